"""URL filters by hashed expressions.

A rule names a host, with all its subdomains, and a path prefix. Each url is expanded into the expressions of its host suffixes and of
those path prefixes whose length some rule has; expressions meet rules in an equi-join on the first 4 bytes of their SHA-256 digest, and a
meeting counts only if the full digests are equal. Of a url's rules the longest (host and path together) decides; of equally long ones the
longer host, then block before allow.

Urls are first reduced to distinct (host, path) pairs, so a host that holds a third of all pages is expanded once for each of its paths. Rules of
more than MOST_LENGTHS path lengths are an error. The rule table is broadcast only when it holds at most BROADCAST_RULES rows; a longer one is joined by a shuffle on digest prefixes.

A null url, or one without `://`, has an empty host and path and fits no rule. The verdict without a rule is `default`. Rows that repeat are
judged each. Very long urls are read whole: their paths are never expanded beyond the rules' lengths. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import attach, table

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
BROADCAST_RULES = 200_000
MOST_LENGTHS = 65_536
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression, 256))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict): a row for each row of pages. rules: (host, path, verdict)."""
    host, path = host_and_path(F.col("_url"))
    # \x1f can't end a host of a rule, so host and path can't run into one another
    listed = rules.select("host", "path", "verdict").distinct()
    listed = listed.select(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("hl"), F.length("path").alias("pl"), digest(F.concat_ws("\x1f", "host", "path")).alias("full"))
    listed = listed.withColumn("short", F.substring("full", 1, 4))
    few = listed.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    lengths = sorted(r[0] for r in listed.select("pl").distinct().limit(MOST_LENGTHS + 1).collect())  # path lengths, not rules
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"rules of more than {MOST_LENGTHS} path lengths")
    urls = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("_url"))
    urls = urls.select("page_id", host.alias("host"), path.alias("path")).withColumn("place", F.xxhash64("host", F.lit("\x1f"), "path"))
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    exprs = pairs.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))))
    exprs = exprs.select("host", "path", digest(F.concat_ws("\x1f", "suffix", "prefix")).alias("_full")).withColumn("short", F.substring("_full", 1, 4))
    met = exprs.join(F.broadcast(listed) if few else listed, "short").where(F.col("full") == F.col("_full"))
    best = F.max(F.struct(F.col("hl") + F.col("pl"), "hl", F.col("verdict") == "block", "rule", "verdict")).alias("best")
    decided = met.groupBy("host", "path").agg(best).select(F.struct("host", "path").alias("pair"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    keyed = urls.withColumn("pair", F.struct("host", "path"))
    out = attach(keyed, decided, "pair", "page_id")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                     WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                     WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                     WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                     WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
