"""Secret scans by multipart credential linking, in DataFrame functions only.

Strong secrets are found by three patterns. Weak candidates (short access identifiers, bare mixed-class strings, endpoints with a
host) alone say nothing; they are reported only where complementary parts stand in one scope: within WINDOW characters of each other, an
identifier or endpoint with a secret, weak or strong. Parts are interval-joined on (document, position divided by WINDOW): a part lies in all cells
from its start to its end and meets those up to WINDOW before and behind, so a document of many parts never forms all pairs.

Positions are code points, ends exclusive. A null or empty text has no spans; rows that repeat get the same spans each. A row is known
by two 64-bit hashes of (doc_id, text). Very long texts are scanned whole. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored, table

# The patterns of the base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs are maximal, so this finds what AKIA[A-Z0-9]+ of 20 and more finds
HEX = r"[0-9a-f]{24,}"
WINDOW = 256
# Parts that count only together, of any length: runs are possessive and look-aheads end with the run, which keeps time linear.
WEAK_ID = r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{6,}+"  # AKIA with 16 and more is also ACCESS's, and dropped as it overlaps
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{16,}+=*+(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?:https?|s3|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@-]{3,}+"
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]


def spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start, kind, end>> of the pattern's leftmost non-overlapping matches. `split` yields what lies between matches, so the
    lengths of both, summed in turn, are the positions; texts without a match are not split."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    step = F.zip_with(F.transform(F.slice(gaps, 1, F.size(found)), lambda g: F.length(g)), F.transform(found, lambda m: F.length(m)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    walked = F.aggregate(step, start, lambda acc, x: F.struct((acc["at"] + x["g"] + x["m"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["g"] + x["m"]).alias("end")))).alias("out")))
    out = F.when(F.size(found) > 0, walked["out"]).otherwise(empty)
    if keep is not None:  # what fails is dropped after matching
        marked = F.zip_with(out, keep(text), lambda s, k: F.struct(s.alias("s"), k.alias("k")))
        out = F.when(F.size(found) > 0, F.transform(F.filter(marked, lambda x: x["k"]), lambda x: x["s"])).otherwise(empty)
    return out


def listed(array: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(array), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, r1, r2, base, weak): the spans of a row's base kinds, and the parts that may count together."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    long_enough = lambda t: F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1)), lambda g: F.length(g) >= 6)
    base = F.concat(spans(F.col("text"), ASSIGN, 0, long_enough), spans(F.col("text"), ACCESS, 1), spans(F.col("text"), HEX, 2))
    weak = F.concat(spans(F.col("text"), WEAK_ID, 3), spans(F.col("text"), WEAK_SECRET, 4), spans(F.col("text"), ENDPOINT, 5))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("r2"), base.alias("base"), weak.alias("weak"))


def linked(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(r1, r2, added): the weak parts of a row that stand near a complementary part and inside no base span."""
    rows = found.where(F.size("weak") > 0).dropDuplicates(["r1", "r2"])
    outside = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    # of complementary roles: whom (1) are identifiers and endpoints, what (2) are secrets
    parts = rows.select("r1", "r2", F.explode(F.concat("base", outside)).alias("s"))
    parts = parts.withColumn("role", F.when(F.col("s.kind").isin(1, 3, 5), 1).otherwise(2))
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / window), F.floor(b / window))).alias("cell")
    near = parts.select("r1", "r2", F.col("s").alias("t"), F.col("role").alias("role2"), cells(F.col("s.start") - window, F.col("s.end") + window))
    met = parts.where("s.kind >= 3").select("r1", "r2", "s", "role", cells(F.col("s.start"), F.col("s.end") - 1)).join(near, ["r1", "r2", "cell"]).where("role <> role2 and t.start < s.end + {0} and s.start < t.end + {0}".format(window))
    return met.groupBy("r1", "r2").agg(F.collect_set("s").alias("added"))


def secrets(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, base, added, r1, r2): arrays of struct(start, kind, end), kind an index of KINDS; a row for each row."""
    found = stored(scanned(docs, id_column, text_column))
    more = linked(found, window)
    out = found.join(more, ["r1", "r2"], "left")
    return out.select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("added"), "r1", "r2")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"),
    )
