"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names (capitalised words after a small letter or comma) and units after numbers become typed placeholders; the rest is lower-cased and cut
into words of letters. Windows of WIDTH template words are hashed, at every offset on both sides. A document is contaminated by an item if,
along one alignment, at least half of the item's windows (COVER, counted exactly) are covered and the slots are consistent: one value of the item always stands for one value in the document and the other way round, so a
question asked anew with other numbers is caught, and a template that fits by chance is not.

Windows with fewer than LITERALS words besides placeholders say nothing and are left out. An item without other windows (number lists, tables)
is found where all its words, values included, stand in a row, from MIN_WORDS words; shorter ones aren't searched. Items shorter than WIDTH words are matched by
one window of their own length at every offset (from MIN_WORDS words). Null or empty texts match nothing, on either side; rows that
repeat share a verdict, being known by two 64-bit hashes of (doc_id, text). Very long texts are read whole. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import maybe_in, stored, table, without

WIDTH, MIN_WORDS, LITERALS, COVER = 8, 5, 4, 0.5
#: Benchmark windows up to which their table is broadcast (28 bytes each); a longer one is joined by a shuffle.
BROADCAST_WINDOWS = 500_000
NAME = r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}[\p{L}'-]*"
NUMBER = r"[0-9]+(?:[.,:][0-9]+)*"
UNIT = r"(?<=<n>\x20?)(?:km/h|km|cm|mm|kg|mg|ml|mph|miles?|meters?|metres?|hours?|minutes?|seconds?|days?|weeks?|years?|dollars?|euros?|pounds?|percent|%|°C|°F|m|g|l|s|h)(?!\p{L})"
CURRENCY = r"[$€£¥](?=<n>)"


def marked(text: Column) -> tuple[Column, Column, Column, Column]:
    """The text with placeholders, and the values that they stand for, in order: names, numbers, units."""
    names = F.regexp_replace(text, NAME, "<a>")
    numbers = F.regexp_replace(names, NUMBER, "<n>")
    units = F.regexp_replace(F.regexp_replace(numbers, UNIT, " <u>"), CURRENCY, "<u> ")
    return units, F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), F.regexp_extract_all(names, F.lit(NUMBER), F.lit(0)), F.regexp_extract_all(numbers, F.lit(rf"{UNIT}|{CURRENCY}"), F.lit(0))


def template(text: Column) -> Column:
    """The template words of a text."""
    spaced = F.regexp_replace(F.lower(marked(F.coalesce(text, F.lit("")))[0]), r"(?<=\p{L})(?=<[anu]>)|(?<=<[anu]>)(?=\p{L})", " ")
    return F.filter(F.split(spaced, r"[^\p{L}<>]+"), lambda w: w != "")


def windows(words: Column, width: int) -> Column:
    """array<bigint>: hashes of the windows at every word; no structs, as long texts have many."""
    last = F.size(words) - width
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))


def literals(words: Column, i, width: int) -> Column:
    return F.size(F.filter(F.slice(words, i + 1, width), lambda w: ~w.isin("<a>", "<n>", "<u>")))


def benchmark_windows(bench: DataFrame, width: int = WIDTH, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, q, h, width, m): every window that says something; m is the item's number of such windows."""
    items = stored(bench.select(F.col(id_column).alias("item_id"), template(F.col(text_column)).alias("words")))
    parts = []
    for w in range(MIN_WORDS, width + 1):
        some = items.where(F.size("words") >= w if w == width else F.size("words") == w)
        cut = some.select("item_id", "words", F.posexplode(windows(F.col("words"), w)).alias("q", "h")).where(literals(F.col("words"), F.col("q"), w) >= min(LITERALS, w - 1))
        parts.append(cut.select("item_id", "q", "h", F.lit(w).alias("width")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return stored(out.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("item_id")).cast("int")))


def raw_words(text: Column) -> Column:
    """The words of a text with their values."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def silent_windows(bench: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """As benchmark_windows, of items that have none there: windows of raw words, end to end and one at the item's end, so all together are the item."""
    items = bench.select("item_id", raw_words(F.col("text")).alias("words")).join(wanted.select("item_id").distinct(), "item_id", "left_anti")
    items = stored(items.where(F.size("words") >= MIN_WORDS))
    out = None
    for w in range(MIN_WORDS, width + 1):
        some = items.where(F.size("words") >= w if w == width else F.size("words") == w).withColumn("n", F.size("words"))
        cut = some.select("item_id", "n", F.posexplode(windows(F.col("words"), w)).alias("q", "h")).where((F.col("q") % w == 0) | (F.col("q") == F.col("n") - w))
        part = cut.select("item_id", "q", "h", F.lit(w).alias("width"))
        out = part if out is None else out.union(part)
    return stored(out.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("item_id")).cast("int")))


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """Two independent 64-bit hashes of a row's id and text, which together know it."""
    return F.struct(F.xxhash64(id_column, text_column).alias("a"), F.xxhash64(text_column, id_column, F.lit(1)).alias("b"))


def leaks(docs: DataFrame, bench: DataFrame, cover: float = COVER, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(rk, item_id, windows): the items found in each row; windows: the item's covered windows along the best alignment."""
    wanted = benchmark_windows(bench)
    row = row_key(id_column, text_column).alias("rk")
    lines = aligned(docs.select(row, template(F.col(text_column)).alias("words")), wanted, cover)
    copies = aligned(docs.select(row, raw_words(F.col(text_column)).alias("words")), silent_windows(bench, wanted), 1.0)
    if lines is None and copies is None:
        return docs.select(row, F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("windows")).where("false")
    whole = None if copies is None else copies.groupBy("rk", "item_id").agg(F.max("hits").alias("windows"))
    if lines is None:
        return whole
    found = consistent(docs, bench, lines, id_column, text_column)
    return found if whole is None else found.union(whole)


def aligned(rows: DataFrame, wanted: DataFrame, cover: float) -> DataFrame | None:
    """(rk, item_id, shift, m, hits): alignments along which at least `cover` of an item's windows are in a row's words; None without windows."""
    facts = wanted.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()  # at most WIDTH rows
    few = sum(r["n"] for r in facts) <= BROADCAST_WINDOWS
    met = None
    for w in sorted(r["width"] for r in facts):
        cut = rows.select("rk", F.posexplode(windows(F.col("words"), w)).alias("p", "h"))
        some = wanted.where(F.col("width") == w).select("item_id", "q", "h", "m")
        hit = (cut.join(F.broadcast(some), "h") if few else maybe_in(cut, "h", some).join(some, "h")).select("rk", "item_id", "m", "p", (F.col("p") - F.col("q")).alias("shift"))
        met = hit if met is None else met.union(hit)
    if met is None:
        return None
    lines = met.groupBy("rk", "item_id", "shift", "m").agg(F.countDistinct("p").alias("hits"))
    return stored(lines.where(F.col("hits") >= F.greatest(F.lit(1), F.ceil(F.col("m") * cover))))


def slots(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, pos, value): the placeholders among a text's template words, with what they stand for."""
    _, names, numbers, units = marked(F.coalesce(text, F.lit("")))
    words = rows.select(key, F.posexplode(template(text)).alias("pos", "word"), names.alias("a"), numbers.alias("n"), units.alias("u")).where(F.col("word").isin("<a>", "<n>", "<u>"))
    nth = F.row_number().over(Window.partitionBy(key, "word").orderBy("pos")) - 1
    value = F.when(F.col("word") == "<a>", F.get("a", F.col("nth"))).when(F.col("word") == "<n>", F.get("n", F.col("nth"))).otherwise(F.get("u", F.col("nth")))
    return words.withColumn("nth", nth).select(key, "pos", F.concat("word", F.lower(value)).alias("value"))


def consistent(docs: DataFrame, bench: DataFrame, lines: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Drops alignments whose slots contradict one another. Only items with slots, and documents aligned with them, are looked at."""
    best = lambda df: df.groupBy("rk", "item_id").agg(F.max("hits").alias("windows"))
    asked = stored(slots(bench.select(F.col("item_id"), F.col("text")), "item_id", F.col("text")))
    open_ = stored(lines.join(asked.select("item_id").distinct(), "item_id", "left_semi"))
    if not open_.take(1):
        return best(lines)
    keyed = docs.select(row_key(id_column, text_column).alias("rk"), F.col(text_column).alias("text")).withColumn("near", F.col("rk.a"))
    keyed = maybe_in(keyed, "near", open_.select(F.col("rk.a").alias("near"))).drop("near")
    texts = keyed.join(open_.select("rk").distinct(), "rk", "left_semi").dropDuplicates(["rk"])
    there = slots(texts, "rk", F.col("text")).withColumnRenamed("value", "said")
    pairs = open_.join(asked, "item_id").withColumn("pos", F.col("pos") + F.col("shift")).join(there, ["rk", "pos"])
    group = ["rk", "item_id", "shift"]
    wrong = [pairs.groupBy(*group, a).agg(F.min(b).alias("x"), F.max(b).alias("y")).where("x <> y").select(*group) for a, b in (("value", "said"), ("said", "value"))]
    return best(lines.join(wrong[0].union(wrong[1]).distinct(), group, "left_anti"))


def without_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows that hold no benchmark item, with all their columns, whatever their names."""
    bad = stored(leaks(docs, bench).select("rk.a", "rk.b").distinct())
    return without(docs, [row_key()["a"], row_key()["b"]], bad)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """(doc_id, contaminated, n_items, items): items are ids, ascending, comma-joined."""
    docs = table(spark, sf_dir, "documents")
    found = leaks(docs, table(spark, sf_dir, "benchmark")).groupBy("rk").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    rows = docs.select("doc_id", row_key().alias("rk")).join(found, "rk", "left")
    return rows.select("doc_id", F.col("ids").isNotNull().alias("contaminated"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("items"))
