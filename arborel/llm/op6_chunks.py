"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so: a chunk ends after the first white space at least MIN characters in that follows a trigger
letter, or at MAX characters. Cuts depend on the text near them alone, so equal passages yield equal chunks wherever they stand.
Chunks are deduplicated over the whole corpus by a 64-bit identifier, which is verified: all chunks under one identifier must have one SHA-256
digest. (Should two chunks ever share one, digests serve as identifiers instead.) A text's recipe is the ordered list of its chunks'
identifiers; two texts are equal when the lists are. Long texts never move: chunks go through the aggregation as 40 bytes each, recipes as 8
bytes a chunk. `chunk_table` gives the chunks themselves, each once.

Null counts as the empty text; its recipe is the empty list. Of equal texts the row with the largest doc_id stays (nulls are the
smallest); rows that repeat under one doc_id share its fate, so both are kept where that id stays. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import attach, stored, table, without

MIN, MAX = 512, 4096
#: lazily up to a trigger letter before white space; else up to MAX characters; `.` takes line ends too
CUT = rf"(?s).{{{MIN},{MAX - 2}}}?[ntra]\s|.{{1,{MAX}}}"


def chunks(text: Column) -> Column:
    """The chunks of a text in order; they concatenate to the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CUT), F.lit(0))


def parts(text: Column) -> Column:
    """array<struct<id, full>>: of each chunk in order the 64-bit identifier and the SHA-256 digest that verifies it."""
    return F.transform(chunks(text), lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("full")))


def ambiguous(rows: DataFrame) -> DataFrame:
    """Identifiers that more than one distinct chunk of the corpus has. The aggregation is the deduplication: one row a distinct chunk leaves each task."""
    return rows.select(F.explode("parts").alias("p")).groupBy("p.id").agg(F.min("p.full").alias("lo"), F.max("p.full").alias("hi")).where("lo <> hi")


def chunk_table(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Each distinct chunk once: (chunk_id, chunk, uses, verified). verified: all uses agree in length and in a second, independent hash."""
    one = docs.select(F.explode(chunks(F.col(text_column))).alias("chunk")).withColumn("chunk_id", F.unhex(F.sha2("chunk", 256)))
    made = one.groupBy("chunk_id").agg(F.min("chunk").alias("chunk"), F.count(F.lit(1)).alias("uses"), F.min(F.xxhash64("chunk")).alias("h0"), F.max(F.xxhash64("chunk")).alias("h1"), F.min(F.length("chunk")).alias("l0"), F.max(F.length("chunk")).alias("l1"))
    return made.select("chunk_id", "chunk", "uses", ((F.col("h0") == F.col("h1")) & (F.col("l0") == F.col("l1"))).alias("verified"))


def recipes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, place, recipe, text_sha256): a row for each row; place is a hash of its id and text. Stored."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = stored(docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(id_column, text_column).alias("place"), parts(F.col(text_column)).alias("parts"), F.sha2(text, 256).alias("text_sha256")))
    field = "full" if ambiguous(rows).take(1) else "id"
    return rows.select("doc_id", "place", F.transform("parts", lambda p: p[field]).alias("recipe"), "text_sha256")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, place): a row for each row."""
    rows = recipes(docs, id_column, text_column)
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    out = attach(rows, groups, "recipe", "doc_id")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "place")


def one_each(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns, whatever their names; rows that repeat under one id share its fate."""
    gone = stored(exact_groups(docs).where("not kept").select("place", "text_sha256").distinct())
    return without(docs, [F.xxhash64("doc_id", "text"), F.sha2(F.coalesce("text", F.lit("")), 256)], gone)


def op6_chunks(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("place")


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
