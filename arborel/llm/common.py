"""Shared pieces: reading tables, shared-folder tables, joins that survive hot keys, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: Java regular expression of a word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Salts over which the rows of one key are spread.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a local one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file:///tmp/checkpoints/arborel"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it again: cuts the lineage, survives lost executors, and gives
    the planner exact sizes. The path is kept on the DataFrame so that `discard` can delete it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arborel-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._arborel_path = path
    tidy(spark)
    return out


#: Share of the driver's largest heap that it may have taken before `tidy` clears it.
HEAP = 0.4


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage where its heap has grown: broadcasts and plans of jobs that are over stay until the heap is full otherwise, so
    the driver's memory would grow with the number of jobs. A full collection also gives memory back."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP * runtime.maxMemory():
        spark._jvm.java.lang.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes a table written by `stored` that no later plan reads."""
    if path := getattr(df, "_arborel_path", None):
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows and bytes of an Arrow batch: whole texts stay small beside an executor's memory, however long they are.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_ROWS and BATCH_BYTES where it has the defaults, for operators that hand texts to Python."""
    for name, usual, most in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", str(64 << 20), BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name, usual) in (usual, f"{usual}b", "64MB", "64m"):
            spark.conf.set(name, str(most))


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def attach(rows: DataFrame, lookup: DataFrame, key: str, spread, how: str = "left", salts: int = SALTS) -> DataFrame:
    """rows left/inner join lookup on a non-null key, of which one value may hold a third of all rows. The rows of a key are
    spread over `salts` sub-keys by the column `spread`; only the distinct sub-keys (at most `salts` a key) meet the lookup row."""
    (salt,) = free(rows, "_salt")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    sub = salted.select(key, salt).distinct().join(lookup, key, "inner")
    return salted.join(sub, [key, salt], how).drop(salt)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links(a long, b long): rows (node, comp), comp the smallest node reached; only nodes with links. Stored.

    Distributed union-find by alternating large-star and small-star steps (Kiveris et al., 2014). Each round is one job, whose state is a written
    table, and which tells by an observed flag whether anything moved. A node's minimum is pre-aggregated map-side and met in a join on the
    node, whose partitions adaptive execution splits, so a hub's links never are in one task."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        watch = Observation()
        after = stored(_small_star(_large_star(edges)).observe(watch, F.max("moved").alias("moved")))
        discard(edges)
        edges = after
        if not watch.get["moved"]:
            break
    else:
        raise RuntimeError("connected components did not settle")
    out = stored(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v"), F.col("v"))).distinct())
    discard(edges)
    return out


def _starred(arcs: DataFrame) -> DataFrame:
    """arcs(u, v) with m, the smallest neighbour of u or u itself."""
    return arcs.join(arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    return _starred(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved"))


def _small_star(edges: DataFrame) -> DataFrame:
    # every node sends its neighbours, and itself, to its minimum
    met = edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u").select("m", F.col("moved") | (F.col("v") != F.col("m")), F.explode(F.array("u", "v")).alias("x")).toDF("m", "moved", "x").where("x <> m")
    return met.groupBy(F.col("x").alias("u"), F.col("m").alias("v")).agg(F.max("moved").alias("moved"))


#: Bits of the membership bitmap: 4,096 rows of 4 KB, so at most 16 MB are ever broadcast.
BITMAP_BITS = 1 << 27


def flagged(rows: DataFrame, key: str, wanted: DataFrame, mark: str = "_maybe") -> DataFrame:
    """rows with a column `mark`: true where the long `key` is in wanted's first column, and for few others as long as the wanted keys are
    fewer than BITMAP_BITS. A bitmap of fixed size is broadcast, so no row moves. All columns stay, whatever their names."""
    at = lambda k: F.pmod(F.xxhash64(k), F.lit(BITMAP_BITS)) + 1
    place, bucket, words = free(rows, "_place", "_bucket", "_words")
    bits = wanted.select(at(F.col(wanted.columns[0])).alias("p")).groupBy(F.bitmap_bucket_number("p").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b"))
    # words of four bytes, so that a test is a look-up and a shift
    unsigned = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.conv(F.hex(F.substring(F.col("b"), i * 4 + 1, F.lit(4))), 16, 10).cast("bigint"))
    bits = bits.select(bucket, F.transform(unsigned, lambda w: F.when(w >= 1 << 31, w - (1 << 32)).otherwise(w).cast("int")).alias(words))
    keyed = rows.withColumn(place, at(F.col(key))).withColumn(bucket, F.bitmap_bucket_number(place)).withColumn(place, F.bitmap_bit_position(place).cast("int"))
    bit = F.expr(f"shiftright(get({words}, {place} div 32), (3 - ({place} div 8) % 4) * 8 + {place} % 8) & 1")
    return keyed.join(F.broadcast(bits), bucket, "left").withColumn(mark, F.coalesce(bit == 1, F.lit(False))).drop(place, bucket, words)


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows that are wanted (by wanted's column of the name), and few others: wide rows that nobody wants are dropped before any shuffle. An exact join follows."""
    (mark,) = free(rows, "_maybe")
    return flagged(rows, key, wanted.select(key), mark).where(mark).drop(mark)


def without(rows: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """The rows whose non-null keys, the first a long, aren't in gone's columns, with all their columns, whatever the names. Rows that the bitmap
    clears stay where they are; only the others are shuffled."""
    *names, mark = free(rows, *(f"_key{k}" for k in range(len(keys))), "_maybe")
    keyed = rows.select("*", *(k.alias(n) for k, n in zip(keys, names)))
    marked = flagged(keyed, names[0], gone, mark)
    cleared = marked.where(~F.col(mark)).drop(mark)
    left = marked.where(mark).drop(mark).join(gone.toDF(*names), names, "left_anti")
    return cleared.unionByName(left).drop(*names)
