from pyspark.sql import functions as F

from arborel.llm import common, neardup, queries


def test_attach_spreads_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 50).cast("bigint").alias("k"), F.col("id").alias("v"))
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    got = common.attach(rows, lookup, "k", "v")
    assert got.count() == 3000 and got.where("k < 40 and (w is null or w <> k * 10)").count() == 0 and got.where("k >= 40 and w is not null").count() == 0
    assert common.attach(rows, lookup, "k", "v", "inner").count() == rows.where("k < 40").count()


def test_maybe_in_keeps_all_wanted(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919).alias("k"), F.lit("wide").alias("text"))
    wanted = rows.where("k % 5 = 0").select("k")
    got = common.maybe_in(rows, "k", wanted)
    assert got.columns == rows.columns and got.join(wanted, "k").count() == 4000 and got.count() < 4100
    assert common.maybe_in(rows, "k", wanted.limit(0)).count() == 0


def test_stored_clears_a_grown_driver(spark, monkeypatch):
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    used = lambda: (runtime.totalMemory() - runtime.freeMemory()) >> 20
    spark._jvm.java.lang.System.gc()
    least = used()
    spark.sparkContext._gateway.new_array(spark._jvm.long, 30_000_000)
    monkeypatch.setattr(common, "HEAP", 0.0)
    assert used() > least + 200 and common.stored(spark.range(5)).count() == 5
    assert used() < least + 150


def test_components_with_a_hub(spark):
    links = spark.createDataFrame([(5, i) for i in range(6, 60)] + [(100, 101), (101, 102), (103, 102), (59, 100)], "a bigint, b bigint")
    assert {r.comp for r in common.components(links).collect()} == {5}


def test_band_keys():
    import numpy as np

    rng = np.random.default_rng(2)
    a = rng.integers(1, 60000, 128).astype(np.uint16)
    b = a.copy()
    b[0] ^= 1
    keys, owner = neardup.band_keys([a.tobytes(), b.tobytes(), bytes(256)])
    assert (owner == np.repeat([0, 1], 32)).all() and len(set(keys[:32]) & set(keys[32:])) == 31


def test_registered():
    assert [q for q in queries.queries()] == [*queries.NAMES, "pipeline"] and len(queries.NAMES) == 10
    assert set(queries.oracle_sql()) == {"op3_urls", "op6_chunks"}


