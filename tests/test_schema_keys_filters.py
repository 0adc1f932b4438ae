import pytest
from hypothesis import given, settings, strategies as st

from arborel.functions import filters, keys as K
from arborel.schema import Column, Entity, Hook, PointerKey, Reference, Registry, Relation, RootKey, SchemaError, snake


def block(*extra, **kw):
    return Registry.of(Entity("Block", RootKey("height"), (Column("weight"),), (Relation("transactions", "Transaction"),), **kw), Entity("Transaction", PointerKey("Block", "tx_index"), (Column("hash", "bytes[32]", "index"),)), *extra)


def test_keys_and_order():
    r = block()
    assert r.keys("Transaction") == ["height", "tx_index"] and r.root("Transaction") == "Block" and r.depth("Transaction") == 1
    assert r.write_order("Block") == ["Transaction", "Block"]
    assert r.struct("Transaction").simpleString() == "struct<height:bigint,tx_index:int,hash:binary>"


@pytest.mark.parametrize(
    "make",
    [
        lambda: Registry.of(Entity("A", None)),
        lambda: Registry.of(Entity("A", [RootKey("x"), RootKey("y")])),
        lambda: Registry.of(Entity("A", RootKey("x"), (Column(""),))),
        lambda: Registry.of(Entity("A", RootKey("x"), (), (Relation("things", "B"),)), Entity("B", PointerKey("A", "i"))),
        lambda: Registry.of(Entity("A", RootKey("x"), (), (Relation("bs", "B", "one"),)), Entity("B", PointerKey("A", "i"))),
        lambda: Registry.of(Entity("A", RootKey("x")), Entity("B", PointerKey("A", "i"))),
        lambda: Registry.of(Entity("A", RootKey("x"), (Column("c", "nonsense"),))) and Registry.of(Entity("A", RootKey("x"), (Column("c", "nonsense"),))).struct("A"),
        lambda: Column("c", shards=0),
        lambda: Column.of("c", "u32", indx=True),
        lambda: block(hook=Hook("transactions", "refs", "hash")),
        lambda: block(references=(Reference("x", "Block", ("nowhere", "p")),)),
    ],
)
def test_rules(make):
    with pytest.raises(SchemaError):
        make()


def test_snake():
    assert snake("MaybeValue") == "maybe_value" and snake("Utxo") == "utxo"


def test_key_algebra():
    assert K.next_index((1, 2)) == (1, 3) and K.nth_index((5,), 3) == (8,)
    assert K.rollback_or_init((5,), 9) == (0,) and K.rollback_or_init((5, 7), 2) == (3, 0)
    assert K.child_range((4,)) == ((4, 0), (5, 0)) and K.child_range((4, 1)) == ((4, 1, 0), (4, 2, 0))
    assert K.total_index((1, 2)) == 5 and K.depth((1, 2, 3)) == 2
    assert K.parse("3-1", 2) == (3, 1) and K.text((3, 1)) == "3-1"
    with pytest.raises(K.KeyFormatError):
        K.parse("3-1", 1)
    with pytest.raises(K.KeyNumberError):
        K.parse("3-x", 2)


@settings(max_examples=12, deadline=None)
@given(st.tuples(st.integers(0, 3), st.integers(0, 3)), st.tuples(st.integers(0, 3), st.integers(0, 3)))
def test_ranges_are_lexicographic(spark, a, b):
    grid = spark.range(16).selectExpr("id div 4 as x", "id % 4 as y")
    found = sorted(map(tuple, grid.where(K.between(["x", "y"], a, b)).collect()))
    assert found == [(x, y) for x in range(4) for y in range(4) if a <= (x, y) < b]


def test_range_reaches_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)  # else the plan's text is cut before the second bound
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").where(K.between(["conv_id", "turn"], (3, 1), (9, 0)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(conv_id,3)" in plan and "LessThanOrEqual(conv_id,9)" in plan


def test_filter_parsing():
    assert filters.parse("") is None and filters.parse("{}") == {}
    with pytest.raises(filters.FilterError):
        filters.parse("{oops")
    r = block()
    for bad in ({"height": {"Eq": 1}}, {"nothing": {"Eq": 1}}, {"transactions": {"tx_index": {"Eq": 1}}}):
        with pytest.raises(filters.FilterError):
            filters.check(r, "Block", bad)


def test_operations(spark):
    from pyspark.sql import functions as F

    df = spark.range(5)
    found = lambda op: [x.id for x in df.where(filters.operation(F.col("id"), op)).collect()]
    assert found({"Eq": 2}) == [2] and found({"$lt": 2}) == [0, 1] and found({"Ge": 3}) == [3, 4] and found({"In": []}) == [] and found({"$in": [1, 4]}) == [1, 4]
    with pytest.raises(filters.FilterError):
        filters.operation(F.col("id"), {"Eq": 1, "Lt": 3})
    with pytest.raises(filters.FilterError):
        filters.operation(F.col("id"), {"Like": "x"})
