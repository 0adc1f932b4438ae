"""Trees of the demo schema: reads and filters against an independent evaluator."""

import json

import pytest

from arborel.functions import keys as K, samples as S
from arborel.operators import write as W
from arborel.operators.compose import Catalog, compose
from arborel.operators.read import Reader
from arborel.plans import demo

REG = demo.demo()


@pytest.fixture(scope="module")
def trees():
    return S.sample_many(REG, "Block", 3)


@pytest.fixture(scope="module")
def catalog(spark, trees):
    return Catalog(REG, {k: v.cache() for k, v in S.frames(spark, REG, "Block", trees).items()})


def plain(x):
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, dict):
        return {k: plain(v) for k, v in sorted(x.items()) if k not in ("weight", "input_utxos")}
    return [plain(v) for v in x] if isinstance(x, list) else x


def rows(df):
    return [plain(r.asDict(True)) for r in df.collect()]


def expected(entity, trees):
    def cut(entity, tree, above):
        out = {k: v for k, v in tree.items() if k not in above}
        keys = REG.keys(entity)
        for r in REG[entity].relations:
            v = tree[r.name]
            out[r.name] = [cut(r.child, t, keys) for t in v] if r.kind == "many" else cut(r.child, v, keys) if v else None
        return out

    return [plain(cut(entity, t, [])) for t in trees]


def test_sizes(catalog):
    assert {e: catalog.frame(e).count() for e in REG.entities} == {"Block": 3, "Header": 3, "Transaction": 9, "Utxo": 27, "Asset": 81, "Input": 27, "MaybeValue": 9}


def test_whole_trees(catalog, trees):
    assert sorted(rows(compose(catalog, "Block")), key=lambda r: r["height"]) == expected("Block", trees)


@pytest.mark.parametrize(
    "q",
    [
        {},
        {"header": {"timestamp": {"Ge": 1}}},
        {"transactions": {"hash": {"Ne": bytes(32)}}},
        {"transactions": {"utxos": {"amount": {"In": [1, 7]}}}},
        {"transactions": {"utxos": {"assets": {"amount": {"Lt": 5}}}, "maybe": {"hash": {"Eq": S.advanced("bytes[32]", 1)}}}},
        {"transactions": {"inputs": {"utxo_height": {"Gt": 1}}}},
        {"header": {"nonce": {"Le": 0}}, "transactions": {"utxos": {"address": {"Eq": b"a"}}}},
    ],
)
def test_filters(catalog, trees, q):
    want = [x for t in trees if (x := S.with_query(REG, "Block", t, q)) is not None]
    r = Reader(catalog, "Block")
    assert sorted(rows(r._tree(r.rows, q)), key=lambda r: r["height"]) == expected("Block", want)


def test_reads(catalog):
    b, t, h, u = (Reader(catalog, e) for e in ("Block", "Transaction", "Header", "Utxo"))
    assert [r.height for r in b.range(1, 3).collect()] == [1, 2]
    assert [(r.height, r.tx_index) for r in t.range((1, 1), (2, 3)).collect()] == [(1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
    assert [r.height for r in h.range_by("timestamp", 0, 2).collect()] == [0, 1]
    assert b.first().first().height == 0 and b.last().first().height == 2 and not b.exists(9) and b.get(9).count() == 0
    assert [r.height for r in b.tail(2).collect()] == [1, 2] and b.tail(0).count() == 0
    assert t.parent_key((2, 1)) == (2,) and t.child((1, 1), "utxos").count() == 3 and t.child((1, 1), "maybe").count() == 1
    assert u.get_by("address", b"a").count() == 1 and [r.height for r in u.parents_by("address", b"a").collect()] == [0]
    assert json.loads(next(b.stream_range(0, 1)))["height"] == 0
    assert h.get(1).first().weight == 0  # transient
    assert t.keys_by("hash", S.advanced("bytes[32]", 4)).collect()[0] == (1, 1)


def test_cascade(catalog, spark):
    left = W.delete_many(REG, "Block", {e: catalog.frame(e) for e in REG.entities}, spark.createDataFrame([(0,)], "height bigint"))
    assert {e: df.count() for e, df in left.items()} == {"Block": 2, "Header": 2, "Transaction": 6, "Utxo": 18, "Asset": 54, "Input": 18, "MaybeValue": 6}
    parts = W.explode_trees(REG, "Block", compose(catalog, "Block"))
    assert {e: df.count() for e, df in parts.items()} == {e: catalog.frame(e).count() for e in REG.entities}
    assert parts["Asset"].exceptAll(catalog.frame("Asset")).count() == 0


def test_values():
    assert S.next_value("u8", 255) == 0 and S.next_value("i8", 127) == -128 and S.next_value("string", "a") == "b" and S.next_value("bool", True) is False
    assert S.next_bytes(b"\xff\x00") == b"\x00\x01" and S.next_value("uuid", "00000000-0000-0000-0000-00000000000f").endswith("10")
    assert K.total_index((1, 2, 1)) == 16
    assert demo.utxo_chain(True, True).keys("Asset") == ["height", "tx_index", "utxo_index", "asset_index"]
