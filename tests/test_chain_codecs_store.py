import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborel.functions import codecs as C
from arborel.operators import chain, write as W
from arborel.operators.compose import compose
from arborel.plans import overlay
from arborel.schema import Column, Entity, PointerKey, Registry, Relation, RootKey
from arborel.sources import store
from arborel.sources.blocks import BlockSource, demo_chain, processed, raw_blocks, retried
from arborel.sources.store import Store
from arborel.streaming import ingest as I


def test_reorder_buffer():
    b = I.ReorderBuffer(10)
    assert [[h for h, _ in b.push(h)] for h in (12, 12, 10, 11)] == [[], [], [10], [11, 12]]
    b = I.ReorderBuffer(50, hint=4)
    for h in (52, 53, 60, 61, 62, 40):
        b.push(h)
    assert b.gap() == {"from": 50, "to": 62, "pending": 5, "saturated": True} and b.dropped == 1


def test_folds():
    assert list(chain.fold_sizes([10, 20, 25], 50)) == [0, 0, 1] and list(chain.fold_sizes([120], 100)) == [0] and list(chain.fold_sizes([1, 1], 0)) == [0, 1]
    assert list(chain.fold_weights([3, 3, 3, 9, 1], 6)) == [0, 0, 1, 1, 2] and list(chain.fold_weights([1, 1, 1], 100, 2)) == [0, 0, 1]


def test_batches(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.length("text").alias("size"))
    got = {(r.conv_id, r.turn): r.batch for r in chain.size_batches(rows, ["conv_id"], "turn", "size", 2000).collect()}
    by = {}
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append(r)
    assert got == {(r.conv_id, r.turn): n for rs in by.values() for r, n in zip(rs, chain.fold_sizes([r["size"] for r in rs], 2000))}


def test_links_and_forks(spark):
    known = demo_chain(spark, 20)
    assert not chain.broken_links(known, 1, 20, True).count()
    bent = known.withColumn("prev_hash", F.when(F.col("height").isin(7, 20), "x").otherwise(F.col("prev_hash")))
    assert [r.height for r in chain.broken_links(bent, 1, 20).collect()] == [6]
    assert sorted(r.height for r in chain.broken_links(bent, 1, 20, True).collect()) == [6, 19]
    fork = demo_chain(spark, 3, 18).withColumn("hash", F.concat(F.lit("f"), "height")).withColumn("prev_hash", F.when(F.col("height") == 18, F.col("prev_hash")).otherwise(F.concat(F.lit("f"), F.col("height") - 1)))
    assert chain.linked_fork(known, fork, 10).count() == 3
    assert chain.linked_fork(known.where("height < 10"), fork, 10).count() == 0
    assert chain.replaced(known, fork).where("hash like 'f%'").count() == 3 and chain.replaced(known, fork).count() == 20
    assert chain.mode(100, 0, 50) == "batch" and chain.mode(5, 100, 50) == "continuous"
    assert chain.heights(10, None) == (1, 11) and chain.heights(3, 9) == (10, 10)


def test_addresses():
    for chain_, text, data in (
        ("btc", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "0062e907b15cbf27d5425399ebf6f0fb50ebb88f18"),
        ("btc", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", "b000751e76e8199196d454941c45d1b3a323f1433bd6"),
        ("btc", "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0", "b00179be667ef9dcbbac55a06295ce870b07029bfcdb2dce28d959f2815b16f81798"),
    ):
        assert C.address_bytes(chain_, text).hex() == data and C.address_text(chain_, bytes.fromhex(data)) == text
    for bad in ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5", "0OIl"):
        with pytest.raises(C.AddressError):
            C.address_bytes("btc", bad)
    with pytest.raises(C.AddressError):
        C.address_text("btc", b"\x00" * 5)
    rng = random.Random(1)
    for _ in range(50):
        for c, (key, script, prefix) in C.CHAINS.items():
            for data in (bytes([key]) + rng.randbytes(20), bytes([script]) + rng.randbytes(20)) + ((b"\xb0\x00" + rng.randbytes(20), b"\xb0\x01" + rng.randbytes(32)) if prefix else ()):
                assert C.address_bytes(c, C.address_text(c, data)) == data
    assert C.ergo_text(b"") == "EMPTY" and C.ergo_bytes(C.ergo_text(b"\0\1x")) == b"\0\1x"


def test_codec_columns(spark):
    one = spark.sql("SELECT X'61' AS b, X'FF' AS bad")
    r = one.select(C.to_hex(F.col("b")), C.to_base64(F.col("b")), C.to_utf8(F.col("b"))).first()
    assert tuple(r) == ("61", "YQ==", "a")
    with pytest.raises(Exception):
        one.select(C.to_utf8(F.col("bad"))).collect()
    with pytest.raises(Exception):
        spark.sql("SELECT 'zz' AS s").select(C.from_hex(F.col("s"))).collect()
    scripts = {"76a914" + "11" * 20 + "88ac": "00" + "11" * 20, "a914" + "22" * 20 + "87": "05" + "22" * 20, "0014" + "33" * 20: "b000" + "33" * 20, "5120" + "44" * 32: "b001" + "44" * 32, "6a01": "f0", "51": "ff"}
    df = spark.createDataFrame([(bytes.fromhex(s), s) for s in scripts], "script binary, name string")
    assert {r.name: bytes(r.a).hex() for r in df.select("name", C.script_address(F.col("script")).alias("a")).collect()} == scripts
    assert C.cache_shares(10, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 3, "c": 3}


REG = Registry.of(
    Entity("Block", RootKey("height"), (), (Relation("header", "Header", "one"), Relation("txs", "Tx"))),
    Entity("Header", PointerKey("Block", kind="one"), (Column("hash", "string", "index"), Column("prev_hash", "string", "index"))),
    Entity("Tx", PointerKey("Block", "tx_index", "int"), (Column("address", "string", "dictionary"),)),
)


def trees(spark, rows):
    return spark.createDataFrame(rows, "height bigint, header struct<hash:string,prev_hash:string>, txs array<struct<tx_index:int,address:string>>")


def tree(h, *addresses, mark=""):
    return (h, (f"h{h}{mark}", f"h{h - 1}"), [(i, a) for i, a in enumerate(addresses)])


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", REG, span=4)
    s.init()
    s.init()
    assert s.version() == 1
    assert s.persist("Block", trees(spark, [tree(h, "a", f"x{h}") for h in range(1, 10)])) == 2
    assert compose(s.catalog(), "Block").count() == 9
    births = lambda: {r.address: tuple(r.birth) for r in s.dictionary("Tx", "address").collect()}
    assert births()["a"] == (1, 0)
    # an upsert replaces whole trees, and writes only the bucket it touches
    before = s.manifest()["tables"]["Tx"]
    s.persist("Block", trees(spark, [tree(2, "b")]))
    after = s.manifest()["tables"]["Tx"]
    assert [b for b in after if after[b] != before.get(b)] == ["0"]
    assert [r.address for r in s.table("Tx").where("height = 2").collect()] == ["b"]
    # a deleted birth row leaves the birth as long as the value is held
    assert s.remove("Block", spark.createDataFrame([(1,)], "height bigint")) and births()["a"] == (1, 0) and "x1" not in births()
    assert not s.remove("Block", spark.createDataFrame([(1,)], "height bigint"))
    # an older version can still be read whole; a range opens only its buckets
    assert compose(s.catalog(2), "Block").count() == 9 and s.table("Block").count() == 8
    assert len(s.catalog(roots=(8, 10)).frame("Block").inputFiles()) == 1
    s.vacuum()
    assert compose(s.catalog(), "Block").count() == 8
    with pytest.raises(Exception):
        s.manifest(2)
    s.truncate("Block")
    assert s.table("Tx").count() == 0 and s.dictionary("Tx", "address") is None


def test_a_commit_writes_what_it_adds(spark, tmp_path, monkeypatch):
    with monkeypatch.context() as few:
        few.setattr(store, "FAN", 3)
        found = [store.merged(x) for x in ([], [0], [0, 0], [1, 0, 0], [1, 1, 0, 0], [2, 0])]
    assert found == [(0, 0), (0, 0), (2, 1), (2, 1), (4, 2), (0, 0)]
    s = Store(spark, f"file://{tmp_path}/s", REG, span=1000)
    s.init()
    written = lambda: sum(f.stat().st_size for f in (tmp_path / "s").rglob("*.parquet"))
    grown = []
    s.persist("Block", trees(spark, [tree(h, "a", *(f"v{h}.{i}" for i in range(40))) for h in range(1, 60)]))
    for h in (60, 61):
        was = written()
        s.persist("Block", trees(spark, [tree(h, "a", f"x{h}")]))
        grown.append(written() - was)
    assert grown[1] < grown[0] * 1.2 and grown[1] < was / 2  # a block costs its own rows, however many are there
    assert [x for _, x in s.manifest()["tables"]["Tx"]["0"]] == [0, 0, 0]
    monkeypatch.setattr(store, "FAN", 3)
    s.persist("Block", trees(spark, [tree(62, "a", "x62")]))
    assert [x for _, x in s.manifest()["tables"]["Tx"]["0"]] == [1]
    assert s.table("Block").count() == 62 and s.table("Tx").count() == 59 * 41 + 6
    values = {r.address: tuple(r.birth) for r in s.dictionary("Tx", "address").collect()}
    assert s.dictionary("Tx", "address").count() == len(values) == 59 * 40 + 4 and values["a"] == (1, 0) and values["x62"] == (62, 1)
    # keys in several pieces are replaced and deleted, with what hangs below them
    s.replace("Block", trees(spark, [tree(61, "new")]), spark.createDataFrame([(1,), (60,)], "height bigint"))
    assert s.table("Block").count() == 60 and [r.address for r in s.table("Tx").where("height >= 60").orderBy("height", "tx_index").collect()] == ["new", "a", "x62"]
    left = {r.address for r in s.dictionary("Tx", "address").collect()}
    assert {"a", "new", "x62"} <= left and not {"x60", "x61", "v1.0"} & left
    assert len(s.manifest()["tables"]["Tx"]["0"]) == 1
    s.vacuum()
    assert compose(s.catalog(), "Block").count() == 60


def test_ingest_links_and_replaces(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", REG, span=100)
    s.init()
    g = I.Ingest(s, "Block", "Header", I.Settings(fork_detection_heights=5))
    g.persist_or_link(trees(spark, [tree(h, "a") for h in range(1, 8)]), 7)
    fork = [(6, ("h6f", "h5"), []), (7, ("h7f", "h6f"), []), (8, ("h8f", "h7f"), [])]
    assert g.persist_or_link(trees(spark, fork), 3)
    assert [r.hash for r in s.table("Header").orderBy("height").collect()] == ["h1", "h2", "h3", "h4", "h5", "h6f", "h7f", "h8f"]
    assert g.persist_or_link(trees(spark, [(20, ("q", "nobody"), [])]), 3) is None
    assert I.launch(g, s.table("Header"), 8) == 9


def test_streams(spark, tmp_path):
    spark.dataSource.register(BlockSource)
    stream = spark.readStream.format("blocks").option("demo", 25).option("per_batch", 10).load()
    s = Store(spark, f"file://{tmp_path}/s", REG, span=100)
    s.init()
    g = I.Ingest(s, "Block", "Header", I.Settings())

    def build(batch):
        b = batch.select(F.from_json("raw", "height bigint, hash string, prev_hash string").alias("b")).select("b.*")
        return b.select("height", F.struct("hash", "prev_hash").alias("header"), F.array().cast("array<struct<tx_index:int,address:string>>").alias("txs"))

    q = g.start(stream, build, f"{tmp_path}/c")
    q.processAllAvailable()
    import time

    for _ in range(60):
        if s.table("Block").count() == 25:
            break
        time.sleep(1)
    q.stop()
    assert q.exception() is None
    assert [r.height for r in s.table("Block").orderBy("height").collect()] == list(range(1, 26))
    assert not chain.broken_links(s.table("Header"), 1, 25, True).count()


def test_reorder_state(spark, tmp_path):
    for i, part in enumerate([[12, 12], [10], [11, 9], [14]]):
        spark.createDataFrame([("c", h) for h in part], "chain string, height bigint").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema("chain string, height bigint").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = I.reordered(stream, 10).writeStream.format("memory").queryName("reordered").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.height for r in spark.table("reordered").collect()) == [10, 11, 12]


def test_reorder_state_holds_many_heights_a_call():
    """Waiting heights are kept as bits, so the calls of the state grow with blocks of heights and not with heights."""

    class Value:
        def __init__(self):
            self.v = None

        exists = lambda self: self.v is not None
        get = lambda self: self.v

        def update(self, v):
            self.v = v

    class Map(dict):
        calls = 0

        def containsKey(self, k):
            self.calls += 1
            return k in self

        getValue = dict.__getitem__
        updateValue = dict.__setitem__
        removeKey = dict.__delitem__

    class Handle:
        getValueState = lambda self, *a: Value()
        getMapState = lambda self, *a: Map()

    p, b, rng = I.Reorder(10), I.ReorderBuffer(10), random.Random(3)
    p.init(Handle())
    every = [h for h in range(5, 200_000) if h != 150_000] * 2 + [900_000, -70_000]
    rng.shuffle(every)
    for part in (every[:150_000], every[150_000:], [150_000]):
        frames = iter([pd.DataFrame({"height": part[a : a + 10_000]}) for a in range(0, len(part), 10_000)])
        got = [h for f in p.handleInputRows(("c",), frames, None) for h in f["height"].tolist()]
        assert got == [h for x in part for h, _ in b.push(x)]
    assert p.next.get()[0] == b.next == 200_000 and p.waiting.calls < 100 and sorted(p.waiting) == [(900_000 // I.BLOCK,)]


def test_timestamp_text(spark):
    rows = [(0, "1970-01-01 00:00:00"), (-1, "1969-12-31 23:59:59"), (253402300800, "10000-01-01 00:00:00"), (518_766_000_000, "18409-01-15 02:40:00"), (-62_000_000_000, "0005-04-19 09:46:40")]
    got = lambda: [tuple(r) for r in spark.createDataFrame(rows, "s bigint, want string").select("s", C.timestamp_text(F.col("s")).alias("text")).collect()]
    assert got() == rows
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert got() == rows
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_raw_blocks_and_retry(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"height": 1, "hash": "a"}\nbroken\n{"height": 2, "hash": "b"}\n')
    raw = raw_blocks(spark, str(tmp_path / "b.json"))
    assert raw.count() == 3 and sorted(r.height for r in processed(raw, "height bigint, hash string").collect()) == [1, 2]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert retried(flaky, 3, 0, lambda s: None) == "ok"
    with pytest.raises(OSError):
        retried(lambda: (_ for _ in ()).throw(OSError()), 2, 0, lambda s: None)


def test_settings(tmp_path):
    (tmp_path / "s.toml").write_text("start = 5\n")
    s = I.Settings.load(str(tmp_path / "s.toml"), environ={"ARBOREL__NON_DURABLE_BATCHES": "3"})
    assert s.start == 5 and s.non_durable_batches == 3 and s.tasks(16) == 8 and s.cache_mb(64_000) == 8500
    assert [I.durable(b, 3, "batch") for b in range(4)] == [False, False, True, False] and I.durable(0, 3, "continuous")


def test_writes(spark, sf_dir):
    refs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "p int, r string")
    with pytest.raises(W.DoubleSpend):
        W.check_spends(refs, ["p"], ["r"])
    W.check_spends(refs.distinct(), ["p"], ["r"])
    c = overlay.catalog(spark, sf_dir)
    tables = {e: c.frame(e) for e in ("Order", "LineItem")}
    trees_ = compose(c, "Order", c.frame("Order").where("o_orderkey < 5")).withColumn("line_items", F.slice("line_items", 1, 1))
    out = W.upsert_trees(c.registry, "Order", tables, trees_)
    assert out["LineItem"].where("o_orderkey < 5").groupBy("o_orderkey").count().agg(F.max("count")).first()[0] == 1
    hook = W.hook_rows(spark.createDataFrame([(1, [("h", 3), ("g", 4)])], "height int, refs array<struct<hash:string,index:int>>"), ["height"], "refs", "input_index")
    assert [tuple(r) for r in hook.collect()] == [(1, 0, "h", 3), (1, 1, "g", 4)]
    assert json.loads(trees_.limit(1).toJSON().first())["line_items"]
