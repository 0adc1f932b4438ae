"""Blocks of nodes as trees, hooks on write, and an ingest that orders, batches, links and stores."""

import json
import random

import pytest
from pyspark.sql import functions as F

from arborel.operators import chain, write as W
from arborel.operators.compose import compose
from arborel.plans import demo
from arborel.sources import chains
from arborel.sources.store import Store
from arborel.streaming import ingest as I

h = "{:064x}".format


def block(height, spends=(), outputs=1, mark=0, parent_mark=0):
    """A block of one coinbase and one transaction that spends (txid, vout) references."""
    script = {"hex": "76a914" + "11" * 20 + "88ac"}
    coinbase = {"txid": h(1000 + height + mark), "vin": [{"coinbase": "00"}], "vout": [{"value": 50, "scriptPubKey": script}]}
    txs = [coinbase] + ([{"txid": h(5000 + height + mark), "vin": [{"txid": t, "vout": v} for t, v in spends], "vout": [{"value": 0.5, "scriptPubKey": {"hex": "6a"}}] * outputs}] if spends else [])
    return {"height": height, "hash": h(height + mark), "previousblockhash": h(height - 1 + parent_mark), "merkleroot": h(9), "time": height * 600, "tx": txs}


def frame(spark, blocks):
    return spark.createDataFrame([(b["height"], json.dumps(b)) for b in blocks], "height bigint, raw string")


def build(rows):
    return chains.block_trees(rows, "btc")


def test_an_out_of_order_feed_with_forks_and_double_spends(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", demo.utxo_chain(), span=8)
    s.init()
    g = I.Ingest(s, "Block", "Header", I.Settings(min_entity_batch_size=20, fork_detection_heights=4, non_durable_batches=2))
    blocks = [block(1)] + [block(n, [(h(1000 + n - 1), 0)]) for n in range(2, 21)]
    random.Random(1).shuffle(blocks)
    told = [g.arrive(frame(spark, blocks[a : a + 5] + blocks[a : a + 2]), build) for a in range(0, 20, 5)]
    assert told[-1]["tip"] == 20 and told[-1]["waiting"] == 0 and all(t["late"] == 0 for t in told)
    assert not chain.broken_links(s.table("Header"), 1, 20, True).count() and s.table("Block").count() == 20
    spent = {(r.height, r.tx_index, r.input_index): tuple(r.utxo_pointer) for r in s.table("Input").collect()}
    assert spent[(7, 1, 0)] == (6, 0, 0) and spent[(7, 0, 0)] == (0, 0, 65535) and len(spent) == 39
    tree = compose(s.catalog(), "Block").where("height = 7").first()
    assert [(r.height, r.utxo_index) for t in tree.transactions for r in t.input_utxos] == [(6, 0)]
    # late repeats are dropped, a fork replaces what it covers, a gap waits and survives a new ingest
    assert g.arrive(frame(spark, [block(3, [(h(1002), 0)]), block(19, [(h(1018), 0)])]), build)["late"] == 2
    fork = [block(19, [(h(1018), 0)], 2, 300), block(20, [(h(1319), 0)], 2, 300, 300), block(21, [(h(1320), 0)], 2, 300, 300)]
    told = g.arrive(frame(spark, [fork[2], fork[0], fork[1], block(24, [(h(1000), 0)])]), build)
    assert (told["forks"], told["tip"], told["waiting"]) == (2, 21, 1)
    assert [r.hash for r in s.table("Header").where("height >= 19").orderBy("height").collect()] == [bytes.fromhex(h(n + 300))[::-1] for n in (19, 20, 21)]
    again = I.Ingest(s, "Block", "Header", g.settings)
    told = again.arrive(frame(spark, [block(22, [(h(1321), 0)], parent_mark=300), block(23, [(h(1022), 0)])]), build)
    assert (told["tip"], told["waiting"]) == (24, 0) and not chain.broken_links(s.table("Header"), 1, 24, True).count()
    # an output that is spent twice in a block is refused, and nothing of the block is stored
    with pytest.raises(W.DoubleSpend):
        again.arrive(frame(spark, [block(25, [(h(1024), 0), (h(1024), 0)], parent_mark=0)]), build)
    assert s.table("Block").agg(F.max("height")).first()[0] == 24


def test_ergo_and_cardano_trees(spark, tmp_path):
    e = {"header": {"id": h(1), "parentId": h(0), "height": 1, "timestamp": 5999}, "blockTransactions": {"transactions": [
        {"id": h(7), "inputs": [{"boxId": h(70)}], "outputs": [{"boxId": h(71), "value": 9, "ergoTree": "0008cd02" + "11" * 32, "assets": [{"tokenId": h(71), "amount": 4}]}, {"boxId": h(72), "value": 3, "ergoTree": "100204", "assets": [{"tokenId": h(5), "amount": 1}]}]},
        {"id": h(8), "inputs": [{"boxId": h(72)}], "outputs": [{"boxId": h(73), "value": 1, "ergoTree": ""}]}]}}
    raw = spark.createDataFrame([(json.dumps(e),), ("no block",)], "raw string")
    s = Store(spark, f"file://{tmp_path}/e", demo.utxo_chain(True, boxes=True))
    trees = chains.block_trees(raw, "ergo")
    assert trees.first().header.weight == 6 + 2 + 2 + 3 + 2 and trees.first().header.timestamp == 5 and chains.invalid(raw, "ergo").count() == 1
    s.persist("Block", trees)
    assert {(r.tx_index, r.input_index): tuple(r.utxo_pointer) for r in s.table("Input").collect()} == {(0, 0): (0, 0, 0), (1, 0): (1, 0, 1)}
    boxes = {bytes(r.box_id).hex(): (r.tx_index, r.utxo_index, bytes(r.address)) for r in s.table("Utxo").collect()}
    assert boxes[h(73)] == (1, 0, b"") and boxes[h(71)][2][0] == 1 and len(boxes[h(71)][2]) == 38 and boxes[h(72)][2][:4] == b"\x03\x10\x02\x04"
    assert sorted((r.utxo_index, r.asset_action) for r in s.table("Asset").collect()) == [(0, 0), (1, 1)]
    c = {"height": 3, "hash": h(3), "ancestor": h(2), "slot": 77, "timestamp": 9, "transactions": [{"id": h(30), "inputs": [{"transaction": h(29), "index": 1}], "outputs": [{"address": "01ff", "script": None, "lovelace": 5, "assets": [
        {"policy": "aa" * 28, "name": "61", "quantity": 2, "minted": True}, {"policy": "aa" * 28, "name": "62", "quantity": -3, "minted": False}, {"policy": "aa" * 28, "name": "63", "quantity": 3}]}]}]}
    s = Store(spark, f"file://{tmp_path}/c", demo.utxo_chain(True, True))
    trees = chains.block_trees(spark.createDataFrame([(json.dumps(c),)], "raw string"), "cardano")
    assert trees.first().header.weight == 25 + 1 + 1 + 1 + 3 and trees.first().header.slot == 77
    s.persist("Block", trees)
    assert [(r.asset_index, int(r.amount), r.asset_action, bytes(r.name)) for r in s.table("Asset").orderBy("asset_index").collect()] == [(0, 2, 0, b"a"), (1, 3, 2, b"b"), (2, 3, 1, b"c")]
    assert [tuple(r.utxo_pointer) for r in s.table("Input").collect()] == [(0, 0, 0)]


def test_upsert_is_repeatable_and_order_is_checked_across_partitions(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert sorted(map(tuple, W.upsert(table, rows, ["k"]).collect())) == [(1, "a"), (2, "y"), (3, "z")]
    numbered = spark.createDataFrame([(k,) for k in (1, 2, 5, 4, 6, 7)], "k int").coalesce(1).union(spark.createDataFrame([(3,), (8,)], "k int").coalesce(1)).withColumn("_o", F.monotonically_increasing_id())
    assert sorted(r.k for r in W.unsorted(numbered, ["k"], "_o").collect()) == [3, 4]


def test_a_run_of_batches_is_written_by_one_job_a_table(spark, tmp_path, monkeypatch):
    from arborel.plans import system_queries as S

    s = Store(spark, f"file://{tmp_path}/s", S.LINKED, span=40)
    s.init()
    g = I.Ingest(s, "Block", "Header", I.Settings(fork_detection_heights=10, min_entity_batch_size=5, non_durable_batches=3))
    rows = spark.range(1, 201).select(F.col("id").alias("height"), F.to_json(F.struct(F.col("id").alias("height"), F.concat(F.lit("h"), "id").alias("hash"), F.concat(F.lit("h"), F.col("id") - 1).alias("prev_hash"))).alias("raw"))
    commits, commit = [], Store._commit
    monkeypatch.setattr(Store, "_commit", lambda self, *a: commits.append(a) or commit(self, *a))
    told = g.arrive(rows, S.header_trees)
    assert (told["versions"], told["tip"], told["waiting"], s.version()) == (14, 200, 0, 15) and len(commits) == 2
    # each version holds what was there before and its own span
    assert [s.table("Header", s.manifest(v)).agg(F.max("height"), F.count("*")).first()[:] for v in (2, 3, 9)] == [(15, 15), (30, 30), (120, 120)]
    assert s.table("Block").count() == s.table("Header").select("hash").distinct().count() == 200
    s.vacuum()
    assert s.table("Header").count() == 200
    # keys that are there go the other way
    assert s.persist_spans("Block", S.header_trees(rows.where("height <= 20")), [(1, 10), (11, 20)]) == 2 and s.table("Block").count() == 200
