"""Blocks of nodes as trees: JSON answers, a line a block, to block, header, transactions, outputs, references and assets. Lines that are no block
of the chain are skipped (`invalid` has them). Inputs are made when the trees are stored, by the schema's hook."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..functions import codecs
from ..operators.write import COINBASE

# The forms of the answers.
FORMS = {
    "btc": "height bigint, hash string, previousblockhash string, merkleroot string, time bigint, tx array<struct<txid string, vin array<struct<txid string, vout bigint>>, vout array<struct<value decimal(20,8), scriptPubKey struct<hex string>>>>>",
    "cardano": "height bigint, hash string, ancestor string, slot bigint, timestamp bigint, transactions array<struct<id string, inputs array<struct<transaction string, index bigint>>, outputs array<struct<address string, script string, lovelace decimal(20,0), assets array<struct<policy string, name string, quantity decimal(20,0), minted boolean>>>>>>",
    "ergo": "header struct<id string, parentId string, height bigint, timestamp bigint>, blockTransactions struct<transactions array<struct<id string, inputs array<struct<boxId string>>, outputs array<struct<boxId string, value decimal(20,0), ergoTree string, assets array<struct<tokenId string, amount decimal(20,0)>>>>>>>",
}
LIKE_BTC = {"btc", "bch", "ltc"}


def parsed(raw: DataFrame, chain: str, column: str = "raw") -> DataFrame:
    """raw with `b`, the answer; its height is null where the line is no block."""
    return raw.withColumn("b", F.from_json(column, FORMS["btc" if chain in LIKE_BTC else chain]))


def _height(chain: str) -> Column:
    return F.col("b.header.height" if chain == "ergo" else "b.height")


def invalid(raw: DataFrame, chain: str, column: str = "raw") -> DataFrame:
    """The lines that are no block."""
    return parsed(raw, chain, column).where(_height(chain).isNull()).drop("b")


def internal(text: Column) -> Column:
    """Bytes of a hash that nodes show in reverse."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(text, F.lit("(..)"), F.lit(1))), ""))


def indexed(array: Column, make) -> Column:
    """The array's items as made of (item, index)."""
    return F.transform(F.coalesce(array, F.array()), make)


def spent(ref: Column, txid: str, index: str, read) -> Column:
    """(hash, index) of a reference; one without a hash spends nothing."""
    none = ref[txid].isNull()
    return F.struct(F.when(none, F.lit(bytes(32))).otherwise(read(ref[txid])).alias("hash"), F.when(none, F.lit(COINBASE)).otherwise(ref[index].bitwiseAND(COINBASE)).cast("long").alias("index"))


def _amount(value: Column) -> Column:
    return value.cast("decimal(20,0)").alias("amount")


def btc_trees(raw: DataFrame, chain: str = "btc", column: str = "raw") -> DataFrame:
    """Trees of bitcoin, bitcoin cash and litecoin."""
    b = parsed(raw, chain, column).where("b.height is not null").select("b.*")

    def output(o, k):
        script = F.coalesce(F.unhex(o["scriptPubKey"]["hex"]), F.lit(b""))
        return F.struct(k.alias("utxo_index"), _amount(o["value"] * 100_000_000), script.alias("script_hash"), codecs.script_address(script, chain).alias("address"))

    def transaction(t, k):
        refs = F.transform(F.coalesce(t["vin"], F.array()), lambda i: spent(i, "txid", "vout", internal))
        return F.struct(k.alias("tx_index"), internal(t["txid"]).alias("hash"), indexed(t["vout"], output).alias("utxos"), refs.alias("input_refs"))

    txs = indexed(F.col("tx"), transaction)
    weight = F.aggregate(F.coalesce("tx", F.array()), F.lit(6).cast("long"), lambda w, t: w + 1 + F.size(F.coalesce(t["vin"], F.array())) + F.size(F.coalesce(t["vout"], F.array())))
    header = F.struct(internal(F.col("hash")).alias("hash"), F.coalesce(internal(F.col("previousblockhash")), F.lit(bytes(32))).alias("prev_hash"), F.col("time").alias("timestamp"), internal(F.col("merkleroot")).alias("merkle_root"), weight.alias("weight"))
    return b.select("height", header.alias("header"), txs.alias("transactions"))


def cardano_trees(raw: DataFrame, column: str = "raw") -> DataFrame:
    b = parsed(raw, "cardano", column).where("b.height is not null").select("b.*")

    def asset(a, k):
        action = F.when(F.coalesce(a["minted"], F.lit(False)), codecs.MINT).when(a["quantity"] < 0, codecs.BURN).otherwise(codecs.TRANSFER)
        return F.struct(k.alias("asset_index"), _amount(F.abs(a["quantity"])), action.cast("smallint").alias("asset_action"), F.unhex(a["name"]).alias("name"), F.unhex(a["policy"]).alias("policy_id"))

    def output(o, k):
        of = lambda c: F.coalesce(F.unhex(o[c]), F.lit(b""))
        return F.struct(k.alias("utxo_index"), _amount(o["lovelace"]), of("script").alias("script_hash"), of("address").alias("address"), indexed(o["assets"], asset).alias("assets"))

    def transaction(t, k):
        refs = F.transform(F.coalesce(t["inputs"], F.array()), lambda i: spent(i, "transaction", "index", F.unhex))
        return F.struct(k.alias("tx_index"), F.unhex(t["id"]).alias("hash"), indexed(t["outputs"], output).alias("utxos"), refs.alias("input_refs"))

    header = F.struct(F.unhex("hash").alias("hash"), F.coalesce(F.unhex("ancestor"), F.lit(bytes(32))).alias("prev_hash"), "timestamp", "slot", weighed(F.col("transactions"), 25).alias("weight"))
    return b.select("height", header.alias("header"), indexed(F.col("transactions"), transaction).alias("transactions"))


def weighed(transactions: Column, base: int) -> Column:
    """A block's weight: base, and one for each transaction, input, output and asset."""
    assets = lambda t: F.aggregate(F.coalesce(t["outputs"], F.array()), F.lit(0).cast("long"), lambda n, o: n + 1 + F.size(F.coalesce(o["assets"], F.array())))
    return F.aggregate(F.coalesce(transactions, F.array()), F.lit(base).cast("long"), lambda w, t: w + 1 + F.size(F.coalesce(t["inputs"], F.array())) + assets(t))


# Kinds of addresses on the main network, and the head of a tree that asks for one key.
KEY_ADDRESS, SCRIPT_ADDRESS, KEY_TREE = b"\x01", b"\x03", bytes.fromhex("0008cd")


def tree_address(tree: bytes) -> bytes:
    """Kind, content and checksum of the address that a tree belongs to: its key, or the tree itself."""
    body = KEY_ADDRESS + tree[3:] if tree.startswith(KEY_TREE) and len(tree) == 36 else SCRIPT_ADDRESS + tree
    return body + hashlib.blake2b(body, digest_size=32).digest()[:4]


def _addresses(trees: pd.Series) -> pd.Series:
    return trees.map(lambda x: [] if x is None else [tree_address(bytes.fromhex(t)) if t else b"" for t in x])


def ergo_trees(raw: DataFrame, column: str = "raw") -> DataFrame:
    b = parsed(raw, "ergo", column).where("b.header.height is not null").select("b.header", F.coalesce("b.blockTransactions.transactions", F.array()).alias("txs"))
    # addresses need a checksum that has no built-in function: all of a block at once
    b = b.withColumn("found", pandas_udf(_addresses, T.ArrayType(T.BinaryType()))(F.transform(F.flatten(F.transform("txs", lambda t: F.coalesce(t["outputs"], F.array()))), lambda o: F.coalesce(o["ergoTree"], F.lit("")))))
    sizes = F.transform("txs", lambda t: F.size(F.coalesce(t["outputs"], F.array())))
    b = b.withColumn("sizes", sizes)

    def transaction(t, k):
        before = F.aggregate(F.slice("sizes", 1, k), F.lit(0), lambda n, x: n + x)
        first = F.get(t["outputs"], F.lit(0))["boxId"]

        def asset(a, j):
            return F.struct(j.alias("asset_index"), _amount(a["amount"]), F.when(a["tokenId"] == first, codecs.MINT).otherwise(codecs.TRANSFER).cast("smallint").alias("asset_action"), F.unhex(a["tokenId"]).alias("name"))

        def output(o, j):
            return F.struct(j.alias("utxo_index"), _amount(o["value"]), F.unhex(o["boxId"]).alias("box_id"), F.get("found", before + j).alias("address"), F.coalesce(F.unhex(o["ergoTree"]), F.lit(b"")).alias("tree"), indexed(o["assets"], asset).alias("assets"))

        refs = F.transform(F.coalesce(t["inputs"], F.array()), lambda i: F.unhex(i["boxId"]))
        return F.struct(k.alias("tx_index"), F.unhex(t["id"]).alias("hash"), indexed(t["outputs"], output).alias("utxos"), refs.alias("input_refs"))

    header = F.struct(F.unhex("header.id").alias("hash"), F.coalesce(F.unhex("header.parentId"), F.lit(bytes(32))).alias("prev_hash"), F.floor(F.col("header.timestamp") / 1000).alias("timestamp"), weighed(F.col("txs"), 6).alias("weight"))
    return b.select(F.col("header.height").alias("height"), header.alias("header"), indexed(F.col("txs"), transaction).alias("transactions"))


def block_trees(raw: DataFrame, chain: str, column: str = "raw") -> DataFrame:
    """Trees of a chain's blocks."""
    if chain in LIKE_BTC:
        return btc_trees(raw, chain, column)
    return {"cardano": cardano_trees, "ergo": ergo_trees}[chain](raw, column)
