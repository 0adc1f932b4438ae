"""The schemas of the chains: blocks, transactions, outputs, inputs, assets."""

from __future__ import annotations

from pyspark.sql import types as T

from ..schema import Column, Entity, Hook, PointerKey, Reference, Registry, Relation, RootKey

HEADER = (Column("hash", "bytes[32]", "index"), Column("prev_hash", "bytes[32]", "index"), Column("timestamp", "u32", "range"))
LINKS = (Relation("header", "Header", "one"), Relation("transactions", "Transaction"))


def demo() -> Registry:
    return Registry.of(
        Entity("Block", RootKey("height", "u32"), (), LINKS),
        Entity("Header", PointerKey("Block", kind="one"), (*HEADER, Column("duration", "duration", "range"), Column("nonce", "i64"), Column("weight", "u32", transient=True))),
        Entity("Transaction", PointerKey("Block", "tx_index"), (Column("hash", "bytes[32]", "index", used=True),), (Relation("utxos", "Utxo"), Relation("inputs", "Input"), Relation("maybe", "MaybeValue", "optional")), (Reference("input_utxos", "Utxo"),)),
        Entity("Utxo", PointerKey("Transaction", "utxo_index"), (Column("amount", "i64"), Column("address", "bytes", "dictionary")), (Relation("assets", "Asset"),)),
        Entity("Asset", PointerKey("Utxo", "asset_index"), (Column("amount", "i64"), Column("name", "bytes", "dictionary"))),
        Entity("Input", PointerKey("Transaction", "input_index"), (Column("utxo_height", "u32", pointer="Block"),)),
        Entity("MaybeValue", PointerKey("Transaction", kind="optional"), (Column("hash", "bytes[32]", "index"),)),
    )


def pointer(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType() if k == 0 else T.IntegerType()) for k, n in enumerate(names)])


OUTPUT = pointer("height", "tx_index", "utxo_index")
REFERENCES = T.ArrayType(T.StructType([T.StructField("hash", T.BinaryType()), T.StructField("index", T.LongType())]))


def utxo_chain(assets: bool = False, slots: bool = False, boxes: bool = False) -> Registry:
    """Bitcoin-like chains; assets and slots for those that have them; boxes: outputs are referenced by an identifier of their own."""
    header = (*HEADER, *((Column("slot", "u32", "range"),) if slots else () if boxes else (Column("merkle_root", "bytes[32]", "index"),)), Column("weight", "u32", transient=True))
    names = (Column("name", "bytes", "dictionary"),) + (() if boxes else (Column("policy_id", "bytes", "dictionary"),))
    tail = (Entity("Asset", PointerKey("Utxo", "asset_index"), (Column("amount", "u64"), Column("asset_action", "u8", "index"), *names)),) if assets else ()
    own = (Column("box_id", "bytes[32]", "index", used=True), Column("address", "bytes", "dictionary"), Column("tree", "bytes", "dictionary")) if boxes else (Column("script_hash", "bytes", "dictionary"), Column("address", "bytes", "dictionary"))
    refs = Column("input_refs", T.ArrayType(T.BinaryType()) if boxes else REFERENCES, transient=True)
    return Registry.of(
        Entity("Block", RootKey("height", "u32"), (), LINKS),
        Entity("Header", PointerKey("Block", kind="one"), header),
        Entity("Transaction", PointerKey("Block", "tx_index"), (Column("hash", "bytes[32]", "index", used=not boxes), refs), (Relation("utxos", "Utxo"), Relation("inputs", "Input")), (Reference("input_utxos", "Utxo", ("inputs", "utxo_pointer")),), Hook("inputs", "input_refs", "utxos" if boxes else "hash")),
        Entity("Utxo", PointerKey("Transaction", "utxo_index"), (Column("amount", "u64"), *own), (Relation("assets", "Asset"),) if assets else ()),
        Entity("Input", PointerKey("Transaction", "input_index"), (Column("utxo_pointer", OUTPUT, pointer="Utxo"),)),
        *tail,
    )
