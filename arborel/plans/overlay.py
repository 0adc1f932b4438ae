"""The provided tables as entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.compose import Catalog
from ..schema import Column, Entity, PointerKey, Reference, Registry, Relation, RootKey

LINE = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

REGISTRY = Registry.of(
    Entity("Region", RootKey("r_regionkey", "int"), (Column("r_name", "string", "index"),), (Relation("nations", "Nation"),)),
    Entity("Nation", PointerKey("Region", "n_nationkey", "int"), (Column("n_name", "string", "index"),), (Relation("customers", "Customer"),)),
    Entity("Customer", PointerKey("Nation", "c_custkey", "long"), (Column("c_name", "string", "index"), Column("c_mktsegment", "string", "dictionary"), Column("c_acctbal", "double"))),
    Entity(
        "Order", RootKey("o_orderkey"),
        (Column("o_custkey", "long", pointer="Customer"), Column("o_orderstatus", "string", "index"), Column("o_orderpriority", "string", "dictionary"), Column("o_orderdate", "timestamp", "range"), Column("o_totalprice", "double"), Column("o_weight", "long", transient=True)),
        (Relation("line_items", "LineItem"),), (Reference("parts", "Part", ("line_items", "l_partkey")),),
    ),
    Entity(
        "LineItem", PointerKey("Order", "line_idx", "int"),
        (Column("l_partkey", "long", pointer="Part"), Column("l_suppkey", "long"), Column("l_quantity", "double"), Column("l_extendedprice", "double"), Column("l_returnflag", "string", "dictionary"), Column("l_linestatus", "string", "index"), Column("l_shipdate", "timestamp", "range")),
    ),
    Entity("Part", RootKey("p_partkey"), (Column("p_brand", "string", "dictionary"), Column("p_size", "int", "range"), Column("p_name", "string"))),
    Entity("Document", RootKey("doc_id"), (Column("lang", "string", "dictionary"), Column("source", "string", "index"), Column("n_chars", "long", "range")), (Relation("label", "Label", "optional"),)),
    Entity("Label", PointerKey("Document", kind="optional"), (Column("quality", "int", "index"), Column("toxic", "int", "index"))),
    Entity("Conversation", RootKey("conv_id"), (), (Relation("turns", "Turn"),)),
    Entity("Turn", PointerKey("Conversation", "turn", "long"), (Column("role", "string", "dictionary"), Column("text", "string"))),
    Entity("Event", RootKey("event_id"), (Column("ts", "timestamp", "range"), Column("user_id", "long", "index"), Column("event_type", "string", "dictionary"), Column("value", "double")), (Relation("header", "EventHeader", "one"),)),
    Entity("EventHeader", PointerKey("Event", kind="one"), (Column("height", "long", "range"), Column("hash", "string", "index"), Column("prev_hash", "string", "index"))),
)


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation = t("nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey", "n_name")
    customer = t("customer").join(nation.select("r_regionkey", "n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    # l_linenumber is no key within an order; a total order over all columns gives the index
    index = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE)) - 1
    line = t("lineitem").withColumn("line_idx", index).withColumnRenamed("l_orderkey", "o_orderkey")
    events = t("events")
    return Catalog(REGISTRY, {
        "Region": t("region"), "Nation": nation, "Customer": customer, "Order": t("orders"), "LineItem": line, "Part": t("part"),
        "Document": t("documents"), "Label": t("labels"), "Conversation": t("conversations").select("conv_id").distinct(), "Turn": t("conversations"),
        "Event": events, "EventHeader": headers(events),
    })


def headers(events: DataFrame, broken_every: int = 97) -> DataFrame:
    """A header an event: height event_id + 1, hashes of the ids; at every broken_every-th height prev_hash names nobody."""
    sha = lambda c: F.sha2(c.cast("string"), 256)
    prev = F.when((F.col("event_id") + 1) % broken_every == 0, F.lit("none")).otherwise(sha(F.col("event_id") - 1))
    return events.select("event_id", (F.col("event_id") + 1).alias("height"), sha(F.col("event_id")).alias("hash"), prev.alias("prev_hash"))
