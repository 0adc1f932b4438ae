"""Queries of operators that write, stream, convert or answer requests, over the provided tables, and SQL that gives the same rows."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, functions as F

from ..api import Api
from ..functions import codecs, filters, keys as K, samples
from ..operators import chain, stats, write as W
from ..operators.compose import compose
from ..operators.read import Lines, Reader
from ..schema import Column, Entity, Hook, PointerKey, Registry, Relation, RootKey
from ..sources import chains
from ..sources.blocks import BlockSource, demo_chain, processed, raw_blocks, retried
from ..sources.scratch import folder
from ..sources.store import Conflict, Store
from ..streaming import ingest as I
from . import demo, overlay
from .catalog_queries import CUST, LI, SQL, dates, query, reader

TURNS = "(conv_id > 3 OR (conv_id = 3 AND turn >= 1)) AND (conv_id < 20 OR (conv_id = 20 AND turn < 2))"


def of_lines(spark, lines, schema: str) -> DataFrame:
    """What an iterator of JSON lines holds. Those of a table are read where they are; no line of them passes through the driver."""
    frame = lines.frame if isinstance(lines, Lines) else spark.createDataFrame([(x,) for x in lines], "line string")
    return frame.select(F.from_json("line", schema).alias("x")).select("x.*")


def values(rows: list[tuple], names: str) -> str:
    """SQL of a few constant rows."""
    put = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(put, r)) + ')' for r in rows)}) AS t({names})"


# ---- streams of lines, by their own iterators

ORDER_KEYS = "o_orderkey bigint, o_custkey bigint"


@query("r08_stream_lines", f"SELECT conv_id, turn, role FROM conversations WHERE {TURNS} AND role = 'user'")
def _(spark, d):
    return of_lines(spark, reader(spark, d, "Turn").stream_range((3, 1), (20, 2), {"role": {"Eq": "user"}}), "conv_id bigint, turn bigint, role string")


@query("r10_parent_keys", "SELECT DISTINCT conv_id, conv_id || '-' || turn AS child FROM conversations WHERE conv_id < 20")
def _(spark, d):
    r = reader(spark, d, "Turn")
    return spark.createDataFrame([(*r.parent_key(tuple(k)), K.text(tuple(k))) for k in r.key_range((0, 0), (20, 0)).collect()], "conv_id bigint, child string")


@query("r30_stream_lines", "SELECT o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def _(spark, d):
    r, customers = reader(spark, d, "Order"), reader(spark, d, "Customer").rows.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return of_lines(spark, r.stream_many(r.rows.join(customers, "o_custkey", "left_semi"), {"o_orderstatus": {"Eq": "P"}}), ORDER_KEYS)


@query("r29_many_of_a_segment", f"WITH {LI} SELECT o.o_orderkey, CAST(count(line_idx) AS BIGINT) AS n_items FROM orders o JOIN customer ON c_custkey = o_custkey LEFT JOIN li ON li.o_orderkey = o.o_orderkey WHERE c_mktsegment = 'MACHINERY' GROUP BY 1")
def _(spark, d):
    r, customers = reader(spark, d, "Order"), reader(spark, d, "Customer").rows.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return r.many(r.rows.join(customers, "o_custkey", "left_semi")).select("o_orderkey", F.size("line_items").cast("long").alias("n_items"))


@query("i03_stream_lines", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < (SELECT avg(o_totalprice) FROM orders) AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def _(spark, d):
    r = reader(spark, d, "Order")
    return of_lines(spark, r.stream_by("o_orderstatus", "F", {"o_totalprice": {"Lt": r.rows.agg(F.avg("o_totalprice")).first()[0]}}), ORDER_KEYS)


@query("i04_stream_lines", f"WITH {CUST} SELECT r_regionkey, n_nationkey, c_custkey FROM cu WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0")
def _(spark, d):
    return of_lines(spark, reader(spark, d, "Customer").stream_by("c_mktsegment", "BUILDING", {"c_acctbal": {"Ge": 0.0}}), "r_regionkey int, n_nationkey int, c_custkey bigint")


@query("i07_stream_lines", "SELECT event_id FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def _(spark, d):
    r = reader(spark, d, "Event")
    return of_lines(spark, r.stream_keys_by("user_id", r.rows.agg(F.min("user_id")).first()[0]), "event_id bigint")


@query("i08_stream_lines", "SELECT o_orderkey FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders)")
def _(spark, d):
    r = reader(spark, d, "Order")
    return of_lines(spark, r.stream_keys_by("o_orderpriority", r.rows.agg(F.min("o_orderpriority")).first()[0]), "o_orderkey bigint")


@query("i10_stream_lines", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01' AND o_orderstatus <> 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def _(spark, d):
    return of_lines(spark, reader(spark, d, "Order").stream_range_by("o_orderdate", *dates("1996-01-01", "1996-03-01"), {"o_orderstatus": {"Ne": "F"}}), ORDER_KEYS)


@query("i12_stream_lines", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, d):
    return of_lines(spark, reader(spark, d, "LineItem").stream_parents_by("l_returnflag", "R", {"o_orderstatus": {"Eq": "O"}}), ORDER_KEYS)


@query("r13_table_info_all", """SELECT 'Order' AS entity, 'key' AS "column", 'key' AS access, count(*) AS entries, NULL::BIGINT AS distinct_values FROM orders UNION ALL SELECT 'Order', 'o_custkey', 'plain', count(o_custkey), NULL FROM orders
UNION ALL SELECT 'Order', 'o_orderstatus', 'index', count(o_orderstatus), NULL FROM orders UNION ALL SELECT 'Order', 'o_orderpriority', 'dictionary', count(o_orderpriority), count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'Order', 'o_orderdate', 'range', count(o_orderdate), NULL FROM orders UNION ALL SELECT 'Order', 'o_totalprice', 'plain', count(o_totalprice), NULL FROM orders""")
def _(spark, d):
    return stats.table_info(overlay.catalog(spark, d), "Order", deep=False)


@query("r21_missing_headers", "SELECT event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def _(spark, d):
    from ..operators.compose import missing

    c = overlay.catalog(spark, d)
    kind = c.frames["Event"].agg(F.min("event_type")).first()[0]
    c.frames["EventHeader"] = c.frames["EventHeader"].join(c.frames["Event"].where(F.col("event_type") != kind).select("event_id"), "event_id", "left_semi")
    return missing(c, "Event", "header")


# ---- filters


@query("f12_shape", values([("key", False), ("line_items.l_returnflag", True), ("nowhere", False), ("o_orderstatus", True), ("o_weight", False)], "name, allowed"))
def _(spark, d):
    def allowed(q) -> bool:
        try:
            filters.check(overlay.REGISTRY, "Order", q)
        except filters.FilterError:
            return False
        return True

    asked = {"key": {"o_orderkey": {"Eq": 1}}, "o_weight": {"o_weight": {"Eq": 1}}, "nowhere": {"nowhere": {"Eq": 1}}, "o_orderstatus": {"o_orderstatus": {"Eq": "F"}}, "line_items.l_returnflag": {"line_items": {"l_returnflag": {"Eq": "R"}}}}
    return spark.createDataFrame([(n, allowed(q)) for n, q in asked.items()], "name string, allowed boolean")


@query("f13_pushed_down", values([("o_orderkey", True), ("o_orderstatus", True)], "name, at_scan"))
def _(spark, d):
    """A filter that fails stops a row at the scan: no other column of it is read."""
    r = reader(spark, d, "Order")
    plan = r._tree(r._between(100, 200), {"o_orderstatus": {"Eq": "F"}})._jdf.queryExecution().executedPlan().toString()
    pushed = " ".join(x for x in plan.split("\n") if "PushedFilters" in x)
    return spark.createDataFrame([(c, f"({c}" in pushed) for c in ("o_orderkey", "o_orderstatus")], "name string, at_scan boolean")


def answered(spark, d, method: str, url: str, schema: str, body: str | None = None) -> DataFrame:
    """The lines that a route answers with."""
    status, out = Api(overlay.catalog(spark, d)).handle(method, url, body)
    assert status == 200, (status, list(out))
    return of_lines(spark, out, schema)


TURN = "conv_id bigint, turn bigint, role string"


def route(name: str, sql: str, method: str, url: str, schema: str, body: str | None = None):
    query(name, sql)(lambda spark, d: answered(spark, d, method, url, schema, body))


route("f14_key_range_body", f"SELECT conv_id, turn, role FROM conversations WHERE {TURNS}", "POST", "/turn/turn?from=3-1&until=20-2", TURN)
route("f15_column_range_body", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 12", "POST", "/part/p_size?from=10&until=12", "p_partkey bigint, p_size int")
route("f16_take", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 7", "GET", "/order/take?take=7", ORDER_KEYS)
route("f16_tail", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 7", "GET", "/order/tail?tail=7", ORDER_KEYS)
route("route_get", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7", "GET", "/order/o_orderkey/7", ORDER_KEYS)
route("route_first", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1", "GET", "/order/first", ORDER_KEYS)
route("route_last", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 1", "GET", "/order/last", ORDER_KEYS)
route("route_table_info", "SELECT 'Part' AS entity, 'p_brand' AS \"column\", count(DISTINCT p_brand) AS distinct_values FROM part UNION ALL SELECT 'Part', c, NULL FROM (VALUES ('key'), ('p_size'), ('p_name')) AS t(c)", "GET", "/part/table_info", "entity string, column string, distinct_values bigint")
route("route_range", f"SELECT conv_id, turn, role FROM conversations WHERE {TURNS} AND role <> 'user'", "POST", "/turn/turn?from=3-1&until=20-2", TURN, '{"role": {"Ne": "user"}}')
route("route_range_by", "SELECT p_partkey, p_size FROM part WHERE p_size >= 3 AND p_size < 5 AND p_brand > 'Brand#3'", "POST", "/part/p_size?from=3&until=5", "p_partkey bigint, p_size int", '{"p_brand": {"Gt": "Brand#3"}}')
route("route_by", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey < 100 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)", "POST", "/order/o_orderstatus/P", ORDER_KEYS, '{"o_custkey": {"Lt": 100}}')
route("route_keys_by", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'", "GET", "/order/o_orderstatus/P/o_orderkey", "o_orderkey bigint")
route("route_parents_by", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')", "POST", "/line_item/l_linestatus/O/order", ORDER_KEYS, '{"o_orderstatus": {"Eq": "P"}}')
route("route_children", f"WITH {LI} SELECT o_orderkey, line_idx, l_partkey FROM li WHERE o_orderkey = 7", "GET", "/order/7/line_items", "o_orderkey bigint, line_idx int, l_partkey bigint")


@query("route_parent_key", values([("3",)], "key"))
def _(spark, d):
    return spark.createDataFrame([(json.loads(next(Api(overlay.catalog(spark, d)).handle("GET", "/turn/turn/3-1/parent_key")[1])),)], "key string")


@query("route_exists", "SELECT o_orderkey IS NOT NULL AS there, k AS key FROM (VALUES (7), (-3)) AS t(k) LEFT JOIN orders ON o_orderkey = k AND k >= 0")
def _(spark, d):
    api = Api(overlay.catalog(spark, d))
    status = lambda key: api.handle("HEAD", f"/order/o_orderkey/{key}")[0]
    return spark.createDataFrame([(7, status(7) == 200), (-3, status(999_999_999) == 200)], "key int, there boolean")


@query("c22_json_body", values([("", "none"), ("{bad", "error"), ("{}", "empty"), ('{"o_custkey": {"Lt": 3}}', "filter"), ("[1]", "error"), ("null", "none")], "body, read_as"))
def _(spark, d):
    def kind(body: str) -> str:
        try:
            found = filters.parse(body)
        except filters.FilterError:
            return "error"
        return "none" if found is None else "filter" if found else "empty"

    return spark.createDataFrame([(b, kind(b)) for b in ("", "{bad", "{}", '{"o_custkey": {"Lt": 3}}', "[1]", "null")], "body string, read_as string")


# ---- the store

SHOP = Registry.of(
    Entity("Order", RootKey("o_orderkey"), (Column("o_custkey", "long"), Column("o_orderstatus", "string", "index"), Column("o_orderpriority", "string", "dictionary")), (Relation("line_items", "LineItem"),)),
    Entity("LineItem", PointerKey("Order", "line_idx", "int"), (Column("l_partkey", "long", "index"), Column("l_returnflag", "string", "dictionary"))),
)


def shop_trees(spark, d, where: str = "true") -> DataFrame:
    c = overlay.catalog(spark, d)
    return compose(c, "Order", c.frame("Order").where(where))


def shop(spark, d) -> Store:
    """A new store that holds all orders with their items."""
    s = Store(spark, folder(spark), SHOP)
    s.init()
    s.persist("Order", shop_trees(spark, d))
    return s


LINES_OF = f"WITH {LI} SELECT o_orderkey, line_idx, l_partkey, l_returnflag FROM li"


@query("w02_store_many", LINES_OF)
def _(spark, d):
    return shop(spark, d).table("LineItem")


@query("w03_persist_trees", f"{LINES_OF} WHERE o_orderkey % 4 <> 1 OR line_idx = 0")
def _(spark, d):
    s = shop(spark, d)
    s.persist("Order", shop_trees(spark, d, "o_orderkey % 4 = 1").withColumn("line_items", F.slice("line_items", 1, 1)))
    return s.table("LineItem")


@query("w06_remove", f"{LINES_OF} WHERE o_orderkey >= 500")
def _(spark, d):
    s = shop(spark, d)
    assert s.remove("Order", s.table("Order").where("o_orderkey < 500").select("o_orderkey"))
    return s.table("LineItem")


@query("w09_init", values([("LineItem", 0), ("Order", 0)], "entity, n"))
def _(spark, d):
    s = Store(spark, folder(spark), SHOP)
    s.init()
    s.init()
    return spark.createDataFrame([(e, s.table(e).count()) for e in SHOP.entities], "entity string, n int")


@query("w11_index_of_the_store", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    return Reader(shop(spark, d).catalog(), "Order").keys_by("o_orderstatus", "P")


@query("w13_sorted_files", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_keys, CAST(0 AS BIGINT) AS out_of_order FROM orders")
def _(spark, d):
    """Rows of each file come in the order of their keys."""
    rows = shop(spark, d).table("Order").select("o_orderkey", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))
    from pyspark.sql import Window

    before = F.lag("o_orderkey").over(Window.partitionBy("file").orderBy("place"))
    return rows.withColumn("late", before >= F.col("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("n_keys"), F.sum(F.coalesce("late", F.lit(False)).cast("long")).alias("out_of_order"))


@query("w14_index_after_delete", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 <> 2")
def _(spark, d):
    s = shop(spark, d)
    s.remove("Order", s.table("Order").where("o_orderkey % 5 = 2").select("o_orderkey"))
    return Reader(s.catalog(), "Order").keys_by("o_orderstatus", "F")


@query("w15_dictionary_of_the_store", "SELECT o_orderpriority, min(o_orderkey) AS birth FROM orders GROUP BY 1")
def _(spark, d):
    """The births of values stay when the rows that bore them go."""
    s = shop(spark, d)
    born = s.dictionary("Order", "o_orderpriority").select(F.col("birth.o_orderkey").alias("o_orderkey"))
    s.remove("Order", born)
    return s.dictionary("Order", "o_orderpriority").select("o_orderpriority", F.col("birth.o_orderkey").alias("birth"))


@query("w21_versions", values([(1, 0), (2, 1), (3, 2)], "version, tables"))
def _(spark, d):
    """A version is seen whole or not at all: tables of each that hold rows."""
    s = Store(spark, folder(spark), SHOP)
    s.init()
    s.persist("Order", shop_trees(spark, d, "o_orderkey < 50").withColumn("line_items", F.slice("line_items", 1, 0)))
    s.persist("Order", shop_trees(spark, d, "o_orderkey < 50"))
    return spark.createDataFrame([(v, sum(bool(s.table(e, s.manifest(v)).take(1)) for e in SHOP.entities)) for v in (1, 2, 3)], "version int, tables int")


@query("w22_rollback", "SELECT count(*) AS n, 2 AS version FROM orders")
def _(spark, d):
    """A commit that fails, or that another went before, changes nothing that can be read."""
    s = shop(spark, d)
    try:
        s.persist("Order", shop_trees(spark, d, "o_orderkey < 50").withColumn("o_custkey", F.raise_error(F.lit("broken")).cast("bigint")))
    except Exception as e:  # noqa: BLE001
        assert "broken" in str(e)
    try:
        s._publish(s.manifest())
    except Conflict:
        pass
    return s.table("Order").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(s.version()))


@query("w23_durable", values([("batch", 0, False), ("batch", 1, False), ("batch", 2, True), ("continuous", 0, True), ("continuous", 1, True), ("continuous", 2, True)], "mode, batch, published"))
def _(spark, d):
    return spark.createDataFrame([(m, b, I.durable(b, 3, m)) for m in ("batch", "continuous") for b in range(3)], "mode string, batch int, published boolean")


@query("w24_write_order", values([(0, "Header"), (1, "Utxo"), (2, "Transaction"), (3, "Input"), (4, "Block")], "place, entity"))
def _(spark, d):
    """Children before parents, and a hook's rows after what they refer to."""
    return spark.createDataFrame(list(enumerate(demo.utxo_chain().write_order("Block"))), "place int, entity string")


@query("s20_truncate", values([("LineItem", 0), ("Order", 0)], "entity, n"))
def _(spark, d):
    s = shop(spark, d)
    s.truncate("Order")
    return spark.createDataFrame([(e, s.table(e).count()) for e in SHOP.entities], "entity string, n int")


# ---- blocks: each order is a block, each of its items a transaction that spends an output of the order before


def node_answers(spark, d, chain_: str) -> DataFrame:
    """(height, raw): blocks as a node of the chain would answer. Transaction n of block b spends output 0 of transaction n of block b - 1."""
    line = overlay.catalog(spark, d).frame("LineItem")
    txid = lambda block, n: F.lpad(F.lower(F.hex(block * 100 + n)), 64, "0")
    h, n = F.col("o_orderkey") + 1, F.col("line_idx").cast("long")
    if chain_ == "btc":
        script = F.when(F.col("l_returnflag") == "R", F.lit("76a914" + "11" * 20 + "88ac")).when(F.col("l_returnflag") == "A", F.lit("a914" + "22" * 20 + "87")).otherwise(F.lit("0014" + "33" * 20))
        outs = F.array(F.struct(F.col("l_partkey").cast("decimal(20,8)").alias("value"), F.struct(script.alias("hex")).alias("scriptPubKey")), F.struct(F.lit(0).cast("decimal(20,8)").alias("value"), F.struct(F.lit("6a01").alias("hex")).alias("scriptPubKey")))
        tx = F.struct(n.alias("n"), txid(h, n).alias("txid"), F.array(F.struct(txid(h - 1, n).alias("txid"), F.lit(0).alias("vout"))).alias("vin"), outs.alias("vout"))
    elif chain_ == "cardano":
        minted = F.col("l_returnflag") == "A"
        asset = F.struct(F.lit("aa" * 28).alias("policy"), F.lower(F.hex(F.col("l_linestatus"))).alias("name"), F.when(F.col("l_returnflag") == "R", -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("quantity"), minted.alias("minted"))
        outs = F.array(F.struct(F.lit("01ff").alias("address"), F.lit(None).cast("string").alias("script"), F.col("l_suppkey").alias("lovelace"), F.array(asset).alias("assets")))
        tx = F.struct(n.alias("n"), txid(h, n).alias("id"), F.array(F.struct(txid(h - 1, n).alias("transaction"), F.lit(0).alias("index"))).alias("inputs"), outs.alias("outputs"))
    else:
        box = lambda block, k: F.lpad(F.lower(F.hex(block * 100 + k + 50)), 64, "0")
        token = F.when(F.col("l_returnflag") == "A", box(h, n)).otherwise(F.lit("ee" * 32))
        outs = F.array(F.struct(box(h, n).alias("boxId"), F.col("l_suppkey").alias("value"), F.lit("0008cd02" + "11" * 32).alias("ergoTree"), F.array(F.struct(token.alias("tokenId"), F.col("l_partkey").alias("amount"))).alias("assets")))
        tx = F.struct(n.alias("n"), txid(h, n).alias("id"), F.array(F.struct(box(h - 1, n).alias("boxId"))).alias("inputs"), outs.alias("outputs"))
    txs = line.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(tx)).alias("txs"))
    b = overlay.catalog(spark, d).frame("Order").select("o_orderkey").join(txs, "o_orderkey", "left").withColumn("txs", F.coalesce("txs", F.array().cast(txs.schema["txs"].dataType)))
    block = F.lpad(F.lower(F.hex(h)), 64, "0")
    before = F.lpad(F.lower(F.hex(h - 1)), 64, "0")
    if chain_ == "btc":
        made = F.struct(h.alias("height"), block.alias("hash"), before.alias("previousblockhash"), block.alias("merkleroot"), (h * 600).alias("time"), F.col("txs").alias("tx"))
    elif chain_ == "cardano":
        made = F.struct(h.alias("height"), block.alias("hash"), before.alias("ancestor"), (h * 20).alias("slot"), (h * 600).alias("timestamp"), F.col("txs").alias("transactions"))
    else:
        made = F.struct(F.struct(block.alias("id"), before.alias("parentId"), h.alias("height"), (h * 600_000).alias("timestamp")).alias("header"), F.struct(F.col("txs").alias("transactions")).alias("blockTransactions"))
    return b.select(h.alias("height"), F.to_json(made).alias("raw"))


def stored_chain(spark, d, chain_: str) -> Store:
    registry = {"btc": demo.utxo_chain(), "cardano": demo.utxo_chain(True, True), "ergo": demo.utxo_chain(True, boxes=True)}[chain_]
    s = Store(spark, folder(spark), registry)
    s.init()
    s.persist("Block", chains.block_trees(node_answers(spark, d, chain_), chain_))
    return s


SPENT = f"""WITH {LI}, t AS (SELECT o_orderkey + 1 AS height, line_idx AS tx_index FROM li)
SELECT a.height, a.tx_index, 0 AS input_index, coalesce(b.height, 0) AS to_height, coalesce(b.tx_index, 0) AS to_tx FROM t a LEFT JOIN t b ON b.height = a.height - 1 AND b.tx_index = a.tx_index"""


def inputs(s: Store) -> DataFrame:
    to = F.col("utxo_pointer")
    return s.table("Input").select("height", "tx_index", "input_index", to["height"].alias("to_height"), to["tx_index"].alias("to_tx"))


@query("s06_btc_outputs", f"""WITH {LI} SELECT o_orderkey + 1 AS height, line_idx AS tx_index, CAST(l_partkey AS BIGINT) * 100000000 AS amount,
CASE l_returnflag WHEN 'R' THEN '00{"11" * 20}' WHEN 'A' THEN '05{"22" * 20}' ELSE 'B000{"33" * 20}' END AS address FROM li UNION ALL SELECT o_orderkey + 1, line_idx, 0, 'F0' FROM li""")
def _(spark, d):
    trees = chains.block_trees(node_answers(spark, d, "btc"), "btc")
    return W.explode_trees(demo.utxo_chain(), "Block", trees)["Utxo"].select("height", "tx_index", F.col("amount").cast("long").alias("amount"), F.hex("address").alias("address"))


@query("s06_btc_skips_bad_blocks", "SELECT count(*) AS good, CAST(2 AS BIGINT) AS bad FROM orders")
def _(spark, d):
    raw = node_answers(spark, d, "btc").select("raw").union(spark.createDataFrame([("no block",), ('{"hash": "00"}',)], "raw string"))
    return chains.block_trees(raw, "btc").agg(F.count(F.lit(1)).alias("good")).crossJoin(chains.invalid(raw, "btc").agg(F.count(F.lit(1)).alias("bad")))  # one row each


@query("s06_cardano_assets", f"WITH {LI} SELECT o_orderkey + 1 AS height, line_idx AS tx_index, l_linestatus AS name, l_partkey AS amount, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'R' AND l_partkey > 0 THEN 2 ELSE 1 END AS asset_action FROM li")
def _(spark, d):
    trees = chains.block_trees(node_answers(spark, d, "cardano"), "cardano")
    assets = W.explode_trees(demo.utxo_chain(True, True), "Block", trees)["Asset"]
    return assets.select("height", "tx_index", F.decode("name", "UTF-8").alias("name"), F.col("amount").cast("long").alias("amount"), F.col("asset_action").cast("int").alias("asset_action"))


@query("s06_ergo_assets", f"WITH {LI} SELECT o_orderkey + 1 AS height, line_idx AS tx_index, l_partkey AS amount, CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AS asset_action FROM li")
def _(spark, d):
    trees = chains.block_trees(node_answers(spark, d, "ergo"), "ergo")
    return W.explode_trees(demo.utxo_chain(True, boxes=True), "Block", trees)["Asset"].select("height", "tx_index", F.col("amount").cast("long").alias("amount"), F.col("asset_action").cast("int").alias("asset_action"))


@query("w16_hook_btc", SPENT)
def _(spark, d):
    return inputs(stored_chain(spark, d, "btc"))


@query("w17_hook_cardano", SPENT)
def _(spark, d):
    return inputs(stored_chain(spark, d, "cardano"))


@query("w18_hook_ergo", SPENT)
def _(spark, d):
    return inputs(stored_chain(spark, d, "ergo"))


@query("w20_query_and_write", f"WITH {LI}, t AS (SELECT o_orderkey + 1 AS height, line_idx AS tx_index FROM li) SELECT a.height, CAST(count(*) AS BIGINT) AS spent FROM t a JOIN t b ON b.height = a.height - 1 AND b.tx_index = a.tx_index GROUP BY 1")
def _(spark, d):
    """Outputs that a block's inputs read back through their pointers."""
    blocks = compose(stored_chain(spark, d, "btc").catalog(), "Block")
    found = F.aggregate(F.transform("transactions", lambda t: F.size(t["input_utxos"])), F.lit(0).cast("long"), lambda a, x: a + x)
    return blocks.select("height", found.alias("spent")).where("spent > 0")


def weights(chain_: str, sql: str):
    @query(f"s28_{chain_}_weights", f"SELECT o_orderkey + 1 AS height, CAST({sql} AS BIGINT) AS weight FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
    def _(spark, d):
        return chains.block_trees(node_answers(spark, d, chain_), chain_).select("height", "header.weight")


weights("btc", "6 + 4 * coalesce(n, 0)")
weights("cardano", "25 + 4 * coalesce(n, 0)")
weights("ergo", "6 + 4 * coalesce(n, 0)")


# ---- sources and ingest


@query("s01_block_source", "SELECT CAST(range AS BIGINT) AS height, sha256(CAST(range AS VARCHAR)) AS hash FROM range(1, 31)")
def _(spark, d):
    spark.dataSource.register(BlockSource)
    at = folder(spark)
    stream = spark.readStream.format("blocks").option("demo", 30).option("per_batch", 10).option("per_task", 4).load()
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/c").start(f"{at}/out")
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(f"{at}/out").select("height", F.get_json_object("raw", "$.hash").alias("hash"))


@query("s03_file_connector", "SELECT CAST(range AS BIGINT) AS height, CAST(range * 600 AS BIGINT) AS timestamp FROM range(1, 13)")
def _(spark, d):
    from ..sources.blocks import DemoConnector, FileConnector

    with tempfile.TemporaryDirectory() as at:  # a connector that only the driver calls
        for n in range(1, 13):
            with open(os.path.join(at, f"{n}.json"), "w") as f:
                f.write(DemoConnector(12).block(n))
        c = FileConnector(at)
        return spark.createDataFrame([(n, json.loads(c.block(n))["timestamp"]) for n in range(1, c.tip() + 1)], "height bigint, timestamp bigint")


@query("s04_demo_chain", "SELECT CAST(range AS BIGINT) AS height, sha256(CAST(range AS VARCHAR)) AS hash, sha256(CAST(range - 1 AS VARCHAR)) AS prev_hash FROM range(1, 101)")
def _(spark, d):
    return demo_chain(spark, 100).select("height", "hash", "prev_hash")


@query("s05_retry", values([("fails thrice", "raised", 3), ("fails twice", "ok", 3), ("works", "ok", 1)], "call, outcome, calls"))
def _(spark, d):
    def tried(failures: int) -> tuple[str, int]:
        calls = []

        def call():
            calls.append(1)
            if len(calls) <= failures:
                raise OSError("not now")
            return "ok"

        try:
            return retried(call, 3, 0, lambda s: None), len(calls)
        except OSError:
            return "raised", len(calls)

    return spark.createDataFrame([("works", *tried(0)), ("fails twice", *tried(2)), ("fails thrice", *tried(3))], "call string, outcome string, calls int")


@query("s06_raw_blocks", "SELECT event_id AS height, event_type FROM events")
def _(spark, d):
    at = folder(spark)
    rows = reader(spark, d, "Event").rows.select(F.to_json(F.struct(F.col("event_id").alias("height"), "event_type")).alias("value"))
    rows.union(spark.createDataFrame([("broken",)], "value string")).write.text(at)
    return processed(raw_blocks(spark, at), "height bigint, event_type string")


def recursive(step: str) -> str:
    """Greedy batches by a recursive walk over each conversation's turns."""
    return f"""WITH RECURSIVE r AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
w AS (SELECT conv_id, turn, k, CAST(0 AS BIGINT) AS batch, size AS total, CAST(1 AS BIGINT) AS n FROM r WHERE k = 1
UNION ALL SELECT r.conv_id, r.turn, r.k, {step} FROM w JOIN r ON r.conv_id = w.conv_id AND r.k = w.k + 1) SELECT conv_id, turn, batch FROM w"""


SQL["s07_size_batches"] = recursive("w.batch + CASE WHEN w.total + r.size > 2000 THEN 1 ELSE 0 END, CASE WHEN w.total + r.size > 2000 THEN r.size ELSE w.total + r.size END, w.n + 1")
SQL["s08_weight_batches"] = recursive("w.batch + CASE WHEN w.total >= 2000 OR w.n >= 4 THEN 1 ELSE 0 END, CASE WHEN w.total >= 2000 OR w.n >= 4 THEN r.size ELSE w.total + r.size END, CASE WHEN w.total >= 2000 OR w.n >= 4 THEN 1 ELSE w.n + 1 END")


@query("s09_reorder_buffer", values([(0, None), (1, None), (2, "10"), (3, "11,12"), (4, None), (5, None)], "step, released"))
def _(spark, d):
    b = I.ReorderBuffer(10)
    return spark.createDataFrame([(n, ",".join(str(x) for x, _ in b.push(h)) or None) for n, h in enumerate((12, 12, 10, 11, 11, 14))], "step int, released string")


@query("s10_reordered_stream", "SELECT event_id AS height FROM events WHERE event_id >= 10 AND event_id < (SELECT max(event_id) FROM events) - 5")
def _(spark, d):
    """Heights that arrive twice and out of order over three batches, with one missing near the end, as the state lets them go."""
    I.rocksdb(spark)
    at = folder(spark)
    heights = reader(spark, d, "Event").rows.select(F.lit("c").alias("chain"), F.col("event_id").alias("height"))
    gap = heights.agg(F.max("height")).first()[0] - 5
    for part in (heights.where("height % 3 = 2"), heights.where("height % 3 = 0"), heights.where("height % 3 <> 0")):
        part.where(F.col("height") != gap).coalesce(1).write.mode("append").json(f"{at}/in")
    stream = spark.readStream.schema("chain string, height bigint").option("maxFilesPerTrigger", 1).json(f"{at}/in")
    q = I.reordered(stream, 10).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/c").start(f"{at}/out")
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(f"{at}/out").select("height")


@query("s12_first_gap", "SELECT CAST(0 AS BIGINT) AS dropped_too_low, CAST(5 AS BIGINT) AS pending, max(event_id) - 5 AS gap_from, max(event_id) AS gap_to FROM events")
def _(spark, d):
    heights = reader(spark, d, "Event").rows.select(F.col("event_id").alias("height"))
    return chain.gap_report(heights.where(F.col("height") != heights.agg(F.max("height")).first()[0] - 5), 0)


@query("s13_modes", values([(5, 100, "continuous"), (50, 0, "continuous"), (51, 0, "batch"), (100, 0, "batch")], "tip, last, mode"))
def _(spark, d):
    return spark.createDataFrame([(t, n, chain.mode(t, n, 50)) for t, n in ((100, 0), (50, 0), (51, 0), (5, 100))], "tip int, last int, mode string")


@query("s13_heights", values([(10, None, 1, 11), (10, 4, 5, 11), (3, 9, 10, 10)], "tip, last, first, until"))
def _(spark, d):
    return spark.createDataFrame([(t, n, *chain.heights(t, n)) for t, n in ((10, None), (10, 4), (3, 9))], "tip int, last int, first int, until int")


LINKED = Registry.of(Entity("Block", RootKey("height"), (), (Relation("header", "Header", "one"),)), Entity("Header", PointerKey("Block", kind="one"), (Column("hash", "string", "index"), Column("prev_hash", "string", "index"))))


def linked(spark) -> I.Ingest:
    s = Store(spark, folder(spark), LINKED)
    s.init()
    return I.Ingest(s, "Block", "Header", I.Settings(fork_detection_heights=10, min_entity_batch_size=1000, non_durable_batches=3))


def header_rows(spark, d) -> DataFrame:
    """(height, raw) of a linked chain, a block an event."""
    rows = reader(spark, d, "Event").rows.select((F.col("event_id") + 1).alias("height"))
    sha = lambda c: F.sha2(c.cast("string"), 256)
    return rows.select("height", F.to_json(F.struct("height", sha(F.col("height")).alias("hash"), sha(F.col("height") - 1).alias("prev_hash"))).alias("raw"))


def header_trees(rows: DataFrame) -> DataFrame:
    b = rows.select(F.from_json("raw", "height bigint, hash string, prev_hash string").alias("b")).select("b.*")
    return b.select("height", F.struct("hash", "prev_hash").alias("header"))


HEADERS = "SELECT event_id + 1 AS height, sha256(CAST(event_id + 1 AS VARCHAR)) AS hash FROM events"


@query("s14_ingest_in_batches", HEADERS)
def _(spark, d):
    """Four batches, out of order and with repeats, through reordering, weight batches and publishing."""
    g, rows = linked(spark), header_rows(spark, d)
    for k in (1, 3, 0, 2):
        g.arrive(rows.where((F.col("height") % 4 == k) | (F.col("height") % 9 == 1)), header_trees)
    return g.store.table("Header").select("height", "hash")


@query("s15_persist_or_link", HEADERS.replace("FROM events", "FROM events WHERE event_id < 40"))
def _(spark, d):
    g, rows = linked(spark), header_rows(spark, d)
    g.persist_or_link(header_trees(rows.where("height <= 30")), 30)
    g.persist_or_link(header_trees(rows.where("height > 30 and height <= 40")), 0)
    assert g.persist_or_link(header_trees(rows.where("height between 60 and 70")), 0) is None  # nobody knows its parent
    return g.store.table("Header").select("height", "hash")


@query("s16_chain_link", "SELECT event_id + 1 AS height, CASE WHEN event_id + 1 >= 28 THEN 'fork' || (event_id + 1) ELSE sha256(CAST(event_id + 1 AS VARCHAR)) END AS hash FROM events WHERE event_id < 33")
def _(spark, d):
    g, rows = linked(spark), header_rows(spark, d)
    g.persist_or_link(header_trees(rows.where("height <= 30")), 30)
    own = header_trees(rows.where("height between 28 and 33"))
    fork = own.select("height", F.struct(F.concat(F.lit("fork"), F.col("height")).alias("hash"), F.when(F.col("height") == 28, F.col("header.prev_hash")).otherwise(F.concat(F.lit("fork"), F.col("height") - 1)).alias("prev_hash")).alias("header"))
    assert g.persist_or_link(fork, 0)
    return g.store.table("Header").select("height", "hash")


@query("s17_store_blocks", HEADERS)
def _(spark, d):
    g = linked(spark)
    g.store.persist("Block", header_trees(header_rows(spark, d)))
    return g.store.table("Header").select("height", "hash")


@query("s22_scheduled_stream", "SELECT CAST(range AS BIGINT) AS height, sha256(CAST(range AS VARCHAR)) AS hash FROM range(1, 26)")
def _(spark, d):
    """A ticking query over the demo chain into the store, then stopped without losing a batch."""
    spark.dataSource.register(BlockSource)
    g = linked(spark)
    progress = I.Progress()
    spark.streams.addListener(progress)
    try:
        q = g.start(spark.readStream.format("blocks").option("demo", 25).option("per_batch", 10).load(), header_trees, folder(spark))
        for _ in range(120):
            q.processAllAvailable()
            if g.tip() == 25:
                break
        I.stop(q)
    finally:
        spark.streams.removeListener(progress)
    return g.store.table("Header").select("height", "hash")


@query("s23_launch", "SELECT max(event_id) + 2 AS fresh_chain, CAST(20 AS BIGINT) AS broken_chain, CAST(1 AS BIGINT) AS no_chain FROM events")
def _(spark, d):
    g = linked(spark)
    whole = header_trees(header_rows(spark, d)).select("height", "header.hash", "header.prev_hash")
    tip = whole.agg(F.max("height")).first()[0]
    bent = whole.withColumn("prev_hash", F.when(F.col("height") == 21, F.lit("nobody")).otherwise(F.col("prev_hash")))
    return spark.createDataFrame([(I.launch(g, whole, tip), I.launch(g, bent, tip), I.launch(g, None, tip))], "fresh_chain bigint, broken_chain bigint, no_chain bigint")


@query("s26_variation", "SELECT event_type, round(stddev_pop(value) / avg(value) * 100, 6) AS cv FROM events GROUP BY 1")
def _(spark, d):
    return stats.task_stats(reader(spark, d, "Event").rows, ["event_type"], "value", "event_id").select("event_type", F.round("cv", 6).alias("cv"))


@query("s29_settings", values([("fork_detection_heights", 7), ("max_items", 10000), ("start", 5)], "name, value"))
def _(spark, d):
    with tempfile.TemporaryDirectory() as at:
        with open(os.path.join(at, "s.toml"), "w") as f:
            f.write("start = 5\nfork_detection_heights = 9\n")
        s = I.Settings.load(os.path.join(at, "s.toml"), environ={"ARBOREL__FORK_DETECTION_HEIGHTS": "7"})
    return spark.createDataFrame([(n, getattr(s, n)) for n in ("start", "fork_detection_heights", "max_items")], "name string, value int")


@query("s30_log_levels", values([("", 20), ("debug", 10), ("error", 40), ("info", 20), ("warn", 30)], "asked, level"))
def _(spark, d):
    return spark.createDataFrame([(n, I.logger("arborel.levels", {"ARBOREL_LOG": n} if n else {}).level) for n in ("", "debug", "info", "warn", "error")], "asked string, level int")


# ---- codecs. Published addresses with the bytes that they stand for.

ADDRESSES = [
    ("btc", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "0062e907b15cbf27d5425399ebf6f0fb50ebb88f18"),
    ("btc", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "05b472a266d0bd89c13706a4132ccfb16f7c3b9fcb"),
    ("btc", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", "b000751e76e8199196d454941c45d1b3a323f1433bd6"),
    ("btc", "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0", "b00179be667ef9dcbbac55a06295ce870b07029bfcdb2dce28d959f2815b16f81798"),
]


def coded(name: str, rows: list[tuple]):
    @query(name, values([(a, b, a) for _, a, b in rows], "address, stored, back"))
    def _(spark, d):
        df = spark.createDataFrame([(a,) for _, a, _ in rows], "address string").withColumn("stored", codecs.decode_address(rows[0][0])("address"))
        return df.select("address", codecs.to_hex(F.col("stored")).alias("stored"), codecs.encode_address(rows[0][0])("stored").alias("back"))


coded("c04_base58_vectors", ADDRESSES[:2])
coded("c05_segwit_vectors", ADDRESSES[2:])
coded("c06_address_vectors", ADDRESSES)


@query("c06_address_errors", values([("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", True), ("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", False), ("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5", True)], "address, refused"))
def _(spark, d):
    def refused(text: str) -> bool:
        try:
            codecs.address_bytes("btc", text)
        except codecs.AddressError:
            return True
        return False

    return spark.createDataFrame([(t, refused(t)) for t in ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5")], "address string, refused boolean")


@query("c07_ergo_addresses", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE lower(hex(encode(c_name))) END AS stored, c_custkey % 4 = 0 AS empty_mark FROM customer")
def _(spark, d):
    rows = reader(spark, d, "Customer").rows.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lit(b"")).otherwise(F.encode("c_name", "UTF-8")).alias("b"))
    text = rows.withColumn("address", codecs.encode_address("ergo")("b"))
    return text.select("c_custkey", codecs.to_hex(codecs.decode_address("ergo")("address")).alias("stored"), (F.col("address") == "EMPTY").alias("empty_mark"))


@query("c08_scripts", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '05' || upper(substr(sha256(c_name), 1, 40)) WHEN 1 THEN 'B000' || upper(substr(sha256(c_name), 1, 40))
WHEN 2 THEN 'B001' || upper(sha256(c_name)) ELSE 'B000' || upper(sha256(c_name)) END AS address FROM customer""")
def _(spark, d):
    h = F.unhex(F.sha2(F.col("c_name"), 256))
    head = lambda text: F.lit(bytes.fromhex(text))
    k = F.col("c_custkey") % 4
    script = F.when(k == 0, F.concat(head("a914"), F.substring(h, 1, 20), head("87"))).when(k == 1, F.concat(head("0014"), F.substring(h, 1, 20))).when(k == 2, F.concat(head("5120"), h)).otherwise(F.concat(head("0020"), h))
    return reader(spark, d, "Customer").rows.select("c_custkey", F.hex(codecs.script_address(script)).alias("address"))


@query("c08_litecoin_scripts", "SELECT c_custkey, (CASE c_custkey % 2 WHEN 0 THEN '30' ELSE '32' END) || upper(substr(sha256(c_name), 1, 40)) AS address FROM customer")
def _(spark, d):
    h = F.substring(F.unhex(F.sha2(F.col("c_name"), 256)), 1, 20)
    head = lambda text: F.lit(bytes.fromhex(text))
    script = F.when(F.col("c_custkey") % 2 == 0, F.concat(head("76a914"), h, head("88ac"))).otherwise(F.concat(head("a914"), h, head("87")))
    return reader(spark, d, "Customer").rows.select("c_custkey", F.hex(codecs.script_address(script, "ltc")).alias("address"))


@query("c09_asset_flows", "SELECT o_orderkey, CAST(CASE WHEN o_custkey % 3 = 0 THEN 0 WHEN o_custkey % 3 = 1 THEN 2 ELSE 1 END AS INTEGER) AS action FROM orders")
def _(spark, d):
    k = F.col("o_custkey") % 3
    went_in = F.when(k == 0, 0).when(k == 1, 5).otherwise(5)
    return reader(spark, d, "Order").rows.select("o_orderkey", codecs.asset_action_flows(went_in, F.when(k == 1, 4).otherwise(5)).alias("action"))


@query("c14_byte_increment", values([("", ""), ("00", "01"), ("ff00", "0001"), ("ffff", "0000"), ("0a0b", "0b0b")], "bytes, next"))
def _(spark, d):
    return spark.createDataFrame([(x, samples.next_bytes(bytes.fromhex(x)).hex()) for x in ("", "00", "ff00", "ffff", "0a0b")], "bytes string, next string")


@query("c15_samples", values([("Asset", 81), ("Block", 3), ("Header", 3), ("Input", 27), ("MaybeValue", 9), ("Transaction", 9), ("Utxo", 27)], "entity, n"))
def _(spark, d):
    r = demo.demo()
    return spark.createDataFrame([(e, df.count()) for e, df in samples.frames(spark, r, "Block", samples.sample_many(r, "Block", 3)).items()], "entity string, n int")


@query("c16_next_values", values([("bool", "True", "False"), ("i8", "127", "-128"), ("string", "a", "b"), ("u16", "65535", "0"), ("u8", "255", "0"), ("uuid", "00000000-0000-0000-0000-00000000000f", "00000000-0000-0000-0000-000000000010")], "kind, value, next"))
def _(spark, d):
    asked = [("u8", 255), ("i8", 127), ("u16", 65535), ("bool", True), ("string", "a"), ("uuid", "00000000-0000-0000-0000-00000000000f")]
    return spark.createDataFrame([(k, str(v), str(samples.next_value(k, v))) for k, v in asked], "kind string, value string, next string")


@query("c17_key_buckets", "SELECT o_orderkey, CAST(o_orderkey % 7 AS INTEGER) AS bucket FROM orders")
def _(spark, d):
    return reader(spark, d, "Order").rows.select("o_orderkey", F.pmod("o_orderkey", F.lit(7)).cast("int").alias("bucket")).where(F.lit(all(codecs.key_bucket(k, 7) == k % 7 for k in range(50))))


@query("c19_cache_shares", values([("a", 4), ("b", 3), ("c", 3), ("d", 0)], "name, share"))
def _(spark, d):
    return spark.createDataFrame(list(codecs.cache_shares(10, {"a": 1, "b": 1, "c": 1, "d": 0}).items()), "name string, share int")


@query("c20_ratios", values([(0.0, 1, 1024), (0.5, 8, 8500), (1.0, 16, 16000)], "ratio, tasks, cache_mb").replace("(0.0,", "(0.0::DOUBLE,"))
def _(spark, d):
    return spark.createDataFrame([(p, I.Settings(parallelism=p).tasks(16), I.Settings(parallelism=p).cache_mb(64_000)) for p in (0.0, 0.5, 1.0)], "ratio double, tasks int, cache_mb int")


@query("c21_out_of_order", "SELECT o_orderkey FROM orders WHERE o_orderkey < (SELECT max(o_orderkey) FROM orders)")
def _(spark, d):
    """Keys written in falling order: all but the first are below the one before."""
    rows = reader(spark, d, "Order").rows.select("o_orderkey").orderBy(F.desc("o_orderkey")).withColumn("_o", F.monotonically_increasing_id())
    return W.unsorted(rows, ["o_orderkey"], "_o").select("o_orderkey")
