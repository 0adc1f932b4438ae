"""A query for each operator over the provided tables, and SQL that gives the same rows. Trees are flattened; amounts are whole cents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import codecs, keys as K
from ..operators import chain, stats, write as W
from ..operators.compose import compose, missing
from ..operators.read import Reader
from . import overlay

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return put


def reader(spark, sf_dir: str, entity: str) -> Reader:
    return Reader(overlay.catalog(spark, sf_dir), entity)


ORDER = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice"
LINE = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate"
#: line items under orders, with the index that the catalog gives them
LI = """li AS (SELECT l_orderkey AS o_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INTEGER) AS line_idx, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate FROM lineitem)"""
CUST = "cu AS (SELECT n_regionkey AS r_regionkey, n_nationkey, c_custkey, c_name, c_mktsegment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def orders(df: DataFrame) -> DataFrame:
    """Composed orders: their own columns, and facts of the nested items."""
    items = F.col("line_items")
    return df.select(*ORDER.split(", "), F.size(items).cast("long").alias("n_items"), F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + F.round(x["l_extendedprice"] * 100).cast("long")).alias("cents"), F.size("parts").cast("long").alias("n_parts"))


def orders_sql(where: str = "TRUE", items: str = "TRUE", join: str = "LEFT JOIN", tail: str = "") -> str:
    return f"""WITH {LI}, x AS (SELECT o_orderkey, count(*) AS n_items, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(p_partkey) AS n_parts
FROM li LEFT JOIN part ON p_partkey = l_partkey WHERE {items} GROUP BY 1)
SELECT {", ".join("o." + c for c in ORDER.split(", "))}, coalesce(n_items, 0) AS n_items, coalesce(cents, 0) AS cents, coalesce(n_parts, 0) AS n_parts
FROM orders o {join} x ON x.o_orderkey = o.o_orderkey WHERE {where} {tail}"""


def flat_lines(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", "o_orderdate", F.explode("line_items").alias("x")).select("o_orderkey", "o_orderdate", "x.*")


def lines_sql(where: str) -> str:
    return f"WITH {LI} SELECT o.o_orderkey, o_orderdate, line_idx, {LINE} FROM orders o JOIN li ON li.o_orderkey = o.o_orderkey WHERE {where}"


# ---- reads by key


@query("r01_get", orders_sql("o.o_orderkey = 7"))
def _(spark, d):
    return orders(reader(spark, d, "Order").get(7))


@query("r02_exists", "SELECT 7 IN (SELECT o_orderkey FROM orders) AS there, -1 IN (SELECT o_orderkey FROM orders) AS nowhere")
def _(spark, d):
    r = reader(spark, d, "Order")
    return spark.createDataFrame([(r.exists(7), r.exists(-1))], "there boolean, nowhere boolean")


@query("r03_first", orders_sql(tail="ORDER BY o.o_orderkey LIMIT 1"))
def _(spark, d):
    return orders(reader(spark, d, "Order").first())


@query("r04_last", orders_sql(tail="ORDER BY o.o_orderkey DESC LIMIT 1"))
def _(spark, d):
    return orders(reader(spark, d, "Order").last())


@query("r05_take", orders_sql(tail="ORDER BY o.o_orderkey LIMIT 20"))
def _(spark, d):
    return orders(reader(spark, d, "Order").take(20))


@query("r06_tail", orders_sql(tail="ORDER BY o.o_orderkey DESC LIMIT 20"))
def _(spark, d):
    return orders(reader(spark, d, "Order").tail(20))


@query("r06_tail_strict", "SELECT conv_id, turn, role FROM conversations WHERE conv_id > (SELECT max(conv_id) FROM conversations) - 3 ORDER BY conv_id DESC, turn DESC LIMIT 3")
def _(spark, d):
    return reader(spark, d, "Turn").tail(3, strict_bound=True).select("conv_id", "turn", "role")


@query("r07_range", orders_sql("o.o_orderkey >= 100 AND o.o_orderkey < 200"))
def _(spark, d):
    return orders(reader(spark, d, "Order").range(100, 200))


@query("r07_range_pointer", "SELECT conv_id, turn, role FROM conversations WHERE (conv_id > 3 OR (conv_id = 3 AND turn >= 1)) AND (conv_id < 20 OR (conv_id = 20 AND turn < 2))")
def _(spark, d):
    return reader(spark, d, "Turn").range((3, 1), (20, 2)).select("conv_id", "turn", "role")


@query("r08_stream_range", "SELECT conv_id, turn, role FROM conversations WHERE (conv_id > 3 OR (conv_id = 3 AND turn >= 1)) AND (conv_id < 20 OR (conv_id = 20 AND turn < 2)) AND role = 'user'")
def _(spark, d):
    found = reader(spark, d, "Turn").range((3, 1), (20, 2), {"role": {"Eq": "user"}})
    return found.select(F.from_json(F.to_json(F.struct("conv_id", "turn", "role")), "conv_id bigint, turn bigint, role string").alias("x")).select("x.*")


@query("r09_key_range", "SELECT conv_id, turn FROM conversations WHERE (conv_id > 3 OR (conv_id = 3 AND turn >= 1)) AND (conv_id < 20 OR (conv_id = 20 AND turn < 2))")
def _(spark, d):
    return reader(spark, d, "Turn").key_range((3, 1), (20, 2))


@query("r10_parent_key", "SELECT DISTINCT n_regionkey AS r_regionkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    return reader(spark, d, "Customer").rows.select("r_regionkey", "n_nationkey").distinct()


@query("r11_filter", orders_sql("o.o_orderkey = 7 AND o_totalprice > 10", join="JOIN"))
def _(spark, d):
    return orders(reader(spark, d, "Order").filter(7, {"o_totalprice": {"Gt": 10.0}}))


@query("r12_iter_keys", "SELECT n_regionkey AS r_regionkey, n_nationkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    return reader(spark, d, "Customer").iter_keys()


@query("r13_table_info", """SELECT * FROM (SELECT 'Order' AS entity, 'o_orderpriority' AS "column", 'dictionary' AS access, count(o_orderpriority) AS entries, count(DISTINCT o_orderpriority) AS distinct_values FROM orders
UNION ALL SELECT 'LineItem', 'l_returnflag', 'dictionary', count(l_returnflag), count(DISTINCT l_returnflag) FROM lineitem)""")
def _(spark, d):
    return stats.table_info(overlay.catalog(spark, d), "Order").where("access = 'dictionary'")


@query("r14_index_stats", "SELECT count(o_orderstatus) AS pk_by_index FROM orders")
def _(spark, d):
    return stats.index_stats(reader(spark, d, "Order").rows, "o_orderstatus")


@query("r15_dictionary_stats", "SELECT count(DISTINCT c_mktsegment) AS distinct_values FROM customer")
def _(spark, d):
    return stats.dictionary_stats(reader(spark, d, "Customer").rows, "c_mktsegment")


@query("r16_plain_stats", "SELECT count(*) AS underlying FROM lineitem")
def _(spark, d):
    return stats.plain_stats(reader(spark, d, "LineItem").rows)


# ---- trees


@query("r20_compose", orders_sql())
def _(spark, d):
    return orders(compose(overlay.catalog(spark, d), "Order"))


@query("r21_compose_one", "SELECT event_id, user_id, event_id + 1 AS height FROM events")
def _(spark, d):
    return compose(overlay.catalog(spark, d), "Event").select("event_id", "user_id", "header.height")


@query("r21_missing_one", "SELECT event_id FROM events WHERE FALSE")
def _(spark, d):
    return missing(overlay.catalog(spark, d), "Event", "header")


@query("r22_compose_optional", "SELECT d.doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(spark, d):
    return compose(overlay.catalog(spark, d), "Document").select("doc_id", "lang", F.coalesce("label.quality", F.lit(-1)).alias("quality"), F.coalesce("label.toxic", F.lit(-1)).alias("toxic"))


@query("r23_compose_many", f"WITH {CUST} SELECT r.r_regionkey, r_name, n.n_nationkey, n_name, c_custkey, c_mktsegment FROM region r JOIN nation n ON n_regionkey = r.r_regionkey JOIN cu ON cu.n_nationkey = n.n_nationkey")
def _(spark, d):
    tree = compose(overlay.catalog(spark, d), "Region")
    nations = tree.select("r_regionkey", "r_name", F.explode("nations").alias("n"))
    return nations.select("r_regionkey", "r_name", "n.n_nationkey", "n.n_name", F.explode("n.customers").alias("c")).select("r_regionkey", "r_name", "n_nationkey", "n_name", "c.c_custkey", "c.c_mktsegment")


@query("r24_read_from", f"WITH {LI} SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY line_idx) - 1 AS INTEGER) AS place, p_partkey, p_brand, p_size FROM li JOIN part ON p_partkey = l_partkey")
def _(spark, d):
    tree = compose(overlay.catalog(spark, d), "Order")
    return tree.select("o_orderkey", F.posexplode("parts").alias("place", "p")).select("o_orderkey", "place", "p.p_partkey", "p.p_brand", "p.p_size")


@query("r24_read_from_missing", f"WITH {LI} SELECT o_orderkey, count(*) AS n FROM li JOIN part ON p_partkey = l_partkey WHERE p_size >= 25 GROUP BY 1")
def _(spark, d):
    c = overlay.catalog(spark, d)
    c.frames["Part"] = c.frames["Part"].where("p_size >= 25")
    return compose(c, "Order").where(F.size("parts") > 0).select("o_orderkey", F.size("parts").cast("long").alias("n"))


@query("r25_transient", "SELECT o_orderkey, CAST(0 AS BIGINT) AS o_weight FROM orders")
def _(spark, d):
    return compose(overlay.catalog(spark, d), "Order").select("o_orderkey", "o_weight")


@query("r26_child_one", "SELECT event_id, event_id + 1 AS height FROM events WHERE event_id = 5")
def _(spark, d):
    return reader(spark, d, "Event").child(5, "header").select("event_id", "height")


@query("r27_child_optional", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id = 1")
def _(spark, d):
    return reader(spark, d, "Document").child(1, "label").select("doc_id", "quality", "toxic")


@query("r28_children", f"WITH {LI} SELECT o_orderkey, line_idx, {LINE} FROM li WHERE o_orderkey = 7")
def _(spark, d):
    return reader(spark, d, "Order").child(7, "line_items")


@query("r29_compose_many_keys", orders_sql("o.o_custkey % 10 = 3"))
def _(spark, d):
    r = reader(spark, d, "Order")
    return orders(r.many(r.rows.where("o_custkey % 10 = 3").select("o_orderkey")))


@query("r30_stream_many", orders_sql("o.o_custkey % 10 = 3 AND o_orderstatus = 'O'", join="JOIN"))
def _(spark, d):
    r = reader(spark, d, "Order")
    return orders(r.many(r.rows.where("o_custkey % 10 = 3").select("o_orderkey"), {"o_orderstatus": {"$eq": "O"}}))


# ---- secondary columns


@query("i01_get_by_index", orders_sql("o_orderstatus = 'F'"))
def _(spark, d):
    return orders(reader(spark, d, "Order").get_by("o_orderstatus", "F"))


@query("i02_get_by_dictionary", f"WITH {CUST} SELECT r_regionkey, n_nationkey, c_custkey, c_name FROM cu WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    return reader(spark, d, "Customer").get_by("c_mktsegment", "BUILDING").select("r_regionkey", "n_nationkey", "c_custkey", "c_name")


@query("i03_stream_by_index", orders_sql("o_orderstatus = 'F' AND o_totalprice < 1000", join="JOIN"))
def _(spark, d):
    return orders(reader(spark, d, "Order").get_by("o_orderstatus", "F", {"o_totalprice": {"Lt": 1000.0}}))


@query("i04_stream_by_dictionary", f"WITH {CUST} SELECT r_regionkey, n_nationkey, c_custkey, c_name FROM cu WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0")
def _(spark, d):
    return reader(spark, d, "Customer").get_by("c_mktsegment", "BUILDING", {"c_acctbal": {"Ge": 0.0}}).select("r_regionkey", "n_nationkey", "c_custkey", "c_name")


@query("i05_keys_by_index", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return reader(spark, d, "Order").keys_by("o_orderstatus", "F")


@query("i06_keys_by_dictionary", f"WITH {CUST} SELECT r_regionkey, n_nationkey, c_custkey FROM cu WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    return reader(spark, d, "Customer").keys_by("c_mktsegment", "BUILDING")


@query("i07_stream_keys_by_index", "SELECT event_id FROM events WHERE user_id = 3")
def _(spark, d):
    return reader(spark, d, "Event").keys_by("user_id", 3)


@query("i08_stream_keys_by_dictionary", "SELECT o_orderkey FROM orders WHERE o_orderpriority = 'nowhere'")
def _(spark, d):
    return reader(spark, d, "Order").keys_by("o_orderpriority", "nowhere")


@query("i09_range_by", orders_sql("o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01'"))
def _(spark, d):
    r = reader(spark, d, "Order")
    return orders(r.range_by("o_orderdate", *dates("1996-01-01", "1996-03-01")))


@query("i10_stream_range_by", orders_sql("o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01' AND o_orderstatus <> 'F'", join="JOIN"))
def _(spark, d):
    return orders(reader(spark, d, "Order").range_by("o_orderdate", *dates("1996-01-01", "1996-03-01"), {"o_orderstatus": {"Ne": "F"}}))


@query("i11_parents_by_index", orders_sql("o.o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')"))
def _(spark, d):
    return orders(reader(spark, d, "LineItem").parents_by("l_linestatus", "F"))


@query("i12_parents_by_dictionary", orders_sql("o.o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderstatus = 'O'", join="JOIN"))
def _(spark, d):
    return orders(reader(spark, d, "LineItem").parents_by("l_returnflag", "R", {"o_orderstatus": {"Eq": "O"}}))


@query("i13_index_keys", "SELECT n_regionkey AS r_regionkey, n_nationkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_name = (SELECT min(c_name) FROM customer)")
def _(spark, d):
    r = reader(spark, d, "Customer")
    return r.keys_by("c_name", r.rows.agg(F.min("c_name")).first()[0])


@query("i14_index_range", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20")
def _(spark, d):
    return reader(spark, d, "Part").range_by("p_size", 10, 20).select("p_partkey", "p_size")


@query("i15_dictionary_keys", "SELECT p_partkey FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def _(spark, d):
    r = reader(spark, d, "Part")
    return r.keys_by("p_brand", r.rows.agg(F.min("p_brand")).first()[0])


@query("i16_value_of", "SELECT o_orderstatus FROM orders WHERE o_orderkey = 7")
def _(spark, d):
    return reader(spark, d, "Order").value_of(7, "o_orderstatus")


@query("i17_any_by", "SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(spark, d):
    return reader(spark, d, "Order").any_by("o_orderpriority")


@query("i17_any_before", "SELECT o_orderpriority, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey < 700 GROUP BY 1")
def _(spark, d):
    return reader(spark, d, "Order").any_by("o_orderpriority", (700,))


def dates(*texts: str):
    import datetime

    return [datetime.datetime.fromisoformat(t) for t in texts]


# ---- filters


def filtered(name: str, q: dict, sql: str):
    QUERIES[name] = lambda spark, d: orders(reader(spark, d, "Order")._tree(reader(spark, d, "Order").rows, q))
    SQL[name] = sql


filtered("f01_eq", {"o_orderstatus": {"Eq": "O"}}, orders_sql("o_orderstatus = 'O'", join="JOIN"))
filtered("f02_ne", {"o_orderstatus": {"Ne": "O"}}, orders_sql("o_orderstatus <> 'O'", join="JOIN"))
filtered("f03_lt", {"o_custkey": {"Lt": 50}}, orders_sql("o_custkey < 50", join="JOIN"))
filtered("f04_le", {"o_custkey": {"Le": 50}}, orders_sql("o_custkey <= 50", join="JOIN"))
filtered("f05_gt", {"o_custkey": {"Gt": 50}}, orders_sql("o_custkey > 50", join="JOIN"))
filtered("f06_ge", {"o_custkey": {"Ge": 50}}, orders_sql("o_custkey >= 50", join="JOIN"))
filtered("f07_in", {"o_custkey": {"In": [3, 5, 8]}}, orders_sql("o_custkey IN (3, 5, 8)", join="JOIN"))
filtered("f07_in_empty", {"o_custkey": {"In": []}}, orders_sql("FALSE"))
filtered("f08_and", {"o_custkey": {"Ge": 50}, "o_orderstatus": {"Eq": "P"}}, orders_sql("o_custkey >= 50 AND o_orderstatus = 'P'", join="JOIN"))
filtered("f11_many", {"line_items": {"l_returnflag": {"Eq": "R"}}}, orders_sql(items="l_returnflag = 'R'", join="JOIN"))
filtered("f11_empty_filter", {}, orders_sql(join="JOIN"))


@query("f09_one", "SELECT event_id, event_id + 1 AS height FROM events WHERE event_id + 1 <= 50")
def _(spark, d):
    r = reader(spark, d, "Event")
    return r._tree(r.rows, {"header": {"height": {"Le": 50}}}).select("event_id", "header.height")


@query("f10_optional", "SELECT d.doc_id, toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic = 1")
def _(spark, d):
    r = reader(spark, d, "Document")
    return r._tree(r.rows, {"label": {"toxic": {"Eq": 1}}}).select("doc_id", "label.toxic")


@query("f10_optional_unfiltered", "SELECT d.doc_id, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE n_chars > 1000")
def _(spark, d):
    r = reader(spark, d, "Document")
    return r._tree(r.rows, {"n_chars": {"Gt": 1000}}).select("doc_id", F.coalesce("label.toxic", F.lit(-1)).alias("toxic"))


@query("f11_deep", f"WITH {CUST} SELECT r.r_regionkey, cu.n_nationkey, c_custkey FROM region r JOIN cu ON cu.r_regionkey = r.r_regionkey WHERE c_mktsegment = 'MACHINERY'")
def _(spark, d):
    r = reader(spark, d, "Region")
    tree = r._tree(r.rows, {"nations": {"customers": {"c_mktsegment": {"Eq": "MACHINERY"}}}})
    return tree.select("r_regionkey", F.explode("nations").alias("n")).select("r_regionkey", "n.n_nationkey", F.explode("n.customers.c_custkey").alias("c_custkey"))


def flagship(spark, d) -> DataFrame:
    """Orders of a key range with their returned items only."""
    return flat_lines(reader(spark, d, "Order").range(100, 200, {"line_items": {"l_returnflag": {"Eq": "R"}}}))


QUERIES["f12_flagship"] = flagship
SQL["f12_flagship"] = lines_sql("o.o_orderkey >= 100 AND o.o_orderkey < 200 AND l_returnflag = 'R'")


# ---- writes


@query("w01_explode", f"WITH {LI} SELECT o_orderkey, line_idx, {LINE} FROM li")
def _(spark, d):
    c = overlay.catalog(spark, d)
    return W.explode_trees(c.registry, "Order", compose(c, "Order"))["LineItem"]


@query("w03_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, d):
    rows = reader(spark, d, "Order").rows
    return W.upsert(rows, rows.where("o_orderkey % 10 = 1").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("w05_delete_cascade", f"WITH {LI} SELECT o_orderkey, line_idx FROM li WHERE o_orderkey % 3 <> 0")
def _(spark, d):
    c = overlay.catalog(spark, d)
    wanted = c.frame("Order").where("o_orderkey % 3 = 0").select("o_orderkey")
    return W.delete_many(c.registry, "Order", {e: c.frame(e) for e in ("Order", "LineItem")}, wanted)["LineItem"].select("o_orderkey", "line_idx")


@query("w06_delete_result", "SELECT TRUE AS all_there, FALSE AS one_absent")
def _(spark, d):
    rows = reader(spark, d, "Order").rows
    wanted = rows.select("o_orderkey").where("o_orderkey % 3 = 0")
    return spark.createDataFrame([(W.deletes_all(rows, wanted, ["o_orderkey"]), W.deletes_all(rows, wanted.union(spark.sql("SELECT -5L")), ["o_orderkey"]))], "all_there boolean, one_absent boolean")


@query("w12_births", f"WITH {LI} SELECT l_returnflag, o_orderkey, line_idx FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY o_orderkey, line_idx) AS k FROM li) WHERE k = 1")
def _(spark, d):
    return W.births(reader(spark, d, "LineItem").rows, "l_returnflag", ["o_orderkey", "line_idx"]).select("l_returnflag", "birth.*")


@query("w12_encoded", "SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_mktsegment) AS birth FROM customer")
def _(spark, d):
    rows = reader(spark, d, "Customer").rows.select("c_custkey", "c_mktsegment")
    return W.encoded(rows, "c_mktsegment", W.births(rows, "c_mktsegment", ["c_custkey"])).select("c_custkey", F.col("c_mktsegment_birth.c_custkey").alias("birth"))


@query("w15_dictionary_collected", "SELECT p_brand, min(p_partkey) AS birth FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_partkey >= 190) GROUP BY 1")
def _(spark, d):
    rows = reader(spark, d, "Part").rows
    known = W.births(rows, "p_brand", ["p_partkey"])
    return W.collected(known, "p_brand", rows.where("p_partkey >= 190")).select("p_brand", F.col("birth.p_partkey").alias("birth"))


@query("w16_double_spends", "SELECT l_orderkey AS o_orderkey, l_partkey, count(*) AS uses FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return W.double_spends(reader(spark, d, "LineItem").rows, ["o_orderkey"], ["l_partkey"])


@query("w17_resolve", "SELECT o_orderkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END AS c_custkey FROM orders JOIN customer ON c_custkey = o_custkey")
def _(spark, d):
    customers = reader(spark, d, "Customer").rows.select("c_custkey", "c_name")
    refs = reader(spark, d, "Order").rows.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")
    return W.resolve(refs, customers.where("c_custkey % 2 = 0"), "c_name", ["c_custkey"], {"c_custkey": 0}).select("o_orderkey", "c_custkey")


@query("w19_sentinels", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id ELSE 0 END AS pointer, CAST(CASE WHEN event_id % 5 = 0 THEN 65535 WHEN event_id % 3 = 0 THEN event_id % 4 ELSE 0 END AS BIGINT) AS pointer_index FROM events")
def _(spark, d):
    e = reader(spark, d, "Event").rows
    refs = e.select("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("hash"), F.when(F.col("event_id") % 5 == 0, F.lit(0xFFFFFFFF)).otherwise(F.col("event_id") % 4).alias("index"))
    known = e.where("event_id % 3 = 0").select(F.col("event_id").alias("pointer"), F.sha2(F.col("event_id").cast("string"), 256).alias("hash"))
    return W.resolve_outputs(refs, known, ["pointer"]).select("event_id", "pointer", "pointer_index")


# ---- chains


@query("s07_size_batches")
def _(spark, d):
    rows = reader(spark, d, "Turn").rows.select("conv_id", "turn", F.length("text").alias("size"))
    return chain.size_batches(rows, ["conv_id"], "turn", "size", 2000)


@query("s08_weight_batches")
def _(spark, d):
    rows = reader(spark, d, "Turn").rows.select("conv_id", "turn", F.length("text").alias("size"))
    return chain.weight_batches(rows, ["conv_id"], "turn", "size", 2000, 4)


@query("s09_contiguous", """WITH a AS (SELECT DISTINCT event_id AS height FROM events WHERE event_id % 61 <> 60), n AS (SELECT height, row_number() OVER (ORDER BY height) + 9 AS k FROM a WHERE height >= 10)
SELECT height FROM n WHERE height = k""")
def _(spark, d):
    arrived = reader(spark, d, "Event").rows.where("event_id % 61 <> 60").select(F.col("event_id").alias("height"))
    return chain.contiguous(arrived.union(arrived.where("height < 30")), 10)


@query("s12_gap_report", "SELECT CAST(10 AS BIGINT) AS dropped_too_low, count(*) AS pending, CAST(60 AS BIGINT) AS gap_from, max(event_id) AS gap_to FROM events WHERE event_id % 61 <> 60 AND event_id > 60")
def _(spark, d):
    return chain.gap_report(reader(spark, d, "Event").rows.where("event_id % 61 <> 60").select(F.col("event_id").alias("height")), 10)


@query("s18_fork_replace", "SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 100 AND 120 THEN 'fork' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, d):
    rows = reader(spark, d, "Order").rows
    fork = rows.where("o_orderkey BETWEEN 100 AND 120").withColumn("o_orderstatus", F.lit("fork"))
    return chain.replaced(rows, fork, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("s19_validate_chain", "SELECT event_id + 1 AS height FROM events WHERE (event_id + 2) % 97 = 0 AND event_id + 2 >= 1 AND event_id + 2 < (SELECT max(event_id) + 1 FROM events)")
def _(spark, d):
    headers = overlay.headers(reader(spark, d, "Event").rows)
    return chain.broken_links(headers, 1, headers.agg(F.max("height")).first()[0]).select("height")


@query("s21_last_header", "SELECT max(event_id) + 1 AS height, sha256(CAST(max(event_id) AS VARCHAR)) AS hash FROM events")
def _(spark, d):
    return reader(spark, d, "EventHeader").last().select("height", "hash")


@query("s26_task_stats", """SELECT event_type, arg_max(CAST(round(value * 100) AS BIGINT), event_id) AS last, round(avg(CAST(round(value * 100) AS BIGINT)), 4) AS mean, round(stddev_pop(CAST(round(value * 100) AS BIGINT)), 4) AS dev,
CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1""")
def _(spark, d):
    tasks = reader(spark, d, "Event").rows.withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return stats.task_stats(tasks, ["event_type"], "cents", "event_id").select("event_type", "last", F.round("mean", 4).alias("mean"), F.round("dev", 4).alias("dev"), "total")


@query("s27_slowest", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def _(spark, d):
    return stats.slowest(reader(spark, d, "Event").rows.select("user_id", "event_id", F.struct("value", "event_id").alias("total")), "user_id", "total").select("user_id", "event_id")


@query("s28_block_weights", "SELECT o_orderkey AS height, CAST(6 + 1 + coalesce(n, 0) AS BIGINT) AS weight FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(spark, d):
    c = overlay.catalog(spark, d)
    blocks = c.frame("Order").select(F.col("o_orderkey").alias("height"))
    return chain.block_weights(blocks, blocks, {"outputs": c.frame("LineItem").select(F.col("o_orderkey").alias("height"))})


# ---- codecs


@query("c01_hex", "SELECT c_custkey, lower(hex(encode(c_name))) AS text, c_name AS back FROM customer")
def _(spark, d):
    text = codecs.to_hex(F.encode("c_name", "UTF-8"))
    return reader(spark, d, "Customer").rows.select("c_custkey", text.alias("text"), codecs.to_utf8(codecs.from_hex(text)).alias("back"))


@query("c02_base64", "SELECT c_custkey, to_base64(encode(c_name)) AS text, c_name AS back FROM customer")
def _(spark, d):
    text = codecs.to_base64(F.encode("c_name", "UTF-8"))
    return reader(spark, d, "Customer").rows.select("c_custkey", text.alias("text"), codecs.to_utf8(codecs.from_base64(text)).alias("back"))


@query("c03_utf8", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.octet_length(codecs.from_utf8(codecs.to_utf8(codecs.from_utf8(F.col("text"))))).cast("long").alias("n"))


@query("c04_addresses")
def _(spark, d):
    rows = reader(spark, d, "Customer").rows.select("c_custkey", F.unhex(F.sha2(F.col("c_name"), 256)).alias("h"))
    stored = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(b"\x00"), F.substring("h", 1, 20))).otherwise(F.concat(F.lit(b"\xb0\x01"), "h"))
    coded = rows.select("c_custkey", stored.alias("stored")).withColumn("address", codecs.encode_address("btc")("stored"))
    return coded.select("c_custkey", "address", (codecs.decode_address("btc")("address") == F.col("stored")).alias("round_trip"))


@query("c08_script_address", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'F0' WHEN c_custkey % 3 = 1 THEN 'FF' ELSE '00' || upper(substr(sha256(c_name), 1, 40)) END AS address FROM customer")
def _(spark, d):
    rows = reader(spark, d, "Customer").rows.select("c_custkey", F.unhex(F.sha2(F.col("c_name"), 256)).alias("h"))
    script = F.when(F.col("c_custkey") % 3 == 2, F.concat(F.lit(b"\x6a"), "h")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(b"\x51"), "h")).otherwise(F.concat(F.lit(bytes.fromhex("76a914")), F.substring("h", 1, 20), F.lit(bytes.fromhex("88ac"))))
    return rows.select("c_custkey", F.hex(codecs.script_address(script)).alias("address"))


@query("c09_asset_action", "SELECT o_orderkey, CAST(CASE WHEN o_custkey % 3 = 0 THEN 0 WHEN o_custkey % 3 = 1 THEN 2 ELSE 1 END AS INTEGER) AS action FROM orders")
def _(spark, d):
    minted = F.when(F.col("o_custkey") % 3 == 0, 1).when(F.col("o_custkey") % 3 == 1, -1).otherwise(0)
    return reader(spark, d, "Order").rows.select("o_orderkey", codecs.asset_action_signed(minted).alias("action"))


@query("c10_key_text", "SELECT concat_ws('-', conv_id, turn) AS key, conv_id AS k0, turn AS k1 FROM conversations")
def _(spark, d):
    rows = reader(spark, d, "Turn").rows.select(K.text_column(["conv_id", "turn"]).alias("key"))
    return rows.select("key", K.parse_column(F.col("key"), 2).alias("k")).select("key", F.col("k")[0].alias("k0"), F.col("k")[1].alias("k1"))


@query("c12_timestamp_text", "SELECT event_id, strftime(make_timestamp((event_id * 86461) * 1000000), '%Y-%m-%d %H:%M:%S') AS text FROM events")
def _(spark, d):
    return reader(spark, d, "Event").rows.select("event_id", codecs.timestamp_text(F.col("event_id") * 86461).alias("text"))


@query("c13_short_hash", "SELECT event_id, substr(sha256(CAST(event_id AS VARCHAR)), 1, 12) AS text FROM events")
def _(spark, d):
    return reader(spark, d, "Event").rows.select("event_id", codecs.short_hash(F.unhex(F.sha2(F.col("event_id").cast("string"), 256))).alias("text"))


@query("c21_assert_sorted", "SELECT o_orderkey FROM orders WHERE FALSE")
def _(spark, d):
    rows = W.sorted_for_write(reader(spark, d, "Order").rows, ["o_orderkey"]).withColumn("_o", F.monotonically_increasing_id())
    return W.unsorted(rows, ["o_orderkey"], "_o").select("o_orderkey")


from . import system_queries  # noqa: E402, F401 (adds its queries to QUERIES and SQL)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
