"""Every query against DuckDB on the provided tables."""

import glob
import os

import duckdb
import pytest

from arborel.plans import catalog_queries as Q


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    return v.isoformat(sep=" ") if hasattr(v, "isoformat") else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = Q.QUERIES[name](spark, sf_dir)
    rows = sorted(str([plain(r[c]) for c in sorted(got.columns)]) for r in got.collect())
    if name not in Q.SQL:
        assert rows
        return
    cur = duck.execute(Q.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    at = [names.index(c) for c in sorted(names)]
    assert rows == sorted(str([plain(r[i]) for i in at]) for r in cur.fetchall())


def test_acceptance_numbers(spark, sf_dir):
    from arborel.plans import overlay
    from arborel.operators.read import Reader

    r = Reader(overlay.catalog(spark, sf_dir), "Order")
    assert r.range(100, 200).count() == 100
    assert r.range(100, 200, {}).count() == 97
    assert Q.flagship(spark, sf_dir).count() == 132


def test_take_has_a_limit(spark, sf_dir):
    from arborel.operators.read import TooMany
    from arborel.plans import overlay
    from arborel.operators.read import Reader

    with pytest.raises(TooMany):
        Reader(overlay.catalog(spark, sf_dir), "Order").take(101)


def test_api(spark, sf_dir):
    import json

    from arborel.api import Api
    from arborel.plans import overlay

    api = Api(overlay.catalog(spark, sf_dir))
    status, out = api.handle("GET", "/order/o_orderkey/7")
    assert status == 200 and json.loads(next(out))["o_orderkey"] == 7
    assert api.handle("GET", "/order/o_orderkey/999999")[0] == 404
    assert api.handle("HEAD", "/order/o_orderkey/7")[0] == 200
    assert api.handle("GET", "/order/take?take=101")[0] == 400
    assert api.handle("GET", "/nothing")[0] == 404
    assert api.handle("POST", "/order/o_orderstatus/F", "{bad")[0] == 400
    status, out = api.handle("POST", "/turn/turn?from=3-1&until=5-0", '{"role": {"$eq": "user"}}')
    assert status == 200 and all(json.loads(x)["role"] == "user" for x in out)
    status, out = api.handle("GET", "/turn/turn/3-1/parent_key")
    assert status == 200 and json.loads(next(out)) == "3"
    status, out = api.handle("POST", "/line_item/l_returnflag/R/order", '{"o_orderstatus": {"Eq": "O"}}')
    assert status == 200 and json.loads(next(out))["o_orderstatus"] == "O"
    assert len(list(api.handle("GET", "/order/7/line_items")[1])) >= 0
    assert api.handle("POST", "/order", "{}")[0] == 400


def test_lines_stay_on_executors_where_rows_go_on(spark, sf_dir, monkeypatch):
    from arborel.operators.read import Lines, Reader
    from arborel.plans import overlay, system_queries as S

    r = Reader(overlay.catalog(spark, sf_dir), "Order")
    stream = r.stream_by("o_orderstatus", "P", {"o_custkey": {"Lt": 100}})
    assert sorted(stream) == sorted(x[0] for x in stream.frame.collect()) and next(stream, None) is None
    assert sorted(x.o_orderkey for x in S.of_lines(spark, iter(r.stream_keys_by("o_orderstatus", "P")), "o_orderkey bigint").collect()) == sorted(x.o_orderkey for x in Q.QUERIES["route_keys_by"](spark, sf_dir).collect())

    def driver(self):
        raise AssertionError("a line on the driver")

    monkeypatch.setattr(Lines, "__next__", driver)
    for name in ("i03_stream_lines", "i12_stream_lines", "r30_stream_lines", "route_parents_by"):
        assert Q.QUERIES[name](spark, sf_dir).count()
