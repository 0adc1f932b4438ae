"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern (the sorted set of their sources); the driver sees one
row a pattern, never a document. Token capacity of each pattern flows to the quotas of its sources at convex cost: the first pass over a
pattern's tokens is free, each further pass dearer, so nothing is repeated while fresh tokens can serve. Last, each pattern and source
selects documents in an order seeded by a hash of the id, without a global sort: the order is cut into BINS ranges of equal width whose sizes are summed,
and only the range that holds a cut is ordered by rows.

Null and empty texts have size 0 and are never taken. A null source is a source of its own, the last. Rows that repeat are
documents of their own, ordered among themselves by size. Very long texts count whole. An empty table gives no rows.
Other columns aren't read; those kept pass through, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD, stored, table

#: Ranges of the seeded order whose sizes are summed before rows are ordered.
BINS = 4096
#: Most membership patterns and sources that the driver accepts; more is an error, not a cut.
MOST_PATTERNS = 100_000
WEIGHTS, SHARE, COPIES, SEED = (3, 1, 2), 1.5, 2, 17


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quotas(sizes: dict, weights: dict, total: float, copies: float) -> dict:
    """Shares of total by weight; where a share is above copies times the source's size it stops there, and the excess is shared
    anew among the others, until none is above."""
    full: dict = {}
    while True:
        rest, weight = total - sum(full.values()), sum(w for s, w in weights.items() if s not in full)
        share = {s: rest * w / weight for s, w in weights.items() if s not in full} if weight else {}
        above = {s: float(copies * sizes[s]) for s, x in share.items() if x > copies * sizes[s]}
        if not above:
            return {**share, **full}
        full |= above


def min_cost_flow(capacity: dict[tuple, int], quota: dict, copies: int) -> dict[tuple[tuple, object], int]:
    """Tokens that each pattern gives each of its sources: total flow is the largest there is, and of such flows the cheapest, pass k over a
    pattern costing k * k for a token (successive shortest paths with potentials; arcs are whole tokens)."""
    graph: dict = defaultdict(list)  # node -> [to, capacity, cost, index of the reverse arc]

    def arc(a, b, cap, cost):
        graph[a].append([b, cap, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for pattern, size in sorted(capacity.items(), key=repr):
        for k in range(copies):
            arc("from", ("p", pattern), size, k * k)
        for source in pattern:
            arc(("p", pattern), ("s", source), copies * size, 0)
    for source, need in sorted(quota.items(), key=repr):
        arc(("s", source), "to", round(need), 0)
    potential: dict = defaultdict(int)
    while True:
        cost, back, queue = {"from": 0}, {}, [(0, 0, "from")]
        ticket = 0
        while queue:
            c, _, a = heapq.heappop(queue)
            if c > cost[a]:
                continue
            for i, (b, cap, w, _) in enumerate(graph[a]):
                d = c + w + potential[a] - potential[b]
                if cap > 0 and d < cost.get(b, float("inf")):
                    cost[b], back[b] = d, (a, i)
                    ticket += 1
                    heapq.heappush(queue, (d, ticket, b))
        if "to" not in cost:
            break
        for node, c in cost.items():
            potential[node] += c
        path, b = [], "to"
        while b != "from":
            path.append(back[b])
            b = back[b][0]
        push = min(graph[a][i][1] for a, i in path)
        for a, i in path:
            graph[a][i][1] -= push
            to, _, _, j = graph[a][i]
            graph[to][j][1] += push
    return {(p, s): x for p in capacity for b, left, _, _ in graph[("p", p)] if b[0] == "s" for s in [b[1]] if (x := copies * capacity[p] - left) > 0}


def mixed(docs: DataFrame, members: Column, weights=None, size: Column | None = None, share: float = SHARE, copies: int = COPIES, seed: int = SEED, id_column: str = "doc_id", keep: list[str] | None = None):
    """The mix of docs. members: array of a document's sources (null allowed within); weights: source -> weight (None: 3, 1, 2, repeating, by
    the sources' order, null last). keep: columns of docs to carry along (they are read again, and never shuffled but for the documents of the range with
    the cut). Returns (documents with `size`, `pattern` and `taken` words, {source: (size, target)}); with keep, those taken, the kept columns and `taken`."""
    spark = docs.sparkSession
    size = words_in(F.col("text")) if size is None else size
    # null sorts last; a source may be any string, so null is told apart by a flag
    marked = F.array_sort(F.array_distinct(F.transform(members, lambda s: F.struct(s.isNull().alias("none"), F.coalesce(s, F.lit("")).alias("name")))))
    rows = docs.select(F.col(id_column).alias("_id"), marked.alias("pattern"), size.alias("_words"), F.xxhash64(F.col(id_column), F.lit(seed)).alias("h"), F.struct(*(keep or [])).alias("_kept") if keep else F.lit(True).alias("_kept"))
    sized = stored(rows.drop("_kept"))
    bin_ = F.shiftrightunsigned("h", 64 - 12).cast("int")
    binned = sized.groupBy("pattern", bin_.alias("bin")).agg(F.sum("_words").alias("words"))
    binned = stored(binned)
    totals = binned.groupBy("pattern").agg(F.sum("words").alias("words")).limit(MOST_PATTERNS + 1).collect()
    if len(totals) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    capacity = {tuple((m["none"], m["name"]) for m in r["pattern"]): r["words"] for r in totals}
    names = sorted({s for p in capacity for s in p})
    sizes = {s: sum(c for p, c in capacity.items() if s in p) for s in names}
    if weights is None:
        chosen = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    else:
        chosen = {s: weights[None if s[0] else s[1]] for s in names}
    target = quotas(sizes, chosen, share * sum(capacity.values()), copies) if names else {}
    flow = min_cost_flow(capacity, target, copies)
    # a pattern's documents are taken `whole` times each, and a seeded part of `rest` words once more
    given = defaultdict(int)
    for (p, _), x in flow.items():
        given[p] += x
    plan = [([{"none": n, "name": s} for n, s in p], given[p] // c if c else 0, given[p] % c if c else 0) for p, c in capacity.items()]
    plan = spark.createDataFrame(plan, "pattern array<struct<none boolean, name string>>, whole bigint, rest bigint")
    # the bin in which each pattern's rest runs out
    before = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = binned.withColumn("before", before).join(F.broadcast(plan), "pattern")  # plan: at most MOST_PATTERNS rows
    cuts = cuts.where("before < rest and before + words >= rest").select("pattern", F.col("bin").alias("cut"), "before")
    plan = plan.join(F.broadcast(cuts), "pattern", "left")  # one row a pattern at most
    rows = (rows if keep else sized).withColumn("bin", bin_).join(F.broadcast(plan), "pattern")
    inside = rows.where(F.col("bin") == F.col("cut"))
    order = Window.partitionBy("pattern", "bin").orderBy("h", "_id", "_words").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the document in which the rest runs out is taken up to there
    inside = inside.withColumn("again", F.greatest(F.lit(0), F.least("_words", F.col("rest") - (F.col("before") + F.sum("_words").over(order) - F.col("_words")))))
    outside = rows.where(F.col("cut").isNull() | (F.col("bin") != F.col("cut"))).withColumn("again", F.when(F.col("bin") < F.coalesce("cut", F.lit(-1)), F.col("_words")).otherwise(F.lit(0)))
    taken = F.col("whole") * F.col("_words") + F.col("again")
    out = inside.unionByName(outside)
    if keep:
        out = out.where(taken > 0).select(*[F.col("_kept")[c].alias(c) for c in keep], taken.alias("taken"))
    else:
        out = out.select(F.col("_id").alias("doc_id"), "pattern", F.col("_words").alias("size"), taken.alias("taken"))
    return out, {s: (sizes[s], target[s]) for s in names}


def chosen(docs: DataFrame) -> DataFrame:
    """The documents that the mix of their sources takes, with all their columns and `taken`, the words to take of each (those of a second
    pass included); a column of that name gives way."""
    return mixed(docs, F.array("source"), keep=[c for c in docs.columns if c != "taken"])[0]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out, facts = mixed(docs, F.array("source"))
    schema = "none boolean, name string, source_size bigint, target double"
    facts = spark.createDataFrame([(n, s, a, float(b)) for (n, s), (a, b) in facts.items()], schema)
    one = out.withColumn("none", F.col("pattern")[0]["none"]).withColumn("name", F.col("pattern")[0]["name"])
    return one.join(F.broadcast(facts), ["none", "name"]).select("doc_id", "size", "source_size", "target", "taken")
