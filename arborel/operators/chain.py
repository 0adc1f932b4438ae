"""Chains of blocks: links, forks, weights, batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def broken_links(headers: DataFrame, start: int, tip: int, include_tip: bool = False, height: str = "height", hash_: str = "hash", prev: str = "prev_hash") -> DataFrame:
    """Headers in [start, tip) whose successor there doesn't name them. The link of the tip is left out unless include_tip.
    Each header meets its successor by an equi-join on the height, so no window runs over all rows in one task."""
    end = F.col(height) <= tip if include_tip else F.col(height) < tip
    some = headers.where((F.col(height) >= start) & end)
    after = some.select((F.col(height) - 1).alias(height), F.col(prev).alias("_named"))
    return some.join(after, height).where(F.col(hash_) != F.col("_named")).drop("_named")


def linked_fork(known: DataFrame, fork: DataFrame, window: int, height: str = "height", hash_: str = "hash", prev: str = "prev_hash") -> DataFrame:
    """The part of a new batch of blocks that reaches a known predecessor: walks from the lowest block back by prev_hash until the block one below is
    known (height 1 is the base); an empty result if a parent is missing. The walk takes at most `window` steps, and a step looks up one header."""
    lowest = fork.orderBy(height).select(height, prev).first()
    if lowest is None:
        return fork
    at, want = lowest[0], lowest[1]
    for _ in range(window + 1):
        if at <= 1 or known.where((F.col(height) == at - 1) & (F.col(hash_) == want)).take(1):
            return fork.where(F.col(height) >= at)
        step = fork.where(F.col(hash_) == want).select(height, prev).first()
        if step is None:
            return fork.where(F.lit(False))
        at, want = step[0], step[1]
    return fork.where(F.lit(False))


def replaced(table: DataFrame, fork: DataFrame, height: str = "height") -> DataFrame:
    """The table with the fork's heights exchanged, in one step."""
    return table.join(fork.select(height).distinct(), height, "left_anti").unionByName(fork)


def mode(tip: int, last: int, window: int) -> str:
    """batch while more heights are wanted than a fork may reach back; never below 0."""
    return "batch" if max(0, tip - last) > window else "continuous"


def heights(tip: int, last: int | None) -> tuple[int, int]:
    """Half-open range of heights to fetch; the genesis isn't stored."""
    return (1 if last is None else last + 1), max(1 if last is None else last + 1, tip + 1)


def block_weights(blocks: DataFrame, transactions: DataFrame, parts: dict[str, DataFrame], per_block: int = 6, per_transaction: int = 1, height: str = "height") -> DataFrame:
    """(height, weight): a fixed weight, one for each transaction, and one for each row of the parts (outputs, inputs, assets)."""
    counted = transactions.groupBy(height).agg((F.count(F.lit(1)) * per_transaction).alias("w"))
    for df in parts.values():
        counted = counted.union(df.groupBy(height).agg(F.count(F.lit(1)).alias("w")))
    total = counted.groupBy(height).agg(F.sum("w").alias("w"))
    return blocks.select(height).join(total, height, "left").select(height, (F.coalesce("w", F.lit(0)) + per_block).alias("weight"))


#: Weights of the block kinds: per block, per transaction.
WEIGHTS = {"btc": (6, 1), "bch": (6, 1), "ltc": (6, 1), "cardano": (25, 1), "ergo": (6, 1)}


def _greedy(rows: DataFrame, group: list[str], order: str, weight: str, fold) -> DataFrame:
    """Numbers the rows of each group in order. A batch's number depends on all before it, so a group's orders and weights (no other
    column) meet in one task, which folds them in linear time."""
    slim = rows.select(*group, F.col(order).cast("bigint").alias(order), F.col(weight).cast("bigint").alias("_w"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        batches = pa.array(list(fold(table["_w"].to_pylist())), pa.int64())
        return table.drop_columns(["_w"]).append_column("batch", batches)

    schema = slim.drop("_w").withColumn("batch", F.lit(0).cast("bigint")).schema
    return slim.groupBy(*group).applyInArrow(run, schema)


def fold_sizes(sizes, limit: int):
    """A batch ends before the item that would take it above the limit; an item above the limit stands alone."""
    batch = total = n = 0
    for s in sizes:
        if n and total + s > limit:
            batch, total, n = batch + 1, 0, 0
        total, n = total + s, n + 1
        yield batch


def fold_weights(weights, least: int, most_items: int = 1 << 62):
    """A batch ends with the item that brings its weight to `least` or its number of items to most_items."""
    batch = total = n = 0
    for w in weights:
        total, n = total + w, n + 1
        yield batch
        if total >= least or n >= most_items:
            batch, total, n = batch + 1, 0, 0


def size_batches(rows: DataFrame, group: list[str], order: str, size: str, limit: int) -> DataFrame:
    """(group, order, batch) by fold_sizes; a limit of 0 gives every item a batch of its own."""
    return _greedy(rows, group, order, size, lambda xs: fold_sizes(xs, limit))


def weight_batches(rows: DataFrame, group: list[str], order: str, weight: str, least: int, most_items: int = 1 << 62) -> DataFrame:
    """(group, order, batch) by fold_weights."""
    return _greedy(rows, group, order, weight, lambda xs: fold_weights(xs, least, most_items))


def contiguous(arrived: DataFrame, next_: int, height: str = "height") -> DataFrame:
    """The heights that a reorder buffer has let go once all of `arrived` is in: from next_ on without a gap. Late ones (below next_) and repeats
    are dropped. The first gap is found by an anti-join of heights with their successors, not by a global sort."""
    some = arrived.where(F.col(height) >= next_).select(height).distinct()
    starts = some.select((F.col(height) + 1).alias(height)).union(arrived.sparkSession.range(1).select(F.lit(next_).cast("bigint").alias(height)))
    gap = starts.join(some, height, "left_anti").agg(F.min(height).alias("_gap"))
    return some.join(F.broadcast(gap), F.col(height) < F.col("_gap")).select(height)  # one row


def gap_report(arrived: DataFrame, next_: int, height: str = "height") -> DataFrame:
    """(dropped_too_low, pending, gap_from, gap_to): what waits behind the first gap, and the span it lies in."""
    ready = contiguous(arrived, next_, height)
    waiting = arrived.select(height).distinct().where(F.col(height) >= next_).join(ready, height, "left_anti")
    low = arrived.agg(F.sum((F.col(height) < next_).cast("long")).alias("dropped_too_low"))
    span = waiting.agg(F.count(F.lit(1)).alias("pending"), F.max(height).alias("gap_to"))
    start = ready.agg(F.coalesce(F.max(height) + 1, F.lit(next_)).alias("gap_from"))
    return low.crossJoin(span).crossJoin(start).select("dropped_too_low", "pending", F.when(F.col("pending") > 0, F.col("gap_from")).alias("gap_from"), "gap_to")  # one row each
