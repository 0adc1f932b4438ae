"""Continuous ordered ingest: a reorder buffer as keyed state, micro-batches into the store, forks, modes, progress."""

from __future__ import annotations

import json
import logging
import os
import tomllib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..operators import chain

log = logging.getLogger("arborel")


class ReorderBuffer:
    """The buffer's rules in memory: contiguous heights go out in order, late ones and second arrivals are dropped."""

    def __init__(self, next_: int, hint: int | None = None):
        self.next, self.hint, self.pending, self.dropped = next_, hint, {}, 0

    def push(self, height: int, item=None) -> list:
        if height < self.next:
            self.dropped += 1
            return []
        self.pending.setdefault(height, item)
        out = []
        while self.next in self.pending:
            out.append((self.next, self.pending.pop(self.next)))
            self.next += 1
        return out

    def gap(self) -> dict | None:
        """The span that holds the first gap, what waits behind it, and whether that is more than the hint."""
        if not self.pending:
            return None
        return {"from": self.next, "to": max(self.pending), "pending": len(self.pending), "saturated": self.hint is not None and len(self.pending) >= self.hint}


#: Heights of a block of the reorder state, a bit each; blocks that are held in memory at once; heights of a frame that is let go.
BLOCK, HELD, FRAME = 1 << 16, 1024, 1 << 20


class Reorder(StatefulProcessor):
    """ReorderBuffer as state of a chain: the next height, and the heights that wait, as bits of blocks of BLOCK heights, so a call of the state serves many
    heights. Only heights go through it; payloads are joined later."""

    def __init__(self, start: int):
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "next bigint")
        self.waiting = handle.getMapState("blocks", "block bigint", "bits binary")
        self.dropped = handle.getValueState("dropped", "n bigint")

    def _block(self, held: dict[int, np.ndarray], block: int) -> np.ndarray:
        """A block's bits, one byte each; those that were taken before are written back when there are too many."""
        if block not in held:
            if len(held) >= HELD:
                self._flush(held)
            bits = self.waiting.getValue((block,))[0] if self.waiting.containsKey((block,)) else None
            held[block] = np.zeros(BLOCK, bool) if bits is None else np.unpackbits(np.frombuffer(bytes(bits), np.uint8)).astype(bool)
        return held[block]

    def _flush(self, held: dict[int, np.ndarray]) -> None:
        for block, bits in held.items():
            if bits.any():
                self.waiting.updateValue((block,), (np.packbits(bits).tobytes(),))
            elif self.waiting.containsKey((block,)):
                self.waiting.removeKey((block,))
        held.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else self.start
        low = self.dropped.get()[0] if self.dropped.exists() else 0
        held: dict[int, np.ndarray] = {}
        for frame in rows:
            heights = frame["height"].to_numpy(np.int64)
            low += int((heights < at).sum())
            heights = np.sort(heights[heights >= at])
            block = heights // BLOCK
            edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(heights) else []
            for a, b in zip(edges, [*edges[1:], len(heights)]):
                self._block(held, int(block[a]))[heights[a:b] % BLOCK] = True
        first = at
        while (bits := self._block(held, at // BLOCK))[at % BLOCK]:
            missing = np.flatnonzero(~bits[at % BLOCK :])
            until = at + int(missing[0]) if len(missing) else (at // BLOCK + 1) * BLOCK
            bits[at % BLOCK : at % BLOCK + until - at] = False
            at = until
        self._flush(held)
        self.next.update((at,))
        self.dropped.update((low,))
        for a in range(first, at, FRAME):
            out = np.arange(a, min(a + FRAME, at), dtype=np.int64)
            yield pd.DataFrame({"chain": pd.Series([key[0]] * len(out), dtype=object), "height": out})

    def close(self) -> None:
        pass


def reordered(heights: DataFrame, start: int) -> DataFrame:
    """A stream of (chain, height) as (chain, height) in order without gaps, within each chain. Needs the RocksDB state store provider."""
    return heights.groupBy("chain").transformWithStateInPandas(statefulProcessor=Reorder(start), outputStructType="chain string, height bigint", outputMode="append", timeMode="none")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Settings:
    """Of an ingest; from a TOML file, each overridden by PREFIX__NAME in the environment."""

    start: int = 1
    min_entity_batch_size: int = 1_000_000
    max_items: int = 10_000
    fork_detection_heights: int = 100
    non_durable_batches: int = 10
    tick_seconds: float = 1.0
    parallelism: float = 0.5

    @staticmethod
    def load(path: str | None = None, prefix: str = "ARBOREL", environ=os.environ) -> "Settings":
        found = {}
        if path:
            with open(path, "rb") as f:
                found = tomllib.load(f)
        names = {f.name: f.type for f in fields(Settings)}
        if unknown := set(found) - set(names):
            raise ValueError(f"unknown settings {sorted(unknown)}")
        for n in names:
            if (v := environ.get(f"{prefix}__{n.upper()}")) is not None:
                found[n] = v
        return Settings(**{n: (float if "float" in str(names[n]) else int)(v) for n, v in found.items()})

    def cache_mb(self, memory_mb: int) -> int:
        """The same ratio as a share of the memory between a 64th and a quarter, 1 GB at least."""
        return max(1024, round(memory_mb / 64 + (memory_mb / 4 - memory_mb / 64) * min(1.0, max(0.0, self.parallelism))))

    def tasks(self, cores: int) -> int:
        """A ratio from 0 to 1 as a number between a sixteenth of the cores and all."""
        return max(1, round(cores / 16 + (cores - cores / 16) * min(1.0, max(0.0, self.parallelism))))


class Ingest:
    """A micro-batch is stored if it lies wholly at or below the fork height, else linked: a batch that doesn't fit the stored chain replaces the heights it
    covers, in one version, once its parents are known; a batch without a known parent is dropped (and asked for again)."""

    def __init__(self, store, root: str, header: str, settings: Settings, height: str = "height"):
        self.store, self.root, self.header, self.settings, self.height = store, root, header, settings, height
        self.waiting = self._found()

    def _found(self) -> str | None:
        """The newest table of rows that wait, left by an ingest before this one."""
        top = self.store._at("_waiting")
        names = sorted((x.getModificationTime(), x.getPath().toString()) for x in self.store.fs.listStatus(top)) if self.store.fs.exists(top) else []
        return names[-1][1] if names else None

    def persist_or_link(self, trees: DataFrame, fork_height: int) -> int | None:
        trees = trees.persist()
        try:
            span = trees.agg(F.min(self.height), F.max(self.height)).first()
            if span[0] is None:
                return None
            if span[1] <= fork_height:
                return self.store.persist(self.root, trees)
            known = self.store.table(self.header)
            fork = trees.select(self.height, *[F.col(f"header.{c}").alias(c) for c in ("hash", "prev_hash")])
            linked = chain.linked_fork(known, fork, self.settings.fork_detection_heights, self.height)
            keep = trees.join(linked.select(self.height), self.height, "left_semi")
            if not keep.take(1):
                return None
            # heights above the fork belong to the branch that is left
            start = keep.agg(F.min(self.height)).first()[0]
            gone = self.store.table(self.root).where(F.col(self.height) >= start).select(self.height)
            return self.store.replace(self.root, keep, gone)
        finally:
            trees.unpersist()

    def tip(self) -> int:
        """The last stored height; one below the start if there is none."""
        last = self.store.table(self.root).agg(F.max(self.height)).first()[0]
        return self.settings.start - 1 if last is None else last

    def _pending(self) -> DataFrame | None:
        return self.store.spark.read.parquet(self.waiting) if self.waiting else None

    def arrive(self, rows: DataFrame, build: Callable[[DataFrame], DataFrame], tip: int | None = None) -> dict:
        """Rows (height, raw) in any order: those that continue the chain without a gap are built, cut into weight batches and stored in order, together
        with what waited; others wait in a written table; of equal heights the first arrival counts. A row at or below the tip is late: it is dropped, unless it
        reaches into the fork window and no header has its hash, when it takes part in a fork. Far behind `tip` (batch mode) every `non_durable_batches`-th
        batch is published with those before it, else each. Returns what happened."""
        spark, h, s = self.store.spark, self.height, self.settings
        next_ = self.tip() + 1
        held = rows.select(h, "raw").withColumn("_turn", F.lit(1))
        if (waiting := self._pending()) is not None:
            held = held.unionByName(waiting.withColumn("_turn", F.lit(0)))
        held = held.groupBy(h, "raw").agg(F.min("_turn").alias("_turn")).persist()
        try:
            low = held.where(F.col(h) < next_)
            reach = low.where(F.col(h) >= next_ - s.fork_detection_heights)
            forks = build(reach.select(h, "raw")).select("*", F.col("header.hash").alias("_hash")).join(self.store.table(self.header).select(F.col("hash").alias("_hash")), "_hash", "left_anti").drop("_hash").persist()
            forked = forks.count()
            one = held.where(F.col(h) >= next_).groupBy(h).agg(F.min_by("raw", F.struct("_turn", "raw")).alias("raw"))
            ready = chain.contiguous(one.select(h), next_, h)
            told = {"next": next_, "late": low.count() - forked, "forks": forked, "versions": 0}
            # a fork and what follows it are linked together
            trees = build(one.join(ready, h, "left_semi"))
            if forked:
                both = forks.unionByName(trees, allowMissingColumns=True)
                told["versions"] += self.persist_or_link(both, 0) is not None
            else:
                told["versions"] += self._store(trees, tip)
            after = one.where(F.col(h) > self.tip())
            self._wait(after)
            told |= {"tip": self.tip(), "waiting": self._pending().count() if self.waiting else 0}
            return told
        finally:
            held.unpersist()

    def _store(self, trees: DataFrame, tip: int | None) -> int:
        """Stores linked trees in weight batches; the number of versions."""
        h, s = self.height, self.settings
        trees = trees.persist()
        try:
            first, last = trees.agg(F.min(h), F.max(h)).first()
            if first is None:
                return 0
            mode = chain.mode(last if tip is None else tip, first - 1, s.fork_detection_heights)
            weight = F.col("header.weight") if "weight" in trees.schema["header"].dataType.names else F.lit(1)
            slim = trees.select(F.lit("chain").alias("chain"), h, weight.cast("long").alias("weight"))
            batches = chain.weight_batches(slim, ["chain"], h, "weight", s.min_entity_batch_size, s.max_items)
            spans = [(r["a"], r["b"]) for r in batches.groupBy("batch").agg(F.min(h).alias("a"), F.max(h).alias("b")).orderBy("batch").collect()]  # two numbers a batch
            parts, start = [], None
            for number, (a, b) in enumerate(spans):
                start = a if start is None else start
                if durable(number, s.non_durable_batches, mode) or number == len(spans) - 1:
                    parts.append((start, b))
                    start = None
            fork = max(0, (last if tip is None else tip) - s.fork_detection_heights)
            # what lies wholly at or below the fork height is only added: its versions are written together and published in turn
            deep = [x for x in parts if x[1] <= fork]
            done = self.store.persist_spans(self.root, trees, deep)
            for a, b in parts[len(deep) :]:
                done += self.persist_or_link(trees.where(F.col(h).between(a, b)), fork) is not None
            return done
        finally:
            trees.unpersist()

    def _wait(self, rows: DataFrame) -> None:
        before, self.waiting = self.waiting, None
        if rows.take(1):
            at = f"{self.store.path}/_waiting/{uuid.uuid4().hex}"
            rows.write.parquet(at)
            self.waiting = at
        if before:
            path = self.store.spark._jvm.org.apache.hadoop.fs.Path(before)
            self.store.fs.delete(path, True)

    def start(self, stream: DataFrame, build: Callable[[DataFrame], DataFrame], checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """stream: (height, raw) rows in any order, also across batches; build makes trees of them. A batch that fails is tried again by Spark from its offsets."""

        def each(batch: DataFrame, number: int) -> None:
            if batch.take(1):
                told = self.arrive(batch, build)
                log.info("batch %s: %s", number, told)

        writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{self.settings.tick_seconds} seconds")
        return writer.start()


def durable(batch: int, every: int, mode: str) -> bool:
    """Whether a batch's version is published at once: always when continuous, each `every`-th in batch mode."""
    return mode == "continuous" or every <= 1 or batch % every == every - 1


def launch(ingest: Ingest, headers: DataFrame | None, tip: int) -> int:
    """Init, or validation: the height from which to sync, the first header that isn't linked or the one after the last."""
    ingest.store.init()
    if headers is None:
        return ingest.settings.start
    last = headers.agg(F.max(ingest.height)).first()[0]
    if last is None:
        return ingest.settings.start
    broken = chain.broken_links(headers, ingest.settings.start, last, True).agg(F.min(ingest.height)).first()[0]
    return last + 1 if broken is None else broken


def stop(*queries: StreamingQuery) -> None:
    """Lets running batches end, then stops."""
    for q in queries:
        if q.isActive:
            q.processAllAvailable()
            q.stop()


class Progress(StreamingQueryListener):
    """Logs rows a second and totals."""

    def __init__(self):
        self.rows = 0

    def onQueryStarted(self, event) -> None:
        log.info("query %s started", event.id)

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        self.rows += p.get("numInputRows", 0)
        log.info("batch %s: %s rows a second, %s in all", p.get("batchId"), p.get("processedRowsPerSecond"), self.rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        log.info("query %s ended", event.id)


def logger(name: str = "arborel", environ=os.environ) -> logging.Logger:
    """Level from ARBOREL_LOG: debug, info, warn or error."""
    out = logging.getLogger(name)
    out.setLevel({"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}.get(environ.get("ARBOREL_LOG", "info").lower(), logging.INFO))
    return out


def rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark
