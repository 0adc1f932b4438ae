"""Feeds of blocks: a generated chain, files of a node's answers, and a streaming source whose offsets are heights."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def retried(call: Callable, attempts: int = 3, delay: float = 1.0, sleep=time.sleep):
    """The call's result; a failure is tried again after a fixed delay, the last one is raised."""
    for left in range(attempts - 1, -1, -1):
        try:
            return call()
        except Exception:
            if not left:
                raise
            sleep(delay)


def demo_hash(height: int) -> str:
    return hashlib.sha256(str(height).encode()).hexdigest()


def demo_chain(spark: SparkSession, n: int, start: int = 1) -> DataFrame:
    """n linked headers from a height on: (height, hash, prev_hash, timestamp, weight)."""
    sha = lambda c: F.sha2(c.cast("string"), 256)
    h = F.col("id")
    return spark.range(start, start + n).select(h.alias("height"), sha(h).alias("hash"), sha(h - 1).alias("prev_hash"), (h * 600).alias("timestamp"), (h % 7 + 1).alias("weight"))


def raw_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A node's answers saved as JSON lines, (raw, valid): lines that are no JSON object with a height are marked, not dropped."""
    text = spark.read.text(path).withColumnRenamed("value", "raw")
    return text.withColumn("valid", F.get_json_object("raw", "$.height").cast("bigint").isNotNull())


def processed(raw: DataFrame, schema: str) -> DataFrame:
    """Raw blocks as rows of the schema; bad ones are skipped (count them with an observation on `raw`)."""
    return raw.where("valid").select(F.from_json("raw", schema).alias("b")).select("b.*")


class Heights(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class HeightReader(DataSourceStreamReader):
    """Heights from `start` (1: the genesis isn't stored) to the tip, `per_batch` at a time at most, `per_task` in a task. The connector gives tip()
    and block(height) -> JSON; a failing call is tried again."""

    def __init__(self, connector, start: int, per_batch: int, per_task: int, attempts: int, delay: float):
        self.connector, self.first, self.per_batch, self.per_task, self.attempts, self.delay = connector, start, per_batch, per_task, attempts, delay
        self.at = start

    def initialOffset(self) -> dict:
        return {"next": self.first}

    def latestOffset(self) -> dict:
        tip = retried(self.connector.tip, self.attempts, self.delay)
        self.at = max(self.at, min(tip + 1, self.at + self.per_batch))
        return {"next": self.at}

    def partitions(self, start: dict, end: dict) -> list[Heights]:
        self.at = max(self.at, end["next"])
        return [Heights(a, min(a + self.per_task, end["next"])) for a in range(start["next"], end["next"], self.per_task)]

    def read(self, partition: Heights) -> Iterator[tuple]:
        for height in range(partition.start, partition.end):
            yield (height, retried(lambda h=height: self.connector.block(h), self.attempts, self.delay))


class DemoConnector:
    """A chain of n linked blocks, in memory."""

    def __init__(self, n: int):
        self.n = n

    def tip(self) -> int:
        return self.n

    def block(self, height: int) -> str:
        return json.dumps({"height": height, "hash": demo_hash(height), "prev_hash": demo_hash(height - 1), "timestamp": height * 600, "weight": height % 7 + 1})


class FileConnector:
    """Blocks as files <height>.json in a folder that driver and executors share; stands in for a node's REST, RPC or socket interface."""

    def __init__(self, path: str):
        self.path = path

    def tip(self) -> int:
        import os

        return max((int(n[:-5]) for n in os.listdir(self.path) if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def block(self, height: int) -> str:
        with open(f"{self.path}/{height}.json") as f:
            return f.read()


class BlockSource(DataSource):
    """spark.dataSource.register(BlockSource); spark.readStream.format("blocks").option("demo", 100) or .option("path", folder)."""

    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return "height bigint, raw string"

    def streamReader(self, schema) -> HeightReader:
        o = self.options
        connector = FileConnector(o["path"]) if "path" in o else DemoConnector(int(o.get("demo", 10)))
        return HeightReader(connector, int(o.get("start", 1)), int(o.get("per_batch", 1000)), int(o.get("per_task", 100)), int(o.get("attempts", 3)), float(o.get("delay", 1.0)))
