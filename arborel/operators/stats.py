"""Counts of tables and columns, and statistics of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .compose import Catalog


def table_info(catalog: Catalog, entity: str, deep: bool = True) -> DataFrame:
    """(entity, column, access, entries, distinct_values) for the entity and all below it; one aggregation an entity. Keys count as the column `key`."""
    registry, out = catalog.registry, None
    for name in registry.descendants(entity) if deep else [entity]:
        columns = registry.stored(name)
        counted = [F.count(F.lit(1)).alias("n_key")] + [F.count(c.name).alias(f"n_{c.name}") for c in columns] + [F.countDistinct(c.name).alias(f"d_{c.name}") for c in columns if c.access == "dictionary"]
        facts = catalog.frame(name).agg(*counted)
        rows = [F.struct(F.lit("key").alias("column"), F.lit("key").alias("access"), F.col("n_key").alias("entries"), F.lit(None).cast("long").alias("distinct_values"))]
        rows += [F.struct(F.lit(c.name).alias("column"), F.lit(c.access).alias("access"), F.col(f"n_{c.name}").alias("entries"), (F.col(f"d_{c.name}") if c.access == "dictionary" else F.lit(None)).cast("long").alias("distinct_values")) for c in columns]
        part = facts.select(F.lit(name).alias("entity"), F.explode(F.array(*rows)).alias("x")).select("entity", "x.*")
        out = part if out is None else out.union(part)
    return out


def index_stats(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(column).alias("pk_by_index"))


def dictionary_stats(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(column) if approximate else F.countDistinct(column)
    return df.agg(count.alias("distinct_values"))


def plain_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("underlying"))


def task_stats(tasks: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """Last value, mean, population deviation and coefficient of variation in percent, of each group; total too, to sort by."""
    mean, dev = F.avg(value), F.stddev_pop(value)
    return tasks.groupBy(*group).agg(F.max_by(value, order).alias("last"), mean.alias("mean"), dev.alias("dev"), F.when(mean == 0, F.lit(0.0)).otherwise(dev / mean * 100).alias("cv"), F.sum(value).alias("total"))


def slowest(tasks: DataFrame, name: str, total: str) -> DataFrame:
    """Of tasks of one name the row with the largest total."""
    return tasks.groupBy(name).agg(F.max_by(F.struct(*tasks.columns), total).alias("x")).select("x.*")
