"""Writes: trees taken apart, references resolved, dictionaries, upserts and deletes that cascade. All are pure functions from
DataFrames to DataFrames; sources/store.py publishes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import Registry, spark_type


class DoubleSpend(ValueError):
    """One reference occurs twice within one parent."""


def explode_trees(registry: Registry, entity: str, trees: DataFrame) -> dict[str, DataFrame]:
    """A DataFrame of key and stored columns for the entity and each one below it. Transients and references are left behind."""
    keys = registry.keys(entity)
    out = {entity: trees.select(*keys, *[c.name for c in registry.stored(entity)])}
    for r in registry[entity].relations:
        if r.name not in trees.columns:
            continue
        one = F.explode(r.name) if r.kind == "many" else F.col(r.name)
        child = trees.select(*keys, one.alias("_c"))
        child = child.where("_c is not null").select(*keys, "_c.*")
        out |= explode_trees(registry, r.child, child)
    return out


def level(registry: Registry, entity: str, trees: DataFrame, wanted: str) -> DataFrame:
    """The rows of an entity within trees of one above it, with all that hangs at them: key columns, then the fields of the nested value."""
    if entity == wanted:
        return trees
    for r in registry[entity].relations:
        if wanted in registry.descendants(r.child) and r.name in trees.columns:
            keys = registry.keys(entity)
            one = F.explode(r.name) if r.kind == "many" else F.col(r.name)
            child = trees.select(*keys, one.alias("_c")).where("_c is not null").select(*keys, "_c.*")
            return level(registry, r.child, child, wanted)
    raise LookupError(f"no {wanted} in trees of {entity}")


def births(values: DataFrame, column: str, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """(column, birth): the dictionary. A known value keeps its birth for ever; a new one is born with the smallest key that holds it."""
    return born(values, column, keys) if known is None else known.unionByName(born(values, column, keys, known))


def born(values: DataFrame, column: str, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """(column, birth) of the values that aren't known yet."""
    new = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*keys)).alias("birth"))
    return new if known is None else new.join(known.select(column), column, "left_anti")


def encoded(rows: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """rows with the value replaced by its birth."""
    return rows.join(dictionary.withColumnRenamed("birth", f"{column}_birth"), column, "left").drop(column)


def collected(dictionary: DataFrame, column: str, left: DataFrame) -> DataFrame:
    """The dictionary without values that no row holds any more; the births of the others stay."""
    return dictionary.join(left.select(column), column, "left_semi")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows replace those of equal key; of rows with one key in the same batch the largest wins, column by column."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_x")).select(*keys, *[F.col("_x")[c].alias(c) for c in rest]) if rest else rows.distinct()
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(one.select(*rows.columns))


def upsert_trees(registry: Registry, entity: str, tables: dict[str, DataFrame], trees: DataFrame) -> dict[str, DataFrame]:
    """Replaces whole trees: what hung below a replaced key goes, even if the new tree has fewer children."""
    parts, keys = explode_trees(registry, entity, trees), registry.keys(entity)
    gone = trees.select(*keys)
    return {name: tables[name].join(gone, keys, "left_anti").unionByName(parts[name]) if name in parts else tables[name].join(gone, keys, "left_anti") for name in registry.descendants(entity)}


def delete_many(registry: Registry, entity: str, tables: dict[str, DataFrame], wanted: DataFrame) -> dict[str, DataFrame]:
    """Without the wanted keys and all below them: each level is an anti-join on the first parts of its key."""
    keys = registry.keys(entity)
    return {name: tables[name].join(wanted.select(*keys), keys, "left_anti") for name in registry.descendants(entity)}


def deletes_all(table: DataFrame, wanted: DataFrame, keys: list[str]) -> bool:
    """Whether every wanted key is there, which is what a delete reports."""
    return not wanted.select(*keys).join(table.select(*keys), keys, "left_anti").take(1)


def double_spends(refs: DataFrame, parent: list[str], ref: list[str]) -> DataFrame:
    """References that occur more than once within one parent (none: a batch of one parent is sound)."""
    return refs.groupBy(*parent, *ref).agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")


def check_spends(refs: DataFrame, parent: list[str], ref: list[str]) -> None:
    if bad := double_spends(refs, parent, ref).take(1):
        raise DoubleSpend(f"one output is spent twice: {bad[0]}")


def resolve(refs: DataFrame, targets: DataFrame, on: str, target_keys: list[str], sentinel: dict[str, Column | int]) -> DataFrame:
    """refs with the keys of the row of targets that holds the referenced value; where there is none, the sentinel. Of several targets with
    the value the smallest key is meant. Hot values are split by the planner (a plain shuffle join)."""
    found = targets.groupBy(on).agg(F.min(F.struct(*target_keys)).alias("_t"))
    joined = refs.join(found, on, "left")
    return joined.select(*[c for c in joined.columns if c != "_t"], *[F.coalesce(F.col("_t")[k], F.lit(sentinel[k]) if not isinstance(sentinel[k], Column) else sentinel[k]).alias(k) for k in target_keys])


#: Index of a reference that spends nothing.
COINBASE = 65535


def resolve_outputs(refs: DataFrame, transactions: DataFrame, tx_keys: list[str], hash_column: str = "hash", index_column: str = "index") -> DataFrame:
    """Pointers of (transaction hash, output index) references: the transaction's key and the index. Unresolved ones get zeros, coinbases the index 65535. Indices
    are cut to 16 bits."""
    index = F.col(index_column).bitwiseAND(COINBASE)
    found = transactions.groupBy(hash_column).agg(F.min(F.struct(*tx_keys)).alias("_t"))
    met = refs.join(found, hash_column, "left")
    pointer = F.when(F.col("_t").isNotNull() | (index == COINBASE), index).otherwise(F.lit(0))
    return met.select(*[c for c in met.columns if c != "_t"], *[F.coalesce(F.col("_t")[k], F.lit(0)).alias(k) for k in tx_keys], pointer.alias("pointer_index"))


def hook_rows(spenders: DataFrame, keys: list[str], refs: str, index: str) -> DataFrame:
    """One child row for each transient reference: the spender's key, the position, and the reference's fields."""
    return spenders.select(*keys, F.posexplode(refs).alias(index, "_ref")).select(*keys, index, "_ref.*")


def hooked(registry: Registry, entity: str, rows: DataFrame, known) -> DataFrame:
    """The child rows that an entity's hook makes: one for each reference of rows (key columns and the transient references), whose pointer column holds the key
    of what is referenced. By the entity's own hash column a reference is (hash, index); by a relation it is a value of that child's used column. known(entity)
    gives the rows that can be referenced. A reference that occurs twice within one root is an error, but for those that spend nothing."""
    hook, keys = registry[entity].hook, registry.keys(entity)
    relation = next(r for r in registry[entity].relations if r.name == hook.relation)
    index = registry[relation.child].key.index
    pointer = next(c for c in registry[relation.child].columns if c.pointer)
    refs = hook_rows(rows, keys, hook.refs, "_place") if hook.using in {c.name for c in registry[entity].columns} else rows.select(*keys, F.posexplode(hook.refs).alias("_place", "_value"))
    refs = refs.select(*[F.col(k).alias(f"_s_{k}") for k in keys], *[c for c in refs.columns if c not in keys])
    values = [c for c in refs.columns if not c.startswith("_s_") and c != "_place"]
    spending = refs if len(values) == 1 else refs.where(F.col("index").bitwiseAND(COINBASE) != COINBASE)
    check_spends(spending, [f"_s_{keys[0]}"], values)
    if hook.using in {c.name for c in registry[entity].columns}:
        found = resolve_outputs(refs.withColumnRenamed("hash", hook.using), known(entity), keys, hook.using, "index")
        parts = [*keys, "pointer_index"]
    else:
        target = next(r.child for r in registry[entity].relations if r.name == hook.using)
        used = next(c.name for c in registry[target].columns if c.used)
        parts = registry.keys(target)
        found = resolve(refs.withColumnRenamed("_value", used), known(target), used, parts, dict.fromkeys(parts, 0))
    kind = spark_type(pointer.type)
    return found.select(*[F.col(f"_s_{k}").alias(k) for k in keys], F.col("_place").alias(index), F.struct(*[F.col(p).cast(f.dataType).alias(f.name) for p, f in zip(parts, kind)]).alias(pointer.name))


def sorted_for_write(rows: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Range-partitioned and sorted by key, so row groups have narrow bounds on it."""
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)


def unsorted(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows whose key is not above that of the row before, in the order given: within a partition the row before, and for a partition's first row the last
    row of the partition before it. The order's partitions are told apart by its upper bits, as monotonically_increasing_id gives them."""
    key, part = F.struct(*keys), F.shiftright(F.col(order), 33)
    marked = rows.withColumn("_part", part).withColumn("_before", F.lag(key).over(Window.partitionBy("_part").orderBy(order)))
    ends = rows.groupBy(part.alias("_p")).agg(F.max_by(key, order).alias("_last"))  # a row a partition
    ends = ends.withColumn("_last", F.lag("_last").over(Window.orderBy("_p")))
    met = marked.join(F.broadcast(ends), F.col("_part") == F.col("_p"), "left").withColumn("_before", F.coalesce("_before", "_last"))
    return met.where(F.col("_before") >= key).select(*rows.columns)
