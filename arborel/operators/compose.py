"""Trees: an entity's rows with their children nested, whole or filtered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import filters
from ..schema import Reference, Registry, Relation, spark_type


class NotFound(LookupError):
    """A row that must be there is missing."""


class Catalog:
    """A DataFrame for each entity of a registry, all of one snapshot."""

    def __init__(self, registry: Registry, frames: dict[str, DataFrame]):
        self.registry, self.frames = registry, frames

    def frame(self, entity: str) -> DataFrame:
        """Key columns and stored columns, in the registry's order."""
        names = self.registry.keys(entity) + [c.name for c in self.registry.stored(entity)]
        return self.frames[entity].select(*names)


def nested(df: DataFrame, drop: list[str]) -> list:
    return [F.col(c) for c in df.columns if c not in drop]


def compose(catalog: Catalog, entity: str, rows: DataFrame | None = None, query: dict | None = None, columns: list[str] | None = None) -> DataFrame:
    """The trees of `rows` (some of the entity's rows; None: all). query: a filter; None differs from an empty one, which drops rows whose to-many
    relations are empty. Filters of children are applied to child rows before they are grouped; children are cut to the wanted parents by
    a semi-join on the key's first parts. columns: of the entity itself, to read fewer."""
    registry, keys = catalog.registry, catalog.registry.keys(entity)
    if rows is None or query:
        filters.check(registry, entity, query)
    out = catalog.frame(entity) if rows is None else rows
    if (own := filters.own(registry, entity, query)) is not None:
        out = out.where(own)
    if columns is not None:
        out = out.select(*keys, *columns)
    narrow = rows is not None or own is not None
    references = registry[entity].references
    for relation in registry[entity].relations:
        out = attach(catalog, out, keys, relation, query, narrow, [r for r in references if r.read_from and r.read_from[0] == relation.name])
    for c in registry[entity].columns:
        if c.transient:
            out = out.withColumn(c.name, default(c))
    for r in references:
        if r.read_from is None:
            out = out.withColumn(r.name, F.array().cast(T.ArrayType(catalog.frame(r.target).schema)))
    names = [r.name for r in references]
    return out.select(*[c for c in out.columns if c not in names], *names) if names else out


def default(column):
    """What a transient column reads as: its default, else the type's zero."""
    kind = spark_type(column.type)
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    zero = {T.StringType: "", T.BooleanType: False, T.BinaryType: b""}.get(type(kind), 0)
    return F.lit(column.default if column.default is not None else zero).cast(kind)


def attach(catalog: Catalog, out: DataFrame, keys: list[str], relation: Relation, query: dict | None, narrow: bool, references: list[Reference] = ()) -> DataFrame:
    """out with the relation's children. What references read through their pointers is met on the child rows, and comes in the same grouping."""
    child = catalog.frame(relation.child)
    part = query.get(relation.name) if query is not None else None
    if narrow:
        child = child.join(out.select(*keys), keys, "left_semi")
    tree = compose(catalog, relation.child, child, part)
    if relation.kind == "many":
        index = catalog.registry[relation.child].key.index
        own = [index, *[c for c in tree.columns if c not in (*keys, index)]]
        for k, reference in enumerate(references):
            tree = pointed(catalog, tree, reference, f"_to{k}")
        met = [f"_to{k}" for k in range(len(references))]
        grouped = tree.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*own, *met))).alias("_items"))
        made = [F.transform("_items", lambda x: F.struct(*[x[c].alias(c) for c in own])).alias(relation.name) if met else F.col("_items").alias(relation.name)]
        made += [there(m).alias(r.name) for r, m in zip(references, met)]
        grouped = grouped.select(*keys, *made)
        joined = out.join(grouped, keys, "left" if query is None else "inner")
        for name in [relation.name, *[r.name for r in references]] if query is None else []:
            joined = joined.withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
        return joined
    packed = tree.select(*keys, F.struct(*nested(tree, keys)).alias(relation.name))
    # a one-to-one child is always there (see missing); an optional one only has to be where it is filtered by
    return out.join(packed, keys, "left" if relation.kind == "optional" and part is None else "inner")


def missing(catalog: Catalog, entity: str, relation: str) -> DataFrame:
    """Keys whose one-to-one child is absent; reading them would be an error."""
    keys = catalog.registry.keys(entity)
    child = next(r.child for r in catalog.registry[entity].relations if r.name == relation)
    return catalog.frame(entity).select(*keys).join(catalog.frame(child).select(*keys), keys, "left_anti")


def there(field: str):
    """The field of those items that have it, in their order."""
    return F.transform(F.filter("_items", lambda x: x[field].isNotNull()), lambda x: x[field])


def pointed(catalog: Catalog, rows: DataFrame, reference: Reference, name: str) -> DataFrame:
    """rows with the tree that their pointer column leads to, null where it isn't there."""
    pointer, target_keys = reference.read_from[1], catalog.registry.keys(reference.target)
    tree = compose(catalog, reference.target, catalog.frame(reference.target))
    tree = tree.select(*[F.col(k).alias(f"_t_{k}") for k in target_keys], F.struct(*tree.columns).alias(name))
    on = F.col(pointer) == F.col(f"_t_{target_keys[0]}") if len(target_keys) == 1 else _all(F.col(pointer)[k] == F.col(f"_t_{k}") for k in target_keys)
    return rows.join(tree, on, "left").drop(*[f"_t_{k}" for k in target_keys])


def _all(conditions):
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out
