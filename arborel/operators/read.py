"""Reads of one entity: by key, by key range, by secondary column, by relation. Every method returns a DataFrame unless its name says otherwise;
key-ordered ones are sorted. Bulk forms take a DataFrame of keys, so many lookups are one job."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import filters, keys as K
from ..schema import SchemaError
from .compose import Catalog, NotFound, compose

#: Most rows that take and tail return.
MOST = 100


class TooMany(ValueError):
    """take and tail are for small numbers."""


class Reader:
    def __init__(self, catalog: Catalog, entity: str):
        self.catalog, self.entity = catalog, entity
        self.registry = catalog.registry
        self.keys = self.registry.keys(entity)

    @property
    def rows(self) -> DataFrame:
        return self.catalog.frame(self.entity)

    def _key(self, key) -> tuple:
        key = key if isinstance(key, tuple) else (key,)
        if len(key) != len(self.keys):
            raise K.KeyFormatError(f"{self.entity} has a key of {len(self.keys)} parts")
        return key

    def _tree(self, rows: DataFrame, query=None) -> DataFrame:
        query = filters.parse(query)
        filters.check(self.registry, self.entity, query)
        return compose(self.catalog, self.entity, rows, query)

    def order(self, descending: bool = False) -> list[Column]:
        return [F.col(k).desc() if descending else F.col(k) for k in self.keys]

    # by key

    def get(self, key) -> DataFrame:
        """The tree of one key; no row if there is none."""
        return self._tree(self.rows.where(K.equals(self.keys, self._key(key))))

    def exists(self, key) -> bool:
        return bool(self.rows.where(K.equals(self.keys, self._key(key))).select(F.lit(1)).take(1))

    def filter(self, key, query) -> DataFrame:
        """get, if it also matches."""
        return self._tree(self.rows.where(K.equals(self.keys, self._key(key))), query)

    def first(self) -> DataFrame:
        return self._ends(1, False)

    def last(self) -> DataFrame:
        return self._ends(1, True)

    def take(self, n: int) -> DataFrame:
        return self._ends(self._few(n), False)

    def tail(self, n: int, strict_bound: bool = False) -> DataFrame:
        """The last n rows in key order. strict_bound: only those of the last n root values, as a store that bounds the scan by the key would read."""
        if strict_bound and self._few(n):
            last = self.rows.select(*self.keys).orderBy(*self.order(True)).limit(1).collect()
            if last:
                start = K.rollback_or_init(K.next_index(tuple(last[0])), n)
                return self._ends(n, True, self.rows.where(K.at_least(self.keys, start)))
        return self._ends(self._few(n), True)

    def _few(self, n: int) -> int:
        if n > MOST:
            raise TooMany(f"at most {MOST} rows")
        return n

    def _ends(self, n: int, descending: bool, rows: DataFrame | None = None) -> DataFrame:
        """Keys first: the limit is taken on key columns alone, and only those rows are composed. The keys (MOST at most) become literals, whose
        bounds on the root reach the scans of the entity and of all below it."""
        rows = self.rows if rows is None else rows
        picked = [tuple(r) for r in rows.select(*self.keys).orderBy(*self.order(descending)).limit(n).collect()]
        wanted = F.col(self.keys[0]).isin(sorted({k[0] for k in picked})) if picked else F.lit(False)
        if picked and len(self.keys) > 1:
            wanted = wanted & reduce(lambda a, b: a | b, [K.equals(self.keys, k) for k in picked])
        return self._tree(rows.where(wanted)).orderBy(*self.order())

    def range(self, start, until, query=None) -> DataFrame:
        """Half-open range of keys, in key order."""
        return self._tree(self._between(start, until), query).orderBy(*self.order())

    def _between(self, start, until) -> DataFrame:
        return self.rows.where(K.between(self.keys, self._key(start), self._key(until)))

    def stream_range(self, start, until, query=None) -> Iterator[str]:
        """range as lines of JSON, read partition by partition."""
        return lines(self.range(start, until, query))

    def key_range(self, start, until) -> DataFrame:
        return self._between(start, until).select(*self.keys)

    def iter_keys(self) -> DataFrame:
        return self.rows.select(*self.keys).orderBy(*self.order())

    def parent_key(self, key) -> tuple:
        return K.parent(self._key(key))

    def many(self, wanted: DataFrame, query=None) -> DataFrame:
        """Trees of all keys of `wanted` that are there."""
        return self._tree(self.rows.join(wanted.select(*self.keys), self.keys, "left_semi"), query)

    def stream_many(self, wanted: DataFrame, query=None) -> Iterator[str]:
        return lines(self.many(wanted, query))

    # by relation

    def child(self, key, relation: str) -> DataFrame:
        """The children of one key under a relation, as trees in the order of their index. A one-to-one child that is absent is an error."""
        found = next((r for r in self.registry[self.entity].relations if r.name == relation), None)
        if found is None:
            raise SchemaError(f"{self.entity} has no relation {relation}")
        reader = Reader(self.catalog, found.child)
        rows = reader.rows.where(K.equals(self.keys, self._key(key)))
        if found.kind == "one" and not rows.select(F.lit(1)).take(1):
            raise NotFound(f"{self.entity} {K.text(self._key(key))} has no {relation}")
        return reader._tree(rows).orderBy(*reader.order())

    # by secondary column

    def _by(self, column: str, value) -> DataFrame:
        if self.registry.column(self.entity, column).access == "plain":
            raise SchemaError(f"{self.entity}.{column} is no index, range or dictionary column")
        return self.rows.where(F.col(column) == F.lit(value))

    def get_by(self, column: str, value, query=None) -> DataFrame:
        """All with column = value, in key order; an unknown value gives none."""
        return self._tree(self._by(column, value), query).orderBy(*self.order())

    def stream_by(self, column: str, value, query=None) -> Iterator[str]:
        return lines(self.get_by(column, value, query))

    def keys_by(self, column: str, value) -> DataFrame:
        return self._by(column, value).select(*self.keys).orderBy(*self.order())

    def stream_keys_by(self, column: str, value) -> Iterator[str]:
        return lines(self.keys_by(column, value))

    def range_by(self, column: str, start, until, query=None) -> DataFrame:
        """Half-open range of values, in the order of value and key."""
        if self.registry.column(self.entity, column).access != "range":
            raise SchemaError(f"{self.entity}.{column} is no range column")
        rows = self.rows.where((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(until)))
        return self._tree(rows, query).orderBy(column, *self.order())

    def stream_range_by(self, column: str, start, until, query=None) -> Iterator[str]:
        return lines(self.range_by(column, start, until, query))

    def parents_by(self, column: str, value, query=None) -> DataFrame:
        """The distinct parents of those with column = value, filtered, in key order."""
        above = self.registry.parent(self.entity)
        if above is None:
            raise SchemaError(f"{self.entity} has no parent")
        parent = Reader(self.catalog, above)
        return parent.many(self._by(column, value).select(*parent.keys).distinct(), query).orderBy(*parent.order())

    def stream_parents_by(self, column: str, value, query=None) -> Iterator[str]:
        return lines(self.parents_by(column, value, query))

    def value_of(self, key, column: str) -> DataFrame:
        """The column's value of one key."""
        return self.rows.where(K.equals(self.keys, self._key(key))).select(column)

    def any_by(self, column: str, before: tuple | None = None) -> DataFrame:
        """One key for each value: the latest before a given key, or the smallest."""
        rows = self.rows if before is None else self.rows.where(K.below(self.keys, before))
        pick = F.min if before is None else F.max
        return rows.groupBy(column).agg(pick(F.struct(*self.keys)).alias("key")).select(column, "key.*")


class Lines(Iterator[str]):
    """Rows as JSON, an object a line: iterated on the driver partition by partition, or taken as `frame` (one column, line), whose lines stay
    on the executors."""

    def __init__(self, df: DataFrame):
        self.frame = df.select(F.to_json(F.struct(*df.columns)).alias("line"))
        self._rows: Iterator | None = None

    def __next__(self) -> str:
        if self._rows is None:
            self._rows = self.frame.toLocalIterator()
        return next(self._rows)[0]


def lines(df: DataFrame) -> Lines:
    """Rows as JSON, an object a line."""
    return Lines(df)
