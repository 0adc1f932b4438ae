"""A versioned store of entity tables on any file system Spark writes to. One manifest names the files of a version, and is published by
one rename after all tables are written: readers see a whole version or the one before.

Rows are cut into buckets by root key ranges of SPAN, and a bucket into pieces. A commit that only adds keys writes a piece of its own rows, and
one of new dictionary values; FAN pieces of one level become one of the next, so a row is written again a logarithmic number of times. A
bucket is rewritten only where keys are replaced or deleted. A read by key opens only the key's bucket. Within a file rows are sorted by
key; index and dictionary columns get Parquet bloom filters."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import write as W
from ..operators.compose import Catalog
from ..schema import Registry

SPAN = 100_000
#: pieces of one level that are merged into one of the next
FAN = 16


def merged(levels: list[int]) -> tuple[int, int]:
    """How many of the last pieces, whose levels never rise, a new piece is merged with, and the level of what comes of it."""
    n, level = 0, 0
    while (same := levels.count(level)) >= FAN - 1:
        n, level = n + same, level + 1
    return n, level


class Conflict(RuntimeError):
    """Another commit was published first."""


class Store:
    def __init__(self, spark: SparkSession, path: str, registry: Registry, span: int = SPAN):
        self.spark, self.path, self.registry, self.span = spark, path.rstrip("/"), registry, span
        self.root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def version(self) -> int:
        """The latest published version, 0 if there is none."""
        where = self._at("_manifests")
        names = [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}, "dictionaries": {}}
        return json.loads(self.spark.read.text(f"{self.path}/_manifests/{version}.json", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        self.fs.mkdirs(self._at("_manifests"))
        draft, final = self._at("_manifests", f".{uuid.uuid4().hex}"), self._at("_manifests", f"{manifest['version']}.json")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']} is there already")

    # reads

    def table(self, entity: str, manifest: dict | None = None, buckets: set[int] | None = None) -> DataFrame:
        manifest = manifest or self.manifest()
        return self._pieces(entity, [p for b, x in manifest["tables"].get(entity, {}).items() if buckets is None or int(b) in buckets for p, _ in x])

    def _pieces(self, entity: str, paths: list[str]) -> DataFrame:
        schema = self.registry.struct(entity)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def catalog(self, version: int | None = None, roots: tuple[int, int] | None = None) -> Catalog:
        """All tables of one version; roots: a half-open range of root keys, to open only its buckets."""
        manifest = self.manifest(version)
        buckets = None if roots is None else set(range(roots[0] // self.span, (roots[1] - 1) // self.span + 1))
        return Catalog(self.registry, {e: self.table(e, manifest, buckets) for e in self.registry.entities})

    def dictionary(self, entity: str, column: str, manifest: dict | None = None) -> DataFrame | None:
        at = (manifest or self.manifest())["dictionaries"].get(f"{entity}.{column}")
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p, _ in at]) if at else None

    # commits

    def init(self) -> None:
        """Publishes an empty first version."""
        if not self.version():
            self._publish({"version": 1, "tables": {e: {} for e in self.registry.entities}, "dictionaries": {}})

    def persist(self, entity: str, trees: DataFrame) -> int:
        """Upserts whole trees; returns the new version."""
        return self.commit(entity, trees=trees)

    def persist_spans(self, entity: str, trees: DataFrame, spans: list[tuple[int, int]]) -> int:
        """Stores the trees of each span (first and last root key; rising, apart, over all trees) as a version of its own, in turn; returns the number of versions. Where all
        of them only add keys and no hook or dictionary asks for the versions before, one job a table writes the rows of all spans, each to pieces of its
        own, and the manifests are published one after the other. The next commit to a bucket merges its pieces."""
        if not spans:
            return 0
        names = self.registry.write_order(entity)
        root = self.registry.keys(entity)[0]
        old = self.manifest()
        some = trees.where(F.col(root).between(spans[0][0], spans[-1][1]))
        plain = len(spans) > 1 and not any(self.registry[n].hook or any(c.access == "dictionary" for c in self.registry.stored(n)) for n in names)
        touched = set(range(spans[0][0] // self.span, spans[-1][1] // self.span + 1))
        if not plain or any(self._hits(entity, some.select(*self.registry.keys(entity)), old, touched, [spans[0][0]], [spans[-1][1]]).values()):
            for a, b in spans:
                self.persist(entity, trees.where(F.col(root).between(a, b)))
            return len(spans)
        starts = [a for a, _ in spans]

        @F.pandas_udf("int")
        def span_of(keys: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(starts, keys, "right") - 1)

        some = some.persist()
        try:
            paths = {}
            for name, rows in W.explode_trees(self.registry, entity, some).items():
                at = f"{name}/v{old['version'] + 1}-{uuid.uuid4().hex[:8]}"
                self._put(name, rows.withColumn("_span", span_of(root)), at, ["_span", "_bucket"])
                for s in self.fs.listStatus(self._at(at)):
                    if (top := s.getPath().getName()).startswith("_span="):
                        for x in self.fs.listStatus(s.getPath()):
                            bucket = x.getPath().getName()
                            paths.setdefault(int(top.removeprefix("_span=")), []).append((name, bucket.removeprefix("_bucket="), f"{at}/{top}/{bucket}"))
        finally:
            some.unpersist()
        tables = {e: dict(x) for e, x in old["tables"].items()}
        for n in range(len(spans)):
            for name, bucket, path in paths.get(n, []):
                tables.setdefault(name, {})[bucket] = [*tables.get(name, {}).get(bucket, []), (path, 0)]
            self._publish({"version": old["version"] + 1 + n, "tables": tables, "dictionaries": old["dictionaries"]})
        return len(spans)

    def remove(self, entity: str, wanted: DataFrame) -> bool:
        """Deletes keys and all below them; whether all were there is known before the commit."""
        found = W.deletes_all(self.table(entity), wanted, self.registry.keys(entity))
        self.commit(entity, gone=wanted)
        return found

    def replace(self, entity: str, trees: DataFrame, gone: DataFrame) -> int:
        """Deletes and stores in one version: a fork never leaves a gap that can be seen."""
        return self.commit(entity, trees=trees, gone=gone)

    def truncate(self, entity: str) -> int:
        """Deletes all rows of an entity and below it; older versions can still be read."""
        old = self.manifest()
        gone = set(self.registry.descendants(entity))
        tables = {e: {} if e in gone else x for e, x in old["tables"].items()}
        dictionaries = {k: p for k, p in old["dictionaries"].items() if k.split(".")[0] not in gone}
        self._publish({"version": old["version"] + 1, "tables": tables, "dictionaries": dictionaries})
        return old["version"] + 1

    def vacuum(self, keep: int = 1) -> None:
        """Deletes files that none of the last `keep` versions name. Not while another commit is under way."""
        latest = self.version()
        kept = [self.manifest(v) for v in range(max(1, latest - keep + 1), latest + 1)]
        named = {"/".join(p.split("/")[:2]) for m in kept for x in m["tables"].values() for b in x.values() for p, _ in b} | {p for m in kept for x in m["dictionaries"].values() for p, _ in x}
        for top in self.fs.listStatus(self.root):
            name = top.getPath().getName()
            if not name.startswith("_"):
                for s in self.fs.listStatus(top.getPath()):
                    if f"{name}/{s.getPath().getName()}" not in named:
                        self.fs.delete(s.getPath(), True)
        for v in range(1, latest - keep + 1):
            self.fs.delete(self._at("_manifests", f"{v}.json"), False)

    def _bucket(self, entity: str):
        return F.floor(F.col(self.registry.keys(entity)[0]) / self.span).cast("long")

    def commit(self, entity: str, trees: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """Publishes a version without the keys of `gone` and with `trees` in the place of theirs."""
        if trees is None:
            return self._commit(entity, None, gone)
        trees = trees.persist()  # every table of the version is made from it
        try:
            return self._commit(entity, trees, gone)
        finally:
            trees.unpersist()

    def _commit(self, entity: str, trees: DataFrame | None, gone: DataFrame | None) -> int:
        old = self.manifest()
        version = old["version"] + 1
        keys = self.registry.keys(entity)
        new = W.explode_trees(self.registry, entity, trees) if trees is not None else {}
        lost = [x.select(*keys) for x in (trees, gone) if x is not None]
        lost = lost[0] if len(lost) == 1 else lost[0].union(lost[1])
        for name in self.registry.descendants(entity) if trees is not None else []:
            if hook := self.registry[name].hook:
                rows = W.level(self.registry, entity, trees, name)
                if hook.refs in rows.columns:
                    # what can be referenced: rows that stay, and the batch's own
                    known = lambda e: self.table(e, old).join(lost, keys, "left_anti").unionByName(new[e])
                    made = W.hooked(self.registry, name, rows, known)
                    child = next(r.child for r in self.registry[name].relations if r.name == hook.relation)
                    new[child] = made if child not in new else new[child].unionByName(made)
        spans = lost.groupBy(self._bucket(entity).alias("b")).agg(F.min(keys[0]), F.max(keys[0])).collect()  # bucket numbers, not keys
        touched = {r[0] for r in spans}
        hits = self._hits(entity, lost, old, touched, [r[1] for r in spans], [r[2] for r in spans])
        tables = {e: dict(x) for e, x in old["tables"].items()}
        dictionaries = dict(old["dictionaries"])
        for name in self.registry.write_order(entity):
            tables[name] = self._table_of(name, tables.get(name, {}), new.get(name), lost, keys, touched, hits.get(name, set()), version)
        manifest = {"version": version, "tables": tables, "dictionaries": dictionaries}
        for name in self.registry.descendants(entity):
            for c in self.registry.stored(name):
                if c.access == "dictionary":
                    dictionaries[f"{name}.{c.name}"] = self._births(name, c.name, new.get(name), manifest, version, bool(hits.get(name)))
        self._publish(manifest)
        return version

    def _hits(self, entity: str, lost: DataFrame, old: dict, touched: set[int], least: list, most: list) -> dict[str, set[int]]:
        """For each entity the buckets that hold rows of the lost keys. Reads keys alone, within the touched buckets and the range of the lost ones."""
        keys = self.registry.keys(entity)
        held = [n for n in self.registry.descendants(entity) if any(int(b) in touched for b in old["tables"].get(n, {}))]
        if not held:
            return {}
        inside = F.col(keys[0]).between(min(least), max(most))
        found = [self.table(n, old, touched).where(inside).select(*keys, F.lit(n).alias("_name")) for n in held]
        for x in found[1:]:
            found[0] = found[0].union(x)
        met = found[0].join(lost, keys, "left_semi").select("_name", self._bucket(entity).alias("b")).distinct().collect()
        return {n: {r.b for r in met if r._name == n} for n in held}

    def _table_of(self, name: str, now: dict, new: DataFrame | None, lost: DataFrame, keys: list[str], touched: set[int], hit: set[int], version: int) -> dict:
        """The buckets of an entity after a commit, as lists of (path, level). Those of `hit` are rewritten without the lost keys; to the others the new rows
        are added, merged with as many of the last pieces as are due."""
        after, old, levels = dict(now), [], {}
        for b in (str(b) for b in touched):
            pieces = now.get(b, [])
            n, level = (len(pieces), pieces[0][1]) if int(b) in hit else merged([x for _, x in pieces]) if new is not None else (0, 0)
            old += [p for p, _ in pieces[len(pieces) - n :]]
            after[b], levels[b] = pieces[: len(pieces) - n], level
        if new is None and not old:
            return dict(now)
        rows = self._pieces(name, old)
        if hit:
            rows = rows.join(lost, keys, "left_anti")
        if new is not None:
            rows = rows.unionByName(new.select(*rows.columns))
        for b, at in self._write(name, rows, version).items():
            after[b] = [*after.get(b, []), (at, levels.get(b, 0))]
        return {b: x for b, x in after.items() if x}

    def _write(self, name: str, rows: DataFrame, version: int) -> dict[str, str]:
        at = f"{name}/v{version}-{uuid.uuid4().hex[:8]}"
        self._put(name, rows, at, ["_bucket"])
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at(at))]
        return {n.removeprefix("_bucket="): f"{at}/{n}" for n in names if n.startswith("_bucket=")}

    def _put(self, name: str, rows: DataFrame, at: str, parts: list[str]) -> None:
        """Writes rows below `at`, sorted by key, in folders of `parts`."""
        writer = W.sorted_for_write(rows.withColumn("_bucket", self._bucket(name)), [*parts, *self.registry.keys(name)]).write
        for c in self.registry.stored(name):
            if c.access in ("index", "dictionary"):
                writer = writer.option(f"parquet.bloom.filter.enabled#{c.name}", "true")
        writer.partitionBy(*parts).parquet(f"{self.path}/{at}")

    def _births(self, name: str, column: str, rows: DataFrame | None, manifest: dict, version: int, clean: bool) -> list:
        """The pieces of a dictionary after a commit: new values are added as a piece; where rows went, it is written anew without the values nobody holds."""
        pieces = manifest["dictionaries"].get(f"{name}.{column}", [])
        known = self.dictionary(name, column, manifest)
        keys = self.registry.keys(name)
        if known is None:
            found, kept, level = W.births(self.table(name, manifest), column, keys), [], 0
        elif clean:
            found = W.collected(known if rows is None else W.births(rows, column, keys, known), column, self.table(name, manifest))
            kept, level = [], pieces[0][1]
        elif rows is None:
            return pieces
        else:
            found = W.born(rows, column, keys, known)
            n, level = merged([x for _, x in pieces])
            kept = pieces[: len(pieces) - n]
            if n:
                found = self.spark.read.parquet(*[f"{self.path}/{p}" for p, _ in pieces[len(pieces) - n :]]).unionByName(found)
        at = f"{name}.{column}/v{version}-{uuid.uuid4().hex[:8]}"
        found.write.parquet(f"{self.path}/{at}")
        return [*kept, (at, level)]
