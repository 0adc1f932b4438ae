"""Entities: keys, columns, relations, and the rules that a set of them must keep."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

TYPES: dict[str, T.DataType] = {
    "u8": T.ShortType(), "i8": T.ByteType(), "u16": T.IntegerType(), "i16": T.ShortType(), "u32": T.LongType(), "i32": T.IntegerType(),
    "u64": T.DecimalType(20, 0), "i64": T.LongType(), "long": T.LongType(), "int": T.IntegerType(), "u128": T.BinaryType(), "i128": T.BinaryType(),
    "string": T.StringType(), "bytes": T.BinaryType(), "bool": T.BooleanType(), "uuid": T.StringType(), "duration": T.LongType(),
    "double": T.DoubleType(), "timestamp": T.TimestampType(),
}


class SchemaError(ValueError):
    """A declaration breaks a rule."""


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def spark_type(name: str | T.DataType) -> T.DataType:
    if isinstance(name, T.DataType):
        return name
    if m := re.fullmatch(r"bytes\[(\d+)\]", name):  # fixed length; checked on write
        return T.BinaryType()
    if name not in TYPES:
        raise SchemaError(f"unknown type {name}")
    return TYPES[name]


@dataclass(frozen=True)
class RootKey:
    column: str
    type: str = "i64"


@dataclass(frozen=True)
class PointerKey:
    """The parent's key and an index below it. kind: how the parent holds it: many, one or optional (then there is no index)."""

    parent: str
    index: str | None = None
    type: str = "u16"
    kind: str = "many"


OPTIONS = {"index", "range", "dictionary", "pointer", "transient", "used", "shards", "db_cache", "lru_cache"}


@dataclass(frozen=True)
class Column:
    """access: plain, index, range or dictionary. pointer: the entity whose key the value is (then columns names the key's parts)."""

    name: str
    type: str | T.DataType = "i64"
    access: str = "plain"
    pointer: str | None = None
    transient: bool = False
    used: bool = False
    shards: int = 1
    default: object = None

    def __post_init__(self):
        if self.access not in ("plain", "index", "range", "dictionary"):
            raise SchemaError(f"unknown access {self.access} of column {self.name}")
        if self.shards < 1:
            raise SchemaError("shards == 0 is not supported")
        if isinstance(spark_type(self.type), T.StructType) and self.access != "plain":
            raise SchemaError(f"struct column {self.name} can't be an index or dictionary")

    @staticmethod
    def of(name: str, type_: str, **options) -> "Column":
        """From option names; unknown ones are an error."""
        if unknown := set(options) - OPTIONS:
            raise SchemaError(f"unknown options {sorted(unknown)} of column {name}")
        access = [a for a in ("range", "index", "dictionary") if options.get(a)]
        return Column(name, type_, access[0] if access else "plain", options.get("pointer"), bool(options.get("transient")), bool(options.get("used")), options.get("shards", 1))


@dataclass(frozen=True)
class Relation:
    name: str
    child: str
    kind: str = "many"


@dataclass(frozen=True)
class Reference:
    """A relation that isn't stored. read_from: (relation, pointer column): each element of the relation is looked up by the pointer."""

    name: str
    target: str
    read_from: tuple[str, str] | None = None


@dataclass(frozen=True)
class Hook:
    """Child rows of `relation` made on write from the transient `refs`, resolved against the just-written column `using`."""

    relation: str
    refs: str
    using: str


@dataclass(frozen=True)
class Entity:
    name: str
    key: RootKey | PointerKey | None
    columns: tuple[Column, ...] = ()
    relations: tuple[Relation, ...] = ()
    references: tuple[Reference, ...] = ()
    hook: Hook | None = None


@dataclass
class Registry:
    entities: dict[str, Entity] = field(default_factory=dict)

    @staticmethod
    def of(*entities: Entity) -> "Registry":
        found = Registry()
        for e in entities:
            if e.name in found.entities:
                raise SchemaError(f"{e.name} is declared twice")
            found.entities[e.name] = e
        found.check()
        return found

    def __getitem__(self, name: str) -> Entity:
        if name not in self.entities:
            raise SchemaError(f"no entity {name}")
        return self.entities[name]

    def keys(self, name: str) -> list[str]:
        """Key columns, root first."""
        key = self[name].key
        if isinstance(key, RootKey):
            return [key.column]
        return self.keys(key.parent) + ([key.index] if key.kind == "many" else [])

    def parent(self, name: str) -> str | None:
        key = self[name].key
        return key.parent if isinstance(key, PointerKey) else None

    def root(self, name: str) -> str:
        while parent := self.parent(name):
            name = parent
        return name

    def depth(self, name: str) -> int:
        return 0 if self.parent(name) is None else 1 + self.depth(self.parent(name))

    def stored(self, name: str) -> list[Column]:
        return [c for c in self[name].columns if not c.transient]

    def column(self, name: str, column: str) -> Column:
        for c in self[name].columns:
            if c.name == column:
                return c
        raise SchemaError(f"{name} has no column {column}")

    def descendants(self, name: str) -> list[str]:
        """The entity and all below it, children before parents."""
        return [d for r in self[name].relations for d in self.descendants(r.child)] + [name]

    def struct(self, name: str) -> T.StructType:
        fields, key = [], self[name].key
        if isinstance(key, RootKey):
            fields.append(T.StructField(key.column, spark_type(key.type)))
        else:
            above = self.struct(key.parent)
            fields += [above[k] for k in self.keys(key.parent)]
            if key.kind == "many":
                fields.append(T.StructField(key.index, spark_type(key.type)))
        return T.StructType(fields + [T.StructField(c.name, spark_type(c.type)) for c in self.stored(name)])

    def check(self) -> None:
        for e in self.entities.values():
            self._check(e)

    def _check(self, e: Entity) -> None:
        if e.key is None:
            raise SchemaError(f"{e.name}: a key is required, a root key or a pointer key")
        if isinstance(e.key, (list, tuple)):
            raise SchemaError(f"{e.name}: only one key is allowed")
        names = [c.name for c in e.columns] + [r.name for r in e.relations] + [r.name for r in e.references]
        if any(not n for n in names):
            raise SchemaError(f"{e.name}: only named columns are supported")
        if len(set(names)) < len(names):
            raise SchemaError(f"{e.name}: a name is used twice")
        if isinstance(e.key, PointerKey):
            if e.key.kind not in ("many", "one", "optional"):
                raise SchemaError(f"{e.name}: a pointer key is held by its parent as many, one or optional")
            if e.key.kind == "many" and not e.key.index:
                raise SchemaError(f"{e.name}: a child of a to-many relation needs an index")
            if not any(r.child == e.name for r in self[e.key.parent].relations):
                raise SchemaError(f"{e.name}: its parent {e.key.parent} has no relation to it")
        for r in e.relations:
            child = self[r.child]
            if not isinstance(child.key, PointerKey) or child.key.parent != e.name or child.key.kind != r.kind:
                raise SchemaError(f"{e.name}.{r.name}: {r.child} must have a pointer key below {e.name}, held as {r.kind}")
            if r.kind == "many" and r.name != snake(r.child) + "s":
                raise SchemaError(f"{e.name}.{r.name}: a to-many relation is named like its child in snake case with an s: {snake(r.child)}s")
        for r in e.references:
            self[r.target]
            if r.read_from:
                relation, pointer = r.read_from
                outer = next((x for x in e.relations if x.name == relation), None)
                if outer is None:
                    raise SchemaError(f"{e.name}.{r.name}: no relation {relation} to read from")
                if self.column(outer.child, pointer).pointer != r.target:
                    raise SchemaError(f"{e.name}.{r.name}: {outer.child}.{pointer} doesn't point to {r.target}")
        if e.hook:
            for needed, among in ((e.hook.relation, [r.name for r in e.relations]), (e.hook.refs, [r.name for r in e.references] + [c.name for c in e.columns if c.transient]), (e.hook.using, [c.name for c in e.columns] + [r.name for r in e.relations])):
                if needed not in among:
                    raise SchemaError(f"{e.name}: the hook needs {needed}, which isn't there")

    def write_order(self, name: str) -> list[str]:
        """Entities in the order of writing: children first, a hook's relation after what it uses, the root last."""
        order = self.descendants(name)
        for d in list(order):
            if hook := self[d].hook:
                child = next(r.child for r in self[d].relations if r.name == hook.relation)
                order.remove(child)
                order.insert(order.index(name), child)
        return order

    def is_header(self, name: str) -> bool:
        """Headers and blocks are known by name and must have the columns of a chain."""
        wanted = {"hash", "prev_hash", "timestamp"}
        return "Header" in name and wanted <= {c.name for c in self[name].columns}
