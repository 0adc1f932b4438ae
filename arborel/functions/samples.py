"""Deterministic sample trees of a registry, as plain Python values, and an evaluator of filters over them that shares nothing with the planner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from ..schema import Registry
from . import keys as K

#: Children of each to-many relation.
CHILDREN = 3
WIDTHS = {"u8": (0, 8), "i8": (1, 8), "u16": (0, 16), "i16": (1, 16), "u32": (0, 32), "i32": (1, 32), "u64": (0, 64), "i64": (1, 64), "long": (1, 64), "int": (1, 32), "duration": (0, 63)}


def next_bytes(value: bytes) -> bytes:
    """Increment of a little-endian number, wrapping around."""
    n = (int.from_bytes(value, "little") + 1) % (1 << 8 * len(value)) if value else 0
    return n.to_bytes(len(value), "little")


def default(kind: str):
    if kind.startswith("bytes["):
        return bytes(int(kind[6:-1]))
    return {"string": "a", "bytes": b"a", "bool": False, "uuid": "00000000-0000-0000-0000-000000000000", "double": 0.0}.get(kind, 0)


def next_value(kind: str, value):
    """The value after one of a type: numbers wrap around, booleans toggle, texts and bytes advance their last sign."""
    if kind in WIDTHS:
        signed, bits = WIDTHS[kind]
        low = -(1 << bits - 1) if signed else 0
        return (value + 1 - low) % (1 << bits) + low
    if kind == "bool":
        return not value
    if kind == "string":
        return value[:-1] + chr(ord(value[-1]) + 1) if value else "a"
    if kind == "bytes":
        return value[:-1] + bytes([(value[-1] + 1) % 256]) if value else b"a"
    if kind.startswith("bytes["):
        return next_bytes(value)
    if kind == "uuid":
        h = f"{(int(value.replace('-', ''), 16) + 1) % (1 << 128):032x}"
        return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
    return value + 1


def advanced(kind: str, times: int):
    value = default(kind)
    for _ in range(times % 1000):
        value = next_value(kind, value)
    return value


def sample(registry: Registry, entity: str, key: tuple) -> dict:
    """The tree at a key: scalars are the type's default advanced by the key's total index, to-many relations have three children, all others one."""
    e, names = registry[entity], registry.keys(entity)
    out = dict(zip(names, key))
    for c in registry.stored(entity):
        out[c.name] = key[0] if c.pointer else advanced(c.type, K.total_index(key))
    for r in e.relations:
        if r.kind == "many":
            out[r.name] = [sample(registry, r.child, (*key, i)) for i in range(CHILDREN)]
        else:
            out[r.name] = sample(registry, r.child, key)
    return out


def sample_many(registry: Registry, entity: str, n: int, start: tuple | None = None) -> list[dict]:
    key = start or tuple(0 for _ in registry.keys(entity))
    out = []
    for _ in range(n):
        out.append(sample(registry, entity, key))
        key = K.next_index(key)
    return out


def holds(op: dict, value) -> bool:
    (name, want), = op.items()
    name = name.removeprefix("$").lower()
    return {"eq": lambda: value == want, "ne": lambda: value != want, "lt": lambda: value < want, "le": lambda: value <= want, "gt": lambda: value > want, "ge": lambda: value >= want, "in": lambda: value in want}[name]()


def with_query(registry: Registry, entity: str, tree: dict, query: dict | None) -> dict | None:
    """The tree as the filter leaves it, or None."""
    if query is None:
        return tree
    out = dict(tree)
    for c in registry.stored(entity):
        if query.get(c.name) is not None and not holds(query[c.name], tree[c.name]):
            return None
    for r in registry[entity].relations:
        part = query.get(r.name)
        if r.kind == "many":
            out[r.name] = [x for t in tree[r.name] if (x := with_query(registry, r.child, t, part)) is not None]
            if not out[r.name]:
                return None
        elif tree[r.name] is None:
            if part is not None or r.kind == "one":
                return None
        else:
            out[r.name] = with_query(registry, r.child, tree[r.name], part)
            if out[r.name] is None:
                return None
    return out


def flattened(registry: Registry, entity: str, trees: list[dict], into: dict | None = None) -> dict[str, list[tuple]]:
    """Rows of each entity's table."""
    into = {} if into is None else into
    names = registry.keys(entity) + [c.name for c in registry.stored(entity)]
    for t in trees:
        into.setdefault(entity, []).append(tuple(t[n] for n in names))
        for r in registry[entity].relations:
            flattened(registry, r.child, t[r.name] if r.kind == "many" else [t[r.name]] if t[r.name] else [], into)
    return into


def frames(spark: SparkSession, registry: Registry, entity: str, trees: list[dict]) -> dict[str, DataFrame]:
    rows = flattened(registry, entity, trees)
    return {name: spark.createDataFrame(rows.get(name, []), T.StructType([T.StructField(f.name, f.dataType) for f in registry.struct(name)])) for name in registry.descendants(entity)}


