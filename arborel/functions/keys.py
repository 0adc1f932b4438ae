"""Key algebra: next, nth, rollback, parent, child range, text form, and key ranges that reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

Key = tuple


def next_index(key: Key) -> Key:
    return (*key[:-1], key[-1] + 1)


def nth_index(key: Key, n: int) -> Key:
    return (*key[:-1], key[-1] + n)


def rollback_or_init(key: Key, n: int) -> Key:
    """A root goes back n, to 0 at least; below it the parent goes back and the index starts at 0."""
    return (max(0, key[0] - n), *(0 for _ in key[1:]))


def parent(key: Key) -> Key:
    if len(key) < 2:
        raise ValueError("a root key has no parent")
    return key[:-1]


def from_parent(key: Key, index: int = 0) -> Key:
    return (*key, index)


def child_range(key: Key) -> tuple[Key, Key]:
    """Half-open range of all children of a key."""
    return (*key, 0), (*next_index(key), 0)


def depth(key: Key) -> int:
    return len(key) - 1


def total_index(key: Key, width: int = 3) -> int:
    return reduce(lambda total, index: total * width + index, key)


def text(key: Key) -> str:
    return "-".join(map(str, key))


class KeyFormatError(ValueError):
    """A key's text has the wrong number of parts."""


class KeyNumberError(ValueError):
    """A part of a key's text is no whole number."""


def parse(value: str, parts: int) -> Key:
    found = value.split("-")
    if len(found) != parts:
        raise KeyFormatError(f"{value!r} has {len(found)} parts, not {parts}")
    for p in found:
        if not p.isascii() or not p.isdigit():
            raise KeyNumberError(f"{p!r} in {value!r} is no whole number")
    return tuple(map(int, found))


def text_column(columns: list[str]) -> Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in columns])


def parse_column(value: Column, parts: int) -> Column:
    """array<bigint>; raises on a wrong number of parts or a part that is no number."""
    split = F.split(value, "-")
    numbers = F.transform(split, lambda p: F.when(p.rlike("^[0-9]+$"), p.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("no whole number in key "), value)).cast("bigint")))
    return F.when(F.size(split) == parts, numbers).otherwise(F.raise_error(F.concat(F.lit("wrong number of parts in key "), value)).cast("array<bigint>"))


def equals(columns: list[str], key: Key) -> Column:
    """Equality with a key, or with its first parts."""
    return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(columns, key)], F.lit(True) if not key else F.col(columns[0]) == key[0])


def at_least(columns: list[str], key: Key) -> Column:
    """columns >= key from the root down. A comparison of structs would not reach the scan; the bound on the first column does."""
    exact = F.col(columns[-1]) >= key[-1]
    for c, v in list(zip(columns, key))[-2::-1]:
        exact = (F.col(c) > v) | ((F.col(c) == v) & exact)
    return exact if len(key) == 1 else (F.col(columns[0]) >= key[0]) & exact


def below(columns: list[str], key: Key) -> Column:
    exact = F.col(columns[-1]) < key[-1]
    for c, v in list(zip(columns, key))[-2::-1]:
        exact = (F.col(c) < v) | ((F.col(c) == v) & exact)
    return exact if len(key) == 1 else (F.col(columns[0]) <= key[0]) & exact


def between(columns: list[str], start: Key, until: Key) -> Column:
    """Half-open range [start, until)."""
    return at_least(columns, start) & below(columns, until)
