"""Filters: a tree of one optional operation a column, all of which must hold, and of filters on relations."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, functions as F

from ..schema import Registry

OPERATIONS = ("Eq", "Ne", "Lt", "Le", "Gt", "Ge", "In")


class FilterError(ValueError):
    """A filter names what isn't there, or has the wrong form."""


def operation(column: Column, op: dict) -> Column:
    """{"Eq": v}, {"$eq": v} and so on; exactly one."""
    if not isinstance(op, dict) or len(op) != 1:
        raise FilterError(f"one operation a column is allowed, not {op!r}")
    (name, value), = op.items()
    name = name.removeprefix("$").capitalize()
    if name == "In":
        if not isinstance(value, (list, tuple, set)):
            raise FilterError("In needs a list")
        return column.isin(list(value)) if value else F.lit(False)
    made = {"Eq": column.__eq__, "Ne": column.__ne__, "Lt": column.__lt__, "Le": column.__le__, "Gt": column.__gt__, "Ge": column.__ge__}.get(name)
    if made is None:
        raise FilterError(f"no operation {name}; there are {', '.join(OPERATIONS)}")
    return made(F.lit(value))


def parse(body: str | bytes | dict | None) -> dict | None:
    """A request's body: empty gives no filter, which differs from an empty filter."""
    if body is None or isinstance(body, dict):
        return body
    if not body.strip():
        return None
    try:
        found = json.loads(body)
    except ValueError as e:
        raise FilterError(f"no JSON: {e}") from None
    if found is not None and not isinstance(found, dict):
        raise FilterError("a filter is an object")
    return found


def check(registry: Registry, entity: str, query: dict | None) -> None:
    """Keys, transients and unknown names can't be filtered by."""
    for name, part in (query or {}).items():
        relation = next((r for r in registry[entity].relations if r.name == name), None)
        if relation:
            if part is not None:
                check(registry, relation.child, part)
        elif not any(c.name == name for c in registry.stored(entity)):
            raise FilterError(f"{entity} has no column or relation {name} to filter by")


def own(registry: Registry, entity: str, query: dict | None) -> Column | None:
    """The conjunction of the operations on the entity's own columns."""
    found = [operation(F.col(c.name), query[c.name]) for c in registry.stored(entity) if query and query.get(c.name) is not None]
    return reduce(lambda a, b: a & b, found) if found else None
