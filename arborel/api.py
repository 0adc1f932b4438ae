"""Routes of the reads and writes, without a server: method and path to a status and lines of JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import parse_qs, unquote, urlsplit

from .functions import filters, keys as K
from .operators.compose import Catalog, NotFound
from .operators.read import Reader, TooMany, lines
from .operators.stats import table_info
from .schema import SchemaError, snake, spark_type


class Api:
    """writes: (entity, key or body) handlers of a store, for POST and DELETE; without them the routes are read-only."""

    def __init__(self, catalog: Catalog, persist=None, remove=None):
        self.catalog, self.persist, self.remove = catalog, persist, remove
        self.names = {snake(e): e for e in catalog.registry.entities}

    def handle(self, method: str, url: str, body: str | bytes | None = None) -> tuple[int, Iterator[str]]:
        try:
            return self._route(method, url, body)
        except (NotFound, FileNotFoundError) as e:
            return 404, iter([json.dumps({"error": str(e)})])
        except (ValueError, SchemaError, TooMany) as e:
            return 400, iter([json.dumps({"error": str(e)})])
        except Exception as e:  # noqa: BLE001
            return 500, iter([json.dumps({"error": str(e)})])

    def _value(self, entity: str, column: str, text: str):
        kind = spark_type(self.catalog.registry.column(entity, column).type).typeName()
        return int(text) if kind in ("long", "integer", "short", "byte") else float(text) if kind == "double" else text

    def _found(self, df) -> tuple[int, Iterator[str]]:
        out = list(df.toJSON().take(1))
        return (200, iter(out)) if out else (404, iter(()))

    def _route(self, method: str, url: str, body):
        parts = urlsplit(url)
        path = [unquote(p) for p in parts.path.strip("/").split("/")]
        ask = {k: v[0] for k, v in parse_qs(parts.query).items()}
        if not path or path[0] not in self.names:
            raise NotFound(f"no entity {path[:1]}")
        entity = self.names[path[0]]
        reader, registry = Reader(self.catalog, entity), self.catalog.registry
        key_name, rest = reader.keys[-1], path[1:]
        key = lambda t: K.parse(t, len(reader.keys))
        relations = {r.name: r for r in registry[entity].relations}
        columns = {c.name for c in registry.stored(entity)}
        match (method, rest):
            case ("POST", []):
                if self.persist is None:
                    raise ValueError("read-only")
                return 200, iter([json.dumps(self.persist(entity, json.loads(body)))])
            case ("GET", ["first"]):
                return 200, lines(reader.first())
            case ("GET", ["last"]):
                return 200, lines(reader.last())
            case ("GET", ["take"]):
                return 200, lines(reader.take(int(ask["take"])))
            case ("GET", ["tail"]):
                return 200, lines(reader.tail(int(ask["tail"])))
            case ("GET", ["table_info"]):
                return 200, lines(table_info(self.catalog, entity))
            case ("GET", [name, v]) if name == key_name:
                return self._found(reader.get(key(v)))
            case ("HEAD", [name, v]) if name == key_name:
                return (200 if reader.exists(key(v)) else 404), iter(())
            case ("DELETE", [name, v]) if name == key_name:
                if self.remove is None:
                    raise ValueError("read-only")
                return (200 if self.remove(entity, key(v)) else 404), iter(())
            case ("GET", [name, v, "parent_key"]) if name == key_name:
                return 200, iter([json.dumps(K.text(reader.parent_key(key(v))))])
            case ("POST", [name]) if name == key_name:
                return 200, reader.stream_range(key(ask["from"]), key(ask["until"]), filters.parse(body))
            case ("POST", [name]) if name in columns:
                return 200, reader.stream_range_by(name, self._value(entity, name, ask["from"]), self._value(entity, name, ask["until"]), filters.parse(body))
            case ("POST", [name, v]) if name in columns:
                return 200, reader.stream_by(name, self._value(entity, name, v), filters.parse(body))
            case ("GET", [name, v, k]) if name in columns and k == key_name:
                return 200, reader.stream_keys_by(name, self._value(entity, name, v))
            case ("POST", [name, v, up]) if name in columns and self.names.get(up) == registry.parent(entity):
                return 200, reader.stream_parents_by(name, self._value(entity, name, v), filters.parse(body))
            case ("GET", [v, child]) if child in relations:
                df = reader.child(key(v), child)
                return (200, lines(df)) if relations[child].kind == "many" else self._found(df)
        raise NotFound(f"no route {method} {url}")
