"""Problem 5: deeply nested records as related flat tables, by Merkle identities of their subtrees.

Every object in one of the listed fields is a node. Objects are canonicalised and hashed bottom-up: an
object's hash covers its own fields and the hashes of the nodes inside it, so equal subtrees have
equal hashes wherever they stand. An object is stored once by its hash; each of its occurrences is a
bridge row with its record, path, parent and ordinal, numbered within the record (`occurrence`; the parent's
number links to it, 0 being the record itself), for a path alone need not be unique. A flat table of one kind is
the bridge rows of that field joined with the stored objects by their hash.

The walk keeps its own stack, so depth is bounded by memory and not by recursion.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelle.session import release, stored

# The fields whose objects are nodes.
NODE_FIELDS = ["blocks", "tables", "rows", "notes", "trials", "arms", "outcomes", "authors", "affiliations", "identifiers"]

#: Every single value of a record, for what is no field of a listed object.
VALUES = "key string, path string, parent_path string, fields array<string>, ordinal long, type string, value string"

BRIDGE = "key string, occurrence long, parent_occurrence long, node_path string, parent_path string, field string, ordinal long, depth int, node_hash string, parent_hash string, content string"


def _refuse(token: str):
    raise ValueError(token)


def parse(text: str | None):
    """The value of strictly valid JSON (no NaN or Infinity), else None."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class _Ref:
    """Stands for a node inside the object around it."""

    def __init__(self, node: int):
        self.node = node


def shred(value, fields: frozenset[str] = frozenset(NODE_FIELDS), text_fields: frozenset[str] = frozenset(["extra"])) -> list[tuple]:
    """Bridge rows (without key) of one record, parents before children; the record itself is `$`, without a row.

    Array elements that are no objects are counted in ordinals and stay in the content of the object
    around them. A lone object in a listed field has ordinal 0. A text in one of `text_fields` is read as the
    JSON it holds, if it holds any.
    """
    if not isinstance(value, dict):
        return []
    nodes: list[dict] = [{"path": "$", "parent": -1, "field": None, "ordinal": None, "depth": 0, "obj": value, "own": None}]
    at = 0
    while at < len(nodes):  # breadth first over nodes; inside a node, its plain fields
        node = nodes[at]
        node["own"] = own = {}
        work = [(node["obj"], node["path"], own)]
        while work:
            obj, path, out = work.pop()
            for name, v in obj.items():
                here = f"{path}.{name}"
                if name in text_fields and isinstance(v, str):
                    held = parse(v)
                    v = held if isinstance(held, (dict, list)) else v
                if name in fields and isinstance(v, (dict, list)):
                    lone = isinstance(v, dict)
                    kept = []
                    for i, x in enumerate([v] if lone else v):
                        if isinstance(x, dict):
                            kept.append(_Ref(len(nodes)))
                            nodes.append({"path": f"{here}[{i}]", "parent": at, "field": name, "ordinal": i, "depth": node["depth"] + 1, "obj": x, "own": None})
                        else:
                            kept.append(x)
                    out[name] = kept[0] if lone else kept
                elif isinstance(v, dict):
                    out[name] = {}
                    work.append((v, here, out[name]))
                elif isinstance(v, list):
                    out[name] = _list(v, here, work)
                else:
                    out[name] = v
        node["obj"] = None
        at += 1
    for node in reversed(nodes):  # children come after their parents, so this is bottom-up
        node["hash"] = hashlib.sha256(canonical(_resolve(node["own"], nodes)).encode("utf-8", "surrogatepass")).hexdigest()[:32]
    return [
        (i, n["parent"], n["path"], nodes[n["parent"]]["path"], n["field"], n["ordinal"], n["depth"], n["hash"], nodes[n["parent"]]["hash"], canonical(_resolve(n["own"], nodes)))
        for i, n in enumerate(nodes[1:], 1)
    ]


def _list(values: list, path: str, work: list) -> list:
    """A list in a plain field: its objects are looked through at the path of the field. Lists inside lists wait on a stack of their own."""
    out: list = []
    waiting = [(values, out)]
    while waiting:
        own, to = waiting.pop()
        for v in own:
            if isinstance(v, dict):
                to.append({})
                work.append((v, path, to[-1]))
            elif isinstance(v, list):
                to.append([])
                waiting.append((v, to[-1]))
            else:
                to.append(v)
    return out


def _resolve(own, nodes: list[dict]):
    """The object with its nodes replaced by their hashes, in a copy."""
    out: list = [None]
    waiting = [(own, out, 0)]
    while waiting:
        v, to, at = waiting.pop()
        if isinstance(v, _Ref):
            to[at] = "node:" + nodes[v.node]["hash"]
        elif isinstance(v, dict):
            to[at] = dict.fromkeys(v)
            waiting += [(x, to[at], k) for k, x in v.items()]
        elif isinstance(v, list):
            to[at] = [None] * len(v)
            waiting += [(x, to[at], i) for i, x in enumerate(v)]
        else:
            to[at] = v
    return out[0]


def leaves(value, fields: frozenset[str] = frozenset(NODE_FIELDS), text_fields: frozenset[str] = frozenset(["extra"])) -> list[tuple]:
    """(path, parent_path, fields, ordinal, type, value) of every single value of one record.

    `path` is `$`, `.field` for each field passed and `[i]` for each array element; `parent_path` is the node around
    it as shred() names it, else `$`; `fields` are the names passed; `ordinal` is the place in the innermost array, 0
    outside arrays. Strings stand as they are, other values as JSON. An empty object or array is a value, so that
    nothing of a record is without a row.
    """
    if not isinstance(value, dict):
        return []
    out = []
    work = [(value, "$", "$", "$", (), 0, False)]
    while work:
        v, path, at, parent, names, ordinal, listed = work.pop()  # at: the path as nodes are named
        if isinstance(v, dict) and v:
            for name, x in reversed(v.items()):
                if name in text_fields and isinstance(x, str):
                    held = parse(x)
                    x = held if isinstance(held, (dict, list)) else x
                here = f"{at}.{name}"
                if name in fields and isinstance(x, dict):
                    work.append((x, f"{path}.{name}[0]", f"{here}[0]", f"{here}[0]", (*names, name), 0, False))
                else:
                    work.append((x, f"{path}.{name}", here, parent, (*names, name), 0, name in fields))
        elif isinstance(v, list) and v:
            for i, x in reversed(list(enumerate(v))):
                node = listed and isinstance(x, dict)
                own = f"{at}[{i}]" if node else at
                work.append((x, f"{path}[{i}]", own, own if node else parent, names, i, False))
        else:
            kind = "null" if v is None else "boolean" if isinstance(v, bool) else {dict: "object", list: "array", str: "string"}.get(type(v), "number")
            out.append((path, parent, list(names), ordinal, kind, v if kind == "string" else None if v is None else canonical(v)))
    return out


def values(df: DataFrame, key: str, payload: str, fields: list[str] = NODE_FIELDS) -> DataFrame:
    """VALUES rows of the JSON column `payload`, for each row with a key; the same rows as for bridge() have none."""
    listed = frozenset(fields)
    names = [c.split(" ")[0] for c in VALUES.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.string()]

    def walk(batches):
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(k, *r) for r in leaves(parse(text), listed)]
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    pairs = df.select(F.col(key).cast("string").alias("key"), F.col(payload).cast("string").alias("payload")).where("key is not null and payload is not null")
    return pairs.mapInArrow(walk, VALUES)


def records(df: DataFrame, key: str, payload: str, columns: list[str]) -> DataFrame:
    """One row for each payload that is a JSON object: key and the named fields of the record itself, strings as they are, other values as JSON."""
    types = ", ".join(f"`{c}` string" for c in columns)

    def walk(batches):
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = parse(text)
                if isinstance(v, dict):
                    rows.append((k, *(x if x is None or isinstance(x, str) else canonical(x) for x in map(v.get, columns))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["key", *columns])

    pairs = df.select(F.col(key).cast("string").alias("key"), F.col(payload).cast("string").alias("payload")).where("key is not null and payload is not null")
    return pairs.mapInArrow(walk, f"key string, {types}")


def bridge(df: DataFrame, key: str, payload: str, fields: list[str] = NODE_FIELDS) -> DataFrame:
    """BRIDGE rows of the JSON column `payload`, for each row with a key.

    Null keys, null payloads and payloads that are not valid JSON objects give no rows, nor do those nested
    deeper than the JSON reader goes: unread() names them. Rows are not deduplicated: see latest_rows(). Other columns play
    no part, whatever their names.
    """
    listed = frozenset(fields)
    names = [c.split(" ")[0] for c in BRIDGE.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def walk(batches):
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(k, *r) for r in shred(parse(text), listed)]
                except RecursionError:
                    continue
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    pairs = df.select(F.col(key).cast("string").alias("key"), F.col(payload).cast("string").alias("payload")).where("key is not null and payload is not null")
    return pairs.mapInArrow(walk, BRIDGE)


def latest_rows(df: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """(key, payload) of the latest row of each key, the greater payload among equals."""
    when = F.coalesce(F.col(order).cast("timestamp"), F.expr("timestamp'1970-01-01 00:00:00'"))
    one = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.struct(when.alias("t"), F.coalesce(F.col(payload), F.lit("")).alias("p"))).alias("m"))
    return one.select("key", F.col("m.p").alias("payload"))


def unread(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, reason) of the rows that give no bridge rows because of their payload: null, no JSON, no object, too deep."""

    def walk(batches):
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reason = None
                try:
                    value = None if text is None else json.loads(text, parse_constant=_refuse)
                    reason = "null" if text is None else None if isinstance(value, dict) else "no object"
                    if reason is None:
                        shred(value)
                except RecursionError:
                    reason = "too deep"
                except ValueError:
                    reason = "no JSON"
                if reason:
                    rows.append((k, reason))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["key", "reason"])

    return df.select(F.col(key).cast("string").alias("key"), F.col(payload).cast("string").alias("payload")).where("key is not null").mapInArrow(walk, "key string, reason string")


def objects(rows: DataFrame) -> DataFrame:
    """(node_hash, field, content, occurrences): each different object once."""
    return rows.groupBy("node_hash", "field").agg(F.min("content").alias("content"), F.count(F.lit(1)).alias("occurrences"))


class Shredded:
    """The two tables of a JSON column, from one walk over it: `bridge` (BRIDGE without content) and `objects`."""

    def __init__(self, df: DataFrame, key: str, payload: str, fields: list[str] = NODE_FIELDS):
        rows = stored(bridge(df, key, payload, fields))
        self.objects = stored(objects(rows))
        self.bridge = stored(rows.drop("content"))
        release(rows)

    def flat_table(self, field: str, columns: dict[str, str]) -> DataFrame:
        """The flat table of one kind of object: key, occurrence, parent_occurrence, node_path, parent_path, ordinal, node_hash and `columns` (name -> JSON path in the object)."""
        own = self.objects.where(F.col("field") == field).select("node_hash", *(F.get_json_object("content", p).alias(n) for n, p in columns.items()))
        places = self.bridge.where(F.col("field") == field).select("key", "occurrence", "parent_occurrence", "node_path", "parent_path", "ordinal", "node_hash")
        return places.join(own, "node_hash").select(*places.columns, *columns)


def source_payload(documents: DataFrame) -> DataFrame:
    """(document_id, ingested_at, payload): blocks and extra of a source document as JSON; values of extra that are JSON are opened."""
    extra = F.transform(F.map_entries("extra"), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), _opened(e["value"])))
    blocks = F.coalesce(F.to_json("blocks"), F.lit("null"))
    text = F.concat(F.lit('{"blocks":'), blocks, F.lit(',"extra":{'), F.coalesce(F.array_join(extra, ","), F.lit("")), F.lit("}}"))
    return documents.select("document_id", "ingested_at", text.alias("payload"))


def _opened(value) -> Column:
    """A value that is a valid JSON object or array as it stands, else as a JSON text."""
    quoted = F.to_json(F.array(value))
    quoted = F.coalesce(quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit("null"))
    valid = F.ltrim(value).rlike(r"^[\[{]") & F.try_parse_json(value).isNotNull()
    return F.when(valid, value).otherwise(quoted)
