"""Queries of nested records: bridge rows, stored objects and flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelle.operators import nested
from trovelle.plans import sqlparts as S

# The fields of each kind of object in the payloads.
COLUMNS = {
    "blocks": {"page": "$.page", "section": "$.section", "text": "$.text"},
    "tables": {"caption": "$.caption"},
    "rows": {"label": "$.label", "value": "$.value"},
    "notes": {"mark": "$.mark", "text": "$.text"},
    "trials": {"trial_id": "$.trial_id"},
    "arms": {"label": "$.label", "n": "$.n"},
    "outcomes": {"name": "$.name", "value": "$.value", "ci_low": "$.ci.low", "ci_high": "$.ci.high"},
    "authors": {"surname": "$.surname", "given": "$.given"},
    "affiliations": {"name": "$.name"},
    "identifiers": {"scheme": "$.scheme", "value": "$.value"},
}

# The fields of the record itself.
RECORD = ["document_id", "title", "source_type"]


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return nested.latest_rows(spark.read.parquet(f"{sf}/raw_documents.parquet"), "record_id", "received_at", "payload")


def _source(spark: SparkSession, sf: str) -> DataFrame:
    held = nested.source_payload(spark.read.parquet(f"{sf}/source_documents.parquet"))
    return nested.latest_rows(held, "document_id", "ingested_at", "payload")


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return nested.bridge(_raw(spark, sf), "key", "payload")


def _source_rows(spark: SparkSession, sf: str) -> DataFrame:
    return nested.bridge(_source(spark, sf), "key", "payload")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).select(F.col("key").cast("long").alias("record_id"), "node_path", "parent_path")


def p5_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of raw_documents and of source_documents, each different one once."""
    return nested.objects(_rows(spark, sf).union(_source_rows(spark, sf)))


def p5_source(spark: SparkSession, sf: str) -> DataFrame:
    return _source_rows(spark, sf).select(F.col("key").alias("document_id"), "field", "occurrence", "parent_occurrence", "node_path", "parent_path", "ordinal", "depth", "node_hash", "parent_hash")


_TABLES: dict[tuple[str, str, str], nested.Shredded] = {}


def _shredded(spark: SparkSession, sf: str, which: str) -> nested.Shredded:
    """Bridge and objects of a folder's raw or source documents: made by the first flat table of a session, read by all."""
    key = (spark.sparkContext.applicationId, sf, which)
    if key not in _TABLES:
        _TABLES[key] = nested.Shredded((_raw if which == "raw" else _source)(spark, sf), "key", "payload")
    return _TABLES[key]


def _flat(field: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _shredded(spark, sf, "raw").flat_table(field, COLUMNS[field])
        return rows.select(F.col("key").cast("long").alias("record_id"), "node_path", "parent_path", "ordinal", *COLUMNS[field])

    return run


def _source_flat(field: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _shredded(spark, sf, "source").flat_table(field, COLUMNS[field])
        return rows.select(F.col("key").alias("document_id"), "node_path", "parent_path", "ordinal", *COLUMNS[field])

    return run


def p5_unread(spark: SparkSession, sf: str) -> DataFrame:
    return nested.unread(_raw(spark, sf), "key", "payload").select(F.col("key").cast("long").alias("record_id"), "reason")


def p5_records(spark: SparkSession, sf: str) -> DataFrame:
    return nested.records(_raw(spark, sf), "key", "payload", RECORD).withColumn("record_id", F.col("key").cast("long")).drop("key")


def p5_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every single value of the records, with its path and the object around it."""
    return nested.values(_raw(spark, sf), "key", "payload").withColumn("record_id", F.col("key").cast("long")).drop("key")


def p5_source_values(spark: SparkSession, sf: str) -> DataFrame:
    return nested.values(_source(spark, sf), "key", "payload").withColumnRenamed("key", "document_id")


def _of_extra(values: DataFrame, key: str) -> DataFrame:
    """The values in `extra` outside listed objects: `key` is the entry of extra, deeper places are in `path`. An extra that is null or empty has no rows; one that is a plain value has no key."""
    own = values.where((F.get("fields", F.lit(0)) == "extra") & (F.col("parent_path") == "$"))
    own = own.where((F.size("fields") > 1) | F.col("type").isin("string", "number", "boolean") | (F.col("path") != "$.extra"))
    return own.select(key, F.get("fields", F.lit(1)).alias("key"), "ordinal", "value", "path", "parent_path", "type")


def p5_extra(spark: SparkSession, sf: str) -> DataFrame:
    return _of_extra(p5_values(spark, sf), "record_id")


def p5_source_extra(spark: SparkSession, sf: str) -> DataFrame:
    return _of_extra(p5_source_values(spark, sf), "document_id")


def queries() -> dict:
    whole = {"p5_found": p5_found, "p5_objects": p5_objects, "p5_source": p5_source, "p5_records": p5_records, "p5_values": p5_values, "p5_extra": p5_extra, "p5_unread": p5_unread}
    source = {"p5_source_values": p5_source_values, "p5_source_extra": p5_source_extra} | {f"p5_source_{f}": _source_flat(f) for f in COLUMNS}
    return whole | {f"p5_{f}": _flat(f) for f in COLUMNS} | source


_NAMES = "|".join(nested.NODE_FIELDS)
_LONE = "fullkey"
for _ in range(2):  # twice, for lone objects that follow one another
    _LONE = f"regexp_replace({_LONE}, '\\.({_NAMES})(\\.|$)', '.\\1[0]\\2', 'g')"
#: Payloads as they are, and those whose extra is a text with the JSON in its place.
P5 = f"""WITH r AS (SELECT record_id, payload FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY received_at DESC NULLS LAST, payload DESC) AS rn FROM raw_documents) WHERE rn = 1 AND json_valid(payload)),
t AS (SELECT record_id, '' AS pre, payload AS body FROM r UNION ALL SELECT record_id, '.extra', payload ->> '$.extra' FROM r WHERE json_type(payload, '$.extra') = 'VARCHAR' AND json_valid(payload ->> '$.extra')),
k AS (SELECT record_id, '$' || pre || substr(e.fullkey, 2) AS fullkey, e.value AS v FROM t, json_tree(t.body) e WHERE e.type = 'OBJECT'),
n AS (SELECT record_id, {_LONE} AS node_path, v FROM k)
"""
_PARENT = f"CASE WHEN regexp_matches(node_path, '^.*\\.({_NAMES})\\[[0-9]+\\].*\\.({_NAMES})\\[[0-9]+\\]$') THEN regexp_extract(node_path, '^(.*\\.({_NAMES})\\[[0-9]+\\]).*\\.({_NAMES})\\[[0-9]+\\]$', 1) ELSE '$' END"
P5_FOUND = f"{P5}SELECT record_id, node_path, {_PARENT} AS parent_path FROM n WHERE regexp_matches(node_path, '\\.({_NAMES})\\[[0-9]+\\]$')"


def _member(path: str) -> str:
    """A member of v as text; objects with their keys in order, as they are stored."""
    members = f"list_transform(list_sort(json_keys(v, '{path}')), lambda k: to_json(k) || ':' || json_extract(v, '{path}.\"' || k || '\"'))"
    return f"CASE WHEN json_type(v, '{path}') = 'OBJECT' THEN '{{' || array_to_string({members}, ',') || '}}' ELSE v ->> '{path}' END"


def _flat_sql(field: str) -> str:
    own = ", ".join(f"{_member(path)} AS {name}" for name, path in COLUMNS[field].items())
    return f"{P5}SELECT record_id, node_path, {_PARENT} AS parent_path, regexp_extract(node_path, '\\[([0-9]+)\\]$', 1)::BIGINT AS ordinal, {own} FROM n WHERE regexp_matches(node_path, '\\.{field}\\[[0-9]+\\]$')"


_SOURCE_BLOCKS = f"WITH {S.DOCUMENTS} SELECT document_id, '$.blocks[' || (i - 1) || ']' AS node_path, '$' AS parent_path, (i - 1)::BIGINT AS ordinal, blocks[i].page::VARCHAR AS page, blocks[i].section AS section, blocks[i].text AS text FROM (SELECT document_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM d)"
_RECORDS = f"{P5.split('t AS (')[0].rstrip().rstrip(',')} SELECT record_id, {', '.join(f"payload ->> '$.{c}' AS {c}" for c in RECORD)} FROM r WHERE json_type(payload) = 'OBJECT'"


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_FOUND, "p5_source_blocks": _SOURCE_BLOCKS, "p5_records": _RECORDS} | {f"p5_{f}": _flat_sql(f) for f in COLUMNS}
