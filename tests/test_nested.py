"""Nested records as flat tables."""

import json

from pyspark.sql import functions as F

from trovelle.operators import nested as N
from trovelle.plans import nested as plans


def test_paths_parents_and_ordinals():
    value = {
        "blocks": [{"page": 1, "tables": {"rows": [{"a": 1}, None, {"a": 2}]}}, "x", {"page": 2, "blocks": [{"page": 3}]}],
        "extra": json.dumps({"trials": [{"arms": {"outcomes": [{"ci": {"low": 1}}]}}]}),
        "other": {"notes": {"mark": "*"}},
        "authors": "none",
    }
    got = {r[2]: r[3] for r in N.shred(value)}
    assert got == {
        "$.blocks[0]": "$",
        "$.blocks[2]": "$",
        "$.blocks[0].tables[0]": "$.blocks[0]",
        "$.blocks[0].tables[0].rows[0]": "$.blocks[0].tables[0]",
        "$.blocks[0].tables[0].rows[2]": "$.blocks[0].tables[0]",
        "$.blocks[2].blocks[0]": "$.blocks[2]",
        "$.extra.trials[0]": "$",
        "$.extra.trials[0].arms[0]": "$.extra.trials[0]",
        "$.extra.trials[0].arms[0].outcomes[0]": "$.extra.trials[0].arms[0]",
        "$.other.notes[0]": "$",
    }


def test_equal_subtrees_have_equal_hashes_whatever_their_order():
    a = N.shred({"blocks": [{"page": 1, "notes": [{"m": 1, "t": "x"}]}, {"notes": [{"t": "x", "m": 1}], "page": 1}]})
    h = {r[2]: r[7] for r in a}
    assert h["$.blocks[0]"] == h["$.blocks[1]"] and h["$.blocks[0].notes[0]"] == h["$.blocks[1].notes[0]"]
    b = {r[2]: r[7] for r in N.shred({"blocks": [{"page": 1, "notes": [{"m": 2, "t": "x"}]}]})}
    assert b["$.blocks[0]"] != h["$.blocks[0]"]


def test_depth_has_no_limit_of_its_own():
    value: dict = {}
    at = value
    for _ in range(300):
        at["blocks"] = [{"page": 1}]
        at = at["blocks"][0]
    assert len(N.shred(value)) == 300


def test_bad_payloads_nulls_and_clashing_columns(spark):
    rows = [(1, '{"blocks": [{"p": 1}]}', "x", 3), (2, '{"blocks": [', "x", 3), (3, None, "x", 3), (None, '{"notes": {}}', "x", 3), (4, "[1]", "x", 3), (5, '{"notes": {"v": NaN}}', "x", 3), (6, "", "x", 3)]
    df = spark.createDataFrame(rows, "record_id long, payload string, key string, ordinal int")
    got = N.bridge(df, "record_id", "payload").collect()
    assert [(r.key, r.node_path) for r in got] == [("1", "$.blocks[0]")]
    assert N.bridge(df.where("false"), "record_id", "payload").count() == 0


def test_objects_are_stored_once_and_bridges_keep_each_place(spark):
    same = json.dumps({"notes": [{"m": 1}, {"m": 1}]})
    rows = N.bridge(spark.createDataFrame([(1, same), (2, same)], "id long, payload string"), "id", "payload")
    (o,) = N.objects(rows).collect()
    assert o.occurrences == 4 and rows.count() == 4
    flat = N.Shredded(spark.createDataFrame([(1, same), (2, same)], "id long, payload string"), "id", "payload").flat_table("notes", {"m": "$.m"})
    assert [(r.key, r.ordinal, r.m) for r in flat.orderBy("key", "ordinal").collect()] == [("1", 0, "1"), ("1", 1, "1"), ("2", 0, "1"), ("2", 1, "1")]


def test_latest_row_counts(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "old"), (1, "2024-02-01", "new"), (1, None, "zz"), (None, "2024-01-01", "x")], "id long, at string, p string")
    assert [tuple(r) for r in N.latest_rows(df, "id", "at", "p").collect()] == [(1, "new")]


def test_source_documents_open_structured_values(spark):
    schema = "document_id string, ingested_at timestamp, blocks array<struct<page:int,section:string,text:string>>, extra map<string,string>"
    df = spark.createDataFrame([("d", None, [(1, None, 'q"uote')], {"trials": '[{"arms": {"n": 1}}]', "plain": "a \"b\" {"}), ("e", None, None, None)], schema)
    held = N.source_payload(df)
    assert all(json.loads(r.payload) is not None for r in held.collect())
    got = {r.node_path for r in N.bridge(held, "document_id", "payload").where(F.col("key") == "d").collect()}
    assert got == {"$.blocks[0]", "$.extra.trials[0]", "$.extra.trials[0].arms[0]"}


def test_every_value_has_a_row_with_its_parent():
    value = {"title": "t", "blocks": [{"page": 1, "section": {"path": ["a", "b"]}}, None], "extra": json.dumps({"label": {"maker": {"name": "m", "notes": [None, {"mark": "*"}]}, "aliases": []}, "n": 2})}
    got = {r[0]: (r[1], r[2][-1], r[3], r[4], r[5]) for r in N.leaves(value)}
    assert got == {
        "$.title": ("$", "title", 0, "string", "t"),
        "$.blocks[0].page": ("$.blocks[0]", "page", 0, "number", "1"),
        "$.blocks[0].section.path[0]": ("$.blocks[0]", "path", 0, "string", "a"),
        "$.blocks[0].section.path[1]": ("$.blocks[0]", "path", 1, "string", "b"),
        "$.blocks[1]": ("$", "blocks", 1, "null", None),
        "$.extra.label.maker.name": ("$", "name", 0, "string", "m"),
        "$.extra.label.maker.notes[0]": ("$", "notes", 0, "null", None),
        "$.extra.label.maker.notes[1].mark": ("$.extra.label.maker.notes[1]", "mark", 0, "string", "*"),
        "$.extra.label.aliases": ("$", "aliases", 0, "array", "[]"),
        "$.extra.n": ("$", "n", 0, "number", "2"),
    }
    parents = {r[2] for r in N.shred(value)} | {"$"}
    assert {p for p, *_ in got.values()} <= parents


def test_source_documents_and_records_stand_in_flat_tables(spark, tmp_path):
    schema = "document_id string, ingested_at timestamp, blocks array<struct<page:int,section:string,text:string>>, extra map<string,string>"
    source = [("d", None, [(1, "S", "x"), (2, None, "y")], {"page_model": "physical", "trial_ids": '["T1", "T2"]', "trials": '[{"trial_id": "T3"}]'}), ("e", None, None, None)]
    spark.createDataFrame(source, schema).write.parquet(f"{tmp_path}/source_documents.parquet")
    raw = [(1, None, json.dumps({"document_id": "d", "title": "t", "source_type": "other", "blocks": [{"page": 1, "section": "S", "text": "x"}], "extra": {"page_model": "synthetic", "label": {"maker": {"name": "m"}}}})), (2, None, "{"), (3, None, "{}")]
    spark.createDataFrame(raw, "record_id long, received_at timestamp, payload string").write.parquet(f"{tmp_path}/raw_documents.parquet")
    run = lambda name: plans.queries()[name](spark, str(tmp_path))
    assert sorted((r.document_id, r.ordinal, r.page, r.section, r.text, r.parent_path) for r in run("p5_source_blocks").collect()) == [("d", 0, "1", "S", "x", "$"), ("d", 1, "2", None, "y", "$")]
    assert sorted((r.document_id, r.key, r.ordinal, r.value) for r in run("p5_source_extra").collect()) == [("d", "page_model", 0, "physical"), ("d", "trial_ids", 0, "T1"), ("d", "trial_ids", 1, "T2")]
    assert [(r.document_id, r.trial_id) for r in run("p5_source_trials").collect()] == [("d", "T3")]
    assert sorted((r.record_id, r.document_id, r.title, r.source_type) for r in run("p5_records").collect()) == [(1, "d", "t", "other"), (3, None, None, None)]
    assert sorted((r.record_id, r.key, r.path, r.value) for r in run("p5_extra").collect()) == [(1, "label", "$.extra.label.maker.name", "m"), (1, "page_model", "$.extra.page_model", "synthetic")]
    held = {(r.field, json.loads(r.content).get("text")): r.occurrences for r in run("p5_objects").collect()}
    assert held == {("blocks", "x"): 2, ("blocks", "y"): 1, ("trials", None): 1}


def test_equal_paths_have_occurrences_of_their_own(spark):
    payload = json.dumps({"x": [{"rows": [{"a": 1}]}, {"rows": [{"a": 2, "notes": {"m": 1}}]}]})
    rows = N.bridge(spark.createDataFrame([(1, payload)], "id long, payload string"), "id", "payload").collect()
    assert [r.node_path for r in rows].count("$.x.rows[0]") == 2 and len({r.occurrence for r in rows}) == 3
    note = next(r for r in rows if r.field == "notes")
    (parent,) = [r for r in rows if r.occurrence == note.parent_occurrence]
    assert '"a":2' in parent.content and parent.node_hash == note.parent_hash


def test_plain_depth_and_unread_payloads(spark):
    value: list = []
    for _ in range(5000):
        value = [value]
    deep = {"blocks": [{"page": 1, "plain": value}]}
    assert N._resolve(N._list([value], "$", []), []) is not None
    rows = [("a", "{"), ("b", None), ("c", "[1]"), ("d", '{"blocks": []}'), ("e", "[" * 200_000)]
    got = {(r.key, r.reason) for r in N.unread(spark.createDataFrame(rows, "id string, p string"), "id", "p").collect()}
    assert {("a", "no JSON"), ("b", "null"), ("c", "no object")} <= got and "d" not in {k for k, _ in got} and deep
