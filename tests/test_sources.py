"""Loaders, the index on disk, the embedding cache, streams."""

import json

import pytest
from pyspark.sql import functions as F

from trovelle.operators import index
from trovelle.operators.chunking import ChunkConfig
from trovelle.sources import loaders as L
from trovelle.sources import store
from trovelle.streaming import rolling

PROSE = "Patients who took the tablet every morning slept better and walked further than those who did not take it at all during the year. "

ARTICLE = f"""<article><front><journal-meta><journal-title-group><journal-title>Journal of Sleep</journal-title></journal-title-group></journal-meta>
<article-meta><article-id pub-id-type="pmcid">PMC77</article-id><article-id pub-id-type="doi">10.1/x</article-id><title-group><article-title>Walking and <i>sleep</i></article-title></title-group>
<contrib-group><contrib contrib-type="editor"><name><surname>Other</surname><given-names>Ed</given-names></name></contrib><contrib contrib-type="author"><name><surname>Vance</surname><given-names>Ada</given-names></name></contrib></contrib-group>
<pub-date><year>2021</year></pub-date><abstract><p>{PROSE}</p></abstract></article-meta></front>
<body><sec><title>Methods</title><p>{PROSE}[12]</p><sec><title>Setting</title><p>{PROSE}</p></sec></sec>
<sec><p>{PROSE}</p><sec><title>Methods</title><p>{PROSE}</p><sec><p>{PROSE} ½ ﬁne</p></sec></sec></sec>
<sec><title>Our references</title><p>{PROSE}</p></sec><sec><title>Funding</title><p>{PROSE}</p><sec><title>Inner</title><p>{PROSE}</p></sec></sec><p>{PROSE}</p></body></article>"""


def test_files_become_documents_and_bad_ones_error_rows(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.xml").write_text(ARTICLE)
    (tmp_path / "sub/b.JSON").write_text(json.dumps({"drug": "x", "label": {"openfda": {"generic_name": ["pelomide"], "brand_name": ["Sano"]}, "warnings": [PROSE, PROSE + "[3]"], "description": "short", "effective_time": "20200101"}}))
    (tmp_path / "c.txt").write_text(PROSE * 2)
    (tmp_path / "d.xml").write_text("<article>")
    (tmp_path / "e.md").write_text("tiny")
    (tmp_path / "f.csv").write_text("a,b")
    (tmp_path / "g.pdf").write_bytes(b"%PDF")
    got = {r.document_id: r for r in L.read_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"PMC77", "fda_pelomide", "c"}
    a = got["PMC77"]
    assert a.title == "Walking and sleep" and a.authors == ["Ada Vance"] and a.published == "2021" and a.publisher == "Journal of Sleep"
    assert [b.section for b in a.blocks] == ["Abstract", "Methods", "Methods > Setting", "Body", "Body > Methods", "Body > Methods", "Body"] and "[12]" not in a.blocks[1].text
    assert a.url.endswith("/PMC77/") and a.extra == {"doi": "10.1/x", "pmid": None, "page_model": "synthetic"} and a.source == "a.xml" and "1⁄2 fine" in a.blocks[5].text
    b = got["fda_pelomide"]
    assert b.title.startswith("Pelomide (Sano)") and [x.section for x in b.blocks] == ["Warnings"] and "[3]" in b.blocks[0].text and b.published == "2020"
    assert b.publisher.startswith("U.S. Food") and b.license.startswith("Public domain") and b.url and b.extra["brand_name"] == "Sano" and b.blocks[0].text.count("\n\n") == 1
    assert {r.source for r in L.read_errors(spark, str(tmp_path)).collect()} == {"d.xml", "e.md", "g.pdf"}


def test_pages_lose_running_lines_and_keep_sections(spark):
    pages = [f"Sleep Journal 2024\n{'1. Methods' if i == 1 else ''}\n{PROSE}\n{PROSE}\nfoot line here" for i in range(4)]
    schema = "path string, document_id string, title string, parts array<struct<section:string,text:string>>"
    raw = spark.createDataFrame([("f/x_y.pdf", "x_y", None, [(str(i), p) for i, p in enumerate(pages, 1)]), ("f/z.pdf", "z", "Z", [("1", "short")])], schema)
    row, none = L.page_blocks(raw).orderBy("path").collect()
    assert [b.section for b in row.blocks] == ["Body", "1. Methods", "1. Methods", "1. Methods"] and row.title == "X Y"
    assert [b.page for b in row.blocks] == [1, 2, 3, 4] and all("Sleep Journal" not in b.text for b in row.blocks) and none.blocks is None


def test_json_lines_and_new_records(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": "1"}\n\n{"a": "2"}\n')
    assert L.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a string").count() == 2
    found = spark.createDataFrame([("1", "t"), ("1", "u"), ("2", "t"), (None, "t")], "id string, topic string")
    assert [r.id for r in L.new_records(found, spark.createDataFrame([("2",)], "id string"), "id").collect()] == ["1"]


CHUNKS = [("c0", "d0", "T", "S", 1, "urate in gout", 3, 0), ("c1", "d1", None, None, 2, "", 0, 0)]
SCHEMA = "chunk_id string, document_id string, title string, section string, page int, text string, token_count int, char_start int"


def test_index_round_trip(spark, tmp_path):
    c = spark.createDataFrame(CHUNKS, SCHEMA)
    store.save_index(c, str(tmp_path / "ix"), ChunkConfig(300, 45))
    t = store.load_index(spark, str(tmp_path / "ix"))
    assert t["chunks"].count() == 2 and t["vectors"].count() == 2 and json.loads(t["manifest"].first().config)["target"] == 300
    assert {r.term for r in t["term_stats"].collect()} == {"t", "urate", "gout"} - {"t"}
    with pytest.raises(store.IndexMissing):
        store.load_index(spark, str(tmp_path / "none"))


def test_embedding_cache_embeds_each_text_once(spark, tmp_path):
    calls = []

    def embed(missing):
        calls.append(missing.count())
        return index.hashed_vectors(missing, "cache_key", F.col("text"))

    items = spark.createDataFrame([("a", "gout urate"), ("b", "gout urate"), ("c", "sleep")], "id string, t string")
    for _ in range(2):
        assert store.embed_cached(items, "id", F.col("t"), str(tmp_path / "cache"), "m1", embed).count() == 3
    assert calls == [2, 0]
    store.embed_cached(items, "id", F.col("t"), str(tmp_path / "cache"), "m2", embed)
    assert calls[-1] == 2


def test_hashed_vectors_agree_with_the_sparse_form(spark):
    c = spark.createDataFrame(CHUNKS, SCHEMA)
    dense = {r.chunk_id: r.v for r in index.hashed_vectors(c, "chunk_id", index.contextual_text()).collect()}
    for r in index.hashed_embedding(c, "chunk_id", index.contextual_text()).collect():
        assert dense[r.chunk_id][r.dim_idx] == pytest.approx(r.value)
    assert not any(dense["c1"])


def test_streams(spark, tmp_path):
    spark.createDataFrame([("d", [(1, "A", PROSE * 3)])], "document_id string, blocks array<struct<page:int,section:string,text:string>>").write.parquet(str(tmp_path / "in"))
    q = rolling.chunk_landing(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "document_id string, blocks array<struct<page:int,section:string,text:string>>")
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    ev = spark.createDataFrame([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 2.0), ("b", "2024-01-01 01:10:00", 5.0)], "event_type string, t string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    ev.write.parquet(str(tmp_path / "ev"))
    live = rolling.hourly(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")))
    s = live.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    s.awaitTermination(60)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, rolling.hourly(ev).collect()))


def test_vectors_must_fit(spark):
    items = spark.createDataFrame([("a",), ("b",)], "id string")
    fit = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, v array<double>")
    index.check_vectors(items, fit, "id")
    for bad in (fit.where("id = 'a'"), fit.union(fit), fit.where("id = 'a'").union(spark.createDataFrame([("b", [1.0])], fit.schema))):
        with pytest.raises(ValueError):
            index.check_vectors(items, bad, "id")


def test_keys_must_be_unique(spark):
    from trovelle.operators.corpus import latest, require_unique

    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 9, "n")], "id string, at int, v string")
    with pytest.raises(ValueError):
        require_unique(df, "id")
    one = latest(df, "id", "at", "v")
    require_unique(one, "id")
    assert {(r.id, r.v) for r in one.collect()} == {("a", "y"), ("b", "z")}


def test_reports(spark, tmp_path):
    store.write_report(spark.createDataFrame([("bm25", 0.9)], "arm string, mrr double"), str(tmp_path / "one"))
    newest = store.latest_report(spark, str(tmp_path / "*" / "*.json")).collect()
    assert len(newest) == 1 and newest[0].path.endswith(".json")


def test_schemas_are_read_by_spark(spark):
    from trovelle import schemas

    for name in ("DOCUMENT", "CHUNK", "HIT", "CITATION", "ANSWER", "QUESTION"):
        assert spark.createDataFrame([], getattr(schemas, name)).count() == 0
