"""Models to plug in, the service."""

import json

import pytest
from pyspark.sql import functions as F

from trovelle import service as V
from trovelle.operators import models as M
from trovelle.operators.answers import extractive
from trovelle.operators.chunking import ChunkConfig
from trovelle.plans.pipeline import AskConfig

PROSE = "Patients who took pelomide every morning slept better and walked further than those who did not take it at all during the year. "


def test_registry_falls_back_in_order():
    r = M.Registry()
    assert r.get() == ("extractive", extractive)
    r.register("openai", lambda: None)
    r.register("Ollama", lambda: "local")
    assert r.get("openai") == ("ollama", "local") and r.get("auto") == ("ollama", "local")
    r.register("gemini", lambda: "far")
    assert r.get("nothing") == ("gemini", "far") and r.get("ollama") == ("ollama", "local")


def test_prompts_and_scores(spark):
    df = spark.createDataFrame([("q", "c", "a", None, 0.5)], "q string, c string, a string, x double, y double")
    r = df.select(M.context_relevance_prompt(F.col("q"), F.col("c")), M.answer_relevance_prompt(F.col("q"), F.col("a")), M.faithfulness_prompt(F.col("c"), F.col("a")), *M.score_columns("x", "y")).first()
    assert "q" in r[0] and "a" in r[1] and "c" in r[2] and (r.x, r.y) == (0.0, 0.5)


def test_files_to_answers(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "sleep_study.txt").write_text(PROSE * 4)
    (raw / "label.json").write_text(json.dumps({"label": {"openfda": {"generic_name": ["ravotide"]}, "warnings": ["Ravotide must not be given to adults with severe gout because urate levels rise quickly in them after each single dose of it. " * 3]}}))
    V.build(spark, str(raw), str(tmp_path / "ix"), ChunkConfig(60, 10, 5))
    s = V.Service(spark, str(tmp_path / "ix"))
    assert s.health()["n_documents"] == 2
    r = s.query("Who must not take ravotide with gout?", AskConfig("bm25")).first()
    assert r.grounded and "urate" in r.answer
    assert s.retrieve("pelomide sleep", AskConfig("hybrid", False)).first().document_id == "sleep_study"
    n, page = s.documents("drug_label")
    assert n == 1 and page.first().document_id == "fda_ravotide"
    assert s.document("sleep_study").count() >= 1
    with pytest.raises(V.NotFound):
        s.document("none")
    with pytest.raises(V.BadRequest):
        s.query("a")
