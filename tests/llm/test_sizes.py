"""Packing and mixing."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trovelle.llm import mixing as M
from trovelle.llm import packing as K
from trovelle.llm import sizes

needs = pytest.mark.skipif(not os.path.exists(sizes.TOKENIZER), reason="no tokenizer files here")


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=12))
def test_plans_use_every_item_and_overfill_nothing(counts):
    plan = K.plan(counts, 50)
    used: dict = {}
    for items, times in plan:
        assert times >= 1 and sum(s * n for s, n in items.items()) <= 50
        for s, n in items.items():
            used[s] = used.get(s, 0) + n * times
    assert used == counts
    containers, total = sum(t for _, t in plan), sum(s * n for s, n in counts.items())
    assert containers <= 2 * -(-total // 50) + 1


def test_plans_fill_gaps_exactly():
    assert sum(t for _, t in K.plan({30: 10, 20: 10, 25: 4}, 50)) == 12
    assert K.plan({}, 10) == []


@needs
def test_packing(spark):
    r = random.Random(1)
    rows = [(i, "word " * r.randint(1, 30)) for i in range(300)] + [(1000, "word " * 200), (1001, None), (1002, ""), (1003, "same "), (1003, "same "), (None, "x")]
    docs = spark.createDataFrame([(a, b, "z", 5) for a, b in rows], "doc_id long, text string, container_kind string, rank int")
    kinds = spark.createDataFrame([("small", 32), ("large", 100), ("none", 0), (None, 5)], "container_kind string, capacity_tokens int")
    got = K.pack(docs, kinds).collect()
    sized = {r.doc_id: r.n_tokens for r in sizes.token_sizes(docs.where("doc_id is not null"), ["doc_id"], "text").collect()}
    for kind, room in (("small", 32), ("large", 100)):
        own = [g for g in got if g.container_kind == kind]
        held: dict = {}
        pieces: dict = {}
        for g in own:
            pieces.setdefault(g.doc_id, []).append(g)
            if g.container_id is not None:
                held[g.container_id] = held.get(g.container_id, 0) + g.n_tokens
        assert max(held.values()) <= room and sorted(held) == list(range(len(held)))
        assert set(pieces) == {k for k in sized}
        for k, ps in pieces.items():
            assert sum(p.n_tokens for p in ps) == sized[k] and (len(ps) == 1 or sized[k] > room)
            assert sorted(p.token_start for p in ps) == [i * room for i in range(len(ps))]
        assert all(room - held[g.container_id] == g.unused for g in own if g.container_id is not None)
        assert {k for k, ps in pieces.items() if ps[0].container_id is None} == {1001, 1002}
    f = {r.container_kind: r for r in K.fill(K.pack(docs, kinds)).collect()}
    assert set(f) == {"small", "large"} and f["small"].unused_share < 0.05
    assert K.pack(docs.where("false"), kinds).count() == 0 and K.pack(docs, kinds.where("false")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 50)), max_size=40), st.integers(0, 2**30))
def test_pivoting_keeps_the_weighted_sum(items, seed):
    p, size = [x[0] for x in items], [x[1] for x in items]
    before = sum(a * b for a, b in zip(p, size))
    last = K_last = M.pivot(p, size, np.random.default_rng(seed).random(len(p)).tolist())
    assert abs(sum(a * b for a, b in zip(p, size)) - before) < 1e-6
    open_ = [i for i, x in enumerate(p) if 1e-9 < x < 1 - 1e-9]
    assert open_ in ([], [K_last]) and (last >= 0) == bool(open_)


def test_pivoting_keeps_each_chance():
    hits = np.zeros(3)
    for seed in range(4000):
        p = [0.2, 0.5, 0.3]
        M.pivot(p, [4, 9, 2], np.random.default_rng(seed).random(3).tolist())
        hits += p
    assert np.allclose(hits / 4000, [0.2, 0.5, 0.3], atol=0.03)


def test_rates_meet_the_scarcest_source():
    got = M.rates([("m", "a", 0.5, 1), ("m", "b", 0.5, 4), ("m", "gone", 0.2, 1)], {"a": 1000, "b": 100})
    assert got[("m", "b")] == 4 and got[("m", "a")] == pytest.approx(0.4) and ("m", "gone") not in got


@needs
def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, "word " * r.randint(1, 60), r.choice(["A", " a ", "b", "B ", "c", None])) for i in range(900)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, copies int")
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.3, 2), ("m", "c", 0.2, 3), ("n", "a", 0.1, 1), ("n", "c", 0.9, 2)], "mix_name string, source string, target_share double, max_repeats int")
    chosen = M.mix_sources(docs, targets)
    got = {(r.mix_name, r.source): r for r in M.shares(chosen, targets).collect()}
    assert len(got) == 5 and all(abs(x.reached_share - x.target_share) < 0.005 and x.most_copies <= x.max_repeats for x in got.values())
    assert chosen.count() == chosen.select("mix_name", "doc_id").distinct().count()
    again = M.mix_sources(docs.repartition(7), targets)
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))
    assert M.mix_sources(docs.where("false"), targets).count() == 0


@needs
def test_many_buckets_meet_up_the_tree(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 10)
    monkeypatch.setattr(M, "FAN", 4)
    docs = spark.createDataFrame([(i, "word " * (i % 17 + 1), "a" if i % 3 else "b") for i in range(600)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "a", 0.7, 1), ("m", "b", 0.3, 1)], "mix_name string, source string, target_share double, max_repeats int")
    got = {r.source: r for r in M.shares(M.mix_sources(docs, targets), targets).collect()}
    assert abs(got["a"].reached_share - 0.7) < 0.003


@needs
def test_long_texts_are_counted_in_parts():
    enc = sizes.encoder()
    text = "alpha beta, gamma delta " * 15000
    assert sizes.count_tokens(text, enc) == len(enc.encode_ordinary(text))
