"""Near duplicates and shared spans against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trovelle.functions import npkern as K
from trovelle.llm import neardup as N
from trovelle.llm import spans as S

WORDS = [f"w{i}" for i in range(400)]


def source(df, key, norm, cfg):
    return [N.Source("t", df, key, norm, cfg)]


def pairs(df, key, norm, cfg):
    return {(r.key_a, r.key_b) for r in N.near_pairs(source(df, key, norm, cfg)).collect()}


def texts(seed: int, n: int = 60) -> list[str]:
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) for _ in range(r.randint(20, 60))) for _ in range(n)]
    out = list(base)
    for t in base[: n // 2]:
        w = t.split()
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        out.append(" ".join(w))
    return out


def jaccard_pairs(rows, units, k, least, threshold):
    sets = [(key, {tuple(u[i : i + k]) for i in range(len(u) - k + 1)}) for key, t in rows if len(u := units(t)) >= least]
    return {tuple(sorted((a, b))) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if len(x & y) / len(x | y) >= threshold}


def test_pairs_match_brute_force(spark):
    rows = [(f"k{i:03d}", t) for i, t in enumerate(texts(1))]
    df = spark.createDataFrame(rows, "id string, t string")
    got = pairs(df, "id", N.normal_words(F.col("t")), N.CHUNK)
    assert got == jaccard_pairs(rows, lambda t: re.findall("[a-z0-9]+", t.lower()), 3, 20, 0.6) and got
    five = pairs(df, "id", N.normal_words(F.col("t")), N.FIVE)
    assert five == jaccard_pairs(rows, str.split, 5, 5, 0.8)


def test_titles_match_brute_force(spark):
    rows = [(f"d{i}", t) for i, t in enumerate(["A study of sleep in adults", "A Study  of Sleep in\tadults", "A study of sleep in adult", "Study of asleep adults!", "short", "", None, "Étude du sommeil – adultes", "Étude du sommeil – adulte"])]
    df = spark.createDataFrame(rows, "document_id string, title string")
    got = pairs(df, "document_id", N.normal_title(F.col("title")), N.TITLE)
    clean = [(k, re.sub(r"\s+", " ", (t or "").lower()).strip()) for k, t in rows]
    assert got == jaccard_pairs(clean, list, 3, 10, 0.7) and ("d7", "d8") in got


def test_copies_repeats_nulls_and_clashing_names(spark):
    t = texts(2, 6)
    rows = [("a", t[0], 1, 2), ("a", t[0], 1, 2), ("b", t[0].upper() + "!", 1, 2), ("c", t[0], 1, 2), (None, t[0], 1, 2), ("d", None, 1, 2), ("e", "", 1, 2), ("f", t[1], 1, 2)]
    df = spark.createDataFrame(rows, "key string, norm string, tid int, band int")
    got = pairs(df, "key", N.normal_words(F.col("norm")), N.CHUNK)
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    assert pairs(df.where("false"), "key", N.normal_words(F.col("norm")), N.CHUNK) == set()


def test_many_copies_do_not_multiply_the_bands(spark):
    t = texts(3, 4)
    df = spark.createDataFrame([(f"k{i}", t[0]) for i in range(300)] + [("x", t[1])], "id string, t string")
    cand = N.candidates(N.classes(N.prepare(source(df, "id", N.normal_words(F.col("t")), N.CHUNK))), {"t": N.CHUNK})
    assert cand.count() == 0
    rows = {r.key: r for r in N.near_classes(source(df, "id", N.normal_words(F.col("t")), N.CHUNK)).collect()}
    assert rows["k7"].n_copies == 300 and rows["k7"].n_links == 0 and len({r.class_key for r in rows.values()}) == 2


def test_classes_follow_chains(spark):
    base = texts(4, 2)[0].split()
    chain, w = [], list(base)
    for i in range(12):
        chain.append(" ".join(w))
        w[(i * 3) % len(w)] = f"new{i}"
    df = spark.createDataFrame([(f"k{i:02d}", t) for i, t in enumerate(chain)] + [("z", " ".join(WORDS[:30]))], "id string, t string")
    rows = {r.key: r.class_key for r in N.near_classes(source(df, "id", N.normal_words(F.col("t")), N.CHUNK)).collect()}
    assert {rows[f"k{i:02d}"] for i in range(12)} == {"k00"} and rows["z"] == "z"


def test_signatures_are_minima_of_shifted_ranks():
    cfg = N.NearDupConfig(3, 0.6, 3, 2, 3, seed=5)
    col = pa.array(["a b c d e", "a b", "c " * 9000])
    sig = N.signatures(*N._shingles(col, cfg), cfg)
    ranks = np.random.default_rng(5).permutation(N.UNIVERSE)
    g, n = N._shingles(col, cfg)
    slots = [int((int(x) * 0x2545F491 + 5) % 2**64 % N.UNIVERSE) for x in g[: n[0]]]
    assert sig[0].tolist() == [min(int(ranks[(s + k) % N.UNIVERSE]) for s in slots) for k in range(6)]
    assert set(sig[1].tolist()) == {N.UNIVERSE} and n.tolist() == [3, 0, 8998]


def brute_runs(rows, length):
    units: dict = {}
    split = {(k, r): [w for w in re.split("[ \t\r\n]+", t) if w] for k, r, _, t in rows}
    for k, r, o, _ in rows:
        w = split[k, r]
        for i in range(len(w) - length + 1):
            units.setdefault(tuple(w[i : i + length]), set()).add(o)
    out = set()
    for (k, r), w in split.items():
        cov = [False] * len(w)
        for i in range(len(w) - length + 1):
            if len(units[tuple(w[i : i + length])]) > 1:
                cov[i : i + length] = [True] * length
        for m in re.finditer("1+", "".join("01"[c] for c in cov)):
            out.add((k, r, m.start(), m.end() - 1))
    return out


@pytest.mark.parametrize("seed, length", [(1, 14), (2, 14), (3, 5), (4, 9)])
def test_runs_match_brute_force(spark, seed, length):
    r = random.Random(seed)
    pool = [" ".join(r.choice(WORDS[:60]) for _ in range(length + r.randint(0, 12))) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [r.choice(pool) if r.random() < 0.4 else " ".join(r.choice(WORDS) for _ in range(r.randint(1, 15))) for _ in range(r.randint(0, 6))]
        rows.append(("chunk", f"c{i}", f"d{i % 9}", r.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [("question", f"q{i}", f"question:q{i}", pool[i]) for i in range(3)]
    df = spark.createDataFrame([(k, f, o, 0, t) for k, f, o, t in rows], "kind string, ref string, owner string, rank long, text string")
    found = S.shared_runs(df, length, page_mb=0.002)
    got = {(x.kind, x.ref, x.first_word, x.last_word) for x in found.where("first_word is not null").collect()}
    assert got == brute_runs(rows, length) and got
    shares = {x.ref: x for x in S.shared_shares(found).collect()}
    assert set(shares) == {x[1] for x in rows} and all(0 <= x.share <= 1 for x in shares.values())


def test_runs_of_nulls_repeats_and_owners(spark):
    long = " ".join(WORDS[:20])
    raw = spark.createDataFrame(
        [("c1", "d1", long, None), ("c1", "d1", long, None), ("c2", "d1", long, None), (None, "d2", long, None), ("c3", None, None, None), ("c4", "d4", "", None)], "id string, doc string, t string, digest string"
    )
    recs = S.records(raw, "chunk", "id", "t", "doc")
    assert S.shared_runs(recs).where("first_word is not null").count() == 0
    more = recs.union(S.records(raw.where("id = 'c1'"), "question", "id", "t"))
    got = {(r.kind, r.ref): (r.first_word, r.last_word) for r in S.shared_runs(more).where("first_word is not null").collect()}
    assert got == {("chunk", "c1"): (0, 19), ("chunk", "c2"): (0, 19), ("question", "c1"): (0, 19)}
    assert S.shared_runs(recs.where("false")).count() == 0


def test_repeats_go_and_the_earliest_stays(spark):
    r = random.Random(9)
    pool = ["é " + " ".join(r.choice(WORDS) for _ in range(20)) for _ in range(4)]
    rows = [("chunk", f"c{i}", f"d{i % 5}", 0, " ".join(r.choice([r.choice(pool), " ".join(r.choice(WORDS) for _ in range(6))]) for _ in range(4))) for i in range(25)]
    df = spark.createDataFrame(rows, "kind string, ref string, owner string, rank long, text string")
    got = {x.ref: x for x in S.without_repeats(df, page_mb=0.002).collect()}
    before = {x[1]: x[4] for x in rows}
    assert set(got) == set(before) and any(x.removed for x in got.values())
    for ref, x in got.items():
        raw, at, kept = before[ref].encode(), 0, b""
        for g in x.removed:
            assert before[ref].split()[g.first_word] == raw[g.first_byte :].decode().split()[0] and g.last_word - g.first_word >= 0
            kept += raw[at : g.first_byte]
            at = g.end_byte
        assert (kept + raw[at:]).decode() == x.text
    units = lambda texts: {tuple(w[i : i + 14]) for w in map(str.split, texts) for i in range(len(w) - 13)}
    shared = {u for u in units(before.values()) if len({o for _, _, o, _, t in rows if u in units([t])}) > 1}
    assert shared and shared <= units(x.text for x in got.values())


@pytest.mark.parametrize("swapped", [False, True])
@pytest.mark.parametrize("ids", [("a", "b"), ("b", "a"), ("doc7", "doc2"), ("x9", "x10"), ("old", "new"), ("q", "p")])
def test_the_older_of_two_owners_keeps_its_passage(spark, ids, swapped):
    passage = " ".join(WORDS[:18])
    texts = {2020: f"first {passage} here", 2024: f"then {passage} there\n{passage}"}
    rows = [("chunk", f"c-{i}", i, year, texts[year]) for i, year in zip(ids, (2020, 2024))]
    df = spark.createDataFrame(rows[::-1] if swapped else rows, "kind string, ref string, owner string, rank long, text string")
    got = {x.ref: x for x in S.without_repeats(df).collect()}
    assert got[f"c-{ids[0]}"].text == texts[2020] and got[f"c-{ids[0]}"].removed == []
    assert got[f"c-{ids[1]}"].text == "then there\n"


def test_lines_are_taken_out_whole_and_the_earliest_stays_in_its_own_record(spark):
    line, part = " ".join(WORDS[:20]), " ".join(WORDS[2:18])
    rows = [("chunk", "c1", "d1", 5, f"a b\n{line}\nc {line}"), ("chunk", "c2", "d1", 6, line), ("chunk", "c3", "d2", 7, line.replace(" ", "  ")), ("chunk", "c4", "d3", 1, f"so {part} on")]
    df = spark.createDataFrame(rows, "kind string, ref string, owner string, rank long, text string")
    got = {x.ref: x.text.split() for x in S.without_repeats(df).collect()}
    assert got["c4"] == f"so {part} on".split()  # the earliest place of the part
    words = line.split()
    assert got["c2"] == [] and got["c3"] == []
    assert got["c1"][:2] == ["a", "b"] and got["c1"][2:4] == words[:2] and "c" in got["c1"]
    units = {tuple(w[i : i + 14]) for w in got.values() for i in range(len(w) - 13)}
    assert {tuple(words[i : i + 14]) for i in range(7)} <= units


def test_repeated_rows_of_a_key_are_thinned_before_the_shuffle(spark):
    long = " ".join(WORDS[:20])
    rows = [("chunk", "hot", "d1", i % 3, long) for i in range(500)] + [("chunk", "hot", "d1", 2, "a newer text"), ("chunk", "b", "d2", 0, long)]
    df = spark.createDataFrame(rows, "kind string, ref string, owner string, rank long, text string").coalesce(1)
    assert S.thin(df).count() <= 5
    got = {r.ref for r in S.shared_runs(df).where("first_word is not null").collect()}
    assert got == {"hot", "b"}  # of equal ranks the greater text counts, here the long one


def test_a_page_sends_one_row_a_digest(spark):
    import pyarrow as pa

    rows = {"page": [3] * 3, "kind": ["chunk"] * 3, "ref": ["a", "b", "c"], "owner": ["o1", "o2", "o1"], "rank": [5, 2, 9], "tie": [1, 1, 1], "text": [" ".join(WORDS[:14])] * 3}
    page = S._Page(pa.table(rows), 14)
    owner = page.owner[page.rec]
    sent = S._sent(3, page, S._Occurrences(page.units(), owner, owner, page.rec, page.at)).to_pylist()
    assert len(sent) == 1 and sent[0]["least"] < sent[0]["most"] and (sent[0]["rank"], sent[0]["at"]) == (2, 0)
    assert K.grams(np.zeros(2, np.uint64), 3).tolist() == []


def test_all_pairs_follow_from_links_and_copy_groups(spark):
    base = " ".join(f"word{i}" for i in range(40))
    rows = [(f"c{i}", base) for i in range(4)] + [("n", base + " more"), ("o", " ".join(f"other{i}" for i in range(40)))]
    df = spark.createDataFrame(rows, "key string, norm string")
    own = source(df, "key", N.normal_words(F.col("norm")), N.CHUNK)
    links = {(r.text_a, r.text_b) for r in N.near_links(own).collect()}
    assert links == {("c0", "n")}
    copies: dict = {}
    for r in N.near_classes(own).collect():
        copies.setdefault(r.text_key, []).append(r.key)
    rebuilt = {tuple(sorted((x, y))) for a, b in links for x in copies[a] for y in copies[b]}
    rebuilt |= {(x, y) for own_ in copies.values() for x in own_ for y in own_ if x < y}
    assert rebuilt == pairs(df, "key", N.normal_words(F.col("norm")), N.CHUNK) and len(rebuilt) == 10


def test_size_classes_overlap_where_near_duplicates_may_differ():
    n = np.array([0, 5, int(N.FULL * 0.5), int(N.FULL * 0.9), N.FULL + 1, N.FULL * 2, N.FULL * 15, N.FULL * 10**5])
    own = [set(c.tolist()) for c in N.size_classes(n, 0.6)]
    assert own[0] == {0, 1, 2, 3, 4} and {3, 4, 5, 6} <= own[1] and 7 in own[-1]
    for i, x in enumerate(n):
        for j, y in enumerate(n):
            if 0 < min(x, y) >= 0.6 * max(x, y):
                assert any({i, j} <= c for c in own)


def test_huge_texts_agree_only_where_they_are_alike():
    r = np.random.default_rng(8)
    word = lambda lo, n: " ".join(f"w{x}" for x in r.integers(lo, lo + 10**7, n))
    a, other = word(0, 400_000), word(10**8, 400_000)
    near = a.split()
    near[1000:9000] = word(2 * 10**8, 8000).split()
    cfg = N.NearDupConfig(3, 0.6, 20, 5, 8)
    text, keys = N.band_rows(pa.array([a, other, " ".join(near)]), cfg)
    assert len(text) == 3  # one class each
    assert (keys[0] == keys[2]).any() and not (keys[0] == keys[1]).any()


def test_components_raise_when_rounds_run_out(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    nodes = spark.range(61).withColumnRenamed("id", "tid")
    with pytest.raises(RuntimeError):
        N.components(nodes, links, max_rounds=1)
    assert {r["class"] for r in N.components(nodes, links).collect()} == {0}
