"""Quality statistics, splitting, pair defects, personal information."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trovelle.llm import pairs as P
from trovelle.llm import pii
from trovelle.llm import quality as Q
from trovelle.llm import splitting as L

COMMON = ["the", "of", "und", "für", "was", "in", "to"]


def plain_counts(counter, text):
    out = dict.fromkeys(Q.COUNTS, 0)
    out["n_chars"] = len(text)
    for w in text.split():
        counter.one_word(w, out)
    assert out["n_common"] == sum(re.sub(r"^\W+|\W+$", "", w).lower() in COMMON for w in text.split())
    out["n_symbols"] = sum(not c.isalnum() and not c.isspace() for c in text)
    out["n_digits"] = sum(c in "0123456789" for c in text)
    for line in text.split("\n"):
        Q._line(Q._last_two(line), out)
    return out


def test_counts_do_not_depend_on_the_cuts():
    r, c = random.Random(5), Q.Counter(COMMON)
    parts = ["the ", "of", "\n", " ", ".", "!)", "für", "Was x9", "a", "-", "\t", "“z”", "|", "12", "…"]
    for _ in range(150):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        want = plain_counts(c, text)
        none = np.zeros(1, bool)
        whole = c.batch(pa.array([text]), none, none)
        assert {k: int(whole[k][0]) for k in Q.COUNTS} == want
        size = r.randint(1, 7)
        cuts = [text[i : i + size] for i in range(0, len(text), size)]
        if len(cuts) > 1:
            at = np.arange(len(cuts))
            b = c.batch(pa.array(cuts), at > 0, at < len(cuts) - 1)
            states = [{k: int(b[k][i]) if k in Q.COUNTS else b[k][i] for k in Q._STATE} for i in range(len(cuts))]
            while len(states) > 1:
                i = r.randrange(len(states) - 1)
                states[i : i + 2] = [c.merge(states[i], states[i + 1])]
            got = c.close(states[0])
            assert {k: got[k] for k in Q.COUNTS} == want


def test_huge_texts_go_up_the_tree(spark):
    text = ("The rise of it was seen in 12 of them.\n" * 400)[:-5]
    df = spark.createDataFrame([("a", text), ("b", text[:50]), ("c", None), ("d", "")], "ref string, text string")
    cut = {r.ref: r.asDict() for r in Q.text_counts(df, ["ref"], "text", COMMON, piece=97).collect()}
    whole = {r.ref: r.asDict() for r in Q.text_counts(df, ["ref"], "text", COMMON).collect()}
    assert cut == whole and len(cut) == 4 and whole["c"]["n_words"] == 0


def test_statistics_and_verdicts(spark):
    prose = "The rise of the fever was seen in most of the wards, and it fell to the usual level in a week. " * 3
    rows = [
        ("prose", prose),
        ("wrapped", prose.replace(" of ", "\nof ")),
        ("list", "\n".join(f"- Pelomide {i} mg tablet" for i in range(20))),
        ("table", "\n".join(f"| Item | {i} | {i * 7} | n/a |" for i in range(20))),
        ("noise", "Th; r|s0 o~ 7he f3v!r w^s s;;n |n m0st 0f t~e w5rds " * 4),
        ("short", "x | y | z"),
        ("empty", ""),
    ]
    df = spark.createDataFrame([("chunk", k, "0", t) for k, t in rows] + [("chunk", "prose", "1", prose)], "kind string, ref string, stamp string, text string")
    words = COMMON + ["and", "it", "a", "seen", "most"]
    got = {r.ref: r for r in Q.statistics(Q.latest_counts(df, words)).collect()}
    assert len(got) == 7
    assert {k for k, r in got.items() if not r.is_prose} == {"list", "table", "noise"}
    assert got["empty"].mean_word_length == 0 and got["prose"].ended_line_share == 1 and got["list"].ended_line_share == 0


TOKEN = re.compile(r"\w+|[^\w\s]+")


def test_pieces_give_the_text_again(spark):
    r = random.Random(3)
    sentence = lambda: " ".join(r.choice(["fever", "rose", "übel", "x_1", "a.b", "(no)"]) for _ in range(r.randint(3, 30))) + r.choice([". ", "!\n", ".\n\n", "; "])
    texts = {
        "many": "".join(sentence() for _ in range(120)),
        "lead": " \n\t" + "".join(sentence() for _ in range(60)) + "  ",
        "bare": "word " * 700,
        "glued": "a." * 400,
        "one": "x" * 5000,
        "edge": " ".join(["w"] * 500),
        "over": " ".join(["w"] * 501),
        "blank": " " * 3000,
    }
    rows = [(k, "s", t, "0", 9) for k, t in texts.items()] + [("many", "s", texts["many"], "0", 9), ("null", "s", None, "0", 9)]
    df = spark.createDataFrame(rows, "ref string, section string, text string, stamp string, piece__ int")
    got: dict = {}
    for p in L.split_texts(df, ["ref"], 500, 75).collect():
        got.setdefault(p.ref, []).append(p)
    assert set(got) == {k for k, t in texts.items() if len(TOKEN.findall(t)) > 500}
    for k, ps in got.items():
        ps.sort(key=lambda p: p.piece)
        at = 0
        assert len(ps) == ps[0].n_pieces and all(p.section == "s" for p in ps)
        for p in ps:
            assert texts[k][p.char_start : p.char_end] == p.text and p.token_count == len(TOKEN.findall(p.text)) <= 500
            if p.piece:
                assert len(TOKEN.findall(texts[k][p.char_start : at])) == 75
            at = p.char_end
        assert at == len(texts[k])
    ends = [p.text.rstrip()[-1] for p in got["many"][:-1]]
    assert all(e in ".!" for e in ends)


def test_overlap_is_checked_and_may_be_none(spark):
    df = spark.createDataFrame([("a", "0", "w " * 25)], "ref string, stamp string, text string")
    assert [p.token_count for p in L.split_texts(df, ["ref"], 10, 0).orderBy("piece").collect()] == [10, 10, 5]
    with pytest.raises(ValueError):
        L.split_texts(df, ["ref"], 10, 5)
    assert L.split_texts(df.where("false"), ["ref"]).count() == 0


ANSWERS = "answer_id long, question string, answer string, usage struct<completion_tokens:int>, logged_at timestamp, shorter boolean, length int"
ASK = "Which patients with gout must not receive pelomide?"


def defects(spark, *cases):
    rows = [(i, q, a, (10 + i,), None, True, 1) for i, (q, a) in enumerate(cases)]
    out: dict = {i: set() for i in range(len(cases))}
    for r in P.pair_defects(spark.createDataFrame(rows, ANSWERS)).collect():
        out[r.answer_id].add(r.defect)
    return [out[i] for i in range(len(cases))]


def test_defects(spark):
    good = "Pelomide is not advised when renal output exceeds the usual level [2]."
    got = defects(
        spark,
        (ASK, good),
        (ASK, None),
        (ASK, " [1][2] "),
        (ASK, "N/A"),
        (ASK, "​"),
        (ASK, ASK.upper()),
        (ASK, "You asked: " + ASK.lower()),
        (ASK, ASK + " " + good),
        (ASK, "I'm sorry, but I can't answer that from these documents. Please rephrase the question."),
        (ASK, "The passages do not report rash, but pelomide halved nausea in 12 of 90 patients [1]."),
        (ASK, "Pelomide could not be continued in 9 patients, and the tablets do not contain lactose [2]."),
        (ASK, "Pelomide is not advised when renal output exceeds the"),
        (ASK, good + "\n3."),
        (ASK, good + " ["),
        (ASK, "- " + good + "\n- Doses above 12 mg raised the level of urate in adults [1]"),
        (ASK, "Die Behandlung mit pelomide verringerte die Beschwerden bei 60 % der Patienten [4]."),
        ("Welche Nebenwirkungen hat pelomide?", "Häufige Nebenwirkungen waren Übelkeit und Schwindel. [2]"),
        (ASK, "The leaflet calls this “nicht empfohlen”; pelomide was stopped in 4 of the patients [5]."),
        (ASK, "Die Behandlung mit pelomide verringerte die Beschwerden der"),
        (None, good),
        (ASK, "79 mg twice daily [1]."),
        (ASK, "Die vorliegenden Dokumente enthalten keine Angaben zu pelomide."),
    )
    assert got == [
        set(), {"empty"}, {"empty"}, {"empty"}, {"empty"}, {"copy"}, {"copy"}, set(), {"refusal"}, set(), set(),
        {"truncated"}, {"truncated"}, {"truncated"}, set(), {"language"}, set(), set(), {"language", "truncated"}, set(), set(), {"refusal", "language"},
    ]


def test_missing_stop_alone_is_no_case_unless_a_longer_version_is_there(spark):
    ends = [(ASK, f"It fell in {i} of the adults. It was seen again in the adults.") for i in range(6)]
    got = defects(spark, *ends, (ASK, "It rose to 5 in the adults"), (ASK, "The level was lower in the adults"), (ASK, "The level was lower in the adults who stopped it early."))
    assert got[6] == set() and got[7] == {"truncated"} and got[8] == set()


def test_latest_row_of_an_answer_counts(spark):
    rows = [(1, ASK, "N/A", None, "2024-01-01"), (1, ASK, "It is safe.", None, "2024-01-02"), (None, ASK, "", None, "2024-01-02")]
    df = spark.createDataFrame(rows, "answer_id long, question string, answer string, u string, t string").select("answer_id", "question", "answer", F.expr("named_struct('completion_tokens', 1) as usage"), F.to_timestamp("t").alias("logged_at"))
    assert P.pair_defects(df).count() == 0 and P.pair_defects(df.where("false")).count() == 0


def test_shortened_over_partition_ends(spark):
    texts = [f"{i:03d} common start" for i in range(60)]
    df = spark.createDataFrame([(t,) for t in texts] + [(t + " and more",) for t in texts[::2]], "text string").repartition(4).withColumn("h", F.xxhash64("text"))
    got = {r.text: r.rest for r in P.shortened(df).join(df, "h").collect()}
    assert got == {t: " and more" for t in texts[::2]}


def test_a_version_cut_at_a_sentence_end_is_whole(spark):
    long = "The level rose to 0.28 in adults [1]. It fell in children, e.g. after meals [2]."
    cuts = ["The level rose to 0.", "The level rose to 0.28 in adults", "The level rose to 0.28 in adults [1].", "The level rose to 0.28 in adults [1]. It fell in children, e.g."]
    got = defects(spark, *((ASK, t) for t in [long, *cuts]))
    assert got == [set(), {"truncated"}, {"truncated"}, set(), {"truncated"}] or got == [set(), {"truncated"}, set(), set(), {"truncated"}]


def test_languages_are_learnt_from_the_texts(spark):
    from trovelle.llm import language as L

    english = [f"What does pelomide{i} do in the kidney when it is given with food?" for i in range(20)]
    german = [f"Welche Wirkung hat pelomide{i} in der Niere und wann wird es mit Nahrung gegeben?" for i in range(20)]
    df = spark.createDataFrame([(e, g) for e, g in zip(english, german)], "a string, b string")
    profile = L.learn(df)
    told = L.languages(pa.array(["The kidney was given food when it was in the", "Wann wird die Niere mit Nahrung", "", None, "x7Gq/9+Zk QQzx"]), profile)
    assert [L.NAMES[i] if i >= 0 else None for i in told] == ["en", "de", None, None, None]
    assert L.languages(pa.array([], pa.string()), profile).tolist() == []


def test_a_token_of_any_length_is_cut_by_characters(spark):
    text = "start. " + "x" * 900_500 + " " + "word, " * 300 + "-" * 5000
    df = spark.createDataFrame([("c", "0", text), ("d", "0", "y" * 9_000_000)], "ref string, stamp string, text string")
    rows = L.split_texts(df, ["ref"], 500, 75).orderBy("ref", "piece").collect()
    assert {r.ref for r in rows} == {"c"} and "".join(text[r.char_start : r.char_end][0 if i == 0 else rows[i - 1].char_end - r.char_start :] for i, r in enumerate(rows)) == text
    assert all(len(r.text) <= 500 * L.LONGEST and r.token_count <= 500 for r in rows) and len(rows) > 3


def test_spikes(spark):
    rows = [(i, i % 90 + 10) for i in range(600)] + [(1000 + i, 800) for i in range(60)]
    df = spark.createDataFrame(rows, "answer_id long, length int")
    assert [r.length for r in P.length_spikes(df).collect()] == [800]


NONE = pii.Contexts(set(), set())

LETTERS = (
    "Dear Mrs Vance, please call Tobor van Kestmark on +1 202 555 0143 after the visit. Patient: Ivor QUENDLEY, SSN 900-12-3456. "
    "Home address: Flat 3, 12b Harrow Lane, Wexcombe ZZ1 6QT. Results were sent to ivor.quendley@post.example on request. "
    "Patient: Holmark, Aniel, wohnhaft Gorsestraße 34, 99579 Tarnby. Signed by K. Quendley. My name is tamo brellick and my number is 020 7946 0135. "
    "The Vance score was 12. Lot 57-4846-6 was recalled. Reference range 293.715.9262 is obsolete. Samples were taken @ 8 a.m. "
    "The Harrow Street clinic supplied 60 records. Write to ada [at] post [dot] example or bo(at)post.example. Insurance file KV-A358818419 stayed."
)


def test_spans_are_found_with_their_kind(spark):
    more = [
        f"Spoke with {a} {b} about the plan. Dr. {b} reviewed the chart. Please call {a} {b} on 020 7946 0{100 + i} after the visit. The {b} score was {i}. Lot {i}0-1234-5 was recalled. The {c} Street clinic supplied 9 records. Samples were taken @ {i} p.m. My name is {a} {b}. {b}, {a}, wohnhaft Gorsestraße {i + 10}, 99579 Tarnby. Reference range 2{10 + i}.715.9262 is obsolete. Mr {b} came in."
        for i, (a, b, c) in enumerate([("Ada", "Vance", "Mill"), ("Ivor", "Quendley", "Hill"), ("Tobor", "Kestmark", "Rowan"), ("Aniel", "Holmark", "Gorse"), ("Tamo", "Brellick", "Dale")] * 8)
    ]
    df = spark.createDataFrame([(0, LETTERS, "a", 1)] + [(i + 1, t, "a", 1) for i, t in enumerate(more)] + [(900, None, "a", 1), (901, "", "a", 1), (None, LETTERS, "a", 1)], "doc_id long, text string, word string, start int")
    spans = pii.personal_spans(df)
    got = {(r.kind, r.value) for r in spans.where("doc_id = 0").collect()}
    assert got == {
        ("name", "Vance"), ("name", "Tobor van Kestmark"), ("phone", "+1 202 555 0143"), ("name", "Ivor QUENDLEY"), ("id_number", "900-12-3456"),
        ("address", "Flat 3, 12b Harrow Lane, Wexcombe ZZ1 6QT"), ("email", "ivor.quendley@post.example"), ("name", "Holmark, Aniel"),
        ("address", "Gorsestraße 34, 99579 Tarnby"), ("name", "K. Quendley"), ("name", "tamo brellick"), ("phone", "020 7946 0135"),
        ("email", "ada [at] post [dot] example"), ("email", "bo(at)post.example"),
    }
    for r in spans.where("doc_id = 0").collect():
        assert LETTERS[r.start : r.end] == r.value
    red = {r.doc_id: r.text for r in pii.redact(df, spans).collect()}
    assert "Dear Mrs [NAME], please call [NAME] on [PHONE] after the visit." in red[0] and "The Vance score was 12." in red[0]
    assert red[900] is None and red[901] == "" and len(red) == 43


def test_a_long_text_is_scanned_in_proportion():
    import time

    one = LETTERS + "\n"
    took = []
    for n in (40, 400):
        began = time.time()
        found = pii.scan(one * n, NONE)
        took.append(time.time() - began)
        assert len({(k, b - a) for k, a, b, *_ in found}) == len({(k, b - a) for k, a, b, *_ in pii.scan(one * 3, NONE)})
    assert took[1] < 30 * took[0] + 0.5


def test_no_documents_no_spans(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_spans(df).count() == 0


def test_reliabilities_learn_from_agreement():
    votes = np.array([[1, 1, 1], [1, 1, 0], [-1, -1, 1], [-1, -1, 0], [1, -1, 1]])
    q, prior, table = pii.reliabilities(votes, np.array([400.0, 100, 150, 350, 10]))
    assert q[0] > 0.9 and q[1] > 0.9 and q[2] < 0.1 and q[3] < 0.1 and 0.4 < prior < 0.6
    w = pii.train(np.array([[1.0], [0.0]]), np.array([0.9, 0.1]), np.array([5.0, 5.0]))
    assert w[0] > 1 and w[1] < 0


def test_numbers_in_brackets_and_beside_others_are_proposed():
    from trovelle.llm.pii import scan

    found = lambda t: {(k, t[a:b]) for k, a, b, *_ in scan(t, NONE) if k in ("id_number", "phone")}
    assert found("seen (412-55-0199) again") == {("id_number", "412-55-0199")}
    assert found("seen 412-55-0199 12 times") == {("id_number", "412-55-0199")}
    assert found("seen/412-55-0199, then") == {("id_number", "412-55-0199")}
    assert found("ring (020 7946 0825) now") == {("phone", "020 7946 0825")}
    assert found("412-55-0199 020 7946 0825") == {("id_number", "412-55-0199"), ("phone", "020 7946 0825")}
    assert ("id_number", "412-55-0199") not in found("no 1412-55-0199-1")


def test_each_model_has_its_own_limit(spark):
    rows = [("a", 400)] * 12 + [("a", 50 + 7 * i) for i in range(40)] + [("b", 420 + 9 * i) for i in range(40)] + [("b", 800)] * 12
    rows += [("c", 300)] * 4 + [("c", 20), ("", 90), (None, 95)]
    got = {(r.model, r.length) for r in P.length_spikes(spark.createDataFrame(rows, "model string, length int")).collect()}
    assert {("a", 400), ("b", 800), ("c", 300), (None, 800)} == got
    base = [("a", 400, "The dose was raised in adults")] * 12 + [("a", 50 + 7 * i, "It fell in adults.") for i in range(40)] + [("b", 420 + 9 * i, "It rose in adults.") for i in range(40)] + [("b", 400, "The dose was lowered in adults")]
    df = spark.createDataFrame([(i, f"q{i}", t, m, n) for i, (m, n, t) in enumerate(base)], "answer_id long, question string, answer string, model string, n int")
    df = df.selectExpr("*", "named_struct('completion_tokens', n) as usage", "cast(null as timestamp) as logged_at")
    cut = {r.answer_id for r in P.pair_defects(df).collect() if r.defect == "truncated"}
    assert cut == set(range(12))


def test_contexts_come_from_all_texts(spark, monkeypatch):
    """More texts than any sample would hold, the ones that teach among the last and the longest; partial counts meet."""
    names = ["Harlow", "Brennick", "Costane", "Dravid", "Ellsten"]
    plain = [f"Dr {n} saw the results of week {i}." for i in range(500) for n in names]
    rare = [f"Results were kept. {'Filler words go on here. ' * 600}The sample was cosigned by {names[i % 5]} on the ward." for i in range(12)]
    texts = [*plain, *(f"Mrs {names[i % 5]} called. {t}" for i, t in enumerate(rare))]
    df = spark.createDataFrame([(f"k{i:05d}", t) for i, t in enumerate(texts)] + [("k00000", texts[0]), (None, texts[1]), ("none", None)], "doc_id string, text string")
    monkeypatch.setattr(pii, "HELD", 5)
    got, want = pii.contexts_of(df), pii.learn_contexts(texts)
    assert "cosigned by" in got.before and (got.before, got.after) == (want.before, want.after)
