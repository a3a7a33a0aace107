"""Cleaning, words, sentences, snippets, expansion."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trovelle.functions import npkern as K
from trovelle.functions import text as T


def one(spark, expr, *values):
    df = spark.createDataFrame([(v,) for v in values], "text string")
    return [r[0] for r in df.select(expr(F.col("text"))).collect()]


def test_cleaning_joins_wrapped_words_and_drops_references_pages_and_links(spark):
    text = "The anti-\nviral was safe [12, 14] (see Fig. 2).\n 17 \nPage 3\nwww at https://x.example/a?b=c or a.b@c.example.\n\n\n\nAll rights reserved.\nDose 5-10 mg, 120/80."
    (got,) = one(spark, T.clean_text, text)
    assert "antiviral was safe" in got and "[12" not in got and "Fig" not in got and "17" not in got and "https" not in got and "@" not in got
    assert "All rights" not in got and "Dose 5-10 mg, 120/80." in got and "\n\n\n" not in got
    (kept,) = one(spark, lambda c: T.clean_text(c, drop_citations=False), text)
    assert "[12, 14]" in kept


def test_null_and_empty_texts_clean_to_the_empty_text(spark):
    assert one(spark, T.clean_text, None, "", " \n ") == ["", "", ""]
    assert one(spark, T.tokenize, None, "", "the of") == [[], [], []]
    assert one(spark, T.sentences, None, "  ") == [[], []]


def test_words_split_hyphens_and_lose_stopwords(spark):
    assert one(spark, T.tokenize, "First-line beta-blocker's use, AND the café") == [["first", "line", "beta", "blocker", "use", "caf"]]
    assert one(spark, T.tokenize, "first line") == one(spark, T.tokenize, "first-line")


def test_sentences_keep_abbreviations_together(spark):
    text = "Dr. Vance saw J. Smith. It fell, e.g. Monday vs. Tuesday. See Fig. 3 and No. 4! Was it approx. 5? (Yes.) end. not here"
    (got,) = one(spark, T.sentences, text)
    assert got == ["Dr. Vance saw J. Smith.", "It fell, e.g. Monday vs. Tuesday.", "See Fig. 3 and No. 4!", "Was it approx. 5?", "(Yes.) end. not here"]


def test_snippet_cuts_at_a_blank(spark):
    assert one(spark, lambda c: T.snippet(c, 10), "short", "one  two\nthree four", "x" * 30) == ["short", "one two…", "xxxxxxxxxx…"]


def test_truncation_counts_words_and_symbols(spark):
    assert one(spark, lambda c: T.truncate_tokens(c, 3), "a b c", " a, b c", "") == ["a b c", " a, b", ""]
    assert one(spark, T.count_tokens, "ein Maß: 5-10", None) == [6, 0]


def test_expansion_appends_each_once_in_order(spark):
    assert one(spark, T.expand_query, "HTN and MI, then htn", "MI-related", "nothing") == ["HTN and MI, then htn hypertension myocardial infarction", "MI-related", "nothing"]


def test_scope_and_headings(spark):
    assert one(spark, T.out_of_scope, "??", "12345", "why", "") == [True, True, False, True]
    got = one(spark, T.looks_like_heading, "METHODS", "3.2 Treatment plan", "Adverse Drug Reactions", "this is a sentence.", "a", "only lower words here", None, "Dose:")
    assert got == [True, True, True, False, False, False, False, False]


def test_meaningful(spark):
    prose = "The patients were treated for twelve weeks and then followed " * 4
    assert one(spark, T.is_meaningful, prose, "short", "1 2 3 | 4 5 6 | " * 20, None) == [True, False, False, False]


def test_nfkc(spark):
    assert one(spark, T.nfkc, "ﬁne ①", None) == ["fine 1", None]


words = st.text(alphabet="ab é\t\n.x9", max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(words, max_size=6))
def test_word_kernel_matches_splitting(texts):
    import pyarrow as pa

    w = K.Words(*K.byte_buffers(pa.array(texts, pa.string())), K.BLANK)
    want = [[x for x in re.split("[ \t\r\n]+", t) if x] for t in texts]
    assert [int(b - a) for a, b in zip(w.lo, w.hi)] == [len(x) for x in want]
    flat = [x for t in want for x in t]
    h = w.hashes().tolist()
    assert len(set(flat)) == len(set(h)) and len({*zip(flat, h)}) == len(set(flat))


@pytest.mark.parametrize("w", [1, 2, 3, 7, 8])
def test_sliding_minimum(w):
    import numpy as np

    x = np.random.default_rng(1).integers(0, 100, 50).astype(np.uint64)
    assert K.sliding_min(x, w).tolist() == [min(x[i : i + w].tolist()) for i in range(51 - w)]


def test_kernel_takes_sliced_null_and_empty_columns():
    import pyarrow as pa

    col = pa.array(["zz", None, "a b", ""]).slice(1)
    w = K.Words(*K.byte_buffers(col), K.BLANK)
    assert (w.hi - w.lo).tolist() == [0, 2, 0]
    assert len(K.Words(*K.byte_buffers(pa.array([], pa.string())), K.BLANK)) == 0
    points, offsets = K.code_points(pa.array(["é€", None, "𝄞"]))
    assert [chr(p) for p in points] == ["é", "€", "𝄞"] and offsets.tolist() == [0, 2, 2, 3]
