"""Pieces of SQL that several twins share (DuckDB dialect)."""

from __future__ import annotations

import unicodedata

from trovelle.functions import text as T

STOP = "[" + ",".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _latest(table: str, key: str, *order: str) -> str:
    by = ", ".join(f"{c} DESC NULLS LAST" for c in order)
    return f"(SELECT * EXCLUDE (rn__) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {by}) AS rn__ FROM {table} WHERE {key} IS NOT NULL) WHERE rn__ = 1)"


CHUNKS = "c AS " + _latest("chunks", "chunk_id", "indexed_at", "title", "section", "text")
QUESTIONS = "q AS " + _latest("eval_questions", "question_id", "created_at", "question", "source_title", "lexical_overlap")
ANSWERS = "a AS " + _latest("answers", "answer_id", "logged_at", "answer")
DOCUMENTS = "d AS " + _latest("source_documents", "document_id", "ingested_at", "title", "published")
BLOCKS = "b AS (SELECT document_id, (i - 1)::INT AS block_idx, blocks[i].page AS page, blocks[i].section AS section, coalesce(blocks[i].text, '') AS text FROM (SELECT document_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM d))"


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def re_sub(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {by}, 'g')"


def strip(expr: str) -> str:
    return re_sub(expr, T.EDGES, "''")


def ligatures(expr: str) -> str:
    for bad, good in T.LIGATURES.items():
        expr = f"replace({expr}, '{bad}', '{good}')"
    return expr


def whitespace(expr: str) -> str:
    expr = f"replace(replace({expr}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return strip(re_sub(re_sub(expr, r"[ \t\x{a0}]+", "' '"), r"\n{3,}", "chr(10) || chr(10)"))


def _compatible() -> dict[str, str]:
    """Compatibility forms of the Latin, punctuation, letterlike, ligature and full-width ranges, by the Unicode tables."""
    ranges = [(0xA0, 0xFF), (0x2000, 0x218F), (0x3000, 0x3000), (0xFB00, 0xFB06), (0xFF01, 0xFF5E)]
    chars = [chr(i) for lo, hi in ranges for i in range(lo, hi + 1)]
    return {c: n for c in chars if (n := unicodedata.normalize("NFKC", c)) != c}


def nfkc(expr: str) -> str:
    """NFKC in those ranges; elsewhere the composed form."""
    table = _compatible()
    one = {c: n for c, n in table.items() if len(n) == 1}
    expr = f"translate({expr}, '{''.join(one)}', {lit(''.join(one.values()))})"
    for c, n in table.items():
        if len(n) != 1:
            expr = f"replace({expr}, '{c}', {lit(n)})"
    return f"nfc_normalize({expr})"


def keep_lines(expr: str) -> str:
    drop = "(?i)" + "|".join([T.PAGE_NUMBER, *T.BOILERPLATE])
    return f"array_to_string(list_filter(list_transform(string_split({expr}, chr(10)), lambda x: {strip('x')}), lambda x: x = '' OR NOT regexp_matches(x, {lit(drop)})), chr(10))"


def references(expr: str) -> str:
    return re_sub(re_sub(expr, T.CITATION, "' '"), T.FIGURE, "' '")


def wrapped(expr: str) -> str:
    return re_sub(expr, T.HYPHEN_WRAP, "'\\1\\2'")


def links(expr: str) -> str:
    return re_sub(re_sub(expr, T.URL, "' '"), T.EMAIL.replace("*+", "*"), "' '")


def clean(expr: str) -> str:
    return whitespace(nfkc(keep_lines(references(links(wrapped(ligatures(re_sub(f"coalesce({expr}, '')", T.CONTROL, "' '"))))))))


def tokens(expr: str, stop: bool = True) -> str:
    found = f"regexp_extract_all(lower(coalesce({expr}, '')), '[a-z0-9]+')"
    return f"list_filter({found}, lambda x: NOT list_contains({STOP}, x))" if stop else found


def words(expr: str) -> str:
    return f"regexp_extract_all({expr}, {lit(r'[^\s\p{Z}]+')})"


def n_tokens(expr: str) -> str:
    return f"len(regexp_extract_all(coalesce({expr}, ''), {lit(T.TOKEN)}))"


def truncate(expr: str, most: int) -> str:
    parts = f"regexp_extract_all({expr}, {lit(rf'[\s\p{{Z}}]*(?:{T.TOKEN})')})"
    return f"CASE WHEN len({parts}) <= {most} THEN {expr} ELSE array_to_string({parts}[1:{most}], '') END"


def sentences(expr: str) -> str:
    """A mark is set at each end and taken away again behind abbreviations."""
    e = re_sub(f"coalesce({expr}, '')", r"([.!?])([\s\p{Z}]+)([A-Z0-9(])", "'\\1' || chr(1) || '\\2\\3'")
    e = f"regexp_replace({e}, '([A-Z][a-z]\\.)' || chr(1), '\\1', 'g')"
    for x in (r"[A-Z]\.", r"e\.g\.", r"i\.e\.", r"vs\.", r"et\sal\.", r"Fig\.", r"No\.", r"approx\."):
        e = f"regexp_replace({e}, '((?:^|[^\\p{{L}}\\p{{N}}_])(?:{x}))' || chr(1), '\\1', 'g')"
    return f"list_filter(list_transform(string_split({e}, chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"


def statements(expr: str) -> str:
    e = re_sub(f"coalesce({expr}, '')", r"([.!?])[\s\p{Z}]+", "'\\1' || chr(1)")
    return f"list_filter(string_split({e}, chr(1)), lambda x: len({words('x')}) >= 4)"


def collapse(expr: str) -> str:
    return strip(re_sub(expr, r"[\s\p{Z}]+", "' '"))


def snippet(expr: str, most: int = 320) -> str:
    flat = collapse(expr)
    return f"CASE WHEN length({flat}) <= {most} THEN {flat} ELSE regexp_replace(substr({flat}, 1, {most}), ' [^ ]*$', '') || '…' END"


ABBREVIATIONS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.ABBREVIATIONS.items()) + "}"


def expand(expr: str) -> str:
    toks = f"regexp_extract_all(lower({expr}), {lit(r'[\p{L}\p{N}_-]*[\p{L}\p{N}_][\p{L}\p{N}_-]*')})"
    found = f"list_filter(list_transform({toks}, lambda x: {ABBREVIATIONS}[regexp_replace(x, '^-+|-+$', '', 'g')]), lambda x: x IS NOT NULL)"
    once = f"list_transform(list_filter(list_transform({found}, lambda x, i: struct_pack(x := x, i := i)), lambda s: list_position({found}, s.x) = s.i), lambda s: s.x)"
    return f"CASE WHEN len({found}) > 0 THEN {expr} || ' ' || array_to_string({once}, ' ') ELSE {expr} END"


MARKERS = "list_transform(regexp_extract_all(coalesce(answer, ''), '\\[([0-9]{1,2})\\]', 1), lambda x: x::INT)"
COVERAGE = f"(CASE WHEN len({statements('answer')}) > 0 THEN len(list_filter({statements('answer')}, lambda x: regexp_matches(x, '\\[[0-9]{{1,2}}\\]')))::DOUBLE / len({statements('answer')}) ELSE 0.0 END)"
