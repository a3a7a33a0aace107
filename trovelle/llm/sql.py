"""SQL twins (DuckDB) of the training-data queries that SQL can express: brute force over whole tables."""

from __future__ import annotations

from trovelle.llm import splitting
from trovelle.plans import sqlparts as S


def _pairs(items: str, unit: str, least: int, threshold: float, kind: str, links: bool = False) -> str:
    """items: a query of (key, u), u the list of units of the text."""
    grams = "list_distinct(list_transform(range(1, len(u) - 1), lambda i: " + ("u[i] || ' ' || u[i + 1] || ' ' || u[i + 2]" if unit == "word" else "u[i] || u[i + 1] || u[i + 2]") + "))"
    names = "key_a AS text_a, key_b AS text_b, round(k::DOUBLE / (n + m - k), 9) AS similarity" if links else "key_a, key_b"
    return f"""(WITH i AS (SELECT key, {grams} AS g FROM ({items}) WHERE len(u) >= {least}), x AS (SELECT key, len(g) AS n, unnest(g) AS s FROM i),
p AS (SELECT x.key AS key_a, y.key AS key_b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS k FROM x JOIN y ON x.s = y.s AND x.key < y.key GROUP BY 1, 2)
SELECT '{kind}' AS kind, {names} FROM p WHERE k::DOUBLE / (n + m - k) >= {threshold} - 1e-12)""".replace("JOIN y ON", "JOIN x y ON")


_PASSAGES = "SELECT chunk_id AS key, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS u FROM c"
_TITLES = f"SELECT document_id AS key, string_split({S.collapse('lower(coalesce(title, ' + chr(39) * 2 + '))')}, '') AS u FROM d"
P1 = f"WITH {S.CHUNKS}, {S.DOCUMENTS} " + _pairs(_PASSAGES, "word", 20, 0.6, "chunk") + " UNION ALL " + _pairs(_TITLES, "char", 10, 0.7, "title")
_ONE = "SELECT min(key) AS key, u FROM ({}) GROUP BY u".format
P1_LINKS = f"WITH {S.CHUNKS}, {S.DOCUMENTS} " + _pairs(_ONE(_PASSAGES), "word", 20, 0.6, "chunk", True) + " UNION ALL " + _pairs(_ONE(_TITLES), "char", 10, 0.7, "title", True)

_BLOCK = r"[^ \t\r\n]+"
_RUNS = f"""WITH {S.CHUNKS}, {S.QUESTIONS}, r AS (SELECT 'chunk' AS kind, chunk_id AS ref, coalesce(document_id, 'chunk:' || chunk_id) AS owner, epoch_us(coalesce(indexed_at, TIMESTAMP '1970-01-01')) AS rank, text, regexp_extract_all(text, '{_BLOCK}') AS w FROM c WHERE text IS NOT NULL
UNION ALL SELECT 'question', question_id, 'question:' || question_id, epoch_us(coalesce(created_at, TIMESTAMP '1970-01-01')), question, regexp_extract_all(question, '{_BLOCK}') FROM q WHERE question IS NOT NULL),
u AS (SELECT kind, ref, owner, rank, i, md5(array_to_string(w[i:i + 13], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 12)) AS i FROM r)),
s AS (SELECT h FROM u GROUP BY 1 HAVING count(DISTINCT owner) > 1),
p AS (SELECT DISTINCT kind, ref, i + j - 1 AS pos FROM (SELECT kind, ref, i, unnest(range(0, 14)) AS j FROM u SEMI JOIN s USING (h))),
g AS (SELECT kind, ref, pos, pos - row_number() OVER (PARTITION BY kind, ref ORDER BY pos) AS grp FROM p),
x AS (SELECT kind, ref, min(pos)::BIGINT AS first_word, max(pos)::BIGINT AS last_word FROM g GROUP BY kind, ref, grp)"""
P3 = f"{_RUNS} SELECT * FROM x"
P3_SHARES = f"""{_RUNS} SELECT r.kind, r.ref, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS covered_words, round(CASE WHEN len(w) > 0 THEN coalesce(n, 0)::DOUBLE / len(w) ELSE 0 END, 9) AS share, q.lexical_overlap
FROM r LEFT JOIN (SELECT kind, ref, sum(last_word - first_word + 1) AS n FROM x GROUP BY 1, 2) y USING (kind, ref) LEFT JOIN q ON r.kind = 'question' AND r.ref = q.question_id"""
_TIE = "('0x' || substr(md5(kind || ':' || ref), 1, 15))::BIGINT"
# lines (l), the repeats among them (lr), moving lines outside these (v), which of them are originals, and the words taken out (z)
P3_DEDUPLICATED = f"""{_RUNS}, l0 AS (SELECT kind, ref, owner, rank, unnest(list_transform(string_split(text, chr(10)), lambda x: regexp_extract_all(x, '{_BLOCK}'))) AS lw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM r),
l1 AS (SELECT *, coalesce(sum(len(lw)) OVER (PARTITION BY kind, ref ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM l0),
l AS (SELECT *, md5(array_to_string(lw, ' ')) AS h FROM l1 WHERE len(lw) >= 14),
lr AS (SELECT kind, ref, st, st + len(lw) AS upto FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY rank, {_TIE}, st) AS n FROM l WHERE h IN (SELECT h FROM l GROUP BY 1 HAVING count(DISTINCT owner) > 1)) WHERE n > 1),
v AS (SELECT kind, ref, i - 1 AS st, row_number() OVER (PARTITION BY h ORDER BY rank, {_TIE}, i) AS n FROM (SELECT u.* FROM u SEMI JOIN s USING (h) ANTI JOIN lr ON u.kind = lr.kind AND u.ref = lr.ref AND u.i - 1 >= lr.st AND u.i + 13 <= lr.upto)),
z AS (SELECT DISTINCT kind, ref, pos FROM (SELECT kind, ref, unnest(range(st, upto)) AS pos FROM lr UNION ALL SELECT kind, ref, unnest(range(st, st + 14)) FROM v WHERE n > 1)
ANTI JOIN (SELECT DISTINCT kind, ref, unnest(range(st, st + 14)) AS pos FROM v WHERE n = 1) USING (kind, ref, pos)),
zg AS (SELECT kind, ref, min(pos) AS a, max(pos) AS b FROM (SELECT *, pos - row_number() OVER (PARTITION BY kind, ref ORDER BY pos) AS grp FROM z) GROUP BY kind, ref, grp),
zl AS (SELECT kind, ref, sum(b - a + 1)::BIGINT AS n, string_agg(a || '-' || b, ' ' ORDER BY a) AS places, flatten(list(range(a, b + 1))) AS gone FROM zg GROUP BY 1, 2)
SELECT r.kind, r.ref, CASE WHEN n IS NULL THEN text ELSE regexp_extract(text, '^[ \t\r\n]*') || array_to_string(list_filter(regexp_extract_all(text, '{_BLOCK}[ \t\r\n]*'), lambda x, i: NOT list_contains(gone, i - 1)), '') END AS text,
coalesce(n, 0)::BIGINT AS removed_words, coalesce(places, '') AS removed_places FROM r LEFT JOIN zl USING (kind, ref)"""

_TEXTS = f"""WITH {S.CHUNKS}, {S.DOCUMENTS}, {S.BLOCKS}, t AS (SELECT 'chunk' AS kind, chunk_id AS ref, coalesce(text, '') AS text FROM c UNION ALL SELECT 'block', document_id || '#' || block_idx, text FROM b)"""
P4 = f"{_TEXTS} SELECT kind, ref FROM t WHERE len(regexp_extract_all(text, {S.lit(splitting.TOKEN.replace(chr(92) + 'x1c-' + chr(92) + 'x1f' + chr(92) + 'x85', chr(92) + 'x1c-' + chr(92) + 'x1f'))})) > 500"

_CORE = "lower(regexp_replace(x, '^[^\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+$', '', 'g'))"
_ENDED = "regexp_matches(x, '[.!?:;…][\"'')\\]”’»]?$')"
_BASE = f"""{_TEXTS}, k AS (SELECT list(DISTINCT lower(word)) AS common FROM common_words), m AS (SELECT kind, ref, text, {S.words('text')} AS w, list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '') AS ln FROM t),
n AS (SELECT kind, ref, text, w, ln, len(list_filter(w, lambda x: list_contains(common, {_CORE}))) AS n_common, length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\s\\p{{Z}}]', '', 'g')) AS n_symbols FROM m, k)"""
P2 = f"""{_BASE}
SELECT kind, ref, len(w)::BIGINT AS n_words, CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w), 6) ELSE 0 END AS mean_word_length,
CASE WHEN length(text) > 0 THEN round(n_symbols::DOUBLE / length(text), 6) ELSE 0 END AS symbol_share,
CASE WHEN len(ln) > 0 THEN round(len(list_filter(ln, lambda x: {_ENDED}))::DOUBLE / len(ln), 6) ELSE 0 END AS ended_line_share,
CASE WHEN len(w) > 0 THEN round(n_common::DOUBLE / len(w), 6) ELSE 0 END AS common_word_share FROM n"""

_BARE = "regexp_replace(x, '^[^\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+$', '', 'g')"
_ODD = f"(regexp_matches({_BARE}, '[^\\p{{L}}\\p{{N}}_''’./,()%:;&+–\\-]') OR regexp_matches({_BARE}, '[\\p{{L}}_][0-9]|[0-9][\\p{{L}}_]'))"
P2_FOUND = f"""{_BASE}, r AS (SELECT kind, ref, length(text) AS n, n_common::DOUBLE / greatest(len(w), 1) AS common, len(list_filter(w, lambda x: {_ODD}))::DOUBLE / greatest(len(w), 1) AS odd,
n_symbols::DOUBLE / greatest(length(text), 1) AS symbols, length(text)::DOUBLE / greatest(len(ln), 1) AS line FROM n)
SELECT kind, ref FROM r WHERE n >= 40 AND ((common < 0.165 AND NOT (common >= 0.115 AND line >= 130 AND symbols < 0.045)) OR odd > 0.3 OR (common > 0.42 AND symbols < 0.012) OR symbols > 0.25)"""
