"""Queries of cleaning, sectioning and scalar text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelle.functions import text as T
from trovelle.operators import chunking, corpus, metrics
from trovelle.plans import sqlparts as S
from trovelle.session import cut, stored

# The passage sizes that are compared.
SWEEP = (300, 500, 800, 1200)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _text(name: str, expr, sql: str) -> None:
    """A text operator over documents: length and digest of what it gives."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        out: Column = expr(F.coalesce("text", F.lit("")))
        return read(spark, sf, "documents").select("doc_id", out.alias("o")).select("doc_id", F.length("o").cast("long").alias("n"), F.md5(F.col("o").cast("binary")).alias("digest"))

    QUERIES[name] = run
    SQL[name] = f"SELECT doc_id, length(o)::BIGINT AS n, md5(o) AS digest FROM (SELECT doc_id, {sql} AS o FROM documents)"


_t = "coalesce(text, '')"
_text("c1_control", lambda c: F.regexp_replace(c, T.CONTROL, " "), S.re_sub(_t, T.CONTROL, "' '"))
_text("c2_ligatures", T.fix_ligatures, S.ligatures(_t))
_text("c3_dehyphenate", lambda c: F.regexp_replace(c, T.HYPHEN_WRAP, "$1$2"), S.wrapped(_t))
_text("c4_links", lambda c: F.regexp_replace(F.regexp_replace(c, T.URL, " "), T.EMAIL, " "), S.links(_t))
_text("c5_references", T.drop_references, S.references(_t))
_text("c6_lines", T.keep_lines, S.keep_lines(_t))
_text("c7_whitespace", T.normalize_whitespace, S.whitespace(_t))
_text("c8_clean", T.clean_text, S.clean("text"))
_text("f2_snippet", T.snippet, S.snippet(_t))
_text("f4_question_spacing", T.collapse, S.collapse(_t))
_text("f13_preview", lambda c: F.substring(c, 1, 600), f"substr({_t}, 1, 600)")


def c7_nfkc(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.md5(T.normalize_whitespace(T.nfkc(F.coalesce("text", F.lit("")))).cast("binary")).alias("digest"))


QUERIES["c7_nfkc"] = c7_nfkc
SQL["c7_nfkc"] = f"SELECT doc_id, md5({S.whitespace(S.nfkc(_t))}) AS digest FROM documents"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.latest_documents(read(spark, sf, "source_documents"))


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.blocks(_docs(spark, sf))


def _headers(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.running_headers(_blocks(spark, sf).select("document_id", F.col("block_idx").alias("page_key"), "text"))


QUERIES["c9_running_headers"] = _headers
_lines = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '')"
_HEADERS = f"""h AS (SELECT document_id, line FROM (SELECT document_id, line, count(*) AS k FROM (
  SELECT document_id, block_idx, unnest(list_distinct(list_concat(ln[1:3], list_reverse(ln)[1:3]))) AS line FROM (SELECT *, {_lines} AS ln FROM b))
  WHERE length(line) BETWEEN 4 AND 120 GROUP BY 1, 2) JOIN (SELECT document_id, count(*) AS n FROM b GROUP BY 1) USING (document_id)
  WHERE n >= 4 AND k >= greatest(2, floor(n * 0.5)))"""
SQL["c9_running_headers"] = f"WITH {S.DOCUMENTS}, {S.BLOCKS}, {_HEADERS} SELECT document_id, line FROM h"


def c10_remove_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of blocks that are not running headers, counted by block."""
    rows = _blocks(spark, sf).select("document_id", "block_idx", F.posexplode(F.split("text", "\n", -1)).alias("i", "raw")).withColumn("line", T.strip(F.col("raw")))
    kept = rows.join(_headers(spark, sf), ["document_id", "line"], "left_anti")
    return kept.groupBy("document_id", "block_idx").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("raw")).alias("n_chars"))


QUERIES["c10_remove_lines"] = c10_remove_lines
SQL["c10_remove_lines"] = f"""WITH {S.DOCUMENTS}, {S.BLOCKS}, {_HEADERS}, l AS (SELECT document_id, block_idx, unnest(string_split(text, chr(10))) AS raw FROM b)
SELECT document_id, block_idx, count(*) AS n_lines, sum(length(raw))::BIGINT AS n_chars FROM l ANTI JOIN h ON l.document_id = h.document_id AND {S.strip('l.raw')} = h.line GROUP BY 1, 2"""


def c11_meaningful(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).select("document_id", "block_idx", T.is_meaningful(F.col("text")).alias("meaningful"))


QUERIES["c11_meaningful"] = c11_meaningful
SQL["c11_meaningful"] = f"""WITH {S.DOCUMENTS}, {S.BLOCKS} SELECT document_id, block_idx, length(text) >= 120 AND
length({S.re_sub('text', r'[^\p{L}\s\p{Z}]', "''")})::DOUBLE / greatest(length(text), 1) >= 0.6 AND len({S.words('text')}) >= 20 AS meaningful FROM b"""


def f1_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tok = read(spark, sf, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return tok.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


QUERIES["f1_tokens"] = f1_tokens
SQL["f1_tokens"] = f"SELECT doc_id, len(t)::BIGINT AS n, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)"


def f3_expand(spark: SparkSession, sf: str) -> DataFrame:
    q = corpus.latest_questions(read(spark, sf, "eval_questions"))
    return q.select("question_id", T.expand_query(F.col("question")).alias("expanded"), T.out_of_scope(F.col("question")).alias("out_of_scope"))


QUERIES["f3_expand"] = f3_expand
SQL["f3_expand"] = f"WITH {S.QUESTIONS} SELECT question_id, {S.expand('question')} AS expanded, length({S.strip('question')}) < 3 OR NOT regexp_matches(question, '\\p{{L}}') AS out_of_scope FROM q"


def f3_expand_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Expansion over texts with abbreviations in them: titles of documents with each abbreviation once a row."""
    words = spark.createDataFrame([(k,) for k in T.ABBREVIATIONS], "abbr string")
    return words.select("abbr", T.expand_query(F.concat(F.lit("Use of "), F.upper("abbr"), F.lit(" and "), F.col("abbr"), F.lit("-related DM?"))).alias("expanded"))


QUERIES["f3_expand_all"] = f3_expand_documents
SQL["f3_expand_all"] = (
    "SELECT abbr, "
    + S.expand("x")
    + " AS expanded FROM (SELECT abbr, 'Use of ' || upper(abbr) || ' and ' || abbr || '-related DM?' AS x FROM (VALUES "
    + ", ".join(f"('{k}')" for k in T.ABBREVIATIONS)
    + ") v(abbr))"
)


def s8_headings(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "line"))
    return lines.where(T.looks_like_heading(F.col("line"))).select("doc_id", F.col("i").cast("long").alias("line_no"), T.strip(F.col("line")).alias("heading"))


QUERIES["s8_headings"] = s8_headings
SQL["s8_headings"] = f"""WITH l AS (SELECT doc_id, x.i - 1 AS line_no, {S.strip('x.s')} AS s FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s, i: struct_pack(s := s, i := i))) AS x FROM documents))
SELECT doc_id, line_no::BIGINT AS line_no, s AS heading FROM l WHERE length(s) BETWEEN 3 AND 80 AND NOT regexp_matches(s, '[.,;]$') AND len({S.words('s')}) <= 10 AND (
(upper(s) = s AND lower(s) <> s) OR (regexp_matches(s, '^[0-9]') AND regexp_matches(s, '\\p{{L}}')) OR
(len({S.words('s')}) >= 2 AND len(list_filter({S.words('s')}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= 0.7 * len({S.words('s')})))"""


def ch_sections(spark: SparkSession, sf: str) -> DataFrame:
    g = chunking.section_groups(_docs(spark, sf))
    return g.select("document_id", F.col("group_id").cast("long").alias("group_id"), "section", F.col("first_block").cast("long").alias("first_block"), "n_blocks")


QUERIES["ch3_section_groups"] = ch_sections
SQL["ch3_section_groups"] = f"""WITH {S.DOCUMENTS}, {S.BLOCKS}, m AS (SELECT *, CASE WHEN block_idx > 0 AND section IS NOT DISTINCT FROM lag(section) OVER (PARTITION BY document_id ORDER BY block_idx) THEN 0 ELSE 1 END AS new FROM b),
g AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY block_idx) AS group_id FROM m)
SELECT document_id, group_id::BIGINT AS group_id, first(section) AS section, min(block_idx)::BIGINT AS first_block, count(*) AS n_blocks FROM g GROUP BY 1, 2"""


def ch_sentences(spark: SparkSession, sf: str) -> DataFrame:
    s = chunking.sentence_rows(_docs(spark, sf))
    return s.select("document_id", "block_idx", "page", F.col("sent_idx").cast("long").alias("sent_idx"), F.md5(F.col("sentence").cast("binary")).alias("digest"), F.col("n_tokens").cast("long").alias("n_tokens"))


QUERIES["ch4_sentences"] = ch_sentences
SQL["ch4_sentences"] = f"""WITH {S.DOCUMENTS}, {S.BLOCKS} SELECT document_id, block_idx, page, x.i - 1 AS sent_idx, md5(x.s) AS digest, {S.n_tokens('x.s')}::BIGINT AS n_tokens FROM (
SELECT document_id, block_idx, page, unnest(list_transform({S.sentences('text')}, lambda s, i: struct_pack(s := s, i := i))) AS x FROM b)"""


def ch_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).select("document_id", "block_idx", T.truncate_tokens(F.col("text"), 40).alias("head"), T.count_tokens(F.col("text")).cast("long").alias("n_tokens"))


QUERIES["ch7_truncate"] = ch_truncate
SQL["ch7_truncate"] = f"WITH {S.DOCUMENTS}, {S.BLOCKS} SELECT document_id, block_idx, {S.truncate('text', 40)} AS head, {S.n_tokens('text')}::BIGINT AS n_tokens FROM b"


def ch_paginate(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.paginate_documents(_docs(spark, sf))


QUERIES["ch1_paginate"] = ch_paginate
# paragraphs (p) one after another: page and what is used of it before the next paragraph (f), blocks as parts of a page
SQL["ch1_paginate"] = f"""WITH RECURSIVE {S.DOCUMENTS}, p0 AS (SELECT document_id, part, section, unnest(ps) AS t, generate_subscripts(ps, 1) AS k, len(ps) AS n FROM
(SELECT document_id, i AS part, blocks[i].section AS section, list_filter(string_split(coalesce(blocks[i].text, ''), chr(10) || chr(10)), lambda x: regexp_matches(x, '[^\\s\\p{{Z}}]')) AS ps FROM (SELECT document_id, blocks, unnest(range(1, len(blocks) + 1)) AS i FROM d))),
p AS MATERIALIZED (SELECT document_id, part, section, length(t) AS l, k = n AS last, row_number() OVER (PARTITION BY document_id ORDER BY part, k) AS i FROM p0),
f AS (SELECT document_id, i, part, section, l, 1 AS page, CASE WHEN last AND l > {int(chunking.CHARS_A_PAGE * chunking.FULL_PAGE)} THEN 2 ELSE 1 END AS next_page, CASE WHEN last AND l > {int(chunking.CHARS_A_PAGE * chunking.FULL_PAGE)} THEN 0 ELSE l END AS used FROM p WHERE i = 1
UNION ALL SELECT document_id, i, part, section, l, page, CASE WHEN full_ THEN page + 1 ELSE page END, CASE WHEN full_ THEN 0 ELSE u + l END FROM (SELECT *, last AND u + l > {int(chunking.CHARS_A_PAGE * chunking.FULL_PAGE)} AS full_ FROM
(SELECT p.*, CASE WHEN turn THEN next_page + 1 ELSE next_page END AS page, CASE WHEN turn THEN 0 ELSE used END AS u FROM (SELECT f.*, f.part AS own, f.page AS mine FROM f) f JOIN p ON p.document_id = f.document_id AND p.i = f.i + 1, LATERAL (SELECT used + p.l > {chunking.CHARS_A_PAGE} AND own = p.part AND mine = next_page AS turn))))
SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY part, page) - 1)::INT AS block_idx, page, any_value(section) AS section, (sum(l) + 2 * count(*) - 2)::INT AS n_chars FROM f GROUP BY document_id, part, page"""


def ch_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(_docs(spark, sf))


QUERIES["ch8_chunks"] = ch_chunks


def ch_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Passage ids made anew from document, place and the digest of the text."""
    c = corpus.latest_chunks(read(spark, sf, "chunks"))
    place = F.split("chunk_id", "::")[1].cast("int")
    return c.select("chunk_id", F.format_string("%s::%04d::%s", "document_id", place, F.substring(F.sha1(F.col("text").cast("binary")), 1, 8)).alias("own_id"))


QUERIES["ch10_ids"] = ch_ids
SQL["ch10_ids"] = f"WITH {S.CHUNKS} SELECT chunk_id, document_id || '::' || printf('%04d', split_part(chunk_id, '::', 2)::INT) || '::' || substr(sha1(text), 1, 8) AS own_id FROM c"


def ch_contextual(spark: SparkSession, sf: str) -> DataFrame:
    from trovelle.operators.index import contextual_text

    return corpus.latest_chunks(read(spark, sf, "chunks")).select("chunk_id", F.md5(contextual_text().cast("binary")).alias("digest"), corpus.citation_label().alias("label"))


QUERIES["ch12_contextual"] = ch_contextual
SQL["ch12_contextual"] = f"WITH {S.CHUNKS} SELECT chunk_id, md5(coalesce(title, '') || chr(10) || coalesce(section, '') || chr(10) || chr(10) || coalesce(text, '')) AS digest, title || ' — p.' || page || ' — ' || section AS label FROM c"


def sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Passage sizes, with an overlap of 15 %: how many passages of which size each target gives, and how well hybrid
    retrieval over them, not reranked, finds the labelled documents. Lists are 20 passages deep, so that recall at 20 is one."""
    from trovelle.plans import pipeline

    out = None
    docs = _docs(spark, sf)
    asked = corpus.latest_questions(read(spark, sf, "eval_questions"))
    rel = metrics.qrels(asked)
    labelled = asked.where(F.exists("relevant_document_ids", lambda d: d.isNotNull())).select(F.col("question_id").alias("query_id"), "question")
    for target in SWEEP:
        cfg = chunking.ChunkConfig(target, int(0.15 * target))
        got = stored(chunking.chunk_documents(docs, cfg).join(docs.select("document_id", "title"), "document_id"))
        row = got.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("token_count").alias("mean_tokens"), F.max("token_count").cast("long").alias("most")).withColumn("target", F.lit(target)).withColumn("overlap", F.lit(cfg.overlap))
        hits = pipeline.search(got, labelled, pipeline.AskConfig("hybrid", False, top_k=20, top_n=20))
        found = metrics.summary(metrics.per_query(metrics.by_document(hits), rel)).select("n_questions", "recall_1", "recall_5", "recall_20", "precision_5", "mrr", "ndcg_5")
        row = cut(row.crossJoin(found))  # each size runs by itself
        out = row if out is None else out.unionByName(row)
    return out


QUERIES["b3_chunk_sweep"] = sweep


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
