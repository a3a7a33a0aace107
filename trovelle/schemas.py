"""The record types as Spark schemas."""

from __future__ import annotations

# Kinds of source.
SOURCE_TYPES = ("research_paper", "drug_label", "guideline", "standard", "other")

BLOCK = "struct<page:int,section:string,text:string>"
DOCUMENT = (
    f"document_id string, title string, source string, source_type string, blocks array<{BLOCK}>, url string, authors array<string>, "
    "published string, publisher string, license string, extra map<string,string>, ingested_at timestamp"
)
CHUNK = (
    "chunk_id string, document_id string, title string, source string, source_type string, page int, section string, text string, "
    "token_count int, char_start int, char_end int, url string, extra map<string,string>"
)
HIT = "query_id string, chunk_id string, score double, vector_score double, bm25_score double, rerank_score double, rank int, retriever string"
CITATION = "query_id string, marker int, document_id string, document string, title string, page int, section string, snippet string, url string, score double"
TIMINGS = "struct<retrieval_latency:double,rerank_latency:double,generation_latency:double,total_latency:double>"
USAGE = "struct<prompt_tokens:int,completion_tokens:int,total_tokens:int,estimated_cost_usd:double>"
ANSWER = (
    "question string, answer string, citations array<struct<marker:int,document_id:string,page:int,section:string,snippet:string>>, "
    f"contexts array<struct<chunk_id:string,score:double,rank:int>>, confidence double, grounded boolean, strategy string, model string, timings {TIMINGS}, usage {USAGE}"
)
QUESTION = (
    "question_id string, question string, expected_information string, relevant_document_ids array<string>, relevant_chunk_ids array<string>, "
    "must_include_terms array<string>, category string, source_title string, lexical_overlap double, unanswerable boolean"
)
