"""Schemas of the stored tables; readers never infer."""

from __future__ import annotations

_ATTACHMENT = "struct<attachment_id:string,filename:string,url:string,sha256:string,size_bytes:bigint,stored_path:string,is_duplicate_of:string>"
_TABLE = "struct<rows:array<array<string>>,has_header:boolean,bbox:array<double>,n_columns:int>"

MANIFEST = f"article_id string, title string, url string, category string, folder string, folder_id string, body_text string, updated_at string, attachments array<{_ATTACHMENT}>, fetched_at string, crawler_version string"
#: Stored with an article but derived from it: dropped when read.
MANIFEST_DERIVED = ("body_char_count", "is_stub", "content_stream")
PAGES = (
    f"doc_id string, page_index int, page_label string, label_source string, text string, tables array<{_TABLE}>, tier string, needs_vision boolean, image_path string, source_article_ids array<string>, "
    "product_family string, doc_type string, model_series array<string>, title string, source_url string, article_url string, category string, folder string, content_stream string"
)
CHUNKS = (
    "chunk_id string, doc_id string, page_index int, page_label string, page_range string, page_span int, label_source string, kind string, is_table boolean, ordinal int, text string, token_count int, "
    "content_hash string, fault_codes array<string>, model_series array<string>, source_article_ids array<string>, product_family string, doc_type string, content_stream string, title string, "
    "source_url string, article_url string, category string, folder string, page_image string, needs_vision boolean"
)
CODES = "code string, code_key string, meaning string, evidence string, product_family string, model_series array<string>, doc_id string, chunk_id string, page_label string, title string, source_url string, article_url string, in_table boolean"
QUERIES = "query_id string, query string, chunk_ids array<string>, answer string, citations array<int>, confidence string, product_family string, latency_ms int, eval_id string"
FEEDBACK = "query_id string, rating string, comment string"
QUESTIONS = "id string, question string, category string, product_family string, model string, expected_source string, expected_page string, must_mention array<string>, must_not_say array<string>, notes string"
