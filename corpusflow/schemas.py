"""Schemas of the tables. They are always given, never inferred: an empty array infers badly."""

from __future__ import annotations

from pyspark.sql import types as T

PAGE = "url string, title string, h1 string, canonical string, description string, last_updated string, breadcrumbs array<string>, headings array<string>, markdown string, text string, content_hash string, selector string, word_count int"
MANIFEST = (
    "url string, doc_id string, section string, status string, sitemap_lastmod string, first_seen timestamp, last_checked timestamp, last_changed timestamp, removed_at timestamp, "
    "http_status int, etag string, last_modified string, raw_hash string, content_hash string, version int, raw_path string, title string, h1 string, canonical string, description string, "
    "breadcrumbs array<string>, headings array<string>, word_count int, page_last_updated string, selector string, final_url string, error string, extract_error string"
)
EVENT = "run_id string, ts timestamp, url string, doc_id string, event string, via string, version int, content_hash string, prev_content_hash string, page_last_updated string, raw_path string, error string, extract_error string"
RAW = "url string, doc_id string, version int, raw_path string, content_hash string, fetched_at timestamp, body binary"
SITEMAP = "url string, sha256 string, fetched_at timestamp, body binary"
RUN = "run_id string, started timestamp, mode string, counts map<string,bigint>"
DOC = "source string, url string, doc_id string, title string, h1 string, description string, section string, breadcrumbs array<string>, headings array<string>, page_last_updated string, version int, content_hash string, fetched_at timestamp, word_count int"
CHUNK = (
    "chunk_id string, doc_id string, url string, title string, section string, breadcrumbs array<string>, heading_path array<string>, position int, role string, parent_id string, "
    "text string, text_to_embed string, tokens_est int, version int, content_hash string, page_last_updated string"
)
TERM = "id string, term string, plain string, say_it string, aliases array<string>, customer_line string, source_urls array<string>, general boolean, domain string, related array<string>"
CONCEPT = "id string, name string, plain string, one_liner string, claims array<struct<text:string,source_urls:array<string>>>, shape string, domain string, citations array<string>"
CARD = "concept_id string, anchor_id string, anchor_label string, bridge string, where_it_breaks string, check struct<q:string,a:string>, mapping array<struct<concept:string,maps_to:string>>, teaching_score int, teaching_reason string"
SCORE = "concept_id string, anchor_id string, score int"
STATE = "profile string, doc_id string, url string, version int, content_hash string"
RESPONSE = "url string, status int, body binary, etag string, last_modified string, final_url string, allowed boolean, error string, unexpected boolean"


def struct_of(ddl: str) -> T.StructType:
    """A schema of plain columns and arrays of strings as a type; needs no session, so executors can use it too."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])
