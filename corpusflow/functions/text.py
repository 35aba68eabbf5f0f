"""Columns on text: normal forms, hashes, counts, and the identifiers made of them. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as invisible, as white space, as the end of a line.
ZERO_WIDTH = "​‌‍﻿"
SPACE = r"[\s\u001c-\u001f]"
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
CHARS_PER_TOKEN = 4


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def stripped(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return stripped(text_or_empty(text)) == ""


def normalize_text(text: Column) -> Column:
    """Zero-width characters deleted, white space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, ZERO_WIDTH, ""), rf"(?U){SPACE}+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_text(text).cast("binary"), 256)


def bytes_hash(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def word_count(normalized: Column) -> Column:
    """Words of normalised text; 0 for none."""
    return F.when(normalized == "", 0).otherwise(F.size(F.split(normalized, " "))).cast("int")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.char_length(text) / CHARS_PER_TOKEN).cast("int")


def chunk_id(doc_id: Column, role: Column, position: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", doc_id, role, position.cast("string")).cast("binary")), 1, 16)


def context_line(title: Column, heading_path: Column) -> Column:
    """Title and headings joined by ' > ', without empty ends."""
    joined = F.concat_ws(" > ", F.concat(F.array(text_or_empty(title)), heading_path))
    return F.regexp_replace(joined, r"^[ >]+|[ >]+$", "")


def embed_text(context: Column, text: Column) -> Column:
    return F.when(context == "", text).otherwise(F.concat(context, F.lit("\n\n"), text))


def slug(text: Column, longest: int = 80) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""), F.lit(longest))


def is_slug(text: Column) -> Column:
    return text_or_empty(text).rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$")


def sentence_count(text: Column) -> Column:
    """Ends of sentences, 1 at least; dots of abbreviations and inside words don't count."""
    # Abbreviations whose dot ends nothing.
    bare = F.regexp_replace(text, r"(?U)\b(e\.g|i\.e|etc|vs)\.", "")
    bare = F.regexp_replace(bare, r"(?U)(?<=\w)\.(?=\w)", "")
    return F.greatest(F.lit(1), F.regexp_count(stripped(bare), F.lit(r"(?U)[.!?](?:\s|$)")))


def html_escape(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def error_text(kind: Column, message: Column, longest: int = 500) -> Column:
    return F.left(F.concat(kind, F.lit(": "), message), F.lit(longest))


def version_name(version: Column) -> Column:
    return F.concat(F.lit("v"), F.lpad(version.cast("string"), 4, "0"))


def short_hash(hash_: Column) -> Column:
    return F.left(hash_, F.lit(8))


def fallback_text(html: Column) -> Column:
    """Text of a page without its tree: scripts and styles cut out, tags dropped, white space collapsed."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return normalize_text(F.regexp_replace(body, r"(?s)<[^>]+>", " "))


def fallback_title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(F.regexp_like(html, F.lit(r"(?is)<title[^>]*>.*?</title>")), normalize_text(found))


def uses_form(sentence: Column, form: Column) -> Column:
    """The form stands in the sentence as a word, in any case."""
    pattern = F.concat(F.lit(r"(?iU)(?<![\w-])\Q"), F.replace(form, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\w-])"))
    return F.regexp_like(sentence, pattern)
