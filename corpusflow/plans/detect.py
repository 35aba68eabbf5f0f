"""What became of each fetched page: one CASE over responses joined with the manifest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bytes_hash, short_hash, version_name
from ..functions.times import compact
from ..functions.urls import doc_path, section_of

# Kinds of events that are stored; 'unchanged' is only counted.
STORED = ("added", "updated", "touched", "removed", "blocked", "error")


def classify(status: Column, content_hash: Column, raw_hash: Column, last_updated: Column, allowed: Column, error: Column, was: Mapping[str, Column]) -> Column:
    """The event of one response, by the first rule that holds. was: status, content_hash, raw_hash, page_last_updated."""
    new = is_new(was)
    same = ~new & content_hash.eqNullSafe(was["content_hash"])
    moved = ~raw_hash.eqNullSafe(was["raw_hash"]) | ~last_updated.eqNullSafe(was["page_last_updated"])
    return (
        F.when(~F.coalesce(allowed, F.lit(True)), "blocked")
        .when(error.isNotNull(), "error")
        .when((status == 304) & ~new, "unchanged")
        .when(status.isin(404, 410), "removed")
        .when(~status.eqNullSafe(F.lit(200)), "error")
        .when(same & moved, "touched")
        .when(same, "unchanged")
        .when(new, "added")
        .otherwise("updated")
    )


def is_new(was: Mapping[str, Column]) -> Column:
    return was["status"].isNull() | (was["status"] == "removed") | (F.coalesce(was["content_hash"], F.lit("")) == "")


def detect(responses: DataFrame, manifest: DataFrame, run_id: str, now: Column, sections: Mapping[str, str] | None = None) -> DataFrame:
    """One row a response with its event and the manifest record that follows.

    responses: schemas.RESPONSE, lastmod, and `page` (struct of schemas.PAGE) with extract_error. Columns: run_id, event,
    via, prev_content_hash, body, is_version, and those of schemas.MANIFEST. A page that is listed but gone gives its event
    once: later rows that say nothing new have is_repeat true. An error that isn't the site's leaves the status of a page
    with content as it was.
    """
    old = manifest.select(F.col("url").alias("_url"), F.struct(*[c for c in manifest.columns]).alias("was"))
    rows = responses.join(old, F.col("url") == F.col("_url"), "left").drop("_url")
    was = {c: F.col(f"was.{c}") for c in manifest.columns}
    raw = F.when(F.col("body").isNotNull(), bytes_hash(F.col("body")))
    event = classify(F.col("status"), F.col("page.content_hash"), raw, F.col("page.last_updated"), F.col("allowed"), F.col("error"), was)
    rows = rows.withColumn("_raw", raw).withColumn("event", event).withColumn("_new", is_new(was))
    version = F.col("event").isin("added", "updated")
    answered = F.col("event").isin("added", "updated", "touched") | ((F.col("event") == "unchanged") & (F.col("status") == 200))
    number = F.when(version, F.coalesce(was["version"], F.lit(0)) + 1).otherwise(was["version"])
    doc_id = doc_path(F.col("url"))
    raw_path = F.concat(F.lit("raw/"), doc_id, F.lit("/"), version_name(number), F.lit("_"), compact(now), F.lit("_"), short_hash(F.col("page.content_hash")), F.lit(".html"))
    fresh = lambda new, name: F.when(answered, new).otherwise(was[name])
    status = F.when(F.col("event").isin("blocked", "removed", "error"), F.col("event")).otherwise("active")
    # A page that had content keeps its status when only the work on it failed.
    kept = F.coalesce("unexpected", F.lit(False)) & was["content_hash"].isNotNull()
    status = F.when((F.col("event") == "error") & kept, was["status"]).otherwise(status)
    record = {
        "doc_id": doc_id,
        "section": section_of(F.col("url"), sections or {}),
        "status": status,
        "sitemap_lastmod": F.coalesce(F.nullif("lastmod", F.lit("")), was["sitemap_lastmod"]),
        "first_seen": F.coalesce(was["first_seen"], now),
        "last_checked": now,
        "last_changed": F.when(version, now).otherwise(was["last_changed"]),
        "removed_at": F.when(F.col("event") == "removed", now).otherwise(was["removed_at"]),
        "http_status": F.coalesce(F.col("status"), was["http_status"]),
        "etag": fresh(F.col("etag"), "etag"),
        "last_modified": fresh(F.col("last_modified"), "last_modified"),
        "raw_hash": fresh(F.col("_raw"), "raw_hash"),
        "content_hash": F.when(version, F.col("page.content_hash")).otherwise(was["content_hash"]),
        "version": number,
        "raw_path": F.when(version, raw_path).otherwise(was["raw_path"]),
        "page_last_updated": fresh(F.col("page.last_updated"), "page_last_updated"),
        "final_url": fresh(F.coalesce("final_url", "url"), "final_url"),
        "error": F.when(F.col("event") == "error", F.coalesce("error", F.concat(F.lit("HTTP "), F.col("status").cast("string")))),
        "extract_error": fresh(F.col("extract_error"), "extract_error"),
    }
    record |= {c: fresh(F.col(f"page.{c}"), c) for c in ("title", "h1", "canonical", "description", "breadcrumbs", "headings", "word_count", "selector")}
    via = F.when(F.col("status").isin(304, 404, 410) & F.col("event").isin("unchanged", "removed"), F.col("status").cast("string"))
    repeat = (F.col("event") == "removed") & (was["status"] == "removed")
    return rows.select(
        F.lit(run_id).alias("run_id"), now.alias("ts"), "event", via.alias("via"), was["content_hash"].alias("prev_content_hash"), version.alias("is_version"), F.coalesce(repeat, F.lit(False)).alias("is_repeat"),
        F.when(version, F.col("body")).alias("body"), "url", *[record[c].alias(c) for c in manifest.columns if c != "url"],
    )


def events_of(detected: DataFrame) -> DataFrame:
    """Rows of schemas.EVENT that are stored."""
    rows = detected.where(F.col("event").isin(*STORED) & ~F.col("is_repeat"))
    carries = F.col("event").isin("added", "updated", "touched")
    return rows.select(
        "run_id", "ts", "url", "doc_id", "event", "via", F.when(carries, F.col("version")).alias("version"), F.when(carries, F.col("content_hash")).alias("content_hash"),
        F.when(F.col("is_version"), F.col("prev_content_hash")).alias("prev_content_hash"), F.when(carries, F.col("page_last_updated")).alias("page_last_updated"),
        F.when(F.col("is_version"), F.col("raw_path")).alias("raw_path"), F.when(F.col("event") == "error", F.col("error")).alias("error"), F.when(F.col("is_version"), F.col("extract_error")).alias("extract_error"),
    )


def removal_events(left: DataFrame, run_id: str, now: Column) -> DataFrame:
    """Rows of schemas.EVENT for pages that left the frontier."""
    null = lambda c: F.lit(None).cast("string").alias(c)
    return left.select(F.lit(run_id).alias("run_id"), now.alias("ts"), "url", "doc_id", F.lit("removed").alias("event"), null("via"), "version", *map(null, ("content_hash", "prev_content_hash", "page_last_updated", "raw_path", "error", "extract_error")))


def run_counts(events: DataFrame) -> DataFrame:
    """run_id, event, n."""
    return events.groupBy("run_id", "event").agg(F.count(F.lit(1)).alias("n"))
