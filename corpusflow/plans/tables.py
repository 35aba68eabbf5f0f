"""Changes of tables without a transactional format: upsert, mirror and incremental decisions as joins that give new rows.

None of these reads and overwrites the same path: they return what the table becomes, and sources.store writes it as a new
snapshot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_upsert(target: DataFrame, source: DataFrame, key: str, version: str = "content_hash", delete_missing: bool = True) -> DataFrame:
    """The target after a merge: source rows that are new, or whose `version` differs, replace; others stay; rows that the
    source lacks go. As with `<>`, a null version on either side is no difference."""
    names = target.columns
    t, s = target.select(F.col(key).alias("_k"), F.struct(*names).alias("t")), source.select(F.col(key).alias("_k"), F.struct(*names).alias("s"))
    both = t.join(s, "_k", "full_outer")
    if delete_missing:
        both = both.where("s is not null")
    differs = F.col("t").isNull() | F.coalesce(F.col(f"t.{version}") != F.col(f"s.{version}"), F.lit(False))
    return both.select(F.when(F.col("s").isNotNull() & differs, F.col("s")).otherwise(F.col("t")).alias("r")).select("r.*")


def merge_actions(target: DataFrame, source: DataFrame, key: str, version: str = "content_hash") -> DataFrame:
    """key, action ('insert', 'update', 'keep', 'delete') of the same merge."""
    t, s = target.select(key, F.col(version).alias("_t"), F.lit(True).alias("_has")), source.select(key, F.col(version).alias("_s"), F.lit(True).alias("_new"))
    action = F.when(F.col("_has").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.coalesce(F.col("_t") != F.col("_s"), F.lit(False)), "update").otherwise("keep")
    return t.join(s, key, "full_outer").select(key, action.alias("action"))


def mirror_actions(current: DataFrame, state: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """target, action ('copy', 'unchanged', 'delete'). current and state: target, sha256; existing: targets that are there
    (all, if not given). Files whose name begins with '_' are not mirrored."""
    name = F.element_at(F.split("target", "/"), -1)
    now = current.where(~F.startswith(name, F.lit("_"))).select("target", F.col("sha256").alias("now"))
    both = now.join(state.select("target", F.col("sha256").alias("was")), "target", "full_outer")
    there: Column = F.lit(True)
    if existing is not None:
        both = both.join(existing.select("target", F.lit(True).alias("_there")), "target", "left")
        there = F.coalesce("_there", F.lit(False))
    return both.select("target", F.when(F.col("now").isNull(), "delete").when(F.col("now").eqNullSafe(F.col("was")) & there, "unchanged").otherwise("copy").alias("action"))


def prepare_actions(manifest: DataFrame, state: DataFrame, only: Column | None = None, full: bool = False, refresh_metadata: bool = False, key: str = "url") -> DataFrame:
    """url, doc_id, action: 'remove' (gone, had output), 'skip' (output is current), 'write'; other pages have no row.

    manifest: url, doc_id, status, raw_path, version, content_hash (and page_last_updated); state: url, version,
    content_hash (and page_last_updated). A full run rewrites everything and still removes what is gone. `key`, a column
    of both, says which output is a page's; state has it once.
    """
    fields = ["version", "content_hash", *(["page_last_updated"] if refresh_metadata else [])]
    rows = manifest.join(state.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields]), F.col(key) == F.col("_key"), "left")
    current = F.col("_key").isNotNull()
    for f in fields:
        current = current & F.col(f).eqNullSafe(F.col(f"_{f}"))
    live = (F.col("status") == "active") & F.col("raw_path").isNotNull()
    chosen = live if only is None else live & only
    action = F.when((F.col("status") == "removed") & F.col("_key").isNotNull(), "remove").when(chosen & current & F.lit(not full), "skip").when(chosen, "write")
    return rows.select("url", "doc_id", action.alias("action")).where("action is not null")


def count_actions(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of highest `order` for each key."""
    body = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*body), order).alias("r")).select(*keys, "r.*")


def doc_rows(manifest: DataFrame, source: str) -> DataFrame:
    """Rows of schemas.DOC from manifest records."""
    none = F.array().cast("array<string>")
    columns: Mapping[str, Column] = {"source": F.lit(source), "breadcrumbs": F.coalesce("breadcrumbs", none), "headings": F.coalesce("headings", none), "fetched_at": F.col("last_changed")}
    names = ["source", "url", "doc_id", "title", "h1", "description", "section", "breadcrumbs", "headings", "page_last_updated", "version", "content_hash", "fetched_at", "word_count"]
    return manifest.select(*[columns.get(n, F.col(n)).alias(n) for n in names])


def refresh_by_events(table: DataFrame, events: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of documents with an event are replaced by their fresh rows (none for removed ones); others stay."""
    changed = events.where(F.col("event").isin("added", "updated", "removed")).select(key).distinct()
    removed = events.where("event = 'removed'").select(key).distinct()
    return table.join(changed, key, "left_anti").unionByName(fresh.join(changed, key, "left_semi").join(removed, key, "left_anti"))


def status_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def section_counts(manifest: DataFrame) -> DataFrame:
    label = F.coalesce(F.nullif("section", F.lit("")), F.lit("unmapped"))
    return manifest.where("status = 'active'").groupBy(label.alias("section")).agg(F.count(F.lit(1)).alias("n"))


def top_paths(manifest: DataFrame, depth: int = 3, n: int = 40) -> DataFrame:
    """The folders with most active pages; ties in order of their first URL."""
    from ..functions.urls import top_folders

    rows = manifest.where("status = 'active'").groupBy(top_folders(F.col("url"), depth).alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("first_url"))
    return rows.orderBy(F.desc("n"), "first_url").limit(n).drop("first_url")


def events_since(events: DataFrame, since: str | None = None, kinds: Sequence[str] | None = ("added", "updated", "removed")) -> DataFrame:
    """Events of later runs, of the kinds asked for (None: all). run_id is the table's partition, so earlier runs aren't read."""
    rows = events if not since else events.where(F.col("run_id") > since)
    return rows if kinds is None else rows.where(F.col("event").isin(*kinds))


def render_targets(events: DataFrame, manifest: DataFrame, done: DataFrame, since: str | None = None, limit: int | None = None) -> DataFrame:
    """url, raw_path of pages to render: changed ones, or all active if there are none; not those done (url, raw_path)."""
    changed = events_since(events, since, ("added", "updated")).where("raw_path is not null")
    newest = latest(changed.select("url", "raw_path", "run_id"), ["url"], "run_id").select("url", "raw_path")
    every = manifest.where("status = 'active' and raw_path is not null").select("url", "raw_path")
    chosen = every if changed.isEmpty() else newest
    rows = chosen.join(done.select("url", "raw_path"), ["url", "raw_path"], "left_anti").orderBy("url")
    return rows if limit is None else rows.limit(limit)
