"""Which URLs a run fetches, and which left: joins of the frontier with the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.times import older_than

MODES = ("incremental", "full", "new-only")


def left_frontier(manifest: DataFrame, frontier: DataFrame) -> DataFrame:
    """Active pages of the manifest that the whole frontier doesn't have."""
    return manifest.where("status = 'active'").join(frontier.select("url"), "url", "left_anti")


def is_due(now: Column, recheck_hours: float) -> Column:
    """On frontier columns (lastmod) joined with manifest columns (status, last_checked, sitemap_lastmod)."""
    newer = (F.coalesce("lastmod", F.lit("")) != "") & (F.coalesce("sitemap_lastmod", F.lit("")) < F.col("lastmod"))
    return (F.col("status") == "error") | F.col("last_checked").isNull() | older_than(F.col("last_checked"), now, recheck_hours) | newer


def plan(frontier: DataFrame, manifest: DataFrame, now: Column, mode: str = "incremental", recheck_hours: float = 24.0, only: str | None = None, limit: int | None = None) -> DataFrame:
    """url, lastmod, reason ('added' or 'due'), priority (from 1). frontier: url, lastmod, ord.

    New pages come first in the frontier's order, then those due, longest unchecked first; a full run takes the frontier's
    order. Places are counted in bins of that order (a minute of last_checked, or 50,000 of ord), so no task has the whole
    plan: only the bins' counts are summed in one place. With a limit, sorting stops at so many rows.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    rows = frontier.where(F.col("url").rlike(only)) if only else frontier
    known = manifest.select("url", "status", "last_checked", "sitemap_lastmod")
    rows = rows.join(known, "url", "left")
    fresh = F.col("status").isNull() | (F.col("status") == "removed")
    due = {"incremental": is_due(now, recheck_hours), "full": F.lit(True), "new-only": F.lit(False)}[mode]
    rows = rows.withColumn("reason", F.when(fresh, "added").when(due, "due")).where("reason is not null")
    last = F.when((F.col("reason") == "due") & F.lit(mode != "full"), F.col("last_checked"))
    order = [F.col("reason") == "due", last.asc_nulls_first(), F.col("ord")]
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    return numbered(rows.withColumn("_last", last)).select("url", "lastmod", "reason", "priority")


def numbered(rows: DataFrame, per_bin: int = 50_000) -> DataFrame:
    """rows (reason, _last, ord) with priority, the place from 1 in the order of reason, _last (null first), ord."""
    late = (F.col("reason") == "due").alias("_late")
    minute = F.coalesce(F.floor(F.unix_seconds(F.col("_last").cast("timestamp")) / 60), F.lit(-(1 << 62))).alias("_minute")
    span = F.when(F.col("_last").isNull(), F.floor(F.col("ord") / per_bin)).otherwise(F.lit(-1)).cast("long").alias("_span")
    bins = ["_late", "_minute", "_span"]
    rows = rows.select("*", late, minute, span)
    before = W.Window.orderBy(*bins).rowsBetween(W.Window.unboundedPreceding, -1)
    base = rows.groupBy(*bins).agg(F.count(F.lit(1)).alias("_n")).select(*bins, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(W.Window.partitionBy(*bins).orderBy(F.col("_last").asc_nulls_first(), "ord"))
    return rows.withColumn("_place", place).join(base, bins).withColumn("priority", (F.col("_base") + F.col("_place")).cast("int")).drop(*bins, "_n", "_base", "_place", "_last")


def add_listed(frontier: DataFrame, urls: DataFrame) -> DataFrame:
    """The frontier (url, lastmod, ord) and explicitly listed urls (url, ord) that it doesn't have, each once."""
    own = urls.groupBy("url").agg(F.min("ord").alias("ord")).join(frontier.select("url"), "url", "left_anti")
    last = frontier.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))  # one row
    return frontier.select("url", "lastmod", "ord").unionByName(own.crossJoin(F.broadcast(last)).select("url", F.lit(None).cast("string").alias("lastmod"), (F.col("ord") + F.col("last") + 1).alias("ord")))


def first_entries(entries: DataFrame) -> DataFrame:
    """One row for each url, the first by ord."""
    return entries.groupBy("url").agg(F.min_by("lastmod", "ord").alias("lastmod"), F.min("ord").alias("ord"))


def changed_sitemaps(fetched: DataFrame, known: DataFrame) -> DataFrame:
    """fetched: url, body. url, sha256, changed: whether the body differs from the one known before."""
    now = fetched.select("url", F.sha2("body", 256).alias("sha256"), "body")
    before = known.select("url", F.col("sha256").alias("was"))
    return now.join(before, "url", "left").withColumn("changed", ~F.col("sha256").eqNullSafe(F.col("was"))).drop("was")
