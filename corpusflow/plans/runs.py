"""Runs over a store: sync, prepare, export. Each is one plan of joins between a fetch or write stage and a commit."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import wanted
from ..operators.chunks import CHUNKERS, chunk_records
from ..operators.html import extract_pages, page_struct
from ..schemas import STATE
from ..sources.config import Source
from ..sources.config import profile as profile_of
from ..sources.http import Politeness, Transport, body_of, fetch_pages, web_transport
from ..sources.readers import file_hashes, read_files
from ..sources.sinks import ENDINGS, delete_files, document_files, write_files
from ..sources.sitemap import discover
from ..sources.store import Store
from .detect import detect, events_of, removal_events, run_counts
from .planner import add_listed, changed_sitemaps, left_frontier, plan
from .tables import doc_rows, mirror_actions, prepare_actions


@dataclass
class RunResult:
    run_id: str
    counts: dict[str, int] = field(default_factory=dict)
    planned: int = 0
    discovered: int = 0
    dry_run: bool = False


def _fresh_id(store: Store, now: dt.datetime) -> str:
    """The run's time, with a suffix if a run of the same second is there already."""
    base = now.strftime("%Y%m%dT%H%M%SZ")
    n, run_id = 0, base
    while store.exists(f"runs/run_id={run_id}"):
        n += 1
        run_id = f"{base}-{n}"
    return run_id


def sync(source: Source, store: Store, now: dt.datetime, transport: Transport = web_transport, sleep: Callable[[float], None] | None = None, mode: str = "incremental", only: str | None = None, limit: int | None = None, dry_run: bool = False, commit_every: int = 5000) -> RunResult:
    """Discovers, plans, and then fetches, classifies and commits the plan in parts of commit_every pages: what a run that
    is lost has committed, the next doesn't fetch again. One page's failure is an event; a sitemap's ends the run."""
    import time

    spark = store.spark
    run_id, at = _fresh_id(store, now), F.lit(now.astimezone(dt.timezone.utc)).cast("timestamp")
    how = Politeness(source.user_agent, source.fetch.delay_seconds, source.fetch.timeout_seconds, source.fetch.max_retries, transport, sleep or time.sleep)
    if source.sitemaps:
        ask = how.asker()
        frontier, bodies = discover(spark, source.sitemaps, lambda url: body_of(ask, url))
    else:
        frontier, bodies = spark.createDataFrame([], "url string, lastmod string, ord long"), spark.createDataFrame([], "url string, body binary")
    if source.urls:
        frontier = add_listed(frontier, spark.createDataFrame([(u, i) for i, u in enumerate(source.urls)], "url string, ord long"))
    held: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return df

    try:
        frontier = keep(frontier.where(wanted(F.col("url"), source.include, source.exclude)))
        manifest = keep(store.load("manifest"))
        todo = keep(plan(frontier, manifest, at, mode, source.detect.recheck_after_hours, only, limit))
        left = keep(left_frontier(manifest, frontier))
        result = RunResult(run_id, discovered=frontier.count(), planned=todo.count(), dry_run=dry_run)
        if dry_run:
            result.counts = {"would_fetch": result.planned, "would_remove": left.count()}
            return result

        known = store.load("sitemaps")
        maps = changed_sitemaps(bodies, known).select("url", "sha256", at.alias("fetched_at"), "body")
        store.save("sitemaps", known.join(maps.select("url"), "url", "left_anti").unionByName(maps))
        parts = max(1, -(-result.planned // commit_every))
        for k in range(parts):
            part = todo.where(F.floor((F.col("priority") - 1) / commit_every) == k) if parts > 1 else todo
            _commit(source, store, how, part, run_id, at, result.counts, first=k == 0)

        gone = removal_events(left, run_id, at)
        if removed := left.count():
            store.append("events", run_id, gone, more=True)
            result.counts["removed"] = result.counts.get("removed", 0) + removed
            records = left.withColumn("status", F.lit("removed")).withColumn("removed_at", at).select(*manifest.columns)
            store.save("manifest", store.load("manifest").join(records.select("url"), "url", "left_anti").unionByName(records))
        store.add_run(run_id, now, mode, result.counts)
        store.delete(f"_work/{run_id}")
        return result
    finally:
        for df in held:
            df.unpersist()


def _commit(source: Source, store: Store, how: Politeness, todo: DataFrame, run_id: str, at: Column, counts: dict[str, int], first: bool) -> None:
    """Fetches a part of the plan and commits what came of it; adds to counts."""
    spark, manifest = store.spark, store.load("manifest")
    # Pages without a version are fetched whatever the server remembers of them.
    fresh = F.col("status").isNull() | (F.col("status") == "removed") | F.col("content_hash").isNull()
    validators = manifest.select("url", F.when(~fresh, F.col("etag")).alias("etag"), F.when(~fresh, F.col("last_modified")).alias("last_modified"))
    fetched = fetch_pages(todo.join(validators, "url", "left"), how, source.respect_robots, tasks=max(1, source.fetch.workers))
    stage = f"{store.root}/_work/{run_id}"
    fetched.write.mode("overwrite").parquet(f"{stage}/fetched")
    fetched = spark.read.schema(fetched.schema).parquet(f"{stage}/fetched")
    page = page_struct(F.col("body"), F.col("url"), source.detect.content_selectors, source.detect.strip_selectors)
    extracted = fetched.join(todo.select("url", "lastmod"), "url").withColumn("_p", page)
    extracted = extracted.select("*", F.col("_p.page").alias("page"), F.col("_p.error").alias("extract_error")).drop("_p")
    found = detect(extracted, manifest, run_id, at, source.sections)
    found.write.mode("overwrite").parquet(f"{stage}/detected")
    found = spark.read.schema(found.schema).parquet(f"{stage}/detected")

    store.append("raw", run_id, found.where("is_version").select("url", "doc_id", "version", "raw_path", "content_hash", F.col("ts").alias("fetched_at"), "body"), more=not first)
    events = events_of(found)
    if not events.isEmpty():
        store.append("events", run_id, events, more=not first)
    records = found.select(*manifest.columns)
    store.save("manifest", manifest.join(records.select("url"), "url", "left_anti").unionByName(records))
    for r in run_counts(found.where(~F.col("is_repeat")).select("run_id", "event")).collect():
        counts[r["event"]] = counts.get(r["event"], 0) + r["n"]


@dataclass
class PrepareResult:
    profile: str
    written: int = 0
    skipped: int = 0
    removed: int = 0
    failed: list[tuple[str, str]] = field(default_factory=list)
    n_failed: int = 0
    chunks: int = 0


def prepare(source: Source, store: Store, profile: str, run_id: str, only: Column | None = None, full: bool = False, folder: str | None = None) -> PrepareResult:
    """Brings a profile's files up to date with the manifest. Pages that fail are left for the next run."""
    options = profile_of(source, profile)
    fmt, name = options.pop("format", "markdown"), options.pop("chunker", "heading")
    if fmt not in ENDINGS:
        raise ValueError(f"profile {profile}: format must be one of {sorted(ENDINGS)}")
    if fmt == "chunks" and name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name!r}; registered: {sorted(CHUNKERS)}")
    folder = folder or f"{store.root}/prepared_files/{profile}"
    manifest, every = store.load("manifest").persist(), store.load("prepared")
    state = every.where(F.col("profile") == profile)
    actions = prepare_actions(manifest, state, only, full).persist()
    result = PrepareResult(profile, skipped=actions.where("action = 'skip'").count())

    work = actions.where("action = 'write'").select("url").join(manifest, "url")
    raw = store.history("raw").select("url", "version", "body")
    pages = extract_pages(work.select("url", "version").join(raw, ["url", "version"]), "body", "url", source.detect.content_selectors, source.detect.strip_selectors, keep=["version"]).persist()
    # All failures are counted, the first by URL are named; the manifest keeps every page's extract_error.
    bad = pages.where("extract_error is not null").select("url", "extract_error")
    result.n_failed, result.failed = bad.count(), [tuple(r) for r in bad.orderBy("url").limit(1000).collect()]
    docs = doc_rows(work, source.name).join(pages.where("extract_error is null").select("url", "markdown"), "url").persist()
    records = None
    if fmt == "chunks":
        records = chunk_records(docs, name, key="url", named_by="doc_id", **options).persist()
        result.chunks = records.count()
    result.written = write_files(document_files(docs, fmt, records), folder).count()
    gone = actions.where("action = 'remove'")
    result.removed = delete_files(gone.select(F.concat(F.lit("docs/"), "doc_id", F.lit(ENDINGS[fmt])).alias("path")), folder).count()
    if result.removed:
        store.append("removed", run_id, gone.select(F.lit(profile).alias("profile"), "url"))
    done = docs.select(F.lit(profile).alias("profile"), "doc_id", "url", "version", "content_hash")
    changed = done.select("url").unionByName(gone.select("url"))
    stays = state.join(changed, "url", "left_anti")
    store.save("prepared", every.where(F.col("profile") != profile).unionByName(stays).unionByName(done).select([x.split()[0] for x in STATE.split(", ")]))
    for df in (manifest, actions, pages, docs, *([records] if records is not None else [])):
        df.unpersist()
    return result


def export(store: Store, what: str, folder: str, to: str) -> dict[str, int]:
    """Mirrors the files of a folder: copies what is new or missing, deletes what it once copied and is gone."""
    spark = store.spark
    current = file_hashes(spark, folder)
    state = store.load("export")
    mine = state.where(F.col("what") == what).select("target", "sha256")
    fs, path = store._hadoop.Path(to).getFileSystem(store._conf), store._hadoop.Path(to)
    existing = file_hashes(spark, to).select("target") if fs.exists(path) else spark.createDataFrame([], "target string")
    actions = mirror_actions(current, mine, existing).persist()
    counts = {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    # The write stage reads the files to copy, and no others.
    write_files(read_files(actions.where("action = 'copy'").select("target"), folder).select(F.col("target").alias("path"), "content"), to).count()
    delete_files(actions.where("action = 'delete'").select(F.col("target").alias("path")), to).count()
    new = current.join(actions.where("action <> 'delete'").select("target"), "target", "left_semi").select(F.lit(what).alias("what"), "target", "sha256")
    store.save("export", state.where(F.col("what") != what).unionByName(new))
    actions.unpersist()
    return {"copied": counts.get("copy", 0), "unchanged": counts.get("unchanged", 0), "deleted": counts.get("delete", 0)}


def load_documents(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The document table after loading prepared documents: the merge of plans.tables on doc_id."""
    from .tables import merge_upsert

    return merge_upsert(target, docs.select(*[F.col(f.name).cast(f.dataType) for f in target.schema]), "doc_id")
