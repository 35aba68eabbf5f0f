"""Command line: sync, status, changes, prepare, export, render-list."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.planner import MODES
from .plans.runs import export, prepare, sync
from .plans.tables import events_since, render_targets, section_counts, status_counts, top_paths
from .sources.config import load_source
from .sources.http import Transport, web_transport
from .sources.store import Store


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusflow", description="Keep a corpus of public documents current and prepared.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.add_argument("-c", "--config", required=True, help="YAML file of the source")
        p.add_argument("--root", default=os.environ.get("CORPUSFLOW_ROOT", "./data"), help="folder of the store")
        return p

    p = command("sync", "discover, fetch and classify changes")
    p.add_argument("--mode", choices=MODES, default="incremental")
    p.add_argument("--limit", type=int)
    p.add_argument("--only", help="regex on URLs")
    p.add_argument("--dry-run", action="store_true")
    command("status", "what is stored").add_argument("--sections", action="store_true")
    p = command("changes", "list change events")
    p.add_argument("--since", help="a run; events after it")
    p.add_argument("--event", default="added,updated,removed", help="kinds, with commas, or all")
    p = command("prepare", "make files from stored pages")
    p.add_argument("--profile", required=True)
    p.add_argument("--full", action="store_true")
    p.add_argument("--only", help="regex on URLs")
    p = command("export", "mirror prepared files elsewhere")
    p.add_argument("--what", required=True, help="prepared/<profile>")
    p.add_argument("--to", required=True)
    p = command("render-list", "pages that a renderer would take")
    p.add_argument("--since")
    p.add_argument("--limit", type=int)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, transport: Transport = web_transport, now: Callable[[], dt.datetime] | None = None, sleep: Callable[[float], None] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpusflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    source = load_source(a.config)
    store = Store(spark, a.root, source.name)
    moment = (now or (lambda: dt.datetime.now(dt.timezone.utc)))()
    say = lambda x: print(json.dumps(x, indent=1, default=str))
    if a.command == "sync":
        r = sync(source, store, moment, transport, sleep, a.mode, a.only, a.limit, a.dry_run)
        say({"run_id": r.run_id, "discovered": r.discovered, "planned": r.planned, "counts": r.counts, "dry_run": r.dry_run})
    elif a.command == "status":
        manifest = store.load("manifest")
        out = {"source": source.name, "root": a.root, "last_run": store.history("runs").agg(F.max("run_id")).first()[0], "docs": {r["status"]: r["n"] for r in status_counts(manifest).collect()}}
        if a.sections:
            out["sections"] = {r["section"]: r["n"] for r in section_counts(manifest).collect()}
            out["top_paths"] = {r["folder"]: r["n"] for r in top_paths(manifest).collect()}
        say(out)
    elif a.command == "changes":
        rows = events_since(store.history("events"), a.since, None if a.event == "all" else a.event.split(","))
        for line in rows.orderBy("run_id", "url").toJSON().toLocalIterator():
            print(line)
    elif a.command == "prepare":
        r = prepare(source, store, a.profile, moment.strftime("%Y%m%dT%H%M%SZ"), F.col("url").rlike(a.only) if a.only else None, a.full)
        say({"profile": r.profile, "written": r.written, "unchanged": r.skipped, "removed": r.removed, "failed": r.n_failed, "failures": r.failed, "chunks": r.chunks})
    elif a.command == "export":
        kind, _, profile = a.what.partition("/")
        if kind != "prepared" or not profile:
            raise ValueError("what must be prepared/<profile>")
        say(export(store, a.what, f"{store.root}/prepared_files/{profile}", a.to))
    else:
        for r in render_targets(store.history("events"), store.load("manifest"), spark.createDataFrame([], "url string, raw_path string"), a.since, a.limit).toLocalIterator():
            print(r["url"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
