import datetime as dt
import json

import pytest
from corpusflow import cli
from corpusflow.plans.runs import export, prepare, sync
from corpusflow.plans.tables import events_since
from corpusflow.sources.config import source_from_dict
from corpusflow.sources.readers import read_chunks, read_docs
from corpusflow.sources.store import Store
from corpusflow.streaming import changes
from pyspark.sql import functions as F

from .site import Site, page

CONFIG = {
    "name": "demo",
    "sitemaps": ["https://s.test/sitemap_index.xml"],
    "include": ["^https://s.test/"],
    "exclude": [r"\.pdf$"],
    "fetch": {"delay_seconds": 0, "workers": 2},
    "detect": {"recheck_after_hours": 0},
    "sections": {"/guides/": "fundamentals"},
    "prepare": {"profiles": {"markdown": {"format": "markdown"}, "docs": {"format": "json"}, "chunks": {"format": "chunks", "chunker": "heading", "max_tokens": 40, "overlap_tokens": 8}}},
}
T0 = dt.datetime(2026, 1, 10, 12, tzinfo=dt.timezone.utc)


class Bench:
    def __init__(self, spark, folder, **change):
        self.site = Site(folder)
        self.source = source_from_dict(CONFIG | change)
        self.store = Store(spark, f"file://{folder}/store", "demo")
        self.hours = 0

    def sync(self, hours=1.0, **options):
        self.hours += hours
        return sync(self.source, self.store, T0 + dt.timedelta(hours=self.hours), self.site.transport(), lambda s: None, **options)

    def record(self, name):
        return self.store.load("manifest").where(F.col("url").endswith(name)).first()


@pytest.fixture
def bench(spark, tmp_path):
    return Bench(spark, tmp_path)


def test_lifecycle(bench):
    first = bench.sync()
    assert first.counts == {"added": 2, "blocked": 1} and first.discovered == 3
    a = bench.record("/a")
    assert (a["version"], a["section"], a["doc_id"], a["title"], a["breadcrumbs"]) == (1, "fundamentals", "s.test/guides/a", "A", ["Guides"])
    assert a["raw_path"] == f"raw/s.test/guides/a/v0001_20260110T130000Z_{a['content_hash'][:8]}.html"
    assert bench.store.load("sitemaps").count() == 2

    assert bench.sync().counts == {"unchanged": 2, "blocked": 1}
    assert bench.store.history("raw").count() == 2

    pages = bench.site.state["pages"]
    bench.site.set(pages=pages | {"https://s.test/guides/a": page("A", updated="2026-01-09", bundle="b2.js"), "https://s.test/guides/b": page("B", body="New sentence.")})
    third = bench.sync()
    assert third.counts == {"touched": 1, "updated": 1, "blocked": 1}
    assert (bench.record("/a")["version"], bench.record("/a")["page_last_updated"], bench.record("/b")["version"]) == (1, "2026-01-09", 2)
    event = bench.store.history("events").where("event = 'updated'").first()
    assert event["prev_content_hash"] != event["content_hash"]
    assert [r["version"] for r in bench.store.raw_versions("https://s.test/guides/b").collect()] == [1, 2]

    # One leaves the sitemap and another joins; later a listed page is gone.
    pages = bench.site.state["pages"]
    del pages["https://s.test/guides/a"]
    bench.site.set(pages=pages | {"https://s.test/guides/c": page("C")})
    fourth = bench.sync()
    assert fourth.counts["removed"] == 1 and fourth.counts["added"] == 1
    bench.site.set(gone=["https://s.test/guides/c"])
    assert bench.sync().counts["removed"] == 1
    again = bench.sync()
    assert "removed" not in again.counts  # said once
    assert events_since(bench.store.history("events"), fourth.run_id, ["removed"]).count() == 1
    bench.site.set(gone=[])
    assert bench.sync().counts["added"] == 1 and bench.record("/c")["version"] == 2


def test_recheck_new_only_and_lastmod(spark, tmp_path):
    b = Bench(spark, tmp_path, detect={"recheck_after_hours": 24})
    b.sync()
    b.site.requests()
    b.site.set(pages=b.site.state["pages"] | {"https://s.test/guides/d": page("D")})
    b.sync()
    assert b.site.requests() == ["https://s.test/guides/d"]
    b.site.set(pages=b.site.state["pages"] | {"https://s.test/guides/e": page("E")})
    b.sync(30, mode="new-only")
    assert b.site.requests() == ["https://s.test/guides/e"]
    b.sync(30)
    b.site.requests()
    b.site.set(lastmod={"https://s.test/guides/b": "2026-01-14"})
    b.sync()
    assert b.site.requests() == ["https://s.test/guides/b"]


def test_dry_run_only_limit_and_errors(bench):
    dry = bench.sync(dry_run=True)
    assert dry.counts == {"would_fetch": 3, "would_remove": 0} and bench.store.load("manifest").isEmpty()
    assert bench.sync(only="/guides/", limit=1).counts == {"added": 1}
    bench.site.set(broken=["https://s.test/guides/b"], etags=False)
    counts = bench.sync().counts
    assert counts["error"] == 1 and counts["unchanged"] == 1
    assert bench.record("/b")["status"] == "error" and "connection reset" in bench.record("/b")["error"]
    bench.site.set(broken=[])
    assert bench.sync().counts["added"] == 1 and bench.record("/b")["error"] is None


def test_prepare_and_export(bench, tmp_path, spark):
    bench.sync()
    run = lambda p, **o: prepare(bench.source, bench.store, p, "r1", **o)
    r = run("markdown")
    assert (r.written, r.skipped) == (2, 0)
    folder = tmp_path / "store/demo/prepared_files/markdown/docs/s.test/guides"
    text = (folder / "a.md").read_text()
    assert text.startswith("---\nbreadcrumbs:\n- Guides\n") and text.endswith("---\n\n# A\n\nText.\n\n## More\n\nSecond paragraph of A.\n")
    assert (run("markdown").written, run("markdown").skipped) == (0, 2)
    assert run("docs").written == 2 and run("chunks").chunks >= 2
    docs = read_docs(spark, str(tmp_path / "store/demo/prepared_files/docs")).collect()
    assert {d["title"] for d in docs} == {"A", "B"} and all(d["markdown"].startswith("# ") for d in docs)
    assert read_chunks(spark, str(tmp_path / "store/demo/prepared_files/chunks")).where("text_to_embed like 'A > A%'").count() >= 1

    bench.site.set(pages=bench.site.state["pages"] | {"https://s.test/guides/a": page("A", body="Edited.")})
    bench.sync()
    assert (run("markdown").written, (folder / "a.md").read_text().count("Edited")) == (1, 1)

    source = f"file://{tmp_path}/store/demo/prepared_files/markdown"
    assert export(bench.store, "prepared/markdown", source, f"file://{tmp_path}/out") == {"copied": 2, "unchanged": 0, "deleted": 0}
    assert export(bench.store, "prepared/markdown", source, f"file://{tmp_path}/out") == {"copied": 0, "unchanged": 2, "deleted": 0}
    pages = bench.site.state["pages"]
    del pages["https://s.test/guides/a"]
    bench.site.set(pages=pages)
    bench.sync()
    assert run("markdown").removed == 1 and not (folder / "a.md").exists()
    assert export(bench.store, "prepared/markdown", source, f"file://{tmp_path}/out")["deleted"] == 1
    assert not (tmp_path / "out/docs/s.test/guides/a.md").exists()
    with pytest.raises(KeyError, match="unknown prepare profile"):
        run("none")


def test_stream_refreshes_a_table(bench, spark, tmp_path):
    bench.sync()
    kept = {}

    def load():
        rows = [("s.test/guides/a", "old"), ("s.test/guides/z", "stays")]
        return spark.createDataFrame(kept.get("rows", rows), "doc_id string, text string")

    def save(df):
        kept["rows"] = [tuple(r) for r in df.collect()]

    stream = changes.event_stream(spark, f"{bench.store.root}/events")
    fresh = lambda changed: changed.select("doc_id", F.lit("new").alias("text"))
    for _ in range(2):
        q = changes.refresh(stream, load, fresh, save, f"{tmp_path}/checkpoint").start()
        q.awaitTermination(60)
        assert sorted(kept["rows"]) == [("s.test/guides/a", "new"), ("s.test/guides/b", "new"), ("s.test/guides/z", "stays")]
    batch = changes.counts_by_window(bench.store.history("events"))
    assert {(r["event"], r["n"]) for r in batch.collect()} == {("added", 2), ("blocked", 1)}


def test_command_line(spark, tmp_path, capsys):
    import yaml

    site = Site(tmp_path)
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(CONFIG))

    def run(*argv):
        assert cli.main([*argv[:1], "-c", str(tmp_path / "c.yaml"), "--root", f"file://{tmp_path}/store", *argv[1:]], spark, site.transport(), lambda: T0, lambda s: None) == 0
        return capsys.readouterr().out

    assert json.loads(run("sync"))["counts"] == {"added": 2, "blocked": 1}
    status = json.loads(run("status", "--sections"))
    assert status["docs"] == {"active": 2, "blocked": 1} and status["sections"] == {"fundamentals": 2}
    assert {json.loads(x)["event"] for x in run("changes").splitlines()} == {"added"}
    assert json.loads(run("prepare", "--profile", "chunks"))["written"] == 2
    assert json.loads(run("export", "--what", "prepared/chunks", "--to", f"file://{tmp_path}/out"))["copied"] == 2
    assert run("render-list", "--limit", "1").strip() == "https://s.test/guides/a"


def test_what_a_lost_run_has_committed_stays(bench, monkeypatch):
    from corpusflow.plans import runs

    bench.site.set(pages={f"https://s.test/guides/p{i}": page(f"P{i}") for i in range(7)})
    real, calls = runs._commit, []

    def commit(*args, **options):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("the driver is lost")
        real(*args, **options)

    monkeypatch.setattr(runs, "_commit", commit)
    with pytest.raises(OSError, match="lost"):
        bench.sync(commit_every=3)
    assert bench.store.load("manifest").count() == 6 and bench.store.history("raw").count() == 6 and bench.store.history("events").count() == 6
    bench.site.requests()
    monkeypatch.undo()
    again = bench.sync(commit_every=3, mode="new-only")
    assert again.counts == {"added": 1} and len(bench.site.requests()) == 1
    assert bench.sync(commit_every=2).counts == {"unchanged": 7}


def test_index_tables_and_public_names(spark, bench, tmp_path):
    import corpusflow
    from corpusflow.operators import glossary
    from corpusflow.sources.readers import read_files
    from corpusflow.sources.sinks import load_table, sync_index

    rows = lambda *r: spark.createDataFrame(r, "chunk_id string, text_to_embed string, url string")
    known, sent, gone = spark.createDataFrame([], "chunk_id string, fingerprint string"), [], []
    for now in (rows(("a", "x", "u"), ("b", "y", None)), rows(("a", "x", "u"), ("b", "z", None), ("c", "w", "v"))):
        known = sync_index(now, known, ["url"], lambda df: sent.append({r["chunk_id"] for r in df.collect()}), lambda df: gone.append({r["chunk_id"] for r in df.collect()}))
    sync_index(rows(("b", "z", None)), known, ["url"], lambda df: sent.append({r["chunk_id"] for r in df.collect()}), lambda df: gone.append({r["chunk_id"] for r in df.collect()}))
    assert sent == [{"a", "b"}, {"b", "c"}, set()] and gone == [set(), set(), {"a", "c"}]

    name = "corpusflow_loaded"
    for n in (2, 3):
        assert load_table(spark.range(n), name, path=str(tmp_path / 't')).count() == n
    spark.sql(f"drop table {name}")

    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "f.bin").write_bytes(b"\0x")
    assert [tuple(r) for r in read_files(spark.createDataFrame([("f.bin",)], "target string"), str(tmp_path / "files")).collect()] == [("f.bin", b"\0x")]

    terms = glossary.glossary_frame(spark, [{"id": "b", "term": "B", "plain": "p"}, {"id": "a", "term": "A", "aliases": ["x"]}])
    records = glossary.to_records(terms)
    assert [r["id"] for r in records] == ["b", "a"] and records[1]["aliases"] == ["x"] and "ord" not in records[0]
    assert glossary.get(terms, "a")["term"] == "A" and glossary.get(terms, "z") is None
    assert all(getattr(corpusflow, n) is not None for n in corpusflow.__all__)
    with pytest.raises(AttributeError):
        corpusflow.nothing
