import gzip

import pytest
from corpusflow.functions import text, times, urls
from corpusflow.plans import detect, planner, tables
from corpusflow.sources import http, readers, sitemap
from corpusflow.sources.config import load_source, profile, source_from_dict
from corpusflow.sources.store import Store
from pyspark.sql import functions as F


def test_config(tmp_path):
    (tmp_path / "s.yaml").write_text("name: a.b-1\nfetch: {workers: 5}\nprepare: {profiles: {p: {format: json}}}\n")
    s = load_source(tmp_path / "s.yaml")
    assert (s.fetch.workers, s.fetch.delay_seconds, s.detect.recheck_after_hours, profile(s, "p")) == (5, 0.5, 24.0, {"format": "json"})
    with pytest.raises(AttributeError):
        s.fetch.workers = 9
    for bad in ({"name": "a b"}, {"name": "a", "colour": 1}, {}, {"name": "a", "fetch": {"speed": 1}}, {"name": "a", "urls": "u"}, {"name": "a", "include": ["("]}, {"name": "a", "fetch": {"workers": "two"}}):
        with pytest.raises((ValueError, TypeError)):
            source_from_dict(bad)


def asker(answers, **options):
    slept, asked = [], []

    def transport(url, headers, timeout):
        asked.append(headers)
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return http.Reply(*a)

    return http.Politeness("me", 0, transport=transport, sleep=slept.append, **options).asker(), slept, asked


def test_retries():
    ask, slept, asked = asker([OSError("x"), (429, b"", {"retry-after": "0"}), (503, b"", {"retry-after": "7"}), (200, b"ok", {})])
    assert ask("u", http.conditions("e", "m")).body == b"ok" and slept == [1.0, 0.0, 7.0]
    assert asked[0]["If-None-Match"] == "e" and asked[0]["If-Modified-Since"] == "m" and http.conditions(None, "") == {}
    ask, slept, _ = asker([(500,)] * 4)
    assert ask("u").status == 500 and slept == [1.0, 2.0, 4.0]
    ask, *_ = asker([OSError("x")] * 4)
    with pytest.raises(http.FetchError):
        ask("u")
    ask, *_ = asker([(404,)])
    with pytest.raises(http.FetchError, match="404"):
        http.body_of(ask, "u")
    assert http.pauses(8)[-3:] == [60.0, 60.0, None] and http.pauses(0) == [None]


def test_asked_wait():
    wait = lambda value, *now: http.asked_wait({"retry-after": value}, *now)
    assert http.asked_wait({}) is None and wait("soon") is None and wait("-3") == 0
    assert wait("Thu, 01 Jan 1970 00:01:40 GMT", lambda: 40.0) == 60


def test_limiter_and_robots():
    now, slept = [0.0], []
    turn = http.paced(2, lambda: now[0], slept.append)
    turn(), turn(), turn()
    assert slept == [2, 4]
    ask, _, asked = asker([(200, b"User-agent: *\nDisallow: /p/", {}), (404,), *[OSError("x")] * 4])
    robots = http.Robots("me", ask)
    robots.learn(["https://h"]), robots.learn(["https://i", "https://h"]), robots.learn(["https://j"])
    assert robots.allow("https://h", "https://h/x") and not robots.allow("https://h", "https://h/p/x") and robots.allow("https://i", "https://i/p/") and robots.allow("https://j", "https://j/")
    assert len(asked) == 6


NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def test_discover(spark):
    files = {
        "i": f"<sitemapindex {NS}><sitemap><loc>a</loc></sitemap><sitemap><loc> b </loc></sitemap><sitemap><loc>i</loc></sitemap></sitemapindex>".encode(),
        "a": gzip.compress(f"<urlset {NS}><url><loc>u1</loc><lastmod> 2026 </lastmod></url><url><lastmod>x</lastmod></url><url><loc>u2</loc><lastmod></lastmod></url></urlset>".encode()),
        "b": f"<urlset {NS}><url><loc>u2</loc><lastmod>late</lastmod></url><url><loc>u3</loc></url></urlset>".encode(),
    }
    frontier, bodies = sitemap.discover(spark, ["i"], files.__getitem__)
    assert [(r["url"], r["lastmod"]) for r in frontier.orderBy("ord").collect()] == [("u1", "2026"), ("u2", None), ("u3", None)]
    assert bodies.count() == 3 and bodies.where("url = 'a'").first()["body"].startswith(b"<urlset")
    more = planner.add_listed(frontier, spark.createDataFrame([("u3", 0), ("x", 1), ("x", 2)], "url string, ord long"))
    assert [r["url"] for r in more.orderBy("ord").collect()] == ["u1", "u2", "u3", "x"]
    known = spark.createDataFrame([("a", "zzz")], "url string, sha256 string")
    assert {r["url"]: r["changed"] for r in planner.changed_sitemaps(bodies, known).collect()} == {"i": True, "a": True, "b": True}


def test_plan_orders_and_checks_mode(spark):
    frontier = spark.createDataFrame([("u1", None, 0), ("u2", None, 1), ("u3", None, 2)], "url string, lastmod string, ord long")
    manifest = spark.createDataFrame([("u1", "active", None, None), ("old", "active", None, None)], "url string, status string, last_checked timestamp, sitemap_lastmod string")
    now = F.lit("2026-01-01").cast("timestamp")
    assert [(r["url"], r["reason"]) for r in planner.plan(frontier, manifest, now).orderBy("priority").collect()] == [("u2", "added"), ("u3", "added"), ("u1", "due")]
    assert [r["url"] for r in planner.left_frontier(manifest, frontier).collect()] == ["old"]
    with pytest.raises(ValueError):
        planner.plan(frontier, manifest, now, mode="never")


@pytest.mark.parametrize(
    ("status", "hash_", "raw", "allowed", "error", "was", "event"),
    [
        (200, "h", "r", False, None, ("active", "h", "r", None), "blocked"),
        (None, None, None, True, "boom", ("active", "h", "r", None), "error"),
        (304, None, None, True, None, ("active", "h", "r", None), "unchanged"),
        (304, None, None, True, None, ("removed", "h", "r", None), "error"),
        (304, None, None, True, None, (None, None, None, None), "error"),
        (404, None, None, True, None, (None, None, None, None), "removed"),
        (410, None, None, True, None, ("active", "h", "r", None), "removed"),
        (500, None, None, True, None, ("active", "h", "r", None), "error"),
        (200, "h", "r2", True, None, ("active", "h", "r", None), "touched"),
        (200, "h", "r", True, None, ("error", "h", "r", None), "unchanged"),
        (200, "h", "r", True, None, ("removed", "h", "r", None), "added"),
        (200, "h", "r", True, None, ("error", None, None, None), "added"),
        (200, "h2", "r2", True, None, ("active", "h", "r", None), "updated"),
    ],
)
def test_decisions(spark, status, hash_, raw, allowed, error, was, event):
    lit = lambda v: F.lit(v) if v is not None else F.lit(None).cast("string")
    old = {k: lit(v) for k, v in zip(("status", "content_hash", "raw_hash", "page_last_updated"), was, strict=True)}
    got = spark.range(1).select(detect.classify(F.lit(status).cast("int"), lit(hash_), lit(raw), lit(None), F.lit(allowed), lit(error), old)).first()[0]
    assert got == event


def test_columns(spark):
    row = spark.range(1).select(
        urls.doc_path(F.lit("https://u@h:8/a b/?q#f")), urls.doc_path(F.lit("https://h")), urls.doc_path(F.lit("https://h/x.html?y/")), text.slug(F.lit("--A b/ç--")), text.normalize_text(F.lit(" a​ \n b ")),
        text.context_line(F.lit(None).cast("string"), F.array(F.lit("A"), F.lit("B"))), text.estimate_tokens(F.lit("abcde")), times.lenient_timestamp(F.lit("2026-01-02T03:04:05Z")).cast("string"), times.lenient_timestamp(F.lit("soon")), text.word_count(F.lit("")),
    ).first()
    assert list(row) == ["u_h_8/a_b/_index", "h/_index", "h/x.html", "A-b", "a b", "A > B", 2, "2026-01-02 03:04:05", None, 0]


def test_merge_and_mirror(spark):
    t = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("c", None, "x")], "k string, content_hash string, v string")
    s = spark.createDataFrame([("a", "1", "y"), ("b", "2", "y"), ("c", "3", "y"), ("d", "1", "y")], t.schema)
    assert {(r["k"], r["v"]) for r in tables.merge_upsert(t, s, "k").collect()} == {("a", "x"), ("b", "y"), ("c", "x"), ("d", "y")}
    assert tables.merge_upsert(tables.merge_upsert(t, s, "k"), s, "k").count() == 4
    assert {tuple(r) for r in tables.merge_actions(t, s.where("k <> 'a'"), "k").collect()} == {("a", "delete"), ("b", "update"), ("c", "keep"), ("d", "insert")}


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", "s")
    assert store.load("export").isEmpty() and store.history("runs").isEmpty() and store.list("raw") == []
    for n in range(4):
        rows = store.load("export").unionByName(spark.createDataFrame([("w", f"t{n}", "h")], "what string, target string, sha256 string"))
        store.save("export", rows)
    assert store.load("export").count() == 4
    assert sum(p.name.startswith("s-") for p in (tmp_path / "s/export").iterdir()) == 2
    event = "ts timestamp, url string, doc_id string, event string, via string, version int, content_hash string, prev_content_hash string, page_last_updated string, raw_path string, error string, extract_error string"
    for run in ("r1", "r2", "r2"):
        store.append("events", run, spark.createDataFrame([(None, run, *[None] * 10)], event))
    later = tables.events_since(store.history("events"), "r1", None)
    assert [r["url"] for r in later.collect()] == ["r2"]
    assert "PartitionFilters: [isnotnull(run_id" in later._jdf.queryExecution().executedPlan().toString()
    store.write_text("x/note.txt", "hello")
    assert store.read_text("x/note.txt") == "hello" and store.list("x") == ["x/note.txt"]


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.pdf").write_bytes(b"pdf")
    (tmp_path / "a/y.txt").write_text("t")
    assert readers.read_binary(spark, f"file://{tmp_path}").count() == 1
    assert {r["target"] for r in readers.file_hashes(spark, f"file://{tmp_path}").collect()} == {"a/x.pdf", "a/y.txt"}
    parsed = spark.sql("""select 'd' doc_id, parse_json('{"document": {"contents": [{"chunk_position": 0, "chunk_to_retrieve": "a", "chunk_to_embed": "T a"}]}}') parsed
        union all select 'e', parse_json('{"error_status": "bad", "document": {"contents": [{"chunk_position": 0}]}}')""")
    assert [tuple(r) for r in readers.parsed_chunks(parsed).collect()] == [("d", 0, "a", "T a")]


def test_render_targets(spark):
    events = spark.createDataFrame([("r1", "u1", "added", "p1"), ("r2", "u1", "updated", "p2"), ("r2", "u2", "removed", None)], "run_id string, url string, event string, raw_path string")
    manifest = spark.createDataFrame([("u1", "active", "p2"), ("u3", "active", "p3")], "url string, status string, raw_path string")
    done = spark.createDataFrame([], "url string, raw_path string")
    get = lambda *a: [tuple(r) for r in tables.render_targets(events, manifest, *a).collect()]
    assert get(done) == [("u1", "p2")] and get(done, "r2") == [("u1", "p2"), ("u3", "p3")] and get(manifest.select("url", "raw_path")) == []
