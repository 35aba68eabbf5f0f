import random

import pytest
from corpusflow.operators import chunks as C
from pyspark.sql import functions as F


def loop_pack(paras, most, overlap):
    """An independent loop to hold the fold against."""
    size = lambda s: -(-len(s) // 4)
    out, now = [], []
    for p in paras:
        if now and size("\n\n".join([*now, p])) > most:
            out.append("\n\n".join(now))
            keep = 0
            while keep < len(now) and sum(map(size, now[len(now) - keep - 1 :])) <= overlap:
                keep += 1
            now = now[len(now) - keep :] if keep else []
        now = [*now, p]
    return [*out, "\n\n".join(now)] if now else out


@pytest.mark.parametrize("overlap", [0, 8, 40])
def test_pack_equals_a_loop(spark, overlap):
    rng = random.Random(overlap)
    cases = [(i, ["w" * rng.randint(1, 90) for _ in range(rng.randint(0, 25))]) for i in range(150)]
    df = spark.createDataFrame(cases, "i int, paras array<string>")
    got = dict(df.select("i", C.pack(F.col("paras"), 40, overlap)).collect())
    assert all(list(got[i]) == loop_pack(paras, 40, overlap) for i, paras in cases)


def loop_blocks(md):
    kinds, buf, code = [], [], False

    def flush():
        if "\n".join(buf).strip():
            kinds.append(("para", None, "\n".join(buf).strip()))
        buf.clear()

    for line in md.splitlines():
        if line.startswith("```"):
            buf.append(line)
            code = not code
            if not code:
                flush()
        elif code:
            buf.append(line)
        else:
            marks = len(line) - len(line.lstrip("#"))
            if 1 <= marks <= 6 and line[marks : marks + 1].isspace():
                flush()
                kinds.append(("heading", marks, line[marks:].strip()))
            elif not line.strip():
                flush()
            else:
                buf.append(line)
    flush()
    return kinds


def test_blocks_equal_a_loop(spark):
    rng = random.Random(1)
    pool = ["a", "b c", "", " ", "# H", "## Two ", "###### six", "####### no", "#no", "```", "```py", "  x", "text # y"]
    cases = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) + rng.choice(["", "\n"])) for i in range(300)]
    rows = C.blocks(spark.createDataFrame(cases, "doc_id int, markdown string")).orderBy("doc_id", "pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["kind"], r["level"], r["text"]))
    for i, md in cases:
        assert got.get(i, []) == [(k, lv, t) for k, lv, t in loop_blocks(md)], repr(md)


LONG = "# Title\n\nIntro.\n\n## Section A\n\n" + "\n\n".join(f"P{i} " + "word " * 42 for i in range(6)) + "\n\n```sql\nselect 1\n\nfrom t\n```\n\n## Section B\n\nShort."


def test_heading_chunks(spark):
    df = spark.createDataFrame([("d", LONG)], "doc_id string, markdown string")
    rows = C.chunk(df, "heading", max_tokens=120, overlap_tokens=0).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(len(rows)))
    assert rows[0]["heading_path"] == ["Title"] and rows[-1]["heading_path"] == ["Title", "Section B"]
    assert any("```sql\nselect 1\n\nfrom t\n```" in r["text"] for r in rows)
    assert all(len(r["text"]) <= 4 * 130 for r in rows)


def test_records_and_parents(spark):
    df = spark.createDataFrame([("d", LONG, "u", "Doc")], "doc_id string, markdown string, url string, title string")
    records = C.chunk_records(df, "parent_child", child_tokens=100, parent_tokens=400)
    small = C.with_parent_text(records).collect()
    assert sorted(r["parent_text"] + r["chunk_id"] for r in small) == sorted(r["parent_text"] + r["chunk_id"] for r in C.small_to_big(df, child_tokens=100, parent_tokens=400).collect())
    assert len(small) == C.retrieval_rows(records).count() > 2
    assert all(r["text"][:20] in r["parent_text"] for r in small)
    assert len({r["chunk_id"] for r in records.collect()}) == records.count()
    r = records.where("role = 'parent'").orderBy("position").first()
    assert r["text_to_embed"].startswith("Doc > Title\n\n") and r["tokens_est"] == -(-len(r["text"]) // 4)


def test_metadata_goes_once_through_every_chunker(spark):
    df = spark.createDataFrame([("d", LONG, "u", "Doc", ["a", "b"]), ("e", "\n\n\nlate", "v", None, None), ("f", None, "w", "x", None)], "doc_id string, markdown string, url string, title string, breadcrumbs array<string>")
    for name, n in (("none", 2), ("heading", 3), ("fixed", 2), ("parent_child", 4)):
        records = C.chunk_records(df, name)
        got = {(r["doc_id"], r["url"], r["title"], tuple(r["breadcrumbs"])) for r in records.collect()}
        assert got == {("d", "u", "Doc", ("a", "b")), ("e", "v", None, ())} and records.count() >= n
        plan = records._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan


def test_registry(spark):
    C.register_chunker("halves", C.python_chunker(lambda md, **_: [{"text": md[: len(md) // 2]}, {"text": md[len(md) // 2 :]}]))
    df = spark.createDataFrame([("d", "abcd"), ("e", None)], "doc_id string, markdown string")
    assert {(r["doc_id"], r["text"], r["position"]) for r in C.chunk(df, "halves").collect()} >= {("d", "ab", 0), ("d", "cd", 1)}
    with pytest.raises(ValueError, match="registered"):
        C.chunk(df, "none such")
    assert C.chunk(spark.createDataFrame([("d", "  \n"), ("e", None)], "doc_id string, markdown string"), "none").count() == 0
