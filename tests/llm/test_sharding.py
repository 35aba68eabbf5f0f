import random
import zlib
from collections import Counter, defaultdict

from corpusflow.llm import sharding as S

from .fixtures import empty, frame, odd_rows


def held(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert set(by) <= set(range(shards))
    return {k: sum(r["size"] for r in v) for k, v in by.items()}


def test_sizes_slots_and_groups(spark):
    rng = random.Random(0)
    texts = [("é" if i % 7 == 0 else "x") * rng.randint(0, 400) + str(i) for i in range(3000)]
    texts += ["copied text " * 20] * 40
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows = S.shard(frame(spark, docs), 16, rows_per_task=50).collect()
    assert len(rows) == len(docs) and all(r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
    sizes = held(rows, 16)
    mean = sum(sizes.values()) / 16
    assert max(sizes.values()) < 1.05 * mean and min(sizes.values()) > 0.95 * mean
    of = defaultdict(set)
    for r in rows:
        of[texts[r["doc_id"]]].add(r["shard"])
    assert Counter(map(len, of.values()))[1] >= len(of) - 1


def test_one_text_alone(spark):
    rows = S.shard(frame(spark, [(i, "same", "en", "s", 0) for i in range(1600)]), 16).collect()
    sizes = held(rows, 16)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 5 * 12


def test_odd_rows(spark):
    rows = S.shard(frame(spark, odd_rows()), 16).collect()
    assert len(rows) == len(odd_rows())
    held(rows, 16)
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (1, 2)} == {(1, 0)}
    assert S.shard(empty(spark)).count() == 0
