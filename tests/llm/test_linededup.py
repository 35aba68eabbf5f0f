import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from corpusflow.llm import linededup as D

from .fixtures import empty, frame, odd_rows


def key(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in bare)


def brute(rows, least):
    docs = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if docs[key(x)] < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def lines_of(df):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect()), key=repr)


def corpus(n=200, seed=0):
    rng = random.Random(seed)
    hot = [f"Common line {i}" for i in range(8)]
    return [(i, "\n".join(rng.choice([*hot, f"own {i} {k}", "", f"  {rng.choice(hot).upper()}\t"]) for k in range(rng.randint(1, 12)))) for i in range(n)]


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
    rows = corpus()
    df = frame(spark, [(i, t, "en", "s", 0) for i, t in rows])
    got = D.dedup_lines(df)
    assert lines_of(got) == brute(rows, 10)
    assert set(got.columns) == set(df.columns) - ({"hit_doc", "hit_keys"} if not limit else {"hit_keys"}) | {"n_lines", "n_dropped"}


def test_insert_and_delete_are_reversible(spark):
    first, more = corpus(150), [(1000 + i, t) for i, t in corpus(60, seed=9)]
    df = lambda rows: frame(spark, [(i, t, "en", "s", 0) for i, t in rows], clash=False)
    store = D.LineStore(spark, min_docs=12, shards=4).insert(df(first))
    grown = store.insert(df(more))
    assert lines_of(grown.apply(df(first))) == [x for x in brute(first + more, 12) if x[0] < 1000]
    back = grown.delete(df(more))
    assert lines_of(back.apply(df(first))) == brute(first, 12)
    assert sorted(map(tuple, back.refs.select("key", "n").collect())) == sorted(map(tuple, store.refs.select("key", "n").collect()))
    gone = back.delete(df(first))
    assert gone.refs.count() == 0 and gone.filters.agg({"held": "sum"}).first()[0] in (0, None)


def test_false_positives_are_spared(spark, monkeypatch):
    monkeypatch.setattr(D.CuckooFilter, "contains", lambda self, keys: np.ones(len(keys), bool))
    rows = corpus(60)
    assert lines_of(D.dedup_lines(frame(spark, [(i, t, "en", "s", 0) for i, t in rows], clash=False))) == brute(rows, 10)


def test_filter():
    keys = [hashlib.md5(bytes([i % 256, i // 256])).digest() for i in range(5000)]
    made = D.CuckooFilter.load(D.build_filter(keys[:3000]).dump())
    assert made.contains(D.as_pairs(keys[:3000])).all() and made.contains(D.as_pairs(keys[3000:])).mean() < 0.001
    made.delete(D.as_pairs(keys[:1500]))
    assert made.contains(D.as_pairs(keys[1500:3000])).all() and made.contains(D.as_pairs(keys[:1500])).mean() < 0.001
    assert made.insert(D.as_pairs(keys[:1500])) and made.contains(D.as_pairs(keys[:3000])).all()
    small = D.CuckooFilter.sized(4)
    assert not small.insert(D.as_pairs(keys[:100]))


def test_odd_rows(spark):
    rows = odd_rows()
    got = D.dedup_lines(frame(spark, rows), min_docs=2)
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(rows)
    assert (by[1]["text"], by[1]["n_lines"], by[1]["n_dropped"]) == ("", 1, 0) and by[5]["text"] == "" and by[4]["text"] == "" and by[8]["n_dropped"] == 0
    assert D.dedup_lines(empty(spark)).count() == 0
