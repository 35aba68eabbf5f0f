import random
import re
from collections import defaultdict

import numpy as np
import pytest
from corpusflow.llm import jaccard as J
from corpusflow.llm.components import components

from .fixtures import empty, frame, odd_rows, prose, vocabulary


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for a in order:
        for b in order:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, families=12, size=9):
    rng = random.Random(seed)
    words = vocabulary(rng, 900)
    shared = prose(rng, words, 70)
    rows = []
    for _ in range(families):
        base = prose(rng, words, rng.choice([6, 30, 120, 500])).split()
        for k in range(size):
            own = list(base)
            for _ in range(int(len(own) * rng.choice([0, 0.01, 0.02, 0.03, 0.05]))):
                own[rng.randrange(len(own))] = rng.choice(words)
            if k % 4 == 3:
                own = own[: int(len(own) * rng.uniform(0.75, 1))]
            rows.append((len(rows), " ".join(own) + (f" {shared}" if k % 5 == 0 else "")))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(spark, seed):
    rows = near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(frame(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect()}
    assert got == brute(rows)


def test_large_groups_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(J, "PART", 8)
    monkeypatch.setattr(J, "LEAF", 2)
    rows = near_copies(7, families=4, size=40)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(frame(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = odd_rows()
    got = J.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[3]["n_shingles"] == 0 and by[2]["component_id"] == 2
    assert by[6]["component_id"] == 5 and by[4]["n_shingles"] == 1 and by[4]["component_id"] == 4
    assert J.near_duplicates(empty(spark)).count() == 0
    kept = J.keep_one(frame(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 5, 7, 8, None} and kept.columns == frame(spark, rows).columns


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 48, 3000).astype(np.uint64)
    sets = []
    for _ in range(60):
        n = int(rng.integers(300, 2400))
        sets.append(np.unique(rng.permutation(base)[:n]) if rng.random() < 0.5 else np.unique(base[:n]))
    sets.sort(key=len)
    sizes = np.array([len(s) for s in sets])
    tree = J.CountTree(sizes, [J.count_vector(s).tobytes() for s in sets], 80, 100)
    for i in range(len(sets)):
        may = set(tree.above(i, np.ones(len(sets), bool)).tolist())
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert j in may


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: v for k, v in want.items() if near[k] != {k}}
