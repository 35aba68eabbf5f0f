import random
import zlib
from collections import Counter

import numpy as np
from corpusflow.llm import packing as P
from tokenizers import Tokenizer

from .fixtures import empty, frame, odd_rows, prose, tokenizer, vocabulary


def check(rows, docs, window):
    coder = Tokenizer.from_file(tokenizer())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, text in docs:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[doc], key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(range(0, len(ids), window)) and all(r["doc_tokens"] == len(ids) for r in own)
        for r in own:
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"]
    for own in by_sequence.values():
        end = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= window
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return sum(r["length"] for r in rows) / (window * len(by_sequence))


def test_pieces_and_places(spark):
    rng = random.Random(1)
    words = vocabulary(rng)
    docs = [(i, prose(rng, words, rng.choice([1, 3, 20, 60, 150, 500]))) for i in range(400)]
    rows = P.pack(spark.createDataFrame(docs, "doc_id long, text string"), tokenizer(), window=256, rows_per_task=50).collect()
    assert check(rows, docs, 256) > 0.97


def test_odd_rows(spark):
    rows = P.pack(frame(spark, odd_rows()), tokenizer(), window=2048, with_ids=True).collect()
    ones = [r for r in rows if r["doc_id"] == 1]
    assert [(r["length"], bytes(r["ids"])) for r in ones] == [(1, b"\x01\0\0\0")]
    assert Counter(r["doc_id"] for r in rows)[4] == 2 and Counter(r["doc_id"] for r in rows)[None] == 2
    assert P.pack(empty(spark), tokenizer()).count() == 0


def test_plan_holds_the_histogram():
    rng = random.Random(2)
    for n in (1, 5, 300, 20_000):
        counts = Counter(min(256, max(1, int(rng.lognormvariate(4, 1)))) for _ in range(n))
        held = Counter()
        for p in P.plan(counts):
            assert p.repeats > 0 and sum(k * m for k, m in p.parts.items()) <= 256
            for k, m in p.parts.items():
                held[k] += m * p.repeats
        assert held == counts
    places = P.runs(P.plan({100: 7, 56: 7, 256: 2}))
    assert sum(high - low for _, low, high, *_ in places) == 16


def test_nnls_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((6, 4)), rng.normal(size=6)
        x = P.nnls(a, b)
        best = min((float(((a[:, list(s)] @ y - b) ** 2).sum()) for s in subsets(4) if len(s) and ((y := np.linalg.lstsq(a[:, list(s)], b, rcond=None)[0]) >= 0).all()), default=float((b**2).sum()))
        assert (x >= 0).all() and abs(float(((a @ x - b) ** 2).sum()) - min(best, float((b**2).sum()))) < 1e-6


def subsets(n):
    return [[i for i in range(n) if k >> i & 1] for k in range(1 << n)]
