import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpusflow.llm import perplexity as Q

from .fixtures import empty, frame, odd_rows, prose, vocabulary

LABELS = "doc_id long, quality int, toxic int"


class Brute:
    """Interpolated modified Kneser-Ney over characters, by dictionaries."""

    def __init__(self, texts, corpus):
        padded = ["\x02" * 4 + self.clean(t) + "\x03" for t in texts]
        self.counts = {5: Counter(t[i - 4 : i + 1] for t in padded for i in range(4, len(t)))}
        for n in range(4, 0, -1):
            self.counts[n] = Counter(g[-n:] for g in self.counts[n + 1])
        self.v = len(self.counts[1]) + 1
        self.d, self.total, self.cut = {}, {}, {}
        for n, counts in self.counts.items():
            have = [sum(c == k for c in counts.values()) for k in range(5)]
            y = have[1] / (have[1] + 2 * have[2]) if have[1] else 0
            d = []
            for k, fall in ((1, 0.5), (2, 1.0), (3, 1.5)):
                value = k - (k + 1) * y * have[k + 1] / have[k] if have[k] and have[1] else 0
                d.append(value if 0 < value < k else fall)
            self.d[n] = d
            self.total[n], self.cut[n] = defaultdict(int), defaultdict(float)
            for g, c in counts.items():
                self.total[n][g[:-1]] += c
                self.cut[n][g[:-1]] += d[min(c, 3) - 1]

    @staticmethod
    def clean(text):
        return "".join("0" if c in "0123456789" else c for c in " ".join((text or "").lower().split()))

    def p(self, gram):
        n = len(gram)
        lower = self.p(gram[1:]) if n > 1 else 1 / self.v
        total = self.total[n].get(gram[:-1])
        if not total:
            return lower
        c = self.counts[n].get(gram, 0)
        return (c - self.d[n][min(c, 3) - 1] if c else 0) / total + self.cut[n][gram[:-1]] / total * lower

    def loss(self, text):
        t = "\x02" * 4 + self.clean(text) + "\x03"
        return -sum(math.log(self.p(t[i - 4 : i + 1])) for i in range(4, len(t))) / (len(t) - 4)


def corpus(n=120):
    rng = random.Random(5)
    words = vocabulary(rng)
    docs, labels = [], []
    for i in range(n):
        junk = i % 10 == 9
        docs.append((i, " ".join(w + "###" for w in prose(rng, words, 60).split()) if junk else prose(rng, words, 60), "en", "s", 0))
        if i % 3 == 0:
            labels.append((i, 0 if junk else 1, 0))
    return docs, labels


def folds(spark, docs, labels):
    return {r["doc_id"]: r["fold"] for r in Q.folded_documents(docs, labels).collect()}


@pytest.mark.parametrize("head_rows", [3_000_000, 300, 0])
def test_equals_brute_force(spark, head_rows):
    docs, labels = corpus()
    rng = random.Random(9)
    signs = ["".join(chr(rng.randint(0x4E00, 0x4F00)) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    docs += [(1000 + i, " ".join(rng.choice(signs) for _ in range(30)) + "𝒳" * (i % 2), "zh", "s", 0) for i in range(30)]
    docs += [docs[3], docs[3], (None, docs[4][1], "en", "s", 0)]
    labels += [(1000 + i, 1, 0) for i in range(0, 30, 2)]
    df, marks = frame(spark, docs), spark.createDataFrame(labels, LABELS)
    fold = folds(spark, df, marks)
    models = {x: Brute([t for i, t, lang, *_ in docs if fold.get(i) == Q.TRAINED and lang == x], docs) for x in ("en", "zh")}
    texts = {(i, lang): t for i, t, lang, *_ in docs}
    got = Q.classify(df, marks, head_rows=head_rows).collect()
    assert len(got) == len(docs) and sum(r["doc_id"] == 3 for r in got) == 3
    for r in got:
        assert abs(math.log(r["perplexity"]) - models[r["lang"]].loss(texts[r["doc_id"], r["lang"]])) < 1e-4


def test_bounds_equal_brute_force(spark):
    docs, labels = corpus(300)
    df, marks = frame(spark, docs), spark.createDataFrame(labels, LABELS)
    fold = folds(spark, df, marks)
    got = {r["doc_id"]: r for r in Q.classify(df, marks).collect()}
    loss = {i: round(math.log(r["perplexity"]) * 1000) for i, r in got.items()}
    length = {i: int(math.log2(r["n_chars"])) for i, r in got.items()}

    def quantile(ids, own, q):
        ranked = sorted(loss[i] for i in ids)
        weights = Counter()
        for k in range(20):
            weights[ranked[math.ceil((k + 0.5) / 20 * len(ids)) - 1]] += 1 / 20
        for i in ids:
            if length[i] == own:
                weights[loss[i]] += 1 + 20 / sum(length[j] == own for j in ids)
        upto, total = 0, sum(weights.values())
        for x in sorted(weights):
            upto += weights[x]
            if upto >= q * total - 1e-9:
                return x

    held, trained = ([i for i in got if fold[i] == f] for f in (Q.HELD, Q.TRAINED))
    assert len(held) > 10
    for i, r in got.items():
        m, far, tm, tfar = (quantile(ids, length[i], q) for ids, q in ((held, 0.5), (held, 0.9), (trained, 0.5), (trained, 0.1)))
        upper, lower = m + 2 * (far - m), tm - 4 * (tm - tfar)
        assert abs(1000 * math.log(r["upper"]) - upper) < 2 and abs(1000 * math.log(r["lower"]) - lower) < 2  # losses may round apart
        assert r["kept"] == (lower <= loss[i] <= upper) or min(abs(loss[i] - upper), abs(loss[i] - lower)) < 3


def test_rejects_junk_and_keeps_the_rest(spark):
    docs, labels = corpus(300)
    docs += [(900, "again and " * 80, "en", "s", 0), (901, "#### ## %%%", "en", "s", 0), (902, docs[0][1], "en", "s", 0)]
    got = {r["doc_id"]: r["kept"] for r in Q.classify(frame(spark, docs), spark.createDataFrame(labels, LABELS)).collect()}
    junk = {i for i in got if i % 10 == 9} | {900, 901}
    assert not any(got[i] for i in junk) and got[902]
    assert sum(got[i] for i in got if i not in junk) >= 0.96 * (len(got) - len(junk))
    df = frame(spark, docs)
    kept = Q.keep_good(df, spark.createDataFrame(labels, LABELS))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k} and kept.columns == df.columns


def test_short_texts_and_small_languages_are_judged(spark):
    """The same rule for every length and language: theirs lean on the others."""
    docs, labels = corpus(400)
    rng = random.Random(8)
    words = vocabulary(rng)
    docs += [(2000 + i, prose(rng, words, 60), "xx", "s", 0) for i in range(12)] + [(2100, "@@ ## $$ %% " * 30, "xx", "s", 0), (2101, "@#%", "en", "s", 0)]
    labels += [(2000 + i, 1, 0) for i in range(12)]
    df, marks = frame(spark, docs), spark.createDataFrame(labels, LABELS)
    assert any(f == Q.HELD for i, f in folds(spark, df, marks).items() if 2000 <= i < 2012)
    got = {r["doc_id"]: r for r in Q.classify(df, marks).collect()}
    assert not got[2100]["kept"] and not got[2101]["kept"] and sum(got[2000 + i]["kept"] for i in range(12)) >= 10


def test_trust(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, 1, 0), (3, 1, 0), (None, 1, 0), (4, None, None)], LABELS)
    docs = frame(spark, [(i, "t", "en", "s", 0) for i in (1, 2, 3, 4, None)])
    assert {r["doc_id"] for r in Q.folded_documents(docs, labels).collect() if r["fold"] != Q.OTHER} == {3}


def test_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1, 0)], LABELS)
    for head_rows in (3_000_000, 50):
        got = Q.classify(frame(spark, odd_rows()), labels, head_rows=head_rows).collect()
        assert len(got) == len(odd_rows()) and all(r["kept"] for r in got)
        assert {r["perplexity"] for r in got if r["lang"] == "ja"} == {None}
    assert Q.classify(empty(spark), labels).count() == 0
    assert Q.classify(frame(spark, odd_rows()), spark.createDataFrame([], LABELS)).count() == len(odd_rows())


def test_table():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 60, 5000)).astype(np.uint64)
    table = Q.GramTable(keys, np.arange(len(keys), dtype=float) + 1)
    assert (table.get(keys) == np.arange(len(keys)) + 1).all() and np.isnan(table.get(np.array([1, 7], np.uint64))).all()
