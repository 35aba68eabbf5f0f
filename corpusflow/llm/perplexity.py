"""Quality classifier: an interpolated modified Kneser-Ney model over characters, one for each language.

Trained on three quarters of the documents that the labels trust (by a hash of doc_id). One pass over all documents
collects, for each task, the distinct 5-grams, how often they occur and how often trusted text has them; counts, contexts
and continuation counts of the five orders are then made by joins and aggregations sharded by n-gram, which give the
probability of every 5-gram that occurs in the corpus. A second pass adds up each document's log-probabilities. The
commonest 5-grams, `head_rows` at most (12 bytes each), are sent to all tasks; the others' occurrences leave the pass as
rows and are joined with the sharded table by 5-gram, so a hot one is never shuffled, no text is, and no machine holds more
than the head, whatever the corpus has.

A document is rejected when its log-perplexity lies beyond quantiles of its language and length (doubling classes of the
number of characters, since the mean of a few scatters more): above, of trusted documents that the model wasn't trained
on, median + `width` * (0.9 quantile - median); below, of those that it was trained on, as their copies are as likely,
median - `depth` * (median - 0.1 quantile). A class of few documents leans on the same class in all languages, weighing
as much as `lean` documents, and on all classes (at twenty points), weighing one: deviations from the language's median are pooled. So every
length and language is judged by the same rule.

Text is read as lower-case characters (whole code points) with white space collapsed and digits as 0. 5-grams are told
apart by 64 bits in a task's memory.

Edge cases: null or empty text is the end mark alone. A null language is a language of its own. A language without trusted
documents, or with none to take quantiles from, rejects nothing. Labels that contradict each other aren't trusted. Null
doc_ids aren't. Repeated rows are scored each. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialize, own_memory, settled, slices, small_batches, tables_written, trim

ORDER, BITS = 5, 21
START, END = 2, 3
#: Parts of the trusted documents: what the model is trained on, and what bounds are taken from.
OTHER, TRAINED, HELD = 0, 1, 2
#: Points that stand for the deviations of all documents.
POINTS = 20
#: Trusted ids that are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 4_000_000
_NO_LANG = "\u0000"


def char_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between four start marks and an end mark, and where each text ends."""
    clean = [" ".join((t or "").lower().split()) for t in texts]
    frame = chr(START) * (ORDER - 1)
    codes = np.frombuffer("".join([f"{frame}{t}{chr(END)}" for t in clean]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes[(codes >= 48) & (codes <= 57)] = 48
    return codes, np.cumsum([len(t) + ORDER for t in clean])


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 5-gram that ends at each character: its first two code points, its last three, and whether there is one (not at
    start marks)."""
    low, high = codes.copy(), np.zeros(len(codes), np.int64)
    for back in range(1, ORDER):
        part = low if back < 3 else high
        part[back:] |= codes[:-back] << (BITS * (back % 3))
    return high, low, codes != START


def keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """64-bit keys of 5-grams."""
    with np.errstate(over="ignore"):
        x = (low.view(np.uint64) ^ (high.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def folded_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs' doc_id, lang, text, and fold: TRAINED or HELD if labelled of quality 1 and not toxic by every label there is."""
    good = labels.groupBy(F.col("doc_id").alias("good")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0 and good is not null").select("good", F.when(F.pmod(F.xxhash64(F.col("good").cast("long")), F.lit(4)) == 0, HELD).otherwise(TRAINED).alias("part"))
    good = materialize(good, "lm-trusted")
    few = good.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit(_NO_LANG)).alias("lang"), "text")
    return rows.join(F.broadcast(good) if few else good, F.col("doc_id") == F.col("good"), "left").select("doc_id", "lang", "text", F.coalesce("part", F.lit(OTHER)).alias("fold"))


def corpus_grams(rows: DataFrame) -> DataFrame:
    """lang, high, low, n, c: every 5-gram of the corpus, how often it occurs, and how often in what the model is trained on."""
    names = ["key", "high", "low", "n", "c"]

    def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        key, high, low, n, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        at = order[first]
        return [key[first], high[at], low[at], *(np.add.reduceat(x[order], first) if len(first) else x for x in (n, c))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory("grams")
        held: dict[str, list[list[np.ndarray]]] = {}

        def out(lang: str) -> pa.RecordBatch:
            found = merged(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(found[0]), pa.string()), *map(pa.array, found[1:])], ["lang", *names[1:]])

        for batch in batches:
            for part in slices(batch, "text", 500, 2 << 20):
                own: dict[tuple[str, bool], list[str | None]] = {}
                for lang, text, fold in zip(*(part.column(c).to_pylist() for c in ("lang", "text", "fold")), strict=True):
                    own.setdefault((lang, fold == TRAINED), []).append(text)
                for (lang, trained), texts in own.items():
                    high, low, real = grams(char_codes(texts)[0])
                    high, low = high[real], low[real]
                    key, at, n = np.unique(keys(high, low), return_index=True, return_counts=True)
                    mine = held.setdefault(lang, [])
                    mine.append([key, high[at], low[at], n, n * trained])
                    if sum(len(x[0]) for x in mine[1:]) > 300_000:
                        held[lang] = [merged(mine)]
                        if len(held[lang][0][0]) > 600_000:
                            yield out(lang)
        for lang in list(held):
            yield out(lang)

    return rows.select("lang", "text", "fold").mapInArrow(run, "lang string, high long, low long, n long, c long").groupBy("lang", "high", "low").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 by Chen and Goodman's estimates from the counts of counts; within (0, count) where those fail."""
    n = [F.sum((F.col("c") == i).cast("long")).cast("double").alias(f"n{i}") for i in range(1, 5)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def of(i: int, fall: float) -> F.Column:
        value = F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))
        return F.when((value > 0) & (value < i), value).otherwise(F.lit(fall)).alias(f"d{i}")

    return counts.groupBy("lang").agg(*n).select(F.col("lang").alias("of"), of(1, 0.5), of(2, 1.0), of(3, 1.5))


def _last(order: int) -> tuple[F.Column, F.Column]:
    """high and low of the last `order` characters of a gram."""
    mask = lambda n: F.lit((1 << (BITS * n)) - 1)
    return F.col("high").bitwiseAND(mask(max(0, order - 3))), F.col("low").bitwiseAND(mask(min(3, order)))


def _before() -> tuple[F.Column, F.Column]:
    """high and low of a gram without its last character."""
    carried = F.shiftleft(F.col("high").bitwiseAND(F.lit((1 << BITS) - 1)), 2 * BITS)
    return F.shiftright("high", BITS), carried.bitwiseOR(F.shiftright("low", BITS))


def _named(pair: tuple[F.Column, F.Column], high: str, low: str) -> list[F.Column]:
    return [pair[0].alias(high), pair[1].alias(low)]


def gram_probabilities(corpus: DataFrame) -> DataFrame:
    """lang, high, low, n, logp (natural) for every 5-gram of the corpus, in languages with trusted text."""
    key = ["lang", "high", "low"]
    # Counts of each order: of the highest, occurrences; of the others, distinct characters before them.
    counts = {ORDER: corpus.where("c > 0").select(*key, "c")}
    for order in range(ORDER - 1, 0, -1):
        counts[order] = materialize(counts[order + 1].groupBy("lang", *_named(_last(order), "high", "low")).agg(F.count(F.lit(1)).alias("c")), f"lm-{order}")
    vocabulary = counts[1].groupBy(F.col("lang").alias("vlang")).agg((F.count(F.lit(1)) + 1).cast("double").alias("v"))
    known = None
    for order in range(1, ORDER + 1):
        # One row a language at most.
        kinds = F.broadcast(_discounts(counts[order]))
        c = F.col("c")
        parts = counts[order].join(kinds, F.col("lang") == F.col("of")).select(*key, *_named(_before(), "chigh", "clow"), "c", F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))
        contexts = parts.groupBy("lang", "chigh", "clow").agg(F.sum("c").alias("total"), F.sum("d").alias("cut")).select("lang", "chigh", "clow", "total", (F.col("cut") / F.col("total")).alias("rest"))
        seen = parts.select(*key, (c - F.col("d")).alias("own"))
        held = [*key, "n"] if order == ORDER else key
        wanted = corpus.select(*held) if order == ORDER else corpus.select("lang", *_named(_last(order), "high", "low")).distinct()
        wanted = wanted.select(*held, *_named(_before(), "chigh", "clow"), *_named(_last(max(1, order - 1)), "shigh", "slow"))
        scored = wanted.join(contexts, ["lang", "chigh", "clow"], "left").join(seen, key, "left")
        if known is None:
            scored = scored.join(F.broadcast(vocabulary), F.col("lang") == F.col("vlang")).withColumn("lower", 1.0 / F.col("v"))
        else:
            scored = scored.join(known.select("lang", F.col("high").alias("shigh"), F.col("low").alias("slow"), F.col("p").alias("lower")), ["lang", "shigh", "slow"])
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise(F.coalesce(F.col("own"), F.lit(0.0)) / F.col("total") + F.col("rest") * F.col("lower"))
        known = materialize(scored.select(*held, p.alias("p")), f"lm-p{order}")
    return known.select(*key, "n", F.log("p").alias("logp"))


class GramTable:
    """Values by 64-bit keys: levels of direct-address tables, each for the keys that collided in the one before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.levels = keys, values, []
        left, bits = np.arange(len(keys), dtype=np.int32), max(8, int(len(keys)).bit_length() + 1)
        while len(left):
            mul = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x51ED270B0 * len(self.levels))
            slot = np.full(1 << bits, -1, np.int32)
            at = self._at(keys[left], mul, bits)
            slot[at] = left
            self.levels.append((slot, mul, bits))
            left = left[slot[at] != left]
            bits = max(8, int(len(left)).bit_length() + 1)

    @staticmethod
    def _at(keys: np.ndarray, mul: np.uint64, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * mul) >> np.uint64(64 - bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, nan for keys that aren't there."""
        out = np.full(len(keys), np.nan)
        if not len(self.keys):
            return out
        ask = None
        for slot, mul, bits in self.levels:
            own = keys if ask is None else keys[ask]
            found = slot[self._at(own, mul, bits)]
            hit = (found >= 0) & (self.keys[found] == own)
            if ask is None:
                out = np.where(hit, self.values[found], np.nan)
                ask = np.flatnonzero(~hit)
            else:
                out[ask[hit]] = self.values[found[hit]]
                ask = ask[~hit]
            if not len(ask):
                break
        return out


def common_grams(table: DataFrame, head_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The table's commonest 5-grams, head_rows at most, and the others (None if there are none). Counts are told apart in
    steps of an eighth of a doubling, so the driver sees a few hundred numbers."""
    step = F.floor(8 * F.log2("n")).cast("int")
    steps = sorted(table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True)
    total, least = 0, None
    for step_no, k in steps:
        total += k
        if total > head_rows:
            break
        least = step_no
    if total <= head_rows:
        return table, None
    return (table.where(step >= least) if least is not None else table.limit(0)), (table.where(step < least) if least is not None else table)


def scores(rows: DataFrame, table: DataFrame, head_rows: int = 3_000_000) -> DataFrame:
    """doc_id, lang, fold, n_chars (with the end mark), logp of every document (null in a language without a model)."""
    spark = rows.sparkSession
    head, tail = common_grams(table, head_rows)
    at_driver = head.select("lang", "high", "low", F.col("logp").cast("float").alias("logp")).toArrow()
    # Languages as numbers: a million strings would be the largest part of all this.
    coded = at_driver.column("lang").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    key, value = keys(at_driver.column("high").to_numpy(), at_driver.column("low").to_numpy()), at_driver.column("logp").to_numpy()
    models = {r[0]: (np.zeros(0, np.uint64), np.zeros(0, np.float32)) for r in table.select("lang").distinct().collect()}
    models |= {name: (key[lang == i], value[lang == i]) for i, name in enumerate(names)}
    del at_driver, coded, lang, key, value
    sent = spark.sparkContext.broadcast(models)
    del models
    trim()
    names = ["doc_id", "lang", "fold", "print"]
    done = rows.withColumn("print", F.xxhash64("text")).select(*names, "text").mapInArrow(_scorer(sent), "doc_id long, lang string, fold int, print long, n_chars long, logp double, highs array<long>, lows array<long>")
    if tail is None:
        return done.select("doc_id", "lang", "fold", "n_chars", "logp")
    # Rows that are alike in all this have equal texts, so a group gives its sum as often as it has rows.
    done = materialize(done, "lm-parts")
    names += ["n_chars", "logp"]
    own = done.groupBy(*names).agg(F.count(F.lit(1)).cast("int").alias("copies"))
    rare = done.where(F.size("highs") > 0).dropDuplicates(names).select(*names, F.explode(F.arrays_zip("highs", "lows")).alias("gram")).select(*names, F.col("gram.highs").alias("high"), F.col("gram.lows").alias("low"))
    rare = rare.groupBy(*names, "high", "low").agg(F.count(F.lit(1)).alias("times")).join(tail.select(F.col("lang").alias("of"), F.col("high").alias("rhigh"), F.col("low").alias("rlow"), F.col("logp").alias("more")), (F.col("lang") == F.col("of")) & (F.col("high") == F.col("rhigh")) & (F.col("low") == F.col("rlow")))
    rare = rare.groupBy(*[F.col(c).alias(f"r_{c}") for c in names]).agg(F.sum(F.col("times") * F.col("more")).alias("more"))
    whole = own.join(rare, F.expr(" and ".join(f"{c} <=> r_{c}" for c in names)), "left")
    return whole.select("doc_id", "lang", "fold", "n_chars", (F.col("logp") + F.coalesce("more", F.lit(0.0))).alias("logp"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def _scorer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory("scores")
        made: dict[str, GramTable] = {}
        for batch in batches:
            for part in slices(batch, "text", 500, 2 << 20):
                langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
                n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                missing: list[tuple[np.ndarray, np.ndarray]] = [(_NONE, _NONE)] * len(texts)
                without = np.zeros(len(texts), bool)
                for lang in set(langs):
                    at = [i for i, x in enumerate(langs) if x == lang]
                    codes, ends = char_codes([texts[i] for i in at])
                    starts = np.r_[0, ends[:-1]]
                    n[at] = ends - starts - (ORDER - 1)
                    if lang not in sent.value:
                        without[at] = True
                        continue
                    if lang not in made:
                        made[lang] = GramTable(*sent.value[lang])
                    high, low, real = grams(codes)
                    found = made[lang].get(keys(high, low))
                    found[~real] = 0.0
                    rare = np.flatnonzero(np.isnan(found))
                    found[rare] = 0.0
                    total[at] = np.add.reduceat(found, starts)
                    if len(rare):
                        edges = np.searchsorted(rare, np.r_[starts, ends[-1]])
                        for i, lo, hi in zip(at, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                            missing[i] = (high[rare[lo:hi]], low[rare[lo:hi]])
                logp = pa.array(total, mask=without)
                lists = [_lists([m[k] for m in missing]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "lang", "fold", "print")), pa.array(n), logp, *lists], ["doc_id", "lang", "fold", "print", "n_chars", "logp", "highs", "lows"])

    return run


_NONE = np.zeros(0, np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in parts])], pa.int32()), pa.array(np.concatenate(parts)))


def _length(column: str = "n_chars") -> F.Column:
    """Class of a length: its doubling."""
    return F.floor(F.log2(F.greatest(F.col(column), F.lit(1)))).cast("int")


def _quantiles(held: DataFrame, wanted: DataFrame, lean: float, qs: dict[str, float]) -> DataFrame:
    """lang, length and quantiles of dev for each wanted (lang, length), from counts n of held (lang, length, dev)."""
    pooled = held.groupBy("length", "dev").agg(F.sum("n").alias("n")).withColumn("n", lean * F.col("n") / F.sum("n").over(W.Window.partitionBy("length")))
    # Of all classes, twenty points of equal weight; the driver sees a row a step of dev, whose number the losses' range bounds.
    steps = sorted((r["dev"], r["n"]) for r in held.groupBy("dev").agg(F.sum("n").alias("n")).collect())
    upto = np.cumsum([n for _, n in steps])
    points = [steps[int(np.searchsorted(upto, (k + 0.5) / POINTS * upto[-1]))][0] for k in range(POINTS)] if steps else []
    rows = held.select("lang", "length", "dev", F.col("n").cast("double").alias("n"))
    rows = rows.unionByName(wanted.join(pooled, "length").select("lang", "length", "dev", "n"))
    if points:
        rows = rows.unionByName(wanted.select("lang", "length", F.explode(F.array(*map(F.lit, points))).alias("dev"), F.lit(1 / POINTS).alias("n")))
    rows = rows.groupBy("lang", "length", "dev").agg(F.sum("n").alias("n"))
    own = W.Window.partitionBy("lang", "length")
    ranked = rows.select("lang", "length", "dev", F.sum("n").over(own.orderBy("dev")).alias("upto"), F.sum("n").over(own).alias("all"))
    return ranked.groupBy("lang", "length").agg(*[F.min(F.when(F.col("upto") >= q * F.col("all") - 1e-9, F.col("dev"))).alias(name) for name, q in qs.items()])


def language_bounds(scored: DataFrame, width: float = 2.0, depth: float = 4.0, lean: float = 20.0) -> DataFrame:
    """of, of_length, lower, upper: bounds of the mean log-loss a character by language and class of length. Quantiles are
    exact to 0.001: documents are counted by rounded loss, so what is gathered in one place is bounded by the number of
    languages, classes and steps, however many documents there are."""
    loss = F.round(-F.col("logp") / F.col("n_chars") * 1000).cast("int")
    counted = scored.where(F.col("logp").isNotNull()).groupBy("lang", "fold", _length().alias("length"), loss.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "lm-histogram")
    run = W.Window.partitionBy("lang").orderBy("step")
    middle = counted.where(F.col("fold") == HELD).groupBy("lang", "step").agg(F.sum("n").alias("n")).select("lang", "step", F.sum("n").over(run).alias("upto"), F.sum("n").over(W.Window.partitionBy("lang")).alias("all"))
    middle = middle.where("2 * upto >= all").groupBy(F.col("lang").alias("mlang")).agg(F.min("step").alias("mid"))
    deviations = counted.join(F.broadcast(middle), F.col("lang") == F.col("mlang")).withColumn("dev", F.col("step") - F.col("mid"))
    wanted = deviations.select("lang", "length", "mid").distinct()
    found = wanted
    for fold, qs in ((HELD, {"m": 0.5, "far": 0.9}), (TRAINED, {"tm": 0.5, "tfar": 0.1})):
        own = deviations.where(F.col("fold") == fold).select("lang", "length", "dev", "n")
        found = found.join(_quantiles(own, wanted.select("lang", "length"), lean, qs), ["lang", "length"], "left")
    upper = F.col("mid") + F.col("m") + width * (F.col("far") - F.col("m"))
    lower = F.col("mid") + F.col("tm") - depth * (F.col("tm") - F.col("tfar"))
    return found.select(F.col("lang").alias("of"), F.col("length").alias("of_length"), (lower / 1000).alias("lower"), (upper / 1000).alias("upper"))


def classify(docs: DataFrame, labels: DataFrame, width: float = 2.0, depth: float = 4.0, lean: float = 20.0, head_rows: int = 3_000_000) -> DataFrame:
    """doc_id, lang, n_chars, perplexity (a character; null where the language has no model), lower and upper bound, kept."""
    small_batches(docs.sparkSession)
    mark = tables_written()
    rows = folded_documents(docs, labels)
    table = gram_probabilities(materialize(corpus_grams(rows), "lm-corpus"))
    scored = materialize(scores(rows, table, head_rows), "lm-scores")
    # Rows by language and doubling of length.
    bounds = F.broadcast(language_bounds(scored, width, depth, lean))
    loss = -F.col("logp") / F.col("n_chars")
    judged = scored.join(bounds, (F.col("lang") == F.col("of")) & (_length() == F.col("of_length")), "left")
    out = (loss > F.col("upper") + 0.0005) | (loss < F.col("lower") - 0.0005)
    result = judged.select("doc_id", F.nullif("lang", F.lit(_NO_LANG)).alias("lang"), "n_chars", F.exp(loss).alias("perplexity"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper"), (~F.coalesce(out, F.lit(False))).alias("kept"))
    return settled(result, "lm-result", mark)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without those rejected. Rejected ids are broadcast only while they are few."""
    bad = materialize(classify(docs, labels, **options).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("bad")).distinct(), "lm-bad")
    few = bad.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(bad) if few else bad, docs["doc_id"] == bad["bad"], "left_anti")
