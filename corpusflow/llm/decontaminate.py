"""Benchmark decontamination by template canonicalisation, in DataFrame expressions alone.

Words of documents and benchmark items become templates. A token is bare: without anything but letters and digits. If it
begins with a digit it is a number, with a capital a name, if it is one of UNITS a unit, else it is itself in lower case;
what stands before it doesn't matter, so a token is the same in an item and in a document that goes on before it. Windows
of 8 template tokens are joined by hash. Matches of a document and an item on one diagonal (equal distance of positions)
are counted; a document with enough of an item's windows (6, which is 13 tokens in a row, or all of a shorter item) is
held to slot consistency: in the matched range, equal values of the item's slots stand for equal values in the document.
So a question whose numbers, names or units were exchanged is caught, and text that merely has slots in the same places
isn't.

What a template takes for a name depends on case, so windows of plain words (bare, in lower case, no slots) are joined
beside them, in the same pass: a copy in capitals or lower case has its words, whatever its template is. Enough windows of
plain words make a match without slots to hold to; so do enough windows of either sort, held to consistency. Where
templates alone give a match, that one is reported.

Windows of templates need 4 tokens of their own (not slots, not empty), of plain words 4 that aren't empty. An item that
has no such window, with 3 words or more, has all its plain windows instead; an item of 1 or 2 words is found in documents
that consist of it.

The benchmark's windows are broadcast after their number is checked, else joined by shuffle; documents are never shuffled
as texts.

Edge cases: null or empty texts, and items without any word, match nothing. Items of fewer than 8 tokens are matched
whole. Repeated rows and items with equal texts each give their match. Empty tables give an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, let, materialize, settled, tables_written

WINDOW, LEAST_OWN, ENOUGH = 8, 4, 6
TEMPLATE, PLAIN, WHOLE = 0, 1, 2
#: Benchmark windows up to this number are broadcast (about 40 bytes each).
BROADCAST_WINDOWS = 2_000_000
# Units of measurement and of money, as template slots.
UNITS = "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl dl l liter liters litre litres gallon gallons s sec secs min mins h hr hrs second seconds minute minutes hour hours day days week weeks month months year years percent cent cents dollar dollars euro euros usd eur gbp kb mb gb tb"


def _flat(text) -> F.Column:
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, " " * 6), " {2,}", " "))


def _bare(value) -> F.Column:
    return F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]+", ""))


def _cased(flat) -> F.Column:
    """`flat` with bare tokens, as many as it has."""
    return F.regexp_replace(flat, r"[^\p{L}\p{N} ]+", "")


def _tokens(cased) -> F.Column:
    """Template tokens: numbers and names as slots (\\u0001 and a letter), others in lower case."""
    named = F.regexp_replace(cased, r"(^| )[\p{Lu}\p{Lt}][^ ]*", "$1\u0001n")
    return F.split(F.lower(F.regexp_replace(named, r"(^| )\p{N}[^ ]*", "$1\u0001d")), " ")


def _template(cased) -> F.Column:
    """Template tokens, with units as slots too."""
    return F.transform(_tokens(cased), lambda x: F.when(x.isin(*UNITS.split()), "\u0001u").otherwise(x))


def _plain(cased) -> F.Column:
    return F.split(F.lower(cased), " ")


def _codes(cased, kind: int) -> F.Column:
    """Hashes of the tokens."""
    if kind != TEMPLATE:
        return F.transform(_plain(cased), lambda x: F.xxhash64(x))
    return F.transform(_tokens(cased), lambda x: F.when(x.isin(*UNITS.split()), F.xxhash64(F.lit("\u0001u"))).otherwise(F.xxhash64(x)))


def _joined(codes, width: int) -> F.Column:
    """For each place a hash of the `width` codes from there on, by halves; the last width - 1 are of fewer."""
    if width == 1:
        return codes
    half = 1 << ((width - 1).bit_length() - 1)

    def both(a, b):
        return F.transform(a, lambda x, i: F.xxhash64(x, F.get(b, i + half)))

    if width == 2 * half:
        return let(_joined(codes, half), lambda a: both(a, a))
    return let(_joined(codes, half), lambda a: let(_joined(codes, width - half), lambda b: both(a, b)))


def _hashes(codes, width: int) -> F.Column:
    """Hash of every window of `width` tokens, in order; none (null) if there are fewer tokens."""
    return F.when(F.size(codes) >= width, F.slice(_joined(codes, width), 1, F.size(codes) - (width - 1)))


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id, kind (TEMPLATE, PLAIN, or WHOLE: found in documents that consist of it), at (place of the window, from 0),
    width, hash, windows (how many of the kind the item has)."""
    flat = _cased(_flat(F.col("text")))
    both = F.array(*[F.struct(F.lit(kind).alias("kind"), tokens.alias("tokens"), _codes(flat, kind).alias("codes")) for kind, tokens in ((TEMPLATE, _template(flat)), (PLAIN, _plain(flat)))])
    items = benchmark.select("item_id", F.inline(both)).withColumn("words", F.size(F.filter("tokens", lambda x: x != ""))).where("words > 0").withColumn("width", F.least(F.lit(width), F.size("tokens")))
    hashes = F.coalesce(*[F.when(F.col("width") == w, _hashes(F.col("codes"), w)) for w in range(1, width + 1)])
    windows = items.select("item_id", "kind", "words", "width", "tokens", F.posexplode(hashes).alias("at", "hash"))
    own = F.size(F.filter(F.slice("tokens", F.col("at") + 1, F.col("width")), lambda x: (x != "") & ~x.startswith("\u0001")))
    counted = windows.select("item_id", "kind", "words", "at", "width", "hash", (own >= LEAST_OWN).alias("used"))
    best = counted.groupBy("item_id", "kind").agg(F.sum(F.col("used").cast("long")).alias("n"), F.count(F.lit(1)).alias("all"))
    best = best.select(F.col("item_id").alias("of"), F.col("kind").alias("of_kind"), "n", "all")
    joined = counted.join(best, F.col("item_id").eqNullSafe(F.col("of")) & (F.col("kind") == F.col("of_kind")))
    every = (F.col("kind") == PLAIN) & (F.col("n") == 0)
    kind = F.when((F.col("kind") == PLAIN) & (F.col("words") < 3), WHOLE).otherwise(F.col("kind"))
    return joined.where(F.col("used") | every).select("item_id", kind.alias("kind"), "at", "width", "hash", F.when(every, F.col("all")).otherwise(F.col("n")).alias("windows"))


def document_windows(docs: DataFrame, kinds: list[tuple[int, int]]) -> DataFrame:
    """doc_id, kind, width, place, hash: all windows of these (kind, width), in one pass over the texts."""

    def of(kind: int) -> F.Column:
        widths = [w for k, w in kinds if k == kind]

        def windows(codes):
            made = [_hashes(codes, w) for w in widths]
            if kind == WHOLE:
                made = [F.when(F.size(codes) == w, m) for w, m in zip(widths, made, strict=True)]
            return F.array(*[F.struct(F.lit(w).alias("width"), m.alias("hashes")) for w, m in zip(widths, made, strict=True)])

        return F.struct(F.lit(kind).alias("kind"), let(_codes(F.col("cased"), kind), windows).alias("own"))

    made = [of(kind) for kind in sorted({k for k, _ in kinds})]
    cased = docs.select("doc_id", _cased(_flat(F.col("text"))).alias("cased"))
    by_kind = cased.select("doc_id", F.inline(F.array(*made))).select("doc_id", "kind", F.inline("own"))
    return by_kind.select("doc_id", "kind", "width", F.posexplode("hashes").alias("place", "hash"))


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, item_id, shift (place in the document less place in the item), sort (0 by templates, 1 by plain words, 2 by
    either), n_windows, first, last: before slots are held to."""
    wanted = materialize(benchmark_windows(benchmark, width), "bench-windows")
    few = wanted.count() <= BROADCAST_WINDOWS
    kinds = sorted(tuple(r) for r in wanted.select("kind", "width").distinct().collect()) or [(PLAIN, width)]  # 3 * `width` at most
    # The hash is the only key, so that it stays a long in the table of the broadcast; the rest is held to afterwards.
    named = wanted.withColumnRenamed("kind", "of_kind").withColumnRenamed("width", "of_width")
    same = (F.col("kind") - F.col("of_kind") == 0) & (F.col("width") - F.col("of_width") == 0)
    found = document_windows(docs, kinds).join(F.broadcast(named) if few else named, "hash").where(same).select("doc_id", "item_id", (F.col("place") - F.col("at")).alias("shift"), "at", "windows", "kind", "width")
    plain = F.col("kind") != TEMPLATE
    sets = [F.collect_set(F.when(k, F.col("at"))).alias(f"at{i}") for i, k in enumerate((~plain, plain))]
    grouped = found.groupBy("doc_id", "item_id", "shift").agg(*sets, *[F.max(F.when(k, F.col("windows"))).alias(f"windows{i}") for i, k in enumerate((~plain, plain))], F.max("width").alias("width"))
    # An item has a plain window wherever it has one of templates.
    ways = [("at0", "windows0"), ("at1", "windows1"), (F.array_union("at0", "at1"), F.coalesce("windows1", F.lit(ENOUGH)))]
    ways = F.array(*[F.struct(F.lit(i).alias("sort"), (F.col(at) if isinstance(at, str) else at).alias("at"), (F.col(n) if isinstance(n, str) else n).alias("windows")) for i, (at, n) in enumerate(ways)])
    sorts = grouped.select("doc_id", "item_id", "shift", "width", F.explode(ways).alias("way")).where("way.windows is not null").where(F.size("way.at") >= F.least(F.lit(ENOUGH), F.col("way.windows")))
    return sorts.select("doc_id", "item_id", "shift", "way.sort", F.size("way.at").alias("n_windows"), F.array_min("way.at").alias("first"), (F.array_max("way.at") + F.col("width") - 1).alias("last"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """A row for each document and item that it contains: doc_id, item_id, first_word (of the match, from 0), n_windows,
    n_slots (of the item, in the matched range), n_changed (those with another value in the document)."""
    mark = tables_written()
    hits = materialize(matches(docs, benchmark, width), "bench-hits")
    n = hits.count()
    items = benchmark.select(F.col("item_id").alias("bench_id"), F.split(_flat(F.col("text")), " ").alias("bench_words"), _template(_cased(_flat(F.col("text")))).alias("bench_template")).dropDuplicates(["bench_id"])
    texts = docs.select(F.col("doc_id").alias("hit_doc"), F.col("text").alias("hit_text"))
    # Documents with a match are few, but nothing bounds them: they are broadcast only while they are.
    small = hits.select(F.col("doc_id").alias("wanted_doc")).distinct()
    texts = texts.join(F.broadcast(small) if n <= BROADCAST_WINDOWS else small, F.col("hit_doc").eqNullSafe(F.col("wanted_doc")), "left_semi")
    texts = texts.select("hit_doc", F.split(_flat(F.col("hit_text")), " ").alias("doc_words"))
    joined = texts.join(F.broadcast(hits) if n <= BROADCAST_WINDOWS else hits, F.col("hit_doc").eqNullSafe(F.col("doc_id"))).join(items, F.col("item_id").eqNullSafe(F.col("bench_id")))
    at = F.sequence(F.col("first"), F.col("last"))
    slots = F.filter(at, lambda i: F.get(F.col("bench_template"), i).startswith("\u0001"))
    pairs = F.transform(slots, lambda i: F.struct(_bare(F.get(F.col("bench_words"), i)).alias("a"), _bare(F.get(F.col("doc_words"), i + F.col("shift").cast("int"))).alias("b")))
    checked = joined.select("doc_id", "item_id", "shift", "sort", "n_windows", (F.col("first") + F.col("shift")).alias("first_word"), pairs.alias("pairs"))
    values = F.transform("pairs", lambda p: p["a"])
    consistent = F.size(F.array_distinct("pairs")) == F.size(F.array_distinct(values))
    checked = checked.where(consistent | (F.col("sort") == 1)).withColumn("n_slots", F.size("pairs")).withColumn("n_changed", F.size(F.filter("pairs", lambda p: ~p["a"].eqNullSafe(p["b"]))))
    best = F.max_by(F.struct("first_word", "n_windows", "n_slots", "n_changed"), F.struct(-F.col("sort"), "n_windows", -F.col("first_word"))).alias("best")
    found = checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *[F.col(f"best.{c}").cast("long").alias(c) for c in ("first_word", "n_windows", "n_slots", "n_changed")])
    return settled(found, "bench-found", mark)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that contain a benchmark item."""
    bad = materialize(contaminated(docs, benchmark).select(F.col("doc_id").alias("bad_doc")).distinct(), "bench-bad")
    few = bad.count() <= BROADCAST_WINDOWS
    return docs.join(F.broadcast(bad) if few else bad, docs["doc_id"].eqNullSafe(bad["bad_doc"]), "left_anti")
