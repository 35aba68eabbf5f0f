"""Quality rules at the level of hosts.

Each document gets its counts and base rules from DataFrame expressions alone; failures of the host rules are summed by
domain, rates are shrunk with a beta prior fitted to all domains by moments, and the domain's verdict is joined back to
its documents. A domain fails when a shrunk rate exceeds the rule's bound (the upper quantile of the fitted prior, but at
most a majority) and is credibly above the mean of all: so the hosts themselves say what is unusual, and a host of few
rows, or hosts that differ by chance alone, don't fail.

Edge cases: a null or empty text has no words and fails; a null domain is a domain of its own; ties and repeated rows
count as rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, let, materialize, settled, tables_written, words_of

SYMBOLS = "#*$%&|<>"
#: Hosts up to this number may be broadcast (under 100 bytes each); more are joined by shuffle.
BROADCAST_HOSTS = 200_000


def _repeated(words) -> F.Column:
    """Number of words that lie in a 3-word window found twice or more."""

    def positions(hashed):
        # Windows sorted by hash; a window is repeated if a neighbour in that order has the same hash.
        def mark(s):
            return F.transform(
                F.filter(
                    F.transform(s, lambda x, i: F.struct(x["at"].alias("at"), ((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])).alias("twice"))),
                    lambda x: x["twice"],
                ),
                lambda x: x["at"],
            )

        return let(F.array_sort(hashed), mark)

    def covered(at):
        return F.size(F.array_union(F.array_union(at, F.transform(at, lambda p: p + 1)), F.transform(at, lambda p: p + 2)))

    def windows(w):
        return F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at")))

    return F.when(F.size(words) < 3, 0).otherwise(let(words, lambda w: let(positions(windows(w)), covered)))


def document_counts(docs: DataFrame, domain: str = "source") -> DataFrame:
    """doc_id, domain, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, ASCII_SPACE, "")) > 0)
    counted = docs.select(
        "doc_id",
        F.col(domain).alias("domain"),
        words_of(F.col("text")).alias("words"),
        F.length(F.translate(text, ASCII_SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return counted.select("doc_id", "domain", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", _repeated(F.col("words")).cast("long").alias("n_repeat_words"))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def failures() -> dict[str, F.Column]:
    """The rules that hosts are held to, as conditions on a document's counts: failed base rules, symbols instead of words,
    words of an unusual mean length, lines that were said before."""
    return {
        "base": base_failed(),
        "symbols": 20 * F.col("n_symbols") > F.col("word_chars"),
        "length": (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")),
        "lines": 50 * F.col("n_dup_lines") > F.col("n_words"),
    }


def host_rates(counts: DataFrame, z: float = 1.645, most: float = 0.5, min_strength: float = 10.0, max_strength: float = 1000.0) -> DataFrame:
    """domain, n_docs, rule, k (documents that fail it), rate (shrunk), least (its lower credible limit), mean and bound.

    For each rule a beta prior has the mean of all documents and the strength that the spread of the hosts' rates shows
    (method of moments, within the limits); a host's rate is the posterior mean. The bound is the prior's quantile at z
    standard deviations above its mean (1.645: 95 %), at most `most`; least is as far below a host's rate in its posterior.
    """
    rules = failures()
    per_host = counts.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), *[F.sum(cond.cast("long")).alias(name) for name, cond in rules.items()])
    names = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("k")) for name in rules])
    long = per_host.select("domain", "n", F.inline(names))
    rate = F.col("k") / F.col("n")
    moments = long.groupBy("rule").agg((F.sum("k") / F.sum("n")).alias("mean"), F.sum(rate).alias("s1"), F.sum(rate * rate).alias("s2"), F.sum(1.0 / F.col("n")).alias("inv"), F.count(F.lit(1)).alias("hosts"))
    m, hosts = F.col("mean"), F.col("hosts")
    # Spread of the rates about the mean, less what sampling alone would give.
    spread = F.greatest(F.lit(0.0), (F.col("s2") - 2 * m * F.col("s1") + hosts * m * m) / hosts - m * (1 - m) * F.col("inv") / hosts)
    strength = F.least(F.lit(max_strength), F.greatest(F.lit(min_strength), F.when(spread > 0, m * (1 - m) / spread - 1).otherwise(F.lit(max_strength))))
    bound = F.least(F.lit(most), m + z * F.sqrt(m * (1 - m) / (strength + 1)))
    prior = moments.select("rule", "mean", strength.alias("strength"), bound.alias("bound"))  # one row a rule
    weight = F.col("n") + F.col("strength")
    shrunk = long.join(F.broadcast(prior), "rule").select("domain", F.col("n").alias("n_docs"), "rule", "k", ((F.col("k") + F.col("mean") * F.col("strength")) / weight).alias("rate"), weight.alias("weight"), "mean", "bound")
    return shrunk.withColumn("least", F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))).drop("weight")


def host_verdicts(rates: DataFrame) -> DataFrame:
    """domain, host_docs, host_risk (of a rule: the smaller of rate / bound and least / mean; largest of all rules, rounded
    to 6 places; 0 where no document fails a rule) and host_failed: it exceeds 1."""
    ratio = F.round(F.max(F.when(F.col("mean") > 0, F.least(F.col("rate") / F.col("bound"), F.col("least") / F.col("mean"))).otherwise(F.lit(0.0))), 6)
    return rates.groupBy("domain").agg(F.max("n_docs").alias("host_docs"), ratio.alias("host_risk")).withColumn("host_failed", F.col("host_risk") > 1)


def host_rules(docs: DataFrame, domain: str = "source", z: float = 1.645, most: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, host_risk, kept.

    Every host's verdict is joined back. The number of hosts is checked: few are broadcast, many are joined by a shuffle
    that adaptive execution splits where one host has many rows.
    """
    mark = tables_written()
    counts = materialize(document_counts(docs, domain), "host-counts")
    verdicts = materialize(host_verdicts(host_rates(counts, z, most)).withColumnRenamed("domain", "of_domain"), "host-verdicts")
    few = verdicts.count() <= BROADCAST_HOSTS
    joined = counts.join(F.broadcast(verdicts) if few else verdicts, F.col("domain").eqNullSafe(F.col("of_domain")))
    out = joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "host_failed", "host_risk", (~base_failed() & ~F.col("host_failed")).alias("kept"))
    return settled(out, "host-rules", mark)
