"""Analogy cards (concept x anchor) in long tables: completeness, scoring, the gate and what is shown.

A table has a row for each concept and anchor; `ord` columns carry the order of input where ties need it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import CUT, FLOOR, judge_request, recall_smell
from ..functions.text import is_blank, text_or_empty
from .glossary import _problem

# Structural shapes a concept may have.
SHAPES = ("hierarchy", "trade_off", "pipeline", "matching", "permission", "record", "lifecycle", "single_relationship")


def cards_from_nested(df: DataFrame, column: str = "cards") -> DataFrame:
    """From a map of concept to map of anchor to struct<bridge, where_it_breaks, check>: schemas.CARD's first columns."""
    outer = df.select(F.explode(column).alias("concept_id", "by_anchor"))
    return outer.select("concept_id", F.explode("by_anchor").alias("anchor_id", "c")).select("concept_id", "anchor_id", "c.*")


def card_struct() -> Column:
    """The part of a card that is published."""
    return F.struct("bridge", "where_it_breaks", F.struct(F.col("check.q").alias("q"), F.col("check.a").alias("a")).alias("check"))


def concept_problems(concepts: DataFrame) -> DataFrame:
    """id, problem."""
    name = text_or_empty(F.col("id"))
    unsourced = F.filter(F.transform(F.coalesce("claims", F.array().cast("array<struct<text:string,source_urls:array<string>>>")), lambda c, i: F.when(F.coalesce(F.size(c["source_urls"]), F.lit(0)) <= 0, i)), lambda i: i.isNotNull())
    checks = F.array(
        _problem((text_or_empty(F.col("id")) == "") | (text_or_empty(F.col("name")) == ""), "id and name are required"),
        _problem(is_blank(F.col("plain")), name, ": plain definition is empty"),
        _problem((text_or_empty(F.col("shape")) != "") & ~F.col("shape").isin(*SHAPES), name, ": unknown shape '", F.col("shape"), "'"),
    )
    claims = F.transform(unsourced, lambda i: F.concat(name, F.lit(": claim "), i.cast("string"), F.lit(" has no source")))
    return concepts.select("id", F.explode(F.concat(F.array_compact(checks), claims)).alias("problem"))


def card_grid(concepts: DataFrame, anchors: DataFrame, cards: DataFrame) -> DataFrame:
    """Every concept (concept_id) with every anchor (anchor_id), and its card if there is one. Both lists are kept small by
    their authors: the grid is the result asked for, not a way to join."""
    return concepts.select("concept_id").crossJoin(anchors.select("anchor_id")).join(cards.withColumn("_there", F.lit(True)), ["concept_id", "anchor_id"], "left")


def card_problems(concepts: DataFrame, anchors: DataFrame, cards: DataFrame) -> DataFrame:
    """concept_id, anchor_id, problem: cards that are missing or not complete."""
    at = F.concat(F.col("concept_id"), F.lit(" x "), F.col("anchor_id"))
    there = F.coalesce("_there", F.lit(False))
    checks = F.array(
        _problem(~there, "missing ", at),
        _problem(there & is_blank(F.col("bridge")), "empty bridge in ", at),
        _problem(there & is_blank(F.col("where_it_breaks")), "empty where_it_breaks in ", at),
        _problem(there & (is_blank(F.col("check.q")) | is_blank(F.col("check.a"))), "incomplete check in ", at),
    )
    return card_grid(concepts, anchors, cards).select("concept_id", "anchor_id", F.explode(F.array_compact(checks)).alias("problem"))


def check_style_problems(cards: DataFrame) -> DataFrame:
    """concept_id, anchor_id, problem: checks that ask for recall."""
    why = recall_smell(F.col("check.q"))
    return cards.where(why.isNotNull()).select("concept_id", "anchor_id", F.concat(F.lit("recall-style check in "), "concept_id", F.lit(" x "), "anchor_id", F.lit(": "), why).alias("problem"))


def judge(concepts: DataFrame, anchors: DataFrame, cards: DataFrame, judge_fn: Callable[[Column], Column]) -> DataFrame:
    """concept_id, anchor_id, score: each card there is, scored by judge_fn (a request Column to a struct with score). A
    concept without cards has one row of nulls, so that the gate sees it."""
    named = concepts.select("concept_id", "name", F.when(text_or_empty(F.col("one_liner")) == "", F.col("plain")).otherwise(F.col("one_liner")).alias("meaning"))
    rows = cards.join(anchors.select("anchor_id", "label"), "anchor_id").join(named, "concept_id")
    request = judge_request(F.col("name"), F.col("meaning"), F.col("label"), F.struct("bridge", "where_it_breaks", "check"))
    scored = rows.select("concept_id", "anchor_id", judge_fn(request)["score"].cast("int").alias("score"))
    return concepts.select("concept_id").join(scored, "concept_id", "left")


def illumination_gate(scores: DataFrame, floor: int = FLOOR, cut: int = CUT) -> DataFrame:
    """concept_id, best_anchor, best_score, passes, lead, cut. scores: concept_id, ord, anchor_id, score; of equal scores
    the one of lowest ord leads, and a concept's row of nulls stands for no scores."""
    key = F.when(F.col("score").isNotNull(), F.struct(F.col("score").alias("score"), (-F.col("ord")).alias("first")))
    low = F.sort_array(F.collect_list(F.when(F.col("score") <= cut, F.col("anchor_id"))))
    best = scores.groupBy("concept_id").agg(F.max_by("anchor_id", key).alias("best_anchor"), F.coalesce(F.max("score"), F.lit(0)).alias("best_score"), low.alias("cut"))
    passes = F.col("best_score") >= floor
    return best.select("concept_id", "best_anchor", "best_score", passes.alias("passes"), F.when(passes, F.col("best_anchor")).alias("lead"), "cut")


def gate_summary(gate: DataFrame) -> DataFrame:
    """passed (every concept passes; true for none) and failing (sorted)."""
    return gate.agg(F.coalesce(F.bool_and("passes"), F.lit(True)).alias("passed"), F.sort_array(F.collect_list(F.when(~F.col("passes"), F.col("concept_id")))).alias("failing"))


def shown_analogies(scores: DataFrame, floor: int = FLOOR, cut: int = CUT) -> DataFrame:
    """concept_id, show, lead, cut, needs_scoring, plain_only. A null score isn't judged yet and is never shown."""
    ranked = F.collect_list(F.when(F.col("score") >= floor, F.struct((-F.col("score")).alias("s"), "ord", "anchor_id")))
    show = F.transform(F.array_sort(ranked), lambda x: x["anchor_id"])
    low = F.sort_array(F.collect_list(F.when(F.col("score") <= cut, F.col("anchor_id"))))
    waiting = F.sort_array(F.collect_list(F.when(F.col("score").isNull(), F.col("anchor_id"))))
    rows = scores.groupBy("concept_id").agg(show.alias("show"), low.alias("cut"), waiting.alias("needs_scoring"))
    return rows.select("concept_id", "show", F.get("show", 0).alias("lead"), "cut", "needs_scoring", (F.size("show") == 0).alias("plain_only"))
