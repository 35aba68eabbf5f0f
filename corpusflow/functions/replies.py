"""Columns on check questions and on what models reply, and the wording of requests to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, stripped, text_or_empty

# Patterns that mark a question as recall, and words that mark a situation.
RECALL = [
    r"(?iU)^\s*(what|which)\s+(is|are|was|were)\s+(an?\s+|the\s+)?[\w .()/'-]{1,60}\?\s*$",
    r"(?iU)\bstands?\s+for\b",
    r"(?iU)\b(definition of|is defined as|best describes|best defines)\b",
    r"(?iU)^\s*(define|name)\b",
    r"(?iU)^\s*what\s+does\s+[\w .()/'-]{1,60}\s+(mean|do)\?\s*$",
    r"(?iU)\btrue or false\b",
]
SITUATION = r"(?iU)\b(you|your|you're|customer|team|stakeholder|user|if|when|suppose|imagine|needs?|wants?|asks?|says?|should|would|why)\b"
EMPTY = "empty question"
RECALLS = "reads like definition recall; ask the reader to apply the concept to a situation"
SHORT = "too short to describe a situation"
# The scale of illumination.
SCALE = (1, 5)
FLOOR, CUT = 4, 2


def recall_smell(question: Column) -> Column:
    """Why a check question reads like recall, or null."""
    q = stripped(text_or_empty(question))
    words = F.size(F.split(q, r"(?U)\s+"))
    situation = F.regexp_like(q, F.lit(SITUATION))
    recall = F.lit(False)
    for pattern in RECALL:
        recall = recall | F.regexp_like(q, F.lit(pattern))
    return F.when(q == "", EMPTY).when(recall & ~(situation & (words > 12)), RECALLS).when((words < 6) & ~situation, SHORT)


def clamp_score(score: Column) -> Column:
    return F.greatest(F.lit(SCALE[0]), F.least(F.lit(SCALE[1]), score))


def json_part(reply: Column) -> Column:
    """From the first brace to the last, or the whole reply."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(found == "", reply).otherwise(found)


def parse_judgement(reply: Column) -> Column:
    """struct<score int, reason string>; null if the reply holds no JSON object. A missing score counts as the lowest."""
    parsed = F.from_json(json_part(reply), "score string, reason string, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    score = clamp_score(F.coalesce(parsed["score"].try_cast("double").cast("int"), F.lit(0)))
    return F.when(parsed.isNotNull() & parsed["broken"].isNull(), F.struct(score.cast("int").alias("score"), stripped(text_or_empty(parsed["reason"])).alias("reason")))


def parse_term_draft(reply: Column) -> Column:
    """map of the drafted fields that are there, stripped."""
    parsed = F.from_json(json_part(reply), "map<string,string>")
    return F.transform_values(F.map_filter(parsed, lambda k, v: k.isin("plain", "say_it", "customer_line")), lambda k, v: stripped(text_or_empty(v)))


def craft_request(name: Column, plain: Column, anchor: Column, facts: Column, audience: str = "learner") -> Column:
    """Asks for one analogy card as JSON with bridge, where_it_breaks and check {q, a}."""
    checks = {
        "learner": "The check is a short situation, new to the reader, that is solved by applying the concept; it never asks for a definition.",
        "business": "The check is a short scene in which a customer says or wants something and the reader decides whether the concept helps and what to ask next; it never asks for a definition.",
    }
    if audience not in checks:
        raise ValueError(f"audience must be one of {sorted(checks)}")
    return F.concat_ws(
        "\n",
        F.lit("Explain one concept through a field the reader already knows."),
        F.concat(F.lit("Concept: "), name),
        F.concat(F.lit("Definition, never to be contradicted: "), plain),
        F.concat(F.lit("Facts; claim nothing beyond them: "), facts),
        F.concat(F.lit("Known field: "), anchor),
        F.lit("Tie parts of the field to parts of the concept so that their structure teaches something a definition does not. Renaming parts is not enough; say so if the field does not fit."),
        F.lit(checks[audience]),
        F.lit('Reply with JSON only: {"bridge": "...", "where_it_breaks": "...", "check": {"q": "...", "a": "..."}}'),
    )


def judge_request(name: Column, meaning: Column, anchor: Column, card: Column) -> Column:
    """Asks for {score 1-5, reason} on how much a card teaches."""
    levels = "5 shows something not obvious; 4 fits and helps; 3 mostly renames; 2 is forced; 1 obscures."
    return F.concat_ws(
        "\n",
        F.lit("Judge how much this analogy teaches. Take it as correct."),
        F.concat(F.lit("Concept: "), name, F.lit(": "), meaning),
        F.concat(F.lit("Known field: "), anchor),
        F.concat(F.lit("Bridge: "), text_or_empty(card["bridge"])),
        F.concat(F.lit("Where it breaks: "), text_or_empty(card["where_it_breaks"])),
        F.concat(F.lit("Check: "), text_or_empty(card["check"]["q"]), F.lit(" / "), text_or_empty(card["check"]["a"])),
        F.lit(f"Scale: {levels} If every field would map in the same way, give 3 at most."),
        F.lit('Reply with JSON only: {"score": 1-5, "reason": "at most 15 words"}'),
    )


def term_request(term: Column, facts: Column, audience: str = "learner") -> Column:
    """Asks for a glossary entry as JSON with plain, say_it and, for business, customer_line."""
    extra = ', "customer_line": "one sentence for a customer"' if audience == "business" else ""
    reader = "someone who talks to customers" if audience == "business" else "a newcomer"
    return F.concat_ws(
        "\n",
        F.concat(F.lit('Write a glossary entry for "'), term, F.lit(f'" for {reader}.')),
        F.concat(F.lit("Facts; claim nothing beyond them: "), facts),
        F.lit("Use plain words, at most 2 sentences and 280 characters, and show the term in a natural sentence."),
        F.lit('Reply with JSON only: {"plain": "...", "say_it": "..."' + extra + "}"),
    )


def missing(value: Column) -> Column:
    return is_blank(value)
