import re

import pytest
from corpusflow.functions import replies, text
from corpusflow.operators import cards as K
from corpusflow.operators import glossary as G
from corpusflow.queries import QUERIES
from pyspark.sql import functions as F

TERMS = [
    {"id": "unity-catalog", "term": "Unity Catalog", "plain": "A catalog of all.", "say_it": "Ask Unity Catalog.", "aliases": ["UC"], "source_urls": ["https://d/x"]},
    {"id": "catalog", "term": "catalog", "plain": "A <list>.", "say_it": "One catalog.", "source_urls": ["https://d/y/"]},
    {"id": "api", "term": "API", "plain": "Calls.", "say_it": "The API.", "general": True},
]


def find(text, **options):
    return G.Matcher([(f, t["id"]) for t in TERMS for f in [t["term"], *t.get("aliases", [])]]).find(text, **options)


def test_longest_and_first():
    assert [m[2] for m in find("Unity Catalog has a catalog. UC and catalog.")] == ["unity-catalog", "catalog"]
    assert len(find("Unity Catalog has a catalog. UC and catalog.", first_only=False)) == 4
    assert [m[2] for m in find("A catalog, UC.", skip=["catalog"])] == ["unity-catalog"]


def test_boundaries_code_and_acronyms():
    assert [m[2] for m in find("catalogs, sub-catalog, `catalog`, ```\ncatalog\n``` api.example.com, the API")] == ["api"]
    assert find("```\ncatalog never closed") == []


def test_annotate_and_mentions(spark):
    terms = G.glossary_frame(spark, TERMS)
    df = spark.createDataFrame([(1, "a <b> catalog & UC"), (2, None)], "i int, t string")
    got = dict(df.select("i", G.annotate_html(terms)(F.col("t"))).collect())
    assert got[1].startswith('a &lt;b&gt; <dfn class="cg-term" data-term="catalog" title="A &lt;list&gt;.">catalog</dfn> &amp; ') and got[2] is None
    found = df.select("i", G.mentions(terms)(F.col("t")).alias("m"))
    assert dict(found.select("i", G.used_terms(F.col("m"))).collect())[1] == ["catalog", "unity-catalog"]


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({"id": "Bad"}, "slug"),
        ({"term": " "}, "term is empty"),
        ({"plain": ""}, "plain definition is empty"),
        ({"plain": "x" * 281}, "over 280"),
        ({"plain": "A. B. C."}, "over 2 sentences"),
        ({"say_it": " "}, "say_it is empty"),
        ({"say_it": "catalogs only"}, "doesn't use the term"),
        ({"source_urls": []}, "needs a public source"),
    ],
)
def test_term_problems(spark, change, problem):
    rows = G.term_problems(G.glossary_frame(spark, [TERMS[1] | change])).collect()
    assert any(problem in r["problem"] for r in rows)


def test_glossary_as_a_whole(spark, tmp_path):
    assert G.glossary_problems(G.glossary_frame(spark, TERMS)).count() == 0
    assert G.glossary_problems(G.default_glossary(spark)).count() == 0
    live = spark.createDataFrame([("https://d/x/",)], "url string")
    assert [r["problem"] for r in G.glossary_problems(G.glossary_frame(spark, TERMS), live).collect()] == ["catalog: source not in the current docs: https://d/y/"]
    (tmp_path / "g.yaml").write_text("terms:\n- {id: catalog, term: catalogue}\n- {id: new, term: new}\n")
    merged = G.merge_glossaries(G.glossary_frame(spark, TERMS), G.load_glossary(spark, tmp_path / "g.yaml"))
    assert [(r["id"], r["term"]) for r in merged.orderBy("ord").collect()] == [("unity-catalog", "Unity Catalog"), ("catalog", "catalogue"), ("api", "API"), ("new", "new")]
    with pytest.raises(ValueError, match="unknown glossary fields"):
        G.glossary_frame(spark, [{"id": "a", "colour": 1}])


def test_sentences(spark):
    df = spark.createDataFrame([("One. Two! Three?", 3), ("Use e.g. 3.5 or a.b.c only.", 1), ("no end", 1), ("", 1)], "t string, n int")
    assert df.where(text.sentence_count(F.col("t")) != F.col("n")).count() == 0


def test_sentences_of_every_document(spark, tmp_path):
    texts = ["One. Two! Three?", "Use e.g. 3.5 or a.b.c only.", "Pens, ink, etc. cost 2.50. Ask i.e. call vs. write!", "Version 2.0. See www.a.org/x.y now.", "no end", "", None]

    def brute(t):
        bare = re.sub(r"(?<=\w)\.(?=\w)", "", re.sub(r"\b(e\.g|i\.e|etc|vs)\.", "", t or ""))
        return max(1, len(re.findall(r"[.!?](?:\s|$)", bare.strip())))

    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["sentences"] for r in QUERIES["sentence_count"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_gate_and_display(spark):
    scores = spark.createDataFrame([("a", 0, "chess", 5), ("a", 1, "gardening", 2), ("b", 0, "chess", 3), ("c", None, None, None)], "concept_id string, ord long, anchor_id string, score int")
    gate = {r["concept_id"]: r for r in K.illumination_gate(scores).collect()}
    assert gate["a"]["lead"] == "chess" and gate["a"]["cut"] == ["gardening"] and gate["c"]["best_score"] == 0 and not gate["c"]["passes"]
    summary = K.gate_summary(K.illumination_gate(scores)).first()
    assert not summary["passed"] and summary["failing"] == ["b", "c"]
    shown = spark.createDataFrame([("x", i, k, s) for i, (k, s) in enumerate([("p", 5), ("q", 4), ("r", 3), ("s", 2), ("t", None)])], scores.schema)
    r = K.shown_analogies(shown).first()
    assert (r["show"], r["lead"], r["cut"], r["needs_scoring"], r["plain_only"]) == (["p", "q"], "p", ["s"], ["t"], False)
    tie = spark.createDataFrame([("x", 0, "late", 4), ("x", 1, "early", 4)], scores.schema)
    assert K.illumination_gate(tie).first()["best_anchor"] == "late"


def test_judge(spark):
    concepts = spark.createDataFrame([("c", "Name", "Plain", ""), ("d", "N", "P", "one")], "concept_id string, name string, plain string, one_liner string")
    anchors = spark.createDataFrame([("a", "Chess")], "anchor_id string, label string")
    cards = spark.createDataFrame([("c", "a", "b", "w", ("q", "a"))], "concept_id string, anchor_id string, bridge string, where_it_breaks string, check struct<q:string,a:string>")
    rows = {r["concept_id"]: r for r in K.judge(concepts, anchors, cards, lambda req: F.struct(F.when(req.contains("Name: Plain"), 4).alias("score"))).collect()}
    assert rows["c"]["score"] == 4 and rows["d"]["anchor_id"] is None


def test_nested_cards(spark):
    df = spark.sql("select map('c', map('a', named_struct('bridge', 'b', 'where_it_breaks', 'w', 'check', named_struct('q', 'q', 'a', 'a')))) cards")
    row = K.cards_from_nested(df).select("concept_id", "anchor_id", K.card_struct().alias("s")).first()
    assert (row["concept_id"], row["anchor_id"], row["s"]["bridge"], row["s"]["check"]["q"]) == ("c", "a", "b", "q")


def test_replies(spark):
    cases = ['{"score": 9, "reason": " r "}', 'x {"score": "3"} y', '{"reason": "n"}', "no", '{"score": -2}']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", replies.parse_judgement(F.col("t"))).collect()}
    assert got[0] == (5, "r") and got[1]["score"] == 3 and got[2] == (1, "n") and got[3] is None and got[4]["score"] == 1
    draft = df.select(replies.parse_term_draft(F.lit('Sure {"plain": " p ", "other": 1, "say_it": "s"}'))).first()[0]
    assert draft == {"plain": "p", "say_it": "s"}
    with pytest.raises(ValueError, match="audience"):
        replies.craft_request(F.lit(""), F.lit(""), F.lit(""), F.lit(""), "none")
    for make in (replies.craft_request(F.lit("N"), F.lit("P"), F.lit("A"), F.lit("F"), "business"), replies.term_request(F.lit("N"), F.lit("F"), "business")):
        assert "N" in df.select(make).first()[0]
