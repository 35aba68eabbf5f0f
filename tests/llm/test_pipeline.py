import corpus_pipeline as P
from corpusflow.llm.perplexity import classify
from corpusflow.llm.queries import ORACLE_SQL, QUERIES

from .fixtures import SCHEMA, odd_rows
from .test_jaccard import brute as components_of
from .test_linededup import brute as lines_of
from .test_perplexity import LABELS, corpus


def test_stages(spark, tmp_path):
    docs, labels = corpus(90)
    item = " ".join(docs[0][1].split()[:30])
    docs.append((500, docs[1][1], "en", "s", 0))
    shared = " ".join(docs[2][1].split()[:12])
    docs += [(600 + i, f"{shared}\n{' '.join(docs[20 + i][1].split()[::-1])}", "en", "s", 0) for i in range(12) if i != 9]
    docs += [(1000 + i if r[0] is not None else None, *r[1:]) for i, r in enumerate(odd_rows())]
    for name, rows, schema in (("documents", docs, SCHEMA), ("labels", labels, LABELS), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for name, stage in P.STAGES[:-1]:
        before = now
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == columns, name
        old, new = ([tuple(r) for r in d.select("doc_id", "text").collect()] for d in (before, now))
        if name == "classify":
            gone = {i for i, _ in old} - {i for i, _ in new}
            judged = classify(before, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("not kept").collect()
            assert gone == {r["doc_id"] for r in judged} - {None} and {i for i in range(90) if i % 10 == 9} <= gone
            assert 0 not in gone and sum(600 <= (i or 0) < 700 for i, _ in new) >= 10
        elif name == "lines":
            assert sorted(new, key=repr) == sorted([x[:2] for x in lines_of(old, 10)], key=repr) and now.where("n_chars <> length(text)").count() == 0
        elif name == "near":
            roots = components_of([x for x in old if x[0] is not None])
            assert {i for i, _ in new if i is not None} == {i for i, (_, r) in roots.items() if i == r}
        else:
            assert {i for i, _ in old} - {i for i, _ in new} == {0}
    pieces = P.STAGES[-1][1](spark, now, str(tmp_path))
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in now.collect()}
    whole = P.run(spark, str(tmp_path))
    order = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(repr, whole.select(order).collect())) == sorted(map(repr, pieces.select(order).collect()))


def test_stage_list_and_queries():
    assert [n for n, _ in P.STAGES] == ["classify", "lines", "near", "benchmark", "pack"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
