import random

import pytest
from corpusflow.llm import decontaminate as B
from pyspark.sql import functions as F

from .fixtures import empty, frame, odd_rows, prose, vocabulary

ITEMS = "item_id long, text string"
QUESTION = "A train leaves Oldtown at 9 hours and meets Anna after 45 km when it goes 30 km each hour so how long does Anna wait in the cold"


def world():
    rng = random.Random(11)
    words = vocabulary(rng, 900)
    items = [(i, prose(rng, words, rng.randint(15, 40))) for i in range(6)] + [(50, QUESTION), (51, "alpha beta gamma delta epsilon")]
    docs = {i: prose(rng, words, 200) for i in range(40)}
    return rng, words, items, docs


def found(spark, docs, items, **o):
    return {(r["doc_id"], r["item_id"]): r for r in B.contaminated(frame(spark, [(i, t, "en", "s", 0) for i, t in docs.items()]), spark.createDataFrame(items, ITEMS), **o).collect()}


@pytest.mark.parametrize("limit", [B.BROADCAST_WINDOWS, 0])
def test_catches_leaks_and_leaves_the_rest(spark, monkeypatch, limit):
    monkeypatch.setattr(B, "BROADCAST_WINDOWS", limit)
    rng, words, items, docs = world()
    docs[100] = f"{prose(rng, words, 30)} {items[0][1]} {prose(rng, words, 30)}"
    docs[101] = items[1][1].upper().lower()
    docs[102] = " ".join(items[2][1].split()[:14])
    changed = QUESTION.replace("Anna", "Berta").replace("Oldtown", "Newcity").replace("45", "81").replace("30", "27").replace("km", "miles").replace("9", "7")
    docs[103] = f"so {prose(rng, words, 20)} {changed} then"
    docs[104] = changed.replace("does Berta", "does Carla")  # one name stands for two: another question
    docs[105] = f"see alpha, beta; gamma delta epsilon! {prose(rng, words, 20)}"
    docs[106] = " ".join(items[3][1].split()[:10])  # too little of it
    got = found(spark, docs, items)
    assert set(got) == {(100, 0), (101, 1), (102, 2), (103, 50), (105, 51)}
    assert got[103, 50]["n_changed"] >= 6 and got[103, 50]["n_slots"] >= 7 and got[100, 0]["n_changed"] == 0 and got[100, 0]["first_word"] in (30, 31)
    df = frame(spark, [(i, t, "en", "s", 0) for i, t in docs.items()])
    left = B.decontaminate(df, spark.createDataFrame(items, ITEMS))
    assert {r["doc_id"] for r in left.collect()} == set(docs) - {100, 101, 102, 103, 105} and left.columns == df.columns


def test_case_of_a_copy_does_not_matter(spark):
    rng, words, items, docs = world()
    names = "The old farmer Jonas Weber asked his neighbour Maria Lund to bring back the cart that Peter Holm had borrowed in May"
    docs[100] = f"{prose(rng, words, 30)} {items[0][1].upper()} {prose(rng, words, 30)}"
    docs[101] = f"{prose(rng, words, 30)} {names.lower()}"
    docs[102] = f"{prose(rng, words, 30)} {names.title()}"
    docs[103] = " ".join(items[3][1].upper().split()[:10])  # too little of it
    got = found(spark, docs, [*items, (60, names)])
    assert set(got) == {(100, 0), (101, 60), (102, 60)}
    assert all(r["n_changed"] == 0 for r in got.values())


def test_short_items_and_items_of_slots(spark):
    rng, words, _, docs = world()
    items = [
        (1, "What is 12 + 30 kg ?"), (2, "Which River Runs Through The Old City Of Prague Today"), (3, "Anna bakes bread for nine hungry friends every single morning"),
        (4, "Tom paints small wooden boats in his garage"), (5, "12 13 14"), (6, "Paris is Big"), (7, "Yes!"), (8, "..."),
    ]
    docs[100], docs[101] = f"{prose(rng, words, 30)} {items[0][1]} {prose(rng, words, 30)}", f"{prose(rng, words, 30)} {items[1][1]}"
    docs[102], docs[103] = f"it says {items[2][1]}", f"it says {items[3][1]}"  # its first word looks like a name here
    docs[104], docs[105] = f"Indeed. {items[2][1].replace('Anna', 'Berta')}", f"Indeed. {items[3][1].replace('Tom', 'Jim')}"
    docs[106] = " ".join(items[3][1].split()[1:])  # without its first word
    docs[107] = f"the uncle {' '.join(items[3][1].split()[1:])}"
    docs[108] = items[0][1].replace("12", "13")
    docs[109], docs[110], docs[111], docs[112], docs[113] = "Here paris is big, we say", "yes", "yes it is", "...", "Paris is big"
    got = found(spark, docs, items)
    assert set(got) == {(100, 1), (101, 2), (102, 3), (103, 4), (104, 3), (105, 4), (109, 6), (110, 7), (113, 6)}
    assert got[104, 3]["n_changed"] == got[105, 4]["n_changed"] == 1 and got[104, 3]["first_word"] == 1


def test_recall_of_planted_items_of_every_length(spark):
    """The one who plants an item knows its slots: no template code is shared."""
    rng = random.Random(17)
    words = vocabulary(rng, 900)
    items, docs, want, missing, i = [], {}, set(), set(), 0
    for n in range(1, 26):
        for _ in range(4):
            sorts = [rng.choice("wwwwwwwwdnu") for _ in range(n)]
            values = [{"w": rng.choice(words), "d": str(rng.randint(2, 99)), "n": rng.choice(words).capitalize() + "x", "u": rng.choice(["km", "kg", "days"])}[x] for x in sorts]
            if len({v.lower() for v, x in zip(values, sorts, strict=True) if x != "w"}) < sum(x != "w" for x in sorts):
                continue  # equal values would have to be exchanged alike
            if rng.random() < 0.5 and sorts[0] == "w":
                values[0] = values[0].capitalize()
            items.append((i, " ".join(values)))
            before, after = (prose(rng, words, rng.randint(0, 30)) for _ in range(2))
            if n >= 3:
                docs[10 * i] = f"{before} {items[-1][1]} {after}"
                docs[10 * i + 1] = f"{before} ({items[-1][1].lower()}) {after}"
                docs[10 * i + 2] = f"{before}\n{items[-1][1].upper()}! {after}"
                want |= {(10 * i + k, i) for k in range(3)}
            else:
                docs[10 * i] = f" {items[-1][1]}.\n"
                want.add((10 * i, i))
            other = {"w": lambda v: v, "d": lambda v: str(int(v) + 100), "n": lambda v: v + "y", "u": lambda v: {"km": "miles", "kg": "tons", "days": "weeks"}[v]}
            changed = [other[x](v) for x, v in zip(sorts, values, strict=True)]
            # Enough words of its own in every window, all of which must match in a short item.
            own = [x == "w" and v[0].islower() for x, v in zip(sorts, values, strict=True)]
            if changed != values and n >= 4 and all(sum(own[k : k + 8]) >= 4 for k in range(max(1, n - 7))):
                docs[10 * i + 3] = f"{before} {' '.join(changed)} {after}"
                want.add((10 * i + 3, i))
            if n >= 6:
                docs[10 * i + 4] = f"{before} {' '.join(values[: n // 3])} {rng.choice(words)} {after}"
                missing.add((10 * i + 4, i))
            i += 1
    got = set(found(spark, docs, items))
    assert len(want) > 250 and sum(d % 10 == 3 for d, _ in want) > 30 and want <= got
    assert not got & missing
    # Whatever else is found has the item's words in a row.
    bare = lambda t: ["".join(c for c in w.lower() if c.isalnum()) for w in t.split()]
    texts = dict(items)
    for d, x in got - want:
        a, b = bare(docs[d]), bare(texts[x])
        assert len(b) <= 4 and any(a[k : k + len(b)] == b for k in range(len(a)))


def test_equal_items_and_repeated_rows(spark):
    _, _, items, docs = world()
    docs[100] = items[0][1]
    got = found(spark, docs, [*items, (77, items[0][1]), (78, None), (None, items[0][1]), (79, "")])
    assert set(got) == {(100, 0), (100, 77), (100, None)}


def test_odd_rows(spark):
    _, _, items, _ = world()
    df = frame(spark, odd_rows())
    assert B.contaminated(df, spark.createDataFrame(items, ITEMS)).count() == 0
    assert B.contaminated(df, spark.createDataFrame([], ITEMS)).count() == 0
    assert B.contaminated(empty(spark), spark.createDataFrame(items, ITEMS)).count() == 0
    clash = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(1)).withColumn("tokens", F.lit(1)).withColumn("hash", F.lit(1))
    assert B.contaminated(df, clash).count() == 0
    assert B.decontaminate(df, clash).count() == len(odd_rows())


def test_no_python_in_the_plan(spark):
    _, _, items, _ = world()
    plan = B.matches(frame(spark, odd_rows()), spark.createDataFrame(items, ITEMS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
