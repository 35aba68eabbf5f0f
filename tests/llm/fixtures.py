"""Small tables with everything that must not break an operator."""

import random

TOKENIZER = "word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside themselves.
CLASHING = ["key", "size", "shard", "slot", "units", "bin", "node", "root", "gone", "bad", "bad_doc", "hit_doc", "hit_keys", "good", "yes", "hash", "n_lines", "domain", "words", "chosen", "digest", "payload"]


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def vocabulary(rng, n=400):
    return ["".join(rng.choice(["an", "ti", "re", "on", "sh", "ed", "ou", "le"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng, words, n):
    out = []
    while len(out) < n:
        part = [rng.choice(words) for _ in range(rng.randint(4, 12))]
        part[0] = part[0].capitalize()
        part[-1] += "."
        out += part
    return " ".join(out[:n])


def odd_rows():
    """Nulls in every column, empty texts, blanks, repeated rows, a very long text."""
    rng = random.Random(3)
    words = vocabulary(rng)
    long = "\n".join(prose(rng, words, 50) for _ in range(400))
    return [
        (1, None, "en", "s", None), (2, "", "en", None, 0), (3, " \n\t ", None, "s", 3), (None, "no id here at all", "en", "s", 17), (None, None, None, None, None),
        (4, "one two three", "en", "s", 13), (4, "one two three", "en", "s", 13), (5, long, "en", "s", len(long)), (6, long, "en", "s", len(long)), (7, "日本語 テスト é ñ   end", "ja", "s", 10), (8, "a\n\n\na\nA \n a", "en", "s", 9),
    ]


def frame(spark, rows, schema=SCHEMA, clash=True):
    df = spark.createDataFrame(rows, schema)
    if clash:
        for i, name in enumerate(CLASHING):
            if name not in df.columns:
                from pyspark.sql import functions as F

                df = df.withColumn(name, F.lit(i))
    return df


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)
