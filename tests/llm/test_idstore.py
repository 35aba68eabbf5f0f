import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpusflow.llm import idstore as I
from corpusflow.llm.common import WordCoder, fresh_dir
from tokenizers import Tokenizer

from .fixtures import empty, frame, odd_rows, prose, tokenizer, vocabulary


def expected(rows):
    coder, out, start = Tokenizer.from_file(tokenizer()), [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, ids))
        start += len(ids)
    return out


def documents():
    rng = random.Random(4)
    words = vocabulary(rng)
    passage = prose(rng, words, 3000)
    return [(i, f"{prose(rng, words, rng.choice([0, 5, 400, 2500]))} {passage if i % 3 == 0 else ''}") for i in range(60)]


def test_round_trip(spark):
    rows = documents()
    folder = I.write_store(frame(spark, [(i, t, "en", "s", 0) for i, t in rows]), tokenizer())
    want = expected(rows)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in I.read_digests(spark, folder).collect())
    assert got == [(d, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, s, ids in want]
    some = spark.createDataFrame([(0,), (7,), (59,)], "doc_id long")
    assert {r["doc_id"]: list(r["ids"]) for r in I.read_ids(spark, folder, some).collect()} == {d: ids for d, _, ids in want if d in (0, 7, 59)}
    chunks = I.read_chunks(spark, folder, payload=False).collect()
    assert len({bytes(c["digest"]) for c in chunks}) == len(chunks)  # each once
    assert sum(c["n"] for c in chunks) < 0.8 * sum(len(ids) for *_, ids in want)  # the shared passage isn't stored again


def test_damage_is_found(spark):
    folder = I.write_store(frame(spark, [(i, t, "en", "s", 0) for i, t in documents()[:5]]), tokenizer())
    fs, root = I.file_system(folder)
    for name in [x["file"] for x in I.read_manifest(folder)["recipes"]]:
        with fs.open_input_stream(f"{root}/recipes/{name}") as f:
            body = f.read()
        if body:
            with fs.open_output_stream(f"{root}/recipes/{name}") as f:
                f.write(body[:-1] + bytes([body[-1] ^ 1]))
            break
    with pytest.raises(Exception, match="root"):
        I.read_recipes(spark, folder).count()
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        body = f.read()
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(body.replace(b'"root": "', b'"root": "00', 1))
    with pytest.raises(ValueError):
        I.read_manifest(folder)


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    gear = I._gear()
    a = rng.integers(0, 49_000, 30_000).astype("<u4")
    ends = I.cut_points(a, gear)
    assert ends[-1] == len(a) and all(x < y for x, y in zip(ends, ends[1:], strict=False)) and max(np.diff([0, *ends])) <= I.MOST
    moved = I.cut_points(np.r_[a[:100][::-1], a], gear)
    assert len(set(np.array(moved) - 100) & set(ends)) > 0.9 * len(ends)
    assert I.cut_points(a[:0], gear) == [] and I.cut_points(a[:10], gear) == [10]


def test_crc_of_parts():
    rng = random.Random(0)
    tables = I._shift_tables()
    for _ in range(50):
        parts = [rng.randbytes(rng.randint(1, 5000)) for _ in range(rng.randint(1, 6))]
        after = np.array([sum(map(len, parts[i + 1 :])) for i in range(len(parts))])
        crc = np.bitwise_xor.reduce(I.shifted(np.array([zlib.crc32(p) for p in parts]), after, tables))
        assert int(crc) == zlib.crc32(b"".join(parts))


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    folder = I.write_store(frame(spark, odd_rows()), tokenizer())
    got = I.read_digests(spark, folder).collect()
    want = expected(rows)
    assert sorted((r["start"], r["n_tokens"]) for r in got) == sorted((a, b) for a, b in zip(np.cumsum([0, *sorted_lengths(got)])[:-1].tolist(), sorted_lengths(got), strict=True))
    assert sorted(r["n_tokens"] for r in got) == sorted(len(ids) for *_, ids in want) and {r["doc_id"] for r in got} == {r[0] for r in rows}
    assert I.read_digests(spark, I.write_store(empty(spark), tokenizer(), folder=fresh_dir(spark, "empty"))).count() == 0


def sorted_lengths(got):
    return [r["n_tokens"] for r in sorted(got, key=lambda r: r["start"])]


def test_word_coder_equals_the_tokenizer():
    coder = WordCoder.of(tokenizer())
    cases = ["it's. Don't, ÇA. 'S. <|endoftext|>. A<|startoftext|>b İstanbul. ΑΣ. ΑΣ, x.. 5. ½. é. é.,a ́.", "", None, "\n\n a\t b\xa0c\x1cd . , ..", "K. ﬁ. ǅ. ʰ. à.̀ à", "日本語。テスト. 한글. ก็.", "A" * 300 + ". B\r\nc\x0bd\x0ce f"]
    rng = random.Random(1)
    cases += ["".join(rng.choice("aÉbß.,'! \n\t5é́​ﬀΣς<|>") for _ in range(40)) for _ in range(500)]
    # Words that end in any letter and a stop, where the steps before the model may make of the letter a letter and a mark.
    letters = [c for c in map(chr, range(0x30000)) if unicodedata.category(c)[0] in "LM"]
    cases += [f"{c}{stop}" for c in letters for stop in ".,"] + [f"a{c}.b" for c in letters]
    small = [c for c in letters if c < "\u3000"]
    cases += ["".join(rng.choice(small if rng.random() < 0.5 else "aZ.,' ") for _ in range(rng.randint(1, 6))) + rng.choice([".", ",", ""]) for _ in range(100_000)]
    cases += ["İ,", "KADİ, BEY", "बाढ़, और", "\ufb2a.", "X\u0307. Å."]
    for text, raw in zip(cases, coder.encode(pa.array(cases, pa.string())), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == coder.coder.encode(text or "", add_special_tokens=False).ids, repr(text)
