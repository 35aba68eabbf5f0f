"""What the training-data operators share: the shared folder, written tables, and a task's memory of tokens."""

from __future__ import annotations

import atexit
import ctypes
import gc
import json
import os
import shutil
import tempfile
import threading
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: str | None = None
_lists = threading.local()

#: The six ASCII white-space characters that separate words and are stripped from lines.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Unset (tests): a temporary one, in local mode only."""
    global _local
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local-")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="corpusflow-")
        atexit.register(shutil.rmtree, _local, True)
    return f"file://{_local}"


def _written() -> list[str]:
    """Tables written by this thread, so that queries of other threads keep theirs."""
    if not hasattr(_lists, "tables"):
        _lists.tables = []
    return _lists.tables


def fresh_dir(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/corpusflow/{tag}-{uuid.uuid4().hex}"
    _written().append(path)
    return path


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it back under the same schema."""
    path = fresh_dir(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """A mark for release()."""
    return len(_written())


def release(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Deletes the tables written since a mark, without the last `but`. Frames that read them are unusable afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    written = _written()
    for name in written[since : len(written) - but]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        written.remove(name)


def settled(df: DataFrame, tag: str, since: int) -> DataFrame:
    """Writes a result and deletes the tables it was made from, written since a mark."""
    done = materialize(df, tag)
    release(df.sparkSession, since, but=1)
    return done


_owner = ""


def own_memory(owner: str) -> None:
    """Called where an operator's task begins. Python workers outlive tasks, so what another operator's tasks keep in this
    worker is dropped, and freed memory goes back to the system."""
    global _owner
    if owner == _owner:
        return
    _owner = owner
    WordCoder._made.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def file_system(path: str):
    """The file system and path of a URI: local, or one that the cluster's Arrow library reaches (hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def put_in_place(fs, temporary: str, name: str) -> None:
    """Renames a finished file. A task that runs again after its executor was lost replaces the file by an equal one, which
    some file systems don't do by themselves."""
    try:
        fs.move(temporary, name)
    except OSError:
        fs.delete_file(name)
        fs.move(temporary, name)


def words_of(text) -> F.Column:
    """Words `[^\\x20\\x09-\\x0D]+` as an array; null text gives an empty one."""
    flat = F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, " " * len(ASCII_SPACE))
    return F.array_remove(F.split(flat, " "), "")


def let(value, body) -> F.Column:
    """body(value) with value computed once a row: a lambda variable is never inlined into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


class WordCoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers.

    A tokenizer of the form below never joins characters across a space, so each run of other characters is encoded alone
    and kept in a bounded memory; a run of lower-case letters is one word to it, which goes straight to the tokenizer's
    model. Any other tokenizer encodes whole texts.
    """

    # The steps before the model that make words independent of each other.
    NORMAL = ["NFC", "Replace", "Lowercase"]
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    #: A stop after one of these letters (Latin without I with a dot above, Greek, Cyrillic) is a token of its own: no step
    #: before the model turns the letter into anything but one letter, so nothing joins the stop.
    STOPPED = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f][.,]$"

    _made: dict[str, WordCoder] = {}

    def __init__(self, path: str, limit: int = 120_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder, self.limit, self.young, self.old = Tokenizer.from_file(path), limit, {}, {}
        spec = json.loads(self.coder.to_str())
        first, before = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_words = [x["type"] for x in first.get("normalizers", [])] == self.NORMAL and before[0].get("pattern") == {"Regex": self.PATTERN} and [x["type"] for x in before] == ["Split", "ByteLevel"]
        # Characters that stand for bytes in the model: printable ones for themselves, the others from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in plain]
        self.letters = {x: chr(x) for x in plain} | {x: chr(256 + i) for i, x in enumerate(others)}

    @classmethod
    def of(cls, path: str, limit: int = 120_000) -> WordCoder:
        """One for each file and Python worker, so that tasks of a worker share it. limit: words that it remembers."""
        own_memory("words")
        if path not in cls._made:
            cls._made[path] = cls(path)
        cls._made[path].limit = limit
        return cls._made[path]

    def _new(self, word: str) -> bytes:
        if word.isalpha() and word == word.lower() and (word.isascii() or unicodedata.is_normalized("NFC", word)):
            spelt = word if word.isascii() else "".join([self.letters[x] for x in word.encode()])
            return b"".join([t.id.to_bytes(4, "little") for t in self.coder.model.tokenize(spelt)])
        return b"".join([i.to_bytes(4, "little") for i in self.coder.encode(word, add_special_tokens=False).ids])

    def _known(self, words: np.ndarray) -> list[bytes]:
        """Ids of distinct words."""
        young, old = self.young, self.old
        found = list(map(young.get, words))
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                ids = old.get(word)
                found[i] = young[word] = self._new(word) if ids is None else ids
        if len(young) > self.limit:  # words not met again since the last time are forgotten
            self.young, self.old = {}, young
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a string array. Arrow splits words and tells them apart; Python sees distinct ones only."""
        texts = texts.fill_null("")
        if not self.by_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.coder.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        # Case doesn't matter to the tokenizer in ASCII, and a full stop or comma after most letters is a token of its own.
        words = coded.dictionary
        plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
        words = pc.if_else(plain, pc.ascii_lower(words), words)
        ends = pc.match_substring_regex(words, self.STOPPED)
        stems = pc.if_else(ends, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        stops = pc.if_else(ends, pc.utf8_slice_codeunits(words, -1), "").dictionary_encode()
        ids = [pa.array(self._known(x.dictionary.to_numpy(zero_copy_only=False)), pa.large_binary()).take(x.indices) for x in (stems, stops)]
        flat = pc.binary_join_element_wise(*ids, pa.scalar(b"", pa.large_binary())).take(coded.indices)
        _, edges, data = flat.buffers()
        at = np.frombuffer(edges, np.int64)[flat.offset + lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        whole = memoryview(data) if data is not None else memoryview(b"")
        return [bytes(whole[a:b]) for a, b in zip(at, at[1:], strict=False)]


def slices(batch: pa.RecordBatch, column: str, rows: int = 2500, size: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many rows, and (unless one row alone has more) bytes of text in a column."""
    long = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        before = long[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(long, before + size, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def regrouped(batches: Iterator[pa.RecordBatch], column: str, rows: int = 1500, size: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many rows or bytes of text in a column, whichever comes first."""
    held: list[pa.RecordBatch] = []
    n = long = 0
    for batch in batches:
        for part in slices(batch, column, rows, size):
            own = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and (n + part.num_rows > rows or long + own > size):
                yield _joined(held)
                held, n, long = [], 0, 0
            held.append(part)
            n, long = n + part.num_rows, long + own
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what a batch of texts takes in the JVM and in Python: unless the session says otherwise, rows cross between
    them a thousand at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
