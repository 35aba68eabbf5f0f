"""Chunks of Markdown as DataFrame programs.

Blocks come from window sums over the lines of each document (fences by parity, groups by breaks), heading paths from the
last heading of each level that no higher one has ended, packing from a fold over a section's paragraphs. A document's
lines never leave its group, so work is bounded by one document; everything stays inside the JVM. Chunkers are looked up
by name; a Python function may be registered and then runs as an Arrow function.

Columns of the document that its chunks need (`carry`) go through the program with its first line, so that documents are
read, and pages extracted, once: nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions.text import LINE_END, chunk_id, context_line, embed_text, estimate_tokens, is_blank, stripped

_HEADING = r"^(#{1,6})\s+(.*)$"
_PARTS = "array<string>"


def _firsts(carry: Sequence[str]) -> list[Column]:
    return [F.first(c).alias(c) for c in carry]


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "markdown", carry: Sequence[str] = ()) -> DataFrame:
    """key, carry, pos, kind ('para' or 'heading'), level, text. A fence stays whole; text right before it belongs to it."""
    # A final line break doesn't begin another line.
    body = F.regexp_replace(F.col(text), rf"(?:{LINE_END})\z", "")
    lines = docs.where(F.col(text).isNotNull()).select(key, *carry, F.posexplode(F.split(body, LINE_END)).alias("pos", "line"))
    run = W.Window.partitionBy(key).orderBy("pos")
    # Only a first line is shuffled with them; the window hands them on.
    lines = lines.withColumns({c: F.when(F.col("pos") == 0, F.struct(c)) for c in carry}) if carry else lines
    lines = lines.withColumns({c: F.first(c, ignorenulls=True).over(run)[c] for c in carry}) if carry else lines
    fence = F.startswith("line", F.lit("```"))
    lines = lines.withColumn("fence", fence).withColumn("inside", (F.sum(F.col("fence").cast("int")).over(run) - F.col("fence").cast("int")) % 2 == 1)
    free = ~F.col("fence") & ~F.col("inside")
    lines = lines.withColumn("heading", free & F.col("line").rlike(r"(?U)" + _HEADING)).withColumn("blank", free & is_blank(F.col("line")))
    ends = (F.col("fence") & F.col("inside")) | F.col("heading")
    starts = F.col("heading") | F.col("blank") | F.coalesce(F.lag(ends).over(run), F.lit(False))
    grouped = lines.withColumn("block", F.sum(starts.cast("int")).over(run)).where(~F.col("blank")).groupBy(key, "block")
    joined = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]))
    found = grouped.agg(joined.alias("raw"), F.max("heading").alias("is_heading"), *_firsts(carry))
    level = F.length(F.regexp_extract("raw", "^(#{1,6})", 1))
    body = stripped(F.regexp_extract("raw", r"(?U)" + _HEADING, 2))
    return found.select(
        key, *carry, F.col("block").cast("int").alias("pos"), F.when(F.col("is_heading"), "heading").otherwise("para").alias("kind"), F.when(F.col("is_heading"), level).alias("level"), F.when(F.col("is_heading"), body).otherwise(stripped(F.col("raw"))).alias("text")
    ).where((F.col("kind") == "heading") | (F.col("text") != ""))


def sections(docs: DataFrame, key: str = "doc_id", text: str = "markdown", max_level: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """key, carry, section (in order), heading_path, paras. Deeper headings are paragraphs; sections without any are left out."""
    run = W.Window.partitionBy(key).orderBy("pos")
    rows = blocks(docs, key, text, carry)
    opens = (F.col("kind") == "heading") & (F.col("level") <= max_level)
    rows = rows.withColumn("opens", opens).withColumn("section", F.sum(F.col("opens").cast("int")).over(run).cast("int"))
    levels = [f"h{n}" for n in range(1, max_level + 1)]
    for n, name in enumerate(levels, 1):
        rows = rows.withColumn(name, F.last(F.when(F.col("opens") & (F.col("level") == n), F.struct("pos", "text")), ignorenulls=True).over(run))
    path = []
    for n, name in enumerate(levels):
        above = [F.coalesce(F.col(f"{x}.pos"), F.lit(-1)) for x in levels[:n]]
        live = F.col(name).isNotNull() if not above else F.col(name).isNotNull() & (F.col(f"{name}.pos") > (F.greatest(*above) if len(above) > 1 else above[0]))
        path.append(F.when(live, F.col(f"{name}.text")))
    rows = rows.withColumn("heading_path", F.array_compact(F.array(*path)))
    para = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    paras = F.transform(F.array_sort(F.collect_list(F.struct("pos", para.alias("para")))), lambda x: x["para"])
    return rows.where(~F.col("opens")).groupBy(key, "section").agg(F.first("heading_path").alias("heading_path"), paras.alias("paras"), *_firsts(carry))


def pack(paras: Column, max_tokens: int, overlap_tokens: int = 0) -> Column:
    """Texts of at most max_tokens (one paragraph may be longer), each beginning with the last paragraphs of the one
    before that fit overlap_tokens. A fold that carries the number of characters, so long sections cost no rejoining."""
    size = lambda x: F.char_length(x).cast("long")
    tokens = lambda n: F.ceil(n / 4).cast("long")
    empty = F.array().cast(_PARTS)
    start = F.struct(empty.alias("done"), empty.alias("now"), F.lit(0).cast("long").alias("chars"))

    def carry(now: Column) -> Column:
        """The longest run of last paragraphs whose tokens sum to overlap_tokens at most, and its characters."""
        begin = F.struct(empty.alias("kept"), F.lit(0).cast("long").alias("sum"), F.lit(True).alias("open"), F.lit(0).cast("long").alias("chars"))

        def step(acc: Column, p: Column) -> Column:
            fits = acc["open"] & (acc["sum"] + tokens(size(p)) <= overlap_tokens)
            return F.struct(
                F.when(fits, F.concat(F.array(p), acc["kept"])).otherwise(acc["kept"]).alias("kept"),
                F.when(fits, acc["sum"] + tokens(size(p))).otherwise(acc["sum"]).alias("sum"),
                fits.alias("open"),
                F.when(fits, acc["chars"] + size(p) + F.when(acc["chars"] > 0, 2).otherwise(0)).otherwise(acc["chars"]).alias("chars"),
            )

        return F.aggregate(F.reverse(now), begin, step)

    def add(acc: Column, p: Column) -> Column:
        longer = acc["chars"] + 2 + size(p)
        full = (F.size(acc["now"]) > 0) & (tokens(longer) > max_tokens)
        done = F.concat(acc["done"], F.array(F.array_join(acc["now"], "\n\n")))
        if overlap_tokens > 0:
            kept = carry(acc["now"])
            fresh = F.struct(done.alias("done"), F.concat(kept["kept"], F.array(p)).alias("now"), (kept["chars"] + size(p) + F.when(F.size(kept["kept"]) > 0, 2).otherwise(0)).alias("chars"))
        else:
            fresh = F.struct(done.alias("done"), F.array(p).alias("now"), size(p).alias("chars"))
        more = F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.array(p)).alias("now"), F.when(F.size(acc["now"]) > 0, longer).otherwise(size(p)).alias("chars"))
        return F.when(full, fresh).otherwise(more)

    return F.aggregate(paras, start, add, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["now"], "\n\n")))).otherwise(acc["done"]))


def _chunk_rows(rows: DataFrame, key: str, carry: Sequence[str] = (), role: str = "chunk") -> DataFrame:
    return rows.select(key, *carry, "text", "heading_path", "position", F.lit(role).alias("role"), F.lit(None).cast("int").alias("parent_position"))


def chunk_none(docs: DataFrame, key: str = "doc_id", text: str = "markdown", carry: Sequence[str] = (), **_) -> DataFrame:
    """The whole page, unless it is blank."""
    rows = docs.where(~is_blank(F.col(text))).select(key, *carry, stripped(F.col(text)).alias("text"), F.array().cast(_PARTS).alias("heading_path"), F.lit(0).alias("position"))
    return _chunk_rows(rows, key, carry)


def chunk_heading(docs: DataFrame, key: str = "doc_id", text: str = "markdown", max_tokens: int = 512, overlap_tokens: int = 64, max_level: int = 3, carry: Sequence[str] = (), **_) -> DataFrame:
    """Sections, packed each on its own."""
    rows = sections(docs, key, text, max_level, carry).select(key, *carry, "section", "heading_path", F.posexplode(pack(F.col("paras"), max_tokens, overlap_tokens)).alias("at", "text"))
    order = F.row_number().over(W.Window.partitionBy(key).orderBy("section", "at")) - 1
    return _chunk_rows(rows.withColumn("position", order.cast("int")), key, carry)


def chunk_fixed(docs: DataFrame, key: str = "doc_id", text: str = "markdown", max_tokens: int = 512, overlap_tokens: int = 64, carry: Sequence[str] = (), **_) -> DataFrame:
    """All paragraphs of a page packed together, without headings."""
    paras = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    rows = blocks(docs, key, text, carry).where("kind = 'para'").groupBy(key).agg(paras.alias("paras"), *_firsts(carry))
    rows = rows.select(key, *carry, F.posexplode(pack(F.col("paras"), max_tokens, overlap_tokens)).alias("position", "text"), F.array().cast(_PARTS).alias("heading_path"))
    return _chunk_rows(rows, key, carry)


def chunk_parent_child(docs: DataFrame, key: str = "doc_id", text: str = "markdown", child_tokens: int = 512, parent_tokens: int = 2048, carry: Sequence[str] = (), parent_text: bool = False, **_) -> DataFrame:
    """Large chunks, and small ones cut from each. Parents count parents; children count all chunks before them. With
    parent_text, another column has the text of each small chunk's parent."""
    parents = chunk_heading(docs, key, text, parent_tokens, 0, carry=carry)
    pieces = parents.withColumn("pieces", pack(F.split("text", "\n\n"), child_tokens, 0))
    before = W.Window.partitionBy(key).orderBy("position").rowsBetween(W.Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("earlier", F.coalesce(F.sum(F.size("pieces") + 1).over(before), F.lit(0)))
    own = F.array(F.struct(F.col("text"), F.col("position"), F.lit("parent").alias("role"), F.lit(None).cast("int").alias("parent_position")))
    small = F.transform("pieces", lambda t, i: F.struct(t.alias("text"), (F.col("earlier") + 1 + i).cast("int").alias("position"), F.lit("child").alias("role"), F.col("position").alias("parent_position")))
    more = [F.col("text").alias("_parent")] if parent_text else []
    both = pieces.select(key, *carry, "heading_path", *more, F.explode(F.concat(own, small)).alias("c"))
    more = [F.when(F.col("c.role") == "child", F.col("_parent")).alias("parent_text")] if parent_text else []
    return both.select(key, *carry, "c.text", "heading_path", "c.position", "c.role", "c.parent_position", *more)


Chunker = Callable[..., DataFrame]
CHUNKERS: dict[str, Chunker] = {"none": chunk_none, "heading": chunk_heading, "fixed": chunk_fixed, "parent_child": chunk_parent_child}


def register_chunker(name: str, chunker: Chunker) -> None:
    """chunker(docs, key, text, carry, **options) gives key, the columns named by carry, text, heading_path, position, role,
    parent_position."""
    CHUNKERS[name] = chunker


def python_chunker(cut: Callable[..., list[dict]]) -> Chunker:
    """A chunker from a function of one page's Markdown, which gives dicts with text and optionally the other columns."""
    kind = T.ArrayType(T.StructType.fromDDL("text string, heading_path array<string>, position int, role string, parent_position int"))

    def chunker(docs: DataFrame, key: str = "doc_id", text: str = "markdown", carry: Sequence[str] = (), **options) -> DataFrame:
        @F.udf(kind, useArrow=True)
        def run(markdown):
            made = cut(markdown or "", **options)
            return [(c["text"], c.get("heading_path", []), c.get("position", i), c.get("role", "chunk"), c.get("parent_position")) for i, c in enumerate(made)]

        return docs.select(key, *carry, F.inline(run(F.col(text))))

    return chunker


def chunk(docs: DataFrame, name: str, key: str = "doc_id", text: str = "markdown", **options) -> DataFrame:
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name!r}; registered: {sorted(CHUNKERS)}")
    return CHUNKERS[name](docs, key=key, text=text, **options)


# The metadata of a document that its chunks repeat.
META = {"url": "string", "title": "string", "section": "string", "breadcrumbs": "array<string>", "version": "int", "content_hash": "string", "page_last_updated": "string"}


def chunk_records(docs: DataFrame, name: str, key: str = "doc_id", text: str = "markdown", title_prefix: bool = True, more: Sequence[str] = (), named_by: str | None = None, **options) -> DataFrame:
    """Rows of schemas.CHUNK: documents cut by a chunker, with identifiers, context and their document's metadata (null
    where docs doesn't have it), and further columns of the chunker's. The key tells documents apart; `named_by` is the
    column of their identifiers (the key, if not given), which documents of different addresses may share."""
    have = set(docs.columns)
    named = docs.select(key, F.col(text).alias("_text"), *([F.col(named_by).alias("_named_by")] if named_by else []), *[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(f"_{c}") for c, kind in META.items()])
    rows = chunk(named, name, key, "_text", carry=[*(["_named_by"] if named_by else []), *[f"_{c}" for c in META]], **options)
    doc = F.col("_named_by" if named_by else key).cast("string")
    context = context_line(F.col("_title"), F.col("heading_path"))
    meta = {c: F.col(f"_{c}").alias(c) for c in META} | {"breadcrumbs": F.coalesce("_breadcrumbs", F.array().cast(_PARTS)).alias("breadcrumbs")}
    return rows.select(
        chunk_id(doc, F.col("role"), F.col("position")).alias("chunk_id"),
        doc.alias("doc_id"),
        *[meta[c] for c in ("url", "title", "section", "breadcrumbs")],
        "heading_path",
        "position",
        "role",
        F.when(F.col("parent_position").isNotNull(), chunk_id(doc, F.lit("parent"), F.col("parent_position"))).alias("parent_id"),
        "text",
        (embed_text(context, F.col("text")) if title_prefix else F.col("text")).alias("text_to_embed"),
        estimate_tokens(F.col("text")).alias("tokens_est"),
        *[meta[c] for c in ("version", "content_hash", "page_last_updated")],
        *more,
    )


def retrieval_rows(records: DataFrame) -> DataFrame:
    """Small chunks only: what is searched when there are parents."""
    return records.where("role = 'child'")


def with_parent_text(records: DataFrame) -> DataFrame:
    """Each small chunk with the text of the large one it was cut from."""
    parents = records.where("role = 'parent'").select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"))
    return retrieval_rows(records).join(parents, "parent_id")


def small_to_big(docs: DataFrame, key: str = "doc_id", text: str = "markdown", **options) -> DataFrame:
    """Each small chunk's record with the text of the large one that it is cut from, in one pass."""
    return retrieval_rows(chunk_records(docs, "parent_child", key, text, more=["parent_text"], parent_text=True, **options))
