"""Chunkers: documents (doc_id, text) to chunks.

Chunks have chunk_id, doc_id, ord (place in emission order within the document), content
and, where it is defined, start_pos and end_pos; structured chunks also have layer,
semantic_type, parent_id, child_ids, cross_refs and constraint_types.  Null and empty
texts give no chunks.  Sizes are characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import clean_text, strip
from folioforge.functions.vectors import cosine
from folioforge.storage import materialize

from .lexicon import classify, semantic_type

SENTENCE_END = "。！？.!?"


def _id(kind: str, nth: Column, width: int = 4) -> Column:
    return F.concat(F.col("doc_id").cast("string"), F.lit(f"_{kind}_"), F.lpad(nth.cast("string"), width, "0"))


def fixed_chunks(docs: DataFrame, size: int = 512, overlap: int = 50, keep_blank: bool = False) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``; blank ones aren't numbered."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(size - overlap))
    windows = F.transform(starts, lambda s: F.struct(s.alias("start_pos"), F.least(s + size, F.length("text")).alias("end_pos"), F.substr(F.col("text"), s + 1, F.lit(size)).alias("content")))
    if not keep_blank:
        windows = F.filter(windows, lambda w: strip(w["content"]) != "")
    rows = docs.where(F.length("text") > 0).select("doc_id", F.posexplode(windows).alias("ord", "w"))
    return rows.select(_id("fixed", F.col("ord")).alias("chunk_id"), "doc_id", "ord", "w.content", "w.start_pos", "w.end_pos")


def _sentences(text: Column, marks: str) -> Column:
    return F.split(text, f"(?<=[{marks}])")


def _vectors_of(parts: DataFrame, embed) -> DataFrame:
    return parts.withColumn("vector", embed(F.col("part")))


def semantic_chunks(docs: DataFrame, embed, threshold: float = 0.5) -> DataFrame:
    """Join adjacent sentences, without a blank, while their vectors' cosine is ``threshold`` or more."""
    parts = F.filter(F.transform(_sentences(F.col("text"), "。！？.!?\n"), strip), lambda s: s != "")
    rows = _vectors_of(docs.select("doc_id", F.posexplode(parts).alias("pos", "part")), embed)
    w = Window.partitionBy("doc_id").orderBy("pos")
    broken = F.coalesce((cosine(F.lag("vector").over(w), F.col("vector")) < threshold).cast("int"), F.lit(0))
    rows = rows.withColumn("ord", F.sum(broken).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    joined = rows.groupBy("doc_id", "ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias("content"))
    return joined.select(_id("semantic", F.col("ord")).alias("chunk_id"), "doc_id", "ord", "content")


def adaptive_chunks(docs: DataFrame, embed, least: int = 128, most: int = 1024) -> DataFrame:
    """Pack paragraphs up to a target that shrinks where neighbours differ in content."""
    parts = F.filter(F.transform(F.split("text", r"\n\n+"), strip), lambda s: s != "")
    rows = _vectors_of(docs.select("doc_id", F.posexplode(parts).alias("pos", "part")), embed)
    w = Window.partitionBy("doc_id").orderBy("pos")
    density = F.coalesce(1 - cosine(F.lag("vector").over(w), F.col("vector")), F.lit(1.0))
    target = (F.lit(least) + (1 - F.least(density, F.lit(1.0))) * (most - least)).cast("int")
    packed = rows.select("doc_id", "pos", "part", target.alias("target")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "part", "target"))).alias("parts"))
    kind = "struct<done: array<string>, now: string>"

    def add(acc: Column, p: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(p["part"]) <= p["target"]
        more = F.struct(acc["done"].alias("done"), F.when(acc["now"] == "", p["part"]).otherwise(F.concat(acc["now"], F.lit("\n\n"), p["part"])).alias("now"))
        flush = F.struct(F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])).alias("done"), p["part"].alias("now"))
        return F.when(fits, more).otherwise(flush).cast(kind)

    first = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now")).cast(kind)
    done = F.aggregate("parts", first, add, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))
    return packed.select("doc_id", F.posexplode(done).alias("ord", "content")).select(_id("adaptive", F.col("ord")).alias("chunk_id"), "doc_id", "ord", "content")


def _per_text(docs: DataFrame, cut, schema: str, kind: pa.Schema) -> DataFrame:
    """Rows of ``cut(doc_id, text)`` for each document; per document, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in cut(d, t or "")]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, schema)


_SPAN_SCHEMA = "chunk_id string, doc_id string, ord int, content string, start_pos int, end_pos int"
_SPAN_KIND = pa.schema([("chunk_id", pa.string()), ("doc_id", pa.string()), ("ord", pa.int32()), ("content", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())])

#: Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", "。", ".", " ", "")


def recursive_pieces(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """Pieces of at most ``size``, each followed by the separator that it was cut at."""
    if not separators or separators[0] == "":
        yield from text if separators else (text,)
        return
    for part in text.split(separators[0]):
        if len(part) <= size:
            yield part + separators[0]
        else:
            yield from recursive_pieces(part, size, separators[1:])


def recursive_chunks(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Cut at the coarsest separators that give fitting pieces, then merge pieces up to ``size``.

    A new chunk starts with the last ``overlap`` characters of the one before, if that was
    longer than ``overlap``.  Positions are those of the untrimmed text.
    """

    def cut(doc_id: str, text: str) -> Iterator[dict]:
        now, start, nth = "", 0, 0

        def made() -> dict:
            return {"chunk_id": f"{doc_id}_recursive_{nth:04d}", "doc_id": doc_id, "ord": nth, "content": now.strip(), "start_pos": start, "end_pos": start + len(now)}

        for piece in recursive_pieces(text, size):
            if len(now) + len(piece) > size:
                if now.strip():
                    yield made()
                    nth += 1
                tail = now[len(now) - overlap :] if 0 < overlap < len(now) else ""
                start += len(now) - len(tail)
                now = tail
            now += piece
        if now.strip():
            yield made()

    return _per_text(docs, cut, _SPAN_SCHEMA, _SPAN_KIND)


def hierarchical_chunks(docs: DataFrame, outlines: DataFrame, least: int = 20, fallback: int = 512, budget: int | None = None) -> DataFrame:
    """Blocks that a model outlined (doc_id, answer: JSON list of level, start, end).

    Spans are clamped to the text; blocks of ``least`` characters or fewer are dropped but
    keep their number.  Documents without a usable outline, and with a ``budget`` those
    beyond the first so many in order of identifier, fall back to fixed windows without
    overlap.
    """
    from folioforge.functions.text import first_json

    asked = docs.select("doc_id", "text")
    spans = F.from_json(first_json(F.col("answer"), "array"), "array<struct<level: int, start: int, end: int>>")
    if budget is not None:  # so many model calls
        asked = asked.join(F.broadcast(asked.select("doc_id").orderBy("doc_id").limit(budget)), "doc_id", "left_semi")
    found = asked.join(outlines.select("doc_id", spans.alias("spans")), "doc_id")
    rows = found.select("doc_id", "text", F.posexplode("spans").alias("ord", "s")).where(F.col("s.level").isin(1, 2))
    start, end = F.greatest(F.lit(0), F.least(F.col("s.start"), F.length("text"))), F.greatest(F.lit(0), F.least(F.col("s.end"), F.length("text")))
    rows = rows.select("doc_id", "ord", F.col("s.level").alias("layer"), start.alias("start_pos"), end.alias("end_pos"), "text").where(F.col("end_pos") > F.col("start_pos") + least)
    good = rows.select(_id("hichunk", F.col("ord")).alias("chunk_id"), "doc_id", "ord", F.substr(F.col("text"), F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")).alias("content"), "start_pos", "end_pos", "layer")
    rest = docs.select("doc_id", "text").join(good.select("doc_id").distinct(), "doc_id", "left_anti")
    plain = fixed_chunks(rest, fallback, 0, keep_blank=True).withColumn("layer", F.lit(1))
    return good.unionByName(plain.select(*good.columns))


#: What starts a section and a clause, what a table, a numeric rule and a reference are.
SECTION = r"(?=(?:^|\n)(?:§?\d+(?:\.\d+)*|第[一二三四五六七八九十]+[章节条]|#{1,4})\s+)"
PARAGRAPH = r"\n\n+|(?=\n\s*[a-z]\)|(?=\n\s*\d+\)))"
TABLE = r"(?:\|.+\|(?:\n\|.+\|)*)"
COMPARATOR = r"≥|≤|≮|≯|>=|<=|不[超大小]于|至少|最[大小多少]"
NUMERIC = r"[^。\n]*(?:≥|≤|≮|≯|>=|<=|不[超大小]于|至少|最[大小多少])\s*\d+[.\d]*\s*(?:mm|cm|m|kg|N|h|%|°|步)[^。\n]*[。]?"
REFERENCE = r"(?i)见表\s*(\d+[-–]?\d*)|see\s+Table\s+(\d+[-–]?\d*)|见\s*§?(\d+(?:\.\d+)*)|see\s+§?(\d+(?:\.\d+)*)"


def section_chunks(docs: DataFrame, section_max: int | None = None) -> DataFrame:
    """Layer 1: cut before headings, trim, drop blanks; ``section_max`` keeps that many first characters only."""
    parts = F.filter(F.transform(F.split("text", SECTION), strip), lambda p: p != "")
    rows = docs.select("doc_id", F.posexplode(parts).alias("nth", "part"))
    return rows.select(_id("L1", F.col("nth"), 3).alias("chunk_id"), "doc_id", "nth", (F.col("part") if section_max is None else F.substring("part", 1, section_max)).alias("content"))


def packed_sentences(text: Column, most: int) -> Column:
    """Sentences joined while they fit; one longer than ``most`` stays whole."""
    kind = "struct<done: array<string>, now: string>"

    def add(acc: Column, s: Column) -> Column:
        fits = F.length(acc["now"]) + F.length(s) <= most
        done = F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))
        return F.when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["now"], s).alias("now"))).otherwise(F.struct(done.alias("done"), s.alias("now"))).cast(kind)

    first = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now")).cast(kind)
    return F.aggregate(_sentences(text, SENTENCE_END), first, add, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))


def paragraph_chunks(sections: DataFrame, paragraph_max: int = 512) -> DataFrame:
    """Layer 2: cut sections at empty lines and clause marks; long parts are packed by sentence."""
    parts = F.filter(F.transform(F.split("content", PARAGRAPH), strip), lambda p: p != "")
    rows = sections.select("doc_id", F.col("chunk_id").alias("parent_id"), F.col("nth").alias("section"), F.posexplode(parts).alias("nth", "part"))
    long = F.length("part") > paragraph_max
    rows = rows.select("*", long.alias("long"), F.posexplode(F.when(long, packed_sentences(F.col("part"), paragraph_max)).otherwise(F.array("part"))).alias("sub", "content"))
    chunk_id = F.concat(F.col("parent_id"), F.lit("_L2_"), F.lpad(F.col("nth").cast("string"), 3, "0"), F.when(F.col("long"), F.concat(F.lit("_"), F.lpad(F.col("sub").cast("string"), 2, "0"))).otherwise(F.lit("")))
    return rows.select(chunk_id.alias("chunk_id"), "doc_id", "parent_id", "section", "nth", "sub", "content")


def constraint_chunks(paragraphs: DataFrame, constraint_max: int = 256) -> DataFrame:
    """Layer 3: table blocks and lines with a comparator, a number and a unit, if short enough."""

    def found(pattern: str, kind: str, rank: int) -> Column:
        return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), lambda m, i: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), i.alias("nth"), strip(m).alias("content")))

    # the numeric pattern tries every start of a line; most texts have no comparator at all
    none = F.array().cast("array<struct<rank: int, kind: string, nth: int, content: string>>")
    numeric = F.when(F.rlike("content", F.lit(COMPARATOR)), found(NUMERIC, "num", 1)).otherwise(none)
    rows = paragraphs.select("doc_id", F.col("chunk_id").alias("parent_id"), "section", F.col("nth").alias("para"), "sub", F.explode(F.concat(found(TABLE, "tbl", 0), numeric)).alias("f"))
    rows = rows.where((F.length("f.content") <= constraint_max) & (F.col("f.content") != ""))
    return rows.select(F.concat(F.col("parent_id"), F.lit("_L3_"), F.col("f.kind"), F.lit("_"), F.lpad(F.col("f.nth").cast("string"), 2, "0")).alias("chunk_id"), "doc_id", "parent_id", "section", "para", "sub", F.col("f.rank").alias("rank"), F.col("f.nth").alias("nth"), F.col("f.content").alias("content"))


def cross_references(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, place, target_id): the first other chunk whose head holds the reference.

    References keep their order and repeats.  A reference is digits with dots or dashes, so
    a head holds it where one of its runs of such characters does; the join is by document
    and every part of such a run, of documents with references only.
    """
    group = lambda i: F.regexp_extract_all("content", F.lit(REFERENCE), F.lit(i))
    # most chunks hold no mark of a reference at all
    marked = chunks.where(F.contains("content", F.lit("见")) | F.contains(F.lower("content"), F.lit("see")))
    refs = F.transform(F.arrays_zip(*[group(i).alias(f"g{i}") for i in range(1, 5)]), lambda z: F.coalesce(*[F.nullif(z[f"g{i}"], F.lit("")) for i in range(1, 5)]))
    asked = marked.select("doc_id", "chunk_id", F.posexplode(refs).alias("place", "ref")).where("ref IS NOT NULL")
    heads = chunks.join(asked.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("chunk_id").alias("target_id"), "ord", F.substring("content", 1, 100).alias("head"))
    runs = F.regexp_extract_all("head", F.lit(r"[0-9.\-–]+"), F.lit(0))
    upto = lambda n: F.sequence(F.lit(1), n)
    inside = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(upto(F.length(r)), lambda i: F.transform(upto(F.length(r) - i + 1), lambda n: F.substr(r, i, n)))))))
    known = heads.select("doc_id", "target_id", "ord", F.explode(inside).alias("ref"))
    met = asked.join(known, ["doc_id", "ref"]).where(F.col("target_id") != F.col("chunk_id"))
    return met.groupBy("chunk_id", "doc_id", "place").agg(F.min_by("target_id", "ord").alias("target_id"))


def structured_chunks(docs: DataFrame, section_max: int | None = None, paragraph_max: int = 512, constraint_max: int = 256, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Three layers with parents, children, cross-references, semantic types and labels.

    ``doc_id`` must be unique: chunks are named by it.  Whole texts are cut unless
    ``section_max`` says otherwise.
    """
    one = section_chunks(docs, section_max)
    two = paragraph_chunks(one, paragraph_max)
    three = constraint_chunks(two, constraint_max)
    nothing = F.lit(-1)
    shaped = [
        one.select("chunk_id", "doc_id", "content", F.lit(1).alias("layer"), F.lit(None).cast("string").alias("parent_id"), semantic_type(F.col("content")).alias("semantic_type"), F.struct(F.col("nth").alias("a"), nothing.alias("b"), nothing.alias("c"), nothing.alias("d"), nothing.alias("e")).alias("at")),
        two.select("chunk_id", "doc_id", "content", F.lit(2).alias("layer"), "parent_id", semantic_type(F.col("content")).alias("semantic_type"), F.struct(F.col("section").alias("a"), F.col("nth").alias("b"), F.col("sub").alias("c"), nothing.alias("d"), nothing.alias("e")).alias("at")),
        three.select("chunk_id", "doc_id", "content", F.lit(3).alias("layer"), "parent_id", F.lit("constraint_specification").alias("semantic_type"), F.struct(F.col("section").alias("a"), F.col("para").alias("b"), F.col("sub").alias("c"), F.col("rank").alias("d"), F.col("nth").alias("e")).alias("at")),
    ]
    # three readers below: written once
    rows = materialize(shaped[0].unionByName(shaped[1]).unionByName(shaped[2]), "structured-chunks")
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).drop("at")
    children = rows.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("chunk_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "chunk_id"))), lambda c: c["chunk_id"]).alias("child_ids"))
    refs = cross_references(rows).groupBy("chunk_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "target_id"))), lambda c: c["target_id"]).alias("cross_refs"))
    none = F.array().cast("array<string>")
    out = rows.join(children, "chunk_id", "left").join(refs, "chunk_id", "left")
    return out.select("chunk_id", "doc_id", "ord", "content", "layer", "semantic_type", "parent_id", F.coalesce("child_ids", none).alias("child_ids"), F.coalesce("cross_refs", none).alias("cross_refs"), classify(F.col("content"), lexicon).alias("constraint_types"))


#: Heading patterns, with the level each gives.
HEADINGS = (r"^(\d+(?:\.\d+)*)\s+(.+)$", r"^(第[一二三四五六七八九十]+[章节条])\s*(.+)$", r"^§\s*(\d+(?:\.\d+)*)\s+(.+)$", r"^(#{1,4})\s+(.+)$")


def extracted_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section_id, title, level, content, ord) by headings of the cleaned text.

    Headings that several patterns find at one place count once.  Without any, the whole
    text is one section, ``root``, at level 0.
    """

    def level(mark: str) -> int:
        return len(mark) if mark.startswith("#") else mark.count(".") + 1

    def cut(doc_id: str, text: str) -> Iterator[dict]:
        found = sorted({m.start(): (m.end(), m[1], m[2].strip()) for p in reversed(HEADINGS) for m in re.finditer(p, text, re.MULTILINE)}.items())
        if not found and text:
            yield {"doc_id": doc_id, "section_id": "root", "title": "", "level": 0, "content": text, "ord": 0}
        for i, (_, (end, mark, title)) in enumerate(found):
            stop = found[i + 1][0] if i + 1 < len(found) else len(text)
            yield {"doc_id": doc_id, "section_id": mark, "title": title, "level": level(mark), "content": text[end:stop].strip(), "ord": i}

    kind = pa.schema([("doc_id", pa.string()), ("section_id", pa.string()), ("title", pa.string()), ("level", pa.int32()), ("content", pa.string()), ("ord", pa.int32())])
    return _per_text(docs.select("doc_id", clean_text(F.col("text")).alias("text")), cut, "doc_id string, section_id string, title string, level int, content string, ord int", kind)
