"""Evaluation-set construction: cleaning, extraction, filtering, deduplication, sampling."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions.text import normalize_answer, normalize_line, strip

from .lexicon import UNIT_FACTORS
from .ranking import global_rank

#: Line shapes of a handbook's pages.
CLAUSE = r"^(\d+(?:\.\d+)+)\s+([A-Z].{2,120})$"
ITEM = r"^(\d+)\.\s+(.+)$"
CATEGORY_ID = r"^([A-Z]\d*(?:\.\d+)*)\s*$"
GUIDELINE_ID = r"^([A-Z]{1,4}-\d+(?:-\d+)?)\s+(.+)$"
FIGURE = r"^FIGURE\s+(D-\d+)\.?\s*(.*)$"
BULLET = r"^[•\-*]\s+(.+)$"
PRINTED_PAGE = r"^(?:[A-Z]-)?\d{1,4}$"
APPENDIX = r"^APPENDIX\s+([A-Z])$"


def page_lines(pages: DataFrame, headers: list[str] | None = None) -> DataFrame:
    """(page_num, line_no, line): normalised lines without blanks, headers and page numbers."""
    rows = pages.select("page_num", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).select("page_num", "line_no", normalize_line(F.col("raw")).alias("line"))
    rows = rows.where((F.col("line") != "") & ~F.rlike("line", F.lit(PRINTED_PAGE)))
    return rows.where(~F.col("line").isin(headers)) if headers else rows


def page_marks(pages: DataFrame, first: int = 6) -> DataFrame:
    """(page_num, printed_page, appendix) from the first lines of each page."""
    lines = F.slice(F.transform(F.split("text", "\n"), normalize_line), 1, first)
    pick = lambda p, g: F.nullif(F.regexp_extract(F.get(F.filter(lines, lambda x: F.rlike(x, F.lit(p))), F.lit(0)), p, g), F.lit(""))
    return pages.select("page_num", pick(f"({PRINTED_PAGE})", 1).alias("printed_page"), pick(APPENDIX, 1).alias("appendix"))


def appendix_ranges(marks: DataFrame) -> DataFrame:
    """(appendix, first, last): each from its first page to before the next one's."""
    firsts = marks.where("appendix IS NOT NULL").groupBy("appendix").agg(F.min("page_num").alias("first"))
    return firsts.withColumn("last", F.lead("first").over(Window.orderBy("first")) - 1)


def _headed(lines: DataFrame, pattern: str, group: list[str]) -> DataFrame:
    """Lines with the running number of the last heading before them, its id, title and page."""
    w = Window.partitionBy(*group).orderBy("page_num", "line_no") if group else Window.orderBy("page_num", "line_no")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.rlike("line", F.lit(pattern))
    marked = lines.withColumn("head", head).withColumn("nth", F.sum(F.col("head").cast("int")).over(run))
    last = lambda c: F.last(F.when(F.col("head"), c), ignorenulls=True).over(run)
    return marked.withColumn("id", last(F.regexp_extract("line", pattern, 1))).withColumn("title", last(F.regexp_extract("line", pattern, 2))).withColumn("page", last(F.col("page_num"))).where("nth > 0")


def headed_records(lines: DataFrame, pattern: str = CLAUSE, group: list[str] | None = None, keep_empty: bool = False) -> DataFrame:
    """Headings with the lines after them joined by blanks: clauses, or templates with ``keep_empty``.

    ``lines`` is one document's, or has the columns of ``group`` to tell documents apart.
    """
    group = group or []
    rows = _headed(lines, pattern, group)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("page_num", "line_no", "line")))), lambda x: x["line"]), " ")
    out = rows.groupBy(*group, "nth", "id", "title", "page").agg(body.alias("text"))
    return out if keep_empty else out.where("text <> ''")


def _line_machine(lines: DataFrame, cut, schema: str, kind: pa.Schema) -> DataFrame:
    """Run a sequential machine over each document's lines (doc, page_num, line_no, line)."""

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["page_num", "line_no", "line"]).to_pylist(), key=lambda r: (r["page_num"], r["line_no"]))
        return pa.Table.from_pylist([{"doc": keys[0].as_py(), **r} for r in cut(rows)], schema=kind)

    return lines.select("doc", "page_num", "line_no", "line").groupBy("doc").applyInArrow(run, schema)


def guideline_records(lines: DataFrame) -> DataFrame:
    """Category id, title and guideline id machine; text without an id gets OCRMISS-nnnn.

    A record's page is that of the line at which it ends.  ``lines`` has a ``doc`` column;
    a document is one handbook, so it fits a task.
    """

    def cut(rows: list[dict]) -> Iterator[dict]:
        category = title = ident = None
        text: list[str] = []
        missed = 0

        def close(page: int) -> Iterator[dict]:
            nonlocal missed, ident, text
            if text:
                if ident is None:
                    missed += 1
                yield {"category_id": category, "category_title": title, "guideline_id": ident or f"OCRMISS-{missed:04d}", "guideline_text": " ".join(text), "page": page}
            ident, text = None, []

        page = 0
        for r in rows:
            page = r["page_num"]
            if m := re.match(GUIDELINE_ID, r["line"]):
                yield from close(page)
                ident, text = m[1], [m[2]]
            elif m := re.match(CATEGORY_ID, r["line"]):
                yield from close(page)
                category, title = m[1], None
            elif category is not None and title is None:
                title = r["line"]
            elif category is not None:
                text.append(r["line"])
        yield from close(page)

    kind = pa.schema([("doc", pa.string()), ("category_id", pa.string()), ("category_title", pa.string()), ("guideline_id", pa.string()), ("guideline_text", pa.string()), ("page", pa.int64())])
    return _line_machine(lines, cut, "doc string, category_id string, category_title string, guideline_id string, guideline_text string, page long", kind)


def action_records(lines: DataFrame, longest_title: int = 120) -> DataFrame:
    """Bullets with their continuation lines under a title, closed by the figure line."""

    def cut(rows: list[dict]) -> Iterator[dict]:
        title, bullets = None, []
        for r in rows:
            if m := re.match(FIGURE, r["line"]):
                if bullets:
                    yield {"title": (m[2] or title or "").strip()[:longest_title], "figure_id": m[1], "bullets": bullets, "text": " ".join(bullets), "page": r["page_num"]}
                title, bullets = None, []
            elif m := re.match(BULLET, r["line"]):
                bullets.append(m[1])
            elif bullets:
                bullets[-1] += " " + r["line"]
            else:
                title = r["line"]

    kind = pa.schema([("doc", pa.string()), ("title", pa.string()), ("figure_id", pa.string()), ("bullets", pa.list_(pa.string())), ("text", pa.string()), ("page", pa.int64())])
    return _line_machine(lines, cut, "doc string, title string, figure_id string, bullets array<string>, text string, page long", kind)


def term_definitions(text_rows: DataFrame, pattern: str = r"(?m)^([一-鿿A-Za-z][^\n：:]{1,30})[：:]\s*([^\n]{10,300})$") -> DataFrame:
    """(doc_id, place, term, definition) by a two-group pattern."""
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("t"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("d"))
    return text_rows.select("doc_id", F.posexplode(found).alias("place", "f")).select("doc_id", "place", strip(F.col("f.t")).alias("term"), strip(F.col("f.d")).alias("definition"))


def page_offsets(pages: DataFrame, group: str = "doc_id") -> DataFrame:
    """(group, page_num, start): where each page begins in the pages joined by line breaks."""
    w = Window.partitionBy(group).orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    return pages.select(group, "page_num", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).alias("start"))


def prefix_distinct(rows: DataFrame, text: str, order: str, group: list[str] | None = None, size: int = 60) -> DataFrame:
    """Keep the first row of each lower-cased prefix within ``group``."""
    w = Window.partitionBy(*(group or []), F.lower(F.substring(text, 1, size))).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_best(rows: DataFrame, group: str, answer: str, rank: list[Column], identity: list[str]) -> DataFrame:
    """One row per (group, normalised answer), the best by ``rank``; the others as ``aliases``."""
    keyed = rows.withColumn("_key", F.sha2(normalize_answer(F.col(answer)), 256))
    w = Window.partitionBy(group, "_key").orderBy(*rank)
    ranked = keyed.withColumn("_n", F.row_number().over(w))
    others = ranked.where("_n > 1").groupBy(group, "_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", *identity))), lambda a: F.struct(*[a[c].alias(c) for c in identity])).alias("aliases"))
    out = ranked.where("_n = 1").join(others, [group, "_key"], "left")
    kind = dict(others.dtypes)["aliases"]
    return out.withColumn("aliases", F.coalesce("aliases", F.array().cast(kind))).withColumn("alias_count", F.size("aliases")).drop("_n", "_key")


def first_per_group(rows: DataFrame, group: str, order: list[Column], most: int = 30) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def hashed(seed: str, *key: str) -> Column:
    """A repeatable random order: md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key]).cast("binary"))


def stratified_sample(rows: DataFrame, group: str, key: str, total: int, quotas: dict[str, int] | None = None, seed: str = "42") -> DataFrame:
    """``quotas`` (or an equal floor) per stratum in hashed order, then filled up to ``total``.

    What strata can't give is taken from the rest in the same order; strata without a
    quota give all they have when ``quotas`` is set.
    """
    order = [hashed(seed, key), F.col(key)]
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    if quotas is not None:
        limit = F.lit(total)
        for name, n in quotas.items():
            limit = F.when(F.col(group) == name, n).otherwise(limit)
    else:
        strata = rows.select(group).distinct().count()
        limit = F.lit(total // max(1, strata))
    first = ranked.withColumn("_late", (F.col("_n") > limit).cast("int"))
    return first.orderBy("_late", *order).limit(total).drop("_n", "_late")


def without_leaks(rows: DataFrame, key: str, *used: DataFrame) -> DataFrame:
    """Rows whose key is in none of the given tables."""
    ids = used[0].select(key)
    for other in used[1:]:
        ids = ids.unionByName(other.select(key))
    return rows.join(ids.distinct(), key, "left_anti")


def resume(rows: DataFrame, key: str, done: DataFrame | None) -> DataFrame:
    """Rows not yet in the log of what is done."""
    return rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")


def prefix_fraction(rows: DataFrame, order: str, fraction: float) -> DataFrame:
    """The first round(fraction x n) rows, half to even, at least one."""
    ranked = global_rank(rows, F.col(order), name="_n")
    return ranked.where(F.col("_n") <= max(1, round(fraction * ranked.count()))).drop("_n")


def candidate_records(sources: list[DataFrame], label: Column) -> tuple[DataFrame, DataFrame]:
    """Union the sources, label them, and return (mapped, unmapped)."""
    rows = sources[0]
    for other in sources[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    labelled = rows.withColumn("mapping", label)
    return labelled.where("mapping.label IS NOT NULL"), labelled.where("mapping.label IS NULL").withColumn("reason", F.col("mapping.method")).drop("mapping")


def unit_family(unit: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for u, (family, _) in UNIT_FACTORS.items():
        out = out.when(F.lower(unit) == u, F.lit(family))
    return F.coalesce(out, F.lower(unit))


def unit_factor(unit: Column) -> Column:
    out = F.when(F.lit(False), F.lit(1.0))
    for u, (_, factor) in UNIT_FACTORS.items():
        out = out.when(F.lower(unit) == u, F.lit(float(factor)))
    return out.otherwise(1.0)


def range_aggregation(values: DataFrame, low: float = 0.0, high: float = 1e7) -> DataFrame:
    """Bounds per (parameter, unit family) from (ord, parameter, unit, value, record, category, page, quote).

    Values are converted to the first row's unit and kept within (low, high).
    """
    rows = values.withColumn("family", unit_family(F.col("unit"))).withColumn("base", F.col("value") * unit_factor(F.col("unit"))).where((F.col("base") > low) & (F.col("base") < high))
    out = rows.groupBy("parameter", "family").agg(
        F.min_by("unit", "ord").alias("unit"), F.min("base").alias("lo"), F.max("base").alias("hi"), F.countDistinct("record").alias("n_records"), F.count(F.lit(1)).alias("n_values"),
        F.slice(F.sort_array(F.collect_set("category")), 1, 3).alias("categories"), F.slice(F.sort_array(F.collect_set("page")), 1, 6).alias("pages"), F.min_by("quote", "ord").alias("quote"),
    )
    return out.withColumn("lower_bound", F.col("lo") / unit_factor(F.col("unit"))).withColumn("upper_bound", F.col("hi") / unit_factor(F.col("unit"))).drop("lo", "hi")


def scenarios(snippets: DataFrame, count: int = 30, per: int = 3, seed: str = "7", cut: int = 700) -> DataFrame:
    """Glue snippets of ``per`` categories into one text; repeated category sets are dropped.

    ``snippets``: category, source_id, text.  Scenario i takes the categories, and of each
    the snippet, that come first in the order hashed with i.
    """
    from folioforge.functions.text import truncate_at_sentence

    spark = snippets.sparkSession
    kinds = snippets.select("category").distinct()
    ids = spark.range(count).select(F.col("id").cast("string").alias("scenario"))
    pick = kinds.crossJoin(F.broadcast(ids)).withColumn("_n", F.row_number().over(Window.partitionBy("scenario").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "scenario", "category").cast("binary"))))).where(F.col("_n") <= per)
    # the least hash per scenario and category, combined before the shuffle
    by_hash = F.struct(F.md5(F.concat_ws(":", F.lit(seed), "scenario", "source_id").cast("binary")), "source_id")
    met = snippets.join(F.broadcast(pick), "category").groupBy("scenario", "_n", "category").agg(F.min_by(F.struct("source_id", "text"), by_hash).alias("s")).select("scenario", "_n", "category", "s.*")
    out = met.groupBy("scenario").agg(F.sort_array(F.collect_list(F.struct("_n", "category", "source_id", "text"))).alias("parts"))
    out = out.select("scenario", truncate_at_sentence(F.array_join(F.transform("parts", lambda p: p["text"]), " "), cut).alias("query"), F.array_sort(F.transform("parts", lambda p: p["category"])).alias("gt_categories"), F.transform("parts", lambda p: F.struct(p["category"].alias("category"), p["source_id"].alias("source_id"))).alias("sources"))
    w = Window.partitionBy("gt_categories").orderBy(F.col("scenario").cast("int"))
    return out.withColumn("_d", F.row_number().over(w)).where("_d = 1").drop("_d")


def template_question(title: Column, ordinal: Column, templates: list[str]) -> Column:
    """Fill ``{}`` of the template at ``ordinal`` mod their number."""
    return F.replace(F.get(F.array(*[F.lit(t) for t in templates]), F.pmod(ordinal.cast("int"), F.lit(len(templates)))), F.lit("{}"), title)


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small hand-written set as a table."""
    return spark.createDataFrame(rows, schema)
