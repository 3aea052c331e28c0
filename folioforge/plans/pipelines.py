"""Pipelines as compositions of a chunker, a retriever and a generator.

Each is a frozen value of three functions over DataFrames.  ``ingest`` makes an index of
whole documents once; ``run`` answers a whole query table with one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import tokens
from folioforge.functions.vectors import hashed_bag
from folioforge.operators import chunking, generation, metrics, retrieval
from folioforge.operators import statistics as stats
from folioforge.operators.ranking import global_rank
from folioforge.storage import materialize

Embed = Callable[[Column], Column]


def hashed_embedder(text: Column) -> Column:
    """The offline stand-in for an embedding model."""
    return hashed_bag(tokens(text))


@dataclass(frozen=True)
class Index:
    chunks: DataFrame
    lexical: retrieval.LexicalIndex
    vectors: DataFrame


@dataclass(frozen=True)
class Pipeline:
    """``chunk``: documents to chunks; ``retrieve``: (index, queries, k) to hits with content;
    ``generate``: (queries, hits) to answers."""

    name: str
    chunk: Callable[[DataFrame], DataFrame]
    retrieve: Callable[[Index, DataFrame, int], DataFrame]
    generate: Callable[[DataFrame, DataFrame], DataFrame]
    embed: Embed = hashed_embedder

    def ingest(self, docs: DataFrame) -> Index:
        """``docs``: doc_id, text.  ``ord`` of the index orders chunks by document, then emission.

        Chunks, vectors and token lists are written: every query table reads them.
        """
        cut = self.chunk(docs)
        chunks = materialize(cut.withColumn("within", F.col("ord")).withColumn("ord", F.struct("doc_id", "within")), "chunks")
        vectors = materialize(chunks.select("chunk_id", "ord", self.embed(F.col("content")).alias("vector")), "vectors")
        return Index(chunks, retrieval.lexical_index(chunks.select("chunk_id", "ord", "content")).stored(), vectors)

    def run(self, index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
        """answers of ``queries`` (query_id, text)."""
        asked = queries.withColumn("vector", self.embed(F.col("text")))
        return self.generate(queries, materialize(self.retrieve(index, asked, k), "hits"))


def _with_content(index: Index, hits: DataFrame) -> DataFrame:
    return hits if "content" in hits.columns else hits.join(index.chunks.select("chunk_id", "content"), "chunk_id")


def by_vectors(index: Index, queries: DataFrame, k: int) -> DataFrame:
    return _with_content(index, retrieval.dense(index.vectors, queries, k))


def by_words(index: Index, queries: DataFrame, k: int) -> DataFrame:
    return _with_content(index, retrieval.bm25(index.lexical, queries, k))


def by_both(index: Index, queries: DataFrame, k: int) -> DataFrame:
    n = retrieval.recall(k)
    return _with_content(index, retrieval.hybrid(retrieval.dense(index.vectors, queries, n), retrieval.bm25(index.lexical, queries, n), k))


def by_category(index: Index, queries: DataFrame, k: int, settings: retrieval.CategoryRanking = retrieval.CategoryRanking()) -> DataFrame:
    n = settings.recall
    return retrieval.category_rank(index.chunks, queries, retrieval.dense(index.vectors, queries, n), retrieval.bm25(index.lexical, queries, n), k, settings)


def by_two_stages(index: Index, queries: DataFrame, k: int) -> DataFrame:
    return _with_content(index, retrieval.dual_stage(index.lexical, index.vectors, queries, k))


def by_passage(write: generation.Model, embed: Embed = hashed_embedder) -> Callable[[Index, DataFrame, int], DataFrame]:
    """``write`` makes the hypothetical passage of a query."""
    return lambda index, queries, k: _with_content(index, retrieval.hyde(index.vectors, queries.withColumn("passage_vector", embed(write(F.col("text")))), k))


def by_variants(write: generation.Model, embed: Embed = hashed_embedder) -> Callable[[Index, DataFrame, int], DataFrame]:
    """``write`` makes numbered reformulations of a query."""

    def run(index: Index, queries: DataFrame, k: int) -> DataFrame:
        variants = queries.select("query_id", F.posexplode(retrieval.query_variants(F.col("text"), write(F.col("text")))).alias("variant", "v"))
        return _with_content(index, retrieval.multi_query(index.vectors, variants.select("query_id", "variant", embed(F.col("v")).alias("vector")), k))

    return run


def bound_grounded(model: generation.Model = generation.extractive_model, profile: str | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def run(queries: DataFrame, hits: DataFrame) -> DataFrame:
        answers = generation.direct(queries, hits, model)
        verified = generation.verify_values(answers.select("query_id", "answer"), hits, profile=profile)
        return generation.grounded(answers.select("query_id", "answer", "sources"), verified).join(answers.select("query_id", "sources"), "query_id")

    return run


def direct(model: generation.Model = generation.extractive_model) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda queries, hits: generation.direct(queries, hits, model)


def same(text: Column) -> Column:
    """Stand-in for a writing model: the text itself."""
    return text


def paragraph_outline(text: Column) -> Column:
    """Offline stand-in for a model that outlines a document: a block per paragraph, as JSON."""
    kind = "struct<at: int, out: array<struct<level: int, start: int, end: int>>>"
    first = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind)

    def add(acc: Column, part: Column) -> Column:
        block = F.struct(F.lit(1).alias("level"), acc["at"].alias("start"), (acc["at"] + F.length(part)).alias("end"))
        return F.struct((acc["at"] + F.length(part) + 2).alias("at"), F.array_append(acc["out"], block).alias("out")).cast(kind)

    return F.to_json(F.aggregate(F.split(text, "\n\n"), first, add, lambda acc: acc["out"]))


def outlined_chunks(outline: generation.Model = paragraph_outline) -> Callable[[DataFrame], DataFrame]:
    """Chunks by a model's outline of each document; ``outline`` maps a text to its answer."""
    return lambda docs: chunking.hierarchical_chunks(docs, docs.select("doc_id", outline(F.col("text")).alias("answer")))


def standard_pipelines(model: generation.Model = generation.extractive_model, write: generation.Model = same, judge: generation.Model = lambda p: F.lit("correct"), outline: generation.Model = paragraph_outline) -> dict[str, Pipeline]:
    """The ten standard compositions by name."""
    fixed, recursive, structured = chunking.fixed_chunks, chunking.recursive_chunks, chunking.structured_chunks
    make = {
        "naive": (fixed, by_vectors, direct(model)),
        "dense": (recursive, by_vectors, direct(model)),
        "hyde": (recursive, by_passage(write), direct(model)),
        "multi_query": (recursive, by_variants(write), direct(model)),
        "dual_stage": (recursive, by_two_stages, direct(model)),
        "corrective": (recursive, by_vectors, lambda q, h: generation.corrective(q, h, judge, model)),
        "rank_and_answer": (recursive, by_vectors, lambda q, h: generation.rank_and_answer(q, h, model)),
        "hierarchical": (outlined_chunks(outline), by_vectors, direct(model)),
        "source_only": (recursive, by_words, generation.source_only),
        "full": (structured, by_category, bound_grounded(model)),
    }
    return {name: Pipeline(name, *parts) for name, parts in make.items()}


def ablations(model: generation.Model = generation.extractive_model) -> dict[str, Pipeline]:
    """Structured or recursive chunks x category or hybrid ranking x grounded or direct; the plain corner's double is left out."""
    chunkers = {"structured": chunking.structured_chunks, "recursive": chunking.recursive_chunks}
    rankers = {"category": by_category, "hybrid": by_both}
    writers = {"grounded": bound_grounded(model), "direct": direct(model)}
    out = {f"{c}-{r}-{w}": Pipeline(f"{c}-{r}-{w}", chunkers[c], rankers[r], writers[w]) for c in chunkers for r in rankers for w in writers}
    out.pop("recursive-hybrid-grounded")
    return out


def weight_sweep(index: Index, queries: DataFrame, settings: list[retrieval.CategoryRanking], k: int = 5) -> DataFrame:
    """Hits of every setting over one index, with the setting's place in ``config``."""
    asked = queries
    n = max(s.recall for s in settings)
    dense, words = retrieval.dense(index.vectors, asked, n), retrieval.bm25(index.lexical, asked, n)
    out = None
    for i, s in enumerate(settings):
        part = retrieval.category_rank(index.chunks, asked, dense.where(F.col("rank") <= s.recall), words.where(F.col("rank") <= s.recall), k, s).withColumn("config", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def evaluate(answers: DataFrame, gold: DataFrame, group: list[str]) -> DataFrame:
    """Means per ``group`` of exact, partial and tuple F1, hallucination and traceability.

    ``answers``: group columns, item, answer, support; ``gold``: item, gold, parameter.
    """
    rows = answers.join(gold, "item").withColumn("pred", generation.strip_warnings(F.col("answer")))
    rows = rows.withColumn("pt", metrics.answer_tuples(F.col("pred"), F.col("parameter"))).withColumn("gt", metrics.answer_tuples(F.col("gold"), F.col("parameter")))
    each = rows.select(
        *group, "item",
        metrics.exact_match(F.col("pred"), F.col("gold")).alias("em"), metrics.partial_match(F.col("pred"), F.col("gold")).alias("pm"),
        metrics.tuple_f1(F.col("pt"), F.col("gt")).alias("tuple_f1"),
        (F.coalesce(F.length("pred"), F.lit(0)) == 0).__or__(metrics.numbers_unsupported(F.col("pred"), F.col("support"), units=False)).cast("double").alias("hallucination"),
        metrics.traceability(F.col("pred"), F.col("support")).alias("traceability"),
    )
    return each.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("em", "pm", "tuple_f1", "hallucination", "traceability")])


def compare_methods(scores: DataFrame, baseline: str, score: str = "score", resamples: int = 2000) -> DataFrame:
    """Paired bootstrap of every method against ``baseline`` over the items both have."""
    base = scores.where(F.col("method") == baseline).select("item", F.col(score).alias("b"))
    pairs = scores.where(F.col("method") != baseline).select("method", "item", F.col(score).alias("a")).join(base, "item")
    return stats.paired_bootstrap(pairs, ["method"], resamples)


def complete_cases(scores: DataFrame, methods: list[str]) -> DataFrame:
    """One row per item that every method has, a column per method."""
    return scores.groupBy("item").pivot("method", methods).agg(F.first("score")).na.drop(subset=methods)


def corpus_fractions(docs: DataFrame, fractions: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Each document once for every corpus fraction that has it, by rank of identifier."""
    ranked = global_rank(docs, F.col("doc_id"), name="_n")
    total = ranked.count()
    sizes = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.lit(max(1, round(f * total))).alias("most")) for f in fractions])
    return ranked.withColumn("_f", F.explode(sizes)).where(F.col("_n") <= F.col("_f.most")).select(*docs.columns, "_f.fraction")


def swept(pipeline: Pipeline, **changes) -> Pipeline:
    return replace(pipeline, **changes)
