"""Answer plans around pluggable models, and grounded verification of the values in answers.

A model is a function Column -> Column (prompt to answer), so a plan is one lazy query; the
default stand-in quotes its context and needs no network.  A hit table here has query_id,
rank, chunk_id, content and score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import parameter_values, plain_number, quote_around

from .lexicon import BOUNDS, PROFILES
from .retrieval import reciprocal_rank_fusion

Model = Callable[[Column], Column]

NOTHING_FOUND = "No relevant content found"
WARNING_HEAD = "\n\n---\nVerification Warnings:\n"


def extractive_model(prompt: Column) -> Column:
    """Offline stand-in: the first paragraph after the references' head."""
    return F.trim(F.regexp_extract(prompt, r"(?s)References:\n\[Source 1\][^\n]*\n(.*?)(?:\n\n|\z)", 1))


def _ordered(hits: DataFrame, *columns: str) -> DataFrame:
    """One row per query: its hits by rank (at most the k of retrieval)."""
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", *columns))).alias("hits"))


def contexts(hits: DataFrame, cut: int | None = None) -> DataFrame:
    """(query_id, context, sources, top_score): sources numbered by rank, an empty line between."""
    rows = _ordered(hits, "chunk_id", "content", "score")
    content = (lambda h: h["content"]) if cut is None else (lambda h: F.substring(h["content"], 1, cut))
    block = F.transform("hits", lambda h: F.concat(F.lit("[Source "), h["rank"].cast("string"), F.lit("] (chunk_id: "), h["chunk_id"], F.lit(")\n"), content(h)))
    return rows.select("query_id", F.array_join(block, "\n\n").alias("context"), F.transform("hits", lambda h: h["chunk_id"]).alias("sources"), F.array_max(F.transform("hits", lambda h: h["score"])).alias("top_score"))


def source_only(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """The retrieved texts themselves, without a model."""
    rows = _ordered(hits, "chunk_id", "content").select("query_id", F.array_join(F.transform("hits", lambda h: h["content"]), "\n\n---\n\n").alias("answer"), F.transform("hits", lambda h: h["chunk_id"]).alias("sources"))
    out = queries.select("query_id").join(rows, "query_id", "left")
    return out.select("query_id", F.coalesce("answer", F.lit(NOTHING_FOUND)).alias("answer"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.lit(1.0).alias("confidence"))


def prompt_for(context: Column, query: Column, instruction: str = "Answer from the references only.") -> Column:
    return F.concat(F.lit(instruction + "\n\nReferences:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), query, F.lit("\n\nAnswer:"))


def direct(queries: DataFrame, hits: DataFrame, model: Model = extractive_model) -> DataFrame:
    """One call with the context; confidence is the best score, 0.3 without hits."""
    rows = queries.select("query_id", "text").join(contexts(hits), "query_id", "left").withColumn("prompt", prompt_for(F.col("context"), F.col("text")))
    return rows.select("query_id", model(F.col("prompt")).alias("answer"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.coalesce("top_score", F.lit(0.3)).alias("confidence"), F.length("prompt").cast("long").alias("prompt_chars"))


def rag_fusion(queries: DataFrame, hits: DataFrame, variant_hits: DataFrame, model: Model = extractive_model, k: int = 5) -> DataFrame:
    """Fuse the hits of the query and of its variants by reciprocal rank, then answer."""
    lists = hits.select("query_id", "chunk_id", "rank", "ord").unionByName(variant_hits.select("query_id", "chunk_id", "rank", "ord"))
    texts = hits.select("chunk_id", "content").unionByName(variant_hits.select("chunk_id", "content")).dropDuplicates(["chunk_id"])
    return direct(queries, reciprocal_rank_fusion(lists, k).join(texts, "chunk_id"), model)


def parse_ranking(answer: Column, k: int) -> Column:
    """Passage numbers after RANK:, within 1..k, distinct; then those not named, in order."""
    named = F.transform(F.regexp_extract_all(F.regexp_extract(answer, r"RANK:\s*([^\n]*)", 1), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    good = F.array_distinct(F.filter(named, lambda i: i.isNotNull() & (i >= 1) & (i <= k)))
    return F.when(F.size(good) > 0, good).otherwise(F.sequence(F.lit(1), F.lit(k)))


def after_answer(answer: Column) -> Column:
    """What follows ANSWER:, or the whole."""
    return F.when(F.contains(answer, F.lit("ANSWER:")), F.trim(F.substring_index(answer, "ANSWER:", -1))).otherwise(F.trim(answer))


def rank_and_answer(queries: DataFrame, hits: DataFrame, model: Model, most: int = 8, cut: int = 500) -> DataFrame:
    """One call that ranks up to ``most`` passages of ``cut`` characters and answers; sources: first 3."""
    few = hits.where(F.col("rank") <= most)
    rows = queries.select("query_id", "text").join(contexts(few, cut), "query_id").withColumn("said", model(prompt_for(F.col("context"), F.col("text"), "Rank the passages as RANK: numbers, then write ANSWER:")))
    order = F.filter(parse_ranking(F.col("said"), most), lambda i: i <= F.size("sources"))
    return rows.select("query_id", after_answer(F.col("said")).alias("answer"), F.slice(F.transform(order, lambda i: F.get("sources", i - 1)), 1, 3).alias("sources"))


def verdict_branch(said: Column, strict: bool = False) -> Column:
    """correct, ambiguous or incorrect; "incorrect" holds "correct" unless ``strict``."""
    low = F.lower(said)
    right = F.contains(low, F.lit("correct"))
    right = right & ~F.contains(low, F.lit("incorrect")) if strict else right
    return F.when(right, "correct").when(F.contains(low, F.lit("ambiguous")), "ambiguous").otherwise("incorrect")


def corrective(queries: DataFrame, hits: DataFrame, judge: Model, model: Model = extractive_model, least: float = 0.3, strict: bool = False) -> DataFrame:
    """Judge the first three hits; answer with all, with those above ``least`` (or the first), or without context."""
    judged = queries.select("query_id", "text").join(contexts(hits.where("rank <= 3")).select("query_id", "context"), "query_id", "left")
    judged = judged.select("query_id", "text", F.when(F.col("context").isNull(), "incorrect").otherwise(verdict_branch(judge(prompt_for(F.col("context"), F.col("text"), "Judge the references.")), strict)).alias("branch"))
    over = hits.withColumn("any", F.max(F.col("score") > least).over(Window.partitionBy("query_id")))
    kept = over.where((F.col("score") > least) | (~F.col("any") & (F.col("rank") == 1)))
    used = hits.join(judged.where("branch = 'correct'").select("query_id"), "query_id", "left_semi").select("query_id", "rank", "chunk_id", "content", "score")
    used = used.unionByName(kept.join(judged.where("branch = 'ambiguous'").select("query_id"), "query_id", "left_semi").select(*used.columns))
    return direct(queries, used, model).join(judged.select("query_id", "branch"), "query_id")


def critique_score(said: Column) -> Column:
    """Mean of the three named scores, 3 where one can't be read."""
    one = lambda n: F.coalesce(F.regexp_extract(said, rf"{n}\s*=\s*(\d)", 1).try_cast("double"), F.lit(3.0))
    return (one("IsRel") + one("IsSup") + one("IsUse")) / 3


def self_reflective(queries: DataFrame, hits: DataFrame, needs: Model, critic: Model, model: Model = extractive_model) -> DataFrame:
    """If retrieval is needed, a candidate per first three hits; the best critique wins, ties by rank."""
    asked = queries.select("query_id", "text", F.contains(F.lower(needs(F.col("text"))), F.lit("yes")).alias("needed"))
    met = asked.where("needed").join(hits.where("rank <= 3"), "query_id")
    each = met.withColumn("answer", model(prompt_for(F.concat(F.lit("[Source 1] (chunk_id: "), F.col("chunk_id"), F.lit(")\n"), F.col("content")), F.col("text"))))
    each = each.withColumn("value", critique_score(critic(F.concat("text", F.lit("\n"), "answer"))))
    best = each.groupBy("query_id").agg(F.max_by(F.struct("answer", "chunk_id", "value"), F.struct("value", (-F.col("rank")).alias("r"))).alias("b"))
    out = asked.join(best, "query_id", "left")
    return out.select("query_id", F.coalesce("b.answer", model(prompt_for(F.lit(None).cast("string"), F.col("text")))).alias("answer"), F.array_compact(F.array("b.chunk_id")).alias("sources"), F.coalesce(F.col("b.value") / 5, F.lit(0.5)).alias("confidence"))


# ---- verification ------------------------------------------------------------------


def _bound_rows(bounds: list[tuple], profile: str | None) -> list[tuple[str, str, float, float]]:
    own = PROFILES[profile][3] if profile else {}
    return [(p, u, *own.get(p, (lo, hi))) for p, u, lo, hi, *_ in bounds]


def matching_bound(parameter: Column, unit: Column, bounds: list[tuple] = BOUNDS, profile: str | None = None) -> Column:
    """struct<parameter, unit, lower, upper>: by exact name; else the first with the unit whose name holds, or is held by, the parameter in any case.

    The bounds are a fixed list, so this is one expression and no join.
    """
    rows = _bound_rows(bounds, profile)
    as_struct = lambda r: F.struct(F.lit(r[0]).alias("parameter"), F.lit(r[1]).alias("unit"), F.lit(float(r[2])).alias("lower"), F.lit(float(r[3])).alias("upper"))
    out = F.when(F.lit(False), as_struct(rows[0]))
    for r in rows:
        out = out.when(parameter == r[0], as_struct(r))
    low = F.lower(parameter)
    for r in rows:
        name = r[0].lower()
        out = out.when((unit == r[1]) & (F.contains(low, F.lit(name)) | F.contains(F.lit(name), low)), as_struct(r))
    return out


def verify_values(answers: DataFrame, hits: DataFrame, bounds: list[tuple] = BOUNDS, profile: str | None = None, weights: tuple[float, float, float] = (0.2, 0.5, 0.3), threshold: float = 0.4) -> DataFrame:
    """One row per value in an answer: tracing, plausibility, consistency, confidence, flags.

    ``answers``: query_id, answer.  Every value meets the query's hits only; a value with
    no hit keeps its row.
    """
    values = answers.select("query_id", F.posexplode(parameter_values(F.col("answer"))).alias("pos", "v")).select("query_id", "pos", "v.*").withColumn("text_value", plain_number(F.col("value")))
    met = values.join(hits.select("query_id", "rank", "chunk_id", "content"), "query_id", "left")
    holds = F.contains("content", F.col("text_value"))
    about = F.contains("content", F.col("parameter")) | F.contains("content", F.col("unit"))
    rows = met.groupBy("query_id", "pos", "parameter", "value", "unit", "text_value").agg(
        F.min(F.when(holds, F.struct("rank", "chunk_id", quote_around(F.col("content"), F.col("text_value")).alias("quote")))).alias("source"),
        F.count(F.when(about, 1)).alias("n_sources"), F.count(F.when(about & holds, 1)).alias("n_agree"),
    )
    bound = matching_bound(F.col("parameter"), F.col("unit"), bounds, profile)
    rows = rows.withColumn("bound", bound).withColumn("inside", F.col("value").between(F.col("bound.lower"), F.col("bound.upper")))
    rows = rows.withColumn("source_score", F.when(F.col("source").isNotNull(), 1.0).otherwise(0.3))
    rows = rows.withColumn("plausibility", F.when(F.col("bound").isNull(), 0.8).when(F.col("inside"), 1.0).otherwise(0.0))
    rows = rows.withColumn("is_hallucination", F.col("bound").isNotNull() & ~F.coalesce("inside", F.lit(True)))
    rows = rows.withColumn("consistency", F.when(F.col("n_sources") > 0, F.col("n_agree") / F.col("n_sources")).otherwise(0.5))
    rows = rows.withColumn("confidence", weights[0] * F.col("source_score") + weights[1] * F.col("plausibility") + weights[2] * F.col("consistency"))
    flags = F.array(
        F.when(F.col("source").isNull(), F.lit("inferred")),
        F.when(F.col("is_hallucination"), F.lit("out_of_bounds")),
        F.when((F.col("consistency") < 0.5) & (F.col("n_sources") >= 2), F.lit("inconsistent")),
        F.when(F.col("confidence") < threshold, F.lit("low_confidence")),
    )
    return rows.select("query_id", "pos", "parameter", "value", "unit", F.col("source.chunk_id").alias("source_chunk_id"), F.col("source.quote").alias("source_quote"), "source_score", "plausibility", "consistency", "confidence", "is_hallucination", F.array_compact(flags).alias("flags"))


def grounded(answers: DataFrame, verified: DataFrame) -> DataFrame:
    """Answers with warnings for values out of bounds, and their mean confidence (0.8 without values)."""
    line = F.concat(F.lit("[Suspected Hallucination] "), "parameter", F.lit("="), plain_number(F.col("value")), "unit", F.lit(" — "), F.array_join("flags", "; "))
    per = verified.groupBy("query_id").agg(F.avg("confidence").alias("confidence"), F.sort_array(F.collect_list(F.when(F.col("is_hallucination"), F.struct("pos", line.alias("line"))))).alias("bad"))
    out = answers.join(per, "query_id", "left")
    text = F.when(F.size("bad") > 0, F.concat("answer", F.lit(WARNING_HEAD), F.array_join(F.transform("bad", lambda b: b["line"]), "\n"))).otherwise(F.col("answer"))
    return out.select("query_id", text.alias("answer"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"))


def strip_warnings(answer: Column) -> Column:
    return F.substring_index(answer, WARNING_HEAD, 1)
