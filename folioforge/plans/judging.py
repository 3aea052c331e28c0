"""Blind judging of several methods' answers, agreement of two judges, and strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import first_json, likert, number_units
from folioforge.operators.generation import Model
from folioforge.operators.metrics import composite
from folioforge.operators.statistics import blind_labels, spearman, weighted_kappa

ASPECTS = ("correctness", "numeric_accuracy", "readability")


def judge_prompt(query: Column, gold: Column, answer: Column, code: Column) -> Column:
    """What a judge sees: the method only as its code."""
    return F.concat(F.lit("Question: "), query, F.lit("\nReference answer: "), F.coalesce(gold, F.lit("")), F.lit("\nAnswer "), code, F.lit(": "), F.coalesce(answer, F.lit("")), F.lit("\nScore each aspect from 1 to 5 as JSON."))


def judged(answers: DataFrame, judge: Model, aspects: tuple[str, ...] = ASPECTS) -> DataFrame:
    """``answers``: item_id, method, query, gold, answer.  Adds method_code, the aspects and ``overall``.

    Methods are coded anew for every item.  A score that can't be read is null, others are
    rounded and clipped to 1..5; ``overall`` is their mean, null unless all were read.
    """
    said = blind_labels(answers).withColumn("said", judge(judge_prompt(F.col("query"), F.col("gold"), F.col("answer"), F.col("method_code"))))
    parsed = said.withColumn("scores", F.from_json(first_json(F.col("said")), "map<string,string>"))
    scored = parsed.select("item_id", "method", "method_code", *[likert(F.try_element_at("scores", F.lit(a))).alias(a) for a in aspects])
    return scored.withColumn("overall", composite(*[F.col(a).cast("double") for a in aspects]))


def method_means(scores: DataFrame, value: str = "overall") -> DataFrame:
    """(method, n, unread, mean) of judged answers."""
    return scores.groupBy("method").agg(F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("unread"), F.avg(value).alias("mean"))


def judge_agreement(one: DataFrame, two: DataFrame, value: str = "correctness") -> DataFrame:
    """(kappa, rho) of two judges over the answers that both scored."""
    pairs = one.select("item_id", "method", F.col(value).alias("a")).join(two.select("item_id", "method", F.col(value).alias("b")), ["item_id", "method"]).where("a IS NOT NULL AND b IS NOT NULL")
    pairs = pairs.withColumns({"all": F.lit("all"), "item": F.concat_ws("|", F.col("item_id").cast("string"), "method")})
    return weighted_kappa(pairs, ["all"]).join(spearman(pairs, ["all"]), "all").drop("all")


def numeric_stratum(text: Column) -> Column:
    """numeric where a number with a unit stands in the text, else free_text."""
    return F.when(F.size(number_units(text)) > 0, "numeric").otherwise("free_text")


def stratified_means(rows: DataFrame, stratum: Column, values: list[str]) -> DataFrame:
    """(stratum, n, mean of each value) per stratum, and over all rows as ``all``."""
    each = rows.withColumn("stratum", F.explode(F.array(stratum, F.lit("all"))))
    return each.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])


def call_costs(calls: DataFrame, baseline: str, chars_per_token: float = 4.0) -> DataFrame:
    """Per method from (method, query_id, prompt_chars, completion_chars), a row a call.

    Calls a query, estimated tokens a query, and both as multiples of ``baseline``.
    """
    per = calls.groupBy("method").agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("calls"), F.sum(F.col("prompt_chars") + F.col("completion_chars")).alias("chars"))
    per = per.select("method", "queries", (F.col("calls") / F.col("queries")).alias("calls_per_query"), (F.col("chars") / chars_per_token / F.col("queries")).alias("tokens_per_query"))
    base = per.where(F.col("method") == baseline).select(F.col("calls_per_query").alias("c0"), F.col("tokens_per_query").alias("t0"))
    return per.crossJoin(F.broadcast(base)).select("method", "queries", "calls_per_query", "tokens_per_query", (F.col("calls_per_query") / F.col("c0")).alias("times_calls"), (F.col("tokens_per_query") / F.col("t0")).alias("times_tokens"))


def report_lines(rows: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """(nth, line) of a Markdown table; for small results: every row becomes a line, numbered in ``order``."""
    from pyspark.sql import Window

    names = columns or rows.columns
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]), F.lit(" |"))
    body = rows.select((F.row_number().over(Window.orderBy(*order)) + 1).cast("long").alias("nth"), cells.alias("line"))
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(names) + " |"), (1, "|" + "---|" * len(names))], "nth long, line string")
    return head.unionByName(body)


def public_columns(rows: DataFrame) -> DataFrame:
    """Without the columns whose names begin with an underscore."""
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if not c.startswith("_")])


def collection_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, n): how many rows each extracted collection has."""
    counts = [df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n")) for name, df in parts.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
