"""Answer and retrieval metrics, as expressions over columns or aggregates over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import float_text, normalized, number_units, plain_number, strip, tokens
from folioforge.functions.vectors import let


def exact_match(pred: Column, gold: Column) -> Column:
    return (strip(pred) == strip(gold)).cast("double")


def _f1(shared: Column, n_pred: Column, n_gold: Column) -> Column:
    """2PR / (P + R) = 2 shared / (pred + gold); 0 without anything shared."""
    return F.when((n_gold == 0) | (n_pred == 0) | (shared == 0), F.lit(0.0)).otherwise(2.0 * shared / (n_pred + n_gold))


def partial_match(pred: Column, gold: Column) -> Column:
    """F1 over the sets of tokens; 0 if gold has none."""
    p, g = F.array_distinct(tokens(pred)), F.array_distinct(tokens(gold))
    return _f1(F.size(F.array_intersect(p, g)), F.size(p), F.size(g))


def answer_tuples(text: Column, parameter: Column | None = None) -> Column:
    """array<struct<param, value, unit>> of an answer; without numbers the text itself; [] if empty.

    A number's value is its decimal form as tokens, "500 0" for 500.
    """
    name = F.coalesce(parameter, F.lit("")) if parameter is not None else F.lit("")
    or_ = lambda d: F.when(name == "", F.lit(d)).otherwise(name)
    row = lambda p, v, u: F.struct(p.alias("param"), v.alias("value"), u.alias("unit"))
    found = F.transform(number_units(text), lambda x: row(or_("value"), F.regexp_replace(float_text(x["value"]), r"\.", " "), x["unit"]))
    whole = normalized(text)
    return F.when(F.size(found) > 0, found).when(whole != "", F.array(row(or_("text"), whole, F.lit("")))).otherwise(F.array().cast("array<struct<param:string,value:string,unit:string>>"))


def tuple_score(p: Column, g: Column, numeric: bool = False) -> Column:
    """Mean of name, value and unit agreement (unit only if either has one).

    Values that both read as a number agree within a tenth; ``numeric`` reads the token
    form "500 0" as a number too.
    """
    name = F.when((p["param"] == "") & (g["param"] == ""), 1.0).otherwise(partial_match(p["param"], g["param"]))
    as_number = (lambda v: F.regexp_replace(v, " ", ".").try_cast("double")) if numeric else (lambda v: v.try_cast("double"))
    a, b = as_number(p["value"]), as_number(g["value"])
    close = F.when(b == 0, (a == 0).cast("double")).otherwise((F.abs(a - b) <= 0.1 * F.abs(b)).cast("double"))
    numbers = a.isNotNull() & b.isNotNull()
    value = F.when(numbers, close).otherwise(partial_match(p["value"], g["value"]))
    unit = (p["unit"] == g["unit"]).cast("double")
    return F.when(numbers | (p["unit"] != "") | (g["unit"] != ""), (name + value + unit) / 3).otherwise((name + value) / 2)


def tuple_f1(pred: Column, gold: Column, numeric: bool = False, least: float = 0.5) -> Column:
    """Greedy matching in prediction order: the best free gold tuple counts if it scores ``least``."""
    kind = "struct<free: array<int>, tp: double>"

    def take(acc: Column, p: Column) -> Column:
        scored = F.transform(acc["free"], lambda i: F.struct(tuple_score(p, F.get(gold, i), numeric).alias("s"), (-i).alias("minus")))
        best = F.array_max(scored)
        hit = F.coalesce(best["s"] >= least, F.lit(False))
        return F.struct(F.when(hit, F.array_remove(acc["free"], -best["minus"])).otherwise(acc["free"]).alias("free"), (acc["tp"] + F.when(hit, best["s"]).otherwise(0.0)).alias("tp")).cast(kind)

    all_ = F.when(F.size(gold) > 0, F.sequence(F.lit(0), F.size(gold) - 1)).otherwise(F.array().cast("array<int>"))
    tp = F.aggregate(pred, F.struct(all_.alias("free"), F.lit(0.0).alias("tp")).cast(kind), take, lambda acc: acc["tp"])
    return F.when(F.size(gold) == 0, (F.size(pred) == 0).cast("double")).when((F.size(pred) == 0) | (tp == 0), 0.0).otherwise(2 * tp / (F.size(pred) + F.size(gold)))


def numeric_error_rate(pred: Column, gold: Column, tolerance: float = 0.1) -> Column:
    """Share of gold values that the value at the same place misses; extra values don't count."""
    n = F.least(F.size(pred), F.size(gold))
    pairs = F.arrays_zip(F.slice(pred, 1, n).alias("p"), F.slice(gold, 1, n).alias("g"))
    bad = F.filter(pairs, lambda z: F.when(z["g"] == 0, z["p"] != 0).otherwise(F.abs(z["p"] - z["g"]) / F.abs(z["g"]) > tolerance))
    return F.when(F.size(gold) == 0, 0.0).otherwise(F.size(bad) / F.size(gold))


def rate(flag: Column) -> Column:
    """Share of true rows; null counts as false, and 0 of nothing is 0."""
    return F.coalesce(F.avg(F.coalesce(flag.cast("double"), F.lit(0.0))), F.lit(0.0))


def mean_where_scored(value: Column, missing: float = -1) -> Column:
    return F.avg(F.when(value != missing, value))


def context_completeness(chunk: Column, gold: Column) -> Column:
    c, g = F.array_distinct(tokens(chunk)), F.array_distinct(tokens(gold))
    return F.when(F.size(g) == 0, 0.0).otherwise(F.size(F.array_intersect(c, g)) / F.size(g))


def numbers_unsupported(answer: Column, support: Column, units: bool = True) -> Column:
    """Whether a number of the answer, or its unit, doesn't occur in the support."""
    s = F.coalesce(support, F.lit(""))
    missing = lambda x: ~F.contains(s, plain_number(x["value"]))
    return F.exists(number_units(answer), lambda x: missing(x) | ~F.contains(s, x["unit"]) if units else missing(x))


def hallucinated(answer: Column, support: Column, confidence: Column | None = None, flagged: Column | None = None, least: float = 0.6) -> Column:
    out = numbers_unsupported(answer, support)
    out = out | F.coalesce(confidence < least, F.lit(False)) if confidence is not None else out
    return out | F.coalesce(flagged, F.lit(False)) if flagged is not None else out


def unsupported(answer: Column, support: Column, has_source: Column) -> Column:
    """Numbers decide if there are any; else too few of the answer's tokens in the support."""
    a, s = F.array_distinct(tokens(answer)), F.array_distinct(tokens(support))
    share = F.size(F.array_intersect(a, s)) / F.size(a)
    return (
        F.when((F.size(a) == 0) | (F.coalesce(support, F.lit("")) == ""), True)
        .when(F.size(number_units(answer)) > 0, numbers_unsupported(answer, support, units=False))
        .otherwise(share < F.when(has_source, 0.2).otherwise(0.3))
    )


def traceability(pred: Column, support: Column, least: int = 3, empty: float = 0.0) -> Column:
    """Share of the answer's ASCII words of ``least`` characters that occur in the support."""
    words = F.regexp_extract_all(F.lower(pred), F.lit(rf"[a-z0-9]{{{least},}}"), F.lit(0))
    found = let(F.struct(words.alias("w"), F.lower(support).alias("s")), lambda x: F.size(F.filter(x["w"], lambda w: F.contains(x["s"], w))))
    return F.when(F.size(words) == 0, empty).otherwise(found / F.size(words))


def coverage(gold: Column, retrieved: Column) -> Column:
    """Share of gold tokens of two characters or more that occur in what was retrieved; 1 without any."""
    return traceability(gold, retrieved, least=2, empty=1.0)


def retrieval_metrics(hits: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Per query: recall@k, reciprocal rank over the whole list, NDCG@k with the ideal of min(relevant, k)."""
    relevant = gold.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("n_rel"))
    found = hits.join(gold.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi")
    per = found.groupBy("query_id").agg(F.count(F.when(F.col("rank") <= k, 1)).alias("n"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1.0))
    out = relevant.join(per, "query_id", "left")
    return out.select("query_id", (F.coalesce("n", F.lit(0)) / F.col("n_rel")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def window_hit_metrics(hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), depth: int = 10) -> DataFrame:
    """From (query_id, rank, hit): hit@k, MRR@depth, and NDCG@depth with the ideal of the hits observed."""
    seen = hits.where(F.col("rank") <= depth).groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.count(F.when(F.col("hit"), 1)).alias("n"), F.sum(F.when(F.col("hit"), 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1.0))
    flags = [F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)).alias(f"recall_{k}") for k in ks]
    return seen.select("query_id", *flags, F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"), F.col("first").alias("first_hit_rank"))


def type_match_accuracy(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(rate(F.arrays_overlap("query_types", "chunk_types")).alias("type_match_accuracy"))


def category_scores(pred: Column, gold: Column) -> Column:
    """struct<precision, recall, f1, exact> of two label sets; recall is 1 without gold."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    shared = F.size(F.array_intersect(p, g))
    precision = F.when(F.size(p) == 0, 0.0).otherwise(shared / F.size(p))
    recall = F.when(F.size(g) == 0, 1.0).otherwise(shared / F.size(g))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), (F.array_sort(p) == F.array_sort(g)).cast("double").alias("exact"))


def composite(*scores: Column) -> Column:
    return sum(scores[1:], scores[0]) / len(scores)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
