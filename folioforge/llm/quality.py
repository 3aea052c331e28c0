"""Quality rules with risk-controlled thresholds, as DataFrame expressions.

Base rules are fixed.  The learned rule rejects a text whose badness is above its
stratum's cutoff.  Badness is the largest of the shares of symbols, repeated lines,
capitals and repeated words.  Cutoffs come from labelled texts: for every stratum and
every cutoff of a fixed grid the number of good texts that it would reject is tested
against the limit ``risk`` by the exact binomial tail, at level ``delta`` divided by the
number of all tests (Bonferroni).  So with probability 1 - delta no stratum's cutoff
rejects more than ``risk`` of its good texts.  Among the cutoffs that pass, the one that
best separates the labels is taken; a stratum where none passes rejects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: What parts words, and the symbols.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Risk:
    risk: float = 0.05
    delta: float = 0.05
    cutoffs: int = 24
    price: float = 20.0  # a rejected good text weighs as so many kept bad ones, as shares


def base_statistics(docs: DataFrame, stratum: Column) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, badness.

    One pass without a shuffle, linear in a text's length but for sorting its windows'
    hashes.  Null text has no words.  n_repeat_words counts the positions that some
    5-word window covers which occurs twice or more.  Windows are compared by 64-bit hash.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum.cast("string").alias("stratum"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.regexp_replace(x, SPACES, "") != ""))
    rows = rows.select(
        "doc_id", "stratum", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    n = F.size("h")
    window = lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(5)])
    rows = rows.withColumn("g", F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), window)).otherwise(F.array().cast("array<bigint>"))).drop("h")
    again = F.size(F.array_distinct("g")) < F.size("g")
    placed = F.sort_array(F.transform("g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = rows.withColumn("s", F.when(again, placed)).drop("g")
    same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
    twice = F.filter("s", lambda x, i: same(x, F.get("s", i + 1)) | same(x, F.get("s", i - 1)))
    rows = rows.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("s")
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("at", i + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    badness = F.greatest(share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_capitals", "word_chars"), share("n_repeat_words", "n_words"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", badness.alias("badness"), failed.alias("base_failed"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials at probability p, by summing its terms' logarithms."""
    odds = F.lit(p / (1 - p))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.when(i > 0, F.log((n - i + 1) / i * odds)).otherwise(F.lit(0.0))
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    first = F.struct((n * F.log1p(F.lit(-p))).cast("double").alias("term"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), k), first, add, lambda acc: F.least(acc["sum"], F.lit(1.0)))


def risk_controlled_cutoffs(labelled: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(stratum, cutoff, n_good, n_rejected, p_value) from (stratum, badness, good boolean).

    Strata without a passing cutoff have no row.  Counting is one shuffle of stratum x
    cutoff partial counts, whatever the number of labels.
    """
    grid = [round(0.02 + 0.96 * (i / (risk.cutoffs - 1)) ** 2, 6) for i in range(risk.cutoffs)]
    above = [F.sum((F.col("badness") > c).cast("long") * good).alias(f"{name}{i}") for i, c in enumerate(grid) for name, good in (("g", F.col("good").cast("long")), ("b", (~F.col("good")).cast("long")))]
    counts = labelled.where("stratum IS NOT NULL AND good IS NOT NULL").groupBy("stratum").agg(F.sum(F.col("good").cast("long")).alias("n_good"), F.count(F.lit(1)).alias("n_all"), *above)
    tests = counts.select("stratum", "n_good", "n_all", F.count(F.lit(1)).over(Window.partitionBy()).alias("strata"), F.explode(F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"g{i}").alias("n_rejected"), F.col(f"b{i}").alias("n_caught")) for i, c in enumerate(grid)])).alias("t"))
    tests = tests.select("stratum", "n_good", "n_all", "strata", "t.*")
    # over the limit already: no need to sum the tail
    tests = tests.withColumn("p_value", F.when(F.col("n_rejected") <= F.col("n_good") * risk.risk, binomial_tail(F.col("n_rejected"), F.col("n_good"), risk.risk)).otherwise(F.lit(1.0)))
    passed = tests.where(F.col("p_value") * F.col("strata") * risk.cutoffs <= risk.delta)
    value = F.coalesce(F.col("n_caught") / F.nullif(F.col("n_all") - F.col("n_good"), F.lit(0)), F.lit(0.0)) - risk.price * F.col("n_rejected") / F.col("n_good")
    best = Window.partitionBy("stratum").orderBy(value.desc(), F.col("cutoff").desc())
    return passed.withColumn("place", F.row_number().over(best)).where("place = 1 AND n_caught > 0").select("stratum", "cutoff", "n_good", "n_rejected", "p_value")


def judge_quality(docs: DataFrame, labels: DataFrame, stratum: Column | None = None, risk: Risk = Risk()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, badness and cutoff of every row.

    Strata are languages unless given; rows without one are kept unless they fail the base
    rules.  Labels with a null quality or identifier don't count; several labels of one
    document count as good if any is.  Empty tables give empty results or no cutoffs.
    """
    stats = materialize(base_statistics(docs, F.col("lang") if stratum is None else stratum), "quality-statistics")
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).alias("good"))
    labelled = stats.where("NOT base_failed").select("doc_id", "stratum", "badness").join(known, "doc_id")
    cutoffs = risk_controlled_cutoffs(labelled, risk).select("stratum", "cutoff")
    judged = stats.join(cutoffs, "stratum", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("badness") <= F.col("cutoff"), F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "badness", "cutoff")
