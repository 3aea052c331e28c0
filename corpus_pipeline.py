"""The corpus pipeline: toxicity, near-dedup, decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the columns
of ``docs``; any further columns stay.  Null texts count as empty.  Each stage begins with
executors that have given back what the one before needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import give_back_heap, materialize
from folioforge.llm.decontaminate import drop_contaminated
from folioforge.llm.packing import pack_documents
from folioforge.llm.secrets import redact_live
from folioforge.llm.simhash import keep_one_of_each
from folioforge.llm.toxicity import drop_toxic, fit_toxicity
from folioforge.session import ensure_importable


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go."""
    give_back_heap(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, fit_toxicity(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: SimHash fingerprints within 3 bits, or 5-word shingles 0.8 alike."""
    give_back_heap(spark)
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    give_back_heap(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the values of live-looking secrets are replaced in its text."""
    give_back_heap(spark)
    return redact_live(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in 1024-token sequences."""
    import public_tokenizers

    give_back_heap(spark)
    # workers still hold some of what earlier stages needed, so this one keeps less
    return pack_documents(docs, str(public_tokenizers.path("byte_bpe_50k.json")), end_id=2, kept_pieces=150_000, batch_rows=2_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL can express neither the trained network nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    ensure_importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
