"""Shared pieces of the training-data operators: input shaping, hot joins and state of workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.storage import materialize, scratch_path, shared_root

__all__ = ["batches_of", "free_names", "give_back", "give_back_heap", "hashed", "id_and_text", "join_spread", "map_whole_rows", "materialize", "scratch_path", "shared_root", "text_position", "used_salts", "worker_state"]

T = TypeVar("T")
_STATE: dict[object, object] = {}
#: A hot key's rows are dealt to so many parts; a mask of 64 bits says which occur.
SALTS = 64


def worker_state(key: object, make: Callable[[], T]) -> T:
    """What a Python worker keeps between tasks, made once: one thing at a time.

    Workers live on from stage to stage; what an earlier operator kept goes when another
    one's is made, so that memory doesn't add up over a pipeline.
    """
    if key not in _STATE:
        _STATE.clear()
        give_back()
        _STATE[key] = make()
    return _STATE[key]  # type: ignore[return-value]


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def give_back_heap(spark: SparkSession) -> None:
    """Let every executor collect its garbage and return the freed heap to the system.

    An executor's heap grows to its limit over the steps of a pipeline, though little of it is
    in use between them, and stands beside what its Python workers need.  One task for each
    core reaches all executors, as none is busy between steps; where others' jobs run some
    may be missed, which costs memory only.
    """
    cores = spark.sparkContext.defaultParallelism
    asked = spark.range(0, cores, 1, cores).select(F.call_function("reflect", F.lit("java.lang.System"), F.lit("gc")).alias("said"))
    asked.write.format("noop").mode("overwrite").save()


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """What is executed inside hands Python workers ``rows`` rows at a time (None: as the session does).

    A batch is held by the executor and by its worker at once, so this bounds both; every
    row is still handed over.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows is not None:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; null text is empty.

    Selecting them first keeps every other column of the input, whatever its name, out
    of the operator.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each made longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_position(df: DataFrame, name: str = "text") -> int:
    """Where the column stands; names are compared as Spark does by default, without case."""
    return [c.lower() for c in df.columns].index(name.lower())


def map_whole_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: str = "") -> DataFrame:
    """``mapInArrow`` that keeps all columns, whatever their names, and may add ``more`` (DDL) at the end.

    ``run`` sees the columns by position.
    """
    slim = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    added = StructType.fromDDL(more).fields if more else []
    return slim.mapInArrow(run, StructType([*slim.schema.fields, *added])).toDF(*df.columns, *[f.name for f in added])


def hashed(*columns: Column | str) -> Column:
    """A row's part, 0 to ``SALTS`` - 1, by a hash of ``columns``."""
    return F.pmod(F.xxhash64(F.lit("part"), *columns), F.lit(SALTS)).cast("int")


def used_salts(salt: Column) -> Column:
    """Aggregate: which parts a key's rows lie in, as bits; combined before the shuffle."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt))


def join_spread(rows: DataFrame, one: DataFrame, key: str, salt: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``one`` on ``key``, where ``rows`` may have very many rows of a key.

    ``one`` has a row per key and, in ``salts``, the parts that occur (``used_salts`` of
    the same ``salt``); each of its rows is repeated once per part, so never more often
    than the key has rows, and a hot key's rows go to ``SALTS`` tasks.
    """
    part, key2 = "_part", "_key"
    wide = one.withColumn(part, F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1))).drop("salts").withColumnRenamed(key, key2)
    dealt = rows.withColumn("_salt", salt)
    return dealt.join(wide, (F.col(key) == F.col(key2)) & (F.col("_salt") == F.col(part)), how).drop("_salt", part, key2)
