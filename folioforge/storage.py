"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder: as set with ``setCheckpointDir``, or else ``spark.checkpoint.dir``.

    Where the session has none a temporary folder of this process is used and set as the
    checkpoint folder, on a local master only: on a cluster the executors could not see
    it, so there this raises.
    """
    context = spark.sparkContext
    own = _OWN_ROOTS.get(context.applicationId)
    if own:
        return own
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    at = context._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    held = tempfile.TemporaryDirectory(prefix="folioforge-", ignore_cleanup_errors=True)
    atexit.register(held.cleanup)
    _OWN_ROOTS[context.applicationId] = f"file://{held.name}"
    context.setCheckpointDir(_OWN_ROOTS[context.applicationId])
    return _OWN_ROOTS[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_root(spark)}/folioforge/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; nothing depends on this
        pass


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its files alone would keep only some busy.

    A table below 4 MB (what opening a file counts as) for each core is dealt out anew; a
    larger one is split by its scan and left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    planned = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if planned < cores * 4 * 2**20 else df


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that read it, and what is
    read several times is computed once.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
