"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed, join_spread, shared_root, used_salts


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges(u, v)``; component: its smallest node.

    Each round links every node's neighbours to the smallest node around it, so the number
    of rounds grows with the logarithm of the longest path.  Minima are found by grouped
    aggregation with map-side combining and sent back to a node's edges in as many parts
    as these are dealt to, so a star's centre is neither one task nor one list.  A round's
    edges are checkpointed to the shared folder.  Self-loops and repeated edges are
    allowed; a null end drops the edge.  An empty table gives an empty result.
    """
    spark = edges.sparkSession
    shared_root(spark)
    here = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    salt, said = hashed("v"), None
    for _ in range(most_rounds):
        both = here.unionByName(here.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), used_salts(F.when(F.col("v") > F.col("u"), salt)).alias("salts"))
        large = join_spread(both.where("v > u"), low.where("salts IS NOT NULL"), "u", salt).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), used_salts(salt).alias("salts"))
        small = join_spread(large, least, "u", salt).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        here = small.where("u <> v").distinct().checkpoint()
        # a star forest maps to itself: the edge set, told by count and sum of hashes, stays
        mark = here.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == said:
            break
        said = mark
    else:
        raise RuntimeError("components did not settle")
    roots = here.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return here.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
