"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Shards stand on a ring of 64-bit positions at many virtual nodes each; a row belongs to
the shard of the first virtual node clockwise from its key's hash.  Loads are bounded: a
shard takes its own rows up to its bound in ring order, and rows beyond it go on clockwise
to the next shards that have room.  With a load factor of 1 the bounds are the two nearest
whole numbers to rows / shards, so counts differ by one at most while a row moves only if
its shard overflows.

All of it is DataFrame expressions.  Rows and virtual nodes are range-partitioned along
the ring; a row's rank is what lies in the slices before and its number within its own.
Rows at one position, as of a much repeated key, are ordered by a hash of their place in
the input, so slices part them too.  The decisions are taken on counts per arc between
virtual nodes (shards x virtual nodes rows at any corpus size) and looked up by arc and
rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def ring(spark, shards: int, virtual_nodes: int) -> DataFrame:
    """(pos, owner): the virtual nodes.  A shard's places don't depend on how many there are."""
    rows = spark.range(shards * virtual_nodes).select((F.col("id") % shards).cast("int").alias("owner"), F.floor(F.col("id") / shards).cast("long").alias("copy"))
    return rows.select(F.xxhash64(F.lit("virtual node"), "owner", "copy").alias("pos"), "owner")


def shard_by_ring(rows: DataFrame, key: Column, shards: int, virtual_nodes: int = 128, load_factor: float = 1.0, slices: int | None = None) -> DataFrame:
    """Add ``shard`` int, ``slot`` long (gapless from 0 in each shard), ``home_shard`` int.

    ``load_factor`` above 1 bounds each shard's rows by ceil(factor x rows / shards), which
    moves fewer rows.  Keys with one hash, null among them, stand at one place in any
    order.  ``slices`` (by default the session's shuffle partitions) says into how many
    parts the ring is cut; a task ranks about rows / slices.  ``rows`` is stored first.
    """
    if shards < 1 or virtual_nodes < 1 or load_factor < 1:
        raise ValueError("at least one shard, one virtual node and a load factor of 1")
    spark = rows.sparkSession
    nodes = ring(spark, shards, virtual_nodes)
    # stored with a number each, so that the sampling and the sorting see the same
    keyed = materialize(rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.xxhash64(key).alias("pos"), F.xxhash64(F.monotonically_increasing_id()).alias("tie")), "ring-rows")
    marked = keyed.select("row", "pos", "tie", F.lit(None).cast("int").alias("owner")).unionByName(nodes.select(F.lit(None).cast(keyed.schema["row"].dataType).alias("row"), "pos", F.lit(0).cast("long").alias("tie"), "owner"))
    order = ["pos", F.col("owner").asc_nulls_first(), "tie"]  # a node comes after the keys at its own position
    cut = marked.repartitionByRange(slices or int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    cut = materialize(cut.withColumn("slice", F.spark_partition_id()), "ring-slices")

    # how many rows and virtual nodes come before each slice; at most `slices` rows
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = cut.groupBy("slice").agg(F.count(F.lit(1)).alias("all"), F.count("owner").alias("nodes"))
    per_slice = per_slice.select("slice", F.coalesce(F.sum(F.col("all") - F.col("nodes")).over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("nodes").over(before), F.lit(0)).alias("nodes_before"))

    along = Window.partitionBy("slice").orderBy(*order)
    running = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = cut.withColumn("nth", F.row_number().over(along)).withColumn("seen", F.count("owner").over(running)).join(F.broadcast(per_slice), "slice")
    ranked = ranked.where("owner IS NULL").select("row", (F.col("nodes_before") + F.col("seen")).alias("arc"), (F.col("rows_before") + F.col("nth") - F.col("seen") - 1).alias("rank"))
    ranked = materialize(ranked, "ring-ranks")  # read for the counts and for the placing
    plan = _plan(nodes, ranked, shards, virtual_nodes, load_factor)
    placed = ranked.join(F.broadcast(plan), (ranked["arc"] == plan["p_arc"]) & (ranked["rank"] >= plan["low"]) & (ranked["rank"] < plan["high"]))
    return placed.select("row.*", "shard", (F.col("slot_low") + F.col("rank") - F.col("low")).alias("slot"), "home_shard")


def _plan(nodes: DataFrame, ranked: DataFrame, shards: int, virtual_nodes: int, load_factor: float) -> DataFrame:
    """(p_arc, low, high, shard, slot_low, home_shard): ranks [low, high) of an arc and where they go."""
    places = shards * virtual_nodes
    arcs = nodes.select((F.row_number().over(Window.orderBy("pos", "owner")) - 1).cast("long").alias("p_arc"), "owner")
    # rows past the last node belong to the first one: arc `places` is its second part
    arcs = arcs.unionByName(arcs.where("p_arc = 0").select(F.lit(places).cast("long").alias("p_arc"), "owner"))
    counts = ranked.groupBy("arc").agg(F.count(F.lit(1)).alias("n"))
    arcs = arcs.join(counts, arcs["p_arc"] == counts["arc"], "left").select("p_arc", "owner", F.coalesce("n", F.lit(0)).alias("n"))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    in_ring = Window.orderBy("p_arc").rowsBetween(Window.unboundedPreceding, -1)
    in_shard = Window.partitionBy("owner").orderBy("p_arc").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(whole)
    bound = F.ceil(total * F.lit(load_factor) / shards) if load_factor > 1 else F.floor(total / shards) + (F.col("owner") < total % shards).cast("long")
    arcs = arcs.withColumn("bound", bound.cast("long")).withColumn("low", F.coalesce(F.sum("n").over(in_ring), F.lit(0))).withColumn("own_before", F.coalesce(F.sum("n").over(in_shard), F.lit(0)))
    arcs = arcs.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("n"), F.col("bound") - F.col("own_before"))))
    home = arcs.where("taken > 0").select("p_arc", "low", (F.col("low") + F.col("taken")).alias("high"), F.col("owner").alias("shard"), F.col("own_before").alias("slot_low"), F.col("owner").alias("home_shard"))

    # the overflow of each arc walks clockwise over the shards; one row holds the whole ring
    per_shard = arcs.groupBy("owner").agg(F.min("bound").alias("bound"), F.sum("taken").alias("used"))
    loads = per_shard.agg(F.array_sort(F.collect_list(F.struct("owner", "bound", "used"))).alias("loads"))
    around = arcs.where(F.col("p_arc") < places).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_arc", "owner"))), lambda x: x["owner"]).alias("around"))
    over = arcs.where("n > taken").agg(F.array_sort(F.collect_list(F.struct("p_arc", "owner", (F.col("low") + F.col("taken")).alias("low"), (F.col("n") - F.col("taken")).alias("rest")))).alias("over"))
    state = over.crossJoin(F.broadcast(around)).crossJoin(F.broadcast(loads))
    state = state.select(
        F.transform("over", lambda o: F.struct(o["p_arc"].alias("p_arc"), o["owner"].alias("owner"), o["low"].alias("low"), o["rest"].alias("rest"), F.array_distinct(F.slice(F.concat("around", "around"), (o["p_arc"] % places + 1).cast("int"), places)).alias("walk"))).alias("over"),
        F.transform("loads", lambda x: x["bound"] - x["used"]).alias("room"),
        F.transform("loads", lambda x: x["used"]).alias("used"),
    )
    kind = "array<struct<p_arc: bigint, low: bigint, high: bigint, shard: int, slot_low: bigint, home_shard: int>>"

    def step(acc: Column, arc: Column) -> Column:
        def visit(s: Column, t: Column) -> Column:
            take = F.least(s["rest"], F.get(s["room"], t))
            new = F.struct(arc["p_arc"].alias("p_arc"), s["low"].alias("low"), (s["low"] + take).alias("high"), t.alias("shard"), F.get(s["used"], t).alias("slot_low"), arc["owner"].alias("home_shard"))
            moved = F.struct(
                (s["rest"] - take).alias("rest"),
                (s["low"] + take).alias("low"),
                F.transform(s["room"], lambda r, i: F.when(i == t, r - take).otherwise(r)).alias("room"),
                F.transform(s["used"], lambda r, i: F.when(i == t, r + take).otherwise(r)).alias("used"),
                F.concat(s["out"], F.array(new)).cast(kind).alias("out"),
            )
            return F.when(take > 0, moved).otherwise(s)

        begin = F.struct(arc["rest"].alias("rest"), arc["low"].alias("low"), acc["room"].alias("room"), acc["used"].alias("used"), acc["out"].alias("out"))
        end = F.aggregate(arc["walk"], begin, visit)
        return F.struct(end["room"].alias("room"), end["used"].alias("used"), end["out"].alias("out"))

    first = F.struct(F.col("room").alias("room"), F.col("used").alias("used"), F.array().cast(kind).alias("out"))
    moved = state.select(F.explode(F.aggregate("over", first, step, lambda acc: acc["out"])).alias("m")).select("m.*")
    return home.unionByName(moved)


def shard_documents(docs: DataFrame, shards: int = 24, virtual_nodes: int = 128, load_factor: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    size: UTF-8 bytes of the text plus 8; null text has none.  The law is ``rows``.  An
    empty table gives an empty result; repeated rows are placed one by one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard_by_ring(slim, F.col("doc_id"), shards, virtual_nodes, load_factor)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write any sharded table as one folder per shard, each in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
