"""Best-fit packing of tokenized documents into training sequences.

Every bin (sequence) has a capacity vector: tokens, pieces (documents) and attention cost
(the sum of squared piece lengths, the cost of attention that stays inside a document).
A piece goes to the bin that fits under every constraint and scores best: by weighted dot
product of demand and residual, or by the smallest norm of what would remain.

Pieces of one length are alike, so the decisions need only how many pieces there are of
each length.  That histogram has at most ``tokens`` rows at any corpus size; the plan made
from it on the driver says for each range of ranks within a length which bins and offsets
it fills.  Bins that best fit leaves with room are emptied and filled again where that
saves some.  Every piece then finds its place by its rank, in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, id_and_text, materialize
from .tokens import KEPT_PIECES, encoder, text_groups


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold.  The defaults leave only tokens binding."""

    tokens: int = 1024
    pieces: int = 1024
    attention: int = 1024 * 1024

    def __post_init__(self):
        if self.tokens < 1 or self.pieces < 1 or self.attention < self.tokens**2:
            raise ValueError("a full-length piece must fit into an empty sequence")


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: Capacity = Capacity(), with_ids: bool = False, kept_pieces: int = KEPT_PIECES) -> DataFrame:
    """One row per piece of each document's ids (the text's ids, then ``end_id``).

    Only documents longer than ``capacity.tokens`` are cut; their first piece takes the
    odd remainder.  Null text is empty, so each document has at least its end id.  Rows
    with null or repeated ``doc_id`` are documents like any other.  ``task`` and ``nth``
    number the pieces of one length within a task.  ``with_ids`` adds the ids.
    """
    most = capacity.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(tokenizer_path, True, kept_pieces), np.asarray([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        seen = [0] * (most + 1)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, texts in text_groups(batch.column(1)):
                rows: list[list] = [[] for _ in range(8)]
                for doc_id, raw in zip(names[a:b], code.encode(texts), strict=True):
                    raw += end
                    n = len(raw) // 4
                    start = 0
                    for piece in range(-(-n // most)):
                        stop = (n - 1) % most + 1 if piece == 0 else start + most
                        part = raw[4 * start : 4 * stop]
                        length = stop - start
                        for column, value in zip(rows, (doc_id, piece, start, length, zlib.crc32(part), task, seen[length], part), strict=True):
                            column.append(value)
                        seen[length] += 1
                        start = stop
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)][: 8 if with_ids else 7]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"][: len(columns)])

    return id_and_text(docs).mapInArrow(run, PIECE_SCHEMA + (", ids binary" if with_ids else ""))


def plan_best_fit(counts: dict[int, int], capacity: Capacity = Capacity(), score: str = "residual", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> list[tuple[int, int, int, int, int]]:
    """Place ``counts[length]`` pieces of each length.

    Rows of the result: (length, first rank, pieces, first bin, offset); the piece with
    rank ``first rank + i`` goes to ``first bin + i``.  ``best_fit_bins`` decides; bins
    that it leaves with room are packed again by ``_refill`` if that takes fewer.
    """
    bins = _improved(best_fit_bins(counts, capacity, score, weights), capacity)
    out: list[tuple[int, int, int, int, int]] = []
    ranks: dict[int, int] = {}
    first = 0
    for held, many in bins:
        offset = 0
        for length, times in held:
            for _ in range(times):
                rank = ranks.get(length, 0)
                out.append((length, rank, many, first, offset))
                ranks[length] = rank + many
                offset += length
        first += many
    return out


#: What a bin holds, as (length, how many) from the longest down, and how many bins are alike.
Bins = list[tuple[tuple[tuple[int, int], ...], int]]


def best_fit_bins(counts: dict[int, int], capacity: Capacity, score: str = "residual", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> Bins:
    """Vector best fit, longest pieces first.

    Bins with the same residuals are handled as one class: the best class that fits is
    found, and as many of its bins as there are pieces left get one piece each.  ``score``
    is "residual" (smallest weighted norm of the residual after placement) or "dot"
    (largest weighted dot product of demand and residual); both use residuals as shares of
    capacity.  An empty bin is opened when no open one fits.
    """
    if score not in ("residual", "dot"):
        raise ValueError(score)
    caps = np.array([capacity.tokens, capacity.pieces, capacity.attention], float)
    weight = np.asarray(weights, float)
    left = np.zeros((0, 3))  # of each class of open bins
    held: list[dict[int, int]] = []
    size: list[int] = []
    full: Bins = []
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        need = np.array([length, 1, length * length], float)
        todo = counts[length]
        while todo:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                after = (left[fits] - need) / caps
                value = (after * after) @ weight if score == "residual" else -((left[fits] / caps) * (need / caps)) @ weight
                k = int(fits[np.argmin(value)])
                take = min(todo, size[k])
                if take < size[k]:  # the rest of the class stays as it was
                    left = np.vstack([left, left[k : k + 1]])
                    held.append(dict(held[k]))
                    size.append(size[k] - take)
                left[k], size[k] = left[k] - need, take
            else:
                # only the bin just opened can take the next of them, until it is full
                each = min(todo, int(min(capacity.tokens // length, capacity.pieces, capacity.attention // (length * length))))
                take = todo // each
                left = np.vstack([left, (caps - each * need)[None]])
                held.append({length: each})
                size.append(take)
                todo -= each * take
                continue
            held[k][length] = held[k].get(length, 0) + 1
            todo -= take
        alive = left[:, 0] >= 1
        if not alive.all():
            full += [(tuple(h.items()), s) for h, s, ok in zip(held, size, alive, strict=True) if not ok]
            left = left[alive]
            held = [h for h, ok in zip(held, alive, strict=True) if ok]
            size = [s for s, ok in zip(size, alive, strict=True) if ok]
    return full + [(tuple(h.items()), s) for h, s in zip(held, size, strict=True)]


def _improved(bins: Bins, capacity: Capacity) -> Bins:
    """``bins``, or fewer: those with room are emptied and packed again by exact filling.

    The emptiest go first; then twice as many each time, up to all that have room.
    """
    tokens = lambda b: sum(n * c for n, c in b[0])
    least = -(-sum(tokens(b) * b[1] for b in bins) // capacity.tokens)
    count = sum(many for _, many in bins)
    loose = sorted((b for b in bins if tokens(b) < capacity.tokens), key=tokens)
    tight = [b for b in bins if tokens(b) == capacity.tokens]
    take = 8
    while count > least and loose:
        free: dict[int, int] = {}
        for held, many in loose[:take]:
            for n, c in held:
                free[n] = free.get(n, 0) + c * many
        again = _refill(free, capacity)
        saved = sum(many for _, many in loose[:take]) - sum(many for _, many in again)
        if saved > 0:
            count -= saved
            loose = again + loose[take:]
        if take >= len(loose):
            break
        take *= 2
    return tight + loose


def _refill(counts: dict[int, int], capacity: Capacity) -> Bins:
    """Bins one kind after another: the longest piece left and what fills it best.

    Which sums the other pieces reach is a set of bits; the largest sum that fits names
    the pieces.  Where they break the other capacities the bin is filled longest first.
    """
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c}
    out: Bins = []
    while left:
        seed = next(iter(left))
        room = capacity.tokens - seed
        inside = (1 << room + 1) - 1
        reach, trail = 1, []
        for n, c in left.items():
            if n > room:
                continue
            for _ in range(min(c - (n == seed), room // n)):
                more = (reach | reach << n) & inside
                if more == reach:
                    break
                trail.append((n, reach))
                reach = more
            if reach >> room & 1:
                break
        at, held = reach.bit_length() - 1, {seed: 1}
        for n, before in reversed(trail):
            if not before >> at & 1:
                held[n] = held.get(n, 0) + 1
                at -= n
        if sum(held.values()) > capacity.pieces or sum(n * n * c for n, c in held.items()) > capacity.attention:
            held = {}
            spare = np.array([capacity.tokens, capacity.pieces, capacity.attention])
            for n, c in left.items():
                fit = int(min(c, *(spare // (n, 1, n * n))))
                if fit > 0:
                    held[n] = fit
                    spare -= np.array([n, 1, n * n]) * fit
        many = min(left[n] // c for n, c in held.items())
        out.append((tuple(sorted(held.items(), reverse=True)), many))
        for n, c in held.items():
            left[n] -= c * many
            if not left[n]:
                del left[n]
    return out


def place_pieces(pieces: DataFrame, capacity: Capacity = Capacity(), score: str = "residual") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of a stored ``tokenized_pieces``.

    ``pieces`` is read twice, so it should be a table.  Shuffles: one of counts by task
    and length, one of the pieces to meet the rank at which their task's begin.  The plan
    is broadcast; it comes from at most ``capacity.tokens`` lengths.
    """
    spark = pieces.sparkSession
    of_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = of_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begins"))
    counts = {r["length"]: r["n"] for r in of_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan_best_fit(counts, capacity, score)
    plan = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length long, low long, many long, bin long, offset long")
    ranked = pieces.join(begins, ["task", "length"]).withColumn("rank", F.col("begins") + F.col("nth")).drop("begins")
    found = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (ranked["rank"] >= plan["low"]) & (ranked["rank"] < plan["low"] + plan["many"])).drop(plan["length"])
    return found.withColumn("sequence_id", F.col("bin") + F.col("rank") - F.col("low")).drop("task", "nth", "rank", "low", "many", "bin")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: Capacity = Capacity(), score: str = "residual", with_ids: bool = False, kept_pieces: int = KEPT_PIECES, batch_rows: int | None = None) -> DataFrame:
    """Pack all documents: one row per piece with its ``sequence_id`` and ``offset``.

    Offsets within a sequence are gapless from 0.  An empty table gives an empty result.
    ``with_ids`` adds each piece's ids as little-endian uint32 bytes.  ``kept_pieces``
    bounds what a worker keeps of the tokenizer's work and ``batch_rows`` how many documents
    it is handed at once, not the result.
    """
    with batches_of(docs.sparkSession, batch_rows):
        pieces = materialize(tokenized_pieces(docs, tokenizer_path, end_id, capacity, with_ids, kept_pieces), "pieces")
    return place_pieces(pieces, capacity, score)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``ids`` and the spans of their documents.

    Needs ``with_ids``.  A sequence holds at most ``Capacity.tokens`` ids, so no group is
    larger than that.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"], p["start"], p["offset"], p["length"])).alias("spans"))
