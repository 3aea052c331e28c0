"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of letters, digits and underscores in lower case; shingles are five words
(items of fewer words have one shingle, all their words).  For each item a window of as
many words slides over a text; a text of fewer words is one window.  Windows and items get
256-bit SimHash fingerprints.  Items of one size have a multi-index of their own: a
fingerprint is cut into 8 blocks of 32 bits, and of two fingerprints within ``radius`` (63)
bits one block at least differs in no more than 63 // 8 = 7.  So every fingerprint within
the radius is found among those with a block that near, which are under 1 percent of
unrelated items of the size.  For what is found, the exact similarity of the windows' and
items' shingles, weighted by their counts (shared weight over joint weight), decides
against ``similarity``.

At similarity 0.8 two fingerprints differ in 39 of 256 bits with a deviation of 5.7, so
about one pair in 100,000 just at the limit lies beyond the radius; unrelated ones differ
in 128 with a deviation of 8.

A window must share enough shingles with items of a size to reach that similarity at all:
of n shingles and the item's m at least s (n + m) / (1 + s).  Windows that don't are not
fingerprinted; this drops no match.  Words that no item has are hashed themselves in what
is fingerprinted, so each shingle has its own bits.  Items travel to the executors in
blocks of bounded size, one pass over the texts for each block, however large the
benchmark is; a worker's index is arrays of about 45 bytes a word and its vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_whole_rows, text_position, worker_state
from .simhash import _widen, fingerprint

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    lanes: int = 4  # words of 64 bits in a fingerprint
    radius: int = 63
    blocks: int = 8
    block_chars: int = 8_000_000  # of benchmark text sent to executors at once


class BlockIndex:
    """Fingerprints (items x lanes), found by any block within radius // blocks bits.

    Few items are found by a pass over each block's values.  From ``scan`` items on the
    halves of the blocks, one of which is within half as many bits, have their values in
    order and are asked for all values that near.
    """

    def __init__(self, prints: np.ndarray, settings: Settings, scan: int = 12_000):
        self.prints, self.radius = prints, settings.radius
        self.width = 64 * settings.lanes // settings.blocks
        if self.width * settings.blocks != 64 * settings.lanes or self.width > 32 or 64 % self.width or self.width % 2:
            raise ValueError("blocks of an even number of bits, 32 at most, must divide the lanes")
        self.near_bits = settings.radius // settings.blocks
        self.values = self._cut(prints, self.width)
        self.order = None
        if len(prints) >= scan:
            half = self.width // 2
            self.flips = np.array([sum(1 << b for b in c) for r in range(self.near_bits // 2 + 1) for c in combinations(range(half), r)], np.uint32)
            halves = self._cut(prints, half)
            self.order = np.argsort(halves, axis=0, kind="stable").astype(np.int32)
            self.halves = np.take_along_axis(halves, self.order, axis=0)

    @staticmethod
    def _cut(prints: np.ndarray, width: int) -> np.ndarray:
        """prints x blocks: each block's bits as a number."""
        at = np.arange(0, 64, width, dtype=np.uint64)
        return (prints[:, :, None] >> at & np.uint64((1 << width) - 1)).astype(np.uint32).reshape(len(prints), -1)

    def near(self, value: np.ndarray) -> np.ndarray:
        """Rows with a block that near to ``value``'s, before all bits are compared."""
        found = []
        halves = self._cut(value[None], self.width // 2)[0].reshape(-1, 2)
        for block, own in enumerate(self._cut(value[None], self.width)[0]):
            if self.order is None:
                found.append(np.flatnonzero(np.bitwise_count(self.values[:, block] ^ own) <= self.near_bits))
                continue
            for half in (0, 1):
                at = 2 * block + half
                wanted = self.flips ^ halves[block, half]
                low, high = np.searchsorted(self.halves[:, at], wanted), np.searchsorted(self.halves[:, at], wanted, side="right")
                rows = [self.order[a:b, at] for a, b in zip(low[low < high].tolist(), high[low < high].tolist(), strict=True)]
                if rows:
                    rows = np.concatenate(rows)
                    found.append(rows[np.bitwise_count(self.values[rows, block] ^ own) <= self.near_bits])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)

    def within(self, value: np.ndarray) -> np.ndarray:
        """Rows whose fingerprint is within the radius of ``value``."""
        rows = self.near(value)
        return rows[np.bitwise_count(self.prints[rows] ^ value).sum(axis=1) <= self.radius]


class ItemIndex:
    """Fingerprints and shingles of one block of items, as arrays."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings = Settings()):
        self.s = settings
        self.vocabulary: dict[str, int] = {}
        self.item_ids: list[int] = []
        sizes, counts, hashes, prints = [], [], [], []
        grams: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in WORD.findall(text.lower())], np.int64)
            if not len(ids):
                continue  # an item without words matches nothing
            k = min(settings.words, len(ids))
            own = self._hashes(ids, k)
            prints.append(fingerprint(_widen(own, 1), settings.lanes))
            values, times = np.unique(own, return_counts=True)
            grams.setdefault(k, []).append((len(ids), values))
            self.item_ids.append(item_id)
            sizes.append(len(ids))
            hashes.append(values)
            counts.append(times.astype(np.int32))
        self.shingles, self.counts, sizes = hashes, counts, np.array(sizes, np.int64)
        #: by item size: which items, and the multi-index of their fingerprints
        self.of_size = {int(n): (which := np.flatnonzero(sizes == n), BlockIndex(np.array([prints[i] for i in which]), settings)) for n in np.unique(sizes)}
        #: by shingle length: sorted shingles, and where each one's item sizes stand
        self.grams = {k: self._sizes_of(rows) for k, rows in grams.items()}

    @staticmethod
    def _sizes_of(rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values = np.concatenate([v for _, v in rows])
        sizes = np.repeat(np.array([n for n, _ in rows], np.int32), [len(v) for _, v in rows])
        order = np.lexsort((sizes, values))
        values, sizes = values[order], sizes[order]
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (sizes[1:] != sizes[:-1])])
        values, sizes = values[new], sizes[new]
        known, first = np.unique(values, return_index=True)
        return known, np.append(first, len(values)), sizes

    @staticmethod
    def _hashes(ids: np.ndarray, k: int) -> np.ndarray:
        """One 64-bit value per k words; 0 only where a word is unknown (id 0)."""
        n = len(ids) - k + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        known = ids > 0
        whole = known[:n].copy()
        for j in range(1, k):
            whole &= known[j : j + n]
        at = np.flatnonzero(whole)  # few windows have only words that some item has
        value = np.zeros(len(at), np.uint64)
        for j in range(k):
            value = _widen(value * np.uint64(31) + ids[at + j].astype(np.uint64), 2)
        out = np.zeros(n, np.uint64)
        out[at] = value
        return out

    @staticmethod
    def _own_ids(words: list[str], ids: np.ndarray) -> np.ndarray:
        """``ids`` with a hash of the word itself where it is unknown (64th bit set)."""
        out = ids.astype(np.uint64)
        for at in np.flatnonzero(ids == 0).tolist():
            out[at] = xxhash.xxh64_intdigest(words[at].encode("utf-8", "surrogatepass")) | 1 << 63
        return out

    def matches(self, text: str) -> dict[int, float]:
        """The best similarity of each item that some window of ``text`` matches."""
        get = self.vocabulary.get
        words = WORD.findall(text.lower())
        ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        best: dict[int, float] = {}
        share = self.s.similarity / (1 + self.s.similarity)
        for k, (known, first, sizes) in self.grams.items():
            hashes = self._hashes(ids, k)
            some = np.flatnonzero(hashes)
            at = np.minimum(np.searchsorted(known, hashes[some]), len(known) - 1)
            found = known[at] == hashes[some]
            places, at = some[found], at[found]
            if not len(places):
                continue
            # a row per place and size of the items that have its shingle, by size
            many = first[at + 1] - first[at]
            rows = np.repeat(first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            size_of, place_of = sizes[rows], np.repeat(places, many)
            order = np.argsort(size_of, kind="stable")
            size_of, place_of = size_of[order], place_of[order]
            cuts = [0, *(np.flatnonzero(size_of[1:] != size_of[:-1]) + 1).tolist(), len(size_of)]
            whole = None  # with the unknown words' own hashes, once a window needs them
            for a, b in zip(cuts, cuts[1:], strict=False):
                size = int(size_of[a])
                m = size - k + 1
                n = min(m, len(hashes))  # a text shorter than the item is one window
                least = share * (n + m) - 1e-9
                if b - a >= least:
                    seen = np.zeros(len(hashes) + 1, np.int64)
                    seen[place_of[a:b] + 1] = 1
                    seen = np.cumsum(seen)
                    starts = np.flatnonzero(seen[n:] - seen[:-n] >= least)
                    if len(starts):
                        whole = self._hashes(self._own_ids(words, ids), k) if whole is None else whole
                        self._verify(whole, size, n, m, starts, best)
        return best

    def _verify(self, hashes: np.ndarray, size: int, n: int, m: int, starts: np.ndarray, best: dict[int, float]) -> None:
        """Fingerprint the windows of ``n`` shingles at ``starts``, look their items up and compare exactly."""
        which, index = self.of_size[size]
        for start in starts.tolist():
            window = hashes[start : start + n]
            candidates = index.within(fingerprint(_widen(window, 1), self.s.lanes))
            if not len(candidates):
                continue
            values, times = np.unique(window, return_counts=True)
            for i in which[candidates].tolist():
                _, mine, own = np.intersect1d(values, self.shingles[i], assume_unique=True, return_indices=True)
                shared = int(np.minimum(times[mine], self.counts[i][own]).sum())
                value = shared / (n + m - shared)
                item_id = self.item_ids[i]
                if value >= self.s.similarity and value > best.get(item_id, 0):
                    best[item_id] = value


def _item_blocks(benchmark: DataFrame, settings: Settings) -> Iterator[list[tuple[int, str]]]:
    slim = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = slim.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // settings.block_chars))
    for b in range(blocks):
        part = slim if blocks == 1 else slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def _index(shared, settings: Settings) -> ItemIndex:
    """The worker's index of a broadcast block, made once."""
    return worker_state(("items", shared.id, settings), lambda: ItemIndex(shared.items, settings))


@dataclass(frozen=True)
class _Block:
    id: str
    items: list[tuple[int, str]]


def _shared(spark, items: list[tuple[int, str]]):
    import uuid

    return spark.sparkContext.broadcast(_Block(uuid.uuid4().hex, items))


def contaminations(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, similarity) of each row of ``docs`` and each item that it holds.

    Null texts match nothing; repeated rows give repeated results; items with equal text
    each match.  Identifiers may be null.  An empty table on either side gives no rows.
    """
    found = None
    for items in _item_blocks(benchmark, settings):
        block = _shared(docs.sparkSession, items)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = _index(block.value, settings)
            for batch in batches:
                rows = [(d, i, s) for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for i, s in index.matches(text.as_py()).items()]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "item_id": pa.array([r[1] for r in rows], pa.int64()), "similarity": pa.array([r[2] for r in rows], pa.float64())})

        part = id_and_text(docs).mapInArrow(run, "doc_id long, item_id long, similarity double")
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose ``text`` matches no item, with all their columns.

    Null and empty texts stay, as do all rows where the benchmark is empty; rows alike
    stay or go together.  Columns may have any name; identifiers aren't read.
    """
    at = text_position(docs)
    for items in _item_blocks(benchmark, settings):
        block = _shared(docs.sparkSession, items)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = _index(block.value, settings)
            for batch in batches:
                keep = [not index.matches(text.as_py() or "") for text in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = map_whole_rows(docs, run)
    return docs
