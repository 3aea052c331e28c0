"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs.  An n-gram's vector binds its letters' vectors,
each rotated by its place, by multiplication; a text's vector bundles (sums) those of its
n-grams.  A language's prototype is the bundle of its training texts.  Texts are compared
with the prototypes, taken relative to their mean, by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, worker_state

LETTERS = 2048  # code points below 1024 have a vector of their own, the rest share 1024


@dataclass(frozen=True)
class Space:
    dimensions: int = 512
    n: int = 3
    seed: int = 11

    def letters(self) -> np.ndarray:
        """n x LETTERS x dimensions: the letters' vectors rotated by each place."""
        base = np.random.RandomState(self.seed).choice(np.array([-1, 1], np.int8), (LETTERS, self.dimensions))
        return np.stack([np.roll(base, self.n - 1 - k, axis=1) for k in range(self.n)])


_CODES = np.array([c if chr(c).isalpha() else 0 for c in range(1024)], np.int64)


def letter_codes(text: str) -> np.ndarray:
    """Letters as codes, runs of anything else as one 0 between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    codes = np.zeros(len(points), np.int64)
    low = points < 1024
    codes[low] = _CODES[points[low]]
    if not low.all():
        values, where = np.unique(points[~low], return_inverse=True)
        codes[~low] = np.array([1024 + v % 1024 if chr(v).isalpha() else 0 for v in values.tolist()], np.int64)[where]
    if not codes.any():
        return np.zeros(0, np.int64)
    padded = np.concatenate([[0], codes, [0]])
    return padded[np.concatenate([[True], (padded[1:] != 0) | (padded[:-1] != 0)])]


def grams(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    codes = letter_codes(text)
    if len(codes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = codes[: len(codes) - n + 1].copy()
    for k in range(1, n):
        key = key * LETTERS + codes[k : len(codes) - n + 1 + k]
    return np.unique(key, return_counts=True)


class _Bound:
    """Bound vectors of n-grams, made once and kept up to ``most`` of them."""

    def __init__(self, space: Space, most: int = 40_000):
        self.space, self.most = space, most
        self.letters = space.letters()
        self.place: dict[int, int] = {}
        self.table = np.zeros((2048, space.dimensions), np.float32)

    def make(self, keys: np.ndarray) -> np.ndarray:
        bound = None
        for k in range(self.space.n):
            letter = self.letters[k][keys // LETTERS ** (self.space.n - 1 - k) % LETTERS]
            bound = letter if bound is None else bound * letter
        return bound.astype(np.float32)

    def sum(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        get = self.place.get
        rows = np.array([get(k, -1) for k in keys.tolist()], np.int64)
        new = np.flatnonzero(rows < 0)[: max(0, self.most - len(self.place))]
        if len(new):
            start = len(self.place)
            while start + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[start : start + len(new)] = self.make(keys[new])
            rows[new] = np.arange(start, start + len(new))
            self.place.update(zip(keys[new].tolist(), rows[new].tolist(), strict=True))
        weights, known = counts.astype(np.float32), rows >= 0
        if known.all():
            return weights @ self.table[rows]
        return weights[known] @ self.table[rows[known]] + weights[~known] @ self.make(keys[~known])


def bundle(keys: np.ndarray, counts: np.ndarray, space: Space) -> np.ndarray:
    """Sum of the n-grams' vectors, each as often as it occurs."""
    bound, total = worker_state(space, lambda: _Bound(space)), np.zeros(space.dimensions)
    for at in range(0, len(keys), 4096):
        total += bound.sum(keys[at : at + 4096], counts[at : at + 4096])
    return total


def held_out(doc_id: Column) -> Column:
    """crc32 of the identifier as text, mod 4, is 2; false for null identifiers."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 4 == 2, F.lit(False))


def fit_prototypes(docs: DataFrame, space: Space = Space(), most: int = 200_000) -> dict[str, np.ndarray]:
    """A prototype per language from every row of ``docs`` (text, lang) with a language.

    A task bundles what it has seen of a language, ``most`` n-grams at a time, and emits
    one row per dimension; the sums over tasks are all that reaches the driver: languages
    x dimensions numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[int, int]] = {}
        totals: dict[str, np.ndarray] = {}

        def add(lang: str) -> None:
            table = seen.pop(lang)
            part = bundle(np.fromiter(table.keys(), np.int64, len(table)), np.fromiter(table.values(), np.int64, len(table)), space)
            totals[lang] = totals.get(lang, 0) + part

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, counts = grams(text.as_py(), space.n)
                table = seen.setdefault(lang, {})
                for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
                    table[k] = table.get(k, 0) + c
                if len(table) > most:
                    add(lang)
        for lang in list(seen):
            add(lang)
        for lang, total in totals.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * space.dimensions), "at": pa.array(range(space.dimensions), pa.int32()), "value": pa.array(np.rint(total).astype(np.int64))})

    slim = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    sums = slim.mapInArrow(run, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r["lang"], np.zeros(space.dimensions))[r["at"]] = r["value"]
    return {lang: v for lang, v in sorted(out.items()) if v.any()}


def predict_languages(docs: DataFrame, prototypes: dict[str, np.ndarray], space: Space = Space(), sharpness: float = 12.0) -> DataFrame:
    """(doc_id, lang_pred, score) of every row.

    ``score`` is the softmax of the cosines at ``sharpness``.  Texts that are null or have
    no letter, and all texts without prototypes, get ``und`` and 0.
    """
    names = list(prototypes)
    unit = np.array([v / (np.linalg.norm(v) or 1) for v in prototypes.values()]).reshape(len(names), space.dimensions)
    centre = unit.mean(axis=0) if len(names) > 1 else np.zeros(space.dimensions)
    relative = unit - centre
    relative /= np.linalg.norm(relative, axis=1, keepdims=True) + 1e-12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1):
                keys, counts = grams(text.as_py(), space.n)
                if not len(keys) or not names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                v = bundle(keys, counts, space)
                v = v / (np.linalg.norm(v) + 1e-12) - centre
                cosines = relative @ (v / (np.linalg.norm(v) + 1e-12))
                share = np.exp(sharpness * (cosines - cosines.max()))
                best = int(np.argmax(cosines))
                langs.append(names[best])
                scores.append(float(share[best] / share.sum()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify_languages(docs: DataFrame, space: Space = Space()) -> DataFrame:
    """Fit on the rows that aren't held out and predict all: doc_id, held_out, lang_pred, score."""
    prototypes = fit_prototypes(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"), space)
    found = predict_languages(docs, prototypes, space)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
