"""Toxicity scores from a bidirectional gated recurrent network, trained in numpy.

A word's input vector is its learned embedding, the mean and the maximum of the learned
embeddings of its character n-grams (with word borders), and its length.  One number of
each embedding starts from how far the word or n-gram leans to toxic training texts (a
clipped z-score of document counts), the others at random; all are trained with the
network.  Two gated recurrent networks read a window of words from both ends; attention
pools their states; a logistic unit gives the window's probability.  A text's score is the
highest over all overlapping windows of the whole text.  Training follows the highest
windows of each training text, found anew every few epochs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, id_and_text, map_whole_rows, text_position, worker_state
from .langid import held_out

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """``most_rows`` and ``most_chars`` bound the training sample: so many labelled rows,
    in hash order, none with a longer text."""

    most_rows: int = 3000
    most_chars: int = 12_000
    window: int = 32
    stride: int = 16
    hidden: int = 8
    word_size: int = 6
    gram_size: int = 4
    most_words: int = 30_000
    most_grams: int = 40_000
    steps: int = 600
    searches: tuple[float, ...] = (0.0, 0.1, 0.25, 0.5, 0.75)  # shares of the steps at which the highest windows are found
    batch: int = 64
    rate: float = 0.01
    embedding_rate: float = 0.003
    toxic_weight: float = 1.0
    seed: int = 5
    threshold: float = 0.3
    kept_words: int = 150_000  # input vectors kept by a Python worker


def char_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 3-, 4- and 5-grams of the words with borders, and each one's word, in order of words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # points from here to the word's end
    value, hashes, owners = points.copy(), [], []
    for n in range(2, 6):
        reach = max(0, len(points) - n + 1)
        value[:reach] = value[:reach] * np.uint64(0x9E3779B97F4A7C15) + points[len(points) - reach :]
        if n >= 3:
            at = np.flatnonzero(room >= n)
            hashes.append(value[at] ^ (value[at] >> np.uint64(29)) ^ np.uint64(n))
            owners.append(word[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(hashes)[order], owner[order].astype(np.int32)


def _leaning(all_: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Clipped z-scores of how much more often than by chance a feature is in toxic texts; 0 below 1.5."""
    z = (toxic - all_ * share) / np.sqrt(all_ * share * (1 - share) + 1)
    return np.where(np.abs(z) >= 1.5, np.tanh(z / 4), 0.0)


def _features(texts: list[list[str]], labels: np.ndarray, least: int, most_words: int, most_grams: int) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """Leanings of the words, and hashes and leanings of the n-grams, that are in ``least`` texts or more."""
    share = float(labels.mean())
    words = list(dict.fromkeys(w for t in texts for w in t))
    number = {w: i for i, w in enumerate(words)}
    hashes, owners = char_grams(words)
    known, where = np.unique(hashes, return_inverse=True)
    ends, where = np.searchsorted(owners, np.arange(len(words) + 1)), where.astype(np.int32)
    del hashes, owners
    seen = {k: np.zeros((2, n), np.int64) for k, n in (("words", len(words)), ("grams", len(known)))}
    for t, label in zip(texts, labels.tolist(), strict=True):
        own = np.fromiter({number[w] for w in t}, np.int64)
        size = ends[own + 1] - ends[own]
        inside = np.unique(where[np.repeat(ends[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())])
        for k, at in (("words", own), ("grams", inside)):
            seen[k][0, at] += 1
            seen[k][1, at] += int(label)
    picked = {}
    for k, most in (("words", most_words), ("grams", most_grams)):
        lean = _leaning(seen[k][0], seen[k][1], share)
        # the strongest first, then the most frequent; then as they come
        order = np.lexsort((-seen[k][0], -np.abs(lean)))
        at = order[seen[k][0][order] >= least][:most]
        picked[k] = (at, lean[at])
    at, lean = picked["grams"]
    order = np.argsort(known[at])
    return {words[i]: float(v) for i, v in zip(*picked["words"], strict=True)}, known[at][order], lean[order]


class Embedding:
    """Rows of learned numbers; row 0 stands for all features that have none and stays zero."""

    def __init__(self, leanings: np.ndarray, size: int, random: np.random.RandomState):
        self.table = random.normal(0, 0.1, (len(leanings) + 1, size)).astype(np.float32)
        self.table[1:, 0] = leanings
        self.table[0] = 0
        self.squares = np.zeros((len(self.table), 1), np.float32)

    def step(self, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
        """Adagrad on the rows that occur, one rate per row."""
        own, where = np.unique(rows, return_inverse=True)
        total = np.zeros((len(own), grads.shape[1]), np.float32)
        np.add.at(total, where, grads)
        total[own == 0] = 0
        self.squares[own] += (total * total).mean(axis=1, keepdims=True)
        self.table[own] -= rate * total / (np.sqrt(self.squares[own]) + 1e-6)


@dataclass
class Inputs:
    """Words to vectors."""

    word_row: dict[str, int]
    gram_keys: np.ndarray  # ascending; row i + 1 of the table is the i-th one's
    words: Embedding
    grams: Embedding
    most: int = 150_000
    kept: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    @property
    def size(self) -> int:
        return self.words.table.shape[1] + 2 * self.grams.table.shape[1] + 1

    def parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the words, rows of their n-grams one after another, where each word's begin, lengths."""
        hashes, owner = char_grams(words)
        if len(self.gram_keys):
            at = np.minimum(np.searchsorted(self.gram_keys, hashes), len(self.gram_keys) - 1)
            found = self.gram_keys[at] == hashes
        else:
            at, found = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        rows, owner = at[found] + 1, owner[found]
        bare = np.flatnonzero(np.bincount(owner, minlength=len(words)) == 0)  # such words have row 0
        owner = np.concatenate([owner, bare])
        order = np.argsort(owner, kind="stable")
        flat = np.concatenate([rows, np.zeros(len(bare), np.int64)])[order]
        own = np.fromiter(map(self.word_row.get, words, repeat(0)), np.int64, len(words))
        lengths = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), 20).astype(np.float32) / 20
        return own, flat, np.searchsorted(owner[order], np.arange(len(words))), lengths

    def vectors(self, own: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(own):
            return np.zeros((0, self.size), np.float32)
        g = self.grams.table[flat]
        many = np.diff(np.append(starts, len(flat)))[:, None]
        return np.concatenate([self.words.table[own], np.add.reduceat(g, starts) / many, np.maximum.reduceat(g, starts), lengths[:, None]], axis=1).astype(np.float32)

    def learn(self, own: np.ndarray, flat: np.ndarray, starts: np.ndarray, grads: np.ndarray, rate: float) -> None:
        """Send the gradients of words' vectors on to the embeddings."""
        k, n = self.words.table.shape[1], self.grams.table.shape[1]
        many = np.diff(np.append(starts, len(flat)))
        g = self.grams.table[flat]
        top = g == np.repeat(np.maximum.reduceat(g, starts), many, axis=0)
        mean = np.repeat(grads[:, k : k + n] / many[:, None], many, axis=0)
        ties = np.repeat(np.add.reduceat(top.astype(np.float32), starts), many, axis=0)
        self.grams.step(flat, mean + top * np.repeat(grads[:, k + n : k + 2 * n], many, axis=0) / ties, rate)
        self.words.step(own, grads[:, :k], rate)

    def positions(self, texts: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Each word's row in the returned table; row 0 is padding."""
        if self.rows is None:
            self.rows = np.zeros((1024, self.size), np.float32)
        if len(self.kept) > self.most:
            self.kept = {}
        new = sorted(set().union(*texts) - self.kept.keys())
        need = len(self.kept) + len(new) + 1
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(need, 2 * len(self.rows)) - len(self.rows), self.size), np.float32)])
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            first = len(self.kept) + 1
            self.rows[first : first + len(some)] = self.vectors(*self.parts(some))
            self.kept.update(zip(some, range(first, first + len(some)), strict=True))
        get = self.kept.__getitem__
        return [np.fromiter(map(get, t), np.int64, len(t)) for t in texts], self.rows


def windows_of(rows: np.ndarray, window: int, stride: int) -> np.ndarray:
    """All windows over a text's words, padded with 0; a text has at least one."""
    count = max(1, -(-(len(rows) - window) // stride) + 1)
    padded = np.zeros((count - 1) * stride + window, np.int64)
    padded[: len(rows)] = rows
    return padded[np.arange(count)[:, None] * stride + np.arange(window)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """The two recurrent networks, the attention and the output unit."""

    def __init__(self, inputs: int, hidden: int, seed: int):
        r = np.random.RandomState(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = r.normal(0, 0.5 / np.sqrt(inputs), (inputs, 3 * hidden)).astype(np.float32)
            self.p[f"U{d}"] = r.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
            self.p[f"b{d}"] = np.zeros(3 * hidden, np.float32)
        self.p["A"] = r.normal(0, 0.5, (2 * hidden, hidden)).astype(np.float32)
        self.p["a"] = r.normal(0, 0.5, hidden).astype(np.float32)
        self.p["o"] = r.normal(0, 0.5, 2 * hidden).astype(np.float32)
        self.p["c"] = np.full(1, -1.0, np.float32)

    def _read(self, x: np.ndarray, mask: np.ndarray, d: str, trace: list | None) -> np.ndarray:
        n, t, _ = x.shape
        h, out = np.zeros((n, self.h), np.float32), np.zeros((n, t, self.h), np.float32)
        u, k = self.p[f"U{d}"], self.h
        xw = x.reshape(-1, x.shape[2]) @ self.p[f"W{d}"] + self.p[f"b{d}"]
        xw = xw.reshape(n, t, 3 * k)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            g = _sigmoid(xw[:, i, : 2 * k] + h @ u[:, : 2 * k])
            z, r = g[:, :k], g[:, k:]
            cand = np.tanh(xw[:, i, 2 * k :] + (r * h) @ u[:, 2 * k :])
            m = mask[:, i : i + 1]
            new = h + m * z * (cand - h)
            if trace is not None:
                trace.append((i, h, z, r, cand, m))
            h = new
            out[:, i] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logits of windows: x is windows x words x inputs, mask 1 where a word stands."""
        steps = {d: ([] if trace is not None else None) for d in "fb"}
        both = np.concatenate([self._read(x, mask, d, steps[d]) for d in "fb"], axis=2)
        s = np.tanh(both @ self.p["A"])
        e = np.where(mask > 0, s @ self.p["a"], -1e9)
        w = np.exp(e - e.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        pooled = (w[:, None, :] @ both)[:, 0]
        if trace is not None:
            trace.update(steps=steps, both=both, s=s, w=w, pooled=pooled, x=x)
        return pooled @ self.p["o"] + self.p["c"][0]

    def gradients(self, trace: dict, dlogit: np.ndarray) -> dict[str, np.ndarray]:
        """Of the parameters; those of the inputs are put into ``trace["dx"]``."""
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        both, s, w, pooled, x, k = trace["both"], trace["s"], trace["w"], trace["pooled"], trace["x"], self.h
        g["o"], g["c"] = dlogit @ pooled, np.array([dlogit.sum()], np.float32)
        dpool = dlogit[:, None] * self.p["o"]
        dboth = w[:, :, None] * dpool[:, None, :]
        dw = (both @ dpool[:, :, None])[:, :, 0]
        de = w * (dw - (w * dw).sum(axis=1, keepdims=True))
        g["a"] = np.einsum("nt,ntk->k", de, s)
        ds = de[:, :, None] * self.p["a"] * (1 - s * s)
        g["A"] = np.einsum("nti,ntk->ik", both, ds)
        dboth = dboth + ds @ self.p["A"].T
        trace["dx"] = dx = np.zeros_like(x)
        for d, part in (("f", dboth[:, :, :k]), ("b", dboth[:, :, k:])):
            u, into = self.p[f"U{d}"], self.p[f"W{d}"].T
            dh = np.zeros((len(x), k), np.float32)
            for i, h, z, r, cand, m in reversed(trace["steps"][d]):
                dh = dh + part[:, i]
                dcand = dh * m * z * (1 - cand * cand)
                dz = dh * m * (cand - h) * z * (1 - z)
                drh = dcand @ u[:, 2 * k :].T
                dr = drh * h * r * (1 - r)
                gates = np.concatenate([dz, dr], axis=1)
                g[f"U{d}"][:, : 2 * k] += h.T @ gates
                g[f"U{d}"][:, 2 * k :] += (r * h).T @ dcand
                whole = np.concatenate([gates, dcand], axis=1)
                g[f"W{d}"] += x[:, i].T @ whole
                g[f"b{d}"] += whole.sum(axis=0)
                dx[:, i] += whole @ into
                dh = dh * (1 - m * z) + drh * r + gates @ u[:, : 2 * k].T
        return g


@dataclass
class Model:
    inputs: Inputs
    network: Network
    settings: Settings

    def scores(self, texts: list[str]) -> np.ndarray:
        """The score of each whole text; a text without words has one empty window."""
        s = self.settings
        best = np.full(len(texts), -np.inf, np.float32)
        start = 0
        while start < len(texts):  # a group of texts at a time bounds memory; a long text is one group
            held, stop = 0, start
            while stop < len(texts) and held < 1_000_000:
                held += len(texts[stop])
                stop += 1
            rows, table = self.inputs.positions([WORD.findall(t.lower()) for t in texts[start:stop]])
            wins = [windows_of(r, s.window, s.stride) for r in rows]
            owner = np.repeat(np.arange(start, stop), [len(w) for w in wins])
            grid = np.concatenate(wins)
            for at in range(0, len(grid), 2048):
                part = grid[at : at + 2048]
                np.maximum.at(best, owner[at : at + 2048], self.network.forward(table[part], _mask(part)))
            start = stop
        return _sigmoid(best.astype(np.float64))


def _highest(network: Network, table: np.ndarray, grid: np.ndarray, owner: np.ndarray, first: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The windows in order of text and falling score (or ``first``), and each one's place within its text."""
    scores = first
    if scores is None:
        scores = np.concatenate([network.forward(table[part], _mask(part)) for part in (grid[at : at + 4096] for at in range(0, len(grid), 4096))])
    order = np.lexsort((-scores, owner))
    begins = np.flatnonzero(np.concatenate([[True], owner[order][1:] != owner[order][:-1]]))
    return order, np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))


def _mask(grid: np.ndarray) -> np.ndarray:
    mask = (grid > 0).astype(np.float32)
    mask[:, 0] = 1
    return mask


def train(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Model | None:
    """Fit on the given rows; None unless both labels occur.

    A toxic text trains its highest window; another one its two highest and one more, as
    all its windows aren't toxic.  The first search takes the words' leanings.
    """
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    split = [WORD.findall(t.lower()) for t in texts]
    pick = np.random.RandomState(settings.seed)
    words, gram_keys, gram_leanings = _features(split, y, 3, settings.most_words, settings.most_grams)
    word_table = Embedding(np.array(list(words.values())), settings.word_size, pick)
    inputs = Inputs({w: i + 1 for i, w in enumerate(words)}, gram_keys, word_table, Embedding(gram_leanings, settings.gram_size, pick), settings.kept_words)
    network = Network(inputs.size, settings.hidden, settings.seed)
    known = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in split for w in t))}
    own, flat, starts, lengths = inputs.parts(["", *known])
    many = np.diff(np.append(starts, len(flat)))
    wins = [windows_of(np.array([known[w] for w in t], np.int64), settings.window, settings.stride).astype(np.int32) for t in split]
    grid, owner = np.concatenate(wins), np.repeat(np.arange(len(y)), [len(w) for w in wins])
    del wins, known, split

    def vectors(words: np.ndarray) -> tuple[np.ndarray, ...]:
        size = many[words]
        begin = np.cumsum(size) - size
        return own[words], flat[np.repeat(starts[words] - begin, size) + np.arange(size.sum())], begin, lengths[words]

    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items()}
    step, k, searches = 0, settings.word_size, [round(s * settings.steps) for s in settings.searches]
    while step < settings.steps:
        if searches and step >= searches[0]:
            table = inputs.vectors(own, flat, starts, lengths)
            table[0] = 0
            lean = table[:, 0] + table[:, k] + table[:, k + settings.gram_size] if step == 0 else None
            searches = [s for s in searches if s > step]
            order, place = _highest(network, table, grid, owner, None if lean is None else np.sort(lean[grid], axis=1)[:, -3:].sum(axis=1))
            top = order[place == 0]
            toxic = top[y[owner[top]] == 1]
            clean = order[(place < 2) & (y[owner[order]] == 0)]
            spare = np.flatnonzero(y[owner] == 0)
        used = np.concatenate([toxic, clean, pick.choice(spare, min(len(spare), len(clean) // 4), replace=False)])
        used = used[pick.permutation(len(used))]
        for at in range(0, len(used), settings.batch):
            some = used[at : at + settings.batch]
            words, where = np.unique(grid[some], return_inverse=True)
            where = where.reshape(len(some), -1)
            parts = vectors(words)
            x = inputs.vectors(*parts)
            x[words == 0] = 0
            trace: dict = {}
            logit = network.forward(x[where], _mask(grid[some]), trace)
            label = y[owner[some]]
            dlogit = ((_sigmoid(logit) - label) * np.where(label == 1, settings.toxic_weight, 1) / len(some)).astype(np.float32)
            step += 1
            slower = max(0.1, 1 - step / settings.steps)
            for name, g in network.gradients(trace, dlogit).items():
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                network.p[name] -= (settings.rate * slower * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            back = np.zeros_like(x)
            np.add.at(back, where.ravel(), trace["dx"].reshape(-1, x.shape[1]))
            back[words == 0] = 0
            inputs.learn(*parts[:3], back, settings.embedding_rate * slower)
            if step == settings.steps:
                break
    return Model(inputs, network, settings)


def fit_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Fit on a bounded sample of labelled rows that aren't held out.

    The sample's identifiers are drawn from ``labels`` in hash order; only their texts are
    read, one of each identifier (the least in order), so the model is the same each time.
    Rows with a null label or text and longer texts than ``most_chars`` don't count.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    drawn = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.most_rows)
    known_texts = id_and_text(docs).where((F.length("text") <= settings.most_chars) & (F.length("text") > 0)).join(F.broadcast(drawn), "doc_id")
    rows = known_texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    texts, said = [r["text"] for r in rows], [r["toxic"] for r in rows]
    del rows
    model = train(texts, said, settings)
    give_back()
    return model


def _broadcast(docs: DataFrame, model: Model | None):
    import uuid

    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))


def _model(shared) -> Model | None:
    """The worker's own copy, so that its kept words serve every task."""
    name, model = shared.value
    return worker_state(("toxicity", name), lambda: model)


def score_toxicity(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null text is empty.

    Without a model (no labels, or one label only) every score is 0.
    """
    shared = _broadcast(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = _model(shared)
            texts = batch.column(1).to_pylist()
            scores = here.scores(texts) if here and texts else np.zeros(len(texts))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(scores, pa.float64())})

    found = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose ``text`` scores below ``threshold``, with all their columns.

    Rows alike stay or go together; null text is empty; identifiers aren't read.
    """
    at = text_position(docs)
    shared = _broadcast(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = _model(shared)
            texts = [t or "" for t in batch.column(at).to_pylist()]
            scores = here.scores(texts) if here and texts else np.zeros(len(texts))
            yield batch.filter(pa.array(scores < threshold, pa.bool_()))

    return map_whole_rows(docs, run)
