"""SimHash fingerprints, pigeonhole blocks and near-duplicate groups.

A fingerprint bit is 1 if it is set in over half the 64-bit hashes of a text's shingles.
Fingerprints within ``radius`` bits are linked.  To find all such pairs a fingerprint is
split into ``blocks`` parts: a pair within the radius differs in at most ``radius`` parts,
so it agrees in all parts of some choice of ``blocks - radius``.  Each choice is a table;
fingerprints meet where they agree on a table's parts, and the Hamming distance decides.

Equal fingerprints are one node from the start, however many documents have them.  Inside
a bucket a spanning forest is made instead of all pairs, by a search that takes each node
out of the list when it is reached; it links exactly what the pairs would link.  Buckets
over ``hot`` nodes are split again by the parts of the bits that the table left open, by
the same pigeonhole rule; that fixes about three quarters of 64 bits, so what is left of
a bucket has a bound that doesn't depend on the corpus.

``similar_groups`` links texts by these fingerprints, and beside them by a stated Jaccard
similarity, which no selective pigeonhole of fingerprints reaches: there MinHash bands
find candidates and exact comparison decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed, id_and_text, join_spread, materialize, used_salts, worker_state
from .graph import connected_components

_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_hashes(text: str, words: int, seed: int = 42, distinct: bool = False) -> np.ndarray:
    """XXH64 of each shingle of a text, A-Z lower-cased, words cut at ASCII white space."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.zeros(len(parts), np.int64)
    np.cumsum(sizes[:-1] + 1, out=starts[1:])
    ends = (starts + sizes)[words - 1 :].tolist()
    out = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends, strict=False)], np.uint64)
    return np.unique(out) if distinct else out


def _widen(hashes: np.ndarray, lane: int) -> np.ndarray:
    """64 more bits of each hash, as good as independent of the others."""
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """``lanes`` words of 64 bits; zeros without hashes."""
    out = np.zeros(lanes, np.uint64)
    if not len(hashes):
        return out
    for lane in range(lanes):
        h = hashes if lane == 0 else _widen(hashes, lane)
        total = np.zeros(64, np.int64)
        for at in range(0, len(h), 65_536):
            part = np.ascontiguousarray(h[at : at + 65_536])
            total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits((2 * total > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, fp array<long>) per document.

    Null and empty texts have the fingerprint zero, which links like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(text.as_py(), words), lanes).view(np.int64) for text in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(prints, pa.list_(pa.int64()))})

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp array<long>")


def _part_masks(bits: list[int], parts: int) -> list[int]:
    """``bits`` (positions) in ``parts`` runs of nearly equal length, as masks."""
    cut = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cut, cut[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def pigeonhole_tables(radius: int, blocks: int, bits: list[int] | None = None) -> list[int]:
    """Masks of 64 bits; any two words within ``radius`` agree under one of them at least."""
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    parts = _part_masks(bits if bits is not None else list(range(64)), blocks)
    return [sum(c) for c in combinations(parts, blocks - radius)]


def spanning_forest(nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of positions in ``nodes`` (n x lanes) that link what pairs within ``radius`` link.

    Each step compares one node with those not reached yet, so dense groups cost about one
    pass and no more than n - 1 pairs come out.
    """
    n = len(nodes)
    if n == 2:
        return [(0, 1)] if int(np.bitwise_count(nodes[0] ^ nodes[1]).sum()) <= radius else []
    out: list[tuple[int, int]] = []
    rest = np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(nodes[rest] ^ nodes[at]).sum(axis=1) <= radius
            if near.any():
                reached = rest[near].tolist()
                out += [(at, r) for r in reached]
                queue += reached
                rest = rest[~near]
    return out


def _bucket_edges(buckets: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) of each bucket of (key, node, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, prints = None, [], []

        def close(us: list, vs: list) -> None:
            if len(nodes) > 1:
                names = np.concatenate(nodes) if len(nodes) > 1 else nodes[0]
                for a, b in spanning_forest(np.concatenate(prints), radius):
                    us.append(int(names[a]))
                    vs.append(int(names[b]))

        for batch in batches:
            if not batch.num_rows:
                continue
            us: list[int] = []
            vs: list[int] = []
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(keys), -1)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if key is None or keys[a] != key:
                    close(us, vs)
                    key, nodes, prints = keys[a], [], []
                for i in range(a, b):
                    nodes.append(ids[i : i + 1])
                    prints.append(flat[i : i + 1])
            yield pa.RecordBatch.from_pydict({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})
        us, vs = [], []
        close(us, vs)
        yield pa.RecordBatch.from_pydict({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    sorted_ = buckets.select("key", "node", "fp").repartition("key").sortWithinPartitions("key")
    return sorted_.mapInArrow(run, "u long, v long")


def _crowded(keyed: DataFrame, label: str) -> DataFrame:
    """Rows (key, node, ...) whose key others have too, with the key's count ``met``.

    Counts are combined before the shuffle and a key's rows meet them in many parts, so a
    hot key is no single task.  Most keys are alone and go here.
    """
    salt = hashed("node")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("met"), used_salts(salt).alias("salts")).where("met > 1")
    return join_spread(keyed, materialize(counts, label), "key", salt)


def exact_edges(nodes: DataFrame, radius: int = 3, blocks: int = 6, hot: int = 4_000) -> DataFrame:
    """Edges between nodes (node, fp of one word) within ``radius``, none missed.

    ``blocks`` sets the number of tables and the bits each compares: 6 parts with radius 3
    make 20 tables of 31 to 33 bits, so chance meetings stay rarer than the nodes
    themselves up to about 10^9 nodes; use more parts beyond.
    """
    masks = pigeonhole_tables(radius, blocks)
    word = F.col("fp")[0]
    met = materialize(_crowded(nodes.withColumn("table", F.explode(F.lit(list(range(len(masks)))))).withColumn("key", _pick(masks, word)), "bucket-counts"), "buckets")
    few = _bucket_edges(met.where(F.col("met") <= hot), radius)
    # beyond `hot`: split by parts of the bits that the table left open
    open_parts = [pigeonhole_tables(radius, blocks, [b for b in range(64) if not m >> b & 1]) for m in masks]
    inner = F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in open_parts])
    many = met.where(F.col("met") > hot).withColumn("inner", F.explode(inner[F.col("table")])).withColumn("key", F.xxhash64("key", "inner", word.bitwiseAND(F.col("inner"))))
    return few.unionByName(_bucket_edges(_crowded(many.drop("met"), "inner-counts"), radius))


def _pick(masks: list[int], word: Column) -> Column:
    table = F.array(*[F.lit(_signed(m)) for m in masks])
    return F.xxhash64("table", word.bitwiseAND(table[F.col("table")]))


def multipliers(count: int, seed: int = 7) -> np.ndarray:
    """Odd 32-bit factors, one per MinHash value."""
    return np.random.RandomState(seed).randint(0, 2**32, count, dtype=np.uint32) | np.uint32(1)


def band_keys(hashes: np.ndarray, odd: np.ndarray, rows: int) -> np.ndarray:
    """One signed key per band of ``rows`` MinHash values; none without hashes."""
    import xxhash

    if not len(hashes):
        return np.zeros(0, np.int64)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(odd), 2**32 - 1, np.uint32)
    for at in range(0, len(high), 512):
        np.minimum(least, np.multiply.outer(odd, high[at : at + 512]).min(axis=1), out=least)
    raw, size = least.tobytes(), 4 * rows
    return np.array([xxhash.xxh64_intdigest(raw[at : at + size], at // size) for at in range(0, len(raw), size)], np.uint64).view(np.int64)


def _banded(docs: DataFrame, words: int, bands: int, rows: int, print_words: int = 3) -> DataFrame:
    """(doc_id, text_hash, node, fp, keys): node is a hash of a text's set of shingles, fp its fingerprint."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # as the worker's state, so that what an earlier operator kept goes
        odd = worker_state(("bands", bands, rows), lambda: multipliers(bands * rows))
        for batch in batches:
            nodes, prints, keys = [], [], []
            for text in batch.column(1):
                prints.append(fingerprint(shingle_hashes(text.as_py(), print_words))[0])
                hashes = shingle_hashes(text.as_py(), words, distinct=True)
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                keys.append(band_keys(hashes, odd, rows))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text_hash": batch.column(2), "node": pa.array(np.array(nodes, np.uint64).view(np.int64), pa.int64()), "fp": pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64()))})

    return id_and_text(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, node long, fp long, keys array<long>")


def similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of positions that link what all pairs of Jaccard ``similarity`` or more link.

    ``sets`` holds non-empty arrays of distinct values.  Every comparison is exact; a set
    leaves the list when it is reached, as in ``spanning_forest``.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(known), bool)
    out: list[tuple[int, int]] = []
    rest = np.arange(len(sets))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            mine = flat[starts[at] : starts[at] + sizes[at]]
            mark[mine] = True
            shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)[rest]
            mark[mine] = False
            near = shared * (1 + similarity) >= similarity * (sizes[at] + sizes[rest]) - 1e-9
            if near.any():
                reached = rest[near].tolist()
                out += [(at, r) for r in reached]
                queue += reached
                rest = rest[~near]
    return out


def _candidates(nodes: DataFrame) -> DataFrame:
    """(node, head, weight) of nodes (node, keys) that share keys with others, stored.

    head: the smallest node of a shared key's bucket; weight: how many nodes are in the
    buckets that have this head.
    """
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    salt = hashed("node")
    heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("met"), used_salts(salt).alias("salts")).where("met > 1")
    return materialize(join_spread(keyed, heads, "key", salt).groupBy("node", "head").agg(F.sum("met").alias("weight")), "candidates")


def _jaccard_at_least(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * (1 + similarity) >= similarity * (len(a) + len(b)) - 1e-9


def _shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, held) for nodes (node, chosen): the sorted shingle hashes of one text each, stored."""
    rows = wanted.select("node", F.col("chosen.doc_id").alias("id"), F.col("chosen.text_hash").alias("hash"))
    texts = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    texts = texts.join(rows, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingle_hashes(t.as_py(), words, distinct=True).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "held": pa.array(held, pa.binary())})

    # rows alike in doc_id and text come more than once
    return materialize(texts.mapInArrow(sets, "node long, held binary").groupBy("node").agg(F.first("held").alias("held")), "shingle-sets")


def _verified_edges(docs: DataFrame, met: DataFrame, chosen: DataFrame, words: int, similarity: float, chunk: int) -> DataFrame:
    """Edges (u, v) that link what all pairs of exact similarity inside candidate groups link.

    A group of at most ``chunk`` nodes is one cell.  In a larger one the node that meets
    most others is compared with all first.  What it links needs no comparison among
    itself; only the rest is compared with everything, dealt into parts of about ``chunk``
    nodes so that each part of the rest meets each part once.  So a large group of copies
    costs a pass over it, and no pair that could add a link is left out.
    """
    salt = hashed("node")
    groups = materialize(connected_components(met.where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))), "candidate-groups")
    members = groups.join(met.groupBy("node").agg(F.sum("weight").alias("weight")), "node")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("many"), F.max(F.struct("weight", "node"))["node"].alias("centre"), used_salts(salt).alias("salts"))
    members = materialize(join_spread(members, sizes, "component", salt).select("node", "component", "many", "centre"), "candidate-members")
    sets = _shingle_sets(docs, members.join(chosen, "node"), words)
    sized = sets.join(members, "node")
    small = sized.where(F.col("many") <= chunk).select(F.col("component").alias("cell"), F.lit(True).alias("rest"), "node", "held")

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [_jaccard_at_least(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), similarity) for a, b in zip(batch.column(3), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "component": batch.column(1), "centre": batch.column(2), "linked": pa.array(linked, pa.bool_())})

    large = sized.where(F.col("many") > chunk)
    centres = large.where("node = centre").select(F.col("component").alias("of"), F.col("held").alias("centre_held"))
    centres = members.where(F.col("many") > chunk).groupBy("component").agg(used_salts(salt).alias("salts")).join(centres, F.col("component") == F.col("of")).drop("of")
    compared = join_spread(large, centres, "component", salt).select("node", "component", "centre", "held", "centre_held")
    stars = materialize(compared.mapInArrow(star, "node long, component long, centre long, linked boolean"), "stars")
    star_edges = stars.where("linked AND node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v"))

    parts = stars.groupBy("component").agg(F.ceil(F.count_if(~F.col("linked")) / chunk).alias("rests"), F.ceil(F.count_if("linked") / chunk).alias("others"), used_salts(salt).alias("salts")).where("rests > 0")
    dealt = join_spread(stars.drop("centre"), parts, "component", salt).withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("linked"), F.col("others")).otherwise(F.col("rests"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    with_rest = F.transform(upto("rests"), lambda o: F.xxhash64("component", F.lit("rest"), F.least("part", o), F.greatest("part", o)))
    with_linked = F.transform(upto("others"), lambda o: F.xxhash64("component", F.lit("linked"), "part", o))
    from_linked = F.transform(upto("rests"), lambda o: F.xxhash64("component", F.lit("linked"), o, "part"))
    cells = F.when(F.col("linked"), from_linked).otherwise(F.concat(with_rest, with_linked))
    big = dealt.select("node", (~F.col("linked")).alias("rest"), F.explode(cells).alias("cell")).join(sets, "node").select("cell", "rest", "node", "held")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}

        def close() -> pa.RecordBatch:
            rest = [n for n, (r, _) in held.items() if r]
            linked = [n for n, (r, _) in held.items() if not r]
            pairs = cell_links([held[n][1] for n in rest], [held[n][1] for n in linked], similarity)
            names = rest + linked
            return pa.RecordBatch.from_pydict({"u": pa.array([names[a] for a, _ in pairs], pa.int64()), "v": pa.array([names[b] for _, b in pairs], pa.int64())})

        for batch in batches:
            for c, rest, node, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if c != cell:
                    yield close()
                    cell, held = c, {}
                held[node] = (rest, np.frombuffer(h.as_py(), np.uint64))
        yield close()

    cells_ = small.unionByName(big).repartition("cell").sortWithinPartitions("cell")
    return cells_.mapInArrow(compare, "u long, v long").unionByName(star_edges)


def cell_links(rest: list[np.ndarray], linked: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of positions in ``rest + linked``: the forest of ``rest`` and a link to ``linked`` for each that has one.

    ``linked`` sets belong together already.
    """
    pairs = similar_forest(rest, similarity) if len(rest) > 1 else []
    if rest and linked:
        sizes = np.array([len(s) for s in linked], np.int64)
        flat = np.concatenate(linked)
        starts = np.cumsum(sizes) - sizes
        for i, own in enumerate(rest):
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            shared = np.add.reduceat(own[at] == flat, starts, dtype=np.int64)
            near = np.flatnonzero(shared * (1 + similarity) >= similarity * (len(own) + sizes) - 1e-9)
            if len(near):
                pairs.append((i, len(rest) + int(near[0])))
    return pairs


def near_duplicate_groups(docs: DataFrame, words: int = 3, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row, by 64-bit fingerprints.

    ``component_id`` is the smallest ``doc_id`` reachable over links; null identifiers
    don't count, and a group that has no other gets null.  Repeated rows and equal texts
    fall together.  An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, words), "fingerprints").select("doc_id", F.col("fp")[0].alias("node"))
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first"), used_salts(hashed("doc_id")).alias("salts"))
    nodes = materialize(nodes, "nodes")
    edges = exact_edges(nodes.select("node", F.array("node").alias("fp")), radius, blocks)
    groups = _named_groups(nodes, edges)
    hexed = F.lower(F.lpad(F.hex("node"), 16, "0"))
    return join_spread(rows, groups, "node", hashed("doc_id")).select("doc_id", hexed.alias("fingerprint"), F.col("first").alias("component_id"))


def _named_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, first, salts): first is the smallest document of each node's component."""
    parts = connected_components(edges)
    known = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = known.groupBy("component").agg(F.min("first").alias("first"), used_salts(hashed("node")).alias("salts"))
    named = join_spread(known.select("node", "component", F.col("salts").alias("node_salts")), firsts, "component", hashed("node"))
    return named.select("node", "component", "first", F.col("node_salts").alias("salts"))


def _fingerprint_edges(named: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Edges (u, v) that link the nodes of ``named`` (node, fp) whose fingerprints are within ``radius``.

    A fingerprint stands for its smallest node; nodes of one fingerprint are linked to it.
    """
    salt = hashed("node")
    pairs = materialize(named.select("node", "fp").distinct(), "fingerprint-nodes")
    heads = materialize(pairs.groupBy("fp").agg(F.min("node").alias("head"), used_salts(salt).alias("salts")), "fingerprint-heads")
    same = join_spread(pairs, heads, "fp", salt).where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    return same.unionByName(exact_edges(heads.select(F.col("head").alias("node"), F.array("fp").alias("fp")), radius, blocks))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 50, rows: int = 8, chunk: int = 120, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(doc_id, text_hash, component, first) of texts linked by fingerprint or by ``similarity``.

    The fingerprints are those of ``near_duplicate_groups``, all pairs within ``radius``
    by the same pigeonhole tables.  Texts whose shingle sets are ``similarity`` alike or
    more are linked too, most of which differ in more bits than that.  Two texts of Jaccard similarity J agree in a MinHash value with probability J, wherever
    they differ, and in all ``rows`` of one of ``bands`` bands with 1 - (1 - J^rows)^bands:
    0.9999 at 0.8.  Bands only name candidates; pairs are linked by the exact similarity of
    their sets.  ``first`` is a component's smallest non-null doc_id.
    """
    named = materialize(_banded(docs, words, bands, rows), "bands")
    chosen = F.min(F.struct("doc_id", "text_hash")).alias("chosen")
    nodes = materialize(named.groupBy("node").agg(F.min("doc_id").alias("first"), chosen, F.first("keys").alias("keys"), used_salts(hashed("doc_id", "text_hash")).alias("salts")), "nodes")
    edges = _verified_edges(docs, _candidates(nodes.select("node", "keys")), nodes.select("node", "chosen"), words, similarity, chunk)
    edges = edges.unionByName(_fingerprint_edges(named, radius, blocks))
    groups = _named_groups(nodes.select("node", "first", "salts"), edges)
    return join_spread(named.select("doc_id", "text_hash", "node"), groups, "node", hashed("doc_id", "text_hash")).drop("node")


def keep_one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """One row of every group of near-duplicate texts, with all columns of ``docs``.

    It is the row with the smallest doc_id (null is the largest), then the smallest text
    hash; of rows alike in both, any one.  Empty and null texts are one group.  Columns
    may have any name.  An empty table gives an empty result.

    Rows alike in doc_id and text are reduced before the shuffle, and the texts are
    shuffled once, by doc_id and text hash.
    """
    rows = similar_groups(docs, **settings)
    least = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
    keys = ["none", "id", "hash"]
    chosen = least.select(F.col("k.none").alias("none"), F.coalesce("k.doc_id", F.lit(0)).cast("long").alias("id"), F.col("k.text_hash").alias("hash"))
    own_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(own_id.isNull().alias("none"), F.coalesce(own_id, F.lit(0)).cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    once = whole.groupBy(*keys).agg(F.first("row").alias("row"))
    return once.join(chosen, keys, "left_semi").select("row.*")
