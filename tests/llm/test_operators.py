"""The training-data operators against brute force, exact round trips and edge cases."""

import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.llm import chat, decontaminate, langid, packing, quality, secrets, sharding, simhash, sstable, tokens, toxicity
from folioforge.llm.common import batches_of, give_back_heap
from folioforge.llm.graph import connected_components

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, spans string, row int, rank int"
ODD = [
    (1, None, None, None, "s", 1, 1), (2, "", "en", "a", "s", 1, 1), (3, "one two three four five six", "en", "a", "s", 1, 1), (3, "one two three four five six", "en", "a", "s", 1, 1),
    (None, "no identifier here at all", "en", "b", "s", 1, 1), (4, "x " * 30_000, "de", "b", None, None, None), (5, "tie tie", "fr", "c", "s", 1, 1), (6, "tie tie", "fr", "c", "s", 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, extra columns with clashing names."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module", params=[(BYTE, True, False), (WORD, False, False), (BYTE, True, True), (WORD, False, True)])
def code(request):
    path, keeps_blank, plain_controls = request.param
    return tokens.PieceEncoder(path, keeps_blank, table_size=50, plain_controls=plain_controls)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab'sS .,\n\t 0_é́ßİ한<|endoftext|>\x00\x1c", "<|endoftext|>", "<|startoftext|>", " <|endoftext|>\n"]), max_size=40).map("".join), max_size=4))
def test_pieces_encode_as_the_library_does(code, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE if code.keeps_blank else WORD)
    library.encode_special_tokens = code.added is None
    plain = library.encode_batch(texts, add_special_tokens=False)
    assert code.encode(texts) == [np.asarray(e.ids, "<u4").tobytes() for e in plain]


def test_packing_is_gapless_and_whole(spark, odd):
    rows = packing.pack_documents(odd, BYTE).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 4)
    assert all(n == 1024 for _, _, n in long[1:]) and all(a[1] + a[2] == b[1] for a, b in zip(long, long[1:], strict=False))
    assert sum(r["doc_id"] == 3 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    assert packing.pack_documents(odd.limit(0), BYTE).count() == 0


def test_packing_by_small_batches_is_the_same(spark, odd):
    key, order = "spark.sql.execution.arrow.maxRecordsPerBatch", ["doc_id", "piece", "sequence_id", "offset"]
    before = spark.conf.get(key)
    rows = lambda **how: packing.pack_documents(odd.coalesce(1), BYTE, **how).orderBy(*order).collect()
    assert rows(kept_pieces=3, batch_rows=2) == rows()
    assert spark.conf.get(key) == before


def test_batches_of_bounds_what_a_worker_is_handed(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    with batches_of(spark, 3):
        assert [r["n"] for r in spark.range(0, 8, 1, 1).mapInArrow(sizes, "n long").collect()] == [3, 3, 2]


def test_packed_ids_are_the_documents(spark, small):
    packed = packing.pack_documents(small, BYTE, with_ids=True)
    spans = packing.packed_sequences(packed).collect()
    pieces = defaultdict(dict)
    for r in spans:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        for s in r["spans"]:
            pieces[s["doc_id"]][s["start"]] = ids[s["offset"] : s["offset"] + s["length"]]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    for r in small.collect():
        got = np.concatenate([pieces[r["doc_id"]][k] for k in sorted(pieces[r["doc_id"]])])
        assert got.tolist() == [*library.encode(r["text"], add_special_tokens=False).ids, 2]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=25), st.sampled_from(["residual", "dot"]), st.integers(2, 9))
def test_plan_respects_every_capacity(counts, score, pieces):
    cap = packing.Capacity(64, pieces, 64 * 64)
    rows = packing.plan_best_fit(counts, cap, score)
    bins, seen = defaultdict(list), defaultdict(set)
    for length, low, many, first, offset in rows:
        for i in range(many):
            bins[first + i].append((offset, length))
            assert low + i not in seen[length]
            seen[length].add(low + i)
    assert {k: len(v) for k, v in seen.items()} == counts
    for parts in bins.values():
        assert len(parts) <= pieces and sum(n * n for _, n in parts) <= 64 * 64
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64


def one_by_one(counts, cap, score, weights=(1.0, 0.05, 0.05)):
    """Vector best fit of single pieces, longest first; the sorted contents of the bins."""
    caps, bins = (cap.tokens, cap.pieces, cap.attention), []
    for length in sorted(counts, reverse=True):
        need = (length, 1, length * length)
        for _ in range(counts[length]):
            def value(b):
                rest = [(r - n * (score == "residual")) / c for r, n, c in zip(b[0], need, caps, strict=True)]
                if score == "residual":
                    return sum(w * x * x for w, x in zip(weights, rest, strict=True))
                return -sum(w * x * n / c for w, x, n, c in zip(weights, rest, need, caps, strict=True))

            open_ = [b for b in bins if all(r >= n for r, n in zip(b[0], need, strict=True))]
            if not open_:
                bins.append(([*caps], []))
                open_ = bins[-1:]
            b = min(open_, key=lambda b: round(value(b), 12))
            b[0][:] = [r - n for r, n in zip(b[0], need, strict=True)]
            b[1].append(length)
    return sorted(sorted(b[1]) for b in bins)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 12), max_size=20), st.sampled_from(["residual", "dot"]), st.integers(2, 9))
def test_classes_of_bins_act_as_single_bins_do(counts, score, pieces):
    cap = packing.Capacity(64, pieces, 64 * 64)
    got = packing.best_fit_bins(counts, cap, score)
    plain = one_by_one(counts, cap, score)
    held = sorted(sorted(n for n, c in h for _ in range(c)) for h, many in got for _ in range(many))
    assert len(held) == len(plain) and Counter(n for b in held for n in b) == Counter(counts)
    planned = packing.plan_best_fit(counts, cap, score)
    assert max((f + m for _, _, m, f, _ in planned), default=0) <= len(plain)


def test_packing_is_near_the_lower_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.tokenized_pieces(docs, BYTE, 2).groupBy("length").count().collect()
    counts = {r["length"]: r["count"] for r in pieces}
    least = -(-sum(n * c for n, c in counts.items()) // 1024)
    for score in ("residual", "dot"):
        assert max(f + m for _, _, m, f, _ in packing.plan_best_fit(counts, score=score)) <= least + 1


def _clashing(df):
    """Names that operators use themselves, one with a dot, and the text under another case."""
    extra = ["node", "key", "hash", "id", "none", "row", "rid", "owner", "salts", "_salt", "_key", "_part", "piece", "length", "stratum", "words", "item_id", "pos", "tie", "slice", "shard", "score", "toxic", "quality", "start", "_ff_rid", "_ff_found", "_ff_spans", "c0", "p.q"]
    taken = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit("clash") for c in extra if c not in taken}).withColumnRenamed("text", "TEXT")


LABELS = "doc_id long, quality int, toxic int, text string, lang string"
OPERATORS = {
    "packing": lambda d, lab, b: packing.pack_documents(d, BYTE),
    "simhash": lambda d, lab, b: simhash.near_duplicate_groups(d),
    "decontaminate": lambda d, lab, b: decontaminate.contaminations(d, b),
    "sstable": lambda d, lab, b: sstable.store_and_read_tokens(d, WORD),
    "quality": lambda d, lab, b: quality.judge_quality(d, lab),
    "langid": lambda d, lab, b: langid.identify_languages(d),
    "secrets": lambda d, lab, b: secrets.secret_spans(d),
    "sharding": lambda d, lab, b: sharding.shard_documents(d),
    "toxicity": lambda d, lab, b: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, lab)),
    "drop_toxic": lambda d, lab, b: toxicity.drop_toxic(d, toxicity.fit_toxicity(d, lab)),
    "keep_one_of_each": lambda d, lab, b: simhash.keep_one_of_each(d),
    "drop_contaminated": lambda d, lab, b: decontaminate.drop_contaminated(d, b),
    "redact_live": lambda d, lab, b: secrets.redact_live(d),
}
#: Rows that come out of ODD; packing has two pieces more for each 1024 ids of the long text.
ROWS = {"decontaminate": 2, "keep_one_of_each": 5, "drop_contaminated": 6}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_odd_and_empty_tables(spark, odd, name):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names, empty tables."""
    labels = spark.createDataFrame([(1, 1, 0, "t", "l"), (3, 1, 1, "t", "l"), (3, 0, 0, "t", "l"), (None, None, 1, None, None), (5, None, None, "t", "l")], LABELS)
    bench = spark.createDataFrame([(7, "one two three four five six", 1), (None, None, None), (8, "", 3)], "item_id long, text string, doc_id long")
    clash = _clashing(odd)
    out = OPERATORS[name](clash, labels, bench)
    n = out.count()
    assert n == ROWS.get(name, len(ODD)) if name != "packing" else n > len(ODD)
    if name in ("drop_toxic", "keep_one_of_each", "drop_contaminated", "redact_live"):
        assert out.dtypes == clash.dtypes
    for docs, lab, b in ((clash.limit(0), labels, bench), (clash.limit(0), labels.limit(0), bench.limit(0))):
        empty = OPERATORS[name](docs, lab, b)
        assert empty.count() == 0 and empty.columns == out.columns
    allnull = spark.createDataFrame([(None, None, None, None)] * 3, "doc_id long, text string, lang string, source string")
    assert OPERATORS[name](allnull, labels, bench).count() == {"decontaminate": 0, "keep_one_of_each": 1}.get(name, 3)


def test_chat_of_an_empty_and_a_clashing_table(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", "x"), (1, None, None, None, None), (1, 0, "user", "a", "x"), (None, None, None, None, None)], "conv_id long, turn long, role string, text string, segments string").withColumn("t", F.lit(1))
    got = chat.conversation_digests(chat.format_conversations(turns)).collect()
    assert sorted((r["conv_id"] or 0, r["n_turns"]) for r in got) == [(0, 1), (1, 3)]


def test_token_shards_round_trip(spark, odd):
    rows = sstable.store_and_read_tokens(odd, WORD).collect()
    assert len(rows) == len(ODD)
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert sstable.store_and_read_tokens(odd.limit(0), WORD).count() == 0


def test_shards_hold_the_librarys_ids(spark, small):
    """Identifiers, starts, counts and checksums of every text through the files."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    docs = small.select("doc_id", "text").unionByName(spark.createDataFrame([(-5, "one <|endoftext|> two<|startoftext|>"), (-4, None)], "doc_id long, text string"))
    wanted, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        wanted.append((r["doc_id"], at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, sstable.store_and_read_tokens(docs, WORD).collect())) == wanted


def test_shard_lookup_and_damage():
    sink = io.BytesIO()
    writer = sstable.ShardWriter(sink, block_bytes=64)
    wanted = {d: np.arange(abs(d) % 7 + 1, dtype="<u4") + 70_000 * (d == 3) for d in range(-40, 40)}
    for d in [None, *sorted(wanted)]:
        writer.add(d, b"" if d is None else wanted[d].tobytes())
    writer.add(39, np.array([5], "<u4").tobytes())
    writer.close()
    reader = sstable.ShardReader(io.BytesIO(sink.getvalue()))
    assert len(reader.blocks) > 5
    for d in range(-40, 39):
        assert [x.tolist() for x in reader.get(d)] == [wanted[d].tolist()]
    assert len(reader.get(39)) == 2 and reader.get(4000) == [] and len(reader.get(None)) == 1
    with pytest.raises(ValueError):
        writer.add(0, b"")
    raw = bytearray(sink.getvalue())
    raw[10] ^= 255
    with pytest.raises(ValueError):
        list(sstable.ShardReader(io.BytesIO(bytes(raw))))


def plain_fingerprint(text, words=3):
    import xxhash

    parts = text.encode().lower().split()
    if not parts:
        return 0
    grams = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    total = [sum(xxhash.xxh64_intdigest(g, 42) >> i & 1 for g in grams) for i in range(64)]
    return sum(1 << i for i in range(64) if 2 * total[i] > len(grams))


def brute_components(prints, radius):
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("hot", [4000, 3])
def test_all_near_fingerprints_are_linked(spark, hot):
    pick = np.random.RandomState(1)
    base = pick.randint(0, 2**63, 12).tolist()
    prints = sorted({b ^ sum(1 << int(i) for i in pick.choice(64, pick.randint(0, 7), replace=False)) for b in base for _ in range(12)} | {0, 7, 2**64 - 1})
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "node long").withColumn("fp", F.array("node"))
    found = {r["node"] % (1 << 64): r["component"] for r in connected_components(simhash.exact_edges(nodes, 3, 6, hot=hot)).collect()}
    expected = brute_components(prints, 3)
    groups, wanted = defaultdict(set), defaultdict(set)
    for p, e in zip(prints, expected, strict=True):
        groups[found.get(p, ("alone", p))].add(p)
        wanted[e].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_near_duplicates_match_brute_force(spark, odd, small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()] + [(d, t) for d, t, *_ in ODD]
    docs = small.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicate_groups(docs).collect()), key=str)
    prints = [plain_fingerprint(t or "") for _, t in rows]
    parts = brute_components(prints, 3)
    least = {}
    for (d, _), p in zip(rows, parts, strict=True):
        if d is not None:
            least[p] = min(least.get(p, d), d)
    assert got == sorted(((d, f"{f:016x}", least.get(p)) for (d, _), f, p in zip(rows, prints, parts, strict=True)), key=str)
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == 0


def test_similar_texts_keep_one_row(spark):
    pick = np.random.RandomState(3)
    words = [f"w{i}" for i in range(4000)]
    base = [" ".join(pick.choice(words, 150)) for _ in range(30)]
    near = [t.replace(t.split()[75], "changed", 1) for t in base[:10]]
    rows = [(i, t, "k") for i, t in enumerate(base)] + [(100 + i, t, "k") for i, t in enumerate(near)] + [(200, base[0], "k"), (200, base[0], "k"), (300, None, "k"), (None, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumns({"_ff_hash": F.lit("q"), "id": F.lit("i"), "none": F.lit(None).cast("string"), "a.b": F.lit(1)})
    got = simhash.keep_one_of_each(docs)
    assert got.dtypes == docs.dtypes
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted([*range(30), 300], key=str)
    assert {(r["_ff_hash"], r["id"], r["none"]) for r in got.collect()} == {("q", "i", None)}
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


def test_kept_texts_are_one_of_each_fingerprint_group(spark):
    """The stage holds the links of the fingerprints, also of texts whose shingle sets are less alike."""
    pick = np.random.RandomState(5)
    fresh = lambda n: " ".join(f"w{x}" for x in pick.randint(0, 10**6, n))
    texts = [fresh(40) for _ in range(20)]
    texts += ["la " * 100 + fresh(8) for _ in range(4)]  # one shingle is over half: equal fingerprints
    long = " ".join(["mi"] * 80 + ["so"] * 79)
    texts += [long + " " + fresh(k) for k in (1, 2, 9)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(docs).collect()}
    assert len(set(groups.values())) <= len(texts) - 4
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()) == sorted(set(groups.values()))


def word_sets_similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("chunk", [500, 7])
def test_similar_groups_match_brute_force(spark, chunk):
    """Appended passages, replaced blocks, scattered edits and short texts, on both sides of 0.8."""
    pick = np.random.RandomState(8)
    fresh = lambda n: [f"w{x}" for x in pick.randint(0, 10**6, n)]
    texts = []
    for i in range(60):
        base = fresh(200)
        texts.append(base)
        texts.append(base + fresh(40 + i % 20))
        block = 12 + i % 16
        texts.append(base[:80] + fresh(block) + base[80 + block :])
        spread = list(base)
        for at in range(10, 200, 200 // (3 + i % 4)):
            spread[at] = f"x{i}y{at}"
        texts.append(spread)
        short = fresh(3 + i % 20)
        texts += [short, short[:-1] + fresh(1), [*short, *fresh(1)]]
    base = fresh(100)
    texts += [base[k:] + fresh(k) for k in range(0, 60, 2)]  # a chain
    base = fresh(200)
    texts += [base[: 5 + 4 * i] + fresh(9) + base[14 + 4 * i :] for i in range(20)]  # alike to the next one only through it,
    texts.append(base)
    texts += [base[:170] + fresh(9) + base[179:180] + fresh(9) + base[189:] for _ in range(20)]  # or not at all
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["first"] for r in simhash.similar_groups(docs, chunk=chunk).collect()}
    wanted = list(range(len(texts)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] & sets[j] and word_sets_similarity(texts[i], texts[j]) >= 0.8 and wanted[i] != wanted[j]:
                low, high = sorted((wanted[i], wanted[j]))
                wanted = [low if w == high else w for w in wanted]
    assert got == dict(enumerate(wanted))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (None, 3), (200, 201)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and got[201] == 200 and 100 not in got


def test_components_of_a_large_star_and_a_bipartite_graph(spark):
    star = spark.range(1, 3001).selectExpr("0L AS u", "id AS v")
    dense = spark.range(900).selectExpr("10000 + id % 30 AS u", "20000 + CAST(id / 30 AS long) AS v")
    got = {r["node"]: r["component"] for r in connected_components(star.unionByName(dense)).collect()}
    assert {got[i] for i in range(3001)} == {0} and {v for k, v in got.items() if k >= 10000} == {10000} and len(got) == 3061


def test_contamination_matches_brute_force(spark, small):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    pick = items[0][1].split()
    extra = [(9001, "lead in " + " ".join(pick[:-1] + ["other"]).upper() + " tail"), (9002, " ".join(pick[: len(pick) // 2])), (9003, None), (None, items[1][1])]
    docs = small.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs, bench).collect()}

    def grams(t):
        w = re.findall(r"\w+", t.lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    wanted = set()
    for d, t in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        mine = grams(t or "")
        for i, text in items:
            c = Counter(grams(text))
            m = sum(c.values())
            for a in range(len(mine) - m + 1):
                shared = sum((Counter(mine[a : a + m]) & c).values())
                if shared / (2 * m - shared) >= 0.8:
                    wanted.add((d, i))
                    break
    assert got == wanted and (9001, items[0][0]) in got and (9002, items[0][0]) not in got
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.count() == docs.count() - len({d for d, _ in wanted})
    blocks = decontaminate.Settings(block_chars=2000)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs, bench, blocks).collect()} == wanted
    assert decontaminate.contaminations(docs, bench.limit(0)).count() == 0


def best_similarity(text, item):
    """The highest similarity of an item-sized window, or of a shorter text, by brute force."""
    mine, wanted = ([tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (re.findall(r"\w+", t.lower()) for t in (text, item)))
    m, best = len(wanted), 0.0
    for a in range(max(1, len(mine) - m + 1)):
        window = mine[a : a + m]
        shared = sum((Counter(window) & Counter(wanted)).values())
        best = max(best, shared / (len(window) + m - shared))
    return best


@pytest.mark.parametrize(("size", "edits"), [(50, 1), (100, 2), (150, 3), (200, 4), (300, 4), (300, 6), (500, 10)])
def test_items_with_unknown_words_are_found(size, edits):
    pick = np.random.RandomState(size + edits)
    items = [(i, " ".join(f"v{x}" for x in pick.randint(0, 4000, size))) for i in range(40)]
    index = decontaminate.ItemIndex(items)
    for i, text in items:
        words = text.split()
        for e in range(edits):
            words[(2 * e + 1) * size // (2 * edits)] = f"unknown{i}x{e}"
        changed = " ".join(["lead", "in", *words, "tail"])
        best = best_similarity(changed, text)
        assert best >= 0.8 and index.matches(changed).get(i) == pytest.approx(best)


@pytest.mark.parametrize("scan", [0, 10**9])
def test_block_index_is_whole_and_selective(scan):
    """All prints within the radius are found; under 5 percent of 10,000 unrelated ones are looked at."""
    pick = np.random.RandomState(4)
    prints = np.frombuffer(pick.bytes(10_000 * 32), np.uint64).reshape(-1, 4)
    index = decontaminate.BlockIndex(prints, decontaminate.Settings(), scan)
    asked = [len(index.near(np.frombuffer(pick.bytes(32), np.uint64))) for _ in range(20)]
    assert np.mean(asked) < 0.05 * len(prints)
    for i in range(40):
        bits = np.unpackbits(prints[i].view(np.uint8))
        bits[pick.choice(256, 40 + i % 30, replace=False)] ^= 1
        value = np.packbits(bits).view(np.uint64)
        assert index.within(value).tolist() == np.flatnonzero(np.bitwise_count(prints ^ value).sum(axis=1) <= 63).tolist()


def test_item_index_is_small():
    """A full block of items costs a worker less than 300 MB."""
    import tracemalloc

    pick = np.random.RandomState(6)
    vocabulary = np.array([f"word{i}" for i in range(60_000)])
    items = [(i, " ".join(vocabulary[pick.randint(0, 60_000, 60)])) for i in range(1300)]  # a tenth of a block
    chars = sum(len(t) for _, t in items)
    tracemalloc.start()
    index = decontaminate.ItemIndex(items)
    held = tracemalloc.get_traced_memory()[1] * decontaminate.Settings().block_chars / chars
    tracemalloc.stop()
    assert held < 300e6 and len(index.item_ids) == 1300


def test_decontamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (None, None), (2, ""), (3, "tie tie")], "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(odd, bench).collect())
    assert got == {(3, 1): 2, (5, 3): 1, (6, 3): 1}
    named = odd.withColumnRenamed("text", "Text").withColumn("item_id", F.lit("x"))
    kept = decontaminate.drop_contaminated(named, bench)
    assert kept.columns == named.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 4]
    assert decontaminate.drop_contaminated(odd.limit(0), bench).count() == 0 and decontaminate.drop_contaminated(odd, bench.limit(0)).count() == len(ODD)


def test_texts_shorter_than_the_item_are_compared():
    pick = np.random.RandomState(5)
    items = [(i, " ".join(f"v{x}" for x in pick.randint(0, 2000, size))) for i, size in enumerate([5, 6, 20, 50, 50, 120, 400])]
    index = decontaminate.ItemIndex(items)
    for i, text in items:
        words = text.split()
        for cut in range(1, len(words), max(1, len(words) // 25)):
            for part in (words[:-cut], words[cut:], [*words[: len(words) // 2], *words[len(words) // 2 + cut :]]):
                best = best_similarity(" ".join(part), text)
                assert index.matches(" ".join(part)).get(i, 0) == pytest.approx(best if best >= 0.8 else 0)
    assert items[3][0] in index.matches(" ".join(items[3][1].split()[:-1])) and index.matches("") == {}


def plain_quality(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_limits(spark, odd):
    texts = [t or "" for _, t, *_ in ODD] + ["a b c d e f a b c d e g a b\n \n\na\na", "# $ <|> end"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality.judge_quality(docs, labels).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_quality(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    assert quality.judge_quality(odd, labels).count() == len(ODD)


def test_binomial_tail_and_cutoffs(spark):
    from math import comb

    rows = spark.createDataFrame([(3, 50), (0, 200), (10, 400)], "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(sum(comb(r["n"], i) * 0.05**i * 0.95 ** (r["n"] - i) for i in range(r["k"] + 1)), rel=1e-9)
    good = [("a", 0.01 * (i % 5), True) for i in range(2000)] + [("a", 0.6, False)] * 100 + [("b", 0.0, True)] * 20 + [("b", 0.9, False)] * 20
    got = quality.risk_controlled_cutoffs(spark.createDataFrame(good, "stratum string, badness double, good boolean")).collect()
    assert [r["stratum"] for r in got] == ["a"]  # 20 good texts can't show a limit of 5 percent
    assert 0.04 <= got[0]["cutoff"] < 0.6 and got[0]["n_rejected"] == 0


def test_language_identification(spark, small):
    rows = {r["doc_id"]: r for r in langid.identify_languages(small).collect()}
    truth = {r["doc_id"]: r["lang"] for r in small.collect()}
    out = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(rows[d]["held_out"] == (d in out) for d in truth)
    assert sum(rows[d]["lang_pred"] == truth[d] for d in out) >= 0.9 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_language_edges(spark, odd):
    got = langid.identify_languages(odd).collect()
    assert len(got) == len(ODD)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2)} == {"und"}
    assert langid.identify_languages(odd.where("lang IS NULL")).first()["lang_pred"] == "und"


def test_secret_spans_and_owners(spark):
    live, shared = "Zx9" + "k" * 20 + "77", "deadbeef" * 4
    rows = [(1, f'the token = "{live}" ends', "a"), (2, f"é {live} alone", "b"), (3, f"AKIA{'Q' * 16} {shared} {shared[:20]}", "c")]
    rows += [(10 + i, f"hash {shared}", f"o{i}") for i in range(6)] + [(30, None, None), (31, "token=abc password: 'abcdef'", "a"), (31, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("spans", F.lit("x"))
    got = defaultdict(list)
    for r in secrets.secret_spans(docs).collect():
        got[r["doc_id"]].append(r)
    assert got[1][0]["spans"] == "assign:4:38" and got[1][0]["n_live"] == 1
    assert got[2][0]["spans"] == "owned:2:27" and got[2][0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[3][0]["spans"] == "access:0:20,hex:21:53" and got[3][0]["n_example"] == 1
    assert got[30][0]["spans"] == "" and sorted(r["spans"] for r in got[31]) == ["", "assign:10:27"]
    red = {r["doc_id"]: r["text"] for r in secrets.redact_live(docs).collect()}
    assert red[1] == 'the token = "[SECRET]" ends' and red[2] == "é [SECRET] alone" and shared in red[10] and red[30] is None
    assert secrets.redact_live(docs).count() == len(rows)


def plain_secrets(rows, most=3, share=0.15):
    """Verdicts per row by loops over the whole corpus; rows are (repository, text, owner)."""
    base, bare = [], []
    owners, repos = defaultdict(set), defaultdict(set)
    for repo, text, owner in rows:
        text = text or ""
        found = [(m.start(), 0, m.end(), m.group(2)) for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 6]
        found += [(m.start(), 1, m.end(), m.group()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
        found += [(m.start(), 2, m.end(), m.group()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
        words = [(s, 3, e, text[s:e], r) for s, e, r in secrets.bare_values(text, [(s, k, e, s, e) for s, k, e, _ in sorted(found)])]
        base.append(sorted(found))
        bare.append(words)
        for x in found + words:
            owners[x[3]].add(owner or "")
            repos[x[3]].add(str(repo))
    few = min(most, -(-len({o or "" for _, _, o in rows}) * share // 1))
    of_base = {x[3] for f in base for x in f}
    out = []
    for found, words in zip(base, bare, strict=True):
        live = [w for w in words if len(owners[w[3]]) <= few and (w[4] or w[3] in of_base)]
        live = [w for w in live if not any(o[0] <= w[0] and w[2] <= o[2] and o is not w and (o[0], -o[2]) < (w[0], -w[2]) for o in live)]
        spans = sorted(found + [w[:4] for w in live])
        out.append(",".join(f"{secrets.KINDS[k]}:{s}:{e}:{len(owners[v])}:{len(repos[v])}:{'live' if len(owners[v]) <= few else 'example'}" for s, k, e, v in spans))
    return out


def test_secret_verdicts_match_brute_force(spark):
    """Copied examples of many owners beside values of one or two, planted with and without their context."""
    pick = np.random.RandomState(12)
    letters = list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789")
    fresh = lambda n: "".join(pick.choice(letters, n - 2)) + "7q"
    examples, own = [fresh(24) for _ in range(4)], [fresh(20 + i) for i in range(12)]
    forms = ["call {} now", 'token = "{}"', "url?sig={}&x=1", "path a/{}", "password: {}", "{}", "dup {0} {0}", "AKIA{}".replace("{}", "Q7" * 9) + " {}"]
    rows = []
    for i in range(160):
        text = f"plain words {i} and more "
        if i % 2:
            text += forms[i // 2 % len(forms)].format(examples[i % 4])
        if i % 3 == 0:
            text += " " + forms[i // 3 % len(forms)].format(own[i % 12])
        owner = f"o{i % 12}" if i % 3 == 0 else f"o{i % 25}"
        rows.append((i, text, owner))
    rows += [(500, "deadbeef" * 4, "o1"), (501, None, None), (502, "", "o2"), (502, "", "o2"), (503, "mail.a7b@example.com 10.0.0.1 v1.2.3 2024-01-02T10:00", "o3"), (504, "x" * 50_000 + " " + own[0], "o0"), (505, f"eyJ{own[1]}.eyJ{own[2]}.{own[3]}", "o1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r["doc_id"], r["verdicts"]) for r in secrets.secret_spans(docs).collect())
    assert got == sorted(zip([d for d, _, _ in rows], plain_secrets([(d, t, o) for d, t, o in rows]), strict=True))
    by = dict(got)
    assert any("owned" in v and ":live" in v for v in by.values()) and any(":example" in v for v in by.values()) and "owned" not in by[503]
    kept = {r["doc_id"]: r["text"] for r in secrets.redact_live(docs).collect()}
    assert not any(v in t for v in own for t in kept.values() if t) and any(v in t for v in examples for t in kept.values() if t)


def test_secrets_of_odd_tables(spark, odd):
    named = odd.withColumns({"_ff_rid": F.lit("r"), "hash": F.lit(1), "rid": F.lit(2), "owner": F.lit("o"), "_salt": F.lit(0), "f.g": F.lit(3)}).withColumnRenamed("text", "TEXT")
    assert secrets.secret_spans(named).count() == len(ODD)
    for docs in (named, odd.drop("source"), odd.select("text")):
        got = secrets.redact_live(docs)
        assert got.dtypes == docs.dtypes and got.count() == len(ODD)
    alone = secrets.redact_live(spark.createDataFrame([("token: abc7defgh9",), ("a abc7defgh9 b",)], "text string"))
    assert sorted(r["text"] for r in alone.collect()) == ["a [SECRET] b", "token: [SECRET]"]
    assert secrets.secret_spans(odd.limit(0)).count() == 0 and secrets.redact_live(odd.limit(0)).count() == 0


def test_shards_are_even_and_moves_few(spark, odd, small):
    many = spark.range(3001).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("é"))
    got = sharding.shard_documents(many, 24).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == 10 and r["text_crc32"] == zlib.crc32("é".encode())
    assert len(slots) == 24 and {len(v) for v in slots.values()} <= {125, 126}
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sum(r["shard"] != r["home_shard"] for r in got) < 0.15 * len(got)
    assert sharding.shard_documents(odd).count() == len(ODD) and sharding.shard_documents(odd.limit(0)).count() == 0


def plain_ring(positions, shards, copies, factor):
    """Each row's shard by walking the ring row by row; ``positions`` maps a row to its place."""
    import bisect

    nodes = sorted(copies)
    order = sorted(positions, key=lambda r: (positions[r], r))
    home = {r: nodes[bisect.bisect_left(nodes, (positions[r], -1)) % len(nodes)][1] for r in order}
    n = len(order)
    bound = [-(-n * factor // shards) if factor > 1 else n // shards + (s < n % shards) for s in range(shards)]
    load, out, over = [0] * shards, {}, []
    for r in order:
        if load[home[r]] < bound[home[r]]:
            load[home[r]] += 1
            out[r] = home[r]
        else:
            over.append(r)
    for r in over:
        at = bisect.bisect_left(nodes, (positions[r], -1))
        s = next(o for i in range(len(nodes)) if load[o := nodes[(at + i) % len(nodes)][1]] < bound[o])
        load[s] += 1
        out[r] = s
    return out, home, load


@pytest.mark.parametrize("factor", [1.0, 1.2])
def test_ring_matches_a_plain_one(spark, factor):
    rows = spark.range(700).selectExpr("id AS n", "IF(id < 150, NULL, id) AS k")
    places = {r["n"]: r["p"] for r in rows.select("n", F.xxhash64("k").alias("p")).collect()}
    nodes = [(r["pos"], r["owner"]) for r in sharding.ring(spark, 5, 8).collect()]
    got = sharding.shard_by_ring(rows, F.col("k"), 5, 8, factor, slices=16).collect()
    out, home, load = plain_ring(places, 5, nodes, factor)
    assert Counter(r["shard"] for r in got) == {s: n for s, n in enumerate(load) if n}
    assert all(r["home_shard"] == home[r["n"]] for r in got)
    one = [r for r in got if r["k"] is not None]  # which of the rows at one place go on is open
    moved = Counter((places[r["n"]], r["shard"]) for r in got)
    assert moved == Counter((places[n], s) for n, s in out.items()) and len(one) == 550


def test_a_hot_key_is_dealt_over_the_slices(spark, monkeypatch):
    kept = []
    plain = sharding.materialize
    monkeypatch.setattr(sharding, "materialize", lambda df, label: kept.append((label, out := plain(df, label))) or out)
    sharding.shard_by_ring(spark.range(4000).selectExpr("IF(id % 2 = 0, NULL, id) AS k", "0 AS pos"), F.col("k"), 4, 8, slices=20).count()
    sizes = [r["count"] for r in dict(kept)["ring-slices"].groupBy("slice").count().collect()]
    assert max(sizes) < 3 * 4032 / 20


def test_toxicity_finds_words_and_prefixes(spark):
    pick = np.random.RandomState(2)
    words = ["".join(pick.choice(list("abcdeiou"), 5)) for _ in range(400)]
    texts, labels = [], []
    for i in range(360):
        body = pick.choice(words, 60).tolist()
        bad = i % 6 == 0
        if bad:
            for at in pick.choice(60, 3, replace=False):
                body[at] = "zork" + pick.choice(words) if i % 12 else "glimp"
        texts.append(" ".join(body))
        labels.append(int(bad))
    model = toxicity.train(texts[:270], labels[:270])
    y = np.array(labels[270:]) == 1
    said = model.scores(texts[270:]) >= 0.3
    assert (said == y).mean() > 0.95
    late = " ".join(pick.choice(words, 3000)) + " glimp zorkabc glimp"
    assert model.scores([late, "", " ".join(pick.choice(words, 3000))])[0] >= 0.3
    docs = spark.createDataFrame([(1, None), (None, late), (2, "")], "doc_id long, text string")
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.drop_toxic(docs, None).count() == 3
    assert toxicity.train([], []) is None


def test_scores_are_the_highest_of_all_windows():
    """Brute force: every word's vector, every window's logit, one at a time."""
    pick = np.random.RandomState(9)
    words = ["".join(pick.choice(list("abcdeiou"), 4)) for _ in range(60)]
    texts = [" ".join(pick.choice(words, n)) for n in (1, 5, 31, 32, 33, 48, 49, 300)] + ["", "!!"]
    model = toxicity.train([*texts, *texts], [i % 2 for i in range(2 * len(texts))], toxicity.Settings(steps=20))
    for text, score in zip(texts, model.scores(texts), strict=True):
        own = text.split() if text != "!!" else []
        logits = []
        for start in range(0, max(1, len(own)), 16):
            if start and start + 16 >= len(own):
                break  # the window before holds all of this one
            part = own[start : start + 32]
            x, mask = np.zeros((1, 32, model.inputs.size), np.float32), np.zeros((1, 32), np.float32)
            mask[0, 0] = 1
            for i, w in enumerate(part):
                x[0, i], mask[0, i] = model.inputs.vectors(*model.inputs.parts([w]))[0], 1
            logits.append(float(model.network.forward(x, mask)[0]))
        assert score == pytest.approx(1 / (1 + np.exp(-max(logits))), abs=1e-4)


def test_char_grams_are_those_of_each_word():
    words = ["a", "abc", "", "ab", "xabcx", "é한", "abc"]
    hashes, owner = toxicity.char_grams(words)
    name = {}
    for i, w in enumerate(words):
        marked = f"^{w}$"
        plain = sorted(marked[a : a + n] for n in (3, 4, 5) for a in range(len(marked) - n + 1))
        assert (owner == i).sum() == len(plain)
        alone = toxicity.char_grams([w])[0]
        assert sorted(alone.tolist()) == sorted(hashes[owner == i].tolist())
        name.setdefault(tuple(plain), set()).add(tuple(sorted(alone.tolist())))
    assert all(len(v) == 1 for v in name.values()) and len({h for v in name.values() for h in v}) == len(name)


def test_embeddings_learn_their_gradients():
    """What reaches the n-grams and words is the difference quotient of the vectors."""
    pick = np.random.RandomState(3)
    keys = np.unique(toxicity.char_grams(["abc", "bcd"])[0])
    inputs = toxicity.Inputs({"abc": 1, "bcd": 2}, keys, toxicity.Embedding(np.array([0.1, -0.2]), 3, pick), toxicity.Embedding(0.1 * np.arange(len(keys)), 2, pick))
    own, flat, starts, lengths = inputs.parts(["abc", "bcd", "xyz"])
    weights = pick.normal(size=(3, inputs.size)).astype(np.float32)
    seen = {}
    for e, name in ((inputs.words, "words"), (inputs.grams, "grams")):
        def keep(rows, grads, rate, name=name, e=e):
            total = np.zeros_like(e.table)
            np.add.at(total, rows, grads)
            seen[name] = total
        e.step = keep
    inputs.learn(own, flat, starts, weights, 0.1)
    for e, name in ((inputs.words, "words"), (inputs.grams, "grams")):
        for at in [(1, 0), (2, 1)]:
            kept = e.table[at]
            e.table[at] = kept + 1e-3
            up = float((inputs.vectors(own, flat, starts, lengths) * weights).sum())
            e.table[at] = kept - 1e-3
            down = float((inputs.vectors(own, flat, starts, lengths) * weights).sum())
            e.table[at] = kept
            assert seen[name][at] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=2e-3)


def test_toxicity_on_held_out_labels(spark):
    """sf0.1's labels: some toxic texts have lost their words to repetition or capitals."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    known = docs.join(labels.where("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id").where(langid.held_out(F.col("doc_id")))
    got = [(r["toxic"], r["predicted"]) for r in toxicity.score_toxicity(known, model).join(known.select("doc_id", "toxic"), "doc_id").collect()]
    toxic = [p for t, p in got if t == 1]
    clean = [p for t, p in got if t == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.015 * len(clean)


def test_toxicity_of_odd_tables(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(odd, labels)
    assert toxicity.score_toxicity(odd, model).count() == len(ODD) and toxicity.score_toxicity(odd.limit(0), model).count() == 0
    named = odd.withColumnRenamed("text", "Text").withColumns({"score": F.lit(1), "a.b": F.lit(2)})
    kept = toxicity.drop_toxic(named, None)
    assert kept.dtypes == named.dtypes and kept.count() == len(ODD)
    assert toxicity.drop_toxic(odd.limit(0), model).count() == 0 and toxicity.fit_toxicity(odd, labels.limit(0)) is None


def test_gradients_agree_with_differences():
    net = toxicity.Network(4, 3, 0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = np.random.RandomState(0).normal(size=(2, 5, 4)), np.ones((2, 5))
    mask[1, 3:] = 0
    trace = {}
    net.forward(x, mask, trace)
    grads = net.gradients(trace, np.array([1.0, -0.5]))
    kept = x[0, 2, 1]
    x[0, 2, 1] = kept + 1e-4
    up = float(net.forward(x, mask) @ np.array([1.0, -0.5]))
    x[0, 2, 1] = kept - 1e-4
    assert trace["dx"][0, 2, 1] == pytest.approx((up - float(net.forward(x, mask) @ np.array([1.0, -0.5]))) / 2e-4, rel=2e-2, abs=2e-4)
    x[0, 2, 1] = kept
    loss = lambda: float(net.forward(x, mask) @ np.array([1.0, -0.5]))
    for name, value in net.p.items():
        at = tuple(0 for _ in value.shape)
        kept = value[at]
        value[at] = kept + 1e-4
        up = loss()
        value[at] = kept - 1e-4
        down = loss()
        value[at] = kept
        assert grads[name][at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-4)


def test_chat_round_trip(spark):
    odd = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", odd), (-1, 1, "assistant", odd), (2, 0, None, None), (2, 1, "x[NAME]\\y", "a\\0b [/ROLE]\\\n</s"), (2, 2, "assistant", " </s> \\a[OUT"), (3, 0, "user", ""), (3, 0, "user", ""), (None, 5, "system", "s")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(turns)).collect()}
    for conv in got:
        mine = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        said, trained = "".join(f"{r}\n{x}\n" for _, r, x in mine), "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[conv]["n_turns"] == len(mine)
        assert got[conv]["loss_sha256"] == hashlib.sha256(trained.encode()).hexdigest() and got[conv]["loss_chars"] == len(trained)
    assert got[-1]["valid"] and not got[3]["valid"] and got[3]["first_bad_turn"] == 1
    assert chat.conversation_digests(chat.format_conversations(turns.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.ChatTemplate(escape="[")


def test_pipeline_runs_whole(spark, tmp_path):
    import shutil

    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def _grown_heap(spark):
    """MB of the executors' heap (here the driver's too) after garbage of 800 MB was made."""
    assert spark.range(1).selectExpr("length(repeat('x', cast(id AS int) + 800000000)) AS n").first()["n"] == 800_000_000
    return _heap_mb(spark)


def _heap_mb(spark):
    return spark._jvm.java.lang.Runtime.getRuntime().totalMemory() >> 20


def test_freed_heap_goes_back(spark):
    before = _grown_heap(spark)
    give_back_heap(spark)
    assert _heap_mb(spark) < before - 500


def test_each_pipeline_stage_begins_with_heap_given_back(spark, tmp_path, monkeypatch):
    import shutil

    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # only what comes before each stage's own work
    for work in ("drop_toxic", "fit_toxicity", "keep_one_of_each", "drop_contaminated", "redact_live", "pack_documents"):
        monkeypatch.setattr(corpus_pipeline, work, lambda docs, *_, **__: docs)
    for name, stage in corpus_pipeline.STAGES:
        before = _grown_heap(spark)
        stage(spark, docs, str(tmp_path))
        assert _heap_mb(spark) < before - 500, name
