"""Literal fixtures with hand-computed values, and the traps of the original semantics."""

import hashlib
import importlib
import inspect
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import chunking, datasets, generation, lexicon, metrics, retrieval
from folioforge.operators import statistics as stats
from folioforge.plans import pipelines

STANDARD = (
    "5.1 Accessibility requirement\nThe access clearance shall be >= 500 mm for hand entry and the opening is marked; MTTR is given elsewhere h.\n"
    "5.2 Diagnostics requirement\nThe FDR of the built-in test shall be >= 95 % for all units and the check lasts no longer than one h, see Table 5-1."
)


def one(spark, value, **columns):
    rows = spark.createDataFrame([tuple(columns.values())], list(columns))
    return rows.select(value.alias("v")).first()["v"]


def test_partial_and_tuple_scores(spark):
    gold, pred = "no less than 500 mm", "at least 500 mm [Source 1]"  # two tokens shared of five and six
    assert one(spark, metrics.partial_match(F.col("p"), F.col("g")), p=pred, g=gold) == pytest.approx(4 / 11)
    rows = spark.createDataFrame([("at least 450 mm", "500 mm"), ("at least 500 mm", "500 mm")], "p string, g string")
    rows = rows.select(metrics.answer_tuples(F.col("p"), F.lit("Accessibility")).alias("p"), metrics.answer_tuples(F.col("g"), F.lit("Accessibility")).alias("g"))
    assert [round(r["v"], 6) for r in rows.select(metrics.tuple_f1(F.col("p"), F.col("g")).alias("v")).collect()] == [0.833333, 1.0]


def test_numeric_tuples_reach_the_tolerance_on_request(spark):
    rows = spark.createDataFrame([("95 mm", "100 mm")], "p string, g string").select(metrics.answer_tuples(F.col("p"), F.lit("a")).alias("p"), metrics.answer_tuples(F.col("g"), F.lit("a")).alias("g"))
    assert rows.select(metrics.tuple_f1(F.col("p"), F.col("g"), numeric=True).alias("v")).first()["v"] == pytest.approx(1.0)


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([("d1", 1, "a b"), ("d2", 2, "a c c"), ("d3", 3, None)], "chunk_id string, ord int, content string").where("content IS NOT NULL")
    queries = spark.createDataFrame([("q", "c")], "query_id string, text string")
    hits = {r["chunk_id"]: r["score"] for r in retrieval.bm25(retrieval.lexical_index(chunks), queries, 2, fill=True).collect()}
    assert hits["d2"] == pytest.approx(0.930399, abs=1e-6)
    assert hits["d1"] == 0


def test_rrf_and_ndcg(spark):
    hits = spark.createDataFrame([("q", "a", 1, 1), ("q", "a", 3, 1), ("q", "b", 2, 2)], "query_id string, chunk_id string, rank int, ord int")
    assert retrieval.reciprocal_rank_fusion(hits).first()["score"] == pytest.approx(1 / 61 + 1 / 63)
    gold = spark.createDataFrame([("q", "b")], "query_id string, chunk_id string")
    listed = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, chunk_id string, rank int")
    got = metrics.retrieval_metrics(listed, gold, 5).first()
    assert got["ndcg"] == pytest.approx(0.63093, abs=1e-5)
    assert (got["recall"], got["mrr"]) == (1.0, 0.5)


def test_fleiss(spark):
    ratings = spark.createDataFrame([("d", i, r) for i, rs in enumerate([(5, 5, 5), (4, 4, 5)]) for r in rs], "dim string, item int, rating int")
    assert stats.fleiss_kappa(ratings, ["dim"]).first()["kappa"] == pytest.approx(0.25)


def test_value_extraction_splits_numbers_without_a_word(spark):
    got = one(spark, T.parameter_values(F.col("t")), t="MTTR: 2 h; a 600 mm gap (500 mm); 30 min; width >= 50 mm")
    assert [(r["parameter"], r["value"], r["unit"]) for r in got] == [("MTTR", 2.0, "h"), ("a", 600.0, "mm"), ("50", 0.0, "mm"), ("3", 0.0, "m"), ("5", 0.0, "mm")]


def test_plain_numbers(spark):
    rows = spark.createDataFrame([(500.0,), (0.5,), (1e7,), (12.25,)], "x double").select(T.plain_number(F.col("x")).alias("p"), T.float_text(F.col("x")).alias("f")).collect()
    assert [tuple(r) for r in rows] == [("500", "500.0"), ("0.5", "0.5"), ("10000000", "10000000.0"), ("12.25", "12.25")]


def test_taxonomy_is_substring_unless_asked(spark):
    got = one(spark, lexicon.classify(F.col("t")), t="What is the minimum accessibility clearance and MTTR requirement?")
    assert {"Accessibility", "Time Parameters"} <= set(got)
    assert "Diagnostics" in one(spark, lexicon.classify(F.col("t")), t="a habit")
    assert one(spark, lexicon.classify(F.col("t"), whole_words=True), t="a habit") == []


def test_structured_document(spark):
    docs = spark.createDataFrame([("d", STANDARD), ("e", None), ("f", "")], "doc_id string, text string")
    got = {r["chunk_id"]: r for r in chunking.structured_chunks(docs).collect()}
    assert [c for c in sorted(got) if "_L2" not in c] == ["d_L1_000", "d_L1_001"]
    assert {r["layer"] for r in got.values()} == {1, 2, 3}
    assert sum(r["layer"] == 3 for r in got.values()) == 2
    assert got["d_L1_000"]["child_ids"] == ["d_L1_000_L2_000"]
    assert got["d_L1_000_L2_000"]["child_ids"] == ["d_L1_000_L2_000_L3_num_00"]
    assert "Accessibility" in got["d_L1_000"]["constraint_types"]
    assert got["d_L1_001"]["semantic_type"] == "constraint_specification"


def test_cross_references_take_the_first_other_chunk(spark):
    chunks = spark.createDataFrame([("a", "d", 0, "as said see Table 3"), ("b", "d", 1, "3 is here"), ("c", "d", 2, "3 too")], "chunk_id string, doc_id string, ord int, content string")
    assert [(r["chunk_id"], r["target_id"]) for r in chunking.cross_references(chunks).collect()] == [("a", "b")]


def test_fixed_and_recursive_chunks(spark):
    docs = spark.createDataFrame([("d", "x" * 500 + " " * 600 + "y"), ("n", None)], "doc_id string, text string")
    fixed = chunking.fixed_chunks(docs).orderBy("ord").collect()
    assert [(r["start_pos"], r["end_pos"]) for r in fixed] == [(0, 512), (462, 974), (924, 1101)]
    with pytest.raises(ValueError):
        chunking.fixed_chunks(docs, 10, 10)
    text = spark.createDataFrame([("d", "aa bb cc dd"), ("n", None)], "doc_id string, text string")
    assert [r["content"] for r in chunking.recursive_chunks(text, 6, 2).orderBy("ord").collect()] == ["aa bb", "b cc", "c dd"]


def test_sentences_longer_than_the_limit_stay_whole(spark):
    got = one(spark, chunking.packed_sentences(F.col("t"), 10), t="abc. defg. a very long sentence. x.")
    assert got == ["abc. defg.", " a very long sentence.", " x."]


def test_semantic_and_adaptive_chunks(spark):
    docs = spark.createDataFrame([("d", "aa aa. aa aa. zz zz.\n\nqq qq")], "doc_id string, text string")
    embed = pipelines.hashed_embedder
    assert [r["content"] for r in chunking.semantic_chunks(docs, embed).orderBy("ord").collect()] == ["aa aa.aa aa.", "zz zz.", "qq qq"]
    assert len(chunking.adaptive_chunks(docs, embed, 5, 8).collect()) == 2


def test_verdicts(spark):
    assert one(spark, generation.verdict_branch(F.col("t")), t="incorrect") == "correct"
    assert one(spark, generation.verdict_branch(F.col("t"), strict=True), t="incorrect") == "incorrect"


def test_confidence_and_warning(spark):
    answers = spark.createDataFrame([("q", "width 7 kg"), ("r", "nothing")], "query_id string, answer string")
    hits = spark.createDataFrame([("q", 1, "c1", "width is 7 or so"), ("q", 2, "c2", "the width")], "query_id string, rank int, chunk_id string, content string")
    verified = generation.verify_values(answers, hits)
    assert verified.first()["confidence"] == pytest.approx(0.75)
    got = {r["query_id"]: r for r in generation.grounded(answers, verified).collect()}
    assert got["r"]["confidence"] == 0.8 and got["r"]["answer"] == "nothing"


def test_t_distribution():
    assert stats.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert stats.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert math.isnan(stats.t_two_sided(float("nan"), 5))


def test_weighted_kappa_and_rank_correlation(spark):
    pairs = spark.createDataFrame([("g", i, a, b) for i, (a, b) in enumerate([(1, 2), (2, 1), (3, 3), (4, 5), (5, 4)])], "g string, item int, a int, b int")
    assert stats.weighted_kappa(pairs, ["g"]).first()["kappa"] == pytest.approx(0.8)
    assert stats.spearman(pairs, ["g"]).first()["r"] == pytest.approx(0.8)


def test_stratified_sample_tops_up(spark):
    rows = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(40)], "id int, kind string")
    got = datasets.stratified_sample(rows, "kind", "id", 20).collect()
    assert len(got) == 20 and sum(r["kind"] == "a" for r in got) == 3


def test_headed_records_and_guidelines(spark):
    lines = [(1, 0, "1.1 First Clause"), (1, 1, "body one"), (2, 0, "goes on"), (2, 1, "1.2 Empty Clause"), (2, 2, "1.3 Last Clause"), (3, 0, "end")]
    rows = spark.createDataFrame(lines, "page_num int, line_no int, line string")
    got = datasets.headed_records(rows).orderBy("nth").collect()
    assert [(r["id"], r["text"], r["page"]) for r in got] == [("1.1", "body one goes on", 1), ("1.3", "end", 2)]
    machine = spark.createDataFrame([("h", 1, 0, "A1"), ("h", 1, 1, "Doors"), ("h", 1, 2, "lost text"), ("h", 2, 0, "AB-1 Use wide doors"), ("h", 2, 1, "always")], "doc string, page_num int, line_no int, line string")
    got = [(r["guideline_id"], r["guideline_text"], r["page"]) for r in datasets.guideline_records(machine).orderBy("page", "guideline_id").collect()]
    assert got == [("AB-1", "Use wide doors always", 2), ("OCRMISS-0001", "lost text", 2)]


def test_query_variants(spark):
    said = "1. first variant\nnoise\n2) second variant\n3. abc"
    assert one(spark, retrieval.query_variants(F.col("q"), F.col("t")), q="the query", t=said) == ["the query", "first variant", "second variant"]


def test_sources(spark, tmp_path):
    from folioforge.sources import readers

    (tmp_path / "p.jsonl").write_text('{"page_num": 1, "text": "short"}\n{"page_num": 2, "text": "' + "x" * 120 + '", "odd": 1}\n')
    assert [r["doc_id"] for r in readers.page_corpus(spark, str(tmp_path / "p.jsonl"), "h").collect()] == ["h_page_2"]
    (tmp_path / "d.md").write_text("# A\n\nb")
    assert readers.documents(spark, str(tmp_path / "d.md")).first()["content"] == "# A\n\nb"
    with pytest.raises(FileNotFoundError):
        readers.documents(spark, str(tmp_path / "none.md"))
    assert readers.qa_items(spark, str(tmp_path), "dev").count() == 0
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    readers.append_new(rows, "id", str(tmp_path / "log"))
    assert readers.append_new(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), "id", str(tmp_path / "log")).count() == 1


def test_pipelines_run(spark):
    docs = spark.createDataFrame([("d1", "The access door is wide. It has a handle."), ("d2", "Pumps need oil every week.")], "doc_id string, text string")
    queries = spark.createDataFrame([(1, "wide access door"), (2, "oil for pumps")], "query_id int, text string")
    for name in ("dense", "full"):
        pipeline = pipelines.standard_pipelines()[name]
        got = {r["query_id"]: r["sources"][0] for r in pipeline.run(pipeline.ingest(docs), queries, 2).collect()}
        assert got[1].startswith("d1") and got[2].startswith("d2")
    assert len(pipelines.ablations()) == 7


def test_stream_appends_chunks(spark, tmp_path):
    from folioforge.streaming.ingest import chunk_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"doc_id": "a", "text": "hello there"}\n')
    chunk_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), chunking.fixed_chunks).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_entry_lists_queries():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stripped_reveals_keep_one_capital_letter_as_in_sql(spark):
    import duckdb

    from __spark_entry__ import oracle_sql

    texts = ["ßheit the | enkeit", "und ßa", "ﬁn", "ᾳb ᾳ", "éa", "\x0bx  the\x0b\x0by", "\u00a0the nb", "a the\n\u2028", "a \u0085", "the", "", None, "ǆ und  x\t\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows.select("doc_id", F.md5(T.reveal_stripped(F.col("text"), ["the", "und"]).cast("binary"))).collect()
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    base.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert sorted(map(tuple, got)) == sorted(base.execute(oracle_sql()["terms_stripped"]).fetchall())


def test_bm25_in_one_pass_is_that_of_the_postings(spark, monkeypatch):
    """Ties, copies, nulls and a struct as order; no row per token or pair is shuffled."""
    texts = ["a b c", "a a b", "c d", "", "x y z", "b b b d d", "d a c b"] * 40 + ["a b c"] * 90
    rows = [(f"k{i}", t if i % 50 else None, (i * 37) % len(texts) if i % 9 else None) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string, at long").repartition(5).withColumn("ord", F.struct("at", F.struct("chunk_id").alias("of"))).drop("at")
    asked = spark.createDataFrame([(1, "a b b"), (2, "d"), (3, "none here"), (4, ""), (None, "c x a")], "query_id long, text string")
    index = retrieval.lexical_index(chunks)
    results = {}
    for cells in (retrieval.MATRIX_CELLS, 0):
        monkeypatch.setattr(retrieval, "MATRIX_CELLS", cells)
        for k in (3, 20):
            for fill in (False, True):
                hits = retrieval.bm25(index, asked, k, fill=fill)
                results[cells > 0, k, fill] = sorted(map(str, hits.select("query_id", "chunk_id", "ord", F.round("score", 8), "rank").collect()))
                assert ("Generate explode" in hits._jdf.queryExecution().executedPlan().toString()) == (cells == 0)
    for k in (3, 20):
        assert results[True, k, False] == results[False, k, False]
        assert results[True, k, True] == results[False, k, True]


def test_dense_scores_without_a_row_per_pair(spark, capsys):
    import random

    pick = random.Random(1)
    rows = [(f"c{i}", i, [pick.choice([0.1, 0.2, 0.3, -0.7]) for _ in range(3)]) for i in range(3000)]  # many ties
    odd = [None, [1.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1e200, 1e200, 1.0]]
    queries = spark.createDataFrame([(i % 6, [pick.random() - 0.5 for _ in range(3)]) for i in range(7)], "query_id int, vector array<double>")
    for more in ([], odd):
        vectors = spark.createDataFrame(rows + [(f"n{i}", 3000 + i, v) for i, v in enumerate(more)], "chunk_id string, ord int, vector array<double>")
        every = retrieval.dense(vectors, queries, None)
        for k in (1, 50, 4000):
            hits = retrieval.dense(vectors, queries, k)
            key = lambda r: (r["query_id"], r["rank"])
            assert str(sorted(hits.collect(), key=key)) == str(sorted(retrieval.top_k(every, k).collect(), key=key))
        if not more:
            hits.explain()
            assert "NestedLoop" not in (said := capsys.readouterr().out) and "Cartesian" not in said


def test_hashed_bag_counts_each_token_once(spark):
    from folioforge.functions.vectors import hashed_bag

    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["x", None])], "i int, t array<string>")
    places = F.transform("t", lambda t: F.pmod(F.xxhash64(t), F.lit(64)))
    for r in rows.select("i", hashed_bag(F.col("t")).alias("v"), places.alias("p")).collect():
        counts = [float((r["p"] or []).count(i)) for i in range(64)]
        n = sum(c * c for c in counts) ** 0.5 + 1e-8
        assert r["v"] == ([None] * 64 if r["p"] is None else [c / n for c in counts])


def test_draws_are_the_hashed_ones():
    draws, slots = np.array([0, 9, 10, 1999]), np.array([0, 9, 10, 99999, 100000, 4294967295])
    for seed in ("p", "boot", "é" * 9, "x" * 60):
        wanted = [[int(hashlib.md5(f"{seed}:{d}:{s}".encode()).hexdigest()[:8], 16) for s in slots] for d in draws]
        assert stats.draw_codes(seed, draws, slots).tolist() == wanted


def test_bootstrap_shuffles_no_row_per_draw_and_keeps_no_group_in_one_task(spark):
    n = stats.BLOCK + 5000  # the groups share a block, and the larger one has several
    rows = spark.range(n + 7).select(F.when(F.col("id") < n, "a").when(F.col("id") < n + 4, "b").when(F.col("id") < n + 6, "c").alias("g"), (-F.col("id")).alias("item"), F.when((F.col("id") % 10 > 0) & (F.col("id") < n + 4), F.col("id") % 1000 - 400.5).alias("value"))
    out = stats.resampled_means(rows, ["g"], 102)
    got = {(r["g"], r["draw"]): r["mean"] for r in out.collect()}
    assert set(got) == {(g, d) for g in "abc" for d in range(102)} and all(got["c", d] is None for d in range(102))
    for g, ids in (("a", np.arange(n)[::-1]), ("b", np.arange(n, n + 4)[::-1])):
        for d in (0, 99, 100, 101):
            drawn = ids[[int(hashlib.md5(f"boot:{d}:{j}".encode()).hexdigest()[:8], 16) % len(ids) for j in range(len(ids))]]
            drawn = drawn[drawn % 10 > 0]
            assert got[g, d] == (pytest.approx(np.mean(drawn % 1000 - 400.5)) if len(drawn) else None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Window \[.*\], \[g#\d+\]", plan) and not re.search(r"Join.*_?place", plan)


@pytest.mark.parametrize("held", [stats.HELD, 1])
def test_shares_of_draws_add_up_whatever_a_task_holds(spark, monkeypatch, held):
    """With one block held at a time, two groups lie across held ranges; values are missing in both."""
    monkeypatch.setattr(stats, "HELD", held)
    monkeypatch.setattr(stats, "BLOCK", 1 << 10)
    rows = spark.range(4000).select(F.when(F.col("id") < 2500, "a").otherwise("b").alias("g"), F.col("id").alias("item"), F.when(F.col("id") % 7 > 0, F.sqrt("id")).alias("value"))
    got = {(r["g"], r["draw"]): r["mean"] for r in stats.resampled_means(rows, ["g"], 67).collect()}
    assert set(got) == {(g, d) for g in "ab" for d in range(67)}
    for g, ids in (("a", np.arange(2500)), ("b", np.arange(2500, 4000))):
        for d in (0, 1, 33, 66):
            drawn = ids[[int(hashlib.md5(f"boot:{d}:{j}".encode()).hexdigest()[:8], 16) % len(ids) for j in range(len(ids))]]
            assert got[g, d] == pytest.approx(np.mean(np.sqrt(drawn[drawn % 7 > 0])))


def test_method_comparison_draws_as_often_as_the_operator(spark):
    """By brute force with the operator's own number of resamples."""
    import __spark_entry__ as driver

    resamples = inspect.signature(pipelines.compare_methods).parameters["resamples"].default
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").selectExpr("conv_id", "role", "length(text) AS n").toPandas()
    scores = turns.groupby(["role", "conv_id"])["n"].mean()
    rows = {r["method"]: r for r in driver.queries()["method_comparison"](spark, "/root/testdata/sf0.001").collect()}
    assert set(rows) == set(turns["role"]) - {"user"}
    for role, row in rows.items():
        items = scores[role].index.intersection(scores["user"].index).sort_values()
        diff = (scores[role][items] - scores["user"][items]).to_numpy()
        means = {s: [np.nanmean(diff[[int(hashlib.md5(f"{s}:{d}:{j}".encode()).hexdigest()[:8], 16) % len(diff) for j in range(len(diff))]]) for d in range(resamples)] for s in ("p", "ci")}
        assert row["p_value"] == round(float(np.mean(np.array(means["p"]) <= 0)), 5)
        assert [row["mean_diff"], row["low"], row["high"]] == pytest.approx([np.nanmean(diff), *np.percentile(means["ci"], [2.5, 97.5])], abs=1e-5)
