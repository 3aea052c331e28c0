"""Registered queries of the engine's operators, each with the same question in DuckDB SQL.

Doubles are rounded to six places on both sides; ranks, counts and lengths are BIGINT.
Queries read whole tables.  Lexicons are words of the test corpus; what needs headings,
units or tables runs on literal rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import chunking, datasets, generation, lexicon, metrics, retrieval
from folioforge.operators import statistics as stats
from folioforge.plans import pipelines
from folioforge.storage import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A lexicon of the test corpus's own words.
CORPUS_LEXICON = {"Article": ["the ", "der ", "les "], "Linking": [" and ", " und ", " et "], "Place": ["with", "dans", "auf"], "Passage": ["tion", "ment"], "License": ["license", "apache"]}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("ord"), F.col("text").alias("content"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-zA-Z0-9]+|[一-鿿]')"


def bm25_sql(k1: float = 1.5, b: float = 0.75) -> str:
    """CTEs up to ``scored(query_id, chunk_id, score)``."""
    return f"""docs AS (SELECT doc_id, {tok('text')} AS toks FROM documents),
    tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS token FROM docs) GROUP BY ALL),
    dl AS (SELECT doc_id, len(toks) AS dl FROM docs), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
    q AS (SELECT item_id AS query_id, token, count(*) AS qtf FROM (SELECT item_id, unnest({tok('text')}) AS token FROM benchmark) GROUP BY ALL),
    scored AS (SELECT query_id, doc_id AS chunk_id, round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl))), 9) AS score
      FROM q JOIN tf USING (token) JOIN df USING (token) JOIN dl USING (doc_id), st GROUP BY ALL)"""


def top_sql(source: str, k: int, cols: str = "query_id, chunk_id") -> str:
    return f"SELECT {cols}, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {source}) WHERE rank <= {k}"


def ranked(hits: DataFrame, *extra: str) -> DataFrame:
    return hits.select("query_id", "chunk_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"), *extra)


# ---- lexical and vector retrieval ---------------------------------------------------


@query(f"SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({tok('text')}) AS token FROM documents) GROUP BY token")
def token_df(spark, sf_dir):
    index = retrieval.lexical_index(_chunks(spark, sf_dir))
    return index.postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT count(*) AS n, round(avg(l), 6) AS avgdl, max(l) AS longest FROM (SELECT len({tok('text')}) AS l FROM documents)")
def doc_length_stats(spark, sf_dir):
    rows = _chunks(spark, sf_dir).select(F.size(T.tokens(F.col("content"))).cast("long").alias("l"))
    return rows.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("l")).alias("avgdl"), F.max("l").alias("longest"))


@query(f"WITH {bm25_sql()} {top_sql('scored', 5)}")
def bm25_topk(spark, sf_dir):
    return ranked(retrieval.bm25(retrieval.lexical_index(_chunks(spark, sf_dir)).stored(), _items(spark, sf_dir), 5))


def _two_lists(spark, sf_dir, k=50):
    index, items = retrieval.lexical_index(_chunks(spark, sf_dir)).stored(), _items(spark, sf_dir)
    return retrieval.bm25(index, items, k), retrieval.bm25(index, items, k, k1=1.2, b=0.0)


_TWO = f"""WITH {bm25_sql()},
 scored2 AS (SELECT query_id, doc_id AS chunk_id, round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE)), 9) AS score FROM q JOIN tf USING (token) JOIN df USING (token), st GROUP BY ALL),
 a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored QUALIFY r <= 50),
 b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored2 QUALIFY r <= 50)"""


@query(
    _TWO
    + """, na AS (SELECT query_id, chunk_id, (score - min(score) OVER w) / (CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END) AS s FROM a WINDOW w AS (PARTITION BY query_id)),
 nb AS (SELECT query_id, chunk_id, (score - min(score) OVER w) / (CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END) AS s FROM b WINDOW w AS (PARTITION BY query_id)),
 f AS (SELECT query_id, chunk_id, round(0.6::DOUBLE * coalesce(na.s, 0) + 0.4::DOUBLE * coalesce(nb.s, 0), 9) AS score FROM na FULL JOIN nb USING (query_id, chunk_id)) """
    + top_sql("f", 5)
)
def hybrid_minmax_topk(spark, sf_dir):
    a, b = _two_lists(spark, sf_dir)
    return ranked(retrieval.hybrid(a, b, 5))


@query(_TWO + ", u AS (SELECT query_id, chunk_id, r FROM a UNION ALL SELECT query_id, chunk_id, r FROM b), f AS (SELECT query_id, chunk_id, round(sum(1::DOUBLE / (60 + r)), 9) AS score FROM u GROUP BY ALL) " + top_sql("f", 5))
def rrf_fusion_topk(spark, sf_dir):
    a, b = _two_lists(spark, sf_dir)
    return ranked(retrieval.reciprocal_rank_fusion(a.unionByName(b), 5))


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    vectors = rows.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"), "label")
    return vectors, vectors.where(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), "vector", F.col("label").alias("q_label"))


_DENSE = "scored AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score, q.label AS q_label, v.label FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"


@query(f"WITH {_DENSE} {top_sql('scored', 5)}")
def dense_topk(spark, sf_dir):
    """The stated query set (identifiers divisible by 100) against all vectors."""
    vectors, asked = _vectors(spark, sf_dir)
    return ranked(retrieval.dense(vectors, asked, 5))


@query(
    """WITH m AS (SELECT a.vec_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: 0.5::DOUBLE * z[1] + 0.5::DOUBLE * z[2]) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 100 = 0),
 u AS (SELECT vec_id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 0.00000001::DOUBLE)) AS v FROM m),
 scored AS (SELECT u.vec_id AS query_id, e.vec_id AS chunk_id, list_dot_product(u.v, e.embedding::DOUBLE[]) AS score FROM u, embeddings e) """
    + top_sql("scored", 5)
)
def hyde_vector_mix(spark, sf_dir):
    vectors, asked = _vectors(spark, sf_dir)
    passages = vectors.select((F.col("chunk_id") - 1).alias("query_id"), F.col("vector").alias("passage_vector"))
    return ranked(retrieval.hyde(vectors, asked.join(passages, "query_id"), 5))


@query(f"""WITH {_DENSE}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored),
 g AS (SELECT q.vec_id AS query_id, count(*) AS n FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0 GROUP BY 1),
 h AS (SELECT query_id, count(*) FILTER (rank <= 5) AS k, min(rank) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 5), 0) AS dcg FROM t WHERE rank <= 10 AND label = q_label GROUP BY 1)
 SELECT query_id, round(coalesce(k, 0) / n, 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM g LEFT JOIN h USING (query_id)""")
def recall_mrr_ndcg(spark, sf_dir):
    vectors, asked = _vectors(spark, sf_dir)
    gold = asked.join(vectors.select("chunk_id", "label"), F.col("q_label") == F.col("label")).select("query_id", "chunk_id")
    out = metrics.retrieval_metrics(retrieval.dense(vectors, asked, 10), gold, 5)
    return out.select("query_id", r6("recall").alias("recall"), r6("mrr").alias("mrr"), r6("ndcg").alias("ndcg"))


@query(f"""WITH {bm25_sql()}, t AS (SELECT query_id, abs(chunk_id % 20 - query_id % 20) <= 1 AS hit, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 10),
 s AS (SELECT query_id, min(rank) FILTER (hit) AS first, count(*) FILTER (hit) AS n, sum(1 / log2(rank + 1)) FILTER (hit) AS dcg FROM t GROUP BY 1)
 SELECT query_id, coalesce((first <= 1)::INT::DOUBLE, 0) AS recall_1, coalesce((first <= 5)::INT::DOUBLE, 0) AS recall_5, round(coalesce(1 / first, 0), 6) AS mrr, round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM s""")
def page_window_metrics(spark, sf_dir):
    hits = retrieval.bm25(retrieval.lexical_index(_chunks(spark, sf_dir)), _items(spark, sf_dir), 10)
    hit = retrieval.signature_hit(F.col("chunk_id") % 20, F.col("query_id") % 20)
    out = metrics.window_hit_metrics(hits.select("query_id", "rank", hit.alias("hit")))
    return out.select("query_id", "recall_1", "recall_5", r6("mrr").alias("mrr"), r6("ndcg").alias("ndcg"))


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


_LABELS = "list_filter([" + ", ".join(f"CASE WHEN {_has(ws)} THEN '{n}' END" for n, ws in CORPUS_LEXICON.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH {bm25_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored QUALIFY r <= 50),
 ql AS (SELECT item_id AS query_id, {_LABELS} AS qt FROM benchmark), cl AS (SELECT doc_id AS chunk_id, {_LABELS} AS ct FROM documents),
 x AS (SELECT query_id, chunk_id, round(score + 0.5::DOUBLE * CASE WHEN len(qt) = 0 OR len(ct) = 0 THEN 0 WHEN len(list_intersect(qt, ct)) > 0 THEN 0.3::DOUBLE * len(list_intersect(qt, ct)) / len(qt) ELSE -0.2::DOUBLE END, 9) AS score, list_has_any(qt, ct) AS type_matched FROM r JOIN ql USING (query_id) JOIN cl USING (chunk_id))
 {top_sql('x', 5, 'query_id, chunk_id, type_matched')}""")
def category_rerank(spark, sf_dir):
    chunks, items = _chunks(spark, sf_dir), _items(spark, sf_dir)
    hits = retrieval.bm25(retrieval.lexical_index(chunks), items, 50)
    out = retrieval.category_rank(chunks, items, hits.withColumn("score", F.round("score", 9)), hits.limit(0), 5, lexicon=CORPUS_LEXICON)
    return ranked(out, "type_matched")


# ---- labelling ---------------------------------------------------------------------


@query(f"SELECT label, count(*) AS n FROM (SELECT unnest({_LABELS}) AS label FROM documents) GROUP BY label")
def taxonomy_match(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(lexicon.classify(F.col("text"), CORPUS_LEXICON)).alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _count_sql(words: list[str], case: bool = False) -> str:
    return "(" + " + ".join(f"contains({'text' if case else 'lower(text)'}, '{w if case else w.lower()}')::INT" for w in words) + ")"


@query(f"SELECT semantic_type, count(*) AS n FROM (SELECT CASE WHEN {_count_sql(lexicon.CONSTRAINT_WORDS, True)} >= 2 THEN 'constraint_specification' WHEN {_count_sql(lexicon.PROCEDURE_WORDS)} > {_count_sql(lexicon.GUIDELINE_WORDS)} THEN 'maintenance_procedure' ELSE 'design_guideline' END AS semantic_type FROM documents) GROUP BY 1")
def semantic_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(lexicon.semantic_type(F.col("text")).alias("semantic_type")).agg(F.count(F.lit(1)).alias("n"))


_SCORES = ", ".join(f"{{'score': {_count_sql(ws)}, 'place': {-i}, 'label': '{n}'}}" for i, (n, ws) in enumerate(CORPUS_LEXICON.items()))


@query(f"SELECT doc_id, CASE WHEN b.score > 0 THEN b.label ELSE 'Unknown' END AS label, b.score::BIGINT AS score FROM (SELECT doc_id, list_max([{_SCORES}]) AS b FROM documents)")
def max_count_classifier(spark, sf_dir):
    best = lexicon.max_count_class(F.col("text"), CORPUS_LEXICON)
    return table(spark, sf_dir, "documents").select("doc_id", best.alias("b")).select("doc_id", "b.label", F.col("b.score").cast("long").alias("score"))


_REASONS = "CASE WHEN length(text) < 40 THEN 'too_short' WHEN length(text) > 20000 THEN 'too_long' WHEN contains(lower(text), 'license') THEN 'boilerplate' WHEN regexp_matches(text, '\\d') THEN 'has_digit' ELSE 'accepted' END"


@query(f"SELECT reason, count(*) AS n FROM (SELECT {_REASONS} AS reason FROM documents) GROUP BY reason")
def reject_reasons(spark, sf_dir):
    t = F.col("text")
    rules = [("too_short", F.length(t) < 40), ("too_long", F.length(t) > 20000), ("boilerplate", F.contains(F.lower(t), F.lit("license"))), ("has_digit", F.rlike(t, F.lit(r"\d")))]
    return table(spark, sf_dir, "documents").groupBy(lexicon.first_reason(rules).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, d AS difficulty, count(*) AS n FROM (SELECT lang, CASE WHEN length(text) < 80 THEN 'easy' WHEN length(text) < 180 THEN 'medium' ELSE 'hard' END AS d FROM documents) GROUP BY ALL")
def difficulty_histogram(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", T.difficulty(F.col("text")).alias("difficulty")).agg(F.count(F.lit(1)).alias("n"))


# ---- chunking ----------------------------------------------------------------------


@query("""WITH w AS (SELECT doc_id, unnest(range(0, length(text), 462)) AS s, text FROM documents WHERE length(text) > 0),
 c AS (SELECT doc_id, s, substr(text, s + 1, 512) AS content, least(s + 512, length(text)) AS e FROM w)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS ord, s::BIGINT AS start_pos, e::BIGINT AS end_pos, md5(content) AS digest FROM c WHERE trim(content, E' \\n\\t\\r') <> ''""")
def fixed_chunks(spark, sf_dir):
    out = chunking.fixed_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query()
def recursive_chunks(spark, sf_dir):
    """A sequential fold over pieces; tested against hand-made cases."""
    return chunking.recursive_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def structured_chunks(spark, sf_dir):
    """Three layers of all documents; tested against hand-made cases."""
    return chunking.structured_chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")).drop("ord")


@query("SELECT doc_id, i::BIGINT AS place, length(b[i + 1]) AS size FROM (SELECT doc_id, b, unnest(range(0, len(b))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\\|.+\\|(?:\\n\\|.+\\|)*') AS b FROM documents))")
def table_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(chunking.TABLE), F.lit(0))).alias("place", "b"))
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), F.length("b").cast("long").alias("size"))


@query("""WITH s AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
 b AS (SELECT label, vec_id, coalesce((list_dot_product(p, v) / (sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(v, v)) + 0.00000001::DOUBLE) < 0.5::DOUBLE)::INT, 0) AS br FROM s)
 SELECT label, vec_id, sum(br) OVER (PARTITION BY label ORDER BY vec_id)::BIGINT AS segment FROM b""")
def semantic_segments(spark, sf_dir):
    """Vectors stand for the sentences of one document per label."""
    from folioforge.functions.vectors import cosine

    w = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn("p", F.lag("embedding").over(w))
    broken = F.coalesce((cosine(F.col("p"), F.col("embedding")) < 0.5).cast("int"), F.lit(0))
    return rows.select("label", "vec_id", F.sum(broken).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long").alias("segment"))


# ---- answers -----------------------------------------------------------------------


def _turns(spark, sf_dir):
    """(conv_id, turn, pred, gold): a user's text and the assistant's reply."""
    rows = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = rows.select("conv_id", "turn", "role", F.col("text").alias("pred"), F.lead("text").over(w).alias("gold"), F.lead("role").over(w).alias("next"))
    return pairs.where("role = 'user' AND next = 'assistant'").select("conv_id", "turn", "pred", "gold")


_TURNS = f"""t AS (SELECT conv_id, turn, pred, gold, list_distinct({tok('pred')}) AS p, list_distinct({tok('gold')}) AS g FROM (SELECT conv_id, turn, role, text AS pred, lead(text) OVER w AS gold, lead(role) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nxt = 'assistant'),
 m AS (SELECT *, len(list_intersect(p, g)) AS s FROM t)"""


@query(f"""WITH {_TURNS} SELECT conv_id, turn, (trim(pred) = trim(gold))::INT::DOUBLE AS em, round(CASE WHEN s = 0 THEN 0 ELSE 2::DOUBLE * s / (len(p) + len(g)) END, 6) AS pm, round(CASE WHEN len(g) = 0 THEN 0 ELSE s::DOUBLE / len(g) END, 6) AS completeness FROM m""")
def answer_match(spark, sf_dir):
    p, g = F.col("pred"), F.col("gold")
    return _turns(spark, sf_dir).select("conv_id", "turn", metrics.exact_match(p, g).alias("em"), r6(metrics.partial_match(p, g)).alias("pm"), r6(metrics.context_completeness(p, g)).alias("completeness"))


@query(f"""WITH {_TURNS}, k AS (SELECT conv_id, turn, regexp_extract_all(lower(gold), '[a-z0-9]{{2,}}') AS w2, regexp_extract_all(lower(pred), '[a-z0-9]{{3,}}') AS w3, lower(pred) AS lp, lower(gold) AS lg FROM m)
 SELECT conv_id, turn, round(CASE WHEN len(w3) = 0 THEN 0 ELSE len(list_filter(w3, lambda x: contains(lg, x)))::DOUBLE / len(w3) END, 6) AS traceability, round(CASE WHEN len(w2) = 0 THEN 1 ELSE len(list_filter(w2, lambda x: contains(lp, x)))::DOUBLE / len(w2) END, 6) AS coverage FROM k""")
def answer_support(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", r6(metrics.traceability(F.col("pred"), F.col("gold"))).alias("traceability"), r6(metrics.coverage(F.col("gold"), F.col("pred"))).alias("coverage"))


@query(f"""WITH {_TURNS} SELECT conv_id, turn, CASE WHEN len(p) = 0 OR coalesce(gold, '') = '' THEN true ELSE s::DOUBLE / len(p) < 0.3::DOUBLE END AS unsupported FROM m WHERE NOT regexp_matches(pred, '\\d+(\\.\\d+)?\\s*(mm|cm|m|kg|N|h|%|°|步|小时)')""")
def unsupported_answers(spark, sf_dir):
    rows = _turns(spark, sf_dir).where(F.size(T.number_units(F.col("pred"))) == 0)
    return rows.select("conv_id", "turn", metrics.unsupported(F.col("pred"), F.col("gold"), F.lit(False)).alias("unsupported"))


_ANSWERS = [("a1", "MTTR: 2 h is required [Source 1]", "MTTR: 2 h"), ("a2", "at least 450 mm", "no less than 500 mm"), ("a3", "at least 500 mm [Source 1]", "no less than 500 mm"), ("a4", "use the tool", "use the tool"), ("a5", "", "30 min"), ("a6", "5 kg or 7 kg", "7 kg and 9 kg")]


@query("SELECT * FROM (VALUES ('a1', 1::DOUBLE), ('a2', 0.833333::DOUBLE), ('a3', 1::DOUBLE), ('a4', 1::DOUBLE), ('a5', 0::DOUBLE), ('a6', 0.833333::DOUBLE)) t(id, tuple_f1)")
def tuple_f1(spark, sf_dir):
    """Literal answers with hand-computed scores."""
    rows = spark.createDataFrame(_ANSWERS, "id string, pred string, gold string")
    name = F.lit("Accessibility")
    rows = rows.select("id", metrics.answer_tuples(F.col("pred"), name).alias("p"), metrics.answer_tuples(F.col("gold"), name).alias("g"))
    return rows.select("id", r6(metrics.tuple_f1(F.col("p"), F.col("g"))).alias("tuple_f1"))


@query("SELECT * FROM (VALUES (0::BIGINT, 'MTTR', 2::DOUBLE, 'h', 1::DOUBLE, 1::DOUBLE, 1::DOUBLE, 1::DOUBLE, false), (1::BIGINT, 'a', 600::DOUBLE, 'mm', 0.3::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0.06::DOUBLE, true), (2::BIGINT, '50', 0::DOUBLE, 'mm', 1::DOUBLE, 0.8::DOUBLE, 1::DOUBLE, 0.9::DOUBLE, false), (3::BIGINT, '3', 0::DOUBLE, 'm', 1::DOUBLE, 0.8::DOUBLE, 1::DOUBLE, 0.9::DOUBLE, false), (4::BIGINT, '5', 0::DOUBLE, 'mm', 1::DOUBLE, 0.8::DOUBLE, 1::DOUBLE, 0.9::DOUBLE, false)) t(pos, parameter, value, unit, source_score, plausibility, consistency, confidence, is_hallucination)")
def value_verification(spark, sf_dir):
    """Extraction, tracing, plausibility, consistency and confidence on a literal answer."""
    answers = spark.createDataFrame([("q", "MTTR: 2 h; a 600 mm gap (500 mm); 30 min; width >= 50 mm")], "query_id string, answer string")
    hits = spark.createDataFrame([("q", 1, "c1", "MTTR of 2 h and 100 mm")], "query_id string, rank int, chunk_id string, content string")
    out = generation.verify_values(answers, hits)
    return out.select(F.col("pos").cast("long").alias("pos"), "parameter", "value", "unit", "source_score", "plausibility", "consistency", r6("confidence").alias("confidence"), "is_hallucination")


@query(f"""WITH {bm25_sql()}, t AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 3)
 SELECT query_id, md5(string_agg(text, E'\\n\\n---\\n\\n' ORDER BY rank)) AS answer, md5(string_agg('[Source ' || rank || '] (chunk_id: ' || chunk_id || E')\\n' || text, E'\\n\\n' ORDER BY rank)) AS context FROM t JOIN documents ON doc_id = chunk_id GROUP BY 1""")
def context_build(spark, sf_dir):
    chunks, items = _chunks(spark, sf_dir), _items(spark, sf_dir)
    hits = retrieval.bm25(retrieval.lexical_index(chunks), items, 3).join(chunks.select("chunk_id", "content"), "chunk_id").withColumn("chunk_id", F.col("chunk_id").cast("string"))
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    answers = generation.source_only(items.join(hits.select("query_id").distinct(), "query_id", "left_semi"), hits)
    return answers.join(generation.contexts(hits), "query_id").select("query_id", md5("answer").alias("answer"), md5("context").alias("context"))


@query("SELECT * FROM (VALUES ('x', [2, 1]::INT[], 'done', 4::INT), ('y', [1, 2, 3]::INT[], 'no marks', NULL::INT), ('z', [3]::INT[], 'c', 5::INT)) t(id, ranking, answer, score)")
def answer_protocols(spark, sf_dir):
    """Ranking and answer marks, and scores clipped to 1..5, on literal model outputs."""
    rows = spark.createDataFrame([("x", "RANK: 2, 1, 9, 2\nANSWER: done", "4.4"), ("y", "no marks", "n/a"), ("z", "RANK: 3\nANSWER: c", "7")], "id string, said string, score string")
    return rows.select("id", generation.parse_ranking(F.col("said"), 3).alias("ranking"), generation.after_answer(F.col("said")).alias("answer"), T.likert(F.col("score")).alias("score"))


# ---- statistics --------------------------------------------------------------------


def _scores(spark, sf_dir):
    """Per event type and user: the mean value, and that of the user's even events."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.col("user_id").alias("item")).agg(F.round(F.avg("value"), 6).alias("a"), F.round(F.avg(F.col("value") * 0.9 + F.col("event_id") % 7), 6).alias("b"))


_EV = "s AS (SELECT event_type, user_id AS item, round(avg(value), 6) AS a, round(avg(value * 0.9::DOUBLE + event_id % 7), 6) AS b FROM events GROUP BY ALL)"


@query(f"WITH {_EV} SELECT event_type, count(*) AS n, round(avg(a - b), 6) AS mean_diff, round(stddev_samp(a - b), 6) AS std_diff, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t FROM s GROUP BY 1")
def paired_t(spark, sf_dir):
    out = stats.paired_t(_scores(spark, sf_dir), ["event_type"])
    return out.select("event_type", "n", *[r6(c).alias(c) for c in ("mean_diff", "std_diff", "t")])


def _boot(seed: str, n: int) -> str:
    return f"""SELECT d.event_type, draw, avg(v) AS mean FROM (SELECT event_type, place, n, unnest(range(0, {n})) AS draw FROM p) d JOIN p ON p.event_type = d.event_type AND p.place = ('0x' || substr(md5('{seed}:' || d.draw || ':' || d.place), 1, 8))::BIGINT % d.n GROUP BY ALL"""


@query(f"""WITH {_EV}, p AS (SELECT event_type, a - b AS v, row_number() OVER (PARTITION BY event_type ORDER BY item) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM s), m AS ({_boot('p', 100)}), c AS ({_boot('ci', 100)}),
 q AS (SELECT event_type, avg((mean <= 0)::INT::DOUBLE) AS p_value FROM m GROUP BY 1), i AS (SELECT event_type, quantile_cont(mean, 0.025::DOUBLE) AS low, quantile_cont(mean, 0.975::DOUBLE) AS high FROM c GROUP BY 1), d AS (SELECT event_type, avg(v) AS mean_diff FROM p GROUP BY 1)
 SELECT event_type, round(mean_diff, 5) AS mean_diff, round(p_value, 5) AS p_value, round(low, 5) AS low, round(high, 5) AS high FROM d JOIN q USING (event_type) JOIN i USING (event_type)""")
def paired_bootstrap(spark, sf_dir):
    out = stats.paired_bootstrap(_scores(spark, sf_dir), ["event_type"], 100)
    return out.select("event_type", *[F.round(c, 5).alias(c) for c in ("mean_diff", "p_value", "low", "high")])


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5::DOUBLE), 6) AS median, round(stddev_pop(value), 6) AS stdev,
 round(avg(value) / (SELECT avg(value) FROM events WHERE event_type = (SELECT min(event_type) FROM events)), 6) AS ratio FROM events GROUP BY 1""")
def latency_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    base = rows.agg(F.min("event_type")).first()[0]
    out = stats.latency_summary(rows, ["event_type"], "value", base)
    return out.select("event_type", "n", *[r6(c).alias(c) for c in ("mean", "median", "stdev", "ratio")])


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
 e AS (SELECT event_type, sum(CASE WHEN i = lo THEN value * (1 - (pos - lo)) WHEN i = lo + 1 THEN value * (pos - lo) ELSE 0 END) AS p95 FROM (SELECT *, 0.95::DOUBLE * (n + 1) AS pos, greatest(1, least(floor(0.95::DOUBLE * (n + 1))::BIGINT, n - 1)) AS lo FROM r) GROUP BY 1)
 SELECT event_type, round(p95, 6) AS p95_exclusive, round(value, 6) AS p95_nearest FROM r JOIN e USING (event_type) WHERE i - 1 = floor(0.95::DOUBLE * (n - 1))""")
def p95_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    a = stats.quantile_exclusive(rows, ["event_type"], "value", 0.95).select("event_type", r6("quantile").alias("p95_exclusive"))
    return a.join(stats.nearest_rank(rows, ["event_type"], "value").select("event_type", r6("quantile").alias("p95_nearest")), "event_type")


_RATE = "(SELECT event_type, event_id AS item, 1 + event_id % 5 AS a, 1 + (user_id + event_id // 3) % 5 AS b FROM events)"


def _ratings(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_type", F.col("event_id").alias("item"), (1 + F.col("event_id") % 5).alias("a"), (1 + (F.col("user_id") + F.floor(F.col("event_id") / 3)) % 5).alias("b"))


@query(f"""WITH k AS (SELECT event_type, avg((a - b) * (a - b)) AS o, var_pop(a) + var_pop(b) + (avg(a) - avg(b)) ** 2 AS c, corr(a, b) AS r FROM {_RATE} GROUP BY 1), f AS (SELECT event_type, count(*) AS n, avg((a = b)::INT::DOUBLE) AS po FROM {_RATE} GROUP BY 1),
 e AS (SELECT event_type, sum((cnt / (2::DOUBLE * n)) ** 2) AS pe FROM (SELECT event_type, x, count(*) AS cnt FROM (SELECT event_type, unnest([a, b]) AS x FROM {_RATE}) GROUP BY ALL) JOIN f USING (event_type) GROUP BY 1)
 SELECT event_type, round(1 - o / c, 6) AS weighted_kappa, round(r, 6) AS pearson, round((po - pe) / (1 - pe), 6) AS fleiss FROM k JOIN f USING (event_type) JOIN e USING (event_type)""")
def rater_agreement(spark, sf_dir):
    pairs = _ratings(spark, sf_dir)
    long = pairs.select("event_type", "item", F.explode(F.array("a", "b")).alias("rating"))
    kappa = stats.weighted_kappa(pairs, ["event_type"]).select("event_type", r6("kappa").alias("weighted_kappa"))
    return kappa.join(stats.pearson(pairs, ["event_type"]).select("event_type", r6("r").alias("pearson")), "event_type").join(stats.fleiss_kappa(long, ["event_type"]).select("event_type", r6("kappa").alias("fleiss")), "event_type")


@query(f"SELECT event_type, round(corr(ra, rb), 6) AS rho FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY a, item) AS ra, row_number() OVER (PARTITION BY event_type ORDER BY b, item) AS rb FROM {_RATE}) GROUP BY 1")
def spearman(spark, sf_dir):
    return stats.spearman(_ratings(spark, sf_dir), ["event_type"]).select("event_type", r6("r").alias("rho"))


@query("""WITH g AS (SELECT unnest([lang, 'overall']) AS member, n_chars FROM documents), m AS (SELECT member, count(*) AS n, avg(n_chars) AS mean FROM g GROUP BY 1)
 SELECT member, n, round(mean, 6) AS mean, round(c.cv, 6) AS cv FROM m, (SELECT stddev_pop(mean) / avg(mean) AS cv FROM m WHERE member <> 'overall') c""")
def group_overall(spark, sf_dir):
    rows = stats.with_overall(table(spark, sf_dir, "documents"), F.array_compact(F.array("lang")))
    means = rows.groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean"))
    cv = stats.dispersion(means.where("member <> 'overall'"), "mean").select("cv")
    return means.crossJoin(F.broadcast(cv)).select("member", "n", r6("mean").alias("mean"), r6("cv").alias("cv"))


@query("""WITH l AS (SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS g, list_filter([CASE WHEN doc_id % 3 > 0 THEN 'good' END, CASE WHEN doc_id % 7 = 0 THEN 'toxic' END], lambda x: x IS NOT NULL) AS p FROM labels),
 s AS (SELECT *, CASE WHEN len(p) = 0 THEN 0 ELSE len(list_intersect(p, g))::DOUBLE / len(p) END AS pr, CASE WHEN len(g) = 0 THEN 1 ELSE len(list_intersect(p, g))::DOUBLE / len(g) END AS rc FROM l)
 SELECT doc_id, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1, (list_sort(p) = list_sort(g))::INT::DOUBLE AS exact FROM s""")
def category_prf(spark, sf_dir):
    flag = lambda c, n: F.when(c, F.lit(n))
    gold = F.array_compact(F.array(flag(F.col("quality") == 1, "good"), flag(F.col("toxic") == 1, "toxic")))
    pred = F.array_compact(F.array(flag(F.col("doc_id") % 3 > 0, "good"), flag(F.col("doc_id") % 7 == 0, "toxic")))
    rows = table(spark, sf_dir, "labels").select("doc_id", metrics.category_scores(pred, gold).alias("s"))
    return rows.select("doc_id", *[r6(F.col(f"s.{c}")).alias(c) for c in ("precision", "recall", "f1", "exact")])


@query("SELECT conv_id, turn, role, 'M' || row_number() OVER (PARTITION BY conv_id ORDER BY md5('blind:' || conv_id || ':' || role || turn), role || turn) AS method_code FROM conversations")
def blind_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("m", F.concat("role", F.col("turn").cast("string")))
    return stats.blind_labels(rows, "conv_id", "m").select("conv_id", "turn", "role", "method_code")


# ---- datasets ----------------------------------------------------------------------


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, lower(substr(text, 1, 60)) ORDER BY doc_id) = 1")
def prefix_dedup(spark, sf_dir):
    return datasets.prefix_distinct(table(spark, sf_dir, "documents"), "text", "doc_id", ["lang"]).select("doc_id")


@query("""WITH k AS (SELECT doc_id, lang, n_chars, source, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS a FROM documents), r AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY lang, a) AS c FROM k WINDOW w AS (PARTITION BY lang, a ORDER BY source, doc_id))
 SELECT doc_id, lang, c - 1 AS alias_count FROM r WHERE n = 1""")
def keep_best_dedup(spark, sf_dir):
    out = datasets.keep_best(table(spark, sf_dir, "documents"), "lang", "text", [F.col("source"), F.col("doc_id")], ["doc_id", "source"])
    return out.select("doc_id", "lang", F.col("alias_count").cast("long").alias("alias_count"))


@query("""WITH r AS (SELECT doc_id, lang, md5('42:' || doc_id) AS h, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS n FROM documents),
 z AS (SELECT *, (n > 100 // (SELECT count(DISTINCT lang) FROM documents))::INT AS late FROM r) SELECT doc_id, lang FROM z ORDER BY late, h, doc_id LIMIT 100""")
def stratified_sample(spark, sf_dir):
    return datasets.stratified_sample(table(spark, sf_dir, "documents"), "lang", "doc_id", 100).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) <= 30")
def balanced_topn(spark, sf_dir):
    return datasets.first_per_group(table(spark, sf_dir, "documents"), "lang", [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def leak_check(spark, sf_dir):
    return datasets.without_leaks(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "labels")).select("doc_id")


@query("""WITH v AS (SELECT p_partkey AS ord, p_brand AS parameter, ['mm', 'cm', 'in'][p_partkey % 3 + 1] AS unit, p_size::DOUBLE AS value, p_type AS record FROM part), b AS (SELECT *, value * CASE unit WHEN 'mm' THEN 1 / 25.4::DOUBLE WHEN 'cm' THEN 1 / 2.54::DOUBLE ELSE 1 END AS base FROM v),
 a AS (SELECT parameter, arg_min(unit, ord) AS unit, min(base) AS lo, max(base) AS hi, count(DISTINCT record) AS n_records, count(*) AS n_values FROM b WHERE base > 0 AND base < 1e7 GROUP BY 1)
 SELECT parameter, unit, n_records, n_values, round(lo / f, 6) AS lower_bound, round(hi / f, 6) AS upper_bound FROM (SELECT *, CASE unit WHEN 'mm' THEN 1 / 25.4::DOUBLE WHEN 'cm' THEN 1 / 2.54::DOUBLE ELSE 1 END AS f FROM a)""")
def range_aggregation(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    unit = F.get(F.array(F.lit("mm"), F.lit("cm"), F.lit("in")), (F.col("p_partkey") % 3).cast("int"))
    rows = part.select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("parameter"), unit.alias("unit"), F.col("p_size").cast("double").alias("value"), F.col("p_type").alias("record"), F.lit("c").alias("category"), F.lit(1).alias("page"), F.lit("").alias("quote"))
    out = datasets.range_aggregation(rows)
    return out.select("parameter", "unit", "n_records", "n_values", r6("lower_bound").alias("lower_bound"), r6("upper_bound").alias("upper_bound"))


@query("SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations")
def page_offsets(spark, sf_dir):
    """Turns stand for pages."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_num"), "text")
    return datasets.page_offsets(rows).select(F.col("doc_id").alias("conv_id"), F.col("page_num").alias("turn"), F.col("start").cast("long").alias("start"))


@query("""WITH s AS (SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations), p AS (SELECT DISTINCT conv_id, unnest([0, 250, 1000, 4000])::BIGINT AS off FROM conversations)
 SELECT p.conv_id, off, max(turn) AS turn FROM p JOIN s ON p.conv_id = s.conv_id AND s.start <= off GROUP BY ALL""")
def offset_asof_page(spark, sf_dir):
    starts = page_offsets(spark, sf_dir)
    points = starts.select("conv_id").distinct().withColumn("off", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 250, 1000, 4000)])))
    return retrieval.as_of(points, starts, "conv_id", "off", "start", "turn").select("conv_id", "off", "turn")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS head FROM conversations")
def carry_forward_headings(spark, sf_dir):
    """User turns stand for headings."""
    rows = table(spark, sf_dir, "conversations").withColumn("head", F.when(F.col("role") == "user", F.col("turn")))
    return lexicon.carry_forward(rows, ["conv_id"], ["turn"], "head").select("conv_id", "turn", "head")


@query("SELECT doc_id, f AS fraction FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS c FROM documents), (SELECT unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS f) WHERE n <= greatest(1, round_even(f * c, 0))")
def corpus_fractions(spark, sf_dir):
    return pipelines.corpus_fractions(table(spark, sf_dir, "documents").select("doc_id"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) = '' AS blank, md5(coalesce(nullif(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80), ''), 'item')) AS slug FROM documents")
def text_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", (T.normalize_answer(F.col("text")) == "").alias("blank"), F.md5(T.slug(F.col("text")).cast("binary")).alias("slug"))


@query()
def full_pipeline(spark, sf_dir):
    """The flagship composition over all documents and benchmark items, with the offline models."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    pipeline = pipelines.standard_pipelines()["full"]
    answers = pipeline.run(pipeline.ingest(docs), _items(spark, sf_dir), 5)
    return answers.select("query_id", "answer", r6("confidence").alias("confidence"), "sources")
