"""Registered queries of text functions, readers and sinks, drivers and answer plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import datasets, generation, lexicon, metrics, retrieval
from folioforge.operators import statistics as stats
from folioforge.plans import judging
from folioforge.queries import _TWO, _chunks, _items, _two_lists, query, r6, table, tok
from folioforge.sources import readers
from folioforge.storage import scratch_path
from folioforge.streaming import ingest


def _md5(c):
    return F.md5(F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary"))


# ---- text functions ------------------------------------------------------------------


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', E'\n\n', 'g'), '[ \t]+', ' ', 'g'), '(?m)^\s*$', '', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""")
def cleaned_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _md5(T.clean_text(F.col("text"))).alias("digest"))


@query(r"""WITH l AS (SELECT doc_id AS page_num, lines[i + 1] AS raw, i AS line_no FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
 n AS (SELECT page_num, line_no, regexp_replace(regexp_replace(translate(raw, chr(160) || '¥', ' -'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS line FROM l)
 SELECT page_num, line_no::BIGINT AS line_no, md5(line) AS digest FROM n WHERE line <> '' AND NOT regexp_matches(line, '^(?:[A-Z]-)?\d{1,4}$')""")
def page_line_digests(spark, sf_dir):
    lines = datasets.page_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_num"), "text"))
    return lines.select("page_num", F.col("line_no").cast("long").alias("line_no"), _md5("line").alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id::INT END AS page FROM documents")
def pages_of_identifiers(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "book_leaf_").otherwise("book_page_"), F.col("doc_id").cast("string")).alias("name"))
    return rows.select("doc_id", T.page_of(F.col("name")).alias("page"))


@query(r"""SELECT doc_id, md5(upper(substr(s, 1, 1)) || substr(s, 2)) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)the', '', 'g'), '(?i)und', '', 'g'), '\s{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS s FROM documents)""")
def terms_stripped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _md5(T.reveal_stripped(F.col("text"), ["the", "und"])).alias("digest"))


_TERM = r"(?m)^([一-鿿A-Za-z][^\n：:]{1,30})[：:]\s*([^\n]{10,300})$"


@query(rf"""WITH d AS (SELECT -1 AS doc_id, E'MTTR: mean time to repair an item\nshort: no\nGap: the free space between two parts' AS text UNION ALL SELECT doc_id, text FROM documents),
 f AS (SELECT doc_id, regexp_extract_all(text, '{_TERM}', 1) AS t, regexp_extract_all(text, '{_TERM}', 2) AS d FROM d)
 SELECT doc_id, i::INT AS place, trim(t[i + 1]) AS term, trim(d[i + 1]) AS definition FROM (SELECT *, unnest(range(0, len(t))) AS i FROM f)""")
def term_definitions(spark, sf_dir):
    """All documents and one literal glossary."""
    literal = spark.createDataFrame([(-1, "MTTR: mean time to repair an item\nshort: no\nGap: the free space between two parts")], "doc_id long, text string")
    return datasets.term_definitions(table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(literal), _TERM)


@query("SELECT item_id FROM benchmark WHERE NOT starts_with(item_id::VARCHAR, '1') ")
def prefix_rejected(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").withColumn("reason", lexicon.first_reason([("prefix", F.startswith(F.col("item_id").cast("string"), F.lit("1")))]))
    return rows.where("reason = 'accepted'").select("item_id")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def public_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("_status"), F.col("o_custkey").alias("_owner"))
    return judging.public_columns(rows)


# ---- readers and sinks -----------------------------------------------------------------


@query("SELECT 'h_page_' || doc_id AS doc_id, doc_id::INT AS page_num, md5(text) AS digest FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 1000")
def page_corpus_round_trip(spark, sf_dir):
    """JSON lines written and read back as a page corpus, short pages left out."""
    path = scratch_path(spark, "page-corpus")
    readers.write_json_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("int").alias("page_num"), F.lit(None).cast("string").alias("appendix"), "text"), path)
    return readers.page_corpus(spark, path, "h", 1000).select("doc_id", "page_num", _md5("text").alias("digest"))


@query("SELECT 'nation' AS folder, n_name AS content, 'txt' AS doc_type FROM nation")
def text_files_round_trip(spark, sf_dir):
    """A file per nation in nested folders, read as documents."""
    path = scratch_path(spark, "text-files")
    table(spark, sf_dir, "nation").select(F.lit("nation").alias("folder"), "n_nationkey", F.col("n_name").alias("value")).write.partitionBy("folder", "n_nationkey").option("lineSep", "\u0001").text(path)
    out = readers.text_documents(spark, path)
    return out.select(F.regexp_extract("source_path", "folder=([a-z]+)", 1).alias("folder"), F.regexp_replace("content", "\u0001$", "").alias("content"), "doc_type")


@query("SELECT item_id::VARCHAR AS id, md5(text) AS query FROM benchmark")
def qa_items_round_trip(spark, sf_dir):
    """Question sets are found under their second name."""
    path = scratch_path(spark, "qa")
    readers.write_json_lines(table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query")), f"{path}/dev_v2.jsonl")
    return readers.qa_items(spark, path, "dev").select("id", _md5("query").alias("query"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def log_appended(spark, sf_dir):
    """A log that has a third of the orders gets the others, once."""
    path = scratch_path(spark, "log")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    readers.append_new(orders.where("o_orderkey % 3 = 0"), "o_orderkey", path)
    return readers.append_new(orders, "o_orderkey", path)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def dumps_by_configuration(spark, sf_dir):
    path = scratch_path(spark, "dumps")
    readers.write_json_lines(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path, by=["o_orderstatus"])
    return readers.json_lines(spark, path, "o_orderkey long, o_orderstatus string").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id::VARCHAR AS item_id, 'M' || row_number() OVER (PARTITION BY conv_id ORDER BY md5('blind:' || conv_id || ':' || role || turn), role || turn) AS method_code, md5(text) AS answer, NULL::INT AS correctness FROM conversations""")
def forms_round_trip(spark, sf_dir):
    """Blind forms as CSV, with quotes and line breaks, read back as annotations."""
    path = scratch_path(spark, "forms")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("item_id"), F.lit("q").alias("query"), F.concat("role", F.col("turn").cast("string")).alias("method"), _md5("text").alias("answer"))
    readers.write_form(rows, path)
    return readers.annotations(spark, path).select("item_id", "method_code", "answer", "correctness")


@query("SELECT c_custkey, upper(c_name) AS answer, 'ok' AS status FROM customer")
def batched_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return readers.batched_model(rows, "c_name", lambda prompts: [p.upper() for p in prompts]).drop("c_name")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    return ingest.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", r6("total"))


# ---- metrics and drivers ---------------------------------------------------------------


@query("""SELECT l_returnflag, round(avg(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END), 6) AS rate, round(avg(CASE WHEN l_tax >= 0 THEN l_discount END), 6) AS mean FROM lineitem GROUP BY 1""")
def rates_by_flag(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag").agg(r6(metrics.rate(F.col("l_quantity") > 25)).alias("rate"), r6(metrics.mean_where_scored(F.col("l_discount"))).alias("mean"))


@query("""SELECT l_returnflag, l_linestatus, round((avg(l_discount) + avg(l_tax) + avg(l_quantity) / 50) / 3, 6) AS composite, CASE WHEN avg(l_tax) < 0.001 THEN '***' WHEN avg(l_tax) < 0.01 THEN '**' WHEN avg(l_tax) < 0.05 THEN '*' ELSE '' END AS stars, round(count(*) * 1024::DOUBLE * 4 / 1000000, 6) AS megabytes FROM lineitem GROUP BY 1, 2""")
def composites_and_stars(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"), (F.avg("l_quantity") / 50).alias("c"), F.count(F.lit(1)).alias("n"))
    return rows.select("l_returnflag", "l_linestatus", r6(metrics.composite(F.col("a"), F.col("b"), F.col("c"))).alias("composite"), metrics.stars(F.col("b")).alias("stars"), r6(stats.index_megabytes(F.col("n"))).alias("megabytes"))


_UNIT_TEXT = "CASE WHEN doc_id % 4 = 0 THEN text || ' 12 mm' ELSE text END"


@query(f"""WITH s AS (SELECT CASE WHEN regexp_matches({_UNIT_TEXT}, '\\d+(\\.\\d+)?\\s*(mm|cm|m|kg|N|h|%|°|步|小时)') THEN 'numeric' ELSE 'free_text' END AS stratum, n_chars FROM documents)
 SELECT stratum, count(*) AS n, round(avg(n_chars), 6) AS n_chars FROM (FROM s UNION ALL SELECT 'all', n_chars FROM s) GROUP BY 1""")
def stratified_means(spark, sf_dir):
    """Strata by numbers with units, and all rows."""
    rows = table(spark, sf_dir, "documents").withColumn("t", F.expr(_UNIT_TEXT))
    return judging.stratified_means(rows, judging.numeric_stratum(F.col("t")), ["n_chars"]).withColumn("n_chars", r6("n_chars"))


def _answers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("item_id"), F.concat("role", F.col("turn").cast("string")).alias("method"), F.col("role").alias("query"), F.lit("g").alias("gold"), "text", F.col("text").alias("answer"))


def _rule(shift: int):
    """A judge that scores by the prompt's length; every ninth answer can't be read."""
    size = lambda p: F.length(p) + shift

    def said(prompt):
        score = lambda n: ((size(prompt) + n) % 7).cast("string")
        read = F.concat(F.lit('```json\n{"correctness": '), score(0), F.lit(', "numeric_accuracy": "'), score(1), F.lit('", "readability": '), score(2), F.lit("}\n``` so"))
        return F.when(size(prompt) % 9 == 0, F.lit("no scores")).otherwise(read)

    return said


def _judged_sql(shift: int) -> str:
    size = f"(length('Question: ' || role || chr(10) || 'Reference answer: g' || chr(10) || 'Answer M' || r || ': ' || text || chr(10) || 'Score each aspect from 1 to 5 as JSON.') + {shift})"
    score = lambda n: f"greatest(1, least(5, ({size} + {n}) % 7))"
    return f"""SELECT conv_id AS item_id, role || turn AS method, {size} % 9 <> 0 AS read, {score(0)} AS c, ({score(0)} + {score(1)} + {score(2)}) / 3::DOUBLE AS overall
     FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY md5('blind:' || conv_id || ':' || role || turn), role || turn) AS r FROM conversations)"""


@query(f"SELECT method, count(*) FILTER (read) AS n, count(*) FILTER (NOT read) AS unread, round(avg(overall) FILTER (read), 6) AS mean FROM ({_judged_sql(0)}) GROUP BY 1")
def blind_judge(spark, sf_dir):
    """Coded per item, asked, parsed, clipped, mapped back and averaged."""
    return judging.method_means(judging.judged(_answers(spark, sf_dir), _rule(0))).withColumn("mean", r6("mean"))


@query(f"""WITH a AS ({_judged_sql(0)}), b AS ({_judged_sql(3)}), p AS (SELECT a.c AS a, b.c AS b, item_id || '|' || method AS item FROM a JOIN b USING (item_id, method) WHERE a.read AND b.read),
 m AS (SELECT count(*) AS n, avg((a - b) ** 2) AS seen FROM p), e AS (SELECT sum(x.k * y.k * (x.a - y.b) ** 2) / (SELECT n * n FROM m)::DOUBLE AS expected FROM (SELECT a, count(*) AS k FROM p GROUP BY 1) x, (SELECT b, count(*) AS k FROM p GROUP BY 1) y),
 r AS (SELECT row_number() OVER (ORDER BY a, item) AS ra, row_number() OVER (ORDER BY b, item) AS rb FROM p) SELECT round(1 - seen / expected, 6) AS kappa, (SELECT round(corr(ra, rb), 6) FROM r) AS rho FROM m, e""")
def judge_agreement(spark, sf_dir):
    """Two judges over the same answers."""
    answers = _answers(spark, sf_dir)
    out = judging.judge_agreement(judging.judged(answers, _rule(0)), judging.judged(answers, _rule(3)))
    return out.select(*[r6(c).alias(n) for c, n in zip(out.columns, ("kappa", "rho"), strict=True)])


_CALLS = "SELECT role AS method, conv_id AS query_id, length(text) AS prompt_chars, length(text) % 10 AS completion_chars FROM conversations"


@query(f"""WITH p AS (SELECT method, count(DISTINCT query_id) AS queries, count(*) / count(DISTINCT query_id)::DOUBLE AS c, sum(prompt_chars + completion_chars) / 4::DOUBLE / count(DISTINCT query_id) AS t FROM ({_CALLS}) GROUP BY 1)
 SELECT p.method, p.queries, round(p.c, 6) AS calls_per_query, round(p.t, 6) AS tokens_per_query, round(p.c / b.c, 6) AS times_calls, round(p.t / b.t, 6) AS times_tokens FROM p, p AS b WHERE b.method = 'user'""")
def call_costs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("method"), F.col("conv_id").alias("query_id"), F.length("text").alias("prompt_chars"), (F.length("text") % 10).alias("completion_chars"))
    out = judging.call_costs(rows, "user")
    return out.select("method", "queries", *[r6(c).alias(c) for c in out.columns[2:]])


@query("""SELECT 0 AS nth, '| n_nationkey | n_name | n_regionkey |' AS line UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT row_number() OVER (ORDER BY n_name) + 1, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' FROM nation""")
def report_lines(spark, sf_dir):
    return judging.report_lines(table(spark, sf_dir, "nation"), ["n_name"])


@query("SELECT 'documents' AS part, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'benchmark', count(*) FROM benchmark")
def collection_summary(spark, sf_dir):
    return judging.collection_summary({n: table(spark, sf_dir, n) for n in ("documents", "pages", "benchmark")})


# ---- answer plans ----------------------------------------------------------------------


def _hits(spark, sf_dir, k=5):
    chunks = _chunks(spark, sf_dir)
    hits = retrieval.bm25(retrieval.lexical_index(chunks).stored(), _items(spark, sf_dir), k)
    return _items(spark, sf_dir), hits.join(chunks.select("chunk_id", "content"), "chunk_id").withColumn("chunk_id", F.col("chunk_id").cast("string"))


@query(_TWO + ", u AS (SELECT query_id, chunk_id, r FROM a UNION ALL SELECT query_id, chunk_id, r FROM b), f AS (SELECT query_id, chunk_id, round(sum(1::DOUBLE / (60 + r)), 9) AS s FROM u GROUP BY ALL) SELECT query_id, string_agg(chunk_id, ',' ORDER BY s DESC, chunk_id) AS sources FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) <= 5) GROUP BY 1")
def rag_fusion_sources(spark, sf_dir):
    """The sources that fusion hands to the model."""
    texts = _chunks(spark, sf_dir).select("chunk_id", F.substring("content", 1, 50).alias("content"))
    a, b = (h.join(texts, "chunk_id").withColumn("chunk_id", F.col("chunk_id").cast("string")) for h in _two_lists(spark, sf_dir))
    return generation.rag_fusion(_items(spark, sf_dir), a, b).select("query_id", F.array_join("sources", ",").alias("sources"))


_TOP = _TWO.split(",\n scored2")[0] + ", t AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 5)"


@query(_TOP + " SELECT query_id, string_agg(chunk_id, ',' ORDER BY CASE rank WHEN 2 THEN 0 ELSE rank END) AS sources, 'fine' AS answer FROM t WHERE rank IN (1, 2) GROUP BY 1")
def ranked_answers(spark, sf_dir):
    """A model that puts the second passage first."""
    items, hits = _hits(spark, sf_dir)
    out = generation.rank_and_answer(items, hits, lambda p: F.lit("RANK: 2, 1, 2, 99\nANSWER: fine"))
    return out.select("query_id", F.array_join("sources", ",").alias("sources"), "answer")


@query(_TOP + " SELECT query_id, chunk_id::VARCHAR AS sources, round(4::DOUBLE / 5, 6) AS confidence FROM t WHERE rank = 1")
def reflected_answers(spark, sf_dir):
    """Every candidate's critique is the same, so the first hit wins."""
    items, hits = _hits(spark, sf_dir)
    out = generation.self_reflective(items, hits, lambda p: F.lit("Yes"), lambda p: F.lit("IsRel=4 IsSup=5 IsUse=3"))
    return out.select("query_id", F.array_join("sources", ",").alias("sources"), r6("confidence").alias("confidence"))


@query(f"SELECT doc_id FROM documents WHERE list_has_any({tok('text')}, ['license', 'apache'])")
def token_semi_join(spark, sf_dir):
    """Chunks that hold a query's token, by a semi-join."""
    rows = retrieval.lexical_index(_chunks(spark, sf_dir)).counted.select("chunk_id", F.explode("toks").alias("token"))
    asked = spark.createDataFrame([("license",), ("apache",)], "token string")
    return rows.join(F.broadcast(asked), "token", "left_semi").select(F.col("chunk_id").alias("doc_id")).distinct()
