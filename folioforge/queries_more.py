"""More registered queries: ranking variants, labelling, text functions, evaluation and protocols.

Same rules as in ``queries``: whole tables, doubles rounded to six places, lexicons of the
test corpus's own words; what needs headings, units or model outputs runs on literal rows
whose results were worked out by hand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import chunking, datasets, generation, lexicon, metrics, retrieval
from folioforge.operators import statistics as stats
from folioforge.plans import pipelines
from folioforge.queries import _LABELS, _TURNS, CORPUS_LEXICON, _chunks, _count_sql, _has, _items, _turns, _vectors, bm25_sql, query, r6, ranked, table, top_sql

# ---- ranking variants ----------------------------------------------------------------


@query(f"""WITH {bm25_sql()}, c AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored QUALIFY r <= 50),
 s AS (SELECT query_id, chunk_id, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM c JOIN embeddings v ON v.vec_id = chunk_id JOIN embeddings q ON q.vec_id = query_id) {top_sql('s', 5)}""")
def dense_dual_stage(spark, sf_dir):
    """Word search over all documents, then the vectors of the 50 best; ids pair texts with vectors."""
    vectors, _ = _vectors(spark, sf_dir)
    asked = _items(spark, sf_dir).join(vectors.select(F.col("chunk_id").alias("query_id"), "vector"), "query_id")
    return ranked(retrieval.dual_stage(retrieval.lexical_index(_chunks(spark, sf_dir)), vectors, asked, 5))


@query("""WITH v AS (SELECT vec_id AS query_id, 'a' AS variant, embedding FROM embeddings WHERE vec_id % 100 = 0 UNION ALL SELECT vec_id - 1, 'b', embedding FROM embeddings WHERE vec_id % 100 = 1),
 d AS (SELECT query_id, variant, e.vec_id AS chunk_id, row_number() OVER (PARTITION BY query_id, variant ORDER BY list_dot_product(v.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS r FROM v, embeddings e QUALIFY r <= 10),
 f AS (SELECT query_id, chunk_id, sum(1::DOUBLE / (60 + r)) AS score FROM d GROUP BY ALL) """ + top_sql("f", 5))
def multi_query_topk(spark, sf_dir):
    """The stated query set; each query has two variants, its own vector and its successor's."""
    vectors, _ = _vectors(spark, sf_dir)
    place = F.col("chunk_id") % 100
    variants = vectors.where(place <= 1).select((F.col("chunk_id") - place).alias("query_id"), F.when(place == 0, "a").otherwise("b").alias("variant"), "vector")
    return ranked(retrieval.multi_query(vectors, variants, 5))


@query(f"""WITH {bm25_sql()}, t AS (SELECT query_id, chunk_id FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5),
 ql AS (SELECT item_id AS query_id, {_LABELS} AS qt FROM benchmark), cl AS (SELECT doc_id AS chunk_id, {_LABELS} AS ct FROM documents)
 SELECT query_id, round(avg(list_has_any(qt, ct)::INT::DOUBLE), 6) AS type_match_accuracy FROM t JOIN ql USING (query_id) JOIN cl USING (chunk_id) GROUP BY 1""")
def type_match_accuracy(spark, sf_dir):
    chunks, items = _chunks(spark, sf_dir), _items(spark, sf_dir)
    hits = retrieval.bm25(retrieval.lexical_index(chunks), items, 5).select("query_id", "chunk_id")
    hits = hits.join(chunks.select("chunk_id", lexicon.classify(F.col("content"), CORPUS_LEXICON).alias("chunk_types")), "chunk_id")
    hits = hits.join(items.select("query_id", lexicon.classify(F.col("text"), CORPUS_LEXICON).alias("query_types")), "query_id")
    return metrics.type_match_accuracy(hits).select("query_id", r6("type_match_accuracy").alias("type_match_accuracy"))


#: Two profiles named by words of the corpus; the first emphasizes Accessibility.
_PROFILES = {"own": ("tion", {}, [1], {}), "other": ("license", {}, [10], {})}
_WORDS = {"Accessibility": ["the "], "Time Parameters": [" und "]}


@query(f"SELECT factor, count(*) AS n FROM (SELECT CASE WHEN contains(lower(text), 'license') AND NOT contains(lower(text), 'tion') THEN 0.5::DOUBLE WHEN {_has(['the '])} THEN 1.2::DOUBLE ELSE 1::DOUBLE END AS factor FROM documents) GROUP BY 1")
def equipment_factor(spark, sf_dir):
    text = F.col("text")
    factor = retrieval.equipment_factor(text, lexicon.classify(text, _WORDS), "own", _PROFILES)
    return table(spark, sf_dir, "documents").groupBy(factor.alias("factor")).agg(F.count(F.lit(1)).alias("n"))


# ---- labelling -----------------------------------------------------------------------

_CUSTOM = {"Linking": [" and ", " und ", " et "], "Place": ["with", "dans", "auf"]}
_TAX = {"License": ["license", "apache"], "Linking": [" with "]}
_NAMES = list(dict.fromkeys([*_CUSTOM, *_TAX]))
_WEIGHTS = ", ".join(f"{{'minus': -({_count_sql(_CUSTOM.get(n, [])) if n in _CUSTOM else '0'} + 2 * {_has(_TAX[n]) + '::INT' if n in _TAX else '0'}), 'place': {i}, 'label': '{n}'}}" for i, n in enumerate(_NAMES))


@query(f"""WITH r AS (SELECT doc_id, lang, list_transform(list_sort(list_filter([{_WEIGHTS}], lambda x: x.minus < 0)), lambda x: x.label) AS c FROM documents)
 SELECT doc_id, coalesce(c[1], CASE WHEN lang LIKE 'e%' THEN 'Western' END) AS label, CASE WHEN len(c) > 0 THEN 'keyword' WHEN lang LIKE 'e%' THEN 'category_prefix' ELSE 'unmapped' END AS method, array_to_string(c, ',') AS candidates FROM r""")
def weighted_classifier(spark, sf_dir):
    scored = lexicon.weighted_class(F.col("text"), F.col("lang"), _CUSTOM, _TAX, {"e": "Western"})
    rows = table(spark, sf_dir, "documents").select("doc_id", scored.alias("s"))
    return rows.select("doc_id", "s.label", "s.method", F.array_join("s.candidates", ",").alias("candidates"))


@query("SELECT label, count(*) AS n FROM (SELECT CASE WHEN lower(o_orderpriority) = '1-urgent' THEN 'Now' WHEN o_orderstatus = 'F' THEN 'Closed' WHEN contains(lower(o_orderpriority), '1-urgent') THEN 'Now' WHEN contains(lower(o_orderpriority), '-medium') THEN 'Soon' END AS label FROM orders) GROUP BY 1")
def tiered_mapping(spark, sf_dir):
    """Exact title, prefix, part of a title; here priorities and states of orders."""
    label = lexicon.tiered_class(F.col("o_orderpriority"), F.col("o_orderstatus"), {"1-URGENT": "Now", "-MEDIUM": "Soon"}, {"F": "Closed"})
    return table(spark, sf_dir, "orders").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


_RULES = {"engine": ["tion"], "naval": ["license"], "armored": [" auf "]}


@query(f"""SELECT types, count(*) AS n FROM (SELECT CASE WHEN len(f) > 0 THEN array_to_string(f, ',') ELSE 'armored,engine,naval' END AS types FROM
 (SELECT list_filter([{', '.join(f"CASE WHEN {_has(_RULES[n])} THEN '{n}' END" for n in sorted(_RULES))}], lambda x: x IS NOT NULL) AS f FROM documents)) GROUP BY 1""")
def equipment_types(spark, sf_dir):
    types = F.array_join(lexicon.equipment_types(F.col("text"), _RULES), ",")
    return table(spark, sf_dir, "documents").groupBy(types.alias("types")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('a', 'Accessibility,Time Parameters'), ('b', ''), ('c', 'Time Parameters'), ('d', 'Accessibility')) t(id, labels)")
def label_parsing(spark, sf_dir):
    """Labels of literal model outputs: fenced, missing, by part of the name, repeated."""
    rows = [("a", '```json\n["accessibility", "Time Parameters"]\n```'), ("b", "none"), ("c", 'I say ["time parameters (MTTR)", "x y z"]'), ("d", '["Accessibility", "ACCESSIBILITY"]')]
    said = spark.createDataFrame(rows, "id string, said string")
    return said.select("id", F.array_join(lexicon.parse_labels(F.col("said"), ["Accessibility", "Time Parameters"]), ",").alias("labels"))


# ---- chunks --------------------------------------------------------------------------


def _sections_sql(content: str) -> str:
    return rf"""WITH m AS (SELECT doc_id, regexp_replace(text, '(^|\n)((?:§?\d+(?:\.\d+)*|第[一二三四五六七八九十]+[章节条]|#{{1,4}})\s)', chr(1) || '\1\2', 'g') AS t FROM documents),
 p AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM m)
 SELECT doc_id, i::BIGINT AS nth, md5({content}) AS digest FROM (SELECT doc_id, parts, unnest(range(0, len(parts))) AS i FROM p)"""


def _digests(out):
    return out.select("doc_id", F.col("nth").cast("long").alias("nth"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query(_sections_sql("parts[i + 1]"))
def section_chunks(spark, sf_dir):
    """Whole sections of whole texts."""
    return _digests(chunking.section_chunks(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(_sections_sql("substr(parts[i + 1], 1, 2048)"))
def section_heads(spark, sf_dir):
    """The bounded variant: the first 2048 characters of each section are the feature."""
    return _digests(chunking.section_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), 2048))


_STANDARD = "1 Scope\nLimits are listed, see Table 3 below.\n2 Access\nThe gap ≥ 500 mm for hands.\n\nTable 3 gives limits\n|part|gap|\n|door|60|"


@query("""SELECT * FROM (VALUES ('s_L1_000', 1, NULL, 's_L1_000_L2_000', 's_L1_000_L2_000'), ('s_L1_000_L2_000', 2, 's_L1_000', '', 's_L1_000'),
 ('s_L1_001', 1, NULL, 's_L1_001_L2_000,s_L1_001_L2_001', ''), ('s_L1_001_L2_000', 2, 's_L1_001', 's_L1_001_L2_000_L3_num_00', ''), ('s_L1_001_L2_000_L3_num_00', 3, 's_L1_001_L2_000', '', ''),
 ('s_L1_001_L2_001', 2, 's_L1_001', 's_L1_001_L2_001_L3_tbl_00', ''), ('s_L1_001_L2_001_L3_tbl_00', 3, 's_L1_001_L2_001', '', '')) t(chunk_id, layer, parent_id, children, refs)""")
def standard_document(spark, sf_dir):
    """Layers, parents, children and references of a literal standard."""
    out = chunking.structured_chunks(spark.createDataFrame([("s", _STANDARD)], "doc_id string, text string"))
    return out.select("chunk_id", "layer", "parent_id", F.array_join("child_ids", ",").alias("children"), F.array_join("cross_refs", ",").alias("refs"))


# ---- text functions ------------------------------------------------------------------


@query("SELECT doc_id, md5(substr(text, greatest(p - 30, 1), p - greatest(p - 30, 1) + 37)) AS quote FROM (SELECT doc_id, text, instr(text, 'license') AS p FROM documents) WHERE p > 0")
def keyword_in_context(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.quote_around(F.col("text"), F.lit("license")).alias("q"))
    return rows.where("q IS NOT NULL").select("doc_id", F.md5(F.col("q").cast("binary")).alias("quote"))


@query("""WITH k AS (SELECT doc_id, text, substr(text, 1, 700) AS head, regexp_extract_all(text, '[A-Z]{2,}|[A-Za-z]{4,}|[一-鿿]{2,}') AS w FROM documents)
 SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:8], ' ') AS keywords, md5(CASE WHEN length(text) <= 700 THEN text WHEN contains(head, '.') THEN regexp_extract(head, '(?s)^(.*)\\.') ELSE head END) AS cut FROM k""")
def keywords_and_cuts(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.keywords(text), " ").alias("keywords"), F.md5(T.truncate_at_sentence(text).cast("binary")).alias("cut"))


_UNITS = list(lexicon.UNIT_FACTORS.items())


@query(f"""WITH u AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{u}', '{fam}', {fac!r}::DOUBLE)" for i, (u, (fam, fac)) in enumerate(_UNITS))}) t(i, unit, family, factor))
 SELECT p_partkey, unit, family, round(p_size * factor, 6) AS base FROM part JOIN u ON i = p_partkey % {len(_UNITS)}""")
def unit_convert(spark, sf_dir):
    """Sizes of parts under every known unit, in the base unit of its family."""
    unit = F.get(F.array(*[F.lit(u) for u, _ in _UNITS]), (F.col("p_partkey") % len(_UNITS)).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", unit.alias("unit"))
    return rows.select("p_partkey", "unit", datasets.unit_family(F.col("unit")).alias("family"), r6(F.col("p_size") * datasets.unit_factor(F.col("unit"))).alias("base"))


# ---- verification and evaluation -------------------------------------------------------

_NAMED = [("MTTR", "h"), ("gap", "mm"), ("fdr", "%"), ("weight", "kg"), ("lru_weight of a box", "kg"), ("nothing", "V")]
_BOUNDS_SQL = ", ".join(f"({i}, '{p}', '{u}', {lo}::DOUBLE, {hi}::DOUBLE)" for i, (p, u, lo, hi, *_) in enumerate(lexicon.BOUNDS))


@query(f"""WITH b AS (SELECT * FROM (VALUES {_BOUNDS_SQL}) t(i, name, bunit, lo, hi)), n AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{p}', '{u}')" for i, (p, u) in enumerate(_NAMED))}) t(k, parameter, unit)),
 m AS (SELECT k, parameter, arg_min({{'lo': lo, 'hi': hi}}, CASE WHEN parameter = name THEN i ELSE 1000 + i END) AS r FROM n JOIN b ON parameter = name OR (unit = bunit AND (contains(lower(parameter), lower(name)) OR contains(lower(name), lower(parameter)))) GROUP BY ALL)
 SELECT n.parameter, count(*) AS n, round(avg(CASE WHEN r IS NULL THEN 0.8::DOUBLE WHEN p_size BETWEEN r.lo AND r.hi THEN 1::DOUBLE ELSE 0::DOUBLE END), 6) AS plausibility FROM part JOIN n ON k = p_partkey % {len(_NAMED)} LEFT JOIN m USING (k) GROUP BY 1""")
def bound_plausibility(spark, sf_dir):
    """Exact-then-fuzzy lookup of bounds; sizes of parts are the values."""
    pair = F.get(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(u).alias("u")) for p, u in _NAMED]), (F.col("p_partkey") % len(_NAMED)).cast("int"))
    rows = table(spark, sf_dir, "part").select(pair["p"].alias("parameter"), pair["u"].alias("unit"), "p_size")
    rows = rows.withColumn("b", generation.matching_bound(F.col("parameter"), F.col("unit")))
    score = F.when(F.col("b").isNull(), 0.8).when(F.col("p_size").between(F.col("b.lower"), F.col("b.upper")), 1.0).otherwise(0.0)
    return rows.groupBy("parameter").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(score)).alias("plausibility"))


@query("SELECT vec_id, round(len(list_filter(list_zip(e, list_reverse(e)), lambda z: CASE WHEN z[2] = 0 THEN z[1] <> 0 ELSE abs(z[1] - z[2]) / abs(z[2]) > 0.5::DOUBLE END))::DOUBLE / len(e), 6) AS error_rate FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def numeric_error_rate(spark, sf_dir):
    """A vector's values against the same in reverse, half of a value tolerated."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.select("vec_id", r6(metrics.numeric_error_rate(F.col("e"), F.reverse("e"), 0.5)).alias("error_rate"))


_UNIT_RE = "(\\d+(?:\\.\\d+)?)\\s*(mm|cm|m|kg|N|h|%|°|步|小时)"


@query(f"""WITH {_TURNS}, n AS (SELECT conv_id, turn, gold, list_zip(regexp_extract_all(pred, '{_UNIT_RE}', 1), regexp_extract_all(pred, '{_UNIT_RE}', 2)) AS v FROM t)
 SELECT conv_id, turn, turn >= 4 OR coalesce(list_bool_or(list_transform(v, lambda z: NOT contains(coalesce(gold, ''), regexp_replace(regexp_replace(z[1]::DECIMAL(38, 12)::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')) OR NOT contains(coalesce(gold, ''), z[2]))), false) AS hallucinated FROM n""")
def hallucination_flags(spark, sf_dir):
    """Numbers or units of an answer that its support lacks, or low confidence (falling by turn)."""
    rows = _turns(spark, sf_dir).withColumn("confidence", 1 - F.col("turn") / 8)
    flag = metrics.hallucinated(F.col("pred"), F.col("gold"), F.col("confidence"))
    return rows.select("conv_id", "turn", flag.alias("hallucinated"))


_ROLE = "(SELECT conv_id AS item, role AS method, avg(length(text)) AS score FROM conversations GROUP BY ALL)"


def _by_role(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("item"), F.col("role").alias("method")).agg(F.avg(F.length("text")).alias("score"))


@query(f"""SELECT item, round("user", 6) AS user_score, round(assistant, 6) AS assistant_score FROM (SELECT item, max(score) FILTER (method = 'user') AS "user", max(score) FILTER (method = 'assistant') AS assistant FROM {_ROLE} GROUP BY 1) WHERE "user" IS NOT NULL AND assistant IS NOT NULL""")
def complete_cases(spark, sf_dir):
    """Conversations that both roles take part in; a role stands for a method."""
    out = pipelines.complete_cases(_by_role(spark, sf_dir), ["user", "assistant"])
    return out.select("item", r6("user").alias("user_score"), r6("assistant").alias("assistant_score"))


def _draws(seed: str, n: int) -> str:
    return f"""(SELECT d.method, draw, avg(v) AS mean FROM (SELECT method, place, n, unnest(range(0, {n})) AS draw FROM p) d JOIN p ON p.method = d.method AND p.place = ('0x' || substr(md5('{seed}:' || d.draw || ':' || d.place), 1, 8))::BIGINT % d.n GROUP BY ALL)"""


@query(f"""WITH p AS (SELECT a.method, a.score - b.score AS v, row_number() OVER (PARTITION BY a.method ORDER BY a.item) - 1 AS place, count(*) OVER (PARTITION BY a.method) AS n FROM {_ROLE} a JOIN {_ROLE} b ON a.item = b.item AND b.method = 'user' WHERE a.method <> 'user'),
 x AS (SELECT method, avg((mean <= 0)::INT::DOUBLE) AS p_value FROM {_draws('p', 2000)} GROUP BY 1), y AS (SELECT method, quantile_cont(mean, 0.025::DOUBLE) AS low, quantile_cont(mean, 0.975::DOUBLE) AS high FROM {_draws('ci', 2000)} GROUP BY 1), z AS (SELECT method, avg(v) AS mean_diff FROM p GROUP BY 1)
 SELECT method, round(mean_diff, 5) AS mean_diff, round(p_value, 5) AS p_value, round(low, 5) AS low, round(high, 5) AS high, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE '' END AS stars FROM x JOIN y USING (method) JOIN z USING (method)""")
def method_comparison(spark, sf_dir):
    """Every role against the user's, paired by conversation, with marks of significance."""
    out = pipelines.compare_methods(_by_role(spark, sf_dir), "user")
    return out.select("method", *[F.round(c, 5).alias(c) for c in ("mean_diff", "p_value", "low", "high")], metrics.stars(F.col("p_value")).alias("stars"))


@query("""WITH u AS (SELECT event_type AS method, user_id AS item, avg(value) AS v FROM events GROUP BY ALL), p AS (SELECT method, v, row_number() OVER (PARTITION BY method ORDER BY item) - 1 AS place, count(*) OVER (PARTITION BY method) AS n FROM u)
 SELECT method AS event_type, round(quantile_cont(mean, 0.025::DOUBLE), 5) AS low, round(quantile_cont(mean, 0.975::DOUBLE), 5) AS high FROM """ + _draws("boot", 100) + " GROUP BY 1")
def bootstrap_ci(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.col("user_id").alias("item")).agg(F.avg("value").alias("value"))
    out = stats.bootstrap_interval(rows, ["event_type"], 100)
    return out.select("event_type", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query("""WITH g AS (SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 9) AS score FROM embeddings GROUP BY 1) SELECT label, round(score, 6) AS score, round(n * 64 * 4 / 1e6::DOUBLE, 6) AS megabytes FROM g ORDER BY g.score DESC, label LIMIT 1""")
def best_configuration(spark, sf_dir):
    """The label with the highest mean first value; labels stand for settings."""
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.get("embedding", F.lit(0)).cast("double")), 9).alias("score"))
    return stats.best_config(rows, "score", "label").select("label", r6("score").alias("score"), r6(stats.index_megabytes(F.col("n"), 64)).alias("megabytes"))


@query("SELECT event_type, round(avg(CASE WHEN event_id % 5 <> 0 THEN value END), 6) AS mean_scored, round(avg((value > 10)::INT::DOUBLE), 6) AS share FROM events GROUP BY 1")
def conditional_means(spark, sf_dir):
    """Means without values marked -1, and rates of a flag."""
    value = F.when(F.col("event_id") % 5 == 0, F.lit(-1.0)).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(r6(metrics.mean_where_scored(value)).alias("mean_scored"), r6(metrics.rate(F.col("value") > 10)).alias("share"))


# ---- protocols and datasets -----------------------------------------------------------


@query("SELECT * FROM (VALUES ('q1', 'correct'), ('q2', 'ambiguous'), ('q3', 'correct'), ('q4', 'incorrect')) t(query_id, branch)")
def corrective_branches(spark, sf_dir):
    """Branches by a judge's words; "incorrect" holds "correct", and no hits mean no context."""
    asked = spark.createDataFrame([("q1", "fine"), ("q2", "maybe"), ("q3", "wrong"), ("q4", "none")], "query_id string, text string")
    hits = spark.createDataFrame([(q, 1, i, f"c{i}", "some text", 0.4) for i, q in enumerate(("q1", "q2", "q3"))], "query_id string, rank int, ord int, chunk_id string, content string, score double")
    says = lambda p: F.when(F.contains(p, F.lit("fine")), "Correct.").when(F.contains(p, F.lit("maybe")), "It is ambiguous").otherwise("Incorrect.")
    return generation.corrective(asked, hits, says).select("query_id", "branch")


@query("SELECT * FROM (VALUES ('a', 3.0::DOUBLE), ('b', 4.0::DOUBLE), ('c', 3.333333::DOUBLE)) t(id, critique)")
def critique_scores(spark, sf_dir):
    """Means of three scores in literal critiques, 3 where one is missing."""
    said = spark.createDataFrame([("a", "no scores"), ("b", "IsRel=5 IsSup = 4, IsUse=3"), ("c", "IsRel=4")], "id string, said string")
    return said.select("id", r6(generation.critique_score(F.col("said"))).alias("critique"))


@query("""WITH k AS (SELECT DISTINCT lang AS category FROM documents), s AS (SELECT unnest(range(0, 30))::VARCHAR AS scenario),
 pick AS (SELECT scenario, category, row_number() OVER (PARTITION BY scenario ORDER BY md5('7:' || scenario || ':' || category)) AS n FROM k, s QUALIFY n <= 2),
 met AS (SELECT scenario, n, category, arg_min({'id': doc_id, 'text': text}, md5('7:' || scenario || ':' || doc_id)) AS d FROM pick JOIN documents ON lang = category GROUP BY ALL),
 o AS (SELECT scenario, string_agg(d.text, ' ' ORDER BY n) AS q, string_agg(category, ',' ORDER BY category) AS gt, string_agg(d.id::VARCHAR, ',' ORDER BY n) AS ids FROM met GROUP BY 1)
 SELECT scenario, gt, ids, md5(CASE WHEN length(q) <= 700 THEN q WHEN contains(substr(q, 1, 700), '.') THEN regexp_extract(substr(q, 1, 700), '(?s)^(.*)\\.') ELSE substr(q, 1, 700) END) AS digest FROM o QUALIFY row_number() OVER (PARTITION BY gt ORDER BY scenario::INT) = 1""")
def scenario_builder(spark, sf_dir):
    """Texts of two languages glued into one question; a language stands for a category."""
    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("category"), F.col("doc_id").alias("source_id"), "text")
    out = datasets.scenarios(rows, 30, 2)
    ids = F.array_join(F.transform("sources", lambda s: s["source_id"].cast("string")), ",")
    return out.select("scenario", F.array_join("gt_categories", ",").alias("gt"), ids.alias("ids"), F.md5(F.col("query").cast("binary")).alias("digest"))


@query("SELECT doc_id, replace(['What about {}?', 'Which {} apply?'][doc_id % 2 + 1], '{}', source) AS question FROM documents")
def template_questions(spark, sf_dir):
    q = datasets.template_question(F.col("source"), F.col("doc_id"), ["What about {}?", "Which {} apply?"])
    return table(spark, sf_dir, "documents").select("doc_id", q.alias("question"))
