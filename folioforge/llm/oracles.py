"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .chat import ChatTemplate
from .quality import Risk


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chat_oracle(template: ChatTemplate = ChatTemplate()) -> str:
    """op10: digests of the turns, the template's lengths and the role machine."""
    escaped = f"replace(text, {_quoted(template.escape)}, 'xx')"
    for mark in template.control_strings():
        escaped = f"replace({escaped}, {_quoted(mark)}, 'xx')"
    marks = " ".join(f"WHEN role = {_quoted(n)} THEN {len(m.opening) + len(m.closing)}" for n, m in template.roles.items())
    name = "replace(role, 'x', 'x')"
    for mark in (template.escape, *template.control_strings()):
        name = f"replace({name}, {_quoted(mark)}, 'xx')"
    other = f"{len(template.others.opening) + len(template.others.closing) + len(template.name_end)} + length({name})"
    moves = ", ".join(_quoted(f"{a}>{b}") for a, bs in template.transitions.items() for b in bs)
    ends = ", ".join(map(_quoted, template.accepting))
    loss = ", ".join(_quoted(n) for n, m in template.roles.items() if m.loss)
    odd = "'</s>[INST] ok [/INST]'"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', {odd}), (-1, 1, 'assistant', {odd})),
 p AS (SELECT *, row_number() OVER w - 1 AS pos, lag(role, 1, 'start') OVER w AS prev FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
 c AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY pos) FILTER (role IN ({loss})), '') AS trained, sum(length({escaped}) + CASE {marks} ELSE {other} END)::BIGINT AS formatted_chars,
  min(pos) FILTER (prev || '>' || role NOT IN ({moves})) AS bad, arg_max(role, pos) AS last FROM p GROUP BY conv_id),
 f AS (SELECT *, coalesce(bad, CASE WHEN last NOT IN ({ends}) THEN n_turns END)::INT AS first_bad_turn FROM c)
 SELECT conv_id, n_turns, turns_sha256, length(trained)::BIGINT AS loss_chars, sha256(trained) AS loss_sha256, formatted_chars, first_bad_turn IS NULL AS valid, first_bad_turn FROM f"""


def quality_oracle(risk: Risk = Risk()) -> str:
    """op5: the base counts, the exact binomial tests and the verdicts."""
    grid = ", ".join(f"{round(0.02 + 0.96 * (i / (risk.cutoffs - 1)) ** 2, 6)}::DOUBLE" for i in range(risk.cutoffs))
    space = r"[\x20\x09-\x0D]+"
    return rf"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}'), lambda x: x <> '') AS words,
   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{space}', '', 'g') <> '') AS lines FROM documents),
 g AS (SELECT rid, i, list_slice(words, i + 1, i + 5) AS gram FROM (SELECT rid, words, unnest(range(0, len(words) - 4)) AS i FROM w WHERE len(words) >= 5)),
 r AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, unnest(range(0, 5)) AS k FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1) GROUP BY rid),
 b AS (SELECT doc_id, stratum, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{space}', '', 'g'))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) AS n_capitals,
   len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
 s AS (SELECT *, greatest(coalesce(n_symbols::DOUBLE / nullif(word_chars, 0), 0), coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0), coalesce(n_capitals::DOUBLE / nullif(word_chars, 0), 0), coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0)) AS badness, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
 l AS (SELECT stratum, badness, good FROM s JOIN (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1) USING (doc_id) WHERE NOT base_failed AND stratum IS NOT NULL),
 t AS (SELECT stratum, cutoff, count(*) FILTER (good) AS n, count(*) AS n_all, count(*) FILTER (good AND badness > cutoff) AS k, count(*) FILTER (NOT good AND badness > cutoff) AS caught FROM l, (SELECT unnest([{grid}]) AS cutoff) GROUP BY ALL),
 p AS (SELECT *, CASE WHEN k <= n * {risk.risk}::DOUBLE THEN least(1, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk.risk}::DOUBLE) + (n - i) * ln(1 - {risk.risk}::DOUBLE))))) ELSE 1 END AS p_value, (SELECT count(DISTINCT stratum) FROM l) AS strata FROM t),
 v AS (SELECT stratum, cutoff, caught, row_number() OVER (PARTITION BY stratum ORDER BY coalesce(caught::DOUBLE / nullif(n_all - n, 0), 0) - {risk.price}::DOUBLE * k / n DESC, cutoff DESC) AS place FROM p WHERE p_value * strata * {risk.cutoffs} <= {risk.delta}::DOUBLE)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(badness <= cutoff, true) AS kept, round(badness, 6) AS badness, cutoff FROM s LEFT JOIN (SELECT stratum, cutoff FROM v WHERE place = 1 AND caught > 0) USING (stratum)"""
