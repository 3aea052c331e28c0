"""Every further query gives the rows of its SQL, on the smallest tables."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__
from folioforge import queries_cases, queries_more
from folioforge.operators import chunking

SF = "/root/testdata/sf0.001"
NAMES = [n for m in (queries_more, queries_cases) for n, f in vars(m).items() if getattr(f, "__module__", "") == m.__name__ and n in __spark_entry__.oracle_sql()]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_those_of_sql(spark, sql, name):
    rows = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    wanted = sql.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, rows.select(columns).collect()))) == sorted(map(repr, wanted))


def plain_recursive(text, size=512, overlap=50):
    """Chunks of one text by a fold over pieces, written out."""

    def pieces(part, separators):
        if not separators:
            return [part]
        if separators[0] == "":
            return list(part)
        out = []
        for x in part.split(separators[0]):
            out += [x + separators[0]] if len(x) <= size else pieces(x, separators[1:])
        return out

    out, now, start = [], "", 0
    for piece in pieces(text, chunking.SEPARATORS):
        if len(now) + len(piece) > size:
            if now.strip():
                out.append((now.strip(), start, start + len(now)))
            tail = now[-overlap:] if len(now) > overlap else ""
            start += len(now) - len(tail)
            now = tail
        now += piece
    return out + ([(now.strip(), start, start + len(now))] if now.strip() else [])


def test_recursive_chunks_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = sorted((str(r["doc_id"]), r["ord"], r["content"], r["start_pos"], r["end_pos"]) for r in chunking.recursive_chunks(docs).collect())
    assert got == sorted((str(r["doc_id"]), i, *c) for r in docs.collect() for i, c in enumerate(plain_recursive(r["text"])))


def plain_layers(doc_id, text):
    """(chunk_id, layer, parent, content) of one text, layer by layer."""
    out = []
    for i, section in enumerate(x for x in (p.strip() for p in re.split(chunking.SECTION, text)) if x):
        one = f"{doc_id}_L1_{i:03d}"
        out.append((one, 1, None, section))
        for j, part in enumerate(x for x in (p.strip() for p in re.split(chunking.PARAGRAPH, section)) if x):
            if len(part) <= 512:
                packed = [(f"{one}_L2_{j:03d}", part)]
            else:
                held, now = [], ""
                for s in re.split(f"(?<=[{chunking.SENTENCE_END}])", part):
                    if len(now) + len(s) <= 512:
                        now += s
                    else:
                        held += [now] if now else []
                        now = s
                packed = [(f"{one}_L2_{j:03d}_{k:02d}", s) for k, s in enumerate(held + ([now] if now else []))]
            for two, content in packed:
                out.append((two, 2, one, content))
                for kind, pattern in (("tbl", chunking.TABLE), ("num", chunking.NUMERIC)):
                    for n, found in enumerate(m.group().strip() for m in re.finditer(pattern, content)):
                        if found and len(found) <= 256:
                            out.append((f"{two}_L3_{kind}_{n:02d}", 3, two, found))
    return out


def test_structured_chunks_of_a_whole_table(spark):
    """Every layer, parent, child list and reference, by loops; documents get rules, tables and references planted."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("CAST(doc_id AS string) AS doc_id", "text", "doc_id AS n")
    planted = "concat('1 Scope\\n', substr(text, 1, 300), '\\n2.', n % 7, ' Gaps see 3-1 and see Table 9\\nThe gap >= ', n, ' mm. ', text, '\\n\\n| a | b |\\n| 1 | 2 |\\n3 Table 3-1 and 19\\nend see §2.', n % 5, ' ok')"
    docs = docs.selectExpr("doc_id", f"IF(n % 2 = 0, {planted}, text) AS text")
    got = {r["chunk_id"]: r for r in chunking.structured_chunks(docs).collect()}
    wanted = [row for r in docs.collect() for row in plain_layers(r["doc_id"], r["text"])]
    assert len(got) == len(wanted) and len({w[0].rpartition("_L1_")[0] for w in wanted}) == 200
    children, of_doc = {}, {}
    for chunk_id, layer, parent, content in wanted:
        assert (got[chunk_id]["layer"], got[chunk_id]["parent_id"], got[chunk_id]["content"]) == (layer, parent, content)
        of_doc.setdefault(got[chunk_id]["doc_id"], []).append((got[chunk_id]["ord"], chunk_id, content))
        if parent:
            children.setdefault(parent, []).append((got[chunk_id]["ord"], chunk_id))
    found = 0
    for rows in of_doc.values():
        rows.sort()
        for _, chunk_id, content in rows:
            assert got[chunk_id]["child_ids"] == [c for _, c in sorted(children.get(chunk_id, []))]
            refs = []
            for m in re.finditer(chunking.REFERENCE.removeprefix("(?i)"), content, re.IGNORECASE):
                ref = next(g for g in m.groups() if g)
                refs += [c for _, c, text in rows if c != chunk_id and ref in text[:100]][:1]
            assert got[chunk_id]["cross_refs"] == refs
            found += len(refs)
    assert found > 100
