"""Secret scans with corpus-wide ownership frequency.

Candidates are what the base patterns match and, beside them, every word that looks
random: 16 or more characters of the usual alphabets, letters and digits among them, with
an entropy of 3 bits a character or more.  The hash of each candidate's value is counted
over the whole corpus: in how many repositories and by how many owners it occurs.  A value
that many owners have is a widely copied example; one that few have is specific to them and
looks live.  Random-looking words that few owners have are spans of their own (kind
``owned``), as are words that hold a live base value without the words around it.

How many owners are few follows the corpus: ``owner_share`` of all owners, rounded up,
at most ``most_owners``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, hashed, join_spread, map_whole_rows, materialize, text_position, used_salts

#: The three base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones needn't be matched and dropped
#: A word with a digit; what it and its parts hold may be a secret's bare value.
WORD = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z+/_.=-]*[0-9][A-Za-z0-9+/_.=-]*")
KINDS = ("assign", "access", "hex", "owned")
#: Bare values shorter than this, or without a letter and a digit, aren't looked for.
LEAST_BARE, LEAST_RANDOM, LEAST_ENTROPY = 8, 16, 3.0


@dataclass(frozen=True)
class Ownership:
    """Where a row's repository and owner stand, and how many owners a live secret has at most.

    Without a column of that name (any case) every row is a repository and an owner of its
    own.  ``most_repositories`` can bound the repositories too.
    """

    repository: str = "doc_id"
    owner: str = "source"
    most_owners: int = 3
    owner_share: float = 0.15
    most_repositories: int | None = None


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def base_spans(text: str) -> list[tuple[int, str, int, int, int]]:
    """(start, kind, end, start of the value, end of it), by start, then kind as listed."""
    found = [(m.start(), 0, m.end(), m.start(2), m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e, vs, ve) for s, k, e, vs, ve in sorted(found)]


def looks_random(word: str) -> bool:
    if len(word) < LEAST_RANDOM:
        return False
    counts = Counter(word)
    return sum(c / len(word) * math.log2(len(word) / c) for c in counts.values()) >= LEAST_ENTROPY


def bare_values(text: str, base: list[tuple[int, str, int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, looks random) of words with letters and digits outside the base spans.

    A word counts whole, without marks at its ends, and by its parts between ``=``, ``/``
    and ``.``.  Linear in the text: words and base spans are both in order.
    """
    out, at, reach = [], 0, 0
    for m in WORD.finditer(text):
        word = m.group().strip("./=-+_")
        start = m.start() + m.group().index(word) if word else m.start()
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach > m.start() or len(word) < LEAST_BARE:
            continue
        parts = [(0, len(word))]
        if re.search(r"[=/.]", word):
            parts += [p.span() for p in re.finditer(r"[^=/.]+", word)]
        for a, b in parts:
            part = word[a:b]
            if len(part) >= LEAST_BARE and any(c.isdigit() for c in part) and any(c.isalpha() for c in part):
                # a path, address or number with marks in it is no single random word
                out.append((start + a, start + b, len(re.findall(r"[./=]", part)) <= 2 and looks_random(part)))
    return out


_FOUND = "struct<kind: string, start: int, stop: int, value_start: int, value_stop: int, hash: bigint, random: boolean>"


def scan(rows: DataFrame, text_col: str = "text", names: tuple[str, str] = ("_ff_rid", "_ff_found")) -> DataFrame:
    """``rows`` with two more columns: a unique number and what was found (base spans and bare words).

    Null text is empty.  The scan is per row; nothing is shuffled.
    """
    at = text_position(rows, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), 0
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value_start", pa.int32()), ("value_stop", pa.int32()), ("hash", pa.int64()), ("random", pa.bool_())]))
        for batch in batches:
            found = []
            for value in batch.column(at):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = [{"kind": k, "start": s, "stop": e, "value_start": vs, "value_stop": ve, "hash": _hash(text[vs:ve]), "random": False} for s, k, e, vs, ve in base]
                spans += [{"kind": "owned", "start": s, "stop": e, "value_start": s, "value_stop": e, "hash": _hash(text[s:e]), "random": r} for s, e, r in bare_values(text, base)]
                found.append(spans)
            rid = pa.array(range((task << 40) + nth, (task << 40) + nth + batch.num_rows), pa.int64())
            nth += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, rid, pa.array(found, kind)], [*batch.schema.names, *names])

    return map_whole_rows(rows, run, f"{names[0]} long, {names[1]} array<{_FOUND}>")


def _hits(scanned: DataFrame, ownership: Ownership, rid: str, found: str) -> DataFrame:
    """(rid, repo, owner, kind ...) per span found; null repository and owner count as one each."""
    known = {c.lower() for c in scanned.columns}

    def place(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name.lower() in known else F.col(rid).cast("string")

    return scanned.where(F.size(found) > 0).select(F.col(rid).alias("rid"), place(ownership.repository).alias("repo"), place(ownership.owner).alias("owner"), F.explode(found).alias("f")).select("rid", "repo", "owner", "f.*")


def ownership_verdicts(hits: DataFrame, owners: int, ownership: Ownership = Ownership()) -> DataFrame:
    """(hash, repositories, owners, base, live, salts) of every candidate value.

    Distinct (value, repository, owner) come first, combined before the shuffle, and are
    dealt by all three, so a value in a third of all rows is no single task.  ``owners``:
    how many the corpus has.
    """
    salts = used_salts(hashed("rid")).alias("salts")
    seen = hits.groupBy("hash", "repo", "owner").agg(F.max(F.col("kind") != "owned").alias("base"), F.max("random").alias("random"), salts)
    each = seen.groupBy("hash").agg(F.max("base").alias("base"), F.max("random").alias("random"), F.bit_or("salts").alias("salts"))
    wanted = each.where("base OR random").select("hash", "base", "random", "salts")
    counts = seen.select("hash", "repo").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    of = seen.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    few = max(1, min(ownership.most_owners, math.ceil(ownership.owner_share * owners)))
    live = F.col("owners") <= few
    if ownership.most_repositories is not None:
        live &= F.col("repositories") <= ownership.most_repositories
    return wanted.join(counts, "hash").join(of, "hash").withColumn("live", live)


def _judged(scanned: DataFrame, ownership: Ownership, rid: str = "_ff_rid", found: str = "_ff_found") -> DataFrame:
    """(rid, spans): every base span with its verdict, and the bare words that are live.

    A bare word inside another one that stays goes.
    """
    known = {c.lower(): c for c in scanned.columns}
    owner = known.get(ownership.owner.lower())
    # no count is needed beyond the one at which the bound is reached
    enough = math.ceil(ownership.most_owners / ownership.owner_share) if ownership.owner_share > 0 else 1
    owners = scanned.select(F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit(""))).distinct().limit(enough).count() if owner else enough
    hits = _hits(scanned, ownership, rid, found)
    verdicts = ownership_verdicts(hits, owners, ownership)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    judged = join_spread(hits.drop("random"), verdicts.drop("random"), "hash", hashed("rid")).where("kind <> 'owned' OR live")
    spans = judged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("place"), "kind", "stop", "value_start", "value_stop", "live", "owners", "repositories"))).alias("all"))
    # in order of start; a bare word lies in a longer one that starts no later, so a running reach tells
    begin = F.struct(F.lit(-1).alias("reach"), F.array().cast(spans.schema["all"].dataType).alias("out"))

    def outer(acc: Column, s: Column) -> Column:
        own = s["kind"] == "owned"
        stays = ~own | (s["stop"] > acc["reach"])
        return F.struct(F.when(own, F.greatest(acc["reach"], s["stop"])).otherwise(acc["reach"]).alias("reach"), F.when(stays, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"))

    bare = F.exists("all", lambda s: s["kind"] == "owned")
    # longest first among those that start together
    ordered = F.sort_array(F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), (-s["stop"]).alias("far"), s.alias("s"))))
    kept = F.aggregate(F.transform(ordered, lambda x: x["s"]), begin, outer, lambda acc: acc["out"])
    return spans.select("rid", F.when(bare, kept).otherwise(F.col("all")).alias("spans"))


def secret_spans(docs: DataFrame, ownership: Ownership = Ownership()) -> DataFrame:
    """Per row: doc_id, counts per kind, base_sha256, spans, verdicts and how many look live.

    A base span covers the whole match; offsets are code points.  ``verdicts`` has
    kind:start:end:owners:repositories:live or example of each span.  Rows with null text,
    identifier or owner, and repeated rows, are rows like any other; an empty table gives
    none.  Extra columns aren't read.
    """
    lower = {c.lower(): c for c in docs.columns}
    columns = dict.fromkeys(lower[c.lower()] for c in ["doc_id", "text", ownership.repository, ownership.owner] if c.lower() in lower)
    rid, found = free_names(docs, "_ff_rid", "_ff_found")
    scanned = materialize(scan(docs.select(*[F.col(f"`{c}`") for c in columns]), names=(rid, found)).drop("text"), "secret-candidates")
    rows = scanned.select(F.col("doc_id"), F.col(rid).alias("rid")).join(_judged(scanned, ownership, rid, found), "rid", "left").withColumn("spans", F.coalesce("spans", F.array()))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans, *fields):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *[f(s) for f in fields])), ",")

    place = [lambda s: s["kind"], lambda s: s["start"].cast("string"), lambda s: s["stop"].cast("string")]
    why = [lambda s: s["owners"].cast("string"), lambda s: s["repositories"].cast("string"), lambda s: F.when(s["live"], "live").otherwise("example")]
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), count("owned").alias("n_owned"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "owned"), *place), 256).alias("base_sha256"),
        joined(F.col("spans"), *place).alias("spans"), joined(F.col("spans"), *place, *why).alias("verdicts"), live.alias("n_live"), (F.size("spans").cast("long") - live).alias("n_example"),
    )


def redact_live(docs: DataFrame, ownership: Ownership = Ownership(), mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the values of live-looking secrets in ``text`` replaced by ``mark``.

    Every row stays, repeated ones too; copied examples stay as they are.  Columns may
    have any name, and owner and repository may be absent.
    """
    columns = docs.columns
    text_name = columns[text_position(docs)]
    rid, found, spans_name = free_names(docs, "_ff_rid", "_ff_found", "_ff_spans")
    scanned = materialize(scan(docs, names=(rid, found)), "scanned-documents")
    judged = _judged(scanned, ownership, rid, found).select(F.col("rid").alias(rid), F.filter("spans", lambda s: s["live"]).alias(spans_name)).where(F.size(spans_name) > 0)
    own = F.col(f"`{text_name}`")

    def cut(acc, s):
        start = F.greatest(s["value_start"], acc["at"])
        fresh = F.concat(acc["out"], F.substr(own, acc["at"] + 1, start - acc["at"]), F.lit(mark))
        return F.when(s["value_stop"] > acc["at"], F.struct(fresh.alias("out"), s["value_stop"].alias("at"))).otherwise(acc)

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    text = F.when(F.col(spans_name).isNull(), own).otherwise(F.aggregate(F.coalesce(F.col(spans_name), F.array()), begin, cut, lambda acc: F.concat(acc["out"], F.substr(own, acc["at"] + 1))))
    picked = [F.col(f"`{c}`") for c in columns]
    changed = scanned.where(F.size(found) > 0).join(judged, rid, "left").select(*[text.alias(c) if c == text_name else F.col(f"`{c}`") for c in columns])
    return scanned.where(F.size(found) == 0).select(*picked).unionByName(changed)
