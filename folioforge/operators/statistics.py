"""Significance, agreement and summary statistics."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import global_rank


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def paired_t(pairs: DataFrame, group: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """n, mean and sample deviation of a - b, t, p and whether p < 0.05, per group."""
    diff = F.col(a) - F.col(b)
    rows = pairs.groupBy(*group).agg(F.count(diff).alias("n"), F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("std_diff"))
    rows = rows.withColumn("t", F.col("mean_diff") / F.nullif(F.col("std_diff") / F.sqrt("n"), F.lit(0.0)))

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(x, m - 1) if pd.notna(x) else None for x, m in zip(t, n, strict=True)], dtype="float64")

    return rows.withColumn("p_value", p_value("t", "n")).withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


#: Ranks packed into one row, rows whose values a task holds at a time, numbers worked on together, numbers drawn at a time, groups of an answer.
BLOCK, HELD, PIECE, DRAWN, BUNCH = 1 << 16, 1 << 7, 1 << 15, 1 << 21, 1000
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def _md5_codes(words: list[np.ndarray | int]) -> np.ndarray:
    """The first four bytes, as a big-endian number, of the MD5 of many padded 64-byte messages, given word by word.

    They are the first register's, which is final after step 61.
    """
    a, b, c, d = (np.full(len(words[0]), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f = np.empty_like(a)
    for i in range(61):
        part, turn = i // 16, _TURNS[i // 16][i % 4]
        if part == 0:
            at = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif part == 1:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif part == 2:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        if isinstance(words[at], int):
            a += np.uint32((_SINES[i] + words[at]) % 2**32)
        else:
            a += np.uint32(_SINES[i])
            a += words[at]
        np.left_shift(a, np.uint32(turn), out=f)
        a >>= np.uint32(32 - turn)
        a |= f
        a += b
        a, d, c, b = d, c, b, a
    return (b + np.uint32(0x67452301)).byteswap()


def _digits(numbers: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(place of the first, ASCII digits as a matrix) of the ascending numbers of each length."""
    text = numbers.astype("S20")
    size = np.char.str_len(text)
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(text)]
    return [(i, np.frombuffer(text[i:j].astype(f"S{size[i]}").tobytes(), np.uint8).reshape(-1, size[i])) for i, j in zip(cuts, cuts[1:], strict=False)]


def draw_codes(seed: str, draws: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The number in the first 8 hex digits of md5("seed:draw:slot"), a row per draw and a column per slot, both ascending."""
    head = f"{seed}:".encode()
    if len(head) + 41 > 55:  # more than one block of MD5
        code = lambda x: int.from_bytes(hashlib.md5(x, usedforsecurity=False).digest()[:4])
        return np.array([[code(head + b"%d:%d" % (d, s)) for s in slots.tolist()] for d in draws.tolist()], np.uint32)
    out = np.empty((len(draws), len(slots)), np.uint32)
    parts = _digits(draws)
    for column, last in _digits(slots):
        for row, first in parts:
            middle = len(head) + first.shape[1]
            size = middle + 1 + last.shape[1]
            n = size // 4 + 1
            left, right = np.zeros((len(first), 4 * n), np.uint8), np.zeros((len(last), 4 * n), np.uint8)
            left[:, : len(head)] = np.frombuffer(head, np.uint8)
            left[:, len(head) : middle] = first
            left[:, middle] = ord(":")
            right[:, middle + 1 : size] = last
            right[:, size] = 0x80
            left, right = left.view("<u4").T[:, :, None], np.ascontiguousarray(right.view("<u4").T)
            step = max(1, PIECE // len(last))
            for i in range(0, len(first), step):
                words = [(x[i : i + step] | y).ravel() for x, y in zip(left, right, strict=True)]
                codes = _md5_codes([*words, *[0] * (14 - n), 8 * size, 0]).reshape(-1, len(last))
                out[row + i : row + i + len(codes), column : column + len(last)] = codes
    return out


def _placed(values: DataFrame, group: list[str], value: str, key: str) -> DataFrame:
    """(group, _value, _rank): ranks from 1 over the whole table in order of group and ``key``, so a group's are consecutive."""
    rows = values.select(*group, F.col(key).alias("_key"), F.col(value).cast("double").alias("_value"))
    for c in group:
        rows = rows.where(F.col(c).isNotNull())
    return global_rank(rows, *[F.col(c) for c in group], F.col("_key"), name="_rank").drop("_key")


def _resampled(placed: DataFrame, group: list[str], resamples: int, seeds: list[str]) -> DataFrame:
    """(group, _seed, draw, mean) of bootstrap means over ``_placed`` rows.

    Draws need the groups' sizes alone, and groups have the same ones.  They are dealt out, eight shares a core,
    and made where they are used: the values go to each share, packed by the block of ranks.  A task holds
    ``HELD`` blocks at most; a group of more is drawn once for each ``HELD`` of its blocks.
    """
    sizes = placed.groupBy(*group).agg((F.min("_rank") - 1).cast("long").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 0")
    session = placed.sparkSession
    share = max(1, math.ceil(resamples * len(seeds) / (8 * session.sparkContext.defaultParallelism)))
    starts = F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(share))
    of = lambda seed: F.transform(starts, lambda at: F.struct(F.lit(seed).alias("_seed"), at.alias("_at")))
    shares = F.explode(F.flatten(F.array(*[of(seed) for seed in seeds])))

    block = lambda place: F.floor(place / BLOCK).cast("long")
    at = F.col("_rank") - 1
    packed = placed.groupBy(block(at).alias("_block")).agg(F.sort_array(F.collect_list(F.struct(at.alias("_at"), "_value"))).alias("_v")).select("_block", F.col("_v._value").alias("_values"))
    touched = F.explode(F.sequence(block(F.col("_first")), block(F.col("_first") + F.col("_n") - 1)))
    owners = sizes.select("_first", "_n", touched.alias("_block")).groupBy("_block").agg(F.collect_list("_first").alias("_firsts"), F.collect_list("_n").alias("_sizes"))
    rows = packed.join(owners, "_block").select(F.floor(F.col("_block") / HELD).cast("long").alias("_held"), "*", shares.alias("_s")).select("_held", "_s.*", "_block", "_values", "_firsts", "_sizes")

    drawn = pa.schema([("_first", pa.int64()), ("_seed", pa.string()), ("draw", pa.int32()), ("_total", pa.float64()), ("_seen", pa.int64())])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, start = key[1].as_py(), key[2].as_py()
        draws = np.arange(start, min(start + share, resamples))
        held = pa.Table.from_batches(batches).sort_by("_block")
        low = held["_block"][0].as_py() * BLOCK
        found = pa.concat_arrays([c.flatten() for c in held["_values"].chunks])
        value, there = found.fill_null(0.0).to_numpy(zero_copy_only=False), found.is_valid().to_numpy(zero_copy_only=False)
        full = found.null_count == 0
        firsts, one = np.unique(np.concatenate([c.flatten().to_numpy() for c in held["_firsts"].chunks]), return_index=True)
        counts = np.concatenate([c.flatten().to_numpy() for c in held["_sizes"].chunks])[one]
        for bunch in range(0, len(firsts), BUNCH):
            group_of = list(zip(firsts[bunch : bunch + BUNCH].tolist(), counts[bunch : bunch + BUNCH].tolist(), strict=True))
            total, seen = np.zeros((len(group_of), len(draws))), np.zeros((len(group_of), len(draws)), np.int64)
            longest = max(n for _, n in group_of)
            for slot in range(0, longest, PIECE):
                slots = np.arange(slot, min(slot + PIECE, longest))
                many = max(1, DRAWN // len(slots))
                for i in range(0, len(draws), many):
                    codes = draw_codes(seed, draws[i : i + many], slots)
                    for g, (first, n) in enumerate(group_of):
                        if n <= slot:
                            continue
                        whole = first >= low and first + n <= low + len(value)
                        mine = codes[:, : n - slot]
                        step = max(1, PIECE // mine.shape[1])
                        for j in range(0, len(mine), step):
                            part = mine[j : j + step]
                            place = (part % np.uint32(n) if n < 2**32 else part).astype(np.int64)
                            place += first - low
                            into = slice(i + j, i + j + len(part))
                            if whole:
                                total[g, into] += value.take(place).sum(axis=1)
                                seen[g, into] += part.shape[1] if full else there.take(place).sum(axis=1)
                            else:
                                inside = (place >= 0) & (place < len(value))
                                total[g, into] += np.where(inside, value.take(place, mode="clip"), 0.0).sum(axis=1)
                                seen[g, into] += (inside & there.take(place, mode="clip")).sum(axis=1)
            columns = [np.repeat([first for first, _ in group_of], len(draws)), pa.array([seed] * total.size, pa.string()), np.tile(draws.astype(np.int32), len(group_of)), total.ravel(), seen.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=drawn)

    by = ["_held", "_seed", "_at"]
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), len(seeds) * math.ceil(resamples / share))
    sums = rows.repartition(tasks, *by).groupBy(*by).applyInArrow(add, "_first long, _seed string, draw int, _total double, _seen long")
    sums = sums.groupBy("_first", "_seed", "draw").agg(F.sum("_total").alias("_total"), F.sum("_seen").alias("_seen"))
    return sums.join(sizes.select(*group, "_first"), "_first").select(*group, "_seed", "draw", F.try_divide("_total", "_seen").alias("mean"))


def resampled_means(values: DataFrame, group: list[str], resamples: int, value: str = "value", key: str = "item", seed: str = "boot") -> DataFrame:
    """(group, draw, mean) of bootstrap means by hashed draws.

    Draw j of resample b takes the row whose place in the group is md5(seed, b, j) mod n, which any SQL
    engine can repeat.  Rows without a value count as places and not in means.
    """
    return _resampled(_placed(values, group, value, key), group, resamples, [seed]).drop("_seed")


def _interval(mean: Column, level: float) -> list[Column]:
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    return [F.percentile(mean, F.lit(low)).alias("low"), F.percentile(mean, F.lit(high)).alias("high")]


def bootstrap_interval(values: DataFrame, group: list[str], resamples: int = 2000, level: float = 0.95, **names) -> DataFrame:
    """Percentile interval of the mean, linear between order statistics."""
    return resampled_means(values, group, resamples, **names).groupBy(*group).agg(*_interval(F.col("mean"), level))


def paired_bootstrap(pairs: DataFrame, group: list[str], resamples: int = 2000, a: str = "a", b: str = "b", key: str = "item") -> DataFrame:
    """One-sided p (share of resampled mean differences at or below 0) and a second resampling's interval."""
    placed = _placed(pairs.withColumn("value", F.col(a) - F.col(b)), group, "value", key)
    of = lambda seed, x: F.when(F.col("_seed") == seed, x)
    p = F.avg(of("p", (F.col("mean") <= 0).cast("double"))).alias("p_value")
    drawn = _resampled(placed, group, resamples, ["p", "ci"]).groupBy(*group).agg(p, *_interval(of("ci", F.col("mean")), 0.95))
    return placed.groupBy(*group).agg(F.avg("_value").alias("mean_diff")).join(drawn, group)


def numpy_bootstrap(values: DataFrame, group: list[str], resamples: int = 10_000, seed: int = 42, value: str = "value", key: str = "item") -> DataFrame:
    """Interval with numpy's generator, item order by ``key``; one group's scores per task."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values(key)[value].to_numpy(float)
        pick = np.random.RandomState(seed)
        means = np.array([x[pick.randint(0, len(x), len(x))].mean() for _ in range(resamples)])
        return pd.DataFrame([[*(frame[g].iloc[0] for g in group), x.mean(), *np.percentile(means, [2.5, 97.5])]], columns=[*group, "mean", "low", "high"])

    kinds = {f.name: f.dataType.simpleString() for f in values.schema}
    return values.groupBy(*group).applyInPandas(run, ", ".join(f"{g} {kinds[g]}" for g in group) + ", mean double, low double, high double")


def fleiss_kappa(ratings: DataFrame, group: list[str], categories: int = 5) -> DataFrame:
    """From (group, item, rating): items with two ratings or more; the number of raters is the first item's."""
    counts = ratings.where(F.col("rating").isNotNull()).groupBy(*group, "item").agg(F.count(F.lit(1)).alias("raters"), *[F.count(F.when(F.col("rating") == c, 1)).alias(f"c{c}") for c in range(1, categories + 1)]).where("raters >= 2")
    squares = sum((F.col(f"c{c}") * F.col(f"c{c}") for c in range(1, categories + 1)), F.lit(0))
    items = counts.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min_by("raters", "item").alias("m"), F.sum(squares).alias("squares"), *[F.sum(f"c{c}").alias(f"s{c}") for c in range(1, categories + 1)])
    observed = (F.col("squares") - F.col("n") * F.col("m")) / (F.col("n") * F.col("m") * (F.col("m") - 1))
    expected = sum(((F.col(f"s{c}") / (F.col("n") * F.col("m"))) ** 2 for c in range(1, categories + 1)), F.lit(0.0))
    rows = items.withColumn("po", observed).withColumn("pe", expected)
    return rows.select(*group, F.when(F.abs(F.col("pe") - 1) < 1e-12, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def weighted_kappa(pairs: DataFrame, group: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Quadratic weights.  Sums of squares and products replace the table of marginals: with
    quadratic weights the chance term needs only means and variances."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    rows = pairs.where(x.isNotNull() & y.isNotNull()).groupBy(*group).agg(F.avg((x - y) * (x - y)).alias("seen"), (F.var_pop(x) + F.var_pop(y) + (F.avg(x) - F.avg(y)) ** 2).alias("chance"))
    return rows.select(*group, F.when(F.col("chance") == 0, 1.0).otherwise(1 - F.col("seen") / F.col("chance")).alias("kappa"))


def pearson(pairs: DataFrame, group: list[str], a: str = "a", b: str = "b") -> DataFrame:
    value = F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
    return pairs.groupBy(*group).agg(F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0)).alias("r"))


def spearman(pairs: DataFrame, group: list[str], a: str = "a", b: str = "b", key: str = "item") -> DataFrame:
    """Pearson of ranks by position; ties keep the order of ``key`` and aren't averaged."""
    place = lambda c: F.row_number().over(Window.partitionBy(*group).orderBy(c, key))
    return pearson(pairs.withColumn("_ra", place(a)).withColumn("_rb", place(b)), group, "_ra", "_rb")


def quantile_exclusive(values: DataFrame, group: list[str], value: str, q: float) -> DataFrame:
    """Quantile at position q (n + 1), between order statistics, within the data's range."""
    w = Window.partitionBy(*group)
    rows = values.select(*group, F.col(value).cast("double").alias("v")).withColumn("i", F.row_number().over(w.orderBy("v"))).withColumn("n", F.count(F.lit(1)).over(w))
    at = q * (F.col("n") + 1)
    low = F.greatest(F.lit(1), F.least(F.floor(at), F.col("n") - 1))
    return rows.groupBy(*group).agg(F.sum(F.when(F.col("i") == low, F.col("v") * (1 - (at - low))).when(F.col("i") == low + 1, F.col("v") * (at - low)).otherwise(0.0)).alias("quantile"))


def nearest_rank(values: DataFrame, group: list[str], value: str, q: float = 0.95) -> DataFrame:
    """The value at place int(q (n - 1)), from 0."""
    w = Window.partitionBy(*group)
    rows = values.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return rows.where(F.col("_i") == F.floor(q * (F.col("_n") - 1))).select(*group, F.col(value).alias("quantile"))


def latency_summary(values: DataFrame, group: list[str], value: str, baseline: str | None = None) -> DataFrame:
    """count, mean, median, p95 (exclusive), population deviation; with ``baseline`` the ratio of means to that group's."""
    rows = values.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_pop(value).alias("stdev"))
    rows = rows.join(quantile_exclusive(values, group, value, 0.95).withColumnRenamed("quantile", "p95"), group)
    if baseline is None:
        return rows
    base = rows.where(F.col(group[0]) == baseline).select(F.col("mean").alias("base"))
    return rows.crossJoin(F.broadcast(base)).withColumn("ratio", F.col("mean") / F.col("base")).drop("base")


def dispersion(rows: DataFrame, value: str) -> DataFrame:
    """Mean, population deviation and coefficient of variation over groups."""
    return rows.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).withColumn("cv", F.col("std") / F.nullif(F.col("mean"), F.lit(0.0)))


def with_overall(rows: DataFrame, members: Column, name: str = "member") -> DataFrame:
    """A row per membership (``unspecified`` without any), and one for ``overall``."""
    of = F.when(F.coalesce(F.size(members), F.lit(0)) > 0, members).otherwise(F.array(F.lit("unspecified")))
    return rows.withColumn(name, F.explode(F.concat(of, F.array(F.lit("overall")))))


def best_config(rows: DataFrame, score: str, order: str) -> DataFrame:
    """The row with the highest score, the earlier one on ties."""
    return rows.orderBy(F.col(score).desc(), F.col(order)).limit(1)


def blind_labels(rows: DataFrame, item: str = "item_id", method: str = "method", seed: str = "blind") -> DataFrame:
    """Codes M1..Mn per item in hashed order; the mapping can be joined back by item and code."""
    w = Window.partitionBy(item).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(item).cast("string"), F.col(method)).cast("binary")), method)
    return rows.withColumn("method_code", F.concat(F.lit("M"), F.row_number().over(w).cast("string")))


def index_megabytes(n_vectors: Column, dimensions: int = 1024) -> Column:
    return n_vectors * dimensions * 4 / 1e6
