"""Exact small-sample statistics and resampling of series.

An exact test counts all ways to relabel a group's rows within its strata. A group with few ways is enumerated in
one task. One with many is met in the middle: its rows are split in two sides, every choice on either side is a row
with its sum, and both sides' sums are counted against each other range by range, so 10^11 ways need 10^6 rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.numeric import t_two_sided
from ..session import cut
from .stats import in_tied_order, mid_ranks, placed, same, welch

#: Ways of a group that one task enumerates, at most, and rows that a group's sides may have.
MOST, MOST_SUMS = 20_000, 50_000_000
#: Figures that a task holds at once while it enumerates groups of one shape, about.
AT_ONCE = 2_000_000
#: Rows of a group that are ever gathered: the sides of more would be beyond ``MOST_SUMS`` for most splits.
MOST_ROWS = 120
#: Rows of a side whose choices one row of work enumerates.
SUFFIX = 14
#: Steps of a series, at most, whose blocks are held in one row.
LONG = 100_000


class Relabelled:
    """A group's rows by stratum, and the statistic: the strata's differences of means, weighted by their sizes.

    It is linear in the rows that are chosen for group a: the sum of their ``weights`` times values, less ``middle``.
    """

    def __init__(self, strata: Sequence, in_a: Sequence, values: Sequence) -> None:
        _, at = np.unique(np.array(strata, str), return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.stratum, self.own, v = at[order], np.asarray(in_a, bool)[order], np.asarray(values, float)[order]
        self.n, self.k = np.bincount(self.stratum), np.bincount(self.stratum, self.own).astype(int)
        share, b = self.n / self.n.sum(), self.n - self.k
        self.weights = (share * self.n / (self.k * b))[self.stratum]
        self.values = v * self.weights
        self.middle = float((share / b * np.bincount(self.stratum, v)).sum())
        self.seen = float(self.values[self.own].sum()) - self.middle
        #: how much the statistic's middle falls when group a is moved down by 1; sums fall by the weights they keep
        self.fall = float((share * self.k / b).sum())
        self.slack = 1e-9 * max(1.0, abs(self.middle))
        self.span = float(np.ptp(v)) or 1.0

    def split(self) -> tuple[int, int]:
        return _split(self.n, self.k)

    def ways(self) -> float:
        return float(np.prod([float(comb(n, k)) for n, k in zip(self.n.tolist(), self.k.tolist())]))

    def sums(self, first: int, last: int, mask: int, fixed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All choices from the rows ``first`` to ``last``: how many of the stratum that the cut divides, sums, kept weights.

        The bits of ``mask`` say which of the ``fixed`` leading rows are chosen. A stratum that ends before the cut, or
        begins behind it, has its full number; behind the cut the divided one is counted by what is left before it.
        """
        here = self.stratum[first:last]
        ends = np.cumsum(self.n)
        sums, kept, count = np.zeros(1), np.zeros(1), np.zeros(1, int)
        key = np.zeros(1, int)
        for i in range(first, last):
            s = int(self.stratum[i])
            if i == first or s != here[i - 1 - first]:
                count = np.zeros(len(sums), int)
            options = (0, 1) if i - first >= fixed else (mask >> (i - first) & 1,)
            sums, kept, count, key = (np.concatenate(x) for x in zip(*((sums + o * self.values[i], kept + o * self.weights[i] * self.own[i], count + o, key) for o in options)))
            left = int(ends[s]) - 1 - i if last >= ends[s] else self.n[s]
            whole = ends[s] - self.n[s] >= first
            good = count <= self.k[s]
            if last >= ends[s] and whole:
                good &= count + left >= self.k[s]
            sums, kept, count, key = sums[good], kept[good], count[good], key[good]
            if i + 1 == last or self.stratum[i + 1] != s:
                if not whole:  # the part of the divided stratum behind the cut
                    key = self.k[s] - count
                elif last < ends[s]:
                    key = count
        return key, sums, kept


def _split(sizes: np.ndarray, chosen: np.ndarray) -> tuple[int, int]:
    """Where to cut the rows in two sides so that these have the fewest choices, and how many they have."""
    ends = np.cumsum(sizes)
    best = None
    for p in range(int(ends[-1]) + 1):
        left = right = 1
        for n, k, end in zip(sizes.tolist(), chosen.tolist(), ends.tolist()):
            m = min(max(p - (end - n), 0), n)
            counts = [(comb(m, j), comb(n - m, k - j)) for j in range(max(0, k - n + m), min(k, m) + 1)]
            left, right = left * sum(c for c, _ in counts), right * sum(c for _, c in counts)
        if best is None or left + right < best[1]:
            best = (p, left + right)
    return best


class _Assignments:
    """All ways to choose group a within each stratum, for groups of one shape with few ways: a row of ``v`` a group.

    The columns are sorted by stratum. ``n`` and ``k`` are the strata's sizes and how many are in group a, which
    come last in their stratum. The figures are those of ``Relabelled``; which rows a way keeps hangs on the shape alone.
    """

    def __init__(self, n: np.ndarray, k: np.ndarray, v: np.ndarray):
        share, b, ends = n / n.sum(), n - k, np.cumsum(n)
        weights = np.repeat(share * n / (k * b), n)
        own = np.concatenate([np.arange(x) >= x - y for x, y in zip(n.tolist(), k.tolist())])
        values = v * weights
        total = np.stack([np.add.accumulate(v[:, e - x : e], axis=1)[:, -1] for e, x in zip(ends.tolist(), n.tolist())], axis=1)
        self.middle = (share / b * total).sum(1)
        self.seen = np.ascontiguousarray(values[:, own]).sum(1) - self.middle
        self.fall = float((share * k / b).sum())
        self.slack = 1e-9 * np.maximum(1.0, np.abs(self.middle))
        self.span = np.ptp(v, axis=1)
        self.span[self.span == 0] = 1.0
        self.sums, self.kept = [], []
        for e, x, y in zip(ends.tolist(), n.tolist(), k.tolist()):
            chosen = np.array(list(combinations(range(e - x, e), y)), int)
            self.sums.append(np.ascontiguousarray(values[:, chosen]).sum(2))
            self.kept.append((weights * own)[chosen].sum(1))

    def share_as_far(self, shift: np.ndarray) -> np.ndarray:
        """The share of ways whose statistic is as far from 0 as the observed, group a moved down by ``shift``: (any, groups)."""
        middle, far = self.middle - shift * self.fall, np.abs(self.seen - shift) - self.slack
        every = [s - shift[..., None] * k for s, k in zip(self.sums, self.kept)]
        rest = np.zeros((*shift.shape, 1))
        for sums in every[:-1]:
            rest = (rest[..., :, None] + sums[..., None, :]).reshape(*shift.shape, -1)
        last, low, high = every[-1][..., None, :], (middle - far)[..., None] - rest, (middle + far)[..., None] - rest
        nearer = np.count_nonzero((last > low[..., None]) & (last < high[..., None]), axis=(-2, -1))
        ways = last.shape[-1] * rest.shape[-1]
        return (ways - nearer) / ways

    def limits(self, alpha: float, steps: int) -> np.ndarray:
        """Low and high: where P falls below ``alpha`` between the observed difference and three spans beside it; else NaN."""
        side = np.array([[-1.0], [1.0]])
        inside, outside = self.seen + 0.0 * side, self.seen + side * 3 * self.span
        reached = self.share_as_far(outside) < alpha
        for _ in range(steps if reached.any() else 0):
            at = (inside + outside) / 2
            holds = self.share_as_far(at) >= alpha
            inside, outside = np.where(holds, at, inside), np.where(holds, outside, at)
        return np.where(reached, (inside + outside) / 2, np.nan)


def _gathered(batches: Iterator[pa.RecordBatch], lists: str, least: int) -> Iterator[pa.RecordBatch]:
    """The batches, put together until their lists hold ``least`` items."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch[lists].flatten())
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _by_shape(strata: pa.Array, sides: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(groups, sizes, of them in group a) for lists that are sorted by stratum and side and divide in the same way."""
    codes = strata.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = np.zeros(len(codes), bool)
    starts[offsets[:-1]] = True
    starts[1:] |= codes[1:] != codes[:-1]
    at = np.flatnonzero(starts)
    n, k = np.diff(at, append=len(codes)), np.add.reduceat(sides.astype(np.int64), at) if len(at) else at
    first = np.searchsorted(at, offsets)
    parts = np.stack([n, k], axis=1)
    held: dict[bytes, list[int]] = {}
    for g, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        held.setdefault(parts[i:j].tobytes(), []).append(g)
    for shape, groups in held.items():
        n, k = np.frombuffer(shape, np.int64).reshape(-1, 2).T
        yield np.array(groups), n, k


def exact_permutation(df: DataFrame, by: Sequence[str], stratum: str, in_a: Column, value: str, alpha: float = 0.05, steps: int = 18, interval: bool = True, most: int = MOST) -> DataFrame:
    """Each group's difference of means, its exact stratified P, and the interval of shifts that aren't rejected.

    The difference is that of each stratum, weighted by the stratum's share of the rows; a stratum with one side only
    tells nothing and is left out, and so is a group of such strata. Null values are left out. An end of the interval
    that no shift reaches is null. P and interval are null for a group of more than ``MOST_ROWS`` rows, or whose sides
    need more than ``MOST_SUMS`` rows: ``stats.permutation`` estimates these. Groups of up to ``most`` ways are
    enumerated in a task each; how a group is counted doesn't change its figures.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(stratum).alias("_s"), in_a.alias("_a"), F.col(value).cast("double").alias("_v")).where("_a is not null")
    m = rows.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_a").alias("_k"), F.avg(F.when(F.col("_a"), F.col("_v"))).alias("_m"), F.avg(F.when(~F.col("_a"), F.col("_v"))).alias("_o"))
    m = cut(m.where("_k > 0 and _k < _n"))
    groups = m.groupBy(*by).agg(F.sum("_k").alias("na"), F.sum(F.col("_n") - F.col("_k")).alias("nb"), (F.sum(F.col("_n") * (F.col("_m") - F.col("_o"))) / F.sum("_n")).alias("difference"))
    told = groups.where(F.col("na") + F.col("nb") <= MOST_ROWS).select(*(F.col(c).alias(f"_g_{c}") for c in by), "na")
    kept = m.select(*(F.col(c).alias(f"_g_{c}") for c in by), F.col("_s").alias("_g__s"))
    rows = rows.join(kept, same([*by, "_s"], "_g_"), "left_semi").join(told, same(by, "_g_"), "left_semi")
    one = F.struct(F.coalesce(F.col("_s").cast("string"), F.lit("")).alias("s"), F.col("_a").alias("a"), F.col("_v").alias("v"))
    held = rows.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("_x"))

    def figures_of(x: pa.ListArray) -> dict[str, np.ndarray]:
        rows, offsets = x.flatten(), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        strata, sides, v = rows.field("s"), rows.field("a").to_numpy(zero_copy_only=False), rows.field("v").to_numpy(zero_copy_only=False)
        out = {c: np.full(len(x), np.nan) for c in ("ways", "sums", "p", "low", "high")}
        for all_, n, k in _by_shape(strata, sides, offsets):
            out["ways"][all_] = ways = float(np.prod([float(comb(i, j)) for i, j in zip(n.tolist(), k.tolist())]))
            out["sums"][all_] = 0.0 if ways <= most else float(_split(n, k)[1])
            if ways > most:
                continue
            few = max(1, int(AT_ONCE // (ways * n.max())))
            for at in (all_[i : i + few] for i in range(0, len(all_), few)):
                every = _Assignments(n, k, v[offsets[at][:, None] + np.arange(n.sum())])
                out["p"][at] = every.share_as_far(np.zeros(len(at)))
                if interval:
                    out["low"][at], out["high"][at] = every.limits(alpha, steps)
        return out

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Several batches together, as shapes of groups are few; rows are kept for those with too many ways."""
        for table in _gathered(batches, "_x", AT_ONCE // 4):
            out = figures_of(table["_x"])
            kept = table["_x"].take(pa.array(np.arange(len(table)), mask=out["ways"] <= most))
            yield pa.RecordBatch.from_arrays([*(table[c] for c in by), kept, *(pa.array(c, from_pandas=True) for c in out.values())], [*by, "_x", *out])

    schema = held.select("*", *(F.lit(0.0).alias(c) for c in ("ways", "sums", "p", "low", "high"))).schema
    schema = StructType([StructField(f.name, f.dataType) for f in schema])  # all may be null
    solved = cut(held.mapInArrow(solve, schema)).withColumn("_id", F.to_json(F.struct(F.lit(0).alias("_"), *by)))
    large = solved.where((F.col("ways") > most) & (F.col("sums") <= MOST_SUMS))
    figures = solved.select(*by, "_id", "p", "low", "high")
    if not large.isEmpty():
        found = _meet(large.select("_id", "_x"), alpha, steps, interval).select(F.col("_id").alias("_of"), *(F.col(c).alias(f"_{c}") for c in ("p", "low", "high")))
        figures = figures.join(found, F.col("_id") == F.col("_of"), "left").select(*by, *(F.coalesce(c, f"_{c}").alias(c) for c in ("p", "low", "high")))
    figures = figures.select(*(F.col(c).alias(f"_g_{c}") for c in by), "p", "low", "high")
    joined = groups.join(figures, same(by, "_g_"), "left")
    return joined.select(*by, "na", "nb", "difference", "p", *(["low", "high"] if interval else []))


def _meet(groups: DataFrame, alpha: float, steps: int, interval: bool) -> DataFrame:
    """(_id, p, low, high) of groups (_id, rows ``_x``): sums of both sides as rows, counted for one shift after another."""
    figures = "struct<seen double, middle double, fall double, slack double, span double, ways double, pieces array<struct<side int, first int, last int, mask long, fixed int>>>"

    @F.pandas_udf(figures)
    def plan(strata: pd.Series, sides: pd.Series, values: pd.Series) -> pd.DataFrame:
        out = []
        for s, a, v in zip(strata, sides, values):
            g = Relabelled(s, a, v)
            cut_at = g.split()[0]
            pieces = []
            for side, (first, last) in enumerate(((0, cut_at), (cut_at, len(g.stratum)))):
                fixed = max(0, last - first - SUFFIX)
                pieces += [{"side": side, "first": first, "last": last, "mask": mask, "fixed": fixed} for mask in range(1 << fixed)]
            out.append((g.seen, g.middle, g.fall, g.slack, g.span, g.ways(), pieces))
        return pd.DataFrame(out, columns=["seen", "middle", "fall", "slack", "span", "ways", "pieces"])

    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, x, piece in zip(*(batch[c].to_pylist() for c in ("_id", "_x", "_p"))):
                group = Relabelled(*([r[c] for r in x] for c in "sav"))
                key, sums, kept = group.sums(piece["first"], piece["last"], piece["mask"], piece["fixed"])
                n = len(sums)
                yield pa.RecordBatch.from_arrays([pa.array([id_] * n, pa.string()), pa.array(np.full(n, piece["side"], np.int32)), pa.array(key.astype(np.int32)), pa.array(sums), pa.array(kept)], ["_id", "side", "key", "sum", "kept"])

    planned = cut(groups.withColumn("_y", plan(F.col("_x.s"), F.col("_x.a"), F.col("_x.v"))).select("_id", "_x", "_y.*"))
    pieces = planned.select("_id", "_x", F.explode("pieces").alias("_p")).repartition(groups.sparkSession.sparkContext.defaultParallelism * 4, "_id", "_p")
    sums = cut(pieces.mapInArrow(enumerate_, "_id string, side int, key int, sum double, kept double"))
    figures = planned.drop("_x", "pieces")

    def share(points: DataFrame) -> DataFrame:
        """P for each (_id, point, shift): what of both sides lies beyond the observed difference, either way."""
        asked = points.join(figures, "_id")
        moved = sums.join(asked.select("_id", "point", "shift", (F.col("middle") - F.col("shift") * F.col("fall")).alias("_c"), (F.abs(F.col("seen") - F.col("shift")) - F.col("slack")).alias("_far")), "_id")
        at = F.col("sum") - F.col("shift") * F.col("kept")
        # 1: a sum of the first side; 0 and 2: bounds from the second, before and after equal sums
        lines = F.when(F.col("side") == 0, F.array(F.struct(at.alias("at"), F.lit(1).alias("kind")))).otherwise(F.array(F.struct((F.col("_c") + F.col("_far") - at).alias("at"), F.lit(0).alias("kind")), F.struct((F.col("_c") - F.col("_far") - at).alias("at"), F.lit(2).alias("kind"))))
        laid = moved.select("_id", "point", "key", F.explode(lines).alias("_l")).select("_id", "point", "key", "_l.at", "_l.kind")
        counted = in_tied_order(laid, ["_id", "point", "key"], ["at", "kind"], F.col("kind") == 1)
        per = counted.groupBy("_id", "point", "key").agg(F.sum(F.when(F.col("kind") == 0, F.col("_all") - F.col("_upto"))).alias("_above"), F.sum(F.when(F.col("kind") == 2, F.col("_upto"))).alias("_below"))
        all_ = per.groupBy("_id", "point").agg((F.sum("_above") + F.sum("_below")).cast("double").alias("_n"))
        return asked.join(all_, ["_id", "point"], "left").select("_id", "point", "shift", F.least(F.coalesce("_n", F.lit(0.0)) / F.col("ways"), F.lit(1.0)).alias("p"))

    observed = share(figures.select("_id", F.lit(0).alias("point"), F.lit(0.0).alias("shift"))).select("_id", "p")
    if not interval:
        return observed.select("_id", "p", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    sides = F.explode(F.array(F.lit(-1), F.lit(1)))
    ends = figures.select("_id", sides.alias("point"), F.col("seen").alias("inside"), "seen", "span").withColumn("outside", F.col("seen") + F.col("point") * 3 * F.col("span"))
    reached = share(ends.select("_id", "point", F.col("outside").alias("shift"))).where(F.col("p") < alpha).select("_id", "point")
    ends = cut(ends.select("_id", "point", "inside", "outside").join(reached, ["_id", "point"]))
    for _ in range(steps):
        p = share(ends.select("_id", "point", ((F.col("inside") + F.col("outside")) / 2).alias("shift"))).select("_id", "point", "shift", "p")
        holds = F.col("p") >= alpha
        ends = cut(ends.join(p, ["_id", "point"]).select("_id", "point", F.when(holds, F.col("shift")).otherwise(F.col("inside")).alias("inside"), F.when(holds, F.col("outside")).otherwise(F.col("shift")).alias("outside")))
    end = lambda point: F.max(F.when(F.col("point") == point, (F.col("inside") + F.col("outside")) / 2))
    return observed.join(ends.groupBy("_id").agg(end(-1).alias("low"), end(1).alias("high")), "_id", "left")


def _u_counts(na: int, nb: int) -> np.ndarray:
    """How many orders of na and nb distinct values give each U, as shares: one value more at a time."""
    ways = np.zeros((nb + 1, na * nb + 1))
    ways[:, 0] = 1.0
    for a in range(1, na + 1):
        new = np.zeros_like(ways)
        new[0, 0] = 1.0
        for b in range(1, nb + 1):
            # the largest value is from b, or from a and then above all b
            new[b] = new[b - 1]
            new[b, b:] += ways[b, : na * nb + 1 - b]
        ways = new
    return ways[nb] / comb(na + nb, na)


def exact_u(ranked: DataFrame, u: str, na: str, nb: str, most: int = 400) -> DataFrame:
    """A column ``p``: the exact two-sided P of Mann-Whitney's U without ties; null if na * nb is above ``most``."""

    @F.pandas_udf("double")
    def p(us: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[int, int], np.ndarray] = {}
        out = []
        for x, i, j in zip(us, a, b):
            if x is None or x != x or not i or not j or i * j > most:
                out.append(None)
                continue
            shares = known.setdefault((i, j), _u_counts(int(i), int(j)))
            low = min(x, i * j - x)
            out.append(min(1.0, 2 * float(shares[: int(np.floor(low)) + 1].sum())))
        return pd.Series(out, dtype="float64")

    return ranked.withColumn("p", p(F.col(u).cast("double"), F.col(na), F.col(nb)))


def exact_rank_sum(df: DataFrame, by: Sequence[str], in_a: Column, value: str) -> DataFrame:
    """The exact two-sided P of the rank sum of the rows in a, ties and all: mid-ranks are relabelled.

    ``difference`` is that of mean ranks; ``p`` the share of ways in which it is as far from 0. Without ties that is
    the P of ``exact_u``. Bounds and null P are those of ``exact_permutation``; null values are left out.
    """
    ranked = mid_ranks(df.where(F.col(value).isNotNull() & in_a.isNotNull()).withColumn("_side", in_a), by, value, "_rank").select(*by, "_side", "_rank")
    ranked = cut(ranked).withColumn("_whole", F.lit(""))  # read for its strata and as rows
    return exact_permutation(ranked, by, "_whole", F.col("_side"), "_rank", interval=False)


def welch_interval(df: DataFrame, by: Sequence[str], in_a: Column, in_b: Column, value: str, level: float = 0.95) -> DataFrame:
    """Welch's t with P and the interval of the difference of means."""
    t = welch(df, by, in_a, in_b, value)

    @F.pandas_udf("struct<p double, margin double>")
    def tails(d: pd.Series, s: pd.Series, f: pd.Series) -> pd.DataFrame:
        out = []
        for diff, stat, free in zip(d.astype(float), s.astype(float), f.astype(float)):
            if not np.isfinite([diff, stat, free]).all() or not stat:
                out.append((None, None))
                continue
            low, high = 0.0, 1e6
            for _ in range(200):  # the quantile of t, by bisection
                at = (low + high) / 2
                low, high = (at, high) if t_two_sided(at, free) > 1 - level else (low, at)
            out.append((t_two_sided(stat, free), high * abs(diff / stat)))
        return pd.DataFrame(out, columns=["p", "margin"], dtype="float64")

    rows = t.withColumn("_x", tails("difference", "t", "df"))
    return rows.select(*t.columns, F.col("_x.p").alias("p"), (F.col("difference") - F.col("_x.margin")).alias("low"), (F.col("difference") + F.col("_x.margin")).alias("high"))


def pairwise_welch(df: DataFrame, by: Sequence[str], group: str, names: Sequence[str], value: str) -> DataFrame:
    """Welch's t between each two named groups, from one pass of moments, and which groups stand out.

    ``highest`` or ``lowest`` names the group whose mean is above or below both others, where there are three.
    """
    of = lambda name: F.when(F.col(group) == name, F.col(value))
    m = df.where(F.col(group).isin(*names)).groupBy(*by).agg(F.array(*(F.struct(F.lit(n).alias("name"), F.avg(of(n)).alias("m"), F.try_divide(F.var_samp(of(n)), F.count(of(n))).alias("e"), F.count(of(n)).alias("n")) for n in names)).alias("_g"))
    order = lambda sign: F.array_min(F.transform("_g", lambda g: F.struct((sign * g["m"]).alias("m"), g["name"].alias("name"))))["name"]
    m = m.withColumn("lowest", order(1)).withColumn("highest", order(-1))
    pairs = F.array(*(F.struct(F.get("_g", F.lit(i)).alias("a"), F.get("_g", F.lit(j)).alias("b")) for i in range(len(names)) for j in range(i + 1, len(names))))
    rows = m.select(*by, "lowest", "highest", F.explode(pairs).alias("_p"))
    a, b = (lambda c: F.col(f"_p.a.{c}")), (lambda c: F.col(f"_p.b.{c}"))
    spread = a("e") + b("e")
    free = F.try_divide(spread * spread, F.try_divide(a("e") * a("e"), a("n") - 1) + F.try_divide(b("e") * b("e"), b("n") - 1))
    return rows.select(*by, a("name").alias("one"), b("name").alias("other"), F.try_divide(a("m") - b("m"), F.sqrt(spread)).alias("t"), free.alias("df"), "lowest", "highest")


def wilcoxon_markers(x: DataFrame, labels: DataFrame, row: str, feature: str, value: str, label: str) -> DataFrame:
    """Rank-sum z of each label against the others for each feature, the values that are left out being 0.

    Zeros of a feature are one tie below its positive values, and only their number is needed; so ranks
    are taken over the values that are there.
    """
    total = labels.agg(F.count(F.lit(1)).alias("_rows"))
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("_na"))
    held = x.where(F.col(value) > 0).join(labels.select(row, label), row)
    counts = placed(held, [feature], value)
    ties = counts.select(F.col(feature).alias(f"_of_{feature}"), F.col(value).alias(f"_of_{value}"), (F.col("_before") + (F.col("_n") + 1) / 2.0).alias("_r"), (F.col("_n") * F.col("_n") - 1.0).alias("_t"))
    ranked = held.join(ties, same([feature, value], "_of_"))
    per = ranked.groupBy(feature).agg(F.count(F.lit(1)).alias("_pos"), F.sum("_t").alias("_ties"))
    own = ranked.groupBy(feature, label).agg(F.sum("_r").alias("_sum"), F.count(F.lit(1)).alias("_own"))
    grid = per.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(total))  # labels times features: the result's own size
    full = grid.join(own, [feature, label], "left")
    n, na, zeros = F.col("_rows"), F.col("_na"), F.col("_rows") - F.col("_pos")
    own_sum = F.coalesce(F.col("_sum") + F.col("_own") * zeros, F.lit(0.0)) + (na - F.coalesce("_own", F.lit(0))) * (zeros + 1) / 2.0
    spread = na * (n - na) / 12.0 * ((n + 1) - (F.col("_ties") + zeros * (zeros * zeros - 1.0)) / (n * (n - 1)))
    z = F.try_divide(own_sum - na * (n + 1) / 2.0, F.sqrt(spread))
    return full.select(feature, label, z.alias("z"))


def cluster_bootstrap(df: DataFrame, unit: str, place: str, value: str, repeats: int, seed: int = 7) -> DataFrame:
    """Percentile band of the mean at each place when whole units are drawn anew.

    A unit's weight in a repeat is Poisson, seeded by its id, so all its rows go together. Rows are
    first summed by unit and place.
    """
    u = F.pmod(F.xxhash64(F.col(unit), F.col("rep"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    cuts = np.cumsum([np.exp(-1.0) / np.prod(range(1, k + 1)) for k in range(8)])
    weight = sum(((u >= float(c)).cast("int") for c in cuts), F.lit(0))
    sums = df.where(F.col(value).isNotNull()).groupBy(unit, place).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    drawn = sums.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("_w", weight).where("_w > 0")
    means = drawn.groupBy(place, "rep").agg((F.sum(F.col("_w") * F.col("_s")) / F.sum(F.col("_w") * F.col("_n"))).alias("_m"))
    return means.groupBy(place).agg(F.percentile("_m", 0.025).alias("low"), F.percentile("_m", 0.975).alias("high"))


def ramp_fit(df: DataFrame, by: Sequence[str], t: str, y: str, bins: int = 24, least: int = 2) -> DataFrame:
    """The ramp (flat, straight, flat) of least squared error over all onsets and offsets on a grid of ``bins`` steps.

    A series is first summed by step, so the search needs a few sums of each step however long the
    series is: the errors of the level parts and of the line between come from prefix sums.
    """
    span = df.where(F.col(t).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi")).where("_hi > _lo")
    rows = df.where(F.col(t).isNotNull() & F.col(y).isNotNull()).join(span, list(by))
    at = F.least(F.floor((F.col(t) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))), F.lit(bins - 1)).cast("int")
    x, v = F.col(t).cast("double") - F.col("_lo"), F.col(y).cast("double")
    steps = rows.withColumn("_b", at).groupBy(*by, "_b").agg(F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.count(F.lit(1)).alias("_n"), F.sum(x).alias("_x"), F.sum(v).alias("_v"), F.sum(x * x).alias("_xx"), F.sum(x * v).alias("_xv"), F.sum(v * v).alias("_vv"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "onset double, offset double, low double, high double, sse double"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((6, bins))
        m[:, pdf["_b"].to_numpy()] = pdf[["_n", "_x", "_v", "_xx", "_xv", "_vv"]].to_numpy(float).T
        sums = np.concatenate([np.zeros((6, 1)), np.cumsum(m, axis=1)], axis=1)
        lo, width = float(pdf["_lo"].iloc[0]), (float(pdf["_hi"].iloc[0]) - float(pdf["_lo"].iloc[0])) / bins
        best = None
        for i in range(0, bins - least + 1):
            for j in range(i + least, bins + 1):
                a, b = i * width, j * width
                left, mid, right = sums[:, i], sums[:, j] - sums[:, i], sums[:, bins] - sums[:, j]
                # y = p (1 - s) + q s with s = (x - a) / (b - a) between, 0 before and 1 after
                s1 = (mid[1] - a * mid[0]) / (b - a)
                s2 = (mid[3] - 2 * a * mid[1] + a * a * mid[0]) / (b - a) ** 2
                sv = (mid[4] - a * mid[2]) / (b - a)
                pp, pq, qq = left[0] + mid[0] - 2 * s1 + s2, s1 - s2, s2 + right[0]
                pv, qv = left[2] + mid[2] - sv, sv + right[2]
                det = pp * qq - pq * pq
                if det <= 1e-12 * max(1.0, pp * qq):
                    continue
                p, q = (qq * pv - pq * qv) / det, (pp * qv - pq * pv) / det
                sse = sums[5, bins] - p * pv - q * qv
                if best is None or sse < best[4] - 1e-9 * max(1.0, abs(best[4])):
                    best = (lo + a, lo + b, p, q, sse)
        if best is None:
            return pd.DataFrame(columns=[*by, "onset", "offset", "low", "high", "sse"])
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, **dict(zip(["onset", "offset", "low", "high", "sse"], best))}])

    return steps.groupBy(*by).applyInPandas(solve, schema)


def block_bootstrap(df: DataFrame, by: Sequence[str], t: str, y: str, length: int, repeats: int, seed: int = 7) -> DataFrame:
    """Observed net rise of each series, and its P among series put together from blocks of neighbouring steps.

    A null series takes its steps from blocks of ``length`` neighbours whose starts are drawn by hash, as
    many as the series has. Blocks come from running sums; only a series of more than ``LONG`` steps has its draws as rows.
    """
    w = Window.partitionBy(*by).orderBy(t)
    rows = df.where(F.col(y).isNotNull()).dropna(subset=list(by)).select(*by, t, (F.col(y) - F.lag(y).over(w)).cast("double").alias("_d")).where("_d is not null")
    k = F.row_number().over(w)
    ahead, all_ = w.rowsBetween(0, length - 1), Window.partitionBy(*by)
    steps = rows.select(*by, k.alias("_k"), F.sum("_d").over(ahead).alias("_block"), F.count(F.lit(1)).over(ahead).alias("_full"), F.sum("_d").over(all_).alias("observed"), F.count(F.lit(1)).over(all_).alias("_n"))
    # blocks of a null series have the series' mean step taken out
    blocks = cut(steps.where(F.col("_full") == length).select(*by, "_k", (F.col("_block") - length * F.col("observed") / F.col("_n")).alias("_block"), "observed", "_n"))
    reps, draws = F.sequence(F.lit(1), F.lit(repeats)), F.sequence(F.lit(1), F.ceil(F.col("_n") / length).cast("int"))
    start = lambda rep, j: (F.pmod(F.xxhash64(*by, rep, j, F.lit(seed)), F.col("_n") - length + 1) + 1).cast("int")
    far = lambda net: F.abs(net) >= F.abs("observed")
    # a series' blocks are an array, in which its draws are looked up; those of a long one are rows to be joined
    held = blocks.where(F.col("_n") <= LONG).groupBy(*by, "observed", "_n").agg(F.array_sort(F.collect_list(F.struct("_k", "_block")))["_block"].alias("_x"))
    held = cut(held)  # or the array would be sorted anew at each draw
    nets = F.transform(reps, lambda rep: F.aggregate(draws, F.lit(0.0), lambda net, j: net + F.element_at("_x", start(rep, j))))
    short = held.select(*by, "observed", ((F.size(F.filter(nets, far)) + 1) / F.lit(repeats + 1)).alias("p"))
    long = blocks.where(F.col("_n") > LONG)
    drawn = long.where("_k = 1").select(*by, "observed", "_n", F.explode(reps).alias("rep")).withColumn("_j", F.explode(draws))
    # the explosion isn't in Spark's estimate of sizes, so it must be told not to broadcast
    drawn = drawn.withColumn("_k", start(F.col("rep"), F.col("_j"))).hint("merge").join(long.select(*by, "_k", "_block"), [*by, "_k"])
    drawn = drawn.groupBy(*by, "rep", "observed").agg(F.sum("_block").alias("_net"))
    return short.unionByName(drawn.groupBy(*by, "observed").agg(((F.count_if(far(F.col("_net"))) + 1) / F.lit(repeats + 1)).alias("p")))
