"""Aligning a record with a sensor by the offset of greatest correlation, and how likely chance is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import correlation
from ..sources.staging import staged
from . import ranges
from .spectral import phase_surrogates

#: Samples that must overlap, and the share of the record.
LEAST_OVERLAP, LEAST_SHARE = 10, 0.25


def interpolated(queries: DataFrame, sensor: DataFrame, columns: list[str], key: str = "record_id") -> DataFrame:
    """Sensor columns at the queries' times q, between the neighbours of each; queries outside the sensor's times go.

    Queries and sensor samples are laid in one order of time per record; the sample before and the one after
    come from windows, so nothing is joined by range.
    """
    extra = [c for c in queries.columns if c not in (key, "q")]
    a = queries.select(key, F.col("q").alias("at"), F.struct(*extra).alias("row"), F.lit(None).cast(dict(sensor.select(F.struct("t", *columns).alias("s")).dtypes)["s"]).alias("s"))
    b = sensor.select(key, F.col("t").alias("at"), F.lit(None).cast(dict(a.dtypes)["row"]).alias("row"), F.struct("t", *columns).alias("s"))
    both = a.unionByName(b)
    w = W.partitionBy(key).orderBy("at", F.col("s").isNull())
    back = W.partitionBy(key).orderBy(F.col("at").desc(), F.col("s").isNull())
    near = both.withColumns({"p": F.last("s", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), "n": F.last("s", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0))})
    hit = near.where(F.col("row").isNotNull() & F.col("p").isNotNull() & F.col("n").isNotNull())
    share = F.coalesce(F.try_divide(F.col("at") - F.col("p.t"), F.col("n.t") - F.col("p.t")), F.lit(0.0))
    return hit.select(key, F.col("at").alias("q"), "row.*", *[(F.col(f"p.{c}") + share * (F.col(f"n.{c}") - F.col(f"p.{c}"))).alias(c) for c in columns])


def alignment_grid(visual: DataFrame, sensor: DataFrame, offsets: list[float], channels: list[str], sensor_channels: list[str], key: str = "record_id") -> DataFrame:
    """Correlation of every offset and pair of channels: record, offset, channel, sensor_channel, n, corr.

    The grid of offsets is a parameter, exploded per sample.
    """
    queries = visual.select(key, "t", *[F.col(c).alias(f"v_{c}") for c in channels], F.posexplode(F.array(*[F.lit(float(o)) for o in offsets])).alias("k", "offset")).withColumn("q", F.col("t") + F.col("offset"))
    at = interpolated(queries.drop("t"), sensor, sensor_channels, key)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("channel"), F.lit(j).alias("sensor_channel"), F.col(f"v_{c}").alias("v"), F.col(s).alias("s")) for i, c in enumerate(channels) for j, s in enumerate(sensor_channels)])).alias("p")
    long = at.select(key, "k", "offset", pairs).select(key, "k", "offset", "p.*").where("v IS NOT NULL AND s IS NOT NULL")
    sums = long.groupBy(key, "k", "offset", "channel", "sensor_channel").agg(F.count(F.lit(1)).alias("n"), correlation(F.col("v"), F.col("s")).alias("corr"))
    total = visual.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    enough = F.greatest(F.lit(LEAST_OVERLAP).cast("double"), F.floor(LEAST_SHARE * F.col("total")))
    return sums.join(total, key).where((F.col("n") >= enough) & F.col("corr").isNotNull()).drop("total")


def best_alignment(grid: DataFrame, least_correlation: float = 0.5, key: str = "record_id", digits: int = 9) -> DataFrame:
    """Per record the pair of greatest |corr|; of equals the first in offset, channel, sensor channel."""
    w = W.partitionBy(key).orderBy(F.round(F.abs("corr"), digits).desc(), "k", "channel", "sensor_channel")
    top = grid.withColumn("r", F.row_number().over(w)).where("r = 1")
    return top.select(key, "offset", F.abs("corr").alias("correlation"), "channel", "sensor_channel", F.when(F.col("corr") >= 0, 1).otherwise(-1).alias("polarity"), F.col("n").alias("overlap"), F.when(F.abs("corr") >= least_correlation, "ALIGNED").otherwise("LOW_CORRELATION").alias("status"))


def preferred_domain(acceleration: DataFrame, displacement: DataFrame, key: str = "record_id") -> DataFrame:
    """Of two alignments of a record the one of greater correlation; acceleration wins ties."""
    a = acceleration.select(key, F.col("correlation").alias("acceleration_correlation"), F.col("offset").alias("a_offset"))
    d = displacement.select(key, F.col("correlation").alias("displacement_correlation"), F.col("offset").alias("d_offset"))
    j = a.join(d, key, "full_outer")
    first = F.coalesce(F.col("acceleration_correlation"), F.lit(-1.0)) >= F.coalesce(F.col("displacement_correlation"), F.lit(-1.0))
    return j.select(key, F.when(first, "acceleration").otherwise("displacement").alias("preferred_domain"), F.when(first, F.col("a_offset")).otherwise(F.col("d_offset")).alias("preferred_offset"), "acceleration_correlation", "displacement_correlation")


def maximum_domain(grids: dict[str, DataFrame], key: str = "record_id", digits: int = 9) -> DataFrame:
    """Per record the domain and place in its grid of greatest |corr|; of equals the first domain by name, then offset and channels."""
    both = None
    for name in sorted(grids):
        part = grids[name].withColumn("domain", F.lit(name))
        both = part if both is None else both.unionByName(part)
    w = W.partitionBy(key).orderBy(F.round(F.abs("corr"), digits).desc(), "domain", "k", "channel", "sensor_channel")
    top = both.withColumn("r", F.row_number().over(w)).where("r = 1")
    return top.select(key, "domain", "offset", F.abs("corr").alias("correlation"), "channel", "sensor_channel", F.when(F.col("corr") >= 0, 1).otherwise(-1).alias("polarity"), F.col("n").alias("overlap"))


def containment(visual: DataFrame, sensor: DataFrame, key: str = "record_id") -> DataFrame:
    """Range of offsets at which the sensor covers the whole record; a shorter sensor is marked."""
    v = visual.groupBy(key).agg(F.min("t").alias("v0"), F.max("t").alias("v1"))
    s = sensor.groupBy(key).agg(F.min("t").alias("s0"), F.max("t").alias("s1"))
    return v.join(s, key).select(key, (F.col("s0") - F.col("v0")).alias("offset_min"), (F.col("s1") - F.col("v1")).alias("offset_max"), ((F.col("s1") - F.col("s0")) >= (F.col("v1") - F.col("v0"))).alias("contained"))


def _shifted_correlations(x: pa.Array, y: pa.Array, shifts: int) -> tuple[float | None, np.ndarray, np.ndarray]:
    """|corr| of two series as they stand, and of y turned round by each shift against x (and which of these are defined).

    As with SQL's aggregates, a pair with a null does not count, a deviation is over all values of its own series, and where one is 0 there is none.
    """
    n, known = len(x), [np.asarray(c.is_valid()) for c in (x, y)]
    series, spread = [], 1.0
    for c, have in zip((x, y), known, strict=True):
        v = c.to_numpy(zero_copy_only=False).astype(float)
        there = v[have]
        flat = not len(there) or there.min() == there.max()
        with np.errstate(invalid="ignore"):
            series.append(np.where(have, v - (there[0] if flat and len(there) else there.mean() if len(there) else 0.0), 0.0))
        spread = spread * (0.0 if flat else there.std())
    least = max(1.0, float(np.ceil(0.05 * n)))
    by = np.floor(least + np.arange(shifts) * (n - 2 * least) / shifts).astype(np.int64)
    starts = np.concatenate([[0], (n - by) % n]) % n  # the first is the series as it stands
    if spread == 0:
        return None, np.zeros(shifts), np.zeros(shifts, bool)
    turned = [np.lib.stride_tricks.sliding_window_view(np.concatenate([c, c]), n) for c in (series[1], known[1].astype(float))]
    whole, step, both = known[0].all() and known[1].all(), max(1, (1 << 20) // n), []
    for k in range(0, len(starts), step):
        part = turned[0][starts[k : k + step]]
        if whole:
            both.append(np.stack([part @ series[0] / n, np.full(len(part), float(n))]))
            continue
        there = turned[1][starts[k : k + step]]
        m = there @ known[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            both.append(np.stack([(part @ series[0] - (there @ series[0]) * (part @ known[0]) / m) / m, m]))
    covariance, m = np.concatenate(both, 1)
    with np.errstate(invalid="ignore"):
        found = np.abs(covariance / spread)
    return (float(found[0]) if m[0] else None), found[1:], m[1:] > 0


def _shift_null(df: DataFrame, shifts: int, key: str, digits: int, each: bool) -> DataFrame:
    """Per record of ten samples or more: observed, and how many shifts are at least as great (to ``digits``), or with ``each`` all their values.

    A record's samples are one row for a numpy kernel, as a shift needs them all; shifts are rows of a matrix, as many at once as keep it small.
    """
    kind = dict(df.dtypes)[key]
    packed = df.select(key, F.struct(F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("s")).where(F.col(key).isNotNull())
    rows = packed.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("s")).where("size(s) >= 10")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = lambda v: np.floor(v * 10.0**digits + 0.5)
        for batch in batches:
            lists, observed, rest = batch.column(1), [], []
            offsets = np.asarray(lists.offsets)
            x, y = lists.values.field("x"), lists.values.field("y")
            for i, j in zip(offsets, offsets[1:], strict=False):
                now, found, there = _shifted_correlations(x[i:j], y[i:j], shifts)
                observed.append(now)
                if each:
                    rest.append([v if ok else None for v, ok in zip(found.tolist(), there.tolist(), strict=True)])
                else:  # NaN is greatest
                    rest.append(0 if now is None else int((there & (np.isnan(found) | (near(found) >= near(now)))).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(observed, pa.float64()), pa.array(rest, pa.list_(pa.float64()) if each else pa.int64())], names=[key, "observed", "rest"])

    return rows.mapInArrow(kernel, f"{key} {kind}, observed double, rest {'array<double>' if each else 'long'}")


def circular_shifts(df: DataFrame, shifts: int, key: str = "record_id") -> DataFrame:
    """Null distribution by circular shifts of y against x: record, shift number, |corr|. Needs i, a sample's place from 0. Shifts are spread evenly from a twentieth of the record on."""
    return _shift_null(df, shifts, key, 9, True).select(key, F.posexplode("rest").alias("b", "null_corr"))


def null_p_values(df: DataFrame, shifts: int, key: str = "record_id", digits: int = 9) -> DataFrame:
    """Per record: observed |corr| of x and y and p = (1 + shifts at least as great) / (shifts + 1)."""
    return _shift_null(df, shifts, key, digits, False).select(key, "observed", ((1 + F.col("rest")) / F.lit(shifts + 1)).alias("p_value"))


def bh_q_values(df: DataFrame, p: str = "p_value", key: str = "record_id") -> DataFrame:
    """Adds q_value by Benjamini and Hochberg over all rows, which are in order of p and key in ranges. The rows are staged, as ranges read them several times."""
    rows = staged(df, "p-values")
    total = rows.count()
    order = ranges.Order(rows, p, tie=key)
    raw = order.with_position(rows, "_at").withColumn("_raw", F.col(p) * total / (F.col("_at") + 1))
    return order.with_least_from(raw, "_raw", "_least").withColumn("q_value", F.least(F.lit(1.0), "_least")).select(*df.columns, "q_value")


def offset_grid(span: tuple[float, float] | float, step: float) -> np.ndarray:
    """Offsets from the first of ``span`` to the last (or from minus ``span`` to plus), ``step`` apart."""
    low, high = (-span, span) if np.isscalar(span) else span
    return np.arange(low, high + step / 2, step) if step > 0 and high >= low else np.zeros(0)


def natural_step(t: np.ndarray, st: np.ndarray) -> float:
    """The lesser of the two series' median steps; 0 if neither has one."""
    steps = [float(np.median(np.diff(x))) for x in (t, st) if len(x) > 1]
    return min(steps, default=0.0)


def searched(t: np.ndarray, v: np.ndarray, st: np.ndarray, series: list[np.ndarray], offsets: np.ndarray, groups: list[tuple[list[int], list[int]]] | None = None, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Greatest |corr| of a visual channel (columns of ``v``) with a sensor channel over all offsets, and its offset, for many versions of the sensor at once.

    ``series``: of each sensor channel an array with a row for each of its times ``st`` and a column for each version; the offset is that of
    version 0. ``groups`` pairs channels that belong together (all with all otherwise). Interpolation at an offset
    is the same two rows and weights for all versions, so an offset costs one product of matrices a pair.
    """
    count = series[0].shape[1]
    best, where = np.full(count, least), 0.0
    total, finite = len(t), np.isfinite(v)
    pairs = groups or [(list(range(v.shape[1])), list(range(len(series))))]
    for offset in offsets:
        inside = np.flatnonzero((t + offset >= st[0]) & (t + offset <= st[-1]))
        if len(inside) < max(LEAST_OVERLAP, int(LEAST_SHARE * total)):
            continue
        after = np.clip(np.searchsorted(st, t[inside] + offset, "right"), 1, len(st) - 1)
        share = ((t[inside] + offset - st[after - 1]) / (st[after] - st[after - 1]))[:, None]
        for visual, sensor in pairs:
            for d in sensor:
                at = series[d][after - 1] * (1 - share) + series[d][after] * share
                centred = at - at.mean(0)
                size = np.einsum("ij,ij->j", centred, centred)
                for c in visual:
                    rows = finite[inside, c]
                    if rows.sum() < LEAST_OVERLAP:
                        continue
                    one = v[inside, c][rows]
                    one = one - one.mean()
                    other, squares = centred, size
                    if not rows.all():
                        other = at[rows] - at[rows].mean(0)
                        squares = np.einsum("ij,ij->j", other, other)
                    spread = np.sqrt((one * one).sum() * squares)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        r = np.abs(one @ other) / spread
                    r = np.where(spread > 1e-12 * len(one), r, 0.0)
                    if r[0] > best[0]:
                        where = float(offset)
                    best = np.fmax(best, r)
    return best, where


def uniform_draws(seed: int, salt: int, first: int, n: int, count: int) -> np.ndarray:
    """What ``np.random.default_rng([seed, salt, it]).random(count)`` gives, a row for each of n iterations ``it`` from ``first`` on.

    Generators are seeded (SeedSequence) and stepped (PCG64) side by side, as making one costs more than a short record's search.
    """
    if max(seed, salt, first + n) >> 32:
        return np.stack([np.random.default_rng([seed, salt, it]).random(count) for it in range(first, first + n)]) if n else np.zeros((0, count))
    low32, shift = 0xFFFFFFFF, np.uint32(16)
    const = [0x43B0D7E5]

    def hashed(v: np.ndarray, factor: int) -> np.ndarray:
        v = v ^ np.uint32(const[0])
        const[0] = const[0] * factor & low32
        v = v * np.uint32(const[0])
        return v ^ v >> shift

    pool = [hashed(np.full(n, x, np.uint32) if np.isscalar(x) else x, 0x931E8875) for x in (seed, salt, np.arange(first, first + n, dtype=np.uint32), 0)]
    for i in range(4):
        for j in range(4):
            if i != j:
                mixed = np.uint32(0xCA01F9DD) * pool[j] - np.uint32(0x4973F715) * hashed(pool[i], 0x931E8875)
                pool[j] = mixed ^ mixed >> shift
    const[0] = 0x8B51F9DD
    words = [hashed(pool[i % 4], 0x58F38DED).astype(np.uint64) for i in range(8)]
    half, one = np.uint64(32), np.uint64(1)
    (sh, sl), (ih, il) = [[words[k] | words[k + 1] << half for k in (i, i + 2)] for i in (0, 4)]
    ih, il = ih << one | il >> np.uint64(63), il << one | one
    mh, ml = np.uint64(2549297995355413924), np.uint64(4865540595714422341)
    m1, m0, cut = ml >> half, ml & np.uint64(low32), np.uint64(low32)

    def added(ah: np.ndarray, al: np.ndarray, bh: np.ndarray, bl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = al + bl
        return ah + bh + (low < al), low

    def stepped(h: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a1, a0 = low >> half, low & cut
        p, q = a0 * m1, a1 * m0
        carry = ((a0 * m0 >> half) + (p & cut) + (q & cut)) >> half
        return added(a1 * m1 + (p >> half) + (q >> half) + carry + h * ml + low * mh, low * ml, ih, il)

    h, low = stepped(*added(ih, il, sh, sl))
    out = np.empty((n, count))
    for k in range(count):
        h, low = stepped(h, low)
        turn, v = h >> np.uint64(58), h ^ low
        out[:, k] = ((v >> turn | v << (np.uint64(64) - turn & np.uint64(63))) >> np.uint64(11)) * 2.0**-53
    return out


def null_test(pairs: DataFrame, iterations: int, offsets: list[float] | None = None, seed: int = 0, key: str = "record_id", method: str = "phase", span: float | None = None, groups: list[tuple[list[int], list[int]]] | None = None, block: int = 1000) -> DataFrame:
    """Surrogates of the sensor that repeat the whole search: key, observed, offset, p_value = (1 + those at least as great) / (1 + iterations).

    ``method``: ``phase`` draws the phases of each of the sensor's channels anew, ``shift`` turns all its samples round by a twentieth or
    more. ``pairs``: key, t, v (array of series), st, sv (array of series), a row per record, times increasing. Offsets are
    ``offsets`` or, without them, each record's own grid in steps of the lesser of its median steps: between minus and plus ``span`` or,
    without it, where the sensor covers the whole record (records longer than their sensor have no such offset, and no row).

    A task has one record and ``block`` iterations, searched side by side as columns of one matrix; a draw is seeded by record and
    iteration, so results do not depend on blocks. Without iterations this is the search alone. Samples that are null or not finite are left out of correlations; a
    sensor sample with one goes.
    """
    if method not in ("phase", "shift"):
        raise ValueError(f"unknown method {method}")
    most = 1 << 22  # numbers in a matrix of versions

    def versions(sv: np.ndarray, salt: int, first: int, n: int) -> list[np.ndarray]:
        if not n:
            return [x[:, None] for x in sv.T]
        if method == "shift":
            rngs = [np.random.default_rng([seed, salt, it]) for it in range(first, first + n)]
            least = max(1, round(0.05 * len(sv)))
            by = np.array([int(rng.integers(least, max(least + 1, len(sv)))) for rng in rngs], np.int64)
            at = (np.arange(len(sv))[:, None] - by) % len(sv)
            return [np.column_stack([x, x[at]]) for x in sv.T]
        turns = uniform_draws(seed, salt, first, n, sv.shape[1] * (len(sv) // 2 + 1)).reshape(n, sv.shape[1], -1)
        return [np.column_stack([x, phase_surrogates(x, turns[:, c]).T]) for c, x in enumerate(sv.T)]

    def kernel(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                t, v, st, sv = np.asarray(r.t, float), np.stack([np.asarray(x, float) for x in r.v]).T, np.asarray(r.st, float), np.stack([np.asarray(x, float) for x in r.sv]).T
                good = np.isfinite(sv).all(1) & np.isfinite(st)
                st, sv = st[good], sv[good]
                if len(st) < 2 or not len(t):
                    continue
                grid = np.asarray(offsets, float) if offsets is not None else offset_grid((st[0] - t[0], st[-1] - t[-1]) if span is None else span, natural_step(t, st))
                if not len(grid):
                    continue
                hits, done, many = 0, 0, max(1, most // len(sv))
                while done < r.n or not r.n:
                    n = min(many, r.n - done)
                    found, where = searched(t, v, st, versions(sv, int(r.salt), r.first + done, n), grid, groups)
                    hits, done = hits + int((found[1:] >= found[0]).sum()), done + n
                    if not r.n:
                        break
                out.append((getattr(r, key), float(found[0]), where, hits, r.n))
            yield pd.DataFrame(out, columns=[key, "observed", "offset", "hits", "n"])

    firsts = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(min(block, iterations - a)).alias("n")) for a in range(0, max(1, iterations), block)])).alias("p")
    kind = dict(pairs.dtypes)[key]
    work = pairs.select("*", F.pmod(F.xxhash64(key), F.lit(1 << 31)).alias("salt"), firsts).select(*pairs.columns, "salt", "p.*").repartition(F.col(key), F.col("first"))
    got = work.mapInPandas(kernel, f"{key} {kind}, observed double, offset double, hits long, n long")
    return got.groupBy(key).agg(F.max("observed").alias("observed"), F.min("offset").alias("offset"), ((1 + F.sum("hits")) / (1 + F.sum("n"))).alias("p_value"))
