"""Derivatives over irregular samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import finite, ordered, ratio
from .spectral import correlation_lag
from .timebase import with_steps


def backward(df: DataFrame, value: str = "x", key: str = "record_id") -> DataFrame:
    """Adds velocity and acceleration by backward differences; the first one and two samples have none."""
    w = ordered(key)
    step = F.col("t") - F.lag("t").over(w)
    v = ratio(F.col(value) - F.lag(value).over(w), step)
    with_v = df.withColumn("_dt", step).withColumn("velocity", v)
    a = ratio(2 * (F.col("velocity") - F.lag("velocity").over(w)), F.col("_dt") + F.lag("_dt").over(w))
    return with_v.withColumn("acceleration", a).drop("_dt")


def _gradient(df: DataFrame, value: str, out: str, key: str) -> DataFrame:
    w = ordered(key)
    t, x = F.col("t"), F.col(value)
    at = lambda c, k: F.lag(c, -k).over(w)

    def three(tt: list[Column], xx: list[Column], where: int) -> Column:
        """Slope of the parabola through three samples at one of them."""
        terms = []
        for j in range(3):
            a, b = [k for k in range(3) if k != j]
            slope = (tt[where] - tt[a]) + (tt[where] - tt[b])
            terms.append(xx[j] * ratio(slope, (tt[j] - tt[a]) * (tt[j] - tt[b])))
        return terms[0] + terms[1] + terms[2]

    inner = three([at("t", -1), t, at("t", 1)], [at(value, -1), x, at(value, 1)], 1)
    first = three([t, at("t", 1), at("t", 2)], [x, at(value, 1), at(value, 2)], 0)
    last = three([at("t", -2), at("t", -1), t], [at(value, -2), at(value, -1), x], 2)
    return df.withColumn(out, F.when(at("t", -1).isNull(), first).when(at("t", 1).isNull(), last).otherwise(inner))


def gradient(df: DataFrame, value: str = "x", key: str = "record_id") -> DataFrame:
    """Adds velocity by second-order differences and acceleration as the gradient of the velocity; records of fewer than three samples have none."""
    return _gradient(_gradient(df, value, "velocity", key), "velocity", "acceleration", key)


def _solve(m: list[list[Column]], v: list[Column]) -> list[Column]:
    """Cramer's rule for a small symmetric system of columns."""

    def det(rows: list[list[Column]]) -> Column:
        if len(rows) == 1:
            return rows[0][0]
        total = None
        for j, head in enumerate(rows[0]):
            part = head * det([[x for k, x in enumerate(r) if k != j] for r in rows[1:]])
            total = part if total is None else (total + part if j % 2 == 0 else total - part)
        return total

    whole = det(m)
    return [ratio(det([[v[i] if k == j else x for k, x in enumerate(r)] for i, r in enumerate(m)]), whole) for j in range(len(v))]


def local_polynomial(df: DataFrame, value: str = "x", window: int = 9, order: int = 2, key: str = "record_id", centred: bool = False, least: int | None = None) -> DataFrame:
    """Adds velocity and acceleration of a polynomial fitted to ``window`` samples: the trailing ones, or, ``centred``, those around.

    A centred window moves inward at a record's ends, so that it has as many samples there too. Samples with fewer
    than ``least`` in their window (all of it, or order + 1 when centred) have none. The normal equations' moments are sums of powers of
    the time since the current sample, in units of the window's length, solved by Cramer's rule.
    """
    w = ordered(key)
    sample = F.struct(F.col("t").alias("t"), F.col(value).alias("v"))
    if centred:
        whole, half = W.partitionBy(key), window // 2
        placed = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(whole), "_near": F.collect_list(sample).over(w.rowsBetween(-(window - 1), window - 1))})
        end = F.least(F.col("_n"), F.greatest(F.lit(0), F.col("_i") - half) + window)
        start = F.greatest(F.lit(0), end - window)
        first = F.greatest(F.lit(0), F.col("_i") - (window - 1))
        gathered = placed.withColumn("_w", F.slice("_near", (start - first + 1).cast("int"), (end - start).cast("int"))).drop("_near", "_i", "_n")
    else:
        gathered = df.withColumn("_w", F.collect_list(sample).over(w.rowsBetween(-(window - 1), 0)))
    least = least or (order + 1 if centred else window)
    scale = F.element_at("_w", -1)["t"] - F.element_at("_w", 1)["t"]
    full = gathered.where(F.size("_w") >= least).withColumn("_s", scale)

    def moment(p: int, q: int) -> Column:
        def add(total, row):
            u = ratio(row["t"] - F.col("t"), F.col("_s"))
            term = F.lit(1.0)
            for _ in range(p):
                term = term * u
            return total + (term * row["v"] if q else term)

        return F.aggregate("_w", F.lit(0.0), add)

    moments = full.withColumns({f"_m{p}": moment(p, 0) for p in range(2 * order + 1)} | {f"_y{p}": moment(p, 1) for p in range(order + 1)})
    c = _solve([[F.col(f"_m{i + j}") for j in range(order + 1)] for i in range(order + 1)], [F.col(f"_y{i}") for i in range(order + 1)])
    names = [x for x in moments.columns if x.startswith("_")]
    return moments.withColumns({"velocity": ratio(c[1], F.col("_s")), "acceleration": ratio(2 * c[2], F.col("_s") * F.col("_s"))}).drop(*names)


def startup_state(required: int = 9, key: str = "record_id") -> Column:
    """WARMUP_k_OF_n until a record has n samples, READY after."""
    n = F.row_number().over(ordered(key))
    return F.when(n >= required, "READY").otherwise(F.concat(F.lit("WARMUP_"), n, F.lit(f"_OF_{required}")))


def running_peak(df: DataFrame, value: str = "acceleration", quality: str | None = None, coefficient: float | None = None, scale_valid: bool = False, research: bool = False, key: str = "record_id") -> DataFrame:
    """Adds the running peak of |value| and what may be said of it.

    Missing values leave the peak as it is, which begins at 0. Estimates need a coefficient and either a
    valid scale or leave for research.
    """
    w = ordered(key).rowsBetween(W.unboundedPreceding, 0)
    proxy = F.abs(F.nanvl(F.col(value), F.lit(None).cast("double")))
    peak = F.coalesce(F.max(proxy).over(w), F.lit(0.0))
    may = coefficient is not None and (scale_valid or research)
    allowed = scale_valid and coefficient is not None
    said = "DEPLOYMENT_CALIBRATED" if allowed else "RESEARCH_ONLY_UNCALIBRATED" if research and coefficient is not None else "PIXEL_PROXY_ONLY"
    state = F.col(quality) if quality else F.lit("GOOD")
    estimate = (lambda c: c * coefficient) if may else (lambda c: F.lit(None).cast("double"))
    return df.withColumns({
        "proxy": proxy,
        "running_proxy": peak,
        "instant_estimate": estimate(proxy),
        "running_estimate": F.when(proxy.isNotNull(), estimate(peak)),
        "confidence": F.when((state == "INVALID") | proxy.isNull(), "INVALID").otherwise(state if allowed else F.lit("LOW_RESEARCH_ONLY")),
        "scale_state": F.lit("VALID" if scale_valid else "UNCALIBRATED"),
        "interpretation": F.lit(said),
    })


def reseed_boundary(reseed_id: Column, key: str = "record_id") -> Column:
    """Whether the id differs from that of the sample before; never at the first."""
    return F.coalesce(reseed_id != F.lag(reseed_id).over(ordered(key)), F.lit(False))


def compare_signals(df: DataFrame, reference: str, candidate: str, most_lag: int, key: str = "record_id") -> DataFrame:
    """Per record, of a candidate against a reference: amplitude_bias, rmse, lag_samples, lag, peak_timing_error, peak_error, reference_peak, candidate_peak.

    The lag is of greatest correlation within ``most_lag`` samples; peaks are of absolute values, of equal ones the
    first. Samples that miss either are left out. Needs t, seq and i.
    """
    both = df.where(finite(F.col(reference)).isNotNull() & finite(F.col(candidate)).isNotNull())
    r, c = F.abs(reference), F.abs(candidate)
    peak = lambda x: F.max(F.struct(x.alias("v"), (-F.col("i")).alias("i"), F.col("t").alias("t")))
    sums = both.groupBy(key).agg(peak(r).alias("r"), peak(c).alias("c"), F.sqrt(F.avg((F.col(candidate) - F.col(reference)) ** 2)).alias("rmse"))
    step = with_steps(both, key).groupBy(key).agg(F.percentile("dt", F.lit(0.5)).alias("step"))
    lag = correlation_lag(both.select(key, "i", F.col(reference).alias("x"), F.col(candidate).alias("y")), most_lag, key)
    d = F.col("c.v") - F.col("r.v")
    return sums.join(step, key).join(lag, key).select(
        key, (d / F.greatest("r.v", F.lit(1e-12))).alias("amplitude_bias"), "rmse", F.col("lag").alias("lag_samples"), (F.col("lag") * F.col("step")).alias("lag"),
        (F.col("c.t") - F.col("r.t")).alias("peak_timing_error"), d.alias("peak_error"), F.col("r.v").alias("reference_peak"), F.col("c.v").alias("candidate_peak"),
    )
