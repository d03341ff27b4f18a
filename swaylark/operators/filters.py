"""Filters of record signals.

Recursive filters need each sample's predecessor, so a record is filtered whole (one shuffle on the record), the
records of a batch side by side in numpy; detrending and integration stay in SQL expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ordered


def butterworth_bandpass(low: float, high: float, rate: float, order: int = 4) -> np.ndarray:
    """Second-order sections (b0, b1, b2, 1, a1, a2) of a Butterworth band pass, by the bilinear transform."""
    if not 0 < low < high < rate / 2:
        raise ValueError("a band pass needs 0 < low < high < rate / 2")
    lo, hi = (2 * rate * np.tan(np.pi * f / rate) for f in (low, high))
    width, centre = hi - lo, np.sqrt(lo * hi)
    k = np.arange(1, order + 1)
    base = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(base * base - centre * centre)
    poles = np.concatenate([base + root, base - root])
    fast = 2 * rate
    z = (fast + poles) / (fast - poles)
    gain = np.real(width**order * fast**order / np.prod(fast - poles))
    upper = sorted(z[z.imag > 1e-12], key=lambda p: abs(p))
    real = sorted(np.real(z[np.abs(z.imag) <= 1e-12]))
    pairs = [(p, np.conj(p)) for p in upper] + [(real[i], real[i + 1]) for i in range(0, len(real), 2)]
    sections = np.array([[1, 0, -1, 1, -np.real(p + q), np.real(p * q)] for p, q in pairs], float)
    sections[0, :3] *= gain
    return sections


def steady_state(sections: np.ndarray) -> np.ndarray:
    """Each section's state (transposed direct form) after endless ones at the filter's input."""
    out, level = np.zeros((len(sections), 2)), 1.0
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        y = (b0 + b1 + b2) / (1 + a1 + a2)
        out[i] = level * np.array([y - b0, b2 - a2 * y])
        level *= y
    return out


def run_sections(sections: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filtered samples and the state after them; transposed direct form II."""
    state = np.zeros((len(sections), 2)) if state is None else state.copy()
    y = np.asarray(x, float).copy()
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        s0, s1 = state[i]
        for j in range(len(y)):
            v = y[j]
            w = b0 * v + s0
            s0 = b1 * v - a1 * w + s1
            s1 = b2 * v - a2 * w
            y[j] = w
        state[i] = s0, s1
    return y, state


def run_together(sections: np.ndarray, series: list[np.ndarray], states: np.ndarray | None = None) -> list[np.ndarray]:
    """Every series filtered by itself, all of them side by side: one step for each sample of the longest."""
    sizes = [len(x) for x in series]
    y = np.zeros((max(sizes, default=0), len(series)))
    for j, x in enumerate(series):
        y[: sizes[j], j] = x
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        s0, s1 = (np.zeros(len(series)) if states is None else states[:, i, k].copy() for k in (0, 1))
        for v in y:
            w = b0 * v + s0
            s0 = b1 * v - a1 * w + s1
            s1 = b2 * v - a2 * w
            v[:] = w
    return [y[:n, j] for j, n in enumerate(sizes)]


def zero_phase(sections: np.ndarray, series: list[np.ndarray]) -> list[np.ndarray | None]:
    """Forward and backward over an odd extension; None for a series that has no more samples than the extension."""
    pad = 3 * (2 * len(sections) + 1)
    fit = [j for j, x in enumerate(series) if len(x) > pad]
    long = [np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) for x in (series[j] for j in fit)]
    zi = steady_state(sections)
    states = lambda xs: np.stack([zi * x[0] for x in xs])
    out: list[np.ndarray | None] = [None] * len(series)
    if fit:
        ahead = [x[::-1] for x in run_together(sections, long, states(long))]
        for j, x in zip(fit, run_together(sections, ahead, states(ahead)), strict=True):
            out[j] = x[::-1][pad:-pad]
    return out


#: Samples of records, padded to the longest, that are filtered side by side.
TOGETHER = 1 << 21


def _by_record(df: DataFrame, value: str, key: str, out: str, kernel: Callable[[list[np.ndarray]], list[np.ndarray | None]]) -> DataFrame:
    """Per sample: key, seq, t and what the kernel makes of the record's values in order. A record is a row; rows of many records share a batch."""
    kind = dict(df.dtypes)[key]
    sample = F.struct("t", F.col("seq").cast("long").alias("seq"), F.col(value).cast("double").alias("v"))
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(sample)).alias("rows"))

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(1).offsets))
            start = 0
            while start < batch.num_rows:
                end = start + 1
                while end < batch.num_rows and (end + 1 - start) * sizes[start : end + 1].max() <= TOGETHER:
                    end += 1
                part = batch.slice(start, end - start)
                flat = part.column(1).flatten()
                cuts = np.cumsum(sizes[start:end])[:-1]
                values = np.asarray(flat.field("v").fill_null(np.nan))
                series = np.split(values, cuts)
                got = [np.full(len(x), np.nan) if y is None else y for x, y in zip(series, kernel(series), strict=True)]
                made = np.concatenate(got) if got else np.zeros(0)
                names = pa.array(np.repeat(np.arange(end - start), sizes[start:end]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(names), flat.field("seq"), flat.field("t"), pa.array(made, mask=np.isnan(made))], names=[key, "seq", "t", out])
                start = end

    return rows.mapInArrow(filtered, f"{key} {kind}, seq long, t double, {out} double")


def bandpass(df: DataFrame, low: float, high: float, rate: float, mode: str = "causal", value: str = "x", key: str = "record_id", order: int = 4) -> DataFrame:
    """Per sample: key, seq, t, filtered. Modes: causal (from rest), steady (from the first value held), zero_phase.

    Records too short for zero phase have nulls.
    """
    sections = butterworth_bandpass(low, high, rate, order)
    zi = steady_state(sections)

    def kernel(series: list[np.ndarray]) -> list[np.ndarray | None]:
        if mode == "zero_phase":
            return zero_phase(sections, series)
        return run_together(sections, series, np.stack([zi * x[0] for x in series]) if mode == "steady" else None)

    return _by_record(df, value, key, "filtered", kernel)


def smoothed(df: DataFrame, weight: float, value: str = "x", key: str = "record_id") -> DataFrame:
    """Exponential smoothing s = s + weight (x - s) from a record's first value, in order: key, seq, t, value, smooth."""

    def kernel(series: list[np.ndarray]) -> list[np.ndarray | None]:
        # the section 1, 0, 0 over 1, weight - 1 with its input scaled, begun as if the first value had been held
        section = np.array([[weight, 0.0, 0.0, 1.0, weight - 1.0, 0.0]])
        return run_together(section, series, np.stack([[[(1 - weight) * x[0], 0.0]] for x in series]))

    smooth = _by_record(df, value, key, "smooth", kernel)
    return df.select(key, "seq", "t", F.col(value).cast("double").alias(value)).join(smooth.select(key, "seq", "smooth"), [key, "seq"])


def detrend(df: DataFrame, value: str = "x", key: str = "record_id") -> DataFrame:
    """Adds what a straight line over the sample's place leaves; records of one sample leave 0."""
    w = W.partitionBy(key)
    place = (F.row_number().over(ordered(key)) - 1).cast("double")
    at = df.withColumn("_i", place)
    slope = F.coalesce(F.try_divide(F.covar_pop("_i", value).over(w), F.var_pop("_i").over(w)), F.lit(0.0))
    line = F.avg(value).over(w) + slope * (F.col("_i") - F.avg("_i").over(w))
    return at.withColumn("detrended", F.col(value) - line).drop("_i")


def trapezoid(df: DataFrame, value: str = "x", key: str = "record_id") -> DataFrame:
    """Adds the running integral over time, from 0."""
    w = ordered(key)
    part = (F.col(value) + F.lag(value).over(w)) / 2 * (F.col("t") - F.lag("t").over(w))
    return df.withColumn("_part", F.coalesce(part, F.lit(0.0))).withColumn("integral", F.sum("_part").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_part")


def _line_out(x: np.ndarray) -> np.ndarray:
    i = np.arange(len(x))
    return x - np.polyval(np.polyfit(i, x, 1), i) if len(x) > 1 else x - x


def displacements(series: list[np.ndarray], low: float, high: float, rate: float) -> list[np.ndarray | None]:
    """Displacement of accelerations: detrend, filter, integrate twice with detrending between, filter. None for series too short."""
    sections = butterworth_bandpass(low, min(high, 0.95 * rate / 2), rate)
    integral = lambda v: np.concatenate([[0], np.cumsum((v[1:] + v[:-1]) / 2 / rate)])
    first = zero_phase(sections, [_line_out(a) for a in series])
    fit = [j for j, v in enumerate(first) if v is not None]
    out: list[np.ndarray | None] = [None] * len(series)
    for j, y in zip(fit, zero_phase(sections, [_line_out(integral(_line_out(integral(first[j])))) for j in fit]), strict=True):
        out[j] = y
    return out


def acceleration_to_displacement(df: DataFrame, low: float, high: float, rate: float, value: str = "x", key: str = "record_id") -> DataFrame:
    """Per sample: key, seq, t, displacement; null for records too short to filter. Time between samples is 1 / rate."""
    return _by_record(df, value, key, "displacement", lambda series: displacements(series, low, high, rate))
