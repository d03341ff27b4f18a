"""Spectra and correlation of record signals."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import PI, ratio


def dft(df: DataFrame, value: str = "x", key: str = "record_id") -> DataFrame:
    """Per record and frequency k from 0 to n / 2: n, k, re, im, power. Needs i, the sample's place.

    One FFT a record, whose samples are a task's. Records with a missing value or of fewer than four samples have none.
    """
    schema = pa.schema([(key, pa.null()), ("n", pa.int64()), ("k", pa.int64()), ("re", pa.float64()), ("im", pa.float64())])

    def kernel(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        x = rows.column("v").to_numpy()
        fields = [rows.schema.field(key), *list(schema)[1:]]
        if len(x) < 4 or not np.isfinite(x).all():
            return pa.schema(fields).empty_table()
        f = np.fft.rfft(x)
        name = pa.repeat(rows.column(key)[0], len(f)) if rows.column(key)[0].is_valid else pa.nulls(len(f), fields[0].type)
        return pa.Table.from_arrays([name, pa.array(np.full(len(f), len(x))), pa.array(np.arange(len(f))), pa.array(f.real), pa.array(f.imag)], schema=pa.schema(fields))

    samples = df.select(key, "i", F.col(value).cast("double").alias("v"))
    spectra = samples.groupBy(key).applyInArrow(kernel, f"{key} {dict(df.dtypes)[key]}, n long, k long, re double, im double")
    return spectra.withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im"))


def dominant_frequency(spectrum: DataFrame, rate: float, key: str = "record_id", digits: int = 6) -> DataFrame:
    """The frequency of most power but for zero; of equal ones (to ``digits``) the lowest."""
    w = W.partitionBy(key).orderBy(F.round(F.sqrt("power"), digits).desc(), "k")
    top = spectrum.where("k > 0").withColumn("r", F.row_number().over(w)).where("r = 1")
    return top.select(key, "n", (F.col("k") * rate / F.col("n")).alias("dominant_hz"))


def band_energy(spectrum: DataFrame, rate: float, bands: tuple[tuple[float, float], ...] = ((0.3, 1.0), (1.0, 3.0), (3.0, 8.0)), key: str = "record_id") -> DataFrame:
    """Per record: the sum of power / n ** 2 of one side of the spectrum in each band, low edge in, high edge out."""
    hz = F.col("k") * rate / F.col("n")
    share = F.col("power") / (F.col("n") * F.col("n"))
    return spectrum.groupBy(key).agg(*[F.sum(F.when((hz >= a) & (hz < b), share).otherwise(0.0)).alias(f"band_{j}") for j, (a, b) in enumerate(bands)])


def spectrum_features(df: DataFrame, value: str = "x", rate: str = "rate", bands: tuple[tuple[float, float], ...] = ((0.3, 1.0), (1.0, 3.0), (3.0, 8.0)), key: str = "record_id", digits: int = 6) -> DataFrame:
    """Per record by one FFT of its samples in order: dominant_hz and band_0, band_1, ...; null for records with a missing value or of fewer than four samples.

    ``rate``: the column with the record's rate. Of frequencies of equal amplitude (to ``digits``) the lowest.
    """
    names = ["dominant_hz", *[f"band_{j}" for j in range(len(bands))]]

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "seq"])
        x, hz = rows["v"].to_numpy(float), float(rows["rate"].iloc[0])
        out = [np.nan] * len(names)
        if len(x) >= 4 and np.isfinite(x).all() and np.isfinite(hz):
            at, power = np.fft.rfftfreq(len(x), 1 / hz), np.abs(np.fft.rfft(x - x.mean())) ** 2
            out = [at[1:][np.argmax(np.round(np.sqrt(power[1:]), digits))]] + [power[(at >= a) & (at < b)].sum() / len(x) ** 2 for a, b in bands]
        return pd.DataFrame({key: [rows[key].iloc[0]]} | {n: [v] for n, v in zip(names, out, strict=True)})

    kind = dict(df.dtypes)[key]
    got = df.select(key, "t", "seq", F.col(value).cast("double").alias("v"), F.col(rate).cast("double").alias("rate")).groupBy(key).applyInPandas(kernel, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))
    return got.select(key, *[F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in names])


def correlation_lag(df: DataFrame, most: int, key: str = "record_id", digits: int = 6) -> DataFrame:
    """The lag of y against x, in samples, at which the sum of their products is greatest; of equal sums the least lag. Needs i."""
    w = W.partitionBy(key)
    centred = df.select(key, "i", (F.col("x") - F.avg("x").over(w)).alias("x"), (F.col("y") - F.avg("y").over(w)).alias("y"))
    shifted = centred.select(key, F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"), "i", "y").select(key, "lag", (F.col("i") - F.col("lag")).alias("i"), F.col("y").alias("y1"))
    sums = centred.join(shifted, [key, "i"]).groupBy(key, "lag").agg(F.sum(F.col("x") * F.col("y1")).alias("score"))
    top = W.partitionBy(key).orderBy(F.round("score", digits).desc(), "lag")
    return sums.withColumn("r", F.row_number().over(top)).where("r = 1").select(key, "lag", "score")


def sinusoid_fit(df: DataFrame, cycles: Column, value: str = "x", key: str = "record_id") -> DataFrame:
    """Amplitude, phase and offset of the best sinusoid of known frequency. ``cycles``: a sample's phase in turns."""
    s, c, x = F.sin(2 * PI * cycles), F.cos(2 * PI * cycles), F.col(value)
    m = {"n": F.lit(1.0), "s": s, "c": c, "ss": s * s, "cc": c * c, "sc": s * c, "x": x, "sx": s * x, "cx": c * x}
    sums = df.groupBy(key).agg(*[F.sum(v).alias(k) for k, v in m.items()])
    g = F.col
    # Centred normal equations of two regressors.
    ss, cc, sc = g("ss") - g("s") * g("s") / g("n"), g("cc") - g("c") * g("c") / g("n"), g("sc") - g("s") * g("c") / g("n")
    sx, cx = g("sx") - g("s") * g("x") / g("n"), g("cx") - g("c") * g("x") / g("n")
    det = ss * cc - sc * sc
    a, b = ratio(sx * cc - cx * sc, det), ratio(cx * ss - sx * sc, det)
    return sums.select(key, F.sqrt(a * a + b * b).alias("amplitude"), F.atan2(b, a).alias("phase"), ((g("x") - a * g("s") - b * g("c")) / g("n")).alias("offset"))


def phase_surrogates(x: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Series with the amplitudes of ``x`` and other phases, a row for each row of ``turns`` (one number from 0 to 1 for each of its len(x) // 2 + 1 frequencies).

    The spectrum is turned by unit phasors, which are 1 at frequency 0 and, for even lengths, at the highest, so these two stay.
    """
    phasors = np.exp(2j * np.pi * turns)
    phasors[:, 0] = 1
    if len(x) % 2 == 0:
        phasors[:, -1] = 1
    return np.fft.irfft(np.fft.rfft(x) * phasors, len(x), axis=1)


def phase_surrogate(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One series with the amplitudes of ``x`` and random phases."""
    return phase_surrogates(x, rng.random((1, len(x) // 2 + 1)))[0]


def surrogates(df: DataFrame, count: int, seed: int = 0, value: str = "x", key: str = "record_id") -> DataFrame:
    """``count`` phase surrogates of each record: key, iteration, i, value. A draw is seeded by record and iteration."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        it = int(rows["iteration"].iloc[0])
        rng = np.random.default_rng([seed, int(rows["salt"].iloc[0]), it])
        return rows.assign(v=phase_surrogate(rows["v"].to_numpy(float), rng))[[key, "iteration", "i", "v"]]

    kind = dict(df.dtypes)[key]
    many = df.select(key, F.col("i").cast("long").alias("i"), F.col(value).cast("double").alias("v"), F.pmod(F.xxhash64(key), F.lit(1 << 31)).alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("iteration"))
    return many.groupBy(key, "iteration").applyInPandas(kernel, f"{key} {kind}, iteration int, i long, v double").withColumnRenamed("v", value)
