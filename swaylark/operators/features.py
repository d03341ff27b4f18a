"""One row of features per record, and peaks of sensor records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clip, finite, joined_flags, norm, ratio
from .derivatives import backward, local_polynomial
from .spectral import spectrum_features
from .timebase import diagnose

VERSION = "swaylark-motion-1"


def motion_features(df: DataFrame, rate: float = 1.0, key: str = "record_id") -> DataFrame:
    """Peaks, RMS and duration of each record's displacement (x) and its backward derivatives.

    Duration counts samples of at least a tenth of the peak acceleration, over ``rate``.
    """
    d = backward(df, "x", key)
    d = d.withColumns({"m": F.abs(finite(F.col("x"))), "v": F.abs(finite(F.col("velocity"))), "a": F.abs(finite(F.col("acceleration")))})
    d = d.withColumn("peak_a", F.max("a").over(W.partitionBy(key)))
    sums = d.groupBy(key).agg(
        F.max("m").alias("peak_displacement"), F.max("v").alias("peak_velocity"), F.max("a").alias("peak_acceleration"),
        F.sqrt(F.avg(F.col("m") * F.col("m"))).alias("rms_displacement"), F.sqrt(F.avg(F.col("a") * F.col("a"))).alias("rms_acceleration"),
        (F.count(F.when(F.col("a") >= 0.1 * F.col("peak_a"), 1)) / rate).alias("strong_duration"),
    )
    return sums.join(diagnose(df, key), key).withColumn("feature_version", F.lit(VERSION))


def record_features(common: DataFrame, points: DataFrame, key: str = "record_id", causal: bool = False, derivatives: str = "local_polynomial", window: int = 9) -> DataFrame:
    """The whole feature row of each record, 31 columns: time base, common motion, spectrum, residuals, visibility and fit.

    ``common``: a row per frame with key, seq, t, x, y, inlier_ratio, fit_rmse, quality. ``points``: a row per
    frame and point with key, seq, point_id, visible, rx, ry. Missing and hidden points have no residual; a point
    is active in a frame where its residual exceeds three times the record's median. Each input is grouped by
    record in its own pass; the spectra are one FFT a record.
    """
    xy = common.withColumns({c: finite(F.col(c)) for c in ("x", "y")})
    if derivatives == "local_polynomial":
        order = lambda c: local_polynomial(xy, c, window, 3, key, centred=not causal, least=4).select(key, "seq", F.col("velocity").alias(f"v{c}"), F.col("acceleration").alias(f"a{c}"))
    elif derivatives == "backward":
        order = lambda c: backward(xy, c, key).select(key, "seq", F.col("velocity").alias(f"v{c}"), F.col("acceleration").alias(f"a{c}"))
    else:
        raise ValueError(f"unknown derivatives {derivatives}")
    moved = xy.join(order("x"), [key, "seq"], "left").join(order("y"), [key, "seq"], "left")
    moved = moved.withColumns({"m": norm(F.col("x"), F.col("y")), "v": norm(F.col("vx"), F.col("vy")), "a": norm(F.col("ax"), F.col("ay"))})
    moved = moved.withColumn("peak_a", F.max("a").over(W.partitionBy(key)))
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    sums = moved.groupBy(key).agg(
        F.min("t").alias("window_start"), F.max("t").alias("window_end"), F.max("m").alias("common_peak_displacement_px"), rms("m").alias("common_rms_displacement_px"), F.max("v").alias("common_peak_velocity_px_s"),
        F.max("a").alias("common_peak_acceleration_px_s2"), rms("a").alias("common_rms_acceleration_px_s2"), F.count(F.when(F.col("a") >= 0.1 * F.col("peak_a"), 1)).alias("_strong"),
        F.avg(finite(F.col("inlier_ratio"))).alias("mean_inlier_ratio"), F.avg(finite(F.col("fit_rmse"))).alias("mean_fit_rmse_px"), joined_flags(F.collect_set("quality")).alias("quality_flags"),
    )
    base = diagnose(common, key).select(key, F.col("sample_count").cast("int").alias("sample_count"), F.col("fps").alias("effective_fps"), F.col("rms_jitter").alias("timestamp_rms_jitter_s"), F.col("missing").cast("int").alias("estimated_missing_frames"))
    spectra = spectrum_features(common.join(base.select(key, F.col("effective_fps").alias("rate")), key), "x", "rate", key=key)
    residual = F.when(F.col("visible"), norm(finite(F.col("rx")), finite(F.col("ry"))))
    seen = points.select(key, "seq", "point_id", "visible", residual.alias("r"))
    middle = seen.groupBy(key).agg(F.greatest(F.coalesce(F.percentile("r", F.lit(0.5)), F.lit(0.0)), F.lit(1e-6)).alias("_middle"))
    frames = seen.join(middle, key).groupBy(key, "seq").agg(F.avg(F.coalesce((F.col("r") > 3 * F.col("_middle")).cast("int"), F.lit(0))).alias("active"), F.sum(F.col("visible").cast("int")).alias("shown"), F.count(F.lit(1)).alias("n"))
    framed = frames.groupBy(key).agg(F.avg("active").alias("active_object_fraction"), (F.sum("shown") / F.sum("n")).alias("mean_visibility"), F.avg("shown").alias("mean_active_track_count"))
    each = seen.groupBy(key, "point_id").agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms"))
    spread = each.groupBy(key).agg(F.percentile("rms", F.lit(0.5)).alias("residual_median_point_rms_px"), F.percentile("rms", F.lit(0.95)).alias("residual_p95_point_rms_px"), F.stddev_pop("rms").alias("residual_point_dispersion_px"))
    left = seen.groupBy(key).agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("residual_rms_px"), F.max("r").alias("residual_peak_px"))
    out = sums.join(base, key).join(spectra, key, "left").join(left, key, "left").join(spread, key, "left").join(framed, key, "left")
    named = {
        "feature_version": F.lit(VERSION), "feature_availability": F.lit("EVENT_END_CAUSAL_AGGREGATE_NOT_RUNNING" if causal else "OFFLINE_FULL_RECORD"),
        "common_dominant_frequency_hz": F.col("dominant_hz"), "common_energy_0p3_1_hz": F.col("band_0"), "common_energy_1_3_hz": F.col("band_1"), "common_energy_3_8_hz": F.col("band_2"),
        "strong_motion_duration_s": ratio(F.col("_strong").cast("double"), F.col("effective_fps")), "derivative_method": F.lit(derivatives), "causal": F.lit(int(causal)),
    }
    return out.withColumns(named).select(key, *RECORD_FEATURES)


#: The columns of a record's feature row, in order.
RECORD_FEATURES = [
    "feature_version", "feature_availability", "window_start", "window_end", "sample_count", "effective_fps", "timestamp_rms_jitter_s", "estimated_missing_frames",
    "common_peak_displacement_px", "common_rms_displacement_px", "common_peak_velocity_px_s", "common_peak_acceleration_px_s2", "common_rms_acceleration_px_s2", "common_dominant_frequency_hz",
    "common_energy_0p3_1_hz", "common_energy_1_3_hz", "common_energy_3_8_hz", "strong_motion_duration_s", "residual_rms_px", "residual_peak_px", "residual_median_point_rms_px", "residual_p95_point_rms_px",
    "residual_point_dispersion_px", "active_object_fraction", "mean_visibility", "mean_inlier_ratio", "mean_fit_rmse_px", "mean_active_track_count", "quality_flags", "derivative_method", "causal",
]


def residual_features(residuals: DataFrame, key: str = "frame") -> DataFrame:
    """Over all points' residual lengths: RMS, peak, and median, 95th percentile and population deviation of the points' own RMS."""
    whole = residuals.agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("residual_rms"), F.max("residual").alias("residual_peak"))
    each = residuals.groupBy("point_id").agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms"))
    spread = each.agg(F.percentile("rms", F.lit(0.5)).alias("point_rms_median"), F.percentile("rms", F.lit(0.95)).alias("point_rms_p95"), F.stddev_pop("rms").alias("point_rms_std"))
    return whole.crossJoin(spread)  # one row each


def active_fraction(all_points: DataFrame, residuals: DataFrame, key: str = "frame") -> DataFrame:
    """Per frame: the share of points whose residual exceeds three times the median of all; hidden points count as still."""
    median = residuals.agg(F.greatest(F.percentile("residual", F.lit(0.5)), F.lit(1e-6)).alias("median"))
    j = all_points.select(key, "point_id").join(residuals.select(key, "point_id", "residual"), [key, "point_id"], "left").crossJoin(F.broadcast(median))  # one row
    return j.groupBy(key).agg(F.avg(F.coalesce((F.col("residual") > 3 * F.col("median")).cast("int"), F.lit(0))).alias("active_fraction"))


def visibility_summary(tracks: DataFrame) -> DataFrame:
    """Per point: share of frames in which it is visible, and where it starts."""
    first = F.min(F.struct("frame", "x", "y")).alias("first")
    return tracks.groupBy("point_id").agg(F.avg(F.col("visible").cast("int")).alias("visible_fraction"), first).select("point_id", "visible_fraction", F.col("first.x").alias("start_x"), F.col("first.y").alias("start_y"))


def active_tracks(tracks: DataFrame) -> DataFrame:
    """Mean visibility over all points and frames, and mean number of visible points in a frame."""
    per = tracks.groupBy("frame").agg(F.sum(F.col("visible").cast("int")).alias("active"), F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum("active") / F.sum("n")).alias("mean_visibility"), F.avg("active").alias("mean_active_tracks"))


def quality_flags(df: DataFrame, flag: str, key: str = "record_id") -> DataFrame:
    """Per record: sorted distinct flags with bars between."""
    return df.groupBy(key).agg(joined_flags(F.collect_set(flag)).alias("quality_flags"))


def sensor_peaks(df: DataFrame, ew: str, ns: str, ud: str, key: str = "record_id") -> DataFrame:
    """Peak acceleration three ways: horizontal vector, largest component, whole vector."""
    e, n, u = F.col(ew), F.col(ns), F.col(ud)
    return df.groupBy(key).agg(
        F.max(norm(e, n)).alias("pga_horizontal"), F.max(F.greatest(F.abs(e), F.abs(n), F.abs(u))).alias("pga_component"), F.max(F.sqrt(e * e + n * n + u * u)).alias("pga_vector")
    )


def in_region(df: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Adds inside: whether the point lies in the box, edges included."""
    return df.withColumn("inside", F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def clipped_region(df: DataFrame, width: float, height: float) -> DataFrame:
    """Boxes (x0, y0, x1, y1) cut to the image; empty ones are marked."""
    c = lambda n, top: clip(F.col(n), 0, top)
    out = df.withColumns({"x0": c("x0", width), "x1": c("x1", width), "y0": c("y0", height), "y1": c("y1", height)})
    return out.withColumn("empty", (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")))


def to_millimetres(df: DataFrame, columns: list[str], mm_per_px: str = "mm_per_px") -> DataFrame:
    """Pixel columns times the scale; a row without a positive scale is an error, as lengths without one mean nothing."""
    scale = F.when(F.col(mm_per_px) > 0, F.col(mm_per_px)).otherwise(F.raise_error(F.lit("no geometric scale")))
    return df.withColumns({f"{c}_mm": F.col(c) * scale for c in columns})


def checked_points(points: DataFrame, width: float, height: float, expected: int | None = None) -> DataFrame:
    """Hand-picked points (x, y) as they are; an error if any is missing, not finite or outside the image, or if there are not as many as expected."""
    x, y = finite(F.col("x")), finite(F.col("y"))
    reason = F.when(x.isNull() | y.isNull(), "point is not finite").when((x < 0) | (x >= width), "x is outside the image").when((y < 0) | (y >= height), "y is outside the image")
    out = points.withColumns({c: F.when(reason.isNotNull(), F.raise_error(reason).cast("double")).otherwise(v) for c, v in (("x", x), ("y", y))})
    if expected is not None and (n := points.count()) != expected:
        raise ValueError(f"{n} points, not {expected}")
    return out
