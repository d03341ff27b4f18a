"""Motion common to a frame's points, what is left over, and how good the fit is.

Closed forms of least squares are ratios of sums over the points of a frame, so fits are one aggregate per
frame with the reference points broadcast (a fixed grid). Robust fits judge all least subsets of a frame's
points at once in numpy.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from itertools import combinations
from math import comb, radians

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import norm, ratio
from ..sources.staging import staged, unstage
from .ranges import last_before

#: Points that a model needs.
LEAST_POINTS = {"translation": 1, "similarity": 2, "affine": 3, "homography": 4}
#: Reference grids of more points than this are not broadcast.
BROADCAST_POINTS = 100_000


def matched(tracks: DataFrame, reference: DataFrame) -> DataFrame:
    """Visible points with their reference places."""
    small = reference.limit(BROADCAST_POINTS + 1).count() <= BROADCAST_POINTS
    return tracks.where("visible").join(F.broadcast(reference) if small else reference, "point_id")


def apply_transform(m: list[Column], x: Column, y: Column, eps: float = 1e-12) -> tuple[Column, Column]:
    """Place of a point under a 3 x 3 matrix of columns (row by row); null where it goes to infinity."""
    w = m[6] * x + m[7] * y + m[8]
    w = F.when(F.abs(w) > eps, w)
    return ratio(m[0] * x + m[1] * y + m[2], w), ratio(m[3] * x + m[4] * y + m[5], w)


def fit_translation(points: DataFrame, key: str = "frame") -> DataFrame:
    """Per frame: n, tx, ty."""
    return points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x") - F.col("x0")).alias("tx"), F.avg(F.col("y") - F.col("y0")).alias("ty"))


def fit_similarity(points: DataFrame, key: str = "frame") -> DataFrame:
    """Per frame: n, a, b, tx, ty of x = a x0 - b y0 + tx, y = b x0 + a y0 + ty, and rotation and scale. None where points coincide."""
    g = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x0").alias("mx0"), F.avg("y0").alias("my0"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        (F.var_pop("x0") + F.var_pop("y0")).alias("d"), (F.covar_pop("x0", "x") + F.covar_pop("y0", "y")).alias("p"), (F.covar_pop("x0", "y") - F.covar_pop("y0", "x")).alias("q"),
    )
    g = g.withColumns({"a": ratio(F.col("p"), F.col("d")), "b": ratio(F.col("q"), F.col("d"))})
    tx, ty = F.col("mx") - F.col("a") * F.col("mx0") + F.col("b") * F.col("my0"), F.col("my") - F.col("b") * F.col("mx0") - F.col("a") * F.col("my0")
    return g.select(key, "n", "a", "b", tx.alias("tx"), ty.alias("ty"), F.atan2("b", "a").alias("rotation"), norm(F.col("a"), F.col("b")).alias("scale"))


def fit_affine(points: DataFrame, key: str = "frame") -> DataFrame:
    """Per frame: n, and a, b, tx, c, d, ty of x = a x0 + b y0 + tx, y = c x0 + d y0 + ty. None where points lie on a line."""
    cov = lambda u, v: F.covar_pop(u, v)
    g = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in ("x0", "y0", "x", "y")],
        F.var_pop("x0").alias("xx"), F.var_pop("y0").alias("yy"), cov("x0", "y0").alias("xy"),
        cov("x0", "x").alias("xu"), cov("y0", "x").alias("yu"), cov("x0", "y").alias("xv"), cov("y0", "y").alias("yv"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    two = lambda p, q: (ratio(F.col(p) * F.col("yy") - F.col(q) * F.col("xy"), det), ratio(F.col(q) * F.col("xx") - F.col(p) * F.col("xy"), det))
    (a, b), (c, d) = two("xu", "yu"), two("xv", "yv")
    g = g.withColumns({"a": a, "b": b, "c": c, "d": d})
    tx, ty = F.col("mx") - F.col("a") * F.col("mx0") - F.col("b") * F.col("my0"), F.col("my") - F.col("c") * F.col("mx0") - F.col("d") * F.col("my0")
    return g.select(key, "n", "a", "b", tx.alias("tx"), "c", "d", ty.alias("ty"))


def decompose(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """Rotation, scale and shear of the linear part [[a, b], [c, d]]."""
    s0, s1 = norm(a, c), norm(b, d)
    return {"rotation": F.atan2(c, a), "scale": F.sqrt(s0 * s1), "shear": ratio(a * b + c * d, s0 * s1)}


def condition_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Ratio of the singular values of [[a, b], [c, d]]; null where it is singular."""
    total, det = a * a + b * b + c * c + d * d, F.abs(a * d - b * c)
    gap = F.sqrt(F.greatest(total * total - 4 * det * det, F.lit(0.0)))
    return ratio(total + gap, 2 * F.when(det > 0, det))


def residuals(points: DataFrame, fits: DataFrame, key: str = "frame") -> DataFrame:
    """Points with rx, ry, residual (length): what the frame's similarity leaves."""
    j = points.join(fits.select(key, "a", "b", "tx", "ty"), key)
    px, py = F.col("a") * F.col("x0") - F.col("b") * F.col("y0") + F.col("tx"), F.col("b") * F.col("x0") + F.col("a") * F.col("y0") + F.col("ty")
    j = j.withColumns({"rx": F.col("x") - px, "ry": F.col("y") - py})
    return j.withColumn("residual", norm(F.col("rx"), F.col("ry"))).select(key, "point_id", "rx", "ry", "residual")


def spatial_coverage(points: DataFrame, width: float, height: float, key: str = "frame") -> DataFrame:
    """Share of the image within the points' bounding box, 0 to 1; 0 for fewer than two points."""
    box = (F.max("x0") - F.min("x0")) * (F.max("y0") - F.min("y0")) / max(width * height, 1.0)
    return points.groupBy(key).agg(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.greatest(F.least(box, F.lit(1.0)), F.lit(0.0))).alias("coverage"))


def ransac_translation(points: DataFrame, threshold: float, key: str = "frame", digits: int = 9) -> DataFrame:
    """Every point's own shift is a candidate: the one with most points within ``threshold``, then least median error, then least point.

    Candidates and points of a frame meet in a join on the frame: n squared rows of a frame of n points, which
    the number of tracked points bounds. Returns frame, point_id (the candidate), n_inliers, median_error, tx,
    ty (the mean over its inliers).
    """
    shift = points.select(key, "point_id", (F.col("x") - F.col("x0")).alias("dx"), (F.col("y") - F.col("y0")).alias("dy"))
    cand = shift.select(key, F.col("point_id").alias("cand"), F.col("dx").alias("cx"), F.col("dy").alias("cy"))
    err = F.sqrt(F.pow(F.col("dx") - F.col("cx"), 2) + F.pow(F.col("dy") - F.col("cy"), 2))
    near = cand.join(shift, key).withColumn("err", err).where(F.col("err") <= threshold)
    scored = near.groupBy(key, "cand").agg(F.count(F.lit(1)).alias("n_inliers"), F.percentile("err", F.lit(0.5)).alias("median_error"), F.avg("dx").alias("tx"), F.avg("dy").alias("ty"))
    best = W.partitionBy(key).orderBy(F.col("n_inliers").desc(), F.round("median_error", digits), "cand")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").select(key, F.col("cand").alias("point_id"), "n_inliers", "median_error", "tx", "ty")


def quality_gate(fits: DataFrame, least_tracks: int = 10, least_inlier_ratio: float = 0.6, least_coverage: float = 0.08, most_rmse: float = 2.0, most_condition: float = 1e8, most_shift: float = 20.0, most_turn: float = radians(3.0), key: str | None = None, by: str = "frame") -> DataFrame:
    """Adds quality (GOOD, DEGRADED, INVALID) and reasons (bar-joined, invalid ones first).

    Jumps are against the last frame before that is not INVALID. Needs n, n_inliers, inlier_ratio, fit_rmse,
    condition, coverage, tx, ty, rotation; a null tx is a fit that failed. ``key`` parts the frames into records.
    """
    c = F.col
    none = F.lit(None).cast("string")
    # The names of the reasons and their order.
    missing = lambda x: x.isNull() | F.isnan(x)
    invalid = [
        F.when(c("n") < least_tracks, "insufficient_tracks").otherwise(none),
        F.when(c("n_inliers") < max(2, least_tracks // 2), "insufficient_inliers").otherwise(none),
        F.when(c("inlier_ratio") < least_inlier_ratio, "low_inlier_ratio").otherwise(none),
        F.when(missing(c("fit_rmse")) | (c("fit_rmse") > most_rmse), "high_fit_rmse").otherwise(none),
        F.when(missing(c("condition")) | (c("condition") > most_condition), "ill_conditioned_transform").otherwise(none),
    ]
    named = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    failed = missing(c("tx"))
    marked = fits.withColumn("_invalid", F.when(failed, F.array(F.lit("transform_fit_failed"))).otherwise(named(invalid)))
    sound = F.when(F.size("_invalid") == 0, F.struct("tx", "ty", "rotation"))
    marked = last_before(marked.withColumn("_now", sound), "_now", "_sound", by, key)
    marked = marked.withColumns({"_tx": c("_sound.tx"), "_ty": c("_sound.ty"), "_rot": c("_sound.rotation")})
    degraded = [
        F.when(c("coverage") < least_coverage, "poor_spatial_coverage").otherwise(none),
        F.when(norm(c("tx") - c("_tx"), c("ty") - c("_ty")) > most_shift, "translation_jump").otherwise(none),
        F.when(F.abs(c("rotation") - c("_rot")) > most_turn, "rotation_jump").otherwise(none),
    ]
    marked = marked.withColumn("_degraded", F.when(failed, F.array().cast("array<string>")).otherwise(named(degraded)))
    quality = F.when(F.size("_invalid") > 0, "INVALID").when(F.size("_degraded") > 0, "DEGRADED").otherwise("GOOD")
    return marked.withColumns({"quality": quality, "reasons": F.array_join(F.concat("_invalid", "_degraded"), "|")}).drop("_invalid", "_degraded", "_tx", "_ty", "_rot", "_now", "_sound")


def weighted_fits(model: str, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares matrices that take points a to b (N x 2), one for each row of weights (B x N), and the condition of each system of equations.

    Rows whose points do not fix a transform have NaN.
    """
    n = w.sum(1)
    out = np.full((len(w), 3, 3), np.nan)
    if model == "homography":
        x, y, u, v = a[:, 0], a[:, 1], b[:, 0], b[:, 1]
        one, zero = np.ones(len(a)), np.zeros(len(a))
        rows = np.stack([np.stack([-x, -y, -one, zero, zero, zero, u * x, u * y, u], 1), np.stack([zero, zero, zero, -x, -y, -one, v * x, v * y, v], 1)], 1)
        used = np.count_nonzero(w, axis=1)
        if len(w) and used.min() == used.max() and 0 < used[0] < len(a):  # points without weight are rows of zeros
            at = np.argsort(w == 0, axis=1, kind="stable")[:, : used[0]]
            system = (np.take_along_axis(w, at, 1)[:, :, None, None] * rows[at]).reshape(len(w), -1, 9)
        else:
            system = (w[:, :, None, None] * rows).reshape(len(w), -1, 9)
        _, values, vectors = np.linalg.svd(system, full_matrices=system.shape[1] < 9)
        values = np.pad(values, ((0, 0), (0, min(2 * len(a), 9) - values.shape[1])))
        h, least = vectors[:, -1].reshape(-1, 3, 3), values[:, min(values.shape[1], 9) - 1]
        sound = (np.abs(h[:, 2, 2]) > np.finfo(float).eps) & (n >= LEAST_POINTS[model])
        out[sound] = h[sound] / h[sound][:, 2:, 2:]
        return out, values[:, 0] / np.maximum(least, np.finfo(float).eps)
    out[:, 2] = [0, 0, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean_a, mean_b = w @ a / n[:, None], w @ b / n[:, None]
        if model == "translation":
            out[:, :2, :2], out[:, :2, 2] = np.eye(2), mean_b - mean_a
            return out, np.ones(len(w))
        p = a[None] - mean_a[:, None]
        cov = np.einsum("bn,bni,bnj->bij", w, p, p)  # of the places, and of places with what they go to
        both = np.einsum("bn,bni,nj->bij", w, p, b)
        if model == "similarity":
            size = cov[:, 0, 0] + cov[:, 1, 1]
            c, s = (both[:, 0, 0] + both[:, 1, 1]) / size, (both[:, 0, 1] - both[:, 1, 0]) / size
            linear = np.stack([np.stack([c, -s], -1), np.stack([s, c], -1)], -2)
            fixed = size > 1e-12 * n * (1 + (mean_a**2).sum(1))
            gram = np.zeros((len(w), 3, 3))  # has the extreme eigenvalues of the system's 4 x 4 products
            gram[:, 0, 0], gram[:, 1, 1], gram[:, 2, 2] = w @ (a * a).sum(1), n, n
            gram[:, 0, 1] = gram[:, 1, 0] = w @ a[:, 0]
            gram[:, 0, 2] = gram[:, 2, 0] = w @ a[:, 1]
        else:
            det = cov[:, 0, 0] * cov[:, 1, 1] - cov[:, 0, 1] ** 2
            inverse = np.stack([np.stack([cov[:, 1, 1], -cov[:, 0, 1]], -1), np.stack([-cov[:, 0, 1], cov[:, 0, 0]], -1)], -2) / det[:, None, None]
            linear = (inverse @ both).transpose(0, 2, 1)
            fixed = det > 1e-12 * (cov[:, 0, 0] * cov[:, 1, 1] + 1e-300)
            full = np.c_[a, np.ones(len(a))]
            gram = np.einsum("bn,ni,nj->bij", w, full, full)
        fixed &= n >= LEAST_POINTS[model]
        out[:, :2, :2], out[:, :2, 2] = linear, mean_b - np.einsum("bij,bj->bi", linear, mean_a)
        out[~fixed] = np.nan
        values = np.linalg.eigvalsh(gram)
        return out, np.sqrt(values[:, -1] / np.maximum(values[:, 0], 1e-300))


def exact_homographies(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of each row of zeros and four ones: the homography that takes its four points of a to b. Where these eight equations hardly fix it, as ``weighted_fits`` has it."""
    at = np.nonzero(w)[1].reshape(len(w), 4)
    (x, y), (u, v) = a[at].transpose(2, 0, 1), b[at].transpose(2, 0, 1)
    one, zero = np.ones_like(x), np.zeros_like(x)
    system = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], -1)], 1)
    out = np.full((len(w), 9), np.inf)
    with contextlib.suppress(np.linalg.LinAlgError):
        out = np.c_[np.linalg.solve(system, np.concatenate([u, v], 1)[..., None])[..., 0], np.ones(len(w))]
    with np.errstate(invalid="ignore"):
        loose = ~(np.abs(out).max(1) < 1e8)
    if loose.any():
        out[loose] = weighted_fits("homography", a, b, w[loose])[0].reshape(-1, 9)
    return out.reshape(-1, 3, 3)


def distances(m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far from b the points a end under each of the matrices (B x N)."""
    to = np.c_[a, np.ones(len(a))] @ m.transpose(0, 2, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        depth = np.where(np.abs(to[..., 2:]) > np.finfo(float).eps, to[..., 2:], np.nan)
        return np.linalg.norm(to[..., :2] / depth - b, axis=-1)


def least_subsets(n: int, k: int, tries: int, seed: int) -> np.ndarray:
    """Subsets of k of n as rows of zeros and ones: all of them, in order, if there are at most ``tries``, else that many, drawn by hashes of seed, try and point."""
    if comb(n, k) <= tries:
        chosen = np.array(list(combinations(range(n), k)), np.int64)
    else:
        with np.errstate(over="ignore"):
            x = (np.arange(tries, dtype=np.uint64)[:, None] + np.uint64(seed % (1 << 32)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(n, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
            for shift in (30, 27, 31):
                x = (x ^ x >> np.uint64(shift)) * np.uint64(0xD6E8FEB86659FD93)
        chosen = np.argpartition(x, k - 1, axis=1)[:, :k]
    w = np.zeros((len(chosen), n))
    np.put_along_axis(w, chosen, 1.0, 1)
    return w


def consensus(model: str, a: np.ndarray, b: np.ndarray, threshold: float = 1.5, tries: int = 128, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Matrix, inliers and condition of the transform that most points agree with; None where nothing fits.

    All least subsets are fitted and judged at once: most points within ``threshold``, then the least median error
    of these (to nine digits), then the first. The fit to its inliers, and to those of that fit if they are others, is the result.
    """
    k, n = LEAST_POINTS[model], len(a)
    if n < k:
        return None
    keep = np.ones(n, bool)
    if n > k:
        w = least_subsets(n, k, tries, seed)
        m = exact_homographies(a, b, w) if model == "homography" else weighted_fits(model, a, b, w)[0]
        error = distances(m, a, b)
        near = error <= threshold  # NaN is not
        count = near.sum(1)
        best = np.flatnonzero((count == count.max()) & ~np.isnan(m[:, 0, 0]))
        if len(best) and count.max() >= k:
            keep = near[best[np.argmin(np.round(np.nanmedian(np.where(near[best], error[best], np.nan), axis=1), 9))]]
    m, condition = weighted_fits(model, a, b, keep[None].astype(float))
    near = distances(m, a, b)[0] <= threshold
    if near.sum() >= k and (near != keep).any():
        keep = near
        m, condition = weighted_fits(model, a, b, keep[None].astype(float))
    if np.isnan(m).any():
        return None
    return m[0], keep, float(max(condition[0], np.linalg.cond(m[0][:2, :2])))


MATRIX = [f"m{i}{j}" for i in range(3) for j in range(3)]


def robust_motion(points: DataFrame, model: str = "similarity", threshold: float = 1.5, width: float = 1.0, height: float = 1.0, seed: int = 0, key: str = "frame", tries: int = 128) -> DataFrame:
    """Per frame, by consensus: n, n_inliers, inlier_ratio, fit_rmse, tx, ty, rotation, scale, shear, condition, coverage, the matrix m00 to m22, and the inliers' point_ids.

    A frame that no transform fits has nulls. The points of a frame are one row for a numpy kernel; rows of many
    frames share an Arrow batch.
    """
    names = ["inlier_ratio", "fit_rmse", "tx", "ty", "rotation", "scale", "shear", "condition", "coverage", *MATRIX]
    kinds = dict(points.dtypes)

    def of_frame(a: np.ndarray, b: np.ndarray, frame: int) -> tuple[np.ndarray, list[float]] | None:
        found = consensus(model, a, b, threshold, tries, seed + frame)
        if found is None:
            return None
        m, keep, condition = found
        error = distances(m[None], a, b)[0]
        s0, s1 = np.hypot(m[0, 0], m[1, 0]), np.hypot(m[0, 1], m[1, 1])
        box = np.ptp(a[keep], axis=0).prod() / max(width * height, 1.0) if keep.sum() > 1 else 0.0
        shear = (m[0, 0] * m[0, 1] + m[1, 0] * m[1, 1]) / max(s0 * s1, np.finfo(float).eps)
        return keep, [keep.mean(), np.sqrt((error[keep] ** 2).mean()), m[0, 2], m[1, 2], np.arctan2(m[1, 0], m[0, 0]), np.sqrt(s0 * s1), shear, condition, min(max(box, 0.0), 1.0), *m.ravel()]

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames, lists = batch.column(0), batch.column(1)
            offsets = np.asarray(lists.offsets)
            xy = {c: np.asarray(lists.values.field(c)) for c in ("point_id", "x0", "y0", "x", "y")}
            n, n_in, inliers, values = [], [], [], []
            for frame, i, j in zip(frames.to_pylist(), offsets, offsets[1:], strict=False):
                a, b = np.c_[xy["x0"][i:j], xy["y0"][i:j]], np.c_[xy["x"][i:j], xy["y"][i:j]]
                got = of_frame(a, b, int(frame or 0))
                n.append(j - i)
                n_in.append(int(got[0].sum()) if got else 0)
                inliers.append(xy["point_id"][i:j][got[0]] if got else [])
                values.append(got[1] if got else [None] * len(names))
            columns = [frames, pa.array(n, pa.int64()), pa.array(n_in, pa.int64()), pa.array(inliers, pa.list_(lists.values.field("point_id").type)), *[pa.array(x, pa.float64()) for x in zip(*values, strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n", "n_inliers", "inliers", *names])

    fields = [F.col("point_id"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x", "y")]]
    rows = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("points"))
    return rows.mapInArrow(fitted, f"{key} {kinds[key]}, n long, n_inliers long, inliers array<{kinds['point_id']}>, " + ", ".join(f"{x} double" for x in names))


def decompose_tracks(tracks: DataFrame, reference: DataFrame, model: str = "similarity", threshold: float = 1.5, width: float = 1.0, height: float = 1.0, seed: int = 0, tries: int = 128, record: str | None = None, **gate) -> tuple[DataFrame, DataFrame]:
    """Common motion by robust fits, what it leaves of every visible point, and the frames' quality.

    Returns frames (``robust_motion`` with quality and reasons; a frame without a fit is INVALID for
    ``transform_fit_failed``) and points (frame, point_id, rx, ry, residual, inlier; null where the frame has no fit).
    ``gate``: thresholds of ``quality_gate``; its jumps are within a ``record`` where that is given.
    """
    points = matched(tracks, reference)
    frames = robust_motion(points, model, threshold, width, height, seed, tries=tries)
    every = tracks.select("frame", *([record] if record else [])).distinct().join(frames, "frame", "left")
    judged = quality_gate(every.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "n_inliers")}), key=record, **gate)
    moved = points.join(frames.select("frame", "inliers", *MATRIX), "frame")
    px, py = apply_transform([F.col(c) for c in MATRIX], F.col("x0"), F.col("y0"))
    moved = moved.withColumns({"rx": F.col("x") - px, "ry": F.col("y") - py})
    return judged, moved.select("frame", "point_id", "rx", "ry", norm(F.col("rx"), F.col("ry")).alias("residual"), F.array_contains("inliers", F.col("point_id")).alias("inlier"))


def per_cell_top(points: DataFrame, cell: float, quota: int, strength: str = "response") -> DataFrame:
    """The ``quota`` strongest points of each square cell; of equals the least point."""
    w = W.partitionBy("cell_x", "cell_y").orderBy(F.col(strength).desc(), "point_id")
    cells = points.withColumns({"cell_x": F.floor(F.col("x") / cell), "cell_y": F.floor(F.col("y") / cell)})
    return cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= quota)


def spaced(points: DataFrame, least: float, group: str, strength: str = "response") -> DataFrame:
    """Greedily, strongest first, points at least ``least`` apart within each group: group, point_id."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([strength, "point_id"], ascending=[False, True])
        xy, kept = rows[["x", "y"]].to_numpy(float), []
        for i in range(len(xy)):
            if not kept or (np.hypot(*(xy[kept] - xy[i]).T) >= least).all():
                kept.append(i)
        return rows.iloc[kept][[group, "point_id"]]

    kinds = dict(points.dtypes)
    return points.select(group, "point_id", "x", "y", strength).groupBy(group).applyInPandas(kernel, f"{group} {kinds[group]}, point_id {kinds['point_id']}")


def _chosen_by_rounds(undecided: DataFrame, least: float, group: str, quota: int | None) -> DataFrame:
    """The points that ``selected_points`` keeps, of groups of any size, by rounds over all groups at once.

    Points lie in squares so small that two of one square are always too near; a
    square's strongest undecided point is kept once no stronger undecided point is too near and its cell's quota cannot be
    filled by stronger ones; what a kept point rules out goes. A point meets the one candidate of each of 25 squares, so work is
    linear in the points of a round, however they crowd, and the strongest point of all is always decided.
    """
    side = least / 1.4143
    undecided = undecided.withColumns({"u": F.floor(F.col("x") / side), "v": F.floor(F.col("y") / side)})
    state = staged(undecided.withColumns({"state": F.lit(0), "round": F.lit(0)}), "points")
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3)])).alias("d")
    square = [group, "u", "v"]
    ahead = lambda one, two: (F.col(f"{one}s") > F.col(f"{two}s")) | ((F.col(f"{one}s") == F.col(f"{two}s")) & (F.col(f"{one}point_id") < F.col(f"{two}point_id")))

    def around(rows: DataFrame, centres: DataFrame) -> DataFrame:
        """Each of ``rows`` with the centres (one a square, columns c_) that are too near it, itself left out."""
        spread = rows.select(*rows.columns, near).withColumns({"_u": F.col("u") + F.col("d.a"), "_v": F.col("v") + F.col("d.b")}).drop("d")
        named = centres.select(*[F.col(c).alias(f"c_{c}") for c in (group, "point_id", "x", "y", "s", "u", "v")])
        hit = spread.join(named, (F.col(group) == F.col(f"c_{group}")) & (F.col("_u") == F.col("c_u")) & (F.col("_v") == F.col("c_v")) & (F.col("point_id") != F.col("c_point_id")))
        return hit.where(F.hypot(F.col("x") - F.col("c_x"), F.col("y") - F.col("c_y")) < least)

    number = 0
    while True:
        number += 1
        order = [F.col("s").desc(), "point_id"]
        if quota:
            w = W.partitionBy(group, "cx", "cy").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
            alive = state.where("state >= 0").withColumns({"full": F.coalesce(F.sum("state").over(w), F.lit(0)), "ahead": F.count(F.lit(1)).over(w)})
        else:
            alive = state.where("state >= 0").withColumns({"full": F.lit(0), "ahead": F.lit(-1)})
        limit = quota or 1
        open_ = alive.where((F.col("state") == 0) & (F.col("full") < limit))
        first = open_.withColumn("r", F.row_number().over(W.partitionBy(*square).orderBy(*order))).where("r = 1").drop("r")
        blocked = around(open_, first).where(ahead("", "c_")).select(F.col(f"c_{group}").alias(group), F.col("c_point_id").alias("point_id")).distinct()
        kept = staged(first.where(F.col("ahead") < limit).join(blocked, [group, "point_id"], "left_anti").select(*[c for c in state.columns]), "kept")
        if not kept.count():
            # every open point waits for a quota: those that can no longer be in it have gone, so none is left
            break
        gone = around(open_, kept).select(group, "point_id").distinct().withColumn("now", F.lit(-1))
        marks = gone.unionByName(kept.select(group, "point_id", F.lit(1).alias("now")))
        full = alive.where((F.col("state") == 0) & (F.col("full") >= limit)).select(group, "point_id", F.lit(-1).alias("now"))
        marks = marks.unionByName(full).groupBy(group, "point_id").agg(F.max("now").alias("now"))
        after = state.where("state >= 0").join(marks, [group, "point_id"], "left").withColumns({"state": F.coalesce("now", "state"), "round": F.when(F.col("now") == 1, number).otherwise(F.col("round"))}).drop("now").where("state >= 0")
        last, state = state, staged(after, "points")
        unstage(last, kept)
    return state.where("state = 1")


def _cells(*columns: pa.Array) -> np.ndarray:
    """A number for each row, the same for equal rows; null is a value."""
    parts = [np.asarray(c.fill_null(0)) for c in columns] + [np.asarray(c.is_null()) for c in columns]
    return np.unique(np.stack(parts, 1), axis=0, return_inverse=True)[1].reshape(-1)


def _chosen_by_group(undecided: DataFrame, least: float, group: str, quota: int | None, target: int | None) -> DataFrame:
    """The points that ``selected_points`` keeps, in their order, a group's points being one row for a numpy kernel: group, point_id, order, complete."""
    kinds = dict(undecided.dtypes)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = np.asarray(lists.offsets)
            x, y = (lists.values.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
            cells = _cells(lists.values.field("cx"), lists.values.field("cy")) if quota and len(x) else None
            at, places, chosen, whole = [], [], [], []
            for g, (i, j) in enumerate(zip(offsets, offsets[1:], strict=False)):
                left, kept, filled = np.ones(j - i, bool), [], {}
                px, py = x[i:j], y[i:j]
                while left.any() and (not target or len(kept) < target):
                    k = int(left.argmax())
                    kept.append(k)
                    with np.errstate(invalid="ignore"):
                        left &= ~(np.hypot(px - px[k], py - py[k]) < least)
                    left[k] = False
                    if quota:
                        c = cells[i + k]
                        filled[c] = filled.get(c, 0) + 1
                        if filled[c] >= quota:
                            left &= cells[i:j] != c
                at += [g] * len(kept)
                places += [i + k for k in kept]
                chosen += range(1, len(kept) + 1)
                whole += [not target or len(kept) >= target] * len(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), lists.values.field("point_id").take(pa.array(places, pa.int64())), pa.array(chosen, pa.int32()), pa.array(whole, pa.bool_())], names=[group, "point_id", "order", "complete"])

    order = [F.col("s").isNull().alias("a"), (~F.isnan(F.col("s").cast("double"))).alias("b"), (-F.col("s")).alias("c")]  # the strongest first, NaN above all, null last
    rows = undecided.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, "point_id", "x", "y", "cx", "cy"))).alias("points"))
    return rows.mapInArrow(kernel, f"{group} {kinds[group]}, point_id {kinds['point_id']}, order int, complete boolean")


def selected_points(points: DataFrame, least: float, group: str, cell: float | None = None, quota: int | None = None, target: int | None = None, strength: str = "response", whole: int = 2048) -> DataFrame:
    """Points that a greedy choice keeps, the strongest first: group, point_id, order (from 1), complete.

    A point is kept if it is ``least`` or more from every kept one of its group and, with ``cell`` and ``quota``, if fewer than
    ``quota`` of its square cell are kept; the first ``target`` kept ones of a group are returned, and complete says whether there
    are as many. Of equal strength the lesser point_id comes first.

    Groups of up to ``whole`` points are chosen from by themselves, each in a task; larger ones go by rounds over all their points.
    """
    undecided = points.select(group, "point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(strength).alias("s"))
    undecided = undecided.withColumns({"cx": F.floor(F.col("x") / cell) if cell else F.lit(0).cast("long"), "cy": F.floor(F.col("y") / cell) if cell else F.lit(0).cast("long")})
    large = staged(undecided.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole).select(group), "large-groups")
    if large.isEmpty():
        unstage(large)
        return _chosen_by_group(undecided, least, group, quota, target)
    small = _chosen_by_group(undecided.join(large, group, "left_anti"), least, group, quota, target)
    chosen = _chosen_by_rounds(undecided.join(large, group, "left_semi"), least, group, quota)
    ranked = chosen.withColumn("order", F.row_number().over(W.partitionBy(group).orderBy(F.col("s").desc(), "point_id")))
    if target:
        ranked = ranked.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(group))).where(F.col("order") <= target)
    ranked = ranked.select(group, "point_id", "order", (F.col("_n") >= target).alias("complete") if target else F.lit(True).alias("complete"))
    return small.unionByName(ranked)
