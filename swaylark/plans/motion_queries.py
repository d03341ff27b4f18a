"""Queries over tracked points (embeddings as frames of 32 points)."""

from __future__ import annotations

from math import radians

from pyspark.sql import functions as F

from ..functions import norm, tidy, wrapped
from ..operators import features, generators, geometry, reseed
from ..sources import adapters as A
from .registry import query
from .signal_queries import rounded

M = f"WITH {A.TRACKS}, m AS (SELECT frame, point_id, x, y, x0, y0 FROM tracks JOIN ref USING (point_id) WHERE visible)"


def _points(spark, sf_dir):
    t = A.tracks(spark, sf_dir)
    return t, geometry.matched(t, A.reference_points(t))


@query(f"{M} SELECT frame, count(*) AS n, round(avg(x - x0), 6) + 0.0::DOUBLE AS tx, round(avg(y - y0), 6) + 0.0::DOUBLE AS ty FROM m GROUP BY 1")
def common_translation(spark, sf_dir):
    return rounded(geometry.fit_translation(_points(spark, sf_dir)[1]), ["tx", "ty"])


SIM = """s0 AS (SELECT frame, count(*) AS n, avg(x0) AS mx0, avg(y0) AS my0, avg(x) AS mx, avg(y) AS my, var_pop(x0) + var_pop(y0) AS d, covar_pop(x0, x) + covar_pop(y0, y) AS p, covar_pop(x0, y) - covar_pop(y0, x) AS q FROM m GROUP BY 1),
s1 AS (SELECT *, p / nullif(d, 0) AS a, q / nullif(d, 0) AS b FROM s0), sim AS (SELECT frame, n, a, b, mx - a * mx0 + b * my0 AS tx, my - b * mx0 - a * my0 AS ty, atan2(b, a) AS rotation, sqrt(a * a + b * b) AS scale FROM s1)"""


@query(f"{M}, {SIM} SELECT frame, n, round(a, 6) + 0.0::DOUBLE AS a, round(b, 6) + 0.0::DOUBLE AS b, round(tx, 6) + 0.0::DOUBLE AS tx, round(ty, 6) + 0.0::DOUBLE AS ty, round(rotation, 6) + 0.0::DOUBLE AS rotation, round(scale, 6) AS scale FROM sim")
def common_similarity(spark, sf_dir):
    return rounded(geometry.fit_similarity(_points(spark, sf_dir)[1]), ["a", "b", "tx", "ty", "rotation", "scale"])


AFF = """a0 AS (SELECT frame, count(*) AS n, avg(x0) AS mx0, avg(y0) AS my0, avg(x) AS mx, avg(y) AS my, var_pop(x0) AS xx, var_pop(y0) AS yy, covar_pop(x0, y0) AS xy, covar_pop(x0, x) AS xu, covar_pop(y0, x) AS yu, covar_pop(x0, y) AS xv, covar_pop(y0, y) AS yv FROM m GROUP BY 1),
a1 AS (SELECT *, nullif(xx * yy - xy * xy, 0) AS det FROM a0),
a2 AS (SELECT *, (xu * yy - yu * xy) / det AS a, (yu * xx - xu * xy) / det AS b, (xv * yy - yv * xy) / det AS c, (yv * xx - xv * xy) / det AS d FROM a1),
aff AS (SELECT frame, n, a, b, mx - a * mx0 - b * my0 AS tx, c, d, my - c * mx0 - d * my0 AS ty FROM a2)"""


@query(f"{M}, {AFF} SELECT frame, n, " + ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in ("a", "b", "tx", "c", "d", "ty")) + " FROM aff")
def common_affine(spark, sf_dir):
    return rounded(geometry.fit_affine(_points(spark, sf_dir)[1]), ["a", "b", "tx", "c", "d", "ty"])


@query(f"""{M}, {AFF}, z AS (SELECT *, sqrt(a * a + c * c) AS s0, sqrt(b * b + d * d) AS s1, a * a + b * b + c * c + d * d AS total, abs(a * d - b * c) AS ad FROM aff)
SELECT frame, round(atan2(c, a), 6) + 0.0::DOUBLE AS rotation, round(sqrt(s0 * s1), 6) AS scale, round((a * b + c * d) / nullif(s0 * s1, 0), 6) + 0.0::DOUBLE AS shear,
       round((total + sqrt(greatest(total * total - 4 * ad * ad, 0))) / (2 * nullif(ad, 0)), 4) AS condition FROM z""")
def affine_decomposition(spark, sf_dir):
    f = geometry.fit_affine(_points(spark, sf_dir)[1])
    abcd = [F.col(c) for c in "abcd"]
    parts = geometry.decompose(*abcd) | {"condition": geometry.condition_2x2(*abcd)}
    return f.select("frame", *[tidy(v, 4 if k == "condition" else 6).alias(k) for k, v in parts.items()])


@query(f"""{M}, {AFF} SELECT frame, point_id, round(a * x0 + b * y0 + tx, 6) + 0.0::DOUBLE AS px, round(c * x0 + d * y0 + ty, 6) + 0.0::DOUBLE AS py FROM m JOIN aff USING (frame)""")
def transformed_points(spark, sf_dir):
    points = _points(spark, sf_dir)[1]
    j = points.join(geometry.fit_affine(points), "frame")
    m = [F.col(c) for c in ("a", "b", "tx", "c", "d", "ty")] + [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    px, py = geometry.apply_transform(m, F.col("x0"), F.col("y0"))
    return j.select("frame", "point_id", tidy(px).alias("px"), tidy(py).alias("py"))


RES = """res AS (SELECT frame, point_id, x - (a * x0 - b * y0 + tx) AS rx, y - (b * x0 + a * y0 + ty) AS ry FROM m JOIN sim USING (frame)), rs AS (SELECT *, sqrt(rx * rx + ry * ry) AS residual FROM res)"""


@query(f"{M}, {SIM}, {RES} SELECT frame, point_id, round(rx, 6) + 0.0::DOUBLE AS rx, round(ry, 6) + 0.0::DOUBLE AS ry, round(residual, 6) AS residual FROM rs WHERE frame > 0")
def residual_motion(spark, sf_dir):
    points = _points(spark, sf_dir)[1]
    r = geometry.residuals(points, geometry.fit_similarity(points)).where("frame > 0")
    return rounded(r, ["rx", "ry", "residual"])


@query(f"""{M}, {SIM}, {RES}, e AS (SELECT point_id, sqrt(avg(residual * residual)) AS rms FROM rs GROUP BY 1)
SELECT round((SELECT sqrt(avg(residual * residual)) FROM rs), 6) AS residual_rms, round((SELECT max(residual) FROM rs), 6) AS residual_peak,
       round(quantile_cont(rms, 0.5), 6) AS point_rms_median, round(quantile_cont(rms, 0.95), 6) AS point_rms_p95, round(stddev_pop(rms), 6) AS point_rms_std FROM e""")
def point_dispersion(spark, sf_dir):
    points = _points(spark, sf_dir)[1]
    r = features.residual_features(geometry.residuals(points, geometry.fit_similarity(points)))
    return rounded(r, r.columns)


@query(f"""{M}, {SIM}, {RES}, q AS (SELECT greatest(quantile_cont(round(residual, 9), 0.5), 1e-6) AS m FROM rs)
SELECT t.frame, round(avg(coalesce((round(residual, 9) > 3 * m)::INT, 0)), 9) AS active_fraction FROM tracks t LEFT JOIN rs ON rs.frame = t.frame AND rs.point_id = t.point_id, q GROUP BY 1""")
def active_fraction(spark, sf_dir):
    t, points = _points(spark, sf_dir)
    r = rounded(geometry.residuals(points, geometry.fit_similarity(points)), ["residual"], 9)
    return rounded(features.active_fraction(t, r), ["active_fraction"], 9)


@query(f"""WITH {A.TRACKS}, p AS (SELECT frame, sum(visible::INT) AS a, count(*) AS n FROM tracks GROUP BY 1)
SELECT round(sum(a) / sum(n), 9) AS mean_visibility, round(avg(a), 6) AS mean_active_tracks FROM p""")
def visibility(spark, sf_dir):
    return rounded(rounded(features.active_tracks(A.tracks(spark, sf_dir)), ["mean_visibility"], 9), ["mean_active_tracks"])


@query(f"WITH {A.TRACKS} SELECT point_id, round(avg(visible::INT), 9) AS visible_fraction, round(arg_min(x, frame), 6) AS start_x, round(arg_min(y, frame), 6) AS start_y FROM tracks GROUP BY 1")
def tracks_summary(spark, sf_dir):
    return rounded(rounded(features.visibility_summary(A.tracks(spark, sf_dir)), ["visible_fraction"], 9), ["start_x", "start_y"])


@query(f"{M} SELECT frame, round(CASE WHEN count(*) < 2 THEN 0 ELSE greatest(least((max(x0) - min(x0)) * (max(y0) - min(y0)) / 5000.0::DOUBLE, 1), 0) END, 9) AS coverage FROM m GROUP BY 1")
def spatial_coverage(spark, sf_dir):
    return rounded(geometry.spatial_coverage(_points(spark, sf_dir)[1], 100.0, 50.0), ["coverage"], 9)


@query(f"""{M}, sh AS (SELECT frame, point_id, x - x0 AS dx, y - y0 AS dy FROM m),
e AS (SELECT c.frame, c.point_id AS cand, s.dx, s.dy, sqrt((s.dx - c.dx) ** 2 + (s.dy - c.dy) ** 2) AS err FROM sh c JOIN sh s ON s.frame = c.frame),
k AS (SELECT frame, cand, count(*) AS n_inliers, quantile_cont(err, 0.5) AS median_error, avg(dx) AS tx, avg(dy) AS ty FROM e WHERE err <= 10 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n_inliers DESC, round(median_error, 9), cand) AS r FROM k)
SELECT frame, cand AS point_id, n_inliers, round(median_error, 6) AS median_error, round(tx, 6) + 0.0::DOUBLE AS tx, round(ty, 6) + 0.0::DOUBLE AS ty FROM r WHERE r = 1""")
def ransac_translation(spark, sf_dir):
    return rounded(geometry.ransac_translation(_points(spark, sf_dir)[1], 10.0), ["median_error", "tx", "ty"])


def _gated(spark, sf_dir):
    points = _points(spark, sf_dir)[1]
    fits = geometry.fit_similarity(points)
    res = geometry.residuals(points, fits).groupBy("frame").agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("fit_rmse"), F.sum((F.col("residual") <= 12).cast("int")).alias("n_inliers"))
    j = fits.join(res, "frame").join(geometry.spatial_coverage(points, 100.0, 50.0), "frame")
    j = j.withColumns({"inlier_ratio": F.col("n_inliers") / F.col("n"), "condition": F.lit(1.0)})
    return rounded(j, ["fit_rmse", "tx", "ty", "rotation"])


@query(f"""{M}, {SIM}, {RES}, fr AS (SELECT frame, round(sqrt(avg(residual * residual)), 6) AS fit_rmse, sum((residual <= 12)::INT) AS n_inliers FROM rs GROUP BY 1),
cv AS (SELECT frame, greatest(least((max(x0) - min(x0)) * (max(y0) - min(y0)) / 5000.0::DOUBLE, 1), 0) AS coverage FROM m GROUP BY 1),
j AS (SELECT frame, n, n_inliers, n_inliers::DOUBLE / n AS ir, fit_rmse, coverage, round(tx, 6) AS tx, round(ty, 6) AS ty, round(rotation, 6) AS rot FROM sim JOIN fr USING (frame) JOIN cv USING (frame)),
i AS (SELECT *, list_filter([CASE WHEN n < 10 THEN 'insufficient_tracks' END, CASE WHEN n_inliers < 5 THEN 'insufficient_inliers' END, CASE WHEN ir < 0.5 THEN 'low_inlier_ratio' END,
      CASE WHEN fit_rmse IS NULL OR fit_rmse > 14 THEN 'high_fit_rmse' END], lambda z: z IS NOT NULL) AS inv FROM j),
p AS (SELECT *, last_value(CASE WHEN len(inv) = 0 THEN tx END IGNORE NULLS) OVER w AS ptx, last_value(CASE WHEN len(inv) = 0 THEN ty END IGNORE NULLS) OVER w AS pty, last_value(CASE WHEN len(inv) = 0 THEN rot END IGNORE NULLS) OVER w AS prot
      FROM i WINDOW w AS (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, list_filter([CASE WHEN coverage < 0.08 THEN 'poor_spatial_coverage' END, CASE WHEN sqrt((tx - ptx) ** 2 + (ty - pty) ** 2) > 5 THEN 'translation_jump' END,
      CASE WHEN abs(rot - prot) > {radians(3.0)!r} THEN 'rotation_jump' END], lambda z: z IS NOT NULL) AS deg FROM p)
SELECT frame, CASE WHEN len(inv) > 0 THEN 'INVALID' WHEN len(deg) > 0 THEN 'DEGRADED' ELSE 'GOOD' END AS quality, coalesce(array_to_string(list_concat(inv, deg), '|'), '') AS reasons FROM d""")
def motion_quality_gate(spark, sf_dir):
    return geometry.quality_gate(_gated(spark, sf_dir), least_inlier_ratio=0.5, most_rmse=14.0, most_shift=5.0).select("frame", "quality", "reasons")


ROBUST = ["inlier_ratio", "fit_rmse", "tx", "ty", "rotation", "scale", "shear", "coverage"]
TRIES = 512  # more than all pairs of 32 points, so that SQL can go through all of them too


def _robust(model):
    def run(spark, sf_dir):
        points = _points(spark, sf_dir)[1]
        r = geometry.robust_motion(points, model, 10.0, 100.0, 50.0, tries=TRIES)
        return rounded(r, ROBUST).select("frame", "n", "n_inliers", *ROBUST)

    run.__name__ = f"robust_{model}"
    return run


def _refit_sql(out: str, source: str) -> str:
    """The similarity of the rows of ``source`` by frame, and all of a frame's points with their errors under it."""
    return f"""{out}_s AS (SELECT frame, avg(x0) AS mx0, avg(y0) AS my0, avg(x) AS mx, avg(y) AS my, var_pop(x0) + var_pop(y0) AS d, covar_pop(x0, x) + covar_pop(y0, y) AS p, covar_pop(x0, y) - covar_pop(y0, x) AS q FROM {source} GROUP BY 1),
{out}_t AS (SELECT frame, p / d AS a, q / d AS b, mx - p / d * mx0 + q / d * my0 AS tx, my - q / d * mx0 - p / d * my0 AS ty FROM {out}_s),
{out} AS (SELECT m.*, a, b, tx, ty, sqrt((x - (a * x0 - b * y0 + tx)) ** 2 + (y - (b * x0 + a * y0 + ty)) ** 2) AS e FROM m JOIN {out}_t USING (frame))"""


ROBUST_SQL = f"""{M},
pairs AS (SELECT i.frame, i.point_id AS p, j.point_id AS q, (j.x0 - i.x0) AS dx, (j.y0 - i.y0) AS dy, (j.x - i.x) AS ux, (j.y - i.y) AS uy, i.x0 AS ix, i.y0 AS iy, i.x AS iu, i.y AS iv FROM m i JOIN m j ON i.frame = j.frame AND i.point_id < j.point_id),
fits AS (SELECT *, (dx * ux + dy * uy) / (dx * dx + dy * dy) AS a, (dx * uy - dy * ux) / (dx * dx + dy * dy) AS b FROM pairs WHERE dx * dx + dy * dy > 0),
errs AS (SELECT f.frame, f.p, f.q, sqrt((m.x - (iu + a * (m.x0 - ix) - b * (m.y0 - iy))) ** 2 + (m.y - (iv + b * (m.x0 - ix) + a * (m.y0 - iy))) ** 2) AS e, m.point_id FROM fits f JOIN m USING (frame)),
scored AS (SELECT frame, p, q, count(*) AS n, round(quantile_cont(e, 0.5), 9) AS med FROM errs WHERE e <= 10 GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n DESC, med, p, q) AS r FROM scored),
keep0 AS (SELECT m.* FROM best b JOIN errs e ON e.frame = b.frame AND e.p = b.p AND e.q = b.q AND e.e <= 10 JOIN m ON m.frame = e.frame AND m.point_id = e.point_id WHERE b.r = 1),
{_refit_sql("fit1", "keep0")}, keep1 AS (SELECT * EXCLUDE (a, b, tx, ty, e) FROM fit1 WHERE e <= 10), few AS (SELECT frame FROM fit1 GROUP BY 1 HAVING count(*) FILTER (e <= 10) < 2),
keep AS (SELECT * FROM keep1 WHERE frame NOT IN (SELECT frame FROM few) UNION ALL SELECT * FROM keep0 WHERE frame IN (SELECT frame FROM few)),
{_refit_sql("fit2", "keep")}, sums AS (SELECT f.frame, count(*) AS n, count(k.point_id) AS n_inliers, any_value(a) AS a, any_value(b) AS b, any_value(f.tx) AS tx, any_value(f.ty) AS ty, sqrt(avg(e * e) FILTER (k.point_id IS NOT NULL)) AS rmse,
  (max(k.x0) - min(k.x0)) * (max(k.y0) - min(k.y0)) / 5000.0::DOUBLE AS cover FROM fit2 f LEFT JOIN keep k ON k.frame = f.frame AND k.point_id = f.point_id GROUP BY 1)"""

query(f"""{ROBUST_SQL} SELECT frame, n, n_inliers, round(n_inliers::DOUBLE / n, 6) AS inlier_ratio, round(rmse, 6) AS fit_rmse, round(tx, 6) + 0.0::DOUBLE AS tx, round(ty, 6) + 0.0::DOUBLE AS ty, round(atan2(b, a), 6) + 0.0::DOUBLE AS rotation,
       round(sqrt(a * a + b * b), 6) AS scale, 0.0::DOUBLE AS shear, round(greatest(least(cover, 1), 0), 6) AS coverage FROM sums""")(_robust("similarity"))
for _model in ("affine", "homography"):
    query()(_robust(_model))


GATE = {"least_inlier_ratio": 0.5, "most_rmse": 7.0, "most_shift": 5.0}


def _decomposed(spark, sf_dir):
    t = A.tracks(spark, sf_dir)
    return geometry.decompose_tracks(t, A.reference_points(t), "similarity", 10.0, 100.0, 50.0, tries=TRIES, **GATE)


@query(f"""{ROBUST_SQL}, g AS (SELECT frame, n, n_inliers, n_inliers::DOUBLE / n AS ir, rmse, greatest(least(cover, 1), 0) AS coverage, tx, ty, atan2(b, a) AS rot FROM sums),
i AS (SELECT *, list_filter([CASE WHEN n < 10 THEN 'insufficient_tracks' END, CASE WHEN n_inliers < 5 THEN 'insufficient_inliers' END, CASE WHEN ir < 0.5 THEN 'low_inlier_ratio' END, CASE WHEN rmse > 7 THEN 'high_fit_rmse' END], lambda z: z IS NOT NULL) AS inv FROM g),
p AS (SELECT *, last_value(CASE WHEN len(inv) = 0 THEN tx END IGNORE NULLS) OVER w AS ptx, last_value(CASE WHEN len(inv) = 0 THEN ty END IGNORE NULLS) OVER w AS pty, last_value(CASE WHEN len(inv) = 0 THEN rot END IGNORE NULLS) OVER w AS prot
      FROM i WINDOW w AS (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, list_filter([CASE WHEN coverage < 0.08 THEN 'poor_spatial_coverage' END, CASE WHEN sqrt((tx - ptx) ** 2 + (ty - pty) ** 2) > 5 THEN 'translation_jump' END,
      CASE WHEN abs(rot - prot) > {radians(3.0)!r} THEN 'rotation_jump' END], lambda z: z IS NOT NULL) AS deg FROM p)
SELECT frame, n_inliers, CASE WHEN len(inv) > 0 THEN 'INVALID' WHEN len(deg) > 0 THEN 'DEGRADED' ELSE 'GOOD' END AS quality, coalesce(array_to_string(list_concat(inv, deg), '|'), '') AS reasons FROM d""")
def decompose_tracks(spark, sf_dir):
    return _decomposed(spark, sf_dir)[0].select("frame", "n_inliers", "quality", "reasons")


@query(f"""{ROBUST_SQL} SELECT f.frame, f.point_id, round(f.x - (a * f.x0 - b * f.y0 + tx), 6) + 0.0::DOUBLE AS rx, round(f.y - (b * f.x0 + a * f.y0 + ty), 6) + 0.0::DOUBLE AS ry, round(e, 6) AS residual, k.point_id IS NOT NULL AS inlier
FROM fit2 f LEFT JOIN keep k ON k.frame = f.frame AND k.point_id = f.point_id""")
def decomposed_residuals(spark, sf_dir):
    return rounded(_decomposed(spark, sf_dir)[1], ["rx", "ry", "residual"]).select("frame", "point_id", "rx", "ry", "residual", "inlier")


@query(f"WITH {A.TRACKS} SELECT frame, point_id, x BETWEEN -5 AND 5 AND y BETWEEN -5 AND 5 AS inside FROM tracks")
def roi_filter(spark, sf_dir):
    return features.in_region(A.tracks(spark, sf_dir), -5.0, -5.0, 5.0, 5.0).select("frame", "point_id", "inside")


@query(f"""WITH {A.TRACKS}, b AS (SELECT frame, greatest(least(min(x), 10), 0) AS x0, greatest(least(min(y), 10), 0) AS y0, greatest(least(max(x), 10), 0) AS x1, greatest(least(max(y), 10), 0) AS y1 FROM tracks GROUP BY 1)
SELECT frame, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, x1 <= x0 OR y1 <= y0 AS empty FROM b""")
def clipped_regions(spark, sf_dir):
    boxes = A.tracks(spark, sf_dir).groupBy("frame").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return rounded(features.clipped_region(boxes, 10.0, 10.0), ["x0", "y0", "x1", "y1"])


@query(f"WITH {A.TRACKS} SELECT frame, point_id, round(x * 0.4::DOUBLE, 6) + 0.0::DOUBLE AS x_mm, round(y * 0.4::DOUBLE, 6) + 0.0::DOUBLE AS y_mm FROM tracks")
def millimetres(spark, sf_dir):
    t = A.tracks(spark, sf_dir).withColumn("mm_per_px", F.lit(0.4))
    return rounded(features.to_millimetres(t, ["x", "y"]), ["x_mm", "y_mm"]).select("frame", "point_id", "x_mm", "y_mm")


@query(f"""WITH {A.TRACKS}, r AS (SELECT frame, point_id, floor(x / 10.0) AS cx, floor(y / 10.0) AS cy, round(x * x + y * y, 6) AS response FROM tracks),
k AS (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY response DESC, frame * 32 + point_id) AS rank FROM r)
SELECT frame * 32 + point_id AS point_id, cx::BIGINT AS cell_x, cy::BIGINT AS cell_y, rank::INT AS rank FROM k WHERE rank <= 3""")
def points_per_cell(spark, sf_dir):
    t = A.tracks(spark, sf_dir).withColumns({"response": F.round(F.col("x") * F.col("x") + F.col("y") * F.col("y"), 6), "point_id": F.col("frame") * 32 + F.col("point_id")})
    return geometry.per_cell_top(t, 10.0, 3).select("point_id", "cell_x", "cell_y", "rank")


#: Runs of 50 frames as records; a replaced point at every frame of one label.
RESEEDS = f"""WITH {A.TRACKS}, m AS (SELECT frame // 50 AS record_id, frame % 50 AS i, (frame % 50) / 30.0::DOUBLE AS t, avg(x) AS tx, avg(y) AS ty, atan2(sum(y), sum(x)) AS rotation FROM tracks GROUP BY frame),
a AS (SELECT vec_id // 50 AS record_id, vec_id % 50 AS i, sqrt((embedding[1]::DOUBLE * 100) ** 2 + (embedding[2]::DOUBLE * 100) ** 2) AS size, 'Q' || label AS quality, label = 3 AS hit, vec_id FROM embeddings),
j AS (SELECT m.*, size, quality, hit, vec_id FROM m JOIN a USING (record_id, i)),
l AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS n, t - lag(t) OVER w AS dt, lag(t) OVER w AS t1, lag(t, 2) OVER w AS t2, lag(tx) OVER w AS x1, lag(tx, 2) OVER w AS x2, lag(ty) OVER w AS y1, lag(ty, 2) OVER w AS y2, lag(rotation) OVER w AS r1, lag(rotation, 2) OVER w AS r2, lag(quality) OVER w AS q1
      FROM j WINDOW w AS (PARTITION BY record_id ORDER BY i)),
r AS (SELECT record_id, greatest(3, coalesce(round_even(0.5 / quantile_cont(dt, 0.5), 0), 3))::BIGINT AS radius FROM l GROUP BY 1),
e AS (SELECT l.*, radius FROM l JOIN r USING (record_id) WHERE hit AND i >= 2 AND i + 1 < n),
b AS (SELECT e.vec_id, quantile_cont(o.size, 0.5) AS baseline FROM e JOIN l o ON o.record_id = e.record_id AND o.i BETWEEN e.i - radius AND e.i + radius GROUP BY 1),
p AS (SELECT e.vec_id, sqrt((a.x - (2 * b.x - c.x)) ** 2 + (a.y - (2 * b.y - c.y)) ** 2) AS jump FROM e JOIN tracks a ON a.frame = e.vec_id JOIN tracks b ON b.frame = e.vec_id - 1 AND b.point_id = a.point_id JOIN tracks c ON c.frame = e.vec_id - 2 AND c.point_id = a.point_id),
g AS (SELECT vec_id, avg(jump) AS mean, quantile_cont(jump, 0.95) AS p95 FROM p GROUP BY 1)"""


@query(f"""{RESEEDS} SELECT record_id, vec_id AS reseed_id, i AS frame_id, round(t, 6) AS "timestamp", round(mean, 6) AS point_position_jump_mean_px, round(p95, 6) AS point_position_jump_p95_px,
  round(sqrt((tx - (2 * x1 - x2)) ** 2 + (ty - (2 * y1 - y2)) ** 2), 6) AS common_translation_jump_px, round(degrees(abs(rotation - (2 * r1 - r2))), 6) AS common_rotation_jump_deg,
  round(sqrt(((tx - x1) / (t - t1) - (x1 - x2) / (t1 - t2)) ** 2 + ((ty - y1) / (t - t1) - (y1 - y2) / (t1 - t2)) ** 2), 5) AS velocity_jump, round(size, 6) AS acceleration_spike, round(size / greatest(baseline, 1e-12), 6) AS acceleration_spike_ratio, q1 AS quality_before, quality AS quality_after
FROM e JOIN b USING (vec_id) JOIN g USING (vec_id)""")
def reseed_report(spark, sf_dir):
    frame = lambda c: [F.floor(F.col(c) / 50).alias("record_id"), (F.col(c) % 50).alias("i")]
    tracks = A.tracks(spark, sf_dir)
    shifts = tracks.groupBy("frame").agg(F.avg("x").alias("tx"), F.avg("y").alias("ty"), F.atan2(F.sum("y"), F.sum("x")).alias("rotation"))
    at = A.table(spark, sf_dir, "embeddings")
    sizes = at.select(F.col("vec_id").alias("frame"), *[(F.col("embedding")[k].cast("double") * 100).alias(c) for k, c in ((0, "ax"), (1, "ay"))], F.concat(F.lit("Q"), "label").alias("quality"))
    motion = shifts.join(sizes, "frame").withColumn("t", F.col("frame") % 50 / F.lit(30.0)).select(*frame("frame"), "t", "tx", "ty", "rotation", "ax", "ay", "quality")
    events = at.where("label = 3").select(*frame("vec_id"), F.col("vec_id").alias("reseed_id"))
    rows = reseed.reseed_rows(motion, tracks.select(*frame("frame"), "point_id", "x", "y"), events)
    names = ["timestamp", "point_position_jump_mean_px", "point_position_jump_p95_px", "common_translation_jump_px", "common_rotation_jump_deg", "acceleration_spike", "acceleration_spike_ratio"]
    return rounded(rounded(rows, names), ["velocity_jump"], 5)


def _greedy_sql(near: float, quota: str) -> str:
    """Point after point of a frame, the strongest first, is kept or not by those kept before it."""
    return f"""WITH RECURSIVE {A.TRACKS}, o AS (SELECT frame, point_id, x, y, floor(x / 10) AS cx, floor(y / 10) AS cy, row_number() OVER (PARTITION BY frame ORDER BY round(sqrt(x * x + y * y), 6) DESC, point_id) AS k FROM tracks),
g AS (SELECT DISTINCT frame, 0::BIGINT AS k, []::STRUCT(p BIGINT, x DOUBLE, y DOUBLE, cx DOUBLE, cy DOUBLE)[] AS kept FROM o UNION ALL
  SELECT o.frame, o.k, CASE WHEN len(list_filter(kept, lambda z: sqrt((z.x - o.x) ** 2 + (z.y - o.y) ** 2) < {near})) = 0{quota} THEN list_append(kept, struct_pack(p := o.point_id, x := o.x, y := o.y, cx := o.cx, cy := o.cy)) ELSE kept END
  FROM g JOIN o ON o.frame = g.frame AND o.k = g.k + 1),
w AS (SELECT frame, kept FROM g WHERE k = 32)"""


@query(f"{_greedy_sql(5.0, '')} SELECT frame, unnest(kept).p AS point_id FROM w")
def spaced_points(spark, sf_dir):
    t = A.tracks(spark, sf_dir).withColumn("response", F.round(norm(F.col("x"), F.col("y")), 6))
    return geometry.spaced(t, 5.0, "frame")


@query(f"""{_greedy_sql(3.0, ' AND len(list_filter(kept, lambda z: z.cx = o.cx AND z.cy = o.cy)) < 4')}
SELECT frame, kept[i].p AS point_id, i::INT AS "order", len(kept) >= 8 AS complete FROM (SELECT frame, kept, unnest(range(1, least(len(kept), 8) + 1)) AS i FROM w)""")
def chosen_points(spark, sf_dir):
    t = A.tracks(spark, sf_dir).withColumn("response", F.round(norm(F.col("x"), F.col("y")), 6))
    return geometry.selected_points(t, 3.0, "frame", cell=10.0, quota=4, target=8)


@query(f"""WITH {A.TRACKS} SELECT frame, point_id, round(atan2(sin(x), cos(x)), 6) + 0.0::DOUBLE AS angle FROM tracks""")
def wrapped_angles(spark, sf_dir):
    return A.tracks(spark, sf_dir).select("frame", "point_id", tidy(wrapped(F.col("x"))).alias("angle"))


@query("""
WITH f AS (SELECT frame, frame / 30.0::DOUBLE AS t FROM range(0, 60) r(frame)), p AS (SELECT point_id, 10.0::DOUBLE + (point_id % 8) * 20.0::DOUBLE AS x0, 10.0::DOUBLE + (point_id // 8) * 20.0::DOUBLE AS y0 FROM range(0, 40) r(point_id)),
g AS (SELECT *, 2.0::DOUBLE * sin(2 * 3.141592653589793::DOUBLE * 1.5::DOUBLE * t) AS w, 0.01::DOUBLE * t AS a, CASE WHEN point_id >= 32 THEN 0.5::DOUBLE * sin(4 * 3.141592653589793::DOUBLE * 1.5::DOUBLE * t) ELSE 0 END AS e FROM f, p)
SELECT frame, point_id, round(80 + (x0 - 80) * cos(a) - (y0 - 50) * sin(a) + w + e, 6) AS x, round(50 + (x0 - 80) * sin(a) + (y0 - 50) * cos(a) - 0.5::DOUBLE * w, 6) AS y FROM g""")
def synthetic_tracks(spark, sf_dir):
    t = generators.synthetic_tracks(spark, 60, 8, 5, 30.0, 2.0, 1.5, 0.01, 0.5, 8)
    return rounded(t, ["x", "y"]).select("frame", "point_id", "x", "y")


@query("""
WITH a AS (SELECT unnest([0.05, 0.1, 0.5, 1.0]::DOUBLE[]) AS amplitude), f AS (SELECT unnest([0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 10.0]::DOUBLE[]) AS frequency), r AS (SELECT unnest([15.0, 25.0, 30.0, 50.0, 60.0]::DOUBLE[]) AS rate),
t AS (SELECT unnest([0.0, 0.1, 0.5, 1.0]::DOUBLE[]) AS turn), s AS (SELECT unnest(['still', 'shift', 'turn', 'both', 'local', 'dark', 'blur', 'cut']) AS scene)
SELECT 'translation' AS axis, amplitude, frequency, rate, NULL::DOUBLE AS turn, NULL AS scene FROM a, f, r UNION ALL SELECT 'rotation', NULL, NULL, rate, turn, NULL FROM t, r UNION ALL SELECT 'scene', amplitude, NULL, NULL, NULL, scene FROM s, a""")
def stress_matrix(spark, sf_dir):
    m = generators.stress_matrix(spark, [0.05, 0.1, 0.5, 1.0], [0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 10.0], [15.0, 25.0, 30.0, 50.0, 60.0], [0.0, 0.1, 0.5, 1.0], ["still", "shift", "turn", "both", "local", "dark", "blur", "cut"])
    return m.drop("case_id")


@query(f"""WITH {A.TRACKS}, e AS (SELECT sqrt((t.x - r.x0) ** 2 + (t.y - r.y0) ** 2) AS e, visible FROM tracks t JOIN ref r USING (point_id))
SELECT round(sqrt(avg(e * e)), 6) AS rmse, round(quantile_cont(e, 0.95), 6) AS p95, round(max(e), 6) AS max, round(avg((NOT visible)::INT), 9) AS hidden_share FROM e""")
def tracking_errors(spark, sf_dir):
    t = A.tracks(spark, sf_dir)
    truth = A.reference_points(t).select("point_id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return rounded(rounded(generators.tracking_errors(t, truth, ("point_id",)), ["rmse", "p95", "max"]), ["hidden_share"], 9)


def _steps(v: str, w: str) -> str:
    return f"({v} - lag({v}) {w}) / nullif(t - lag(t) {w}, 0)"


RW = "OVER (PARTITION BY record_id ORDER BY seq)"
BANDS = (("common_energy_0p3_1_hz", 0.3, 1.0), ("common_energy_1_3_hz", 1.0, 3.0), ("common_energy_3_8_hz", 3.0, 8.0))
DIGITS = {"effective_fps": 6, "timestamp_rms_jitter_s": 9, "active_object_fraction": 9, "mean_visibility": 9}


@query(f"""{M}, {SIM}, {RES},
fr AS (SELECT frame, sqrt(avg(residual * residual)) AS fit_rmse, avg((residual <= 12)::INT) AS inlier_ratio FROM rs GROUP BY 1),
co AS (SELECT frame // 50 AS record_id, frame % 50 AS seq, (frame % 50) / 30.0::DOUBLE AS t, tx AS x, ty AS y, inlier_ratio, fit_rmse, CASE WHEN fit_rmse > 14 THEN 'INVALID' ELSE 'GOOD' END AS quality FROM sim JOIN fr USING (frame)),
d0 AS (SELECT *, t - lag(t) {RW} AS dt, {_steps('x', RW)} AS vx, {_steps('y', RW)} AS vy FROM co),
d1 AS (SELECT *, 2 * (vx - lag(vx) {RW}) / nullif(dt + lag(dt) {RW}, 0) AS ax, 2 * (vy - lag(vy) {RW}) / nullif(dt + lag(dt) {RW}, 0) AS ay FROM d0),
d2 AS (SELECT *, sqrt(x * x + y * y) AS m, sqrt(vx * vx + vy * vy) AS v, sqrt(ax * ax + ay * ay) AS a FROM d1), d3 AS (SELECT *, max(a) OVER (PARTITION BY record_id) AS pa, count(*) OVER (PARTITION BY record_id) AS n FROM d2),
nd AS (SELECT record_id, quantile_cont(dt, 0.5) AS md FROM d3 GROUP BY 1),
sm AS (SELECT record_id, min(t) AS window_start, max(t) AS window_end, count(*) AS sample_count, 1 / md AS effective_fps, sqrt(avg((dt - md) ** 2)) AS timestamp_rms_jitter_s, sum(greatest(round_even(dt / md, 0) - 1, 0)) AS estimated_missing_frames, max(m) AS common_peak_displacement_px,
  sqrt(avg(m * m)) AS common_rms_displacement_px, max(v) AS common_peak_velocity_px_s, max(a) AS common_peak_acceleration_px_s2, sqrt(avg(a * a)) AS common_rms_acceleration_px_s2, count(CASE WHEN a >= 0.1 * pa THEN 1 END) * md AS strong_motion_duration_s,
  avg(inlier_ratio) AS mean_inlier_ratio, avg(fit_rmse) AS mean_fit_rmse_px, string_agg(DISTINCT quality, '|' ORDER BY quality) AS quality_flags FROM d3 JOIN nd USING (record_id) GROUP BY record_id, md),
tm AS (SELECT record_id, n, k, x * cos(2 * 3.141592653589793::DOUBLE * k * seq / n) AS c, -x * sin(2 * 3.141592653589793::DOUBLE * k * seq / n) AS d FROM d3, range(0, 26) r(k) WHERE k <= n // 2 AND n >= 4),
pw AS (SELECT record_id, n, k, k / (n * md) AS hz, sum(c) ** 2 + sum(d) ** 2 AS power FROM tm JOIN nd USING (record_id) WHERE k > 0 GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY round(sqrt(power), 6) DESC, k) AS r FROM pw),
sp AS (SELECT record_id, max(CASE WHEN r = 1 THEN hz END) AS common_dominant_frequency_hz, {", ".join(f"sum(CASE WHEN hz >= {a} AND hz < {b} THEN power / (n * n) ELSE 0 END) AS {c}" for c, a, b in BANDS)} FROM rk GROUP BY 1),
al AS (SELECT t.frame // 50 AS record_id, t.frame, t.point_id, t.visible, residual AS r FROM tracks t LEFT JOIN rs ON rs.frame = t.frame AND rs.point_id = t.point_id),
md2 AS (SELECT record_id, greatest(quantile_cont(r, 0.5), 1e-6) AS middle, sqrt(avg(r * r)) AS residual_rms_px, max(r) AS residual_peak_px FROM al GROUP BY 1),
ac AS (SELECT record_id, frame, avg(coalesce((r > 3 * middle)::INT, 0)) AS active, sum(visible::INT) AS shown, count(*) AS n FROM al JOIN md2 USING (record_id) GROUP BY 1, 2),
ag AS (SELECT record_id, avg(active) AS active_object_fraction, sum(shown) / sum(n) AS mean_visibility, avg(shown) AS mean_active_track_count FROM ac GROUP BY 1),
ea AS (SELECT record_id, point_id, sqrt(avg(r * r)) AS rms FROM al GROUP BY 1, 2), sd AS (SELECT record_id, quantile_cont(rms, 0.5) AS residual_median_point_rms_px, quantile_cont(rms, 0.95) AS residual_p95_point_rms_px, stddev_pop(rms) AS residual_point_dispersion_px FROM ea GROUP BY 1)
SELECT record_id, '{features.VERSION}' AS feature_version, 'EVENT_END_CAUSAL_AGGREGATE_NOT_RUNNING' AS feature_availability, sample_count::INT AS sample_count, estimated_missing_frames::INT AS estimated_missing_frames, quality_flags, 'backward' AS derivative_method, 1 AS causal,
  {", ".join(f"round({c}, {DIGITS.get(c, 4)}) + 0.0::DOUBLE AS {c}" for c in features.RECORD_FEATURES if c not in ("feature_version", "feature_availability", "sample_count", "estimated_missing_frames", "quality_flags", "derivative_method", "causal"))}
FROM sm JOIN sp USING (record_id) JOIN md2 USING (record_id) JOIN ag USING (record_id) JOIN sd USING (record_id)""")
def record_features(spark, sf_dir):
    """Every 50 frames as a record of 30 frames a second."""
    t, points = _points(spark, sf_dir)
    fits = geometry.fit_similarity(points)
    res = geometry.residuals(points, fits)
    place = {"record_id": F.floor(F.col("frame") / 50), "seq": F.col("frame") % 50}
    per = res.groupBy("frame").agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("fit_rmse"), F.avg((F.col("residual") <= 12).cast("int")).alias("inlier_ratio"))
    common = fits.join(per, "frame").withColumns(place | {"x": F.col("tx"), "y": F.col("ty"), "quality": F.when(F.col("fit_rmse") > 14, "INVALID").otherwise("GOOD")}).withColumn("t", F.col("seq") / 30.0)
    every = t.join(res, ["frame", "point_id"], "left").withColumns(place)
    f = features.record_features(common, every, causal=True, derivatives="backward")
    number = [c for c, kind in f.dtypes if kind == "double"]
    for digits in sorted({DIGITS.get(c, 4) for c in number}):
        f = rounded(f, [c for c in number if DIGITS.get(c, 4) == digits], digits)
    return f
