"""Queries over feature rows, pairings, timings and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tidy
from ..operators import audit, features, models, quality, sets
from ..sources import adapters as A
from ..sources import records
from .registry import query
from .signal_queries import rounded

FOLDS = 5
FEATURES = ["f1", "f2", "f3"]
EDGES = [0.0, 50000.0, 100000.0, 200000.0, 400000.0, 1000000.0]

FOLDED = f"""WITH {A.FEATURES}, grps AS (SELECT grp, ntile({FOLDS}) OVER (ORDER BY md5('7|' || grp)) - 1 AS fold FROM (SELECT DISTINCT grp FROM feats)),
f AS (SELECT feats.*, fold FROM feats JOIN grps USING (grp))"""


def _folded(spark, sf_dir):
    return models.group_folds(A.feature_rows(spark, sf_dir), FOLDS)


@query(f"{FOLDED} SELECT grp, fold::INT AS fold, count(*) AS n FROM f GROUP BY 1, 2")
def group_kfold(spark, sf_dir):
    return _folded(spark, sf_dir).groupBy("grp", "fold").agg(F.count(F.lit(1)).alias("n"))


MEDIAN = f"p AS (SELECT fold, (SELECT quantile_cont(target, 0.5) FROM f g WHERE g.fold <> k.fold) AS predicted FROM (SELECT DISTINCT fold FROM f) k)"


@query(f"{FOLDED}, {MEDIAN} SELECT record_id, round(predicted, 4) AS predicted FROM f JOIN p USING (fold)")
def cv_median(spark, sf_dir):
    return rounded(models.median_baseline(_folded(spark, sf_dir), FOLDS), ["predicted"], 4).select("record_id", "predicted")


SINGLE = "c AS (SELECT k.fold, sum(f1 * target) / greatest(sum(f1 * f1), 1e-12) AS coefficient FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold GROUP BY 1), p AS (SELECT f.*, greatest(coefficient * f1, 0) AS predicted FROM f JOIN c USING (fold))"


@query(f"{FOLDED}, {SINGLE} SELECT record_id, round(predicted, 2) AS predicted FROM p")
def cv_single_coefficient(spark, sf_dir):
    return rounded(models.single_coefficient(_folded(spark, sf_dir)), ["predicted"], 2).select("record_id", "predicted")


@query(f"""{FOLDED}, s AS (SELECT k.fold, avg(f1) AS m, stddev_pop(f1) AS sd, avg(ln(target)) AS level, covar_pop(f1, ln(target)) * count(*) AS sxy, var_pop(f1) * count(*) AS sxx FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold GROUP BY 1)
SELECT record_id, round(exp(level + (sxy / sd) / (sxx / (sd * sd) + 1) * (f1 - m) / sd), 2) AS predicted FROM f JOIN s USING (fold)""")
def cv_ridge_1d(spark, sf_dir):
    return rounded(models.ridge_1d(_folded(spark, sf_dir)), ["predicted"], 2).select("record_id", "predicted")


def _cv(algorithm):
    def run(spark, sf_dir):
        out = models.cross_validated(_folded(spark, sf_dir), algorithm, FEATURES, FOLDS)
        return rounded(out, ["predicted"], 2).select("record_id", "predicted")

    return run


def _linear_sql(alpha: float, source: str = "f", by: str = "") -> str:
    """CTEs up to lin: rows with predicted by a line on three standardized features of ln target, fitted to the other folds (three equations, by determinants)."""
    lead, same = (f"{by}, ", f"{source}.{by} = k.{by} AND ") if by else ("", "")
    return f"""ls AS (SELECT {f"k.{by}, " if by else ""}k.fold, count(*) + {alpha}::DOUBLE AS d, avg(f1) AS m1, avg(f2) AS m2, avg(f3) AS m3, stddev_pop(f1) AS s1, stddev_pop(f2) AS s2, stddev_pop(f3) AS s3, avg(ln(target)) AS level,
  count(*) * corr(f1, f2) AS c12, count(*) * corr(f1, f3) AS c13, count(*) * corr(f2, f3) AS c23, count(*) * covar_pop(f1, ln(target)) / stddev_pop(f1) AS b1, count(*) * covar_pop(f2, ln(target)) / stddev_pop(f2) AS b2, count(*) * covar_pop(f3, ln(target)) / stddev_pop(f3) AS b3
  FROM {source} JOIN (SELECT DISTINCT {lead}fold FROM {source}) k ON {same}{source}.fold <> k.fold GROUP BY ALL),
lb AS (SELECT *, d * (d * d - c23 * c23) - c12 * (c12 * d - c23 * c13) + c13 * (c12 * c23 - d * c13) AS det, b1 * (d * d - c23 * c23) - c12 * (b2 * d - c23 * b3) + c13 * (b2 * c23 - d * b3) AS n1,
  d * (b2 * d - c23 * b3) - b1 * (c12 * d - c23 * c13) + c13 * (c12 * b3 - b2 * c13) AS n2, d * (d * b3 - b2 * c23) - c12 * (c12 * b3 - b2 * c13) + b1 * (c12 * c23 - d * c13) AS n3 FROM ls),
lin AS (SELECT {source}.*, exp(level + n1 / det * (f1 - m1) / s1 + n2 / det * (f2 - m2) / s2 + n3 / det * (f3 - m3) / s3) AS predicted FROM {source} JOIN lb USING ({lead}fold))"""


for _name, _sql in (("log_linear", f"{FOLDED}, {_linear_sql(0)} SELECT record_id, round(predicted, 2) AS predicted FROM lin"), ("ridge", f"{FOLDED}, {_linear_sql(1)} SELECT record_id, round(predicted, 2) AS predicted FROM lin"), ("huber", None)):
    _f = _cv(_name)
    _f.__name__ = f"cv_{_name}"
    query(_sql)(_f)


def _metrics_sql(source: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    lead, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""r AS (SELECT *, greatest(predicted, 1e-12) AS e, rank() OVER ({part}ORDER BY target) + (count(*) OVER (PARTITION BY {keys + ', ' if keys else ''}target) - 1) / 2 AS rt,
  rank() OVER ({part}ORDER BY predicted) + (count(*) OVER (PARTITION BY {keys + ', ' if keys else ''}predicted) - 1) / 2 AS re FROM {source})
SELECT {lead}count(*) AS n, round(avg(abs(predicted - target)), 3) AS mae, round(sqrt(avg((predicted - target) ** 2)), 3) AS rmse, round(avg(abs(ln(e) - ln(target))), 6) AS log_mae,
       round(quantile_cont(greatest(e / target, target / e), 0.5), 6) AS median_factor, round(avg((greatest(e / target, target / e) <= 1.5)::INT), 6) AS within_1p5, round(avg((greatest(e / target, target / e) <= 2)::INT), 6) AS within_2,
       round(covar_pop(target, predicted) / nullif(stddev_pop(target) * stddev_pop(predicted), 0), 6) AS pearson, round(covar_pop(rt, re) / nullif(stddev_pop(rt) * stddev_pop(re), 0), 6) AS spearman FROM r {group}"""


METRIC_COLUMNS = ["log_mae", "median_factor", "within_1p5", "within_2", "pearson", "spearman"]


@query(f"{FOLDED}, {SINGLE}, {_metrics_sql('p')}")
def prediction_metrics(spark, sf_dir):
    m = models.metrics(models.single_coefficient(_folded(spark, sf_dir)))
    return rounded(rounded(m, ["mae", "rmse"], 3), METRIC_COLUMNS)


@query(f"{FOLDED}, {SINGLE}, {_metrics_sql('p', 'grp')}")
def metrics_by_group(spark, sf_dir):
    m = models.metrics(models.single_coefficient(_folded(spark, sf_dir)), ["grp"])
    return rounded(rounded(m, ["mae", "rmse"], 3), METRIC_COLUMNS)


@query(f"""{FOLDED}, {SINGLE}, q AS (SELECT 'grp' AS "column", grp::VARCHAR AS "value", target, predicted FROM p UNION ALL SELECT 'fold', fold::VARCHAR, target, predicted FROM p
  UNION ALL SELECT 'target_bin', len(list_filter({EDGES[1:-1]}::DOUBLE[], lambda e: e <= target))::VARCHAR, target, predicted FROM p), {_metrics_sql('q', '"column", "value"')}""")
def group_report(spark, sf_dir):
    p = models.single_coefficient(_folded(spark, sf_dir)).withColumn("target_bin", models.binned(F.col("target"), EDGES))
    m = models.group_report(p, ["grp", "fold", "target_bin", "site"])
    return rounded(rounded(m, ["mae", "rmse"], 3), METRIC_COLUMNS)


@query(f"""{FOLDED}, {SINGLE}, b AS (SELECT len(list_filter({EDGES[1:-1]}::DOUBLE[], lambda e: e <= target)) AS a, len(list_filter({EDGES[1:-1]}::DOUBLE[], lambda e: e <= predicted)) AS b FROM p),
k AS (SELECT i.i AS a, j.j AS b FROM range(0, 5) i(i), range(0, 5) j(j))
SELECT k.a::INT AS true_bin, k.b::INT AS estimated_bin, count(b.a) AS n FROM k LEFT JOIN b ON b.a = k.a AND b.b = k.b GROUP BY 1, 2""")
def confusion_matrix(spark, sf_dir):
    return models.confusion(models.single_coefficient(_folded(spark, sf_dir)), EDGES)


#: The draws of a row: eight numbers of 16 bits from each digest, as Poisson counts of mean 1.
DRAWS = f"""dg AS (SELECT target, predicted, b8, md5('0|' || record_id || '|' || b8) AS h FROM p, range(0, 250) r(b8)),
du AS (SELECT target, predicted, b8 * 8 + k AS draw, ('0x' || substr(h, 4 * k + 1, 4))::BIGINT / 65536.0::DOUBLE AS u FROM dg, range(0, 8) r(k)),
dw AS (SELECT target, predicted, draw, {" + ".join(f"(u >= {x})::INT" for x in models.POISSON)} AS c FROM du WHERE u >= {models.POISSON[0]})"""


@query(f"""{FOLDED}, {SINGLE}, d AS (SELECT b, abs(predicted - target) AS e, ('0x' || substr(md5('0|' || record_id || '|' || b), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM p, range(0, 2000) r(b)),
w AS (SELECT b, e, {" + ".join(f"(u >= {x})::INT" for x in models.POISSON_32)} AS c FROM d), m AS (SELECT b, sum(c * e) / sum(c) AS mae FROM w GROUP BY 1)
SELECT round(quantile_cont(mae, 0.025), 3) AS lower_95, round(quantile_cont(mae, 0.5), 3) AS median, round(quantile_cont(mae, 0.975), 3) AS upper_95 FROM m""")
def bootstrap_ci(spark, sf_dir):
    p = models.single_coefficient(_folded(spark, sf_dir))
    return rounded(models.bootstrap_mae(p, 2000, per_digest=1), ["lower_95", "median", "upper_95"], 3)


#: All metrics of each draw. Ranks are those of the resample, in which a row is there c times; the median is that of such copies.
RESAMPLED = """dr AS (SELECT *, greatest(predicted, 1e-12) AS safe, greatest(greatest(predicted, 1e-12) / target, target / greatest(predicted, 1e-12)) AS factor,
  sum(c) OVER (PARTITION BY draw ORDER BY target) - (sum(c) OVER (PARTITION BY draw, target) - 1) / 2.0::DOUBLE AS rt,
  sum(c) OVER (PARTITION BY draw ORDER BY predicted) - (sum(c) OVER (PARTITION BY draw, predicted) - 1) / 2.0::DOUBLE AS re FROM dw),
df AS (SELECT *, sum(c) OVER (PARTITION BY draw ORDER BY factor) AS upto, sum(c) OVER (PARTITION BY draw) AS total FROM dr),
dm AS (SELECT draw, avg(target) AS mt, avg(predicted) AS mp, sum(c) AS w FROM dw GROUP BY 1),
dt AS (SELECT draw, any_value(w)::DOUBLE AS n, sum(c * abs(predicted - target)) / any_value(w) AS mae, sqrt(sum(c * (predicted - target) ** 2) / any_value(w)) AS rmse, sum(c * abs(ln(safe) - ln(target))) / any_value(w) AS log_mae,
  (min(factor) FILTER (upto > (total - 1) // 2) + min(factor) FILTER (upto > total // 2)) / 2 AS median_factor,
  sum(c * (factor <= 1.5)::INT) / any_value(w) AS within_1p5, sum(c * (factor <= 2.0)::INT) / any_value(w) AS within_2,
  (sum(c * (target - mt) * (predicted - mp)) - sum(c * (target - mt)) * sum(c * (predicted - mp)) / any_value(w))
    / sqrt((sum(c * (target - mt) ** 2) - sum(c * (target - mt)) ** 2 / any_value(w)) * (sum(c * (predicted - mp) ** 2) - sum(c * (predicted - mp)) ** 2 / any_value(w))) AS pearson,
  sum(c * (rt - (w + 1) / 2.0) * (re - (w + 1) / 2.0)) / sqrt(sum(c * (rt - (w + 1) / 2.0) ** 2) * sum(c * (re - (w + 1) / 2.0) ** 2)) AS spearman
  FROM df JOIN dm USING (draw) GROUP BY 1)"""


@query(f"""{FOLDED}, {SINGLE}, {DRAWS}, {RESAMPLED}, l AS (UNPIVOT (SELECT * EXCLUDE (draw) FROM dt) ON COLUMNS(*) INTO NAME metric VALUE v)
SELECT metric, round(quantile_cont(v, 0.025), 3) AS lower_95, round(quantile_cont(v, 0.5), 3) AS median, round(quantile_cont(v, 0.975), 3) AS upper_95 FROM l GROUP BY 1""")
def bootstrap_metrics(spark, sf_dir):
    p = models.single_coefficient(_folded(spark, sf_dir))
    return rounded(models.bootstrap(p, 2000), ["lower_95", "median", "upper_95"], 3)


def _rows(spark, sf_dir):
    f = A.feature_rows(spark, sf_dir)
    return f.withColumns({
        "mean_active_track_count": F.col("f1"), "mean_visibility": F.when(F.col("record_id") % 5 != 0, F.col("f3") * 10), "mean_fit_rmse_px": F.col("f2"),
        "quality_flags": F.when(F.col("record_id") % 11 == 0, "GOOD|INVALID").otherwise("GOOD"), "spatial_coverage": F.col("f3"), "motion_model_condition_number": F.lit(1.0),
        "blur_metric": F.when(F.col("record_id") % 3 == 0, 0.5), "exposure_instability": F.lit(0.1), "preferred_correlation": F.when(F.col("record_id") % 7 != 0, F.col("f3") * 10).otherwise(0.0),
    })


THRESHOLDS = {"min_tracks": 20.0, "min_visibility": 0.2, "max_fit_rmse_px": 6.0}

QUALITY = f"""WITH {A.FEATURES}, v AS (SELECT *, CASE WHEN record_id % 5 <> 0 THEN f3 * 10 END AS mv, record_id % 11 = 0 AS bad, CASE WHEN record_id % 3 = 0 THEN 0.5 END AS blur, CASE WHEN record_id % 7 <> 0 THEN f3 * 10 ELSE 0.0 END AS pc FROM feats),
w AS (SELECT *, list_filter([CASE WHEN bad THEN 'MOTION_QUALITY_INVALID' END, CASE WHEN f1 < 20 THEN 'mean_active_track_count_OUT_OF_RANGE' END, CASE WHEN f2 > 6 THEN 'mean_fit_rmse_px_OUT_OF_RANGE' END, CASE WHEN mv < 0.2 THEN 'mean_visibility_OUT_OF_RANGE' END], lambda z: z IS NOT NULL) AS failed,
  list_filter([CASE WHEN blur IS NULL THEN 'blur_metric' END, CASE WHEN mv IS NULL THEN 'mean_visibility' END], lambda z: z IS NOT NULL) AS unknown FROM v),
z AS (SELECT *, len(failed) = 0 AS accepted, CASE WHEN len(failed) > 0 THEN 'REJECTED' WHEN len(unknown) > 0 THEN 'PASS_WITH_UNKNOWN_METRICS' ELSE 'PASS' END AS state,
  CASE WHEN len(failed) > 0 THEN array_to_string(failed, '|') WHEN len(unknown) > 0 THEN 'UNKNOWN:' || array_to_string(unknown, '|') ELSE '' END AS reason FROM w),
y AS (SELECT *, target > 0 AS in_all, target > 0 AND accepted AS in_video, target > 0 AND coalesce(nullif(pc, 0), '-inf'::DOUBLE) >= 0.4 AS in_posthoc FROM z)"""


def _judged(spark, sf_dir):
    return quality.subset_flags(quality.video_quality(_rows(spark, sf_dir), THRESHOLDS), FEATURES, "preferred_correlation", 0.4)


@query(f"{QUALITY} SELECT record_id, accepted, state, reason, in_all, in_video AS in_video_quality, in_posthoc FROM y")
def quality_subsets(spark, sf_dir):
    return _judged(spark, sf_dir).select("record_id", "accepted", "state", "reason", "in_all", "in_video_quality", "in_posthoc")


@query(f"""{QUALITY} SELECT record_id, 'all' AS subset, in_all AS included, CASE WHEN in_all THEN '' ELSE 'NONFINITE_MODEL_INPUT' END AS exclusion_reason FROM y
UNION ALL SELECT record_id, 'video_quality', in_video, concat_ws('|', CASE WHEN NOT in_all THEN 'NONFINITE_MODEL_INPUT' END, CASE WHEN NOT accepted THEN reason END) FROM y
UNION ALL SELECT record_id, 'posthoc_aligned', in_posthoc, concat_ws('|', CASE WHEN NOT in_all THEN 'NONFINITE_MODEL_INPUT' END, CASE WHEN in_all AND NOT in_posthoc THEN 'EXPLORATORY_CORRELATION_BELOW_THRESHOLD' END) FROM y""")
def exclusion_reasons(spark, sf_dir):
    return quality.exclusions(_judged(spark, sf_dir))


@query(f"""{QUALITY}, s AS (SELECT unnest([CASE WHEN in_all THEN 'all' END, CASE WHEN in_video THEN 'video_quality' END, CASE WHEN in_posthoc THEN 'posthoc_aligned' END]) AS subset, grp, f1, f2, f3, target FROM y),
g AS (SELECT grp, ntile({FOLDS}) OVER (ORDER BY md5('7|' || grp)) - 1 AS fold FROM (SELECT DISTINCT grp FROM feats)), h AS (SELECT * FROM s JOIN g USING (grp) WHERE subset IS NOT NULL),
k AS (SELECT DISTINCT subset, fold FROM h), c AS (SELECT k.subset, k.fold, sum(f1 * target) / greatest(sum(f1 * f1), 1e-12) AS coefficient, quantile_cont(target, 0.5) AS middle FROM h JOIN k ON h.subset = k.subset AND h.fold <> k.fold GROUP BY 1, 2),
{_linear_sql(0, 'h', 'subset')}, {_linear_sql(1, 'h', 'subset').replace('ls AS', 'rs AS').replace('FROM ls', 'FROM rs').replace('lb AS', 'rb AS').replace('JOIN lb', 'JOIN rb').replace('lin AS', 'ridge AS')},
e AS (SELECT h.subset, 'median' AS algorithm, target, middle AS predicted FROM h JOIN c USING (subset, fold) UNION ALL SELECT h.subset, 'single_coefficient', target, greatest(coefficient * f1, 0) FROM h JOIN c USING (subset, fold)
      UNION ALL SELECT subset, 'log_linear', target, predicted FROM lin UNION ALL SELECT subset, 'ridge', target, predicted FROM ridge),
p AS (SELECT subset, algorithm, target, round(predicted, 6) AS predicted FROM e), {_metrics_sql('p', 'subset, algorithm')}""")
def evaluate_subsets(spark, sf_dir):
    return _evaluated(spark, sf_dir, ("median", "single_coefficient", "log_linear", "ridge"))


@query()
def evaluate_huber(spark, sf_dir):
    return _evaluated(spark, sf_dir, ("huber",))


def _predicted(spark, sf_dir, algorithms):
    judged = _judged(spark, sf_dir).withColumns({"feature_version": F.lit(features.VERSION), "causal": F.lit(1)})
    models.checked_inputs(judged, features.VERSION)
    subsets = {"all": "in_all", "video_quality": "in_video_quality", "posthoc_aligned": "in_posthoc"}
    return models.subset_predictions(models.group_folds(judged, FOLDS), subsets, FEATURES, FOLDS, "f1", algorithms=algorithms)


def _evaluated(spark, sf_dir, algorithms):
    p = rounded(_predicted(spark, sf_dir, algorithms).select("subset", "algorithm", "target", "predicted"), ["predicted"])
    return rounded(rounded(models.metrics(p, ["subset", "algorithm"]), ["mae", "rmse"], 3), METRIC_COLUMNS)


@query(f"""{QUALITY}, m AS (SELECT count(*)::DOUBLE AS n, sum(f1 * target) / greatest(sum(f1 * f1), 1e-12) AS coefficient FROM y WHERE in_video)
SELECT n, round(coefficient, 6) AS coefficient FROM m""")
def final_model(spark, sf_dir):
    kept = _judged(spark, sf_dir).where("in_video_quality")
    return rounded(models.whole_coefficient(kept), ["coefficient"])


@query(f"""{FOLDED}, {SINGLE}, b AS (SELECT *, len(list_filter({EDGES[1:-1]}::DOUBLE[], lambda e: e <= target)) AS bin, 'single_coefficient' AS algorithm FROM p), {_metrics_sql('b', 'algorithm, bin, grp')}""")
def metrics_by_bin(spark, sf_dir):
    p = models.single_coefficient(_folded(spark, sf_dir)).withColumns({"bin": models.binned(F.col("target"), EDGES).cast("long"), "algorithm": F.lit("single_coefficient")})
    m = models.metrics(p, ["algorithm", "bin", "grp"])
    return rounded(rounded(m, ["mae", "rmse"], 3), METRIC_COLUMNS)


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing_left' WHEN l.doc_id IS NULL THEN 'missing_right' ELSE 'paired' END AS status FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def record_pairing(spark, sf_dir):
    return records.pair_tables(A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "labels"), "doc_id")


@query("""
WITH l AS (SELECT l_returnflag, unnest([struct_pack(metric := 'l_quantity', v := l_quantity), struct_pack(metric := 'l_extendedprice', v := l_extendedprice), struct_pack(metric := 'l_discount', v := l_discount)]) AS p FROM lineitem)
SELECT l_returnflag, p.metric AS metric, count(*) AS n, round(avg(p.v), 6) AS mean, round(quantile_cont(p.v, 0.5), 6) AS p50, round(quantile_cont(p.v, 0.95), 6) AS p95, round(quantile_cont(p.v, 0.99), 6) AS p99, round(max(p.v), 6) AS max FROM l GROUP BY 1, 2""")
def timing_summary(spark, sf_dir):
    s = audit.summarize(A.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"])
    return rounded(s, ["mean", "p50", "p95", "p99", "max"])


@query("""
SELECT c_nationkey, c_mktsegment, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(max(o_totalprice), 4) AS max, (grouping(c_nationkey) + grouping(c_mktsegment))::INT AS level
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_nationkey, c_mktsegment)""")
def batch_rollup(spark, sf_dir):
    j = A.table(spark, sf_dir, "orders").join(A.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(audit.rollup(j, ["c_nationkey", "c_mktsegment"], "o_totalprice"), ["mean", "max"], 4)


@query("""
WITH k AS (SELECT c_nationkey, o_totalprice, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_nationkey, round(max(CASE WHEN r = n // 2 + 1 THEN o_totalprice END), 4) AS upper_median FROM k GROUP BY 1""")
def upper_median(spark, sf_dir):
    j = A.table(spark, sf_dir, "orders").join(A.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(j.groupBy("c_nationkey").agg(audit.upper_median("o_totalprice").alias("upper_median")), ["upper_median"], 4)


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), b AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey < 12)
SELECT coalesce(a.id, b.id) AS id, a.id IS NOT NULL AS in_a, b.id IS NOT NULL AS in_b FROM a FULL JOIN b ON a.id = b.id""")
def id_set_ops(spark, sf_dir):
    a = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    b = A.table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("id"))
    return sets.membership(a, b, "id")


@query("""
WITH n AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_partkey::VARCHAR END AS name FROM part)
SELECT name FROM n ORDER BY NOT regexp_matches(name, '^[0-9]+$'), try_cast(name AS BIGINT), name LIMIT 100""")
def natural_sort_topk(spark, sf_dir):
    names = A.table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_partkey").cast("string")).alias("name")).distinct()
    return sets.naturally_first(names, "name", 100)


@query("""
WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
SELECT p_brand, p_partkey, round(p_retailprice, 4) AS p_retailprice, rank::INT AS rank FROM r WHERE rank <= 3""")
def top_per_group(spark, sf_dir):
    t = sets.top_per_group(A.table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", "p_retailprice", "p_partkey", 3)
    return rounded(t, ["p_retailprice"], 4)


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, round(s_acctbal, 4) FROM supplier")
def union_of_columns(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    s = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), tidy(F.col("s_acctbal"), 4).alias("balance"))
    return sets.stacked([c, s])


@query("SELECT item_id, sha256(text) AS text_sha256, length(text) AS n FROM benchmark")
def text_hashes(spark, sf_dir):
    return A.table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n"))


@query("SELECT page_id, regexp_replace(url, '^https?://', '<root>/') AS redacted FROM pages")
def redacted_paths(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "<root>/").alias("redacted"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unfinished_records(spark, sf_dir):
    done = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return records.unfinished(A.table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def orders_without_returns(spark, sf_dir):
    done = A.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return records.unfinished(A.table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("""SELECT DISTINCT record_id, status, coalesce(attempt_utc, 'legacy') AS attempt_utc FROM (
SELECT user_id AS record_id, event_type AS status, NULL AS attempt_utc FROM events UNION ALL SELECT user_id, event_type, CASE WHEN user_id % 2 = 0 THEN 'now' END FROM events)""")
def failure_history(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), F.col("event_type").alias("status"))
    return records.add_failures(e.withColumn("attempt_utc", F.lit(None).cast("string")), e.withColumn("attempt_utc", F.when(F.col("record_id") % 2 == 0, "now")))


@query("""
SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 4 <> 0 THEN l_discount END, 'inf'::DOUBLE) >= 0.05 AND NOT contains(l_returnflag || '|' || l_linestatus, 'R') AS accepted FROM lineitem""")
def correlation_filter(spark, sf_dir):
    i = A.table(spark, sf_dir, "lineitem").withColumns({"alignment_correlation": F.when(F.col("l_linenumber") % 4 != 0, F.col("l_discount")), "quality_flags": F.concat_ws("|", "l_returnflag", "l_linestatus")})
    return quality.correlation_filter(i, 0.05, ("R",)).select("l_orderkey", "l_linenumber", "accepted")


@query("""
WITH c AS (SELECT l_orderkey AS record_id, arg_max(l_extendedprice, (l_linenumber, l_extendedprice)) AS causal FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), o AS (SELECT l_orderkey AS record_id, arg_max(l_extendedprice, (l_linenumber, l_extendedprice)) AS offline FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT record_id, round(causal, 4) AS causal, round(offline, 4) AS offline FROM c JOIN o USING (record_id)""")
def causal_and_offline(spark, sf_dir):
    i = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_extendedprice").alias("predicted"), F.struct("l_linenumber", "l_extendedprice").alias("row"), "l_linestatus", "l_returnflag")
    pairs = quality.paired_predictions(i.withColumn("included", F.col("l_linestatus") == "F"), i.withColumn("included", F.col("l_returnflag") != "N"))
    return rounded(pairs, ["causal", "offline"], 4)


@query("""
SELECT c_custkey AS record_id, CASE WHEN o_custkey IS NOT NULL THEN top ELSE c_acctbal END AS alignment_correlation, CASE WHEN o_custkey IS NOT NULL THEN 'NEW' ELSE c_mktsegment END AS alignment_status
FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1) ON o_custkey = c_custkey""")
def updated_alignments(spark, sf_dir):
    rows = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_acctbal").alias("alignment_correlation"), F.col("c_mktsegment").alias("alignment_status"))
    new = A.table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").groupBy(F.col("o_custkey").alias("record_id")).agg(F.max("o_totalprice").alias("alignment_correlation")).withColumn("alignment_status", F.lit("NEW"))
    return quality.with_alignments(rows, new)
