"""Properties that the operators must have, on small made-up records."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swaylark.operators import alignment, audit, derivatives, features, filters, generators, geometry, models, quality, ranges, reseed, sets, spectral, timebase
from swaylark.sources import records
from swaylark.streaming import guard, online


def series(spark, values, times=None, record=1):
    times = times if times is not None else range(len(values))
    return spark.createDataFrame([(record, i, float(t), float(v), float(v), i) for i, (t, v) in enumerate(zip(times, values, strict=True))], "record_id long, seq long, t double, x double, y double, i long")


def column(df, name, by="seq"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_timebase_counts_a_missing_sample(spark):
    t = [k / 30 for k in range(30) if k != 10]
    r = timebase.diagnose(series(spark, [0] * 29, t)).first()
    assert r["missing"] == 1 and r["fps"] == pytest.approx(30)


def test_one_sample_and_no_samples(spark):
    one = series(spark, [3.0])
    assert timebase.diagnose(one).first()["missing"] == 0
    assert derivatives.backward(one).first()["velocity"] is None
    none = one.limit(0)
    for f in (timebase.diagnose, derivatives.gradient, derivatives.local_polynomial, features.motion_features, filters.detrend, filters.trapezoid):
        assert f(none).count() == 0
    assert filters.bandpass(none, 0.05, 0.4, 1.0).count() == 0


def test_backward_second_derivative_of_a_parabola(spark):
    t = [0, 0.1, 0.23, 0.4, 0.7]
    a = column(derivatives.backward(series(spark, [x * x for x in t], t)), "acceleration")
    assert a[:2] == [None, None] and a[2:] == pytest.approx([2, 2, 2])


def test_gradient_matches_numpy(spark):
    t = np.cumsum(np.random.default_rng(0).uniform(0.5, 1.5, 20))
    x = np.sin(t)
    want = np.gradient(x, t, edge_order=2)
    assert column(derivatives.gradient(series(spark, x, t)), "velocity") == pytest.approx(want.tolist())


def test_local_polynomial_matches_polyfit(spark):
    rng = np.random.default_rng(1)
    t, x = np.cumsum(rng.uniform(0.5, 1.5, 15)), rng.normal(size=15)
    got = derivatives.local_polynomial(series(spark, x, t)).orderBy("seq").collect()
    for r, j in zip(got, range(8, 15), strict=True):
        c = np.polyfit(t[j - 8 : j + 1] - t[j], x[j - 8 : j + 1], 2)
        assert (r["velocity"], r["acceleration"]) == pytest.approx((c[1], 2 * c[0]))


def test_derivatives_do_not_look_ahead(spark):
    x = np.random.default_rng(2).normal(size=30)
    y = x.copy()
    y[20:] += 1000
    for f in (derivatives.backward, derivatives.local_polynomial, lambda d: filters.bandpass(d, 0.05, 0.4, 1.0)):
        a, b = (f(series(spark, v)).where("seq < 20").orderBy("seq").collect() for v in (x, y))
        assert [r.asDict().get("velocity", r.asDict().get("filtered")) for r in a] == [r.asDict().get("velocity", r.asDict().get("filtered")) for r in b]


def test_running_peak_never_falls(spark):
    d = derivatives.running_peak(series(spark, [3, -2, float("nan"), 1]), "x", coefficient=2.0, research=True)
    r = d.orderBy("seq").collect()
    assert [x["running_proxy"] for x in r] == [3, 3, 3, 3] and [x["running_estimate"] for x in r] == [6, 6, None, 6]
    assert r[2]["confidence"] == "INVALID" and r[0]["interpretation"] == "RESEARCH_ONLY_UNCALIBRATED"


def test_butterworth_edges_and_zero_phase():
    s = filters.butterworth_bandpass(0.3, 8, 30)
    z = lambda f: np.exp(2j * np.pi * f / 30)
    gain = lambda f: abs(np.prod([(b0 + b1 / z(f) + b2 / z(f) ** 2) / (1 + a1 / z(f) + a2 / z(f) ** 2) for b0, b1, b2, _, a1, a2 in s]))
    assert gain(0.3) == pytest.approx(2**-0.5, rel=1e-6) and gain(8) == pytest.approx(2**-0.5, rel=1e-6) and gain(1.5) == pytest.approx(1, rel=1e-3)
    t = np.arange(300) / 30
    clean = np.sin(2 * np.pi * 2 * t)
    (y,) = filters.zero_phase(s, [clean + 0.5 * np.sin(2 * np.pi * 12 * t)])
    assert np.corrcoef(y, clean)[0, 1] > 0.98
    with pytest.raises(ValueError):
        filters.butterworth_bandpass(8, 0.3, 30)
    assert filters.zero_phase(s, [np.zeros(27)]) == [None]
    held, _ = filters.run_sections(s, np.full(50, 4.0), filters.steady_state(s) * 4.0)
    assert np.abs(held).max() < 1e-9


def test_blocks(spark):
    b = timebase.hopping_blocks(series(spark, [0] * 10), 4, 2)
    got = {}
    for r in b.collect():
        got.setdefault(r["block"], []).append(r["i"])
    assert {k: sorted(v) for k, v in got.items()} == {0: [0, 1, 2, 3], 1: [2, 3, 4, 5], 2: [4, 5, 6, 7], 3: [6, 7, 8, 9]}
    final = timebase.finalized(b, 2, 4)
    assert sorted(r["i"] for r in final.collect()) == list(range(10))
    assert timebase.hopping_blocks(series(spark, [0] * 3), 4, 2).count() == 0


def test_dominant_frequency(spark):
    t = np.arange(120) / 30
    s = spectral.dft(series(spark, np.sin(2 * np.pi * 2 * t), t))
    assert spectral.dominant_frequency(s, 30.0).first()["dominant_hz"] == pytest.approx(2.0)
    assert spectral.dft(series(spark, [1.0, float("nan"), 2.0, 3.0])).count() == 0


def test_surrogates_keep_the_spectrum():
    x = np.random.default_rng(3).normal(size=64)
    y = spectral.phase_surrogate(x, np.random.default_rng(4))
    assert np.abs(np.fft.rfft(y)) == pytest.approx(np.abs(np.fft.rfft(x))) and not np.allclose(x, y)


def grid_points(spark):
    base = [(k, 10.0 + 25 * (k % 8), 10.0 + 20 * (k // 8)) for k in range(40)]
    c, s = 1.003 * np.cos(0.02), 1.003 * np.sin(0.02)
    rows = [(0, k, float(c * x - s * y) + 0.4 + (4 if k >= 32 else 0), float(s * x + c * y) - 0.25 - (3 if k >= 32 else 0), x, y) for k, x, y in base]
    return spark.createDataFrame(rows, "frame long, point_id long, x double, y double, x0 double, y0 double")


def test_robust_similarity_finds_the_inliers(spark):
    r = geometry.robust_motion(grid_points(spark), "similarity", 0.5, 200.0, 100.0).first()
    assert r["n_inliers"] == 32 and r["rotation"] == pytest.approx(0.02) and r["scale"] == pytest.approx(1.003) and r["tx"] == pytest.approx(0.4)


def test_fits_of_coincident_points_have_no_scale(spark):
    same = grid_points(spark).withColumns({"x0": F.lit(1.0), "y0": F.lit(1.0)})
    assert geometry.fit_similarity(same).first()["a"] is None and geometry.fit_affine(same).first()["a"] is None
    assert geometry.robust_motion(same, "similarity").first()["n_inliers"] == 0


MODELS = {"translation": [[1, 0, 3], [0, 1, -2], [0, 0, 1]], "similarity": [[1, -0.1, 3], [0.1, 1, -2], [0, 0, 1]], "affine": [[1.1, 0.2, 3], [0.1, 0.9, -2], [0, 0, 1]], "homography": [[1.1, 0.2, 3], [0.1, 0.9, -2], [1e-4, 2e-4, 1]]}


def moved(m, a):
    out = np.c_[a, np.ones(len(a))] @ np.array(m).T
    return out[:, :2] / out[:, 2:]


def design(model, a, b):
    x, y, o, z = a[:, 0], a[:, 1], np.ones(len(a)), np.zeros(len(a))
    if model == "similarity":
        return np.r_[np.c_[x, -y, o, z], np.c_[y, x, z, o]], np.r_[b[:, 0], b[:, 1]]
    return np.r_[np.c_[x, y, o, z, z, z], np.c_[z, z, z, x, y, o]], np.r_[b[:, 0], b[:, 1]]


def plain_fit(model, a, b):
    if model == "translation":
        return np.array([[1, 0, (b - a)[:, 0].mean()], [0, 1, (b - a)[:, 1].mean()], [0, 0, 1]])
    if model == "homography":
        rows = [r for (x, y), (u, v) in zip(a, b, strict=True) for r in ([-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v])]
        h = np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3)
        return h / h[2, 2]
    got = np.linalg.lstsq(*design(model, a, b), rcond=None)[0]
    return np.array([[got[0], -got[1], got[2]], [got[1], got[0], got[3]], [0, 0, 1]]) if model == "similarity" else np.vstack([got.reshape(2, 3), [0, 0, 1]])


@pytest.mark.parametrize("model", MODELS)
def test_weighted_fits(model):
    rng = np.random.default_rng(5)
    a = rng.uniform(0, 100, (12, 2))
    b = moved(MODELS[model], a)
    w = (rng.random((6, 12)) < 0.7).astype(float)
    w[0], w[5] = 1, 0
    m, condition = geometry.weighted_fits(model, a, b, w)
    assert m[0] == pytest.approx(np.array(MODELS[model]), abs=1e-6) and np.isnan(m[5]).any()
    noisy = b + rng.normal(0, 0.5, b.shape)
    m, condition = geometry.weighted_fits(model, a, noisy, w)
    for k in range(5):
        at = w[k] > 0
        assert m[k] == pytest.approx(plain_fit(model, a[at], noisy[at]), abs=1e-5)
        if model in ("similarity", "affine"):
            assert condition[k] == pytest.approx(np.linalg.cond(design(model, a[at], noisy[at])[0]), rel=1e-6)


def test_homographies_of_subsets_solve_for_their_own_points_alone(monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.uniform(0, 100, (28, 2))
    b = moved(MODELS["homography"], a) + rng.normal(0, 0.3, a.shape)
    sizes, real = [], np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda m, full_matrices=True: sizes.append((m.shape[1:], full_matrices)) or real(m, full_matrices=full_matrices))
    w = geometry.least_subsets(28, 4, 50, 1)
    m, condition = geometry.weighted_fits("homography", a, b, w)
    again, same = geometry.weighted_fits("homography", a, b, np.vstack([w, np.ones((1, 28))]))  # of several sizes: all rows
    assert sizes == [((8, 9), True), ((56, 9), False)]
    assert m == pytest.approx(again[:50], rel=1e-5, abs=1e-7) and condition.shape == (50,) and same.shape == (51,)
    del sizes[:]
    assert geometry.exact_homographies(a, b, w) == pytest.approx(m, rel=1e-5, abs=1e-7) and not sizes  # no decomposition for a subset
    a[:4, 1] = a[:4, 0]  # four on a line, which fix nothing
    loose = geometry.exact_homographies(a, b, np.vstack([w, np.arange(28) < 4]))
    assert loose[:50][w[:, :4].sum(1) == 0] == pytest.approx(m[w[:, :4].sum(1) == 0], rel=1e-5, abs=1e-7)
    a = rng.uniform(0, 100, (28, 2))
    m, _ = geometry.weighted_fits("homography", a, b, w)
    for k in range(3):
        assert m[k] == pytest.approx(plain_fit("homography", a[w[k] > 0], b[w[k] > 0]), rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("model", MODELS)
def test_consensus_against_every_subset(model):
    from itertools import combinations

    k = geometry.LEAST_POINTS[model]
    for seed in range(4):
        rng = np.random.default_rng(seed)
        a = rng.uniform(0, 100, (9, 2))
        b = moved(MODELS[model], a) + rng.normal(0, 0.3, a.shape)
        b[:3] += rng.uniform(5, 20, (3, 2))
        best = None
        for sub in combinations(range(9), k):
            e = np.linalg.norm(moved(plain_fit(model, a[list(sub)], b[list(sub)]), a) - b, axis=1)
            near = e <= 1.5
            if near.sum() >= k and (best is None or (near.sum(), -round(np.median(e[near]), 9)) > best[0]):
                best = (near.sum(), -round(np.median(e[near]), 9)), near
        keep = best[1]
        m = plain_fit(model, a[keep], b[keep])
        again = np.linalg.norm(moved(m, a) - b, axis=1) <= 1.5
        if again.sum() >= k and (again != keep).any():
            keep, m = again, plain_fit(model, a[again], b[again])
        got, inliers, _ = geometry.consensus(model, a, b, 1.5, 200)
        assert (inliers == keep).all() and got == pytest.approx(m, abs=1e-5)
    drawn = geometry.least_subsets(30, k, 100, 3)
    assert len(drawn) == (30 if k == 1 else 100) and (drawn.sum(1) == k).all() and len({tuple(x) for x in drawn}) > 25


def test_decomposition_leaves_the_local_motion(spark):
    points = grid_points(spark)
    tracks = points.select("frame", "point_id", "x", "y", F.lit(True).alias("visible"))
    tracks = tracks.unionByName(tracks.where("point_id < 1").withColumn("frame", F.lit(1).cast("long")))
    frames, left = geometry.decompose_tracks(tracks, points.select("point_id", "x0", "y0"), threshold=0.5, width=200.0, height=100.0)
    got = {r["frame"]: (r["quality"], r["reasons"], r["n_inliers"]) for r in frames.collect()}
    assert got == {0: ("GOOD", "", 32), 1: ("INVALID", "transform_fit_failed", 0)}
    for r in left.where("frame = 0").collect():
        assert r["residual"] == pytest.approx(5.0 if r["point_id"] >= 32 else 0.0, abs=1e-6) and r["inlier"] == (r["point_id"] < 32)
    assert left.where("frame = 1").first()["residual"] is None


def test_gate_compares_with_the_last_sound_frame(spark):
    rows = [(0, 20, 20, 1.0, 0.1, 1.0, 0.5, 0.0, 0.0, 0.0), (1, 20, 2, 0.1, 0.1, 1.0, 0.5, 90.0, 0.0, 0.0), (2, 20, 20, 1.0, 0.1, 1.0, 0.5, 1.0, 0.0, 0.0), (3, 20, 20, 1.0, None, 1.0, 0.01, 50.0, 0.0, 0.2)]
    df = spark.createDataFrame(rows, "frame long, n long, n_inliers long, inlier_ratio double, fit_rmse double, condition double, coverage double, tx double, ty double, rotation double")
    r = geometry.quality_gate(df).orderBy("frame").collect()
    assert [x["quality"] for x in r] == ["GOOD", "INVALID", "GOOD", "INVALID"]
    assert r[1]["reasons"] == "insufficient_inliers|low_inlier_ratio|translation_jump" and r[3]["reasons"] == "high_fit_rmse|poor_spatial_coverage|translation_jump|rotation_jump"


def test_alignment_recovers_a_planted_offset(spark):
    rng = np.random.default_rng(6)
    st = np.arange(1000) / 100
    sx = np.convolve(rng.normal(size=1000), np.ones(20) / 20, "same")
    vt = np.arange(240) / 30
    vx = -np.interp(vt + 0.18, st, sx)
    v = series(spark, vx, vt).withColumn("y", F.lit(0.0))
    s = series(spark, sx, st)
    best = alignment.best_alignment(alignment.alignment_grid(v, s, [k * 0.06 for k in range(-3, 7)], ["x"], ["x"])).first()
    assert best["offset"] == pytest.approx(0.18) and best["polarity"] == -1 and best["status"] == "ALIGNED"


def test_q_values_rise_with_rank(spark):
    p = [0.01, 0.04, 0.03, 0.2]
    r = alignment.bh_q_values(spark.createDataFrame([(k, x) for k, x in enumerate(p)], "record_id long, p_value double")).orderBy("p_value").collect()
    q = [x["q_value"] for x in r]
    assert q == sorted(q) and q[0] == pytest.approx(0.04) and q[-1] == pytest.approx(0.2)


def regression(spark, outlier=False):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 3))
    y = np.exp(2 + x @ [0.5, -0.3, 0.2])
    if outlier:
        y[-1] *= 100
    return spark.createDataFrame([(k, k % 10, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))], "record_id long, grp long, f1 double, f2 double, f3 double, target double")


def test_models(spark):
    f = ["f1", "f2", "f3"]
    df = regression(spark)
    m = models.from_json(models.to_json(models.fit(df, "log_linear", f)))
    assert models.metrics(models.predict(df, m)).first()["log_mae"] < 1e-8
    with pytest.raises(ValueError):
        models.predict(df, m, scale_valid=False)
    bad = regression(spark, True)
    err = lambda a: models.metrics(models.predict(df, models.fit(bad, a, f))).first()["log_mae"]
    assert err("huber") < err("ridge")


def test_folds_keep_groups_together(spark):
    r = models.group_folds(regression(spark), 5).select("grp", "fold").distinct().collect()
    assert len(r) == 10 and {x["fold"] for x in r} == set(range(5))


def test_metrics_of_a_constant_have_no_correlation(spark):
    df = regression(spark).withColumn("predicted", F.lit(3.0))
    r = models.metrics(df).first()
    assert r["pearson"] is None and r["spearman"] is None


def test_quality_never_reads_the_truth(spark):
    df = spark.createDataFrame([(1, 30.0, None, "GOOD"), (2, 5.0, 0.9, "INVALID")], "record_id long, mean_active_track_count double, mean_visibility double, quality_flags string")
    r = quality.video_quality(df, {"min_tracks": 10, "min_visibility": 0.5}).orderBy("record_id").collect()
    assert r[0]["state"] == "PASS_WITH_UNKNOWN_METRICS" and "mean_visibility" in r[0]["reason"]
    assert r[1]["reason"] == "MOTION_QUALITY_INVALID|mean_active_track_count_OUT_OF_RANGE"


def test_reseed_jump(spark):
    d = reseed.innovations(series(spark, [0.0] * 10 + [2.0] * 10))
    assert column(d, "jump")[10] == pytest.approx(2.0)


def test_audit(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 3.0), (1, 2.0, float("nan")), (2, 0.0, 5.0)], "k long, t double, v double")
    r = audit.summarize(df, ["v"]).first()
    assert (r["n"], r["mean"], r["max"]) == (3, 3.0, 5.0)
    assert [x["slope"] for x in audit.slope(df.where("NOT isnan(v)"), "v", ["k"], ["t"]).orderBy("k").collect()] == [2.0, None]


def test_queue_rejects_and_counts(spark):
    r = audit.bounded_queue(series(spark, [0] * 4, [0, 0.1, 0.2, 0.3]), 2, 10.0).first()
    assert (r["accepted"], r["rejected"]) == (2, 2)


def test_sets(spark):
    names = spark.createDataFrame([(x,) for x in ("b", "10", "2", "a1")], "name string")
    assert [r["name"] for r in sets.naturally_first(names, "name", 4).collect()] == ["2", "10", "a1", "b"]


def test_stress_matrix_size(spark):
    m = generators.stress_matrix(spark, [0.1] * 4, [1.0] * 7, [30.0] * 5, [0.0] * 4, ["s"] * 8)
    assert m.count() == 4 * 7 * 5 + 4 * 5 + 8 * 4


def test_record_sources(spark, tmp_path):
    (tmp_path / "1-1.txt").write_text("﻿Time(s)\tEW\tNS\tUD\n0\t10\t0\t0\nbad\tline\n1\t-3\t4\t5\n", encoding="utf-8")
    s = records.read_sensor_text(spark, str(tmp_path / "1-1.txt"))
    assert s.count() == 2
    p = features.sensor_peaks(s.withColumn("record_id", F.lit(1)), "ew", "ns", "ud").first()
    assert (p["pga_horizontal"], p["pga_component"]) == (10.0, 10.0)
    (tmp_path / "e.jsonl").write_text('{"event": "reseed", "frame_index": 3}\nnot json\n')
    assert sorted(r["event"] for r in records.read_events(spark, str(tmp_path / "e.jsonl")).collect()) == ["malformed_event_line", "reseed"]
    files = spark.createDataFrame([(f"/x/{n}",) for n in ("54.avi", "1.avi", "54-1.txt", "54-2.txt")], "path string")
    assert [(r["record_id"], r["status"]) for r in records.pair_files(files).collect()] == [("1", "missing_strong_motion"), ("54", "paired_split_sensor")]


def test_segments_become_monotone(spark):
    rows = [(1, s, k, float(t)) for s, ts in ((1, [0, 1]), (2, [0, 1])) for k, t in enumerate(ts)]
    out = records.concat_segments(spark.createDataFrame(rows, "record_id long, segment int, seq int, t double"))
    assert [r["t"] for r in out.orderBy("segment", "seq").collect()] == [0, 1, 2, 3]


def test_failures_and_resume(spark):
    h = spark.createDataFrame([(1, "x", None)], "record_id long, status string, attempt_utc string")
    assert records.add_failures(h, h).count() == 1
    done = spark.createDataFrame([(1, 1)], "record_id long, causal int")
    assert [r[0] for r in records.unfinished(spark.range(1, 3).withColumnRenamed("id", "record_id"), done, causal=1).collect()] == [2]
    with pytest.raises(ValueError):
        records.unfinished(done, done, causal=0)
    with pytest.raises(ValueError):
        records.check_blocks(16, 8, (0, 7))


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    df = series(spark, rng.normal(size=30)).unionByName(series(spark, rng.normal(size=30), record=2)).select("record_id", "seq", "t", "x")
    for k in range(3):
        df.where(F.col("seq").between(10 * k, 10 * k + 9)).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    want = online.online_signal(df).orderBy("record_id", "seq").collect()
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    q = online.online_signal(stream).writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(online.fan_out(str(tmp_path / "out"))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out/online_signal")).orderBy("record_id", "seq").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_late_samples_are_rejected_not_dropped(spark):
    r = online.online_signal(series(spark, [1, 2, 3], [0, 2, 1])).orderBy("seq").collect()
    assert [x["rejected"] for x in r] == [False, False, True]
    s = online.OnlineSignal(filters.butterworth_bandpass(0.05, 0.4, 1.0))
    assert s.update(0.0, float("nan")) is None and json.loads(s.dump())[6] == 0


def test_last_before_over_the_whole_table(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i), float(i) if rng.random() < 0.2 else None) for i in rng.permutation(200)]
    got = {r["t"]: r["out"] for r in ranges.last_before(spark.createDataFrame(rows, "t long, v double"), "v", "out", "t").collect()}
    held = None
    for t, v in sorted(rows):
        assert got[t] == held
        held = v if v is not None else held


def test_average_ranks_against_pandas(spark):
    rng = np.random.default_rng(12)
    df = pd.DataFrame({"g": rng.integers(0, 3, 300), "v": rng.integers(0, 40, 300) / 4.0, "k": range(300)})
    for keys in (None, ["g"]):
        got = models.average_ranks(spark.createDataFrame(df), "v", "r", keys).toPandas().set_index("k")["r"].sort_index()
        want = (df.groupby("g")["v"] if keys else df["v"]).rank()
        assert np.allclose(got.to_numpy(), want.to_numpy())


def test_q_values_against_the_definition(spark):
    p = np.random.default_rng(13).random(150) ** 3
    got = {r["record_id"]: r["q_value"] for r in alignment.bh_q_values(spark.createDataFrame(list(enumerate(map(float, p))), "record_id long, p_value double")).collect()}
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * 150 / np.arange(1, 151))[::-1])[::-1]
    assert all(got[int(i)] == pytest.approx(min(1, x)) for i, x in zip(order, q, strict=True))


def huber(x, y, alpha=1.0, rounds=30, k=1.345):
    mean, sd = x.mean(0), x.std(0)
    z = np.c_[np.ones(len(x)), (x - mean) / sd]
    solve = lambda w: np.linalg.solve(z.T @ (z * w[:, None]) + np.diag([0.0] + [alpha] * x.shape[1]), z.T @ (w * y))
    beta = solve(np.ones(len(y)))
    for _ in range(rounds):
        r = y - z @ beta
        spread = max(1.4826 * np.median(np.abs(r - np.median(r))), 1e-12)
        new = solve(np.minimum(1, k * spread / np.maximum(np.abs(r), 1e-12)))
        done, beta = np.abs(new - beta).max() < 1e-8, new
        if done:
            break
    return lambda q: np.exp(np.c_[np.ones(len(q)), (q - mean) / sd] @ beta)


@pytest.mark.parametrize("few", [8, 1 << 15])
def test_huber_rows_are_not_repeated_for_each_fold_and_medians_are_cut_down_exactly(spark, monkeypatch, few):
    rng = np.random.default_rng(12)
    n = 120
    x = np.round(rng.uniform(1, 9, (n, 3)), 1)
    y = np.exp(0.3 * x[:, 0] - 0.1 * x[:, 1] + 3 + rng.normal(0, 0.3, n) + (np.arange(n) % 20 == 0))
    y[:12], x[:12] = 50.0, 4.0  # many equal residuals
    fold = np.arange(n) % 3
    df = spark.createDataFrame([(i, int(f), *map(float, a), float(b)) for i, (f, a, b) in enumerate(zip(fold, x, y, strict=True))], "record_id long, fold int, f1 double, f2 double, f3 double, target double")
    monkeypatch.setattr(models, "BINS", 64)
    monkeypatch.setattr(models, "FEW", few)
    monkeypatch.setattr(models, "train_rows", None)
    got = models.cross_validated(df, "huber", ["f1", "f2", "f3"], 3).toPandas().set_index("record_id")["predicted"].sort_index()
    for f in range(3):
        fitted = huber(x[fold != f], np.log(y[fold != f]))
        assert got[fold == f].to_numpy() == pytest.approx(fitted(x[fold == f]), rel=1e-6)


def test_cross_validated_huber_against_numpy(spark):
    df = models.group_folds(regression(spark, True).withColumn("side", F.when(F.col("record_id") % 4 == 0, "b").otherwise("a")), 5)
    got = models.cross_validated(df, "huber", ["f1", "f2", "f3"], 5, by=["side"]).toPandas()
    for (side, fold), part in got.groupby(["side", "fold"]):
        rest = got[(got.side == side) & (got.fold != fold)]
        f = huber(rest[["f1", "f2", "f3"]].to_numpy(), np.log(rest["target"].to_numpy()))
        assert np.allclose(part["predicted"], f(part[["f1", "f2", "f3"]].to_numpy()), rtol=1e-5)


def test_inputs_of_another_version_are_refused(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1)], "feature_version string, causal int")
    assert models.checked_inputs(df, "a") == "PASS" and models.checked_inputs(df.withColumn("causal", F.lit(0)), "a") == "FAIL"
    with pytest.raises(ValueError):
        models.checked_inputs(df, "b")


def test_picked_points(spark):
    good = spark.createDataFrame([(1.0, 2.0), (0.0, 0.0)], "x double, y double")
    assert features.checked_points(good, 10, 10, 2).count() == 2
    for bad in ((10.0, 1.0), (1.0, -0.1), (float("nan"), 1.0), (None, 1.0)):
        with pytest.raises(Exception, match="outside|finite"):
            features.checked_points(spark.createDataFrame([bad], "x double, y double"), 10, 10).collect()
    with pytest.raises(ValueError):
        features.checked_points(good, 10, 10, 3)


def test_decimation_against_a_loop(spark):
    rng = np.random.default_rng(14)
    t = np.cumsum(rng.choice([0.03, 0.04, 0.3], 80, p=[0.5, 0.4, 0.1]))
    got = [(r["seq"], r["emitted"]) for r in timebase.decimate(series(spark, [0] * 80, t), 0.1, 0.04).orderBy("emitted").collect()]
    want, n = [], 0
    for i, x in enumerate(t):
        if x + 0.02 >= n * 0.1:
            want.append((i, n))
            n += 1
    assert got == want


@pytest.mark.parametrize("n", [1, 3, 4, 9, 10, 11])
def test_padded_blocks_leave_no_sample_out(spark, n):
    rows = timebase.padded_blocks(series(spark, [0] * n, [0.5 * k for k in range(n)]), 4, 2).collect()
    blocks = {}
    for r in rows:
        blocks.setdefault(r["block"], []).append((r["place"], r["padded"], r["i"], r["t"]))
    assert {i for b in blocks.values() for _, p, i, _ in b if not p} == set(range(n))
    for k, b in blocks.items():
        assert sorted(x[0] for x in b) == [0, 1, 2, 3] and all(t == pytest.approx(0.5 * (k * 2 + place)) or n == 1 for place, _, _, t in b)


def test_centred_cubic_at_the_ends(spark):
    rng = np.random.default_rng(15)
    t = np.cumsum(rng.uniform(0.02, 0.05, 15))
    x = rng.normal(size=15)
    d = derivatives.local_polynomial(series(spark, x, t), order=3, centred=True).orderBy("seq").collect()
    for i, r in enumerate(d):
        end = min(15, max(0, i - 4) + 9)
        c = np.polynomial.polynomial.polyfit(t[end - 9 : end] - t[i], x[end - 9 : end], 3)
        assert r["velocity"] == pytest.approx(c[1], rel=1e-4, abs=1e-3) and r["acceleration"] == pytest.approx(2 * c[2], rel=1e-3, abs=1e-1)


def test_zero_phase_of_many_records_at_once(spark):
    rng = np.random.default_rng(16)
    parts = {k: rng.normal(size=n) for k, n in ((1, 40), (2, 27), (3, 90))}
    df = None
    for k, x in parts.items():
        df = series(spark, x, record=k) if df is None else df.unionByName(series(spark, x, record=k))
    s = filters.butterworth_bandpass(0.05, 0.4, 1.0)
    zi = filters.steady_state(s)
    for name, f in (("filtered", lambda d: filters.bandpass(d, 0.05, 0.4, 1.0, "zero_phase")), ("displacement", lambda d: filters.acceleration_to_displacement(d, 0.05, 0.4, 1.0))):
        got = f(df).orderBy("record_id", "seq").toPandas()
        for k, x in parts.items():
            own = got[got.record_id == k][name].to_numpy()
            if len(x) <= 27:
                assert np.isnan(own).all()
                continue

            def smooth(v):
                long = np.concatenate([2 * v[0] - v[27:0:-1], v, 2 * v[-1] - v[-2:-29:-1]])
                ahead, _ = filters.run_sections(s, long, zi * long[0])
                return filters.run_sections(s, ahead[::-1], zi * ahead[-1])[0][::-1][27:-27]

            flat = lambda v: v - np.polyval(np.polyfit(np.arange(len(v)), v, 1), np.arange(len(v)))
            total = lambda v: np.concatenate([[0], np.cumsum((v[1:] + v[:-1]) / 2)])
            want = smooth(x) if name == "filtered" else smooth(flat(total(flat(total(smooth(flat(x)))))))
            assert own == pytest.approx(want)


@pytest.mark.parametrize("method", ["phase", "shift"])
def test_null_test_repeats_the_search(spark, method):
    rng = np.random.default_rng(17)
    st, t = np.arange(300) / 10, np.arange(60) / 10 + 8
    sensor = np.convolve(rng.normal(size=300), np.ones(5) / 5, "same")
    planted = np.interp(t + 0.5, st, sensor)
    noise = rng.normal(size=60)
    rows = [(k, t.tolist(), [v.tolist()], st.tolist(), [sensor.tolist()]) for k, v in ((1, planted), (2, noise))]
    df = spark.createDataFrame(rows, "record_id long, t array<double>, v array<array<double>>, st array<double>, sv array<array<double>>")
    offsets = [k * 0.1 for k in range(-10, 11)]
    got = {r["record_id"]: r for r in alignment.null_test(df, 99, offsets, method=method).collect()}
    assert got[1]["observed"] == pytest.approx(1.0) and got[1]["offset"] == pytest.approx(0.5)
    assert got[1]["p_value"] == pytest.approx(0.01) if method == "phase" else got[1]["p_value"] < 0.15  # a turn by less than the offsets searched is undone
    best = max(abs(np.corrcoef(noise, np.interp(t + o, st, sensor))[0, 1]) for o in offsets)
    assert got[2]["observed"] == pytest.approx(best) and got[2]["p_value"] > 0.05
    with pytest.raises(ValueError):
        alignment.null_test(df, 9, offsets, method="other")


def test_verdicts(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 9.0), (3, 1.0)], "run long, spike_ratio double")
    got = {(r["run"], r["criterion"]): r["verdict"] for r in audit.verdict_table(spark.range(1, 5).withColumnRenamed("id", "run"), ("reseed", audit.reseed_status(df, "run"), "status")).collect()}
    assert list(got.values()) and got[1, "reseed"] == "PASS_P95_RATIO_LE_3" and got[2, "reseed"] == "FAIL_REVIEW_REQUIRED" and got[3, "reseed"] == "NOT_EVALUABLE_SINGLE_EVENT_BELOW_THRESHOLD" and got[4, "reseed"] == "NOT_MEASURED"


def test_a_failing_stream_leaves_an_event(spark, tmp_path):
    import time

    spark.range(5).write.parquet(str(tmp_path / "in"))
    audit_log = guard.RunAudit()
    spark.streams.addListener(audit_log)
    try:
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        bad = stream.select(F.when(F.col("id") >= 0, F.raise_error(F.lit("no such thing"))).alias("x"))
        good = stream.writeStream.queryName("good").format("noop").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
        good.awaitTermination(60)
        q = bad.writeStream.queryName("bad").format("noop").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="no such thing"):
            q.awaitTermination(60)
        for _ in range(100):
            if audit_log.events and audit_log.timing:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(audit_log)
    (event,) = audit_log.event_rows(spark).collect()
    assert event["worker"] == "bad" and event["action"] == "stop_without_output_claim" and audit_log.timing_rows(spark).where("worker = 'good'").agg(F.sum("rows")).first()[0] == 5
    audit_log.write(spark, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log/events")).count() == 1


def test_sensor_files_are_checked(spark, tmp_path):
    for name, lines in (("good", ["0\t1\t2\t3", "1\t1\t2\t3"]), ("short", ["0\t1\t2\t3"]), ("falls", ["1\t1\t2\t3", "0\t1\t2\t3"])):
        (tmp_path / f"{name}.txt").write_text("\n".join(["t\tew\tns\tud", *lines]) + "\n")
        s = records.checked_sensors(records.read_sensor_text(spark, str(tmp_path / f"{name}.txt")))
        if name == "good":
            assert [r["t"] for r in s.orderBy("seq").collect()] == [0, 1]
        else:
            with pytest.raises(Exception, match="no usable|do not rise"):
                s.collect()
    (tmp_path / "b.csv").write_text("k\n1\n")
    assert records.read_all_strings(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv")).count() == 1
    assert records.read_all_strings(spark, str(tmp_path / "a.csv"), columns=["k"]).columns == ["k"]


def test_configurations(spark, tmp_path):
    good = {"video": {}, "motion": {}, "scale": {}, "pga": {}, "tracker": {"window_len": 16, "step": 8, "num_points": 5, "source_timestamp_future_context_frames": [8, 15]}, "signal": {"bandpass_hz": [0.3, 8]}, "runtime": {"target_fps": 30, "max_queue_blocks": 4}}
    (tmp_path / "c.json").write_text(json.dumps(good))
    assert records.read_config(spark, str(tmp_path / "c.json")) == good and records.config_sha256(good) == records.config_sha256(json.loads(json.dumps(good, sort_keys=True)))
    for path, value in (("tracker.step", 17), ("tracker.window_len", 1), ("tracker.source_timestamp_future_context_frames", [7, 15]), ("tracker.num_points", 0), ("runtime.target_fps", 0), ("signal.bandpass_hz", [8, 3])):
        bad = json.loads(json.dumps(good))
        section, name = path.split(".")
        bad[section][name] = value
        with pytest.raises(records.ConfigError):
            records.checked_config(bad)
    with pytest.raises(records.ConfigError, match="pga"):
        records.checked_config({k: v for k, v in good.items() if k != "pga"})


def test_batches_of_the_same_points_are_one(spark):
    part = lambda ids, f, r: spark.createDataFrame([(f, i, r) for i in ids], "frame long, point_id long, reseed_id long")
    both = sets.concatenated_tracks([part([1, 2], 0, 3), part([1, 2], 1, 5)])
    assert both.count() == 4 and {r["reseed_id"] for r in both.collect()} == {5}
    with pytest.raises(ValueError):
        sets.concatenated_tracks([part([1, 2], 0, 3), part([1, 3], 1, 5)])


@pytest.mark.parametrize("scene", generators.SCENES)
def test_scenes_decompose_to_what_they_were_made_of(spark, scene):
    truth = generators.scene_tracks(spark, scene, seconds=0.5, columns=5, rows=4)
    reference = truth.where("frame = 0").select("point_id", "x0", "y0")
    frames, _ = geometry.decompose_tracks(truth.select("frame", "point_id", "x", "y", "visible"), reference, threshold=0.2, width=320.0, height=240.0, tries=200, least_tracks=5, least_coverage=0.01)
    true = truth.groupBy("frame").agg(F.first("rotation").alias("true_rotation"))
    name = lambda d: d.withColumn("case_id", F.lit(scene))
    r = generators.case_metrics(name(truth), name(truth), name(frames.join(true, "frame"))).first()
    assert r["frames"] == 15 and r["points"] == 20 and r["point_rmse_px"] == 0 and r["track_survival_ratio"] == 1
    assert r["rotation_rmse_deg"] < (1e-6 if "local" not in scene and scene != "degraded" else 0.2) and r["motion_good_fraction"] == 1
    with pytest.raises(ValueError):
        generators.scene_tracks(spark, "other")


def test_online_motion_is_causal_and_streams(spark, tmp_path):
    rng = np.random.default_rng(18)
    rows = [(1, k, float(k), *map(float, rng.normal(size=2)), rng.normal(size=(4, 2)).tolist(), "GOOD", k // 10) for k in range(25)]
    schema = "record_id long, seq long, t double, x double, y double, local array<array<double>>, quality string, reseed_id long"
    df = spark.createDataFrame(rows, schema)
    want = online.online_motion(df).orderBy("seq").collect()
    assert [r["reseed_boundary"] for r in want] == [k in (10, 20) for k in range(25)] and want[1]["startup_state"] == "WARMUP_2_OF_3" and want[5]["retained_history_samples"] == 3
    one = online.online_signal(df).orderBy("seq").collect()
    for a, b in zip(want, one, strict=True):
        assert a["filtered_common_x"] == pytest.approx(b["filtered"])
        if b["acceleration"] is not None:
            assert a["common_acceleration_x"] == pytest.approx(b["acceleration"])
    changed = [(*r[:3], r[3] + 1000 * (r[1] >= 20), *r[4:]) for r in rows]
    again = online.online_motion(spark.createDataFrame(changed, schema)).orderBy("seq").collect()
    assert [str(tuple(r)) for r in again[:20]] == [str(tuple(r)) for r in want[:20]]
    odd = [(1, 0, 0.0, 0.0, 0.0, [[0.0, 0.0]], "GOOD", 0), (1, 1, 0.0, 0.0, 0.0, [[0.0, 0.0]], "GOOD", 0), (1, 2, 2.0, 0.0, 0.0, [[0.0, 0.0]] * 2, "GOOD", 0), (1, 3, 3.0, 0.0, float("nan"), [[0.0, 0.0]], "GOOD", 0)]
    assert [r["rejected"] for r in online.online_motion(spark.createDataFrame(odd, schema)).orderBy("seq").collect()] == [False, True, True, True]
    for k in range(2):
        df.where((F.col("seq") >= 13) == F.lit(bool(k))).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = online.online_motion(stream).writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(online.fan_out(str(tmp_path / "out"))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out/online_signal")).orderBy("seq").collect()
    assert [str(tuple(r)) for r in got] == [str(tuple(r)) for r in want]
