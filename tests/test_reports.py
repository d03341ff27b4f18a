"""Reseed rows, group reports, point choices, configurations and scenes against loops."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swaylark.operators import generators, geometry, models, reseed
from swaylark.sources import records


def one_reseed(t, xy, common, turn, acc, quality, at):
    jump = np.linalg.norm(xy[at] - (2 * xy[at - 1] - xy[at - 2]), axis=1)
    before, after = (common[at - 1] - common[at - 2]) / (t[at - 1] - t[at - 2]), (common[at] - common[at - 1]) / (t[at] - t[at - 1])
    size, r = np.linalg.norm(acc, axis=1), max(3, int(round(0.5 / np.median(np.diff(t)))))
    near = np.nanmedian(size[max(0, at - r) : at + r + 1])
    return [t[at], np.nanmean(jump), np.nanpercentile(jump, 95), np.linalg.norm(common[at] - (2 * common[at - 1] - common[at - 2])), np.degrees(abs(turn[at] - (2 * turn[at - 1] - turn[at - 2]))), np.linalg.norm(after - before), size[at], size[at] / max(near, 1e-12), quality[at - 1], quality[at]]


@pytest.mark.parametrize("step", [0.4, 1 / 30])
def test_reseed_rows_against_a_loop(spark, step):
    rng, n, many = np.random.default_rng(3), 60, 7
    t = np.cumsum(rng.uniform(0.8, 1.2, n)) * step
    xy, common, turn, acc = rng.normal(size=(n, many, 2)), rng.normal(size=(n, 2)), rng.normal(size=n), rng.normal(size=(n, 2))
    xy[20, 3], acc[31] = np.nan, np.nan
    quality = [("GOOD", "DEGRADED", "INVALID")[k % 3] for k in range(n)]
    motion = spark.createDataFrame([(1, k, float(t[k]), *map(float, common[k]), float(turn[k]), *map(float, acc[k]), quality[k]) for k in range(n)], "record_id long, i long, t double, tx double, ty double, rotation double, ax double, ay double, quality string")
    tracks = spark.createDataFrame([(1, k, p, *map(float, xy[k, p])) for k in range(n) for p in range(many)], "record_id long, i long, point_id long, x double, y double")
    events = [0, 1, 2, 20, 22, 30, 57, 58, 59, 99]
    got = reseed.reseed_rows(motion, tracks, spark.createDataFrame([(1, e, k) for k, e in enumerate(events)], "record_id long, i long, reseed_id long")).orderBy("frame_id").collect()
    assert [r["frame_id"] for r in got] == [2, 20, 22, 30, 57, 58]
    for r in got:
        want = one_reseed(t, xy, common, turn, acc, quality, r["frame_id"])
        assert [r["timestamp"], *list(r)[4:11]] == pytest.approx(want[:8]) and [r["quality_before"], r["quality_after"]] == want[8:]


def test_group_report_is_metrics_of_each_value(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"algorithm": np.where(rng.random(120) < 0.5, "a", "b"), "site": rng.integers(0, 3, 120), "bin": rng.choice(["low", "high"], 120), "target": rng.uniform(1, 9, 120), "predicted": rng.uniform(0, 9, 120)})
    got = {(r["algorithm"], r["column"], r["value"]): r for r in models.group_report(spark.createDataFrame(pdf), ["bin", "missing", "site"], ["algorithm"]).collect()}
    assert len(got) == 2 * (3 + 2)
    for (a, c, v), r in got.items():
        part = pdf[(pdf.algorithm == a) & (pdf[c].astype(str) == v)]
        assert r["n"] == len(part) and r["mae"] == pytest.approx((part.target - part.predicted).abs().mean()) and r["spearman"] == pytest.approx(part.target.rank().corr(part.predicted.rank()))
    with pytest.raises(ValueError):
        models.group_report(spark.createDataFrame(pdf), ["missing"])


def greedy(rows, least, cell=None, quota=None, target=None):
    kept, counts = [], {}
    for p, x, y, s in sorted(rows, key=lambda r: (-r[3], r[0])):
        c = (np.floor(x / cell), np.floor(y / cell)) if cell else 0
        if quota and counts.get(c, 0) >= quota:
            continue
        if all(np.hypot(x - a, y - b) >= least for _, a, b in kept):
            kept.append((p, x, y))
            counts[c] = counts.get(c, 0) + 1
    return [p for p, _, _ in kept][:target]


@pytest.mark.parametrize("options", [{}, {"cell": 20.0, "quota": 2}, {"cell": 15.0, "quota": 1, "target": 6}])
def test_chosen_points_are_those_of_the_greedy_loop(spark, options):
    rng = np.random.default_rng(5)
    rows = [(g, i, *map(float, np.round(rng.uniform(0, 60, 2) if i % 3 else rng.normal(20, 2, 2), 2)), float(rng.integers(0, 12))) for g in range(3) for i in range(70)]
    df = spark.createDataFrame(rows, "frame long, point_id long, x double, y double, response double")
    got = geometry.selected_points(df, 6.0, "frame", **options).orderBy("frame", "order").collect()
    for g in range(3):
        want = greedy([r[1:] for r in rows if r[0] == g], 6.0, **options)
        mine = [r for r in got if r["frame"] == g]
        assert [r["point_id"] for r in mine] == want
        assert all(r["complete"] == (len(want) == options.get("target", len(want))) for r in mine)


@pytest.mark.parametrize("options", [{}, {"cell": 20.0, "quota": 2}, {"cell": 15.0, "quota": 1, "target": 6}])
def test_small_groups_are_chosen_in_one_pass_and_large_ones_by_rounds(spark, options, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(g, i, *map(float, np.round(rng.uniform(0, 60, 2) if i % 3 else rng.normal(20, 2, 2), 2)), float(rng.integers(0, 12))) for g in range(3) for i in range((20, 40, 90)[g])]
    df = spark.createDataFrame(rows, "frame long, point_id long, x double, y double, response double")
    made, real = [], geometry.staged
    monkeypatch.setattr(geometry, "staged", lambda d, name: made.append(name) or real(d, name))
    once = sorted(map(tuple, geometry.selected_points(df, 6.0, "frame", **options).collect()))
    assert made == ["large-groups"]  # no rounds: their plans fill the driver
    for whole in (0, 40):
        assert sorted(map(tuple, geometry.selected_points(df, 6.0, "frame", whole=whole, **options).collect())) == once
    for g in range(3):
        assert [p for f, p, *_ in sorted(once, key=lambda r: (r[0], r[2])) if f == g] == greedy([r[1:] for r in rows if r[0] == g], 6.0, **options)


def test_configurations_tell_all_faults_and_may_be_yaml(spark, tmp_path):
    good = {"video": {}, "motion": {}, "scale": {}, "pga": {}, "tracker": {"window_len": 16, "step": 8, "num_points": 5}, "signal": {"bandpass_hz": [0.3, 8]}, "runtime": {"target_fps": 30, "max_queue_blocks": 4}}
    assert records.config_faults(good) == [] and records.config_faults([]) != []
    bad = json.loads(json.dumps(good))
    bad["tracker"] |= {"step": 17, "num_points": "many", "source_timestamp_future_context_frames": [8, 15]}
    bad["signal"] = {"bandpass_hz": [8]}
    del bad["pga"]
    with pytest.raises(records.ConfigError) as caught:
        records.checked_config(bad)
    assert len(caught.value.faults) == 5 and all(any(x in f for f in caught.value.faults) for x in ("pga", "tracker.step", "num_points", "future_context", "bandpass_hz"))
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(good))
    assert records.read_config(spark, str(tmp_path / "c.yaml")) == good


def test_many_scenes_are_each_alone(spark):
    both = generators.many_scene_tracks(spark, ["rotation_local", "occlusion"], seconds=0.3, columns=4, rows=3)
    for name in ("rotation_local", "occlusion"):
        one = generators.scene_tracks(spark, name, seconds=0.3, columns=4, rows=3)
        columns = ["frame", "point_id", *[F.round(c, 9).alias(c) for c in ("x", "y", "lx", "tx", "rotation")], "visible"]
        assert sorted(map(tuple, both.where(F.col("scene") == name).select(*columns).collect())) == sorted(map(tuple, one.select(*columns).collect()))
    assert both.where("scene = 'occlusion' AND (rotation <> 0 OR lx <> 0)").count() == 0 and both.where("scene = 'rotation_local' AND tx <> 0").count() == 0
