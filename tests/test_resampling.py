"""Searches and resamples done as matrices, against one at a time."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pytest

from swaylark.operators import alignment, models, spectral


def one_search(t, v, st, sv, offsets):
    best, where = 0.0, 0.0
    for o in offsets:
        inside = (t + o >= st[0]) & (t + o <= st[-1])
        if inside.sum() < max(alignment.LEAST_OVERLAP, int(alignment.LEAST_SHARE * len(t))):
            continue
        for s in sv.T:
            at = np.interp(t[inside] + o, st, s)
            for c in v[inside].T:
                fine = np.isfinite(c)
                if fine.sum() >= 10 and c[fine].std() > 0 and at[fine].std() > 0:
                    r = abs(np.corrcoef(c[fine], at[fine])[0, 1])
                    if r > best:
                        best, where = r, o
    return best, where


@pytest.mark.parametrize("seed", range(4))
def test_many_versions_are_searched_as_each_alone(seed):
    rng = np.random.default_rng(seed)
    st, t = np.cumsum(rng.uniform(0.5, 1.5, 80)), np.cumsum(rng.uniform(0.5, 1.5, 40)) + 10
    v, sv = rng.normal(size=(40, 2)), rng.normal(size=(80, 2))
    if seed == 2:
        v[5, 0], v[:, 1] = np.nan, 1.0  # a gap, and a channel that does not vary
    versions = [sv] + [np.roll(sv, k, axis=0) for k in (3, 11, 29)]
    series = [np.column_stack([x[:, c] for x in versions]) for c in range(2)]
    offsets = alignment.offset_grid((-12.0, 20.0), 0.7)
    found, where = alignment.searched(t, v, st, series, offsets)
    want = [one_search(t, v, st, x, offsets) for x in versions]
    assert found.tolist() == pytest.approx([w[0] for w in want]) and where == pytest.approx(want[0][1])
    apart, _ = alignment.searched(t, v, st, series, offsets, groups=[([0], [0]), ([1], [1])])
    assert apart[0] == pytest.approx(max(one_search(t, v[:, [c]], st, sv[:, [c]], offsets)[0] for c in range(2)))


def test_results_do_not_depend_on_blocks_and_own_grids_step_by_the_lesser_median(spark):
    rng = np.random.default_rng(5)
    st, t = np.arange(200) / 10, np.arange(30) / 5 + 6
    sensor = np.convolve(rng.normal(size=200), np.ones(5) / 5, "same")
    rows = [(1, t.tolist(), [np.interp(t + 2.3, st, sensor).tolist()], st.tolist(), [sensor.tolist()]), (2, st.tolist(), [sensor.tolist()], t.tolist(), [t.tolist()])]
    df = spark.createDataFrame(rows, "record_id long, t array<double>, v array<array<double>>, st array<double>, sv array<array<double>>")
    a, b = (sorted(map(tuple, alignment.null_test(df, 60, seed=3, block=k).collect())) for k in (7, 250))
    assert [x[:3] for x in a] == [x[:3] for x in b] and [x[3] for x in a] == pytest.approx([x[3] for x in b])
    assert len(a) == 1 and a[0][1] == pytest.approx(1.0) and a[0][2] == pytest.approx(2.3) and a[0][3] < 0.05  # the second's sensor is shorter than the record
    assert alignment.natural_step(t, st) == pytest.approx(0.1) and len(alignment.offset_grid(2.0, 0.5)) == 9
    search = alignment.null_test(df, 0, span=3.0).where("record_id = 1").first()
    assert search["observed"] == pytest.approx(1.0) and search["p_value"] == 1.0
    assert alignment.null_test(df.limit(0), 10).count() == 0


def test_circular_shifts_against_a_loop_and_without_a_row_for_each_sample_and_shift(spark):
    rng = np.random.default_rng(9)
    rows = [(g, i, *(None if g == 2 and rng.random() < 0.2 else float(v) for v in rng.normal(size=2))) for g, n in ((1, 33), (2, 40), (3, 9), (4, 12)) for i in range(n)]
    rows = [(g, i, 1.0, y) if g == 4 else (g, i, x, y) for g, i, x, y in rows]  # one that does not vary
    df = spark.createDataFrame(rows, "record_id long, i int, x double, y double")
    got = {r["record_id"]: r for r in alignment.null_p_values(df, 19).collect()}
    assert set(got) == {1, 2, 4} and got[4]["observed"] is None and got[4]["p_value"] == 1 / 20
    shifted = {(r["record_id"], r["b"]): r["null_corr"] for r in alignment.circular_shifts(df, 19).collect()}
    for g in (1, 2):
        x, y = (np.array([np.nan if r[c] is None else r[c] for r in rows if r[0] == g]) for c in (2, 3))
        n, least = len(x), max(1, np.ceil(0.05 * len(x)))
        def corr(ys):
            both = ~np.isnan(x * ys)  # noqa: B023
            return abs(np.cov(x[both], ys[both], bias=True)[0, 1]) / (np.nanstd(x) * np.nanstd(ys))  # noqa: B023
        null = [corr(np.roll(y, int(least + b * (n - 2 * least) // 19))) for b in range(19)]
        assert [shifted[g, b] for b in range(19)] == pytest.approx(null) and got[g]["observed"] == pytest.approx(corr(y))
        assert got[g]["p_value"] == (1 + sum(v >= corr(y) for v in null)) / 20
    plan = alignment.null_p_values(df, 19)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


@pytest.mark.parametrize("seed, salt", [(0, 0), (3, 1 << 30), ((1 << 32) - 1, 12345), (1 << 40, 7)])
def test_draws_side_by_side_are_those_of_numpys_generators(seed, salt):
    for first, n in ((0, 50), (999, 3), (5, 0)):
        want = [np.random.default_rng([seed, salt, it]).random(37).tolist() for it in range(first, first + n)]
        assert alignment.uniform_draws(seed, salt, first, n, 37).tolist() == want


def test_no_generator_is_made_for_each_iteration(monkeypatch):
    """Making 1000 of them takes longer than the search of a short record."""
    calls = []
    monkeypatch.setattr(np.random, "default_rng", lambda *a: calls.append(a))
    assert alignment.uniform_draws(0, 5, 0, 1000, 34).shape == (1000, 34) and not calls


@pytest.mark.parametrize("n", [30, 31])
def test_phase_surrogates_keep_the_power_spectrum(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    many = spectral.phase_surrogates(x, rng.random((20, n // 2 + 1)))
    assert np.allclose(np.abs(np.fft.rfft(many, axis=1)), np.abs(np.fft.rfft(x))) and not np.allclose(many[0], many[1])
    assert np.allclose(many.mean(1), x.mean())


def one_metrics(t, e):
    safe = np.maximum(e, models.TINY)
    factor = np.maximum(safe / t, t / safe)

    def ranks(x):
        return np.array([(x < y).sum() + ((x == y).sum() + 1) / 2 for y in x])

    corr = lambda a, b: np.corrcoef(a, b)[0, 1] if a.std() > 0 and b.std() > 0 else np.nan
    return {
        "n": len(t), "mae": np.abs(e - t).mean(), "rmse": np.sqrt(((e - t) ** 2).mean()), "log_mae": np.abs(np.log(safe) - np.log(t)).mean(), "median_factor": np.median(factor),
        "within_1p5": (factor <= 1.5).mean(), "within_2": (factor <= 2).mean(), "pearson": corr(t, e), "spearman": corr(ranks(t), ranks(e)),
    }


def test_resampled_metrics_are_those_of_repeated_rows():
    rng = np.random.default_rng(6)
    t, e = rng.integers(1, 9, 40) / 2.0, rng.integers(0, 9, 40) / 2.0
    w = models.resampled_counts(list(range(40)), 0, 24, 5)
    assert w.shape == (40, 24) and 0.8 < w.mean() < 1.2
    w[:, 3], w[:, 4] = 0, 0
    w[7, 4] = 3  # nothing, and copies of one row
    got = models.resampled_metrics(t, e, w)
    for k in range(24):
        if k == 3:
            assert all(np.isnan(v[k]) for v in got.values())
            continue
        want = one_metrics(np.repeat(t, w[:, k]), np.repeat(e, w[:, k]))
        for name, x in want.items():
            assert got[name][k] == pytest.approx(x, nan_ok=True), (name, k)
    assert (models.resampled_counts(list(range(40)), 8, 16, 5) == models.resampled_counts(list(range(40)), 0, 24, 5)[:, 8:]).all()


def test_bootstrap_intervals(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "ab"[i % 2], float(rng.uniform(1, 9)), float(rng.uniform(0, 9))) for i in range(60)] + [(99, "a", None, 1.0), (98, "b", 1.0, float("nan")), (97, "b", -1.0, 1.0)]
    df = spark.createDataFrame(rows, "record_id long, grp string, target double, predicted double")
    got = {(r["grp"], r["metric"]): r for r in models.bootstrap(df, 200, by=["grp"], block=40).collect()}
    assert {m for _, m in got} == set(models.METRICS)
    for g in "ab":
        part = [r for r in rows[:60] if r[1] == g]
        t, e = np.array([r[2] for r in part]), np.array([r[3] for r in part])
        w = models.resampled_counts([r[0] for r in part], 0, 200, 0)
        mae = (np.abs(e - t) @ w) / w.sum(0)
        r = got[g, "mae"]
        assert (r["lower_95"], r["median"], r["upper_95"]) == pytest.approx(tuple(np.percentile(mae, [2.5, 50, 97.5])))
    alone = models.bootstrap_mae(df.where("grp = 'a' AND target IS NOT NULL"), 200).first()
    assert (alone["lower_95"], alone["upper_95"]) == pytest.approx((got["a", "mae"]["lower_95"], got["a", "mae"]["upper_95"]))
    with pytest.raises(ValueError):
        models.bootstrap(df, 10, block=9)


def test_each_draw_of_the_mae_interval_has_a_digest_of_its_own(spark):
    """Draws that share a digest have 16 bits each, which no count over 7 comes from."""
    keys = list(range(300))
    w = models.resampled_counts(keys, 0, 2000, 0, per_digest=1)
    for k, b in ((0, 0), (7, 10), (299, 1999)):
        u = int(md5(f"0|{k}|{b}".encode()).hexdigest()[:8], 16) / 2**32
        assert w[k, b] == sum(u >= x for x in models.POISSON_32)
    assert w.max() > 7 >= models.resampled_counts(keys, 0, 2000, 0).max()
    rng = np.random.default_rng(3)
    t, e = rng.uniform(1, 9, 300), rng.uniform(0, 9, 300)
    df = spark.createDataFrame([(k, float(x), float(y)) for k, x, y in zip(keys, t, e, strict=True)], "record_id long, target double, predicted double")
    mae = (np.abs(e - t) @ w) / w.sum(0)
    assert tuple(models.bootstrap_mae(df, 2000, per_digest=1).first()) == pytest.approx(tuple(np.percentile(mae, [2.5, 50, 97.5])))


def test_digests_side_by_side_are_md5():
    heads, tails = [b"x" * n for n in (0, 1, 3, 49, 51, 52, 55, 60)], [b"", b"1", b"1999"]
    got = models.md5_pairs(heads, tails)
    assert all(got[i, j].tobytes() == md5(x + y).digest() for i, x in enumerate(heads) for j, y in enumerate(tails))
