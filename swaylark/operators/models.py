"""Regressions of a positive target on record features, their cross-validation and metrics.

Folds are dealt by group; a fold's parameters come from sums over the other folds, which are the sums over
all less the fold's own: one aggregate gives the parameters of every fold.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ratio
from ..sources.staging import staged
from . import ranges

TINY = 1e-12


def group_folds(df: DataFrame, folds: int, group: str = "grp", seed: int = 7) -> DataFrame:
    """Adds fold: groups in order of a hash of seed and name, dealt into near equal runs; a group is never split.

    One task numbers the groups, a row each: going by ranges would read the rows of ``df`` three times.
    """
    groups = df.select(group).distinct()
    order = W.partitionBy(F.lit(0)).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"))))
    dealt = groups.withColumn("fold", F.ntile(folds).over(order) - 1)
    return df.join(dealt, group)


def train_rows(df: DataFrame, folds: int) -> DataFrame:
    """Every row once for each fold that it trains: all but its own. Adds test_fold."""
    return df.withColumn("test_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("test_fold <> fold")


def _others(df: DataFrame, sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Per fold (of a group): sums over all other folds."""
    by = by or []
    own = df.groupBy(*by, "fold").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    whole = own.groupBy(*by).agg(*[F.sum(k).alias(f"_{k}") for k in sums])
    joined = own.join(F.broadcast(whole), by) if by else own.crossJoin(F.broadcast(whole))  # whole is a row per group
    return joined.select(*by, "fold", *[(F.col(f"_{k}") - F.col(k)).alias(k) for k in sums])


def fold_medians(df: DataFrame, folds: int, target: str = "target", by: list[str] | None = None) -> DataFrame:
    """Per fold (of a group): the median target of the other folds."""
    by = by or []
    rows = train_rows(df.select(*by, "fold", target).withColumn("_id", F.monotonically_increasing_id()), folds)
    rows = staged(rows.select(*by, F.col("test_fold").alias("fold"), target, "_id"), "fold-targets")
    return ranges.quantiles(rows, target, {"middle": 0.5}, [*by, "fold"], "_id")


def median_baseline(df: DataFrame, folds: int, target: str = "target", by: list[str] | None = None) -> DataFrame:
    """Adds predicted: the median target of the other folds."""
    by = by or []
    return df.join(fold_medians(df, folds, target, by).withColumnRenamed("middle", "predicted"), [*by, "fold"])  # a row per fold


def single_coefficient(df: DataFrame, feature: str = "f1", target: str = "target", by: list[str] | None = None) -> DataFrame:
    """Adds predicted: a line through the origin fitted to the other folds."""
    by = by or []
    p = _others(df, {"xy": F.col(feature) * F.col(target), "xx": F.col(feature) * F.col(feature)}, by)
    p = p.select(*by, "fold", (F.col("xy") / F.greatest("xx", F.lit(TINY))).alias("coefficient"))
    return df.join(F.broadcast(p), [*by, "fold"]).withColumn("predicted", F.greatest(F.col("coefficient") * F.col(feature), F.lit(0.0)))


def whole_coefficient(df: DataFrame, feature: str = "f1", target: str = "target") -> DataFrame:
    """The line through the origin of all rows: n, coefficient. One row, the model that is kept."""
    x, y = F.col(feature), F.col(target)
    return df.agg(F.count(F.lit(1)).cast("double").alias("n"), (F.sum(x * y) / F.greatest(F.sum(x * x), F.lit(TINY))).alias("coefficient"))


def ridge_1d(df: DataFrame, feature: str = "f1", target: str = "target", alpha: float = 1.0) -> DataFrame:
    """Adds predicted: exp of a ridge line of ln target on the feature, standardized on the other folds."""
    x, y = F.col(feature), F.ln(target)
    p = _others(df, {"n": F.lit(1.0), "x": x, "xx": x * x, "y": y, "xy": x * y})
    c = F.col
    mean, var = c("x") / c("n"), F.greatest(c("xx") / c("n") - (c("x") / c("n")) * (c("x") / c("n")), F.lit(0.0))
    p = p.select("fold", "n", "x", "y", "xy", mean.alias("mean"), F.when(F.sqrt(var) < TINY, F.lit(1.0)).otherwise(F.sqrt(var)).alias("sd"), (var * c("n")).alias("sxx"))
    slope = ((c("xy") - c("mean") * c("y")) / c("sd")) / (c("sxx") / (c("sd") * c("sd")) + alpha)
    p = p.select("fold", "mean", "sd", slope.alias("slope"), (c("y") / c("n")).alias("level"))
    return df.join(F.broadcast(p), "fold").withColumn("predicted", F.exp(c("level") + c("slope") * (x - c("mean")) / c("sd")))


def gram(df: DataFrame, features: list[str], target: str, by: list[str], weight: str | None = None) -> dict[tuple, tuple[np.ndarray, np.ndarray, float]]:
    """By group: X'WX and X'Wy with an intercept column first, and the number of rows. One aggregate; a row per group comes to the driver."""
    cols = [F.lit(1.0)] + [F.col(f) for f in features]
    w = F.col(weight) if weight else F.lit(1.0)
    k = len(cols)
    sums = {f"g{i}_{j}": w * cols[i] * cols[j] for i in range(k) for j in range(i, k)} | {f"y{i}": w * cols[i] * F.col(target) for i in range(k)}
    out = {}
    for row in df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(name) for name, v in sums.items()]).collect():
        g, y = np.zeros((k, k)), np.array([row[f"y{i}"] or 0.0 for i in range(k)])
        for i in range(k):
            g[i, i:] = g[i:, i] = [row[f"g{i}_{j}"] or 0.0 for j in range(i, k)]
        out[tuple(row[x] for x in by)] = (g, y, row["n"])
    return out


def standardized(g: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of raw sums: mean and population deviation of the features (nearly 0 counts as 1), and the sums over standardized ones."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    sd = np.sqrt(np.maximum(np.diag(g)[1:] / n - mean * mean, 0.0))
    sd = np.where(sd < TINY, 1.0, sd)
    move = np.eye(len(g))
    move[1:, 0] = -mean
    move[1:] /= sd[:, None]
    return mean, sd, move @ g @ move.T, move @ y


def solved(g: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Least squares from sums; the intercept is not penalized."""
    return np.linalg.lstsq(g + np.diag([0.0] + [penalty] * (len(g) - 1)), y, rcond=None)[0]


LINEAR = ("log_linear", "ridge", "huber")
ALGORITHMS = ("median", "single_coefficient", *LINEAR)


def _line(beta: list[str], mean: list[str], sd: list[str], features: list[str]) -> Column:
    out = F.col(beta[0])
    for b, m, s, f in zip(beta[1:], mean, sd, features, strict=True):
        out = out + F.col(b) * (F.col(f) - F.col(m)) / F.col(s)
    return out


#: Bins of a pass that looks for medians, and values of a group that may come to the driver.
BINS, FEW = 512, 1 << 15


def _huber(rows: DataFrame, features: list[str], by: list[str], sums: dict, scale: dict, betas: dict, alpha: float, rounds: int, k: float, apart: bool) -> dict[tuple, np.ndarray]:
    """By group: the coefficients of ``group_models``, from those that ``betas`` begins with. ``rows``: by, features, _y.

    A row is there once and each pass takes its residuals under all models that it trains. Medians are exact: a pass counts by bins between
    guesses, and again within a bin that has many values, until the few around the middle can come to the driver; from the second round on the
    last medians and how far they moved tell where to look. Sums are one more pass.
    Rows with a feature that is null or not finite are left out.
    """
    names, size = list(betas), len(features) + 1
    trains = [[j for j, other in enumerate(names) if (other[:-1] == name[:-1] and other != name if apart else other == name)] for name in names]
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    if by:
        table = spark.createDataFrame([(*name, i) for i, name in enumerate(names)], ", ".join([f"_k{i} {kinds[c]}" for i, c in enumerate(by)] + ["_g int"]))
        same = F.lit(True)
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        rows = rows.join(F.broadcast(table), same)  # a row per group
    else:
        rows = rows.withColumn("_g", F.lit(0))
    rows = rows.select("_g", *[F.col(f).cast("double").alias(f) for f in features], "_y").persist()  # every pass reads them
    middle, unit = (np.mean([scale[n][i] for n in names], axis=0) for i in (0, 1))
    moves = []  # from columns that all models share to a model's own
    for name in names:
        mean, sd = scale[name]
        move = np.diag([1.0, *(unit / sd)])
        move[1:, 0] = (middle - mean) / sd
        moves.append(move)

    def passed(lines: np.ndarray, found) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each model: numbers, and the sums of their values, in what ``found`` makes of a group's columns, targets, residuals and models."""

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                group, y = np.asarray(batch.column(0)), batch.column(size).to_numpy(zero_copy_only=False)
                x = np.stack([np.ones(len(y)), *[(batch.column(1 + i).to_numpy(zero_copy_only=False) - middle[i]) / unit[i] for i in range(size - 1)]], 1)
                good = np.isfinite(x).all(1) & np.isfinite(y)
                for g in np.unique(group).tolist():
                    if not trains[g]:
                        continue
                    at = np.flatnonzero(good & (group == g))
                    for j, numbers, values in found(x[at], y[at], y[at][:, None] - x[at] @ lines[trains[g]].T, trains[g]):
                        held = sums.setdefault(j, [])
                        held.append((numbers, values))
                        if sum(len(n) for n, _ in held) > 1 << 16:
                            sums[j] = [_summed(held)]
            for j, held in sums.items():
                numbers, values = _summed(held)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), j), pa.int32()), pa.array(numbers, pa.int64()), pa.array(values, pa.float64())], names=["m", "j", "v"])

        got = rows.mapInArrow(kernel, "m int, j long, v double").groupBy("m", "j").agg(F.sum("v").alias("v")).toArrow()
        model, numbers, values = (got.column(c).to_numpy() for c in ("m", "j", "v"))
        return [(numbers[at], values[at]) for at in (np.flatnonzero(model == j) for j in range(len(names)))]

    def medians(lines: np.ndarray, centre: np.ndarray | None, low: np.ndarray, high: np.ndarray, crowd: float) -> np.ndarray:
        """Of each model's residuals, or their distances from ``centre``; ``low`` and ``high`` are guesses of where these lie, between which there may be ``crowd`` values."""
        low, high, crowd, out = low.astype(float).copy(), high.astype(float).copy(), np.full(len(names), float(crowd)), np.zeros(len(names))
        turn = lambda r, models: r if centre is None else np.abs(r - centre[models])
        middles = lambda upto, total: [np.searchsorted(upto, p, "right") for p in ((total - 1) // 2, total // 2)]

        def inside(x, y, r, models):
            v = turn(r, models)
            for c, j in enumerate(models):
                some, n = np.unique(v[(v[:, c] >= low[j]) & (v[:, c] <= high[j]), c], return_counts=True)
                below = np.count_nonzero(v[:, c] < low[j])
                yield j, np.concatenate([[-np.inf], some, [np.inf]]).view(np.int64), np.array([below, *n, len(v) - below - n.sum()], float)

        def counted(x, y, r, models):
            spots = np.clip(np.floor((turn(r, models) - low[models]) / width[models]), -1, BINS).astype(np.int64) + 1  # 0 is below, BINS + 1 above
            for c, j in enumerate(models):
                n = np.bincount(spots[:, c], minlength=BINS + 2)
                at = np.flatnonzero(n)
                yield j, at, n[at].astype(float)

        while True:
            width = np.maximum((high - low) / BINS, np.maximum(np.maximum(np.abs(low), np.abs(high)) * 1e-15, 1e-300))
            close, missed = (crowd <= FEW).all(), np.zeros(len(names), int)
            for j, (numbers, values) in enumerate(passed(lines, inside if close else counted)):
                if not len(numbers):
                    crowd[j] = 0
                    continue
                numbers = numbers.view(float) if close else numbers
                order = np.argsort(numbers)
                numbers, upto = numbers[order], np.cumsum(values[order])
                first, last = (numbers[i] for i in middles(upto, upto[-1]))
                under, over = (first == -np.inf, last == np.inf) if close else (first == 0, last > BINS)
                if under or over:
                    span = max(high[j] - low[j], width[j])
                    low[j], high[j], missed[j], crowd[j] = low[j] - 16 * span * under, high[j] + 16 * span * over, 1, np.inf
                elif close:
                    out[j] = (first + last) / 2
                else:
                    crowd[j] = values[order][(numbers >= first) & (numbers <= last)].sum() if width[j] > 2e-15 * max(abs(low[j]), abs(high[j]), 1e-285) else 0
                    low[j], high[j] = low[j] + (first - 1.001) * width[j], low[j] + (last + 0.001) * width[j]
            if close and not missed.any():
                return out

    cells = [(a, b) for a in range(size) for b in range(a, size)]
    most, last, half = max(sums[n][2] for n in names), None, None
    for _ in range(rounds):
        lines = np.stack([m.T @ betas[n] for m, n in zip(moves, names, strict=True)])
        if last is None:  # any guess will do: one that misses is widened, a crowded bin is cut again
            centre = medians(lines, None, np.full(len(names), -1.0), np.full(len(names), 1.0), most)
            middling = medians(lines, centre, np.zeros(len(names)), np.full(len(names), 1.0), most)
            half = np.maximum(middling / 8, 1e-9)
        else:
            crowd = most * (half / np.maximum(last[1], TINY)).max()  # about as many as a normal distribution has there, or fewer
            centre = medians(lines, None, last[0] - half, last[0] + half, crowd)
            middling = medians(lines, centre, np.maximum(last[1] - half, 0), last[1] + half, crowd)
            half = np.maximum(4 * np.maximum(np.abs(centre - last[0]), np.abs(middling - last[1])), middling * 1e-6 + 1e-12)
        last = centre, middling
        spread = np.maximum(1.4826 * middling, TINY)

        def weighted(x, y, r, models, spread=spread):
            w = np.minimum(1.0, k * spread[models] / np.maximum(np.abs(r), TINY))
            for c, j in enumerate(models):
                own = x * w[:, c : c + 1]
                g = own.T @ x
                yield j, np.arange(len(cells) + size), np.array([*[g[a, b] for a, b in cells], *(own.T @ y)])

        new = {}
        for j, (numbers, values) in enumerate(passed(lines, weighted)):
            found, g = np.zeros(len(cells) + size), np.zeros((size, size))
            found[numbers] = values
            for (a, b), v in zip(cells, found[: len(cells)], strict=True):
                g[a, b] = g[b, a] = v
            y = found[len(cells) :]
            new[names[j]] = solved(moves[j] @ g @ moves[j].T, moves[j] @ y, alpha)
        done = max(np.abs(new[name] - betas[name]).max() for name in betas) < 1e-8
        betas = new
        if done:
            break
    rows.unpersist()
    return betas


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that occur, once each, with the sums of their values."""
    numbers, values = (np.concatenate([x[i] for x in held]) for i in (0, 1))
    some, at = np.unique(numbers, return_inverse=True)
    return some.astype(np.int64), np.bincount(at, values, len(some))


def group_models(train: DataFrame, algorithm: str, features: list[str], by: list[str], target: str = "target", alpha: float = 1.0, rounds: int = 30, k: float = 1.345, sums: dict | None = None, apart: bool = False) -> dict[tuple, dict]:
    """By group of ``train``: the parameters of log_linear, ridge or huber on ln target, as a small dict that to_json keeps.

    Huber reweights by residuals over 1.4826 times their median distance from their median. All groups take a
    round together. ``sums``: those of ``gram`` where they are known. ``apart`` (huber): a group's model is that of all other
    rows that share all of ``by`` but the last, as folds have it; ``sums`` are needed then.
    """
    if algorithm not in LINEAR:
        raise ValueError(f"unknown algorithm {algorithm}")
    rows = train.where(F.col(target) > 0).select(*by, *features, F.ln(target).alias("_y"))
    sums = sums if sums is not None else gram(rows, features, "_y", by)
    scale, betas = {}, {}
    for name, (g, y, _) in sums.items():
        mean, sd, zg, zy = standardized(g, y)
        scale[name], betas[name] = (mean, sd), solved(zg, zy, 0.0 if algorithm == "log_linear" else alpha)
    if algorithm == "huber" and sums:
        betas = _huber(rows, features, by, sums, scale, betas, alpha, rounds, k, apart)
    return {name: {"algorithm": algorithm, "features": features, "scale": {f: [float(m), float(d)] for f, m, d in zip(features, *scale[name], strict=True)}, "beta": betas[name].tolist()} for name in betas}


def fit(df: DataFrame, algorithm: str, features: list[str], target: str = "target", **options) -> dict:
    """The model of all rows of ``df``."""
    return group_models(df, algorithm, features, [], target, **options)[()]


def predict(df: DataFrame, model: dict, scale_valid: bool = True) -> DataFrame:
    """Adds predicted, never negative. Refused without a geometric scale."""
    if not scale_valid:
        raise ValueError("predictions need a valid geometric scale")
    line = F.lit(float(model["beta"][0]))
    for b, f in zip(model["beta"][1:], model["features"], strict=True):
        mean, sd = model["scale"][f]
        line = line + float(b) * (F.col(f) - mean) / sd
    return df.withColumn("predicted", F.greatest(F.exp(line), F.lit(0.0)))


def to_json(model: dict) -> str:
    return json.dumps(model, sort_keys=True)


def from_json(text: str) -> dict:
    return json.loads(text)


def fold_models(df: DataFrame, algorithms: list[str], features: list[str], folds: int, target: str = "target", by: list[str] | None = None) -> dict[str, dict[tuple, dict]]:
    """By algorithm and fold (of a group): a model of the other folds. Closed forms of all algorithms come from one aggregate: sums by fold, those of the others being the whole's less the fold's own."""
    by = by or []
    sums = gram(df.where(F.col(target) > 0).withColumn("_y", F.ln(target)), features, "_y", [*by, "fold"])
    others = {}
    for name in sums:
        rest = [v for other, v in sums.items() if other[:-1] == name[:-1] and other[-1] != name[-1]]
        if rest:
            others[name] = tuple(sum(x[i] for x in rest) for i in range(3))
    out = {}
    for algorithm in algorithms:
        if algorithm == "huber":
            out[algorithm] = group_models(df, algorithm, features, [*by, "fold"], target, sums=others, apart=True)
        else:
            out[algorithm] = group_models(df, algorithm, features, [*by, "fold"], target, sums=others)
    return out


def cross_validated(df: DataFrame, algorithm: str, features: list[str], folds: int, target: str = "target", by: list[str] | None = None) -> DataFrame:
    """Adds predicted by a model of the other folds, within each group of ``by``."""
    by = by or []
    if algorithm == "huber":
        df = staged(df, "fold-rows")  # read for the sums, the rounds and the predictions
    found = fold_models(df, [algorithm], features, folds, target, by)[algorithm]
    kinds = dict(df.dtypes)
    names = [[f"_{x}{i}" for i in range(len(features) + (x == "b"))] for x in "bms"]
    table = [(*name, *m["beta"], *[m["scale"][f][0] for f in features], *[m["scale"][f][1] for f in features]) for name, m in found.items()]
    kept = df.sparkSession.createDataFrame(table, ", ".join([f"{x} {kinds[x]}" for x in [*by, "fold"]] + [f"{x} double" for x in sum(names, [])]))
    line = _line(*names, features)
    return df.join(kept, [*by, "fold"], "left").withColumn("predicted", F.greatest(F.exp(line), F.lit(0.0))).drop(*sum(names, []))  # a row per fold


def _single_coefficients(rows: DataFrame, feature: str, target: str, by: list[str]) -> dict[tuple, float]:
    """Per group and fold: the line through the origin of the other folds. A row a fold comes to the driver."""
    x, y = F.col(feature), F.col(target)
    own = {tuple(r[c] for c in [*by, "fold"]): (r["xy"] or 0.0, r["xx"] or 0.0) for r in rows.groupBy(*by, "fold").agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx")).collect()}
    out = {}
    for name in own:
        rest = [v for other, v in own.items() if other[:-1] == name[:-1] and other != name]
        out[name] = sum(v[0] for v in rest) / max(sum(v[1] for v in rest), TINY)
    return out


def subset_predictions(df: DataFrame, subsets: dict[str, str], features: list[str], folds: int, single: str, target: str = "target", algorithms: tuple[str, ...] = ALGORITHMS) -> DataFrame:
    """Long: subset, algorithm, and the row with predicted, for rows whose flag of the subset is true. ``subsets``: flag column by name.

    A row is exploded by its subsets once, and these rows are staged, as every algorithm reads them. The parameters of all
    algorithms are one wide row per subset and fold, so that predictions are one projection of the rows.
    """
    labels = F.filter(F.array(*[F.when(F.col(flag), F.lit(name)) for name, flag in subsets.items()]), lambda x: x.isNotNull())
    rows = staged(df.withColumn("subset", F.explode(labels)).withColumn("fold", F.col("fold").cast("int")), "subset-rows")
    wide: dict[tuple, dict[str, float]] = {}
    lines = {}
    linear = [a for a in algorithms if a not in ("median", "single_coefficient")]
    if linear:
        found = fold_models(rows, linear, features, folds, target, ["subset"])
        names = {a: [[f"_{a}_{x}{i}" for i in range(len(features) + (x == "b"))] for x in "bms"] for a in linear}
        for a in linear:
            lines[a] = F.greatest(F.exp(_line(*names[a], features)), F.lit(0.0))
            for at, m in found[a].items():
                values = [*m["beta"], *[m["scale"][f][0] for f in features], *[m["scale"][f][1] for f in features]]
                wide.setdefault(at, {}).update(zip(sum(names[a], []), map(float, values), strict=True))
    if "single_coefficient" in algorithms:
        for at, v in _single_coefficients(rows, single, target, ["subset"]).items():
            wide.setdefault(at, {})["_coefficient"] = float(v)
        lines["single_coefficient"] = F.greatest(F.col("_coefficient") * F.col(single), F.lit(0.0))
    if "median" in algorithms:
        for r in fold_medians(rows, folds, target, ["subset"]).collect():  # a row a fold
            wide.setdefault((r["subset"], r["fold"]), {})["_middle"] = float(r["middle"])
        lines["median"] = F.col("_middle")
    columns = sorted({c for x in wide.values() for c in x} | ({"_coefficient"} if "single_coefficient" in algorithms else set()) | ({"_middle"} if "median" in algorithms else set()) | {c for a in linear for c in sum(names[a], [])})
    table = df.sparkSession.createDataFrame([(*at, *[x.get(c) for c in columns]) for at, x in wide.items()], ", ".join(["subset string", "fold int", *[f"{c} double" for c in columns]]))
    predicted = F.explode(F.array(*[F.struct(lines[a].alias("predicted"), F.lit(a).alias("algorithm")) for a in algorithms])).alias("_p")
    return rows.join(table, ["subset", "fold"], "left").select(*rows.columns, predicted).select(*rows.columns, "_p.*")


def checked_inputs(df: DataFrame, version: str, version_column: str = "feature_version", causal_column: str = "causal") -> str:
    """PASS if all rows are causal, else FAIL; rows of another feature version are an error. A row comes to the driver."""
    seen = df.agg(*[F.slice(F.array_sort(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit(missing)))), 1, 100).alias(c) for c, missing in ((version_column, "MISSING"), (causal_column, "UNKNOWN"))]).first()
    if seen[version_column] != [version]:
        raise ValueError(f"feature versions are {seen[version_column]}, not {version}")
    return "PASS" if seen[causal_column] in (["1"], ["true"]) else "FAIL"


def average_ranks(df: DataFrame, value: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """Adds the average rank of each value among ``keys``. The rows are staged with a number each, as ranges read them several times; that number tells ties apart."""
    rows = staged(df.withColumn("_tie", F.monotonically_increasing_id()), "ranked")
    return ranges.Order(rows, value, keys, "_tie").with_average_rank(rows, out).drop("_tie")


def metrics(df: DataFrame, keys: list[str] | None = None, truth: str = "target", estimate: str = "predicted") -> DataFrame:
    """MAE, RMSE, log MAE, median factor, shares within 1.5 and 2 times, Pearson and Spearman, over all rows or by ``keys``. Truth must be positive.

    The scored rows are staged once; ranks of truth and estimate and the places of factors are a shuffle by range each.
    """
    keys = keys or []
    t, e = F.col(truth), F.col(estimate)
    safe = F.greatest(e, F.lit(TINY))
    rows = df.select(*keys, truth, estimate, F.greatest(safe / t, t / safe).alias("_factor"))
    rows = staged(rows.withColumn("_tie", F.monotonically_increasing_id()), "scored")
    pearson = lambda a, b: ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    truths, estimates = (ranges.Order(rows, c, keys, "_tie") for c in (truth, estimate))
    ranked = estimates.with_average_rank(truths.with_average_rank(rows, "_rt"), "_re")
    aggs = [
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e - t)).alias("mae"), F.sqrt(F.avg((e - t) * (e - t))).alias("rmse"),
        F.avg(F.abs(F.ln(safe) - F.ln(t))).alias("log_mae"),
        F.avg((F.col("_factor") <= 1.5).cast("int")).alias("within_1p5"), F.avg((F.col("_factor") <= 2.0).cast("int")).alias("within_2"),
        pearson(t, e).alias("pearson"), pearson(F.col("_rt"), F.col("_re")).alias("spearman"),
    ]
    middle = ranges.quantiles(rows, "_factor", {"median_factor": 0.5}, keys, "_tie")
    names = [*keys, "n", "mae", "rmse", "log_mae", "median_factor", "within_1p5", "within_2", "pearson", "spearman"]
    if not keys:
        return ranked.agg(*aggs).crossJoin(F.broadcast(middle)).select(*names)  # one row
    other = middle.toDF(*[f"_{k}" for k in keys], "median_factor")
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = one if same is None else same & one
    return ranked.groupBy(*keys).agg(*aggs).join(other, same, "left").select(*names)


def group_report(df: DataFrame, columns: list[str], keys: list[str] | None = None, truth: str = "target", estimate: str = "predicted") -> DataFrame:
    """``metrics`` for every value of each of ``columns`` that ``df`` has: keys, column, value (as text), and the metrics.

    A row is laid out once for each column, so that all groupings are one set of groups and share every pass; ranks are
    those within a group.
    """
    present, keys = [c for c in columns if c in df.columns], keys or []
    if not present:
        raise ValueError(f"none of the columns {columns} is there")
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in present])).alias("_g")
    return metrics(df.select(*keys, truth, estimate, both).select(*keys, "_g.*", truth, estimate), [*keys, "column", "value"], truth, estimate)


def binned(value: Column, edges: list[float]) -> Column:
    """Place of the value among edges: how many of the inner edges it reaches."""
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in edges[1:-1]]), lambda x: x <= value))


def confusion(df: DataFrame, edges: list[float], truth: str = "target", estimate: str = "predicted") -> DataFrame:
    """Counts of every pair of true and estimated bin, zeros included: true_bin, estimated_bin, n."""
    spark, k = df.sparkSession, len(edges) - 1
    cells = spark.range(k * k).select(F.floor(F.col("id") / k).cast("int").alias("true_bin"), (F.col("id") % k).cast("int").alias("estimated_bin"))
    counts = df.groupBy(binned(F.col(truth), edges).alias("true_bin"), binned(F.col(estimate), edges).alias("estimated_bin")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(F.broadcast(counts), ["true_bin", "estimated_bin"], "left").select("true_bin", "estimated_bin", F.coalesce("n", F.lit(0)).alias("n"))  # k squared rows


#: Draws that one digest gives, of 16 bits each.
PER_DIGEST = 8
#: The cumulative Poisson distribution of mean 1.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020]
#: The same as far as numbers of 32 bits reach.
POISSON_32 = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892, 0.9999999999364022]
METRICS = ["n", "mae", "rmse", "log_mae", "median_factor", "within_1p5", "within_2", "pearson", "spearman"]


_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [np.uint32(int(abs(np.sin(i + 1.0)) * 2**32)) for i in range(64)]


def _digests(words: dict[int, np.ndarray]) -> np.ndarray:
    """MD5 of messages of one block, a row of 16 bytes each, from their words that are not zero."""
    n = len(words[0])
    start = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    a, b, c, d = (np.full(n, x, np.uint32) for x in start)
    t = np.empty(n, np.uint32)
    for i in range(64):
        turn, k = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if turn == 0:
            np.bitwise_xor(c, d, t), np.bitwise_and(t, b, t), np.bitwise_xor(t, d, t)
        elif turn == 1:
            np.bitwise_xor(b, c, t), np.bitwise_and(t, d, t), np.bitwise_xor(t, c, t)
        elif turn == 2:
            np.bitwise_xor(b, c, t), np.bitwise_xor(t, d, t)
        else:
            np.invert(d, t), np.bitwise_or(t, b, t), np.bitwise_xor(t, c, t)
        a += t
        a += _SINES[i]
        if k in words:
            a += words[k]
        s = np.uint32(_TURNS[turn][i % 4])
        np.left_shift(a, s, t)
        a >>= np.uint32(32) - s
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    return np.stack([x + np.uint32(y) for x, y in zip((a, b, c, d), start, strict=True)], 1).view(np.uint8)


def md5_pairs(heads: list[bytes], tails: list[bytes], block: int = 8192) -> np.ndarray:
    """MD5 of every head followed by every tail: heads x tails x 16 bytes. Those of a length go side by side; messages over 55 bytes one by one."""
    out = np.empty((len(heads), len(tails), 16), np.uint8)
    sizes, ends = np.array([len(x) for x in heads], np.int64), np.array([len(x) for x in tails], np.int64)
    for p in np.unique(sizes).tolist():
        for q in np.unique(ends).tolist():
            i, j = np.flatnonzero(sizes == p), np.flatnonzero(ends == q)
            if p + q > 55:
                for y in i.tolist():
                    out[y, j] = np.frombuffer(b"".join([md5(heads[y] + tails[x]).digest() for x in j.tolist()]), np.uint8).reshape(-1, 16)
                continue
            front = np.frombuffer(b"".join([heads[y] for y in i.tolist()]), np.uint8).reshape(len(i), 1, p)
            back = np.frombuffer(b"".join([tails[x] for x in j.tolist()]), np.uint8).reshape(1, len(j), q)
            step, width = max(1, block // len(j)), (p + q) // 4 + 1
            for y in range(0, len(i), step):
                some = i[y : y + step]
                m = np.zeros((len(some), len(j), 4 * width), np.uint8)
                m[:, :, :p], m[:, :, p : p + q], m[:, :, p + q] = front[y : y + step], back, 0x80
                m = m.view("<u4").reshape(-1, width)
                words = {k: np.ascontiguousarray(m[:, k]) for k in range(width)}
                words[14] = words[14] + np.uint32(8 * (p + q)) if 14 in words else np.uint32(8 * (p + q))
                out[some[:, None], j] = _digests(words).reshape(len(some), len(j), 16)
    return out


def resampled_counts(keys: list, first: int, draws: int, seed: int, per_digest: int = PER_DIGEST) -> np.ndarray:
    """How often each row is in each of the draws from ``first`` on (a multiple of ``per_digest``): a Poisson number of mean 1 from an MD5 of seed, row and
    draw // per_digest, of which a draw has its share, up to 32 bits."""
    size = min(4, 16 // per_digest)
    digests = md5_pairs([f"{seed}|{k}|".encode() for k in keys], [str(b).encode() for b in range(first // per_digest, -(-(first + draws) // per_digest))])
    u = np.ascontiguousarray(digests[:, :, : per_digest * size]).view(f">u{size}").reshape(len(keys), -1)[:, :draws] / 256.0**size
    return np.searchsorted(POISSON_32 if size == 4 else POISSON, u, "right").astype(np.uint8)


def _weighted_correlation(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each column of ``w``; x and y are columns or matrices like w. NaN where one does not vary."""
    total = w.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        x, y = x - (w * x).sum(0) / total, y - (w * y).sum(0) / total
        spread = np.sqrt((w * x * x).sum(0)) * np.sqrt((w * y * y).sum(0))
        return np.where(spread > 1e-9, (w * x * y).sum(0) / spread, np.nan)


def _weighted_ranks(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Average rank of each row's value in each column's resample."""
    values, place = np.unique(x, return_inverse=True)
    order = np.argsort(place, kind="stable")
    sums = np.add.reduceat(w[order].astype(np.int64), np.searchsorted(place[order], np.arange(len(values))), axis=0)
    return (np.cumsum(sums, 0) - (sums - 1) / 2)[place]


def resampled_metrics(target: np.ndarray, predicted: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
    """All metrics of each column's resample, as ``metrics`` has them of the rows."""
    total = w.sum(0, dtype=np.int64)
    safe = np.maximum(predicted, TINY)
    factor = np.maximum(safe / target, target / safe)
    order = np.argsort(factor, kind="stable")
    upto = np.cumsum(w[order], 0, dtype=np.int64)
    sides = [factor[order][np.minimum((upto <= k).sum(0), len(factor) - 1)] for k in ((total - 1) // 2, total // 2)]
    t, e, w = target[:, None], predicted[:, None], w.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = lambda x: x @ w / total
        out = {
            "n": total.astype(float), "mae": mean(np.abs(predicted - target)), "rmse": np.sqrt(mean((predicted - target) ** 2)), "log_mae": mean(np.abs(np.log(safe) - np.log(target))),
            "median_factor": (sides[0] + sides[1]) / 2, "within_1p5": mean(factor <= 1.5), "within_2": mean(factor <= 2.0),
            "pearson": _weighted_correlation(w, t, e), "spearman": _weighted_correlation(w, _weighted_ranks(w, target), _weighted_ranks(w, predicted)),
        }
    return {k: np.where(total > 0, v, np.nan) for k, v in out.items()}


def bootstrap(df: DataFrame, draws: int, seed: int = 0, truth: str = "target", estimate: str = "predicted", key: str = "record_id", by: list[str] | None = None, block: int = 80) -> DataFrame:
    """2.5th, 50th and 97.5th percentile of every metric over resamples of the rows, of each group of ``by``: metric, lower_95, median, upper_95.

    A resample repeats each row by a Poisson number of mean 1 drawn from a hash of seed, row and draw. ``block`` draws (a multiple of PER_DIGEST) are
    a task's, side by side as columns of weights, which ranks and medians take as they are: no row is repeated. Draws in which a metric is undefined are
    left out of its percentiles. A task holds three values of each of a group's rows (records, not samples), and
    as few draws at once as keep its matrices small. Rows whose truth is not positive or whose estimate is null or not finite are left out.
    """
    by, most = by or [], 1 << 21
    if block % PER_DIGEST:
        raise ValueError("a block of draws is whole digests")

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        first, n = int(rows["_first"].iloc[0]), int(rows["_n"].iloc[0])
        keys, target, predicted = rows["_key"].tolist(), rows["_t"].to_numpy(float), rows["_e"].to_numpy(float)
        many, parts = max(PER_DIGEST, most // len(rows) // PER_DIGEST * PER_DIGEST), []
        for a in range(first, first + n, many):
            size = min(many, first + n - a)
            found = resampled_metrics(target, predicted, resampled_counts(keys, a, size, seed))
            parts += [pd.DataFrame({"draw": np.arange(a, a + size), "metric": name, "value": v}) for name, v in found.items()]
        out = pd.concat(parts)
        return out.assign(**{c: rows[c].iloc[0] for c in by})[[*by, "draw", "metric", "value"]]

    good = df.where((F.col(truth) > 0) & F.col(estimate).isNotNull() & ~F.isnan(estimate) & (F.abs(F.col(estimate)) < float("inf")))
    starts = F.explode(F.array(*[F.struct(F.lit(a).alias("_first"), F.lit(min(block, draws - a)).alias("_n")) for a in range(0, draws, block)])).alias("p")
    work = good.select(*by, F.col(key).cast("string").alias("_key"), F.col(truth).cast("double").alias("_t"), F.col(estimate).cast("double").alias("_e"), starts).select(*by, "_key", "_t", "_e", "p.*")
    kinds = "".join(f"{c} {dict(df.dtypes)[c]}, " for c in by)
    values = work.groupBy(*by, "_first").applyInPandas(kernel, f"{kinds}draw long, metric string, value double").where(~F.isnan("value"))
    return values.groupBy(*by, "metric").agg(*[F.percentile("value", F.lit(p)).alias(n) for n, p in (("lower_95", 0.025), ("median", 0.5), ("upper_95", 0.975))])  # a value a draw


def bootstrap_mae(df: DataFrame, draws: int, seed: int = 0, truth: str = "target", estimate: str = "predicted", key: str = "record_id", by: list[str] | None = None, per_digest: int = PER_DIGEST) -> DataFrame:
    """The interval of the MAE alone, as ``bootstrap`` has it. One pass over the rows: each task sums its rows' weights and weighted errors for all draws, and only these sums are shuffled.

    ``per_digest`` draws (1, 4 or 8) share a digest; with 1 or 4 each has 32 bits, with 8 it has 16, as ``bootstrap`` takes them.
    """
    by = by or []
    if per_digest not in (1, 4, 8):
        raise ValueError("a digest gives 1, 4 or 8 draws")

    def kernel(batches):
        sums: dict[tuple, np.ndarray] = {}
        for rows in batches:
            for group, part in rows.groupby(by, dropna=False) if by else [((), rows)]:
                held = sums.setdefault(group if isinstance(group, tuple) else (group,), np.zeros((2, draws)))
                for a in range(0, len(part), 1024):
                    some = part.iloc[a : a + 1024]
                    w = resampled_counts(some["_key"].tolist(), 0, draws, seed, per_digest)
                    held += np.stack([w.sum(0), some["_e"].to_numpy(float) @ w])
        for group, held in sums.items():
            yield pd.DataFrame({**dict(zip(by, group, strict=True)), "draw": np.arange(draws), "w": held[0], "e": held[1]})

    kinds = "".join(f"{c} {dict(df.dtypes)[c]}, " for c in by)
    rows = df.select(*by, F.col(key).cast("string").alias("_key"), F.abs(F.col(estimate) - F.col(truth)).cast("double").alias("_e")).where("_e IS NOT NULL AND NOT isnan(_e)")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # of small rows and long work
    sums = rows.repartition(tasks, "_key").mapInPandas(kernel, f"{kinds}draw long, w double, e double").groupBy(*by, "draw").agg(F.try_divide(F.sum("e"), F.sum("w")).alias("mae"))
    return sums.groupBy(*by).agg(*[F.percentile("mae", F.lit(p)).alias(n) for n, p in (("lower_95", 0.025), ("median", 0.5), ("upper_95", 0.975))])  # a value a draw
