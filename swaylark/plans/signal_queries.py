"""Queries over record signals (users' events)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tidy
from ..operators import alignment, audit, derivatives, features, filters, reseed, spectral, timebase
from ..sources import adapters as A
from ..sources import records
from ..streaming import online
from .registry import query

W = "OVER (PARTITION BY record_id ORDER BY t, seq)"
#: Rate at which the records' samples count as even, for filters and spectra.
RATE = 1.0


def rounded(df, columns, digits=6):
    return df.withColumns({c: tidy(F.col(c), digits) for c in columns})


@query(f"""
WITH {A.SIGNAL}, d AS (SELECT *, t - lag(t) {W} AS dt FROM signal), m AS (SELECT record_id, quantile_cont(dt, 0.5) AS md FROM d GROUP BY 1)
SELECT record_id, count(*) AS sample_count, round(md, 6) AS nominal_dt, round(1 / nullif(md, 0), 9) AS fps, round(max(abs(dt - md)), 6) AS max_jitter,
       round(sqrt(avg((dt - md) * (dt - md))), 4) AS rms_jitter, coalesce(sum(greatest(round_even(dt / nullif(md, 0), 0) - 1, 0)), 0)::BIGINT AS missing
FROM d JOIN m USING (record_id) GROUP BY record_id, md""")
def timebase_diagnostics(spark, sf_dir):
    d = timebase.diagnose(A.signal(spark, sf_dir))
    return d.select("record_id", "sample_count", tidy(F.col("nominal_dt")).alias("nominal_dt"), tidy(F.col("fps"), 9).alias("fps"), tidy(F.col("max_jitter")).alias("max_jitter"), tidy(F.col("rms_jitter"), 4).alias("rms_jitter"), "missing")


BACKWARD = f"""b1 AS (SELECT *, t - lag(t) {W} AS dt, (x - lag(x) {W}) / nullif(t - lag(t) {W}, 0) AS velocity FROM signal),
b2 AS (SELECT *, 2 * (velocity - lag(velocity) {W}) / nullif(dt + lag(dt) {W}, 0) AS acceleration FROM b1)"""


@query(f"WITH {A.SIGNAL}, {BACKWARD} SELECT record_id, seq, round(velocity, 9) + 0.0::DOUBLE AS velocity, round(acceleration, 12) + 0.0::DOUBLE AS acceleration FROM b2")
def backward_derivatives(spark, sf_dir):
    d = derivatives.backward(A.signal(spark, sf_dir))
    return d.select("record_id", "seq", tidy(F.col("velocity"), 9).alias("velocity"), tidy(F.col("acceleration"), 12).alias("acceleration"))


def _gradient_sql(v: str, out: str, source: str) -> str:
    def three(w: int) -> str:
        parts = []
        for j in range(3):
            a, b = [k for k in range(3) if k != j]
            parts.append(f"v{j} * (((t{w} - t{a}) + (t{w} - t{b})) / nullif((t{j} - t{a}) * (t{j} - t{b}), 0))")
        return " + ".join(parts)

    def placed(first: int, w: int) -> str:
        text = three(w)
        for j in range(3):
            k = first + j
            name = "c" if k == 0 else f"{'p' if k > 0 else 'm'}{abs(k)}"
            text = text.replace(f"v{j}", f"@x{name}").replace(f"t{j}", f"@t{name}")
        return text.replace("@", "")

    lags = ", ".join(f"{f}({c}, {k}) {W} AS {n}{s}{k}" for c, n in ((v, "x"), ("t", "t")) for f, s in (("lag", "m"), ("lead", "p")) for k in (1, 2))
    return f"{out}_w AS (SELECT *, {v} AS xc, t AS tc, {lags} FROM {source}), {out}_q AS (SELECT * EXCLUDE (xc, tc, xm1, xm2, xp1, xp2, tm1, tm2, tp1, tp2), CASE WHEN tm1 IS NULL THEN {placed(0, 0)} WHEN tp1 IS NULL THEN {placed(-2, 2)} ELSE {placed(-1, 1)} END AS {out} FROM {out}_w)"


@query(f"WITH {A.SIGNAL}, {_gradient_sql('x', 'velocity', 'signal')}, {_gradient_sql('velocity', 'acceleration', 'velocity_q')} SELECT record_id, seq, round(velocity, 8) + 0.0::DOUBLE AS velocity, round(acceleration, 10) + 0.0::DOUBLE AS acceleration FROM acceleration_q")
def central_gradient(spark, sf_dir):
    d = derivatives.gradient(A.signal(spark, sf_dir))
    return d.select("record_id", "seq", tidy(F.col("velocity"), 8).alias("velocity"), tidy(F.col("acceleration"), 10).alias("acceleration"))


@query(f"""
WITH {A.SIGNAL}, w AS (SELECT record_id, seq, t, list(struct_pack(t := t, v := x)) OVER (PARTITION BY record_id ORDER BY t, seq ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS h FROM signal),
f AS (SELECT record_id, seq, t, h, t - h[1].t AS s FROM w WHERE len(h) = 9),
u AS (SELECT record_id, seq, s, unnest(list_transform(h, lambda r: struct_pack(u := (r.t - t) / nullif(s, 0), v := r.v))) AS p FROM f),
m AS (SELECT record_id, seq, s, sum(1.0::DOUBLE) AS m0, sum(p.u) AS m1, sum(p.u ** 2) AS m2, sum(p.u ** 3) AS m3, sum(p.u ** 4) AS m4, sum(p.v) AS y0, sum(p.u * p.v) AS y1, sum(p.u ** 2 * p.v) AS y2 FROM u GROUP BY 1, 2, 3),
d AS (SELECT *, m0 * (m2 * m4 - m3 * m3) - m1 * (m1 * m4 - m3 * m2) + m2 * (m1 * m3 - m2 * m2) AS det FROM m)
SELECT record_id, seq, round((m0 * (y1 * m4 - m3 * y2) - y0 * (m1 * m4 - m3 * m2) + m2 * (m1 * y2 - y1 * m2)) / nullif(det, 0) / s, 6) + 0.0::DOUBLE AS velocity,
       round(2 * (m0 * (m2 * y2 - y1 * m3) - m1 * (m1 * y2 - y1 * m2) + y0 * (m1 * m3 - m2 * m2)) / nullif(det, 0) / (s * s), 8) + 0.0::DOUBLE AS acceleration
FROM d""")
def local_polynomial(spark, sf_dir):
    d = derivatives.local_polynomial(A.signal(spark, sf_dir))
    return d.select("record_id", "seq", tidy(F.col("velocity"), 6).alias("velocity"), tidy(F.col("acceleration"), 8).alias("acceleration"))


@query(f"""
WITH RECURSIVE {A.SIGNAL}, s AS (
  SELECT record_id, i, seq, x AS smooth FROM signal WHERE i = 0
  UNION ALL SELECT g.record_id, g.i, g.seq, s.smooth + 0.2::DOUBLE * (g.x - s.smooth) FROM s JOIN signal g ON g.record_id = s.record_id AND g.i = s.i + 1)
SELECT record_id, seq, round(smooth, 6) AS smooth FROM s""")
def ewma_filter(spark, sf_dir):
    return rounded(filters.smoothed(A.signal(spark, sf_dir), 0.2), ["smooth"]).select("record_id", "seq", "smooth")


def _determinant(rows: list[list[str]]) -> str:
    if len(rows) == 1:
        return rows[0][0]
    return "(" + " ".join(f"{'+' if j % 2 == 0 else '-'} {head} * {_determinant([[x for k, x in enumerate(r) if k != j] for r in rows[1:]])}" for j, head in enumerate(rows[0])) + ")"


def _cubic(k: int) -> str:
    """Coefficient k of a cubic's normal equations in m0 .. m6 and y0 .. y3."""
    whole = [[f"m{i + j}" for j in range(4)] for i in range(4)]
    return f"{_determinant([[f'y{i}' if j == k else x for j, x in enumerate(r)] for i, r in enumerate(whole)])} / nullif({_determinant(whole)}, 0)"


@query(f"""
WITH {A.SIGNAL}, n AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS n FROM signal),
e AS (SELECT record_id, seq, i, t, least(n, greatest(0, i - 4) + 9) AS e FROM n), w AS (SELECT *, greatest(0, e - 9) AS s FROM e WHERE e - greatest(0, e - 9) >= 4),
f AS (SELECT w.record_id, w.seq, w.t, g.t AS gt, g.x AS v, max(g.t) OVER (PARTITION BY w.record_id, w.seq) - min(g.t) OVER (PARTITION BY w.record_id, w.seq) AS s FROM w JOIN signal g ON g.record_id = w.record_id AND g.i >= w.s AND g.i < w.e),
u AS (SELECT record_id, seq, s, (gt - t) / nullif(s, 0) AS u, v FROM f),
m AS (SELECT record_id, seq, s, {", ".join(f"sum(u ** {k}) AS m{k}" for k in range(7))}, {", ".join(f"sum(u ** {k} * v) AS y{k}" for k in range(4))} FROM u GROUP BY 1, 2, 3)
SELECT record_id, seq, round({_cubic(1)} / s, 5) + 0.0::DOUBLE AS velocity, round(2 * {_cubic(2)} / (s * s), 7) + 0.0::DOUBLE AS acceleration FROM m""")
def centred_polynomial(spark, sf_dir):
    d = derivatives.local_polynomial(A.signal(spark, sf_dir), order=3, centred=True)
    return d.select("record_id", "seq", tidy(F.col("velocity"), 5).alias("velocity"), tidy(F.col("acceleration"), 7).alias("acceleration"))


def _sos_sql(low: float, high: float, steady: bool = False, select: str = "SELECT record_id, seq, round(filtered, 6) + 0.0::DOUBLE AS filtered FROM f") -> str:
    sections = filters.butterworth_bandpass(low, high, RATE)
    n = len(sections)
    lit = lambda x: f"({float(x)!r})::DOUBLE"
    held = filters.steady_state(sections) if steady else np.zeros((n, 2))
    zero = ", ".join(f"{lit(held[j, 0])} * x AS p{j}, {lit(held[j, 1])} * x AS q{j}" for j in range(n))

    def chain(source: str) -> str:
        """y0 .. yn of one sample, then the states after it."""
        text = f"(SELECT *, {lit(sections[0][0])} * x + p0 AS y0 FROM {source})"
        for j in range(1, n):
            text = f"(SELECT *, {lit(sections[j][0])} * y{j - 1} + p{j} AS y{j} FROM {text})"
        states = ", ".join(f"{lit(s[1])} * {'x' if j == 0 else f'y{j - 1}'} - {lit(s[4])} * y{j} + q{j} AS np{j}, {lit(s[2])} * {'x' if j == 0 else f'y{j - 1}'} - {lit(s[5])} * y{j} AS nq{j}" for j, s in enumerate(sections))
        return f"SELECT record_id, i, seq, t, y{n - 1} AS filtered, {states} FROM {text}"

    before = ", ".join(f"f.np{j} AS p{j}, f.nq{j} AS q{j}" for j in range(n))
    return f"""WITH RECURSIVE {A.SIGNAL}, f AS (
  {chain(f"(SELECT record_id, i, seq, t, x, {zero} FROM signal WHERE i = 0)")}
  UNION ALL {chain(f"(SELECT g.record_id, g.i, g.seq, g.t, g.x, {before} FROM f JOIN signal g ON g.record_id = f.record_id AND g.i = f.i + 1)")})
{select}"""


@query(_sos_sql(0.05, 0.4))
def sos_bandpass_causal(spark, sf_dir):
    return rounded(filters.bandpass(A.signal(spark, sf_dir), 0.05, 0.4, RATE), ["filtered"]).select("record_id", "seq", "filtered")


@query()
def sos_bandpass_zero_phase(spark, sf_dir):
    return rounded(filters.bandpass(A.signal(spark, sf_dir), 0.05, 0.4, RATE, "zero_phase"), ["filtered"]).select("record_id", "seq", "filtered")


@query(_sos_sql(0.05, 0.4, steady=True))
def sos_bandpass_steady(spark, sf_dir):
    return rounded(filters.bandpass(A.signal(spark, sf_dir), 0.05, 0.4, RATE, "steady"), ["filtered"]).select("record_id", "seq", "filtered")


@query()
def acceleration_to_displacement(spark, sf_dir):
    return rounded(filters.acceleration_to_displacement(A.signal(spark, sf_dir), 0.05, 0.4, RATE), ["displacement"]).select("record_id", "seq", "displacement")


@query(f"""
WITH {A.SIGNAL}, p AS (SELECT *, i::DOUBLE AS k FROM signal), m AS (SELECT record_id, avg(x) AS mx, avg(k) AS mk, covar_pop(k, x) / nullif(var_pop(k), 0) AS b FROM p GROUP BY 1)
SELECT record_id, seq, round(x - (mx + coalesce(b, 0) * (k - mk)), 6) + 0.0::DOUBLE AS detrended FROM p JOIN m USING (record_id)""")
def linear_detrend(spark, sf_dir):
    return rounded(filters.detrend(A.signal(spark, sf_dir)), ["detrended"]).select("record_id", "seq", "detrended")


@query(f"""
WITH {A.SIGNAL}, p AS (SELECT *, coalesce((x + lag(x) {W}) / 2 * (t - lag(t) {W}), 0) AS part FROM signal)
SELECT record_id, seq, round(sum(part) OVER (PARTITION BY record_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING), 2) AS integral FROM p""")
def cumulative_trapezoid(spark, sf_dir):
    return rounded(filters.trapezoid(A.signal(spark, sf_dir)), ["integral"], 2).select("record_id", "seq", "integral")


@query(f"""
WITH {A.SIGNAL}, p AS (SELECT record_id, t, x, lead(t) {W} AS t1, lead(x) {W} AS x1 FROM signal),
g AS (SELECT *, unnest(range(ceil(t / 20000.0)::BIGINT, CASE WHEN t1 IS NULL THEN floor(t / 20000.0)::BIGINT + 1 ELSE ceil(t1 / 20000.0)::BIGINT END)) AS k FROM p)
SELECT record_id, k, round(x + coalesce((k * 20000.0::DOUBLE - t) / nullif(t1 - t, 0), 0) * (coalesce(x1, x) - x), 6) AS x FROM g""")
def resample_linear(spark, sf_dir):
    return rounded(timebase.resample(A.signal(spark, sf_dir), 20000.0), ["x"]).select("record_id", "k", "x")


@query(f"""
WITH RECURSIVE {A.SIGNAL}, s AS (
  SELECT record_id, -1::BIGINT AS i, NULL::BIGINT AS seq, NULL::DOUBLE AS t, 0::BIGINT AS n, false AS emit FROM signal WHERE i = 0
  UNION ALL SELECT g.record_id, g.i, g.seq, g.t, s.n + (g.t + 500 >= s.n * 50000.0::DOUBLE)::INT, g.t + 500 >= s.n * 50000.0::DOUBLE FROM s JOIN signal g ON g.record_id = s.record_id AND g.i = s.i + 1)
SELECT record_id, round(t, 6) AS t, seq, n - 1 AS emitted, round((n - 1) * 50000.0::DOUBLE, 6) AS "at" FROM s WHERE emit""")
def decimated_capture(spark, sf_dir):
    return rounded(timebase.decimate(A.signal(spark, sf_dir), 50000.0, 1000.0), ["t", "at"])


@query(f"""
WITH {A.SIGNAL}, n AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS n, t - lag(t) {W} AS dt FROM signal), z AS (SELECT *, CASE WHEN n <= 16 THEN 1 ELSE ceil((n - 16) / 8.0)::BIGINT + 1 END AS blocks FROM n),
st AS (SELECT record_id, coalesce(quantile_cont(dt, 0.5), 0) AS step FROM n GROUP BY 1),
b AS (SELECT record_id, seq, t, i, unnest(range(greatest(0, ceil((i - 15) / 8.0))::BIGINT, least(floor(i / 8.0)::BIGINT, blocks - 1) + 1)) AS block FROM z),
p AS (SELECT record_id, seq, t + k * step AS t, i + k - (blocks - 1) * 8 AS place, blocks - 1 AS block FROM (SELECT z.*, step, unnest(range(1, (blocks - 1) * 8 + 16 - n + 1)) AS k FROM z JOIN st USING (record_id) WHERE i = n - 1))
SELECT record_id, seq, round(t, 4) AS t, block, i - block * 8 AS place, false AS padded FROM b UNION ALL SELECT record_id, seq, round(t, 4), block, place, true FROM p""")
def padded_blocks(spark, sf_dir):
    b = timebase.padded_blocks(A.signal(spark, sf_dir), 16, 8)
    return rounded(b, ["t"], 4).select("record_id", "seq", "t", "block", F.col("place").cast("long").alias("place"), "padded")


DFT = """n AS (SELECT record_id, count(*) AS n FROM signal GROUP BY 1 HAVING count(*) >= 4),
terms AS (SELECT s.record_id, n, k, x * cos(2 * 3.141592653589793::DOUBLE * k * i / n) AS c, -x * sin(2 * 3.141592653589793::DOUBLE * k * i / n) AS d FROM signal s JOIN n USING (record_id), range(0, 4000) r(k) WHERE k <= n // 2),
spec AS (SELECT record_id, n, k, sum(c) ** 2 + sum(d) ** 2 AS power FROM terms GROUP BY 1, 2, 3)"""


@query(f"""
WITH {A.SIGNAL}, {DFT}, r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY round(sqrt(power), 6) DESC, k) AS r FROM spec WHERE k > 0)
SELECT record_id, n, round(k * 1.0::DOUBLE / n, 9) AS dominant_hz FROM r WHERE r = 1""")
def dominant_frequency(spark, sf_dir):
    return rounded(spectral.dominant_frequency(spectral.dft(A.signal(spark, sf_dir)), RATE), ["dominant_hz"], 9)


@query(f"""
WITH {A.SIGNAL}, {DFT}, h AS (SELECT record_id, k * 1.0::DOUBLE / n AS hz, power / (n * n) AS e FROM spec)
SELECT record_id, round(sum(CASE WHEN hz >= 0.02 AND hz < 0.1 THEN e ELSE 0 END), 6) AS band_0, round(sum(CASE WHEN hz >= 0.1 AND hz < 0.25 THEN e ELSE 0 END), 6) AS band_1,
       round(sum(CASE WHEN hz >= 0.25 AND hz < 0.5 THEN e ELSE 0 END), 6) AS band_2
FROM h GROUP BY 1""")
def band_energy(spark, sf_dir):
    e = spectral.band_energy(spectral.dft(A.signal(spark, sf_dir)), RATE, ((0.02, 0.1), (0.1, 0.25), (0.25, 0.5)))
    return rounded(e, ["band_0", "band_1", "band_2"])


@query(f"""
WITH {A.SIGNAL}, {BACKWARD}, p AS (SELECT *, abs(acceleration) AS proxy FROM b2)
SELECT record_id, seq, round(coalesce(max(proxy) OVER (PARTITION BY record_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING), 0), 12) AS running_proxy,
       CASE WHEN proxy IS NULL THEN NULL ELSE round(2 * max(proxy) OVER (PARTITION BY record_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING), 12) END AS running_estimate,
       CASE WHEN proxy IS NULL THEN 'INVALID' ELSE 'LOW_RESEARCH_ONLY' END AS confidence, 'RESEARCH_ONLY_UNCALIBRATED' AS interpretation, coalesce(kind <> lag(kind) {W}, false) AS reseed_boundary,
       CASE WHEN row_number() {W} >= 9 THEN 'READY' ELSE 'WARMUP_' || row_number() {W} || '_OF_9' END AS startup_state
FROM p""")
def running_peak(spark, sf_dir):
    d = derivatives.running_peak(derivatives.backward(A.signal(spark, sf_dir)), coefficient=2.0, research=True)
    d = d.withColumns({"reseed_boundary": derivatives.reseed_boundary(F.col("kind")), "startup_state": derivatives.startup_state()})
    return rounded(d, ["running_proxy", "running_estimate"], 12).select("record_id", "seq", "running_proxy", "running_estimate", "confidence", "interpretation", "reseed_boundary", "startup_state")


@query(f"""
WITH {A.SIGNAL}, {BACKWARD}, c AS (SELECT *, abs(x) AS m, abs(velocity) AS v, abs(acceleration) AS a, max(abs(acceleration)) OVER (PARTITION BY record_id) AS pa FROM b2),
md AS (SELECT record_id, quantile_cont(dt, 0.5) AS md FROM b1 GROUP BY 1)
SELECT record_id, round(max(m), 6) AS peak_displacement, round(max(v), 9) AS peak_velocity, round(max(a), 12) AS peak_acceleration, round(sqrt(avg(m * m)), 6) AS rms_displacement,
       round(sqrt(avg(a * a)), 12) AS rms_acceleration, count(CASE WHEN a >= 0.1 * pa THEN 1 END)::DOUBLE AS strong_duration, count(*) AS sample_count, round(md, 6) AS nominal_dt,
       coalesce(sum(greatest(round_even(dt / nullif(md, 0), 0) - 1, 0)), 0)::BIGINT AS missing
FROM c JOIN md USING (record_id) GROUP BY record_id, md""")
def motion_features(spark, sf_dir):
    d = features.motion_features(A.signal(spark, sf_dir))
    d = rounded(rounded(d, ["peak_displacement", "rms_displacement", "nominal_dt"]), ["peak_acceleration", "rms_acceleration"], 12)
    return rounded(d, ["peak_velocity"], 9).select("record_id", "peak_displacement", "peak_velocity", "peak_acceleration", "rms_displacement", "rms_acceleration", "strong_duration", "sample_count", "nominal_dt", "missing")


@query(f"""
WITH {A.SIGNAL}, n AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS n FROM signal),
b AS (SELECT record_id, seq, i, n, unnest(range(greatest(0, ceil((i - 15) / 8.0))::BIGINT, floor(i / 8.0)::BIGINT + 1)) AS block FROM n),
f AS (SELECT *, i - block * 8 AS place FROM b WHERE block * 8 + 16 <= n), l AS (SELECT *, max(block) OVER (PARTITION BY record_id) AS last FROM f)
SELECT record_id, seq, block, place, place < 8 OR block = last AS finalized, block // 64 AS reseed_id FROM l""")
def hopping_blocks(spark, sf_dir):
    blocks = timebase.hopping_blocks(A.signal(spark, sf_dir), 16, 8)
    final = timebase.finalized(blocks, 8, 16).select("record_id", "seq", "block", F.lit(True).alias("f"))
    return blocks.join(final, ["record_id", "seq", "block"], "left").select("record_id", "seq", "block", F.col("place").cast("long").alias("place"), F.coalesce("f", F.lit(False)).alias("finalized"), F.floor(F.col("block") / 64).alias("reseed_id"))


JUMPS = f"""j AS (SELECT *, lag(x, 1) {W} AS x1, lag(x, 2) {W} AS x2, lag(t, 1) {W} AS t1, lag(t, 2) {W} AS t2, count(*) OVER (PARTITION BY record_id) AS n FROM signal)"""


@query(f"""
WITH {A.SIGNAL}, {JUMPS}
SELECT record_id, i, round(abs(x - (2 * x1 - x2)), 6) AS jump, round(abs((x - x1) / nullif(t - t1, 0) - (x1 - x2) / nullif(t1 - t2, 0)), 9) AS velocity_jump
FROM j WHERE kind = 'purchase' AND i >= 2 AND i + 1 < n""")
def reseed_jumps(spark, sf_dir):
    s = A.signal(spark, sf_dir)
    d = reseed.at_events(reseed.innovations(s), s.where("kind = 'purchase'"))
    return d.select("record_id", F.col("i").cast("long").alias("i"), tidy(F.col("jump")).alias("jump"), tidy(F.col("velocity_jump"), 9).alias("velocity_jump"))


@query(f"""
WITH {A.SIGNAL}, s AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS n FROM signal),
w AS (SELECT a.record_id, a.i, a.x, quantile_cont(b.x, 0.5) AS m FROM s a JOIN s b ON a.record_id = b.record_id AND b.i BETWEEN a.i - 3 AND a.i + 3 WHERE a.kind = 'purchase' AND a.i >= 2 AND a.i + 1 < a.n GROUP BY 1, 2, 3)
SELECT record_id, i, round(x, 6) AS spike, round(m, 6) AS baseline, round(x / greatest(m, 1e-12), 6) AS spike_ratio FROM w""")
def reseed_spikes(spark, sf_dir):
    s = A.signal(spark, sf_dir)
    d = reseed.spikes(s, s.where("kind = 'purchase'"), 3, "x")
    return rounded(d, ["spike", "baseline", "spike_ratio"]).withColumn("i", F.col("i").cast("long"))


@query(f"""
WITH {A.SIGNAL}, e AS (SELECT record_id, t AS event_t FROM signal WHERE kind = 'purchase')
SELECT s.record_id, round(e.event_t, 6) AS event_t, count(*) AS near, round(avg(s.x), 6) AS mean_x FROM signal s JOIN e ON s.record_id = e.record_id AND abs(s.t - e.event_t) <= 86400 GROUP BY 1, 2""")
def event_neighbourhood(spark, sf_dir):
    s = A.signal(spark, sf_dir)
    near = reseed.neighbourhood(s, s.where("kind = 'purchase'").select("record_id", F.col("t").alias("event_t")), 86400.0)
    return near.groupBy("record_id", tidy(F.col("event_t")).alias("event_t")).agg(F.count(F.lit(1)).alias("near"), tidy(F.avg("x")).alias("mean_x"))


@query(f"""
WITH {A.SIGNAL}, {JUMPS}, l AS (SELECT unnest([struct_pack(name := 'jump', v := abs(x - (2 * x1 - x2))), struct_pack(name := 'value', v := x)]) AS p FROM j)
SELECT p.name AS name, count(p.v) AS n, round(quantile_cont(p.v, 0.5), 6) AS p50, round(quantile_cont(p.v, 0.95), 6) AS p95 FROM l WHERE p.v IS NOT NULL GROUP BY 1""")
def reseed_summary(spark, sf_dir):
    d = reseed.innovations(A.signal(spark, sf_dir)).withColumn("value", F.col("x"))
    return rounded(reseed.summary(d, ["jump", "value"]), ["p50", "p95"])


@query(f"""
WITH {A.SIGNAL}, c AS (SELECT record_id, i, x - avg(x) OVER (PARTITION BY record_id) AS x, y - avg(y) OVER (PARTITION BY record_id) AS y FROM signal),
s AS (SELECT a.record_id, b.i - a.i AS lag, sum(a.x * b.y) AS score FROM c a JOIN c b ON a.record_id = b.record_id AND b.i - a.i BETWEEN -5 AND 5 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY round(score, 6) DESC, lag) AS r FROM s)
SELECT record_id, lag::INT AS lag, round(score, 4) + 0.0::DOUBLE AS score FROM r WHERE r = 1""")
def xcorr_lag(spark, sf_dir):
    return rounded(spectral.correlation_lag(A.signal(spark, sf_dir), 5), ["score"], 4)


@query(f"""
WITH {A.SIGNAL}, p AS (SELECT record_id, x, sin(2 * 3.141592653589793::DOUBLE * (i * 0.1::DOUBLE)) AS s, cos(2 * 3.141592653589793::DOUBLE * (i * 0.1::DOUBLE)) AS c FROM signal),
m AS (SELECT record_id, count(*)::DOUBLE AS n, sum(s) AS s, sum(c) AS c, sum(s * s) AS ss, sum(c * c) AS cc, sum(s * c) AS sc, sum(x) AS x, sum(s * x) AS sx, sum(c * x) AS cx FROM p GROUP BY 1),
k AS (SELECT record_id, n, s, c, x, ss - s * s / n AS ss, cc - c * c / n AS cc, sc - s * c / n AS sc, sx - s * x / n AS sx, cx - c * x / n AS cx FROM m),
ab AS (SELECT *, (sx * cc - cx * sc) / nullif(ss * cc - sc * sc, 0) AS a, (cx * ss - sx * sc) / nullif(ss * cc - sc * sc, 0) AS b FROM k)
SELECT record_id, round(sqrt(a * a + b * b), 6) AS amplitude, round(atan2(b, a), 6) + 0.0::DOUBLE AS phase, round((x - a * s - b * c) / n, 6) + 0.0::DOUBLE AS "offset" FROM ab""")
def sinusoid_fit(spark, sf_dir):
    return rounded(spectral.sinusoid_fit(A.signal(spark, sf_dir), F.col("i") * 0.1), ["amplitude", "phase", "offset"])


#: Values of two decimals have means that lie on a rounding edge; this moves them off it.
EDGE = 3.1e-6
BINS = (1, 2, 3)
_SIZES = ", ".join(f"round(sqrt(sum(x * cos(2 * pi() * {k} * i / n)) ** 2 + sum(x * sin(2 * pi() * {k} * i / n)) ** 2) / any_value(n) + {EDGE}, 4) AS amplitude{k}" for k in BINS)


@query(f"""WITH {A.SIGNAL}, s AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS n FROM signal)
SELECT record_id, b::INT AS iteration, any_value(n) AS n, round(avg(x) + {EDGE}, 4) AS mean, round(stddev_pop(x) + {EDGE}, 4) AS deviation, {_SIZES} FROM s, range(0, 3) r(b) GROUP BY 1, 2""")
def phase_surrogates(spark, sf_dir):
    s = spectral.surrogates(A.signal(spark, sf_dir), 3).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("record_id", "iteration")))
    turn = lambda k: 2 * math.pi * k * F.col("i") / F.col("n")
    size = lambda k: F.sqrt(F.sum(F.col("x") * F.cos(turn(k))) ** 2 + F.sum(F.col("x") * F.sin(turn(k))) ** 2) / F.any_value("n")
    out = {"mean": F.avg("x"), "deviation": F.stddev_pop("x")} | {f"amplitude{k}": size(k) for k in BINS}
    return s.groupBy("record_id", "iteration").agg(F.any_value("n").alias("n"), *[tidy(v + EDGE, 4).alias(k) for k, v in out.items()])


OFFSETS = [-43200.0, -21600.0, 0.0, 21600.0, 43200.0]


def _sides(spark, sf_dir):
    s = A.signal(spark, sf_dir)
    return s.where("seq % 2 = 0"), s.where("seq % 2 = 1")


ALIGN = f"""vis AS (SELECT record_id, t, x, y FROM signal WHERE seq % 2 = 0), sen AS (SELECT record_id, t, x, y FROM signal WHERE seq % 2 = 1),
sen2 AS (SELECT *, lead(t) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM sen WINDOW w AS (PARTITION BY record_id ORDER BY t)),
o AS (SELECT unnest({OFFSETS}::DOUBLE[]) AS "offset", unnest(range(0, {len(OFFSETS)})) AS k),
q AS (SELECT record_id, k, "offset", x, y, t + "offset" AS q FROM vis, o),
pt AS (SELECT q.record_id, k, "offset", q.x, q.y, coalesce((q.q - s.t) / nullif(s.t1 - s.t, 0), 0) AS f, s.x AS sx, s.y AS sy, coalesce(s.x1, s.x) AS sx1, coalesce(s.y1, s.y) AS sy1
       FROM q JOIN sen2 s ON q.record_id = s.record_id AND q.q >= s.t AND (q.q < s.t1 OR (s.t1 IS NULL AND q.q = s.t))),
p AS (SELECT record_id, k, "offset", unnest([struct_pack(c := 0, d := 0, v := x, s := sx + f * (sx1 - sx)), struct_pack(c := 0, d := 1, v := x, s := sy + f * (sy1 - sy)),
      struct_pack(c := 1, d := 0, v := y, s := sx + f * (sx1 - sx)), struct_pack(c := 1, d := 1, v := y, s := sy + f * (sy1 - sy))]) AS p FROM pt),
g AS (SELECT record_id, k, "offset", p.c AS channel, p.d AS sensor_channel, count(*) AS n, covar_pop(p.v, p.s) / nullif(stddev_pop(p.v) * stddev_pop(p.s), 0) AS corr FROM p WHERE p.v IS NOT NULL AND p.s IS NOT NULL GROUP BY ALL),
grid AS (SELECT g.* FROM g JOIN (SELECT record_id, count(*) AS total FROM vis GROUP BY 1) USING (record_id) WHERE n >= greatest(10, floor(0.25 * total)) AND corr IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY round(abs(corr), 9) DESC, k, channel, sensor_channel) AS r FROM grid)"""


@query(f"""
WITH {A.SIGNAL}, {ALIGN}
SELECT record_id, "offset", round(abs(corr), 6) AS correlation, channel, sensor_channel, CASE WHEN corr >= 0 THEN 1 ELSE -1 END AS polarity, n AS overlap, CASE WHEN abs(corr) >= 0.3 THEN 'ALIGNED' ELSE 'LOW_CORRELATION' END AS status
FROM best WHERE r = 1""")
def alignment_search(spark, sf_dir):
    visual, sensor = _sides(spark, sf_dir)
    return rounded(alignment.best_alignment(alignment.alignment_grid(visual, sensor, OFFSETS, ["x", "y"], ["x", "y"]), 0.3), ["correlation"])


@query(f"""
WITH {A.SIGNAL}, {ALIGN}, a AS (SELECT record_id, "offset", abs(corr) AS c, row_number() OVER (PARTITION BY record_id ORDER BY round(abs(corr), 9) DESC, k) AS r FROM grid WHERE channel = 0 AND sensor_channel = 0),
d AS (SELECT record_id, "offset", abs(corr) AS c, row_number() OVER (PARTITION BY record_id ORDER BY round(abs(corr), 9) DESC, k) AS r FROM grid WHERE channel = 1 AND sensor_channel = 1)
SELECT coalesce(a.record_id, d.record_id) AS record_id, CASE WHEN coalesce(a.c, -1) >= coalesce(d.c, -1) THEN 'acceleration' ELSE 'displacement' END AS preferred_domain,
       CASE WHEN coalesce(a.c, -1) >= coalesce(d.c, -1) THEN a."offset" ELSE d."offset" END AS preferred_offset, round(a.c, 6) AS acceleration_correlation, round(d.c, 6) AS displacement_correlation
FROM (SELECT * FROM a WHERE r = 1) a FULL JOIN (SELECT * FROM d WHERE r = 1) d ON a.record_id = d.record_id""")
def preferred_domain(spark, sf_dir):
    visual, sensor = _sides(spark, sf_dir)
    one = lambda c: alignment.best_alignment(alignment.alignment_grid(visual, sensor, OFFSETS, [c], [c]))
    return rounded(alignment.preferred_domain(one("x"), one("y")), ["acceleration_correlation", "displacement_correlation"])


@query(f"""
WITH {A.SIGNAL}, {ALIGN}, dm AS (SELECT *, 'acceleration' AS domain FROM grid WHERE channel = 0 AND sensor_channel = 0 UNION ALL SELECT *, 'displacement' FROM grid WHERE channel = 1 AND sensor_channel = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY round(abs(corr), 9) DESC, domain, k) AS r FROM dm)
SELECT record_id, domain, "offset", round(abs(corr), 6) AS correlation, 0 AS channel, 0 AS sensor_channel, CASE WHEN corr >= 0 THEN 1 ELSE -1 END AS polarity, n AS overlap FROM r WHERE r = 1""")
def maximum_domain(spark, sf_dir):
    visual, sensor = _sides(spark, sf_dir)
    grids = {name: alignment.alignment_grid(visual, sensor, OFFSETS, [c], [c]) for name, c in (("acceleration", "x"), ("displacement", "y"))}
    return rounded(alignment.maximum_domain(grids), ["correlation"])


@query(f"""
WITH RECURSIVE {A.SIGNAL}, s AS (
  SELECT record_id, i, seq, t, x, x AS smooth FROM signal WHERE i = 0
  UNION ALL SELECT g.record_id, g.i, g.seq, g.t, g.x, s.smooth + 0.5::DOUBLE * (g.x - s.smooth) FROM s JOIN signal g ON g.record_id = s.record_id AND g.i = s.i + 1),
p AS (SELECT record_id, max(abs(x)) AS rv, max(abs(smooth)) AS cv, arg_max(t, (abs(x), -i)) AS rt, arg_max(t, (abs(smooth), -i)) AS ct, sqrt(avg((smooth - x) ** 2)) AS rmse FROM s GROUP BY 1),
st AS (SELECT record_id, quantile_cont(dt, 0.5) AS step FROM (SELECT record_id, t - lag(t) {W} AS dt FROM signal) GROUP BY 1),
c AS (SELECT record_id, i, x - avg(x) OVER (PARTITION BY record_id) AS x, smooth - avg(smooth) OVER (PARTITION BY record_id) AS y FROM s),
l AS (SELECT a.record_id, b.i - a.i AS lag, sum(a.x * b.y) AS score FROM c a JOIN c b ON a.record_id = b.record_id AND b.i - a.i BETWEEN -8 AND 8 GROUP BY 1, 2), lr AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY round(score, 6) DESC, lag) AS r FROM l)
SELECT record_id, round((cv - rv) / greatest(rv, 1e-12), 6) + 0.0::DOUBLE AS amplitude_bias, round(rmse, 6) AS rmse, lag::INT AS lag_samples, round(lag * step, 4) + 0.0::DOUBLE AS lag, round(ct - rt, 4) + 0.0::DOUBLE AS peak_timing_error,
       round(cv - rv, 6) + 0.0::DOUBLE AS peak_error, round(rv, 6) AS reference_peak, round(cv, 6) AS candidate_peak FROM p JOIN st USING (record_id) JOIN lr USING (record_id) WHERE r = 1""")
def causal_comparison(spark, sf_dir):
    s = A.signal(spark, sf_dir)
    both = s.join(filters.smoothed(s, 0.5).select("record_id", "seq", "smooth"), ["record_id", "seq"])
    d = derivatives.compare_signals(both, "x", "smooth", 8)
    return rounded(rounded(d, ["lag", "peak_timing_error"], 4), ["amplitude_bias", "rmse", "peak_error", "reference_peak", "candidate_peak"])


@query(f"""
WITH {A.SIGNAL}, v AS (SELECT record_id, min(t) AS a, max(t) AS b FROM signal WHERE seq % 2 = 0 GROUP BY 1), s AS (SELECT record_id, min(t) AS a, max(t) AS b FROM signal WHERE seq % 2 = 1 GROUP BY 1)
SELECT record_id, round(s.a - v.a, 6) + 0.0::DOUBLE AS offset_min, round(s.b - v.b, 6) + 0.0::DOUBLE AS offset_max, s.b - s.a >= v.b - v.a AS contained FROM v JOIN s USING (record_id)""")
def containment_range(spark, sf_dir):
    visual, sensor = _sides(spark, sf_dir)
    return rounded(alignment.containment(visual, sensor), ["offset_min", "offset_max"])


NULLS = """nn AS (SELECT record_id, i, x, y, count(*) OVER (PARTITION BY record_id) AS n FROM signal),
sh AS (SELECT record_id, n, i, y, b, floor(greatest(1, ceil(0.05 * n)) + b * (n - 2 * greatest(1, ceil(0.05 * n))) / 199)::BIGINT AS s FROM nn, range(0, 199) r(b) WHERE n >= 10),
nc AS (SELECT m.record_id, m.b, abs(covar_pop(o.x, m.y) / nullif(stddev_pop(o.x) * stddev_pop(m.y), 0)) AS null_corr FROM sh m JOIN nn o ON o.record_id = m.record_id AND o.i = (m.i + m.s) % m.n GROUP BY 1, 2),
ob AS (SELECT record_id, abs(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)) AS observed FROM signal GROUP BY 1),
pv AS (SELECT record_id, observed, (1 + coalesce(sum((round(null_corr, 9) >= round(observed, 9))::INT), 0))::DOUBLE / (count(*) + 1) AS p_value FROM ob JOIN nc USING (record_id) GROUP BY 1, 2)"""


@query(f"WITH {A.SIGNAL}, {NULLS} SELECT record_id, round(observed, 6) AS observed, round(p_value, 9) AS p_value FROM pv")
def null_circular_shift(spark, sf_dir):
    return rounded(rounded(alignment.null_p_values(A.signal(spark, sf_dir), 199), ["observed"]), ["p_value"], 9)


@query(f"""
WITH {A.SIGNAL}, {NULLS}, r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY round(p_value, 9), record_id) AS rk FROM pv)
SELECT record_id, round(p_value, 9) AS p_value, round(least(1.0, min(round(p_value, 9) * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 9) AS q_value FROM r""")
def bh_qvalues(spark, sf_dir):
    p = rounded(alignment.null_p_values(A.signal(spark, sf_dir), 199), ["p_value"], 9)
    return rounded(alignment.bh_q_values(p), ["q_value"], 9).select("record_id", "p_value", "q_value")


def _series(spark, sf_dir):
    visual, sensor = _sides(spark, sf_dir)
    pack = lambda df, a, b: df.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("t", "seq", "x", "y"))).alias("r")).select("record_id", F.col("r.t").alias(a), F.array("r.x", "r.y").alias(b))
    return pack(visual, "t", "v").join(pack(sensor, "st", "sv"), "record_id").where("size(t) >= 10 AND size(st) >= 2")


@query()
def surrogate_null_test(spark, sf_dir):
    return rounded(alignment.null_test(_series(spark, sf_dir), 1000, OFFSETS), ["observed", "p_value"])


SERIES = "big AS (SELECT record_id FROM signal GROUP BY 1 HAVING count(*) FILTER (seq % 2 = 0) >= 10 AND count(*) FILTER (seq % 2 = 1) >= 2)"


@query(f"""
WITH {A.SIGNAL}, {ALIGN}, {SERIES}, top AS (SELECT record_id, max(abs(corr)) AS c FROM grid GROUP BY 1)
SELECT record_id, round(coalesce(c, 0), 6) AS observed FROM big LEFT JOIN top USING (record_id)""")
def null_test_observed(spark, sf_dir):
    return rounded(alignment.null_test(_series(spark, sf_dir), 1000, OFFSETS).select("record_id", "observed"), ["observed"])


SPAN = 43200.0
OWN = f"""st AS (SELECT record_id, quantile_cont(dt, 0.5) AS step FROM (SELECT record_id, t - lag(t) OVER (PARTITION BY record_id ORDER BY t, seq) AS dt FROM (SELECT record_id, t, seq FROM signal WHERE seq % 2 = 0)) GROUP BY 1
  UNION ALL SELECT record_id, quantile_cont(dt, 0.5) FROM (SELECT record_id, t - lag(t) OVER (PARTITION BY record_id ORDER BY t, seq) AS dt FROM (SELECT record_id, t, seq FROM signal WHERE seq % 2 = 1)) GROUP BY 1),
steps AS (SELECT record_id, min(step) AS step FROM st JOIN big USING (record_id) GROUP BY 1),
ow AS (SELECT record_id, k, -{SPAN} + k * step AS "offset" FROM (SELECT record_id, step, unnest(range(0, ceil((2 * {SPAN} + step / 2) / step)::BIGINT)) AS k FROM steps WHERE step > 0))"""


@query(f"""
WITH {A.SIGNAL}, {SERIES}, {OWN}, {ALIGN.replace(ALIGN[ALIGN.index("o AS ("):ALIGN.index("q AS (")], "").replace("FROM vis, o)", "FROM vis JOIN ow USING (record_id))")},
top AS (SELECT record_id, max(abs(corr)) AS c FROM grid GROUP BY 1)
SELECT record_id, round(coalesce(c, 0), 6) AS observed FROM steps LEFT JOIN top USING (record_id) WHERE step > 0""")
def own_grid_search(spark, sf_dir):
    return rounded(alignment.null_test(_series(spark, sf_dir), 0, span=SPAN).select("record_id", "observed"), ["observed"])


@query(f"""
WITH {A.SIGNAL}, c AS (SELECT record_id, x AS e, y AS n, x - y AS u FROM signal)
SELECT record_id, round(max(sqrt(e * e + n * n)), 6) AS pga_horizontal, round(max(greatest(abs(e), abs(n), abs(u))), 6) AS pga_component, round(max(sqrt(e * e + n * n + u * u)), 6) AS pga_vector FROM c GROUP BY 1""")
def pga_definitions(spark, sf_dir):
    s = A.signal(spark, sf_dir).withColumn("u", F.col("x") - F.col("y"))
    return rounded(features.sensor_peaks(s, "x", "y", "u"), ["pga_horizontal", "pga_component", "pga_vector"])


@query(f"""
WITH RECURSIVE {A.SIGNAL}, seg AS (SELECT record_id, (i // 20)::BIGINT AS segment, seq, (t - (i // 20) * 100000.0::DOUBLE) AS t, x FROM signal),
d AS (SELECT *, t - lag(t) OVER (PARTITION BY record_id, segment ORDER BY t) AS dt FROM seg),
g AS (SELECT record_id, segment, min(t) AS a, max(t) AS b, coalesce(quantile_cont(dt, 0.5), 0) AS step FROM d GROUP BY 1, 2),
f AS (SELECT record_id, segment, 0.0::DOUBLE AS shift, b AS e FROM g WHERE segment = 0
      UNION ALL SELECT g.record_id, g.segment, CASE WHEN g.a <= f.e THEN f.e + g.step - g.a ELSE 0 END, g.b + CASE WHEN g.a <= f.e THEN f.e + g.step - g.a ELSE 0 END FROM f JOIN g ON g.record_id = f.record_id AND g.segment = f.segment + 1)
SELECT record_id, seq, segment, round(t + shift, 7) + 0.0::DOUBLE AS t FROM seg JOIN f USING (record_id, segment)""")
def segment_concat(spark, sf_dir):
    s = A.signal(spark, sf_dir).withColumn("segment", F.floor(F.col("i") / 20))
    s = s.withColumn("t", F.col("t") - F.col("segment") * 100000.0)
    return rounded(records.concat_segments(s), ["t"], 7).select("record_id", "seq", "segment", "t")


@query(f"""
WITH {A.SIGNAL}, p AS (SELECT record_id, count(*) AS n, regr_slope(x, i::DOUBLE) AS slope FROM signal GROUP BY 1)
SELECT record_id, n, round(CASE WHEN n < 2 THEN NULL ELSE slope END, 6) + 0.0::DOUBLE AS slope FROM p""")
def queue_slope(spark, sf_dir):
    return rounded(audit.slope(A.signal(spark, sf_dir), "x", ["record_id"], ["t", "seq"]), ["slope"])


@query(f"""
WITH RECURSIVE {A.SIGNAL}, s AS (
  SELECT record_id, -1::BIGINT AS i, 0.0::DOUBLE AS free, 0 AS accepted, 0 AS rejected, 0 AS deepest FROM signal WHERE i = 0
  UNION ALL SELECT record_id, i, CASE WHEN waiting < 2 THEN greatest(free, t) + 40000.0::DOUBLE ELSE free END, accepted + (waiting < 2)::INT, rejected + (waiting >= 2)::INT, greatest(deepest, CASE WHEN waiting < 2 THEN waiting + 1 ELSE waiting END)
  FROM (SELECT g.record_id, g.i, g.t, free, accepted, rejected, deepest, ceil(greatest(free - g.t, 0) / 40000.0::DOUBLE)::INT AS waiting FROM s JOIN signal g ON g.record_id = s.record_id AND g.i = s.i + 1))
SELECT record_id, arg_max(accepted, i) AS accepted, arg_max(rejected, i) AS rejected, arg_max(deepest, i) AS deepest FROM s GROUP BY 1""")
def bounded_queue(spark, sf_dir):
    return audit.bounded_queue(A.signal(spark, sf_dir), 2, 40000.0)


@query(f"""
WITH {A.SIGNAL}, g AS (SELECT record_id, max(t) - min(t) AS seconds, sum((x > 480)::INT) AS dropped, sum((x < 1)::INT) AS failed, quantile_cont(x, 0.95) AS p95 FROM signal GROUP BY 1)
SELECT record_id, round(seconds, 6) AS seconds, dropped::BIGINT AS dropped, failed::BIGINT AS failed, round(p95, 6) AS p95,
       CASE WHEN seconds < 1000000 THEN 'NOT_TESTED' WHEN dropped > 0 OR failed > 0 OR p95 >= 470 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM g""")
def acceptance_verdict(spark, sf_dir):
    s = A.signal(spark, sf_dir).select("record_id", "t", F.col("x").alias("latency"), (F.col("x") > 480).cast("int").alias("dropped"), (F.col("x") < 1).cast("int").alias("failed"))
    return rounded(audit.acceptance(s, "record_id", 1000000.0, 470.0), ["seconds", "p95"])


@query(f"""
WITH {A.SIGNAL}, m AS (SELECT record_id, CASE WHEN kind <> 'view' THEN (x > 480)::INT END AS dropped FROM signal)
SELECT record_id, count(dropped) AS measured, sum(dropped)::BIGINT AS dropped, CASE WHEN count(dropped) = 0 THEN 'NOT_MEASURED' WHEN sum(dropped) > 0 THEN 'DROPS_COUNTED' ELSE 'NO_DROPS' END AS status FROM m GROUP BY 1""")
def drop_verdict(spark, sf_dir):
    s = A.signal(spark, sf_dir).withColumn("dropped", F.when(F.col("kind") != "view", (F.col("x") > 480).cast("int")))
    return audit.drop_status(s, "record_id")


@query("SELECT coalesce(event_type, 'UNKNOWN') AS name, count(*) AS n FROM events GROUP BY 1")
def event_counts(spark, sf_dir):
    return audit.counts(A.table(spark, sf_dir, "events"), "event_type")


@query(f"""WITH {A.SIGNAL} SELECT record_id, string_agg(DISTINCT kind, '|' ORDER BY kind) AS quality_flags FROM signal GROUP BY 1""")
def quality_flag_sets(spark, sf_dir):
    return features.quality_flags(A.signal(spark, sf_dir), "kind")


@query(f"""
WITH {A.SIGNAL}, o AS (SELECT record_id, seq, t, max(t) OVER (PARTITION BY record_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM signal)
SELECT record_id, seq, round(t, 6) AS t, round(before, 6) AS before FROM o WHERE t <= before""")
def out_of_order_samples(spark, sf_dir):
    return rounded(timebase.monotonic_violations(A.signal(spark, sf_dir)).select("record_id", "seq", "t", "before"), ["t", "before"])


@query("""
WITH o AS (SELECT o_custkey AS record_id, o_orderkey AS seq, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS t FROM orders),
b AS (SELECT *, max(t) OVER (PARTITION BY record_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o)
SELECT record_id, seq, t, before FROM b WHERE t <= before""")
def orders_out_of_date_order(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("record_id"), F.col("o_orderkey").alias("seq"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double").alias("t"))
    return timebase.monotonic_violations(rows).select("record_id", "seq", "t", "before")


ONLINE = f"""SELECT record_id, i AS seq, round(t, 6) + 0.0::DOUBLE AS t, round(filtered, 6) + 0.0::DOUBLE AS filtered, round(velocity, 6) + 0.0::DOUBLE AS velocity, round(acceleration, 6) + 0.0::DOUBLE AS acceleration,
  round(coalesce(max(abs(acceleration)) OVER (PARTITION BY record_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0), 6) AS running_peak, i + 1 AS samples_seen, CASE WHEN i >= 2 THEN 'READY' ELSE 'WARMUP_' || (i + 1) || '_OF_3' END AS startup_state, false AS rejected
FROM (SELECT *, 2 * (velocity - lag(velocity) {W}) / (dt + lag(dt) {W}) AS acceleration FROM (SELECT *, t - lag(t) {W} AS dt, (filtered - lag(filtered) {W}) / (t - lag(t) {W}) AS velocity FROM f))"""


@query(_sos_sql(0.05, 0.4, steady=True, select=ONLINE))
def online_signal(spark, sf_dir):
    s = A.signal(spark, sf_dir)
    out = online.online_signal(s.withColumn("seq", F.col("i").cast("long")))
    return rounded(out, ["t", "filtered", "velocity", "acceleration", "running_peak"])


def _dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


#: Powers of the time in the window made orthogonal one after the other, which stays exact where samples lie close together.
_LESS = "list_transform(list_zip({}), lambda p: p[1] - {})"


@query(f"""
WITH {A.SIGNAL}, w AS (SELECT record_id, i, t, x, list(t) OVER v AS ts, list(x) OVER v AS y FROM signal WINDOW v AS (PARTITION BY record_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
u1 AS (SELECT *, list_transform(ts, lambda z: (z - t) / nullif(t - ts[1], 0)) AS u FROM w WHERE len(ts) >= 4),
u2 AS (SELECT record_id, i, u, y, list_transform(u, lambda z: z * z) AS uu, list_transform(u, lambda z: z * z * z) AS uuu, list_avg(u) AS m FROM u1),
u3 AS (SELECT *, list_transform(u, lambda z: z - m) AS v1, list_avg(uu) AS a FROM u2),
u4 AS (SELECT *, {_dot("uu", "v1")} / {_dot("v1", "v1")} AS b FROM u3),
u5 AS (SELECT *, {_LESS.format("uu, v1", "a - b * p[2]")} AS v2, list_avg(uuu) AS c, {_dot("uuu", "v1")} / {_dot("v1", "v1")} AS d FROM u4),
u6 AS (SELECT *, {_LESS.format("uuu, v1", "c - d * p[2]")} AS r3 FROM u5),
u7 AS (SELECT *, {_dot("r3", "v2")} / {_dot("v2", "v2")} AS e FROM u6),
u8 AS (SELECT *, {_LESS.format("r3, v2", "e * p[2]")} AS v3 FROM u7),
u9 AS (SELECT *, {", ".join(f"{_dot('y', f'v{k}')} / {_dot(f'v{k}', f'v{k}')} AS g{k}" for k in (1, 2, 3))} FROM u8),
d AS (SELECT record_id, i, g1 - b * g2 + (e * b - d) * g3 AS turn, 2 * (g2 - e * g3) AS bend FROM u9)
SELECT w.record_id, w.i AS seq, round(w.x, 6) AS filtered, round(sign(d.turn) * ln(1 + abs(d.turn)), 5) + 0.0::DOUBLE AS log_velocity, round(sign(d.bend) * ln(1 + abs(d.bend)), 5) + 0.0::DOUBLE AS log_acceleration,
       w.i + 1 AS samples_seen, CASE WHEN w.i >= 3 THEN 'READY' ELSE 'WARMUP_' || (w.i + 1) || '_OF_4' END AS startup_state
FROM w LEFT JOIN d USING (record_id, i)""")
def online_polynomial(spark, sf_dir):
    """Velocity and acceleration in units of their window's length, as logarithms, as they span many orders of magnitude."""
    s = A.signal(spark, sf_dir).withColumn("seq", F.col("i").cast("long"))
    out = online.online_signal(s, low=None, method=online.POLYNOMIAL, window=9, order=3)
    span = F.col("t") - F.first("t").over(Window.partitionBy("record_id").orderBy("seq").rowsBetween(-8, 0))
    logged = lambda v: tidy(F.signum(v) * F.log1p(F.abs(v)), 5)
    return out.select("record_id", "seq", tidy(F.col("filtered"), 6).alias("filtered"), logged(F.col("velocity") * span).alias("log_velocity"), logged(F.col("acceleration") * span * span).alias("log_acceleration"), "samples_seen", "startup_state")


@query("""
SELECT l_orderkey, l_linenumber, round(l_quantity * 1000, 4) AS queue_wait, round(l_tax * 1000, 4) AS tracker_compute, round((l_quantity + l_tax) * 1000, 4) AS capture_to_tracker_end, round((l_quantity + l_tax + l_discount) * 1000, 4) AS capture_to_pga, round(l_discount * 1000, 4) AS pga_ms
FROM lineitem""")
def latency_decomposition(spark, sf_dir):
    i = A.table(spark, sf_dir, "lineitem")
    q, x, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    blocks = i.withColumns({"capture": F.lit(0.0), "enqueue": F.lit(0.0), "tracker_start": q, "tracker_end": q + x, "motion_end": q + x, "signal_end": q + x, "pga_end": q + x + d, "write_end": q + x + d})
    parts = ["queue_wait", "tracker_compute", "capture_to_tracker_end", "capture_to_pga", "pga_ms"]
    return rounded(audit.latencies(blocks), parts, 4).select("l_orderkey", "l_linenumber", *parts)


@query(f"""
WITH {A.SIGNAL}, {JUMPS}, e AS (SELECT record_id, abs(x - (2 * x1 - x2)) / 100 AS ratio FROM j WHERE kind = 'purchase' AND i >= 2 AND i + 1 < n),
g AS (SELECT s.record_id, count(ratio) AS events, quantile_cont(ratio, 0.95) AS p95 FROM (SELECT DISTINCT record_id FROM signal) s LEFT JOIN e USING (record_id) GROUP BY 1)
SELECT record_id, CASE WHEN p95 IS NULL THEN 'NOT_MEASURED' WHEN p95 > 3 THEN 'FAIL_REVIEW_REQUIRED' WHEN events < 2 THEN 'NOT_EVALUABLE_SINGLE_EVENT_BELOW_THRESHOLD' ELSE 'PASS_P95_RATIO_LE_3' END AS verdict, 'reseed' AS criterion FROM g""")
def run_verdicts(spark, sf_dir):
    s = A.signal(spark, sf_dir)
    jumps = reseed.at_events(reseed.innovations(s), s.where("kind = 'purchase'")).withColumn("spike_ratio", F.col("jump") / 100)
    return audit.verdict_table(s.select("record_id").distinct(), ("reseed", audit.reseed_status(jumps, "record_id"), "status"), key="record_id")
