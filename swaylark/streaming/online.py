"""The online signal processor as a stateful stream.

A record's samples pass a causal band pass that starts from the first value held; derivatives follow, by backward
differences or by a polynomial fitted to the last few samples, and a running peak. State is a few numbers per record, and goes
when event time has passed the record by, where the stream has it. Samples that do not come after the one before are
given back as rejected rather than dropped. A micro-batch's rows are sorted here, as they come in any order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.filters import butterworth_bandpass, run_sections, steady_state

OUTPUT = "record_id long, seq long, t double, filtered double, velocity double, acceleration double, running_peak double, samples_seen long, startup_state string, rejected boolean"
STATE = "state string"


#: How derivatives are taken. Fixed values.
DIFFERENCES, POLYNOMIAL = "backward_finite_difference", "causal_polynomial"


class Derivatives:
    """First and second derivatives of several channels at a record's last sample, from the last few.

    Differences need two and three samples. The polynomial of ``order`` is fitted by least squares to the last
    ``window`` samples, or as many as there are from order + 1 on, in time since the last one over the window's length.
    """

    def __init__(self, method: str = DIFFERENCES, window: int = 9, order: int = 3):
        if method not in (DIFFERENCES, POLYNOMIAL) or window <= order or order < 2:
            raise ValueError("derivatives are by differences, or by a polynomial of order 2 or more over more samples than its order")
        self.method, self.window, self.order = method, 3 if method == DIFFERENCES else window, order
        self.required = 3 if method == DIFFERENCES else order + 1
        self.t, self.values = np.zeros(0), None

    def update(self, t: float, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.t = np.append(self.t, t)[-self.window :]
        self.values = values[None] if self.values is None else np.concatenate([self.values, values[None]])[-self.window :]
        velocity, acceleration = np.full(values.shape, np.nan), np.full(values.shape, np.nan)
        if self.method == DIFFERENCES:
            dt = np.diff(self.t)
            slopes = np.diff(self.values, axis=0) / dt.reshape(-1, *[1] * values.ndim)
            if len(slopes):
                velocity = slopes[-1]
            if len(slopes) == 2:
                acceleration = 2 * (slopes[1] - slopes[0]) / (dt[0] + dt[1])
        elif len(self.t) >= self.required:
            scale = self.t[-1] - self.t[0]
            powers = np.vander((self.t - self.t[-1]) / scale, self.order + 1, increasing=True)
            fitted = np.linalg.lstsq(powers, self.values.reshape(len(self.t), -1), rcond=None)[0]
            velocity, acceleration = fitted[1].reshape(values.shape) / scale, 2 * fitted[2].reshape(values.shape) / scale**2
        return velocity, acceleration

    def startup(self) -> str:
        return "READY" if len(self.t) >= self.required else f"WARMUP_{len(self.t)}_OF_{self.required}"

    def dump(self) -> list:
        return [self.method, self.window, self.t.tolist(), None if self.values is None else self.values.tolist()]

    def load(self, kept: list) -> None:
        self.t, self.values = np.array(kept[2]), None if kept[3] is None else np.array(kept[3])


class OnlineSignal:
    """One record's filter, derivatives and peak. ``dump`` and ``load`` keep it between micro-batches. Without ``sections`` values pass as they are."""

    def __init__(self, sections: np.ndarray | None, derivatives: Derivatives | None = None):
        self.sections, self.derivatives = sections, derivatives or Derivatives()
        self.filter: np.ndarray | None = None
        self.peak, self.seen = 0.0, 0

    def dump(self) -> str:
        return json.dumps([self.filter.tolist() if self.filter is not None else None, *self.derivatives.dump(), self.peak, self.seen])

    @classmethod
    def load(cls, sections: np.ndarray | None, text: str, derivatives: Derivatives | None = None) -> OnlineSignal:
        new = cls(sections, derivatives)
        kept, *history, new.peak, new.seen = json.loads(text)
        new.derivatives.load(history)
        new.filter = np.array(kept) if kept is not None else None
        return new

    def update(self, t: float, x: float) -> tuple | None:
        """(filtered, velocity, acceleration, running peak, samples seen, startup state), or None if the sample is refused."""
        if (len(self.derivatives.t) and not t > self.derivatives.t[-1]) or not np.isfinite(t) or not np.isfinite(x):
            return None
        if self.sections is not None:
            if self.filter is None:
                self.filter = steady_state(self.sections) * x
            y, self.filter = run_sections(self.sections, np.array([x]), self.filter)
            x = float(y[0])
        velocity, acceleration = (None if np.isnan(v) else float(v) for v in self.derivatives.update(t, np.array(x)))
        if acceleration is not None:
            self.peak = max(self.peak, abs(acceleration))
        self.seen += 1
        return x, velocity, acceleration, self.peak, self.seen, self.derivatives.startup()


def _process(state: OnlineSignal, key: int, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in rows.sort_values("seq").itertuples():
        got = state.update(float(r.t), float(r.x))
        out.append((key, r.seq, r.t, *(got or (None,) * 6), got is None))
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    return pd.DataFrame(out, columns=names)


def _grouped(stream: DataFrame, columns: list[str], schema: str, fresh, load, process, event_time: str | None, idle: float) -> DataFrame:
    """A table's records as wholes, or a stream's by state: forgotten ``idle`` seconds of event time after their last row where ``event_time`` has a watermark, else never."""
    if not stream.isStreaming:
        return stream.select(*columns).groupBy("record_id").applyInPandas(lambda rows: process(fresh(), int(rows["record_id"].iloc[0]), rows), schema)
    empty = pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield empty
            return
        held = load(state.get[0]) if state.exists else fresh()
        rows = pd.concat(list(batches))
        if len(rows):
            yield process(held, int(key[0]), rows)
        state.update((held.dump(),))
        if event_time:
            state.setTimeoutTimestamp(max(int(rows[event_time].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + max(1, round(idle * 1000)))

    kind = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout
    return stream.select(*columns, *([event_time] if event_time else [])).groupBy("record_id").applyInPandasWithState(update, schema, STATE, "append", kind)


def online_signal(stream: DataFrame, low: float | None = 0.05, high: float = 0.4, rate: float = 1.0, method: str = DIFFERENCES, window: int = 9, order: int = 3, event_time: str | None = None, idle: float = 600.0) -> DataFrame:
    """A stream (or table) of record_id, seq, t, x as OUTPUT rows. Order within a micro-batch is by seq.

    Without ``low`` values are not filtered. ``method``: see ``Derivatives``. With ``event_time``, a column that has a watermark, a
    record's state goes ``idle`` seconds after its last sample.
    """
    sections = None if low is None else butterworth_bandpass(low, high, rate)
    fresh = lambda: OnlineSignal(sections, Derivatives(method, window, order))
    load = lambda text: OnlineSignal.load(sections, text, Derivatives(method, window, order))
    return _grouped(stream, ["record_id", "seq", "t", "x"], OUTPUT, fresh, load, _process, event_time, idle)


MOTION = (
    "record_id long, seq long, timestamp double, filtered_common_x double, filtered_common_y double, common_velocity_x double, common_velocity_y double, common_acceleration_x double, common_acceleration_y double, "
    "local_motion_rms double, local_velocity_rms double, local_acceleration_rms double, quality_state string, derivative_method string, startup_state string, samples_seen int, retained_history_samples int, filter_state_bytes int, reseed_id int, reseed_boundary boolean, rejected boolean"
)


class OnlineMotion:
    """A record's common motion (x, y) and local motion of its points, all channels filtered and differenced side by side."""

    def __init__(self, sections: np.ndarray, derivatives: Derivatives | None = None):
        self.sections, self.derivatives = sections, derivatives or Derivatives()
        self.filter: np.ndarray | None = None  # section, two numbers, channel
        self.seen, self.reseed = 0, None

    def dump(self) -> str:
        return json.dumps([None if self.filter is None else self.filter.tolist(), *self.derivatives.dump(), self.seen, self.reseed])

    @classmethod
    def load(cls, sections: np.ndarray, text: str, derivatives: Derivatives | None = None) -> OnlineMotion:
        new = cls(sections, derivatives)
        kept, *history, new.seen, new.reseed = json.loads(text)
        new.filter = None if kept is None else np.array(kept)
        new.derivatives.load(history)
        return new

    def update(self, t: float, common: list[float], local: list[list[float]], reseed: int) -> tuple | None:
        """The row's numbers, or None for a sample that is refused: late, not finite, or of another number of points."""
        values = np.array([*common, *(x for p in local for x in p)], float)
        late = len(self.derivatives.t) and not t > self.derivatives.t[-1]
        if late or not local or not np.isfinite(t) or not np.isfinite(values).all() or (self.filter is not None and self.filter.shape[2] != len(values)):
            return None
        if self.filter is None:
            self.filter = steady_state(self.sections)[:, :, None] * values
        for (b0, b1, b2, _, a1, a2), state in zip(self.sections, self.filter, strict=True):
            out = b0 * values + state[0]
            state[0], state[1] = b1 * values - a1 * out + state[1], b2 * values - a2 * out
            values = out
        velocity, acceleration = self.derivatives.update(t, values)
        self.seen += 1
        rms = lambda v: float(np.sqrt(np.mean(np.sum(v[2:].reshape(-1, 2) ** 2, axis=1))))
        boundary, self.reseed = self.reseed is not None and reseed != self.reseed, reseed
        return *values[:2], *velocity[:2], *acceleration[:2], rms(values), rms(velocity), rms(acceleration), self.derivatives.startup(), self.seen, len(self.derivatives.t), self.filter.nbytes, reseed, boundary


def _move(held: OnlineMotion, key: int, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in rows.sort_values("seq").itertuples():
        got = held.update(float(r.t), [r.x, r.y], [list(p) for p in r.local], int(r.reseed_id))
        numbers = (None,) * 9 if got is None else got[:9]
        startup, seen, kept, size, reseed, boundary = (None, held.seen, len(held.derivatives.t), 0, int(r.reseed_id), False) if got is None else got[9:]
        out.append((key, r.seq, r.t, *numbers, r.quality, held.derivatives.method, startup, seen, kept, size, reseed, boundary, got is None))
    return pd.DataFrame(out, columns=[c.split()[0] for c in MOTION.split(", ")])


def online_motion(stream: DataFrame, low: float = 0.05, high: float = 0.4, rate: float = 1.0, method: str = DIFFERENCES, window: int = 9, order: int = 3, event_time: str | None = None, idle: float = 600.0) -> DataFrame:
    """A stream (or table) of record_id, seq, t, x, y, local (array of [x, y] by point), quality, reseed_id as MOTION rows.

    A sample that is late, not finite or of another number of points than the record's first is given back as
    rejected and leaves the state as it was. A new source is a new record_id, which begins anew. ``method``: see ``Derivatives``; state goes as in ``online_signal``.
    """
    sections = butterworth_bandpass(low, high, rate)
    fresh = lambda: OnlineMotion(sections, Derivatives(method, window, order))
    load = lambda text: OnlineMotion.load(sections, text, Derivatives(method, window, order))
    return _grouped(stream, ["record_id", "seq", "t", "x", "y", "local", "quality", "reseed_id"], MOTION, fresh, load, _move, event_time, idle)


def fan_out(folder: str):
    """A foreachBatch sink that writes a micro-batch's signals and rejects to their own tables."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("NOT rejected").write.mode("append").parquet(f"{folder}/online_signal")
        batch.where("rejected").write.mode("append").parquet(f"{folder}/rejected")
        batch.unpersist()

    return write
