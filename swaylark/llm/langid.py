"""Language identification by a bidirectional gated recurrent network over bytes.

A network of two directions reads windows of a text's bytes and gives each position a probability for every
language; a document's probabilities are the means over all its positions. It is trained in numpy by
backpropagation through time on windows of a bounded sample of labelled documents. Windows follow each other
without overlap and cover the whole text; each starts from an empty state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

HIDDEN = 8
WINDOW = 64
#: Labelled documents of each language that the network learns from, about; two windows of each.
SAMPLE = 1500
STEPS = 260
BATCH = 160
#: A place past the end of a text: its update gate keeps the state as it is.
PAD = 256


@dataclass
class Network:
    """``table``: what each byte adds to the gates (update, reset, new), by direction; ``recur``: what the state adds."""

    table: np.ndarray  # 2 x 257 x 3H
    recur: np.ndarray  # 2 x H x 3H
    out: np.ndarray  # 2 x H x K
    bias: np.ndarray  # K
    languages: list[str]

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.table, self.recur, self.out, self.bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_network(languages: list[str], hidden: int = HIDDEN, seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.25, shape).astype(np.float32)
    net = Network(small(2, 257, 3 * hidden), small(2, hidden, 3 * hidden), small(2, hidden, len(languages)), np.zeros(len(languages), np.float32), languages)
    net.table[:, PAD] = 0
    net.table[:, PAD, :hidden] = 30
    return net


def forward(net: Network, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of both directions by position: 2 x T x B x H. ``x``: T x B bytes. ``keep`` gets what the way back needs."""
    t, b = x.shape
    h = net.recur.shape[1]
    both = np.stack([x, x[::-1]])  # direction, step, text
    state = np.zeros((2, b, h), np.float32)
    states = np.empty((2, t, b, h), np.float32)
    for i in range(t):
        given = np.stack([net.table[0][both[0, i]], net.table[1][both[1, i]]])
        recur = state @ net.recur
        gates = _sigmoid(given[..., : 2 * h] + recur[..., : 2 * h])
        z, r = gates[..., :h], gates[..., h:]
        n = np.tanh(given[..., 2 * h :] + r * recur[..., 2 * h :])
        new = n + z * (state - n)
        if keep is not None:
            keep.append((state, z, r, n, recur[..., 2 * h :]))
        state = new
        states[0, i], states[1, t - 1 - i] = state
    return states


def probabilities(net: Network, states: np.ndarray) -> np.ndarray:
    """T x B x K."""
    logits = states[0] @ net.out[0]
    logits += states[1] @ net.out[1]
    logits += net.bias
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


def gradients(net: Network, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions that are not padding, and its gradients by weight."""
    keep: list = []
    states = forward(net, x, keep)
    p = probabilities(net, states)
    t, b, _ = p.shape
    h = net.recur.shape[1]
    real = x != PAD
    scale = np.float32(1 / max(real.sum(), 1))
    loss = float(-(np.log(np.maximum(p[:, np.arange(b), label], 1e-12)) * real).sum() * scale)
    d = p
    d[:, np.arange(b), label] -= 1
    d *= real[..., None] * scale
    d_out = np.stack([np.tensordot(s, d, ([0, 1], [0, 1])) for s in states])
    d_bias = d.sum((0, 1))
    d_states = np.stack([d @ o.T for o in net.out])
    d_recur = np.zeros_like(net.recur)
    d_given = np.empty((2, t, b, 3 * h), np.float32)
    d_state = np.zeros((2, b, h), np.float32)
    for i in range(t - 1, -1, -1):
        before, z, r, n, recur_n = keep[i]
        d_state = d_state + np.stack([d_states[0, i], d_states[1, t - 1 - i]])
        dz = d_state * (before - n) * z * (1 - z)
        dn = d_state * (1 - z) * (1 - n * n)
        dr = dn * recur_n * r * (1 - r)
        d_given[:, i] = np.concatenate([dz, dr, dn], -1)
        d_rec = np.concatenate([dz, dr, dn * r], -1)
        d_recur += before.transpose(0, 2, 1) @ d_rec
        d_state = d_state * z + d_rec @ net.recur.transpose(0, 2, 1)
    d_table = np.zeros_like(net.table)
    for k, at in enumerate((x, x[::-1])):
        flat = at.ravel()
        order = np.argsort(flat, kind="stable")
        values, first = np.unique(flat[order], return_index=True)
        d_table[k, values] = np.add.reduceat(d_given[k].reshape(-1, 3 * h)[order], first)
    d_table[:, PAD] = 0
    return loss, [d_table, d_recur, d_out, d_bias]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 3) -> Network:
    """By Adam on random batches. ``windows``: N x T bytes."""
    net = new_network(languages, seed=seed)
    if not len(windows) or len(languages) < 2:
        return net
    rng = np.random.default_rng(seed)
    m, v = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for step in range(1, steps + 1):
        at = rng.integers(0, len(windows), batch)
        _, grads = gradients(net, np.ascontiguousarray(windows[at].T), labels[at])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1, 2 - 2 * step / (steps + 1))  # falls over the second half
        grads = [g / max(size, 1) for g in grads]
        for w, g, a, b in zip(net.weights, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


class Reader:
    """Applies a network, with a row of memory for each gate and a column for each window, and half-angle sigmoids."""

    def __init__(self, net: Network, most: int = 2048):
        self.net, self.most = net, most
        h = net.recur.shape[1]
        half = np.ones(3 * h, np.float32)
        half[: 2 * h] = 0.5
        self.table = [np.ascontiguousarray((t * half).T) for t in net.table]
        self.recur = [np.ascontiguousarray((u * half).T) for u in net.recur]
        self.out = [np.ascontiguousarray(o.T) for o in net.out]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """T x K x B of T x B bytes."""
        t, b = x.shape
        h, k = self.net.recur.shape[1], len(self.net.bias)
        out = np.empty((t, k, b), np.float32)
        out[:] = self.net.bias[:, None]
        given, recur = np.empty((3 * h, b), np.float32), np.empty((3 * h, b), np.float32)
        for table, u, o, steps in zip(self.table, self.recur, self.out, (range(t), range(t - 1, -1, -1)), strict=True):
            state = np.zeros((h, b), np.float32)
            for i in steps:
                np.take(table, x[i], axis=1, out=given, mode="clip")
                np.matmul(u, state, out=recur)
                gates = given[: 2 * h]
                gates += recur[: 2 * h]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                n = recur[2 * h :]
                n *= gates[h:]
                n += given[2 * h :]
                np.tanh(n, out=n)
                state -= n
                state *= gates[:h]
                state += n
                out[i] += o @ state
        return out

    def classify(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities over the bytes of each text laid end to end; empty texts have zeros."""
        sizes = np.diff(offsets)
        n_windows = -(-sizes // WINDOW)
        total = int(n_windows.sum())
        sums = np.zeros((len(sizes), len(self.net.languages)))
        owner = np.repeat(np.arange(len(sizes)), n_windows)
        number = np.arange(total) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        starts = offsets[:-1][owner] + number * WINDOW
        ends = np.minimum(starts + WINDOW, offsets[1:][owner])
        padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        step = np.arange(WINDOW)[:, None]
        for a in range(0, total, self.most):
            s, e = starts[a : a + self.most], ends[a : a + self.most]
            real = s + step < e
            p = self.logits(np.where(real, padded[s + step].astype(np.int64), PAD))
            p -= p.max(1, keepdims=True)
            np.exp(p, out=p)
            p *= (real / p.sum(1))[:, None]
            own = owner[a : a + self.most]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            sums[own[first]] += np.add.reduceat(p.sum(0), first, axis=1).T
        return sums / np.maximum(sizes, 1)[:, None]


def _uniform(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(11), key), 11).cast("double") / F.lit(float(1 << 53))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, most: int | None = None) -> Network | None:
    """From rows whose language is not null: about ``sample`` documents of each language, those whose ids hash least; with ``most`` of the most frequent languages only.

    Two windows of each, at places drawn from its length, come to the driver. Null and empty texts teach nothing;
    rows that repeat an id are chosen alike. None without any language.
    """
    C.small_batches(labelled.sparkSession)
    known = labelled.where(F.col(lang).isNotNull() & (F.octet_length(text) > 0))
    counts = {r[0]: r[1] for r in known.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(most or (1 << 31) - 1).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, sample / n)])
    chosen = known.where(F.col(lang).isin(languages) & (_uniform(F.col(key)) < F.try_element_at(share, F.col(lang))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, windows = [], []
            for name, body in zip(C.values(batch, "lang"), C.values(batch, "body"), strict=True):
                for k in (0, 1):
                    at = 0 if len(body) <= WINDOW else (len(body) * 2654435761 + k * 40503 * len(body) // 7) % (len(body) - WINDOW)
                    langs.append(name)
                    windows.append(body[at : at + WINDOW])
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "window": pa.array(windows, pa.binary())})

    rows = chosen.select(F.col(lang).alias("lang"), C.body(text).alias("body")).mapInArrow(cut, "lang string, window binary")
    rows = rows.orderBy(F.xxhash64("lang", "window"), "window").limit(2 * sample * len(languages)).collect()
    x = np.full((len(rows), WINDOW), PAD, np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r["window"])] = np.frombuffer(r["window"], np.uint8)
    return train(x, np.array([languages.index(r["lang"]) for r in rows], np.int64), languages)


def predict(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score (the mean probability of that language).

    Null texts, empty ones and those without a letter are ``und`` with score 0, as is all text if nothing was
    learned. Texts of any length are read whole. Rows that repeat are rows of their own; null ids stay null; of
    equal probabilities the first language by name counts. Empty tables give no rows.
    """
    C.small_batches(docs.sparkSession)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net) if net is not None else None
        for batch in batches:
            texts = C.values(batch, "text")
            letters = [net is not None and x is not None and any(map(str.isalpha, x)) for x in texts]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            data, offsets = C.binaries(batch, "text")
            for a, b in C.blocks(batch, "text", 1 << 20):
                if not any(letters[a:b]):
                    continue
                p = reader.classify(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                best = p.argmax(1)
                for i in range(a, b):
                    if letters[i]:
                        names[i], scores[i] = net.languages[best[i - a]], min(1.0, float(p[i - a, best[i - a]]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(predicted, "doc_id long, lang_pred string, score double")
