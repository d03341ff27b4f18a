"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased, digits and white space folded; n-grams of characters, of words and across them, are hashed to
buckets. A feature is 1 where the text has the bucket, times the bucket's log ratio of smoothed document
shares in toxic and other texts; buckets of small ratios are left out. A logistic regression on a bounded sample of labelled texts learns one
weight per bucket; the log-count ratios count all labelled texts. Applying it is one table lookup per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDERS = (4, 5, 6)
BITS = 18
#: Labelled texts of each class that the regression is fitted on, about: those of the least hashes.
SAMPLE = 3000
#: Texts by which the counts of a bucket are smoothed.
SMOOTH = 150.0
#: Buckets whose ratio is nearer to 0 than this are no features: they tell the classes apart too little. Held-out rows of sf0.1:
#: recall 0.74 and 0.25 % false alarms with it, 0.67 and 0.33 % with every bucket.
LEAST_RATIO = 0.3
THRESHOLD = 0.7


def characters(data: np.ndarray) -> np.ndarray:
    """The code points of a text's UTF-8 bytes in lower case, digits as 0 and white space as a space."""
    text = data.tobytes()
    x = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32) if not text.isascii() else FOLD[data]
    return np.where(x < 128, FOLD[np.minimum(x, 127)], x) if x.dtype == np.uint32 else x


def _folded() -> np.ndarray:
    table = np.arange(128, dtype=np.uint8)
    table[65:91] += 32
    table[48:58] = 48
    table[[9, 10, 11, 12, 13]] = 32
    return table


FOLD = _folded()


def grams(data: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> list[tuple[int, np.ndarray]]:
    """By order: the bucket of the n-gram that begins at each character of the text's bytes. An order's n-grams have hashes of their own."""
    x = characters(data).astype(np.uint32)
    out = []
    for n in orders:
        if len(x) < n:
            out.append((n, np.zeros(0, np.uint32)))
            continue
        h = np.full(len(x) - n + 1, n, np.uint32)
        for j in range(n):
            h *= np.uint32(0x01000193)
            h ^= x[j : len(x) - n + 1 + j]
        h *= np.uint32(0x9E3779B1)
        out.append((n, h >> np.uint32(32 - bits)))
    return out


class Features:
    """The distinct buckets of a text. Keeps a table in which each bucket holds the last place it was seen at."""

    def __init__(self, bits: int = BITS):
        self.bits, self.last = bits, np.zeros(1 << bits, np.int32)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        h = np.concatenate([h for _, h in grams(data, ORDERS, self.bits)])
        place = np.arange(len(h), dtype=np.int32)
        self.last[h] = place
        return h[self.last[h] == place]


def document_counts(labelled: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Of all labelled texts (body, label): how many of each class have each bucket, and how many there are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n, features = np.zeros((2, 1 << bits), np.int64), np.zeros(2, np.int64), Features(bits)
        for batch in batches:
            data, at = C.binaries(batch, "body")
            for i, y in enumerate(C.values(batch, "label")):
                have[y][features(data[at[i] : at[i + 1]])] += 1
                n[y] += 1
        for y in (0, 1):
            if n[y]:
                seen = np.flatnonzero(have[y])
                yield pa.RecordBatch.from_pydict({"label": pa.array([y] * (len(seen) + 1), pa.int32()), "bucket": pa.array(np.append(seen, -1), pa.int32()), "n": pa.array(np.append(have[y][seen], n[y]), pa.int64())})

    rows = labelled.mapInArrow(counted, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    table = rows.toArrow()  # two rows per bucket at most
    label, bucket, n = (np.asarray(table.column(x)) for x in ("label", "bucket", "n"))
    have, total = np.zeros((2, 1 << bits)), np.zeros(2)
    at = bucket >= 0
    have[label[at], bucket[at]] = n[at]
    total[label[~at]] = n[~at]
    return have, total


def log_count_ratios(have: np.ndarray, total: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """ln of the share of toxic texts that have a bucket over that of other texts.

    Each bucket counts ``smooth`` more texts, split as the classes are, so that a bucket of few texts stays near 0.
    """
    prior = smooth * total / max(total.sum(), 1)
    share = (have + prior[:, None]) / np.maximum(total, 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.log(share[1] / share[0])
    return np.where(np.isfinite(r), r, 0.0)


def fit(samples: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, epochs: int = 12, rate: float = 0.5, decay: float = 1e-4, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression by adaptive gradient steps on sparse features; returns a weight per bucket, ratio included, and the bias."""
    w, g2, bias, gb = np.zeros(len(ratios)), np.full(len(ratios), 1e-6), 0.0, 1e-6
    if len(set(labels.tolist())) < 2:  # one class only: nothing to tell apart
        return w, 4.0 if len(labels) and labels[0] else -4.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            at = samples[i]
            x = ratios[at]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x + bias, -30, 30)))
            e = p - labels[i]
            g = e * x + decay * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
            gb += e * e
            bias -= rate * e / np.sqrt(gb)
    return w * ratios, bias


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, float]:
    """Weights and bias from the texts of ``docs`` that ``labels`` marks 0 or 1.

    Ratios count every labelled text; the regression is fitted on about ``sample`` texts of each class, those
    whose ids hash below a bound. Rows without a label, and labels without a row, are not looked at; a document marked both
    ways counts as 1. Null ids have no label. Null texts count as empty; rows that repeat an id count each. Without
    any label every score is 0.5. Columns of any other names are not looked at.
    """
    C.small_batches(docs.sparkSession)
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("marked")).agg(F.max(label).cast("int").alias("label")).hint("merge")  # by shuffle at any size
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(key).alias("at"), C.body(text).alias("body"))
    labelled = C.staged(texts.join(marks, F.col("id") == F.col("marked")).select("at", "label", "body"), "toxicity-labelled")
    have, total = document_counts(labelled)
    if not total.sum():
        return np.zeros(1 << BITS, np.float32), 0.0
    ratios = log_count_ratios(have, total)
    ratios[np.abs(ratios) < LEAST_RATIO] = 0
    useful = ratios != 0

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            data, at = C.binaries(batch, "body")
            found = [features(data[at[i] : at[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_pydict({"buckets": pa.array([x[useful[x]].astype(np.int32).tobytes() for x in found], pa.binary())})

    samples, marked = [], []
    for y in (0, 1):
        share = F.shiftrightunsigned("at", 11) / F.lit(float(1 << 53))
        part = labelled.where((F.col("label") == y) & (share < sample / max(total[y], 1)))
        found = [np.frombuffer(x.as_buffer(), np.int32) for x in part.select("body").mapInArrow(sampled, "buckets binary").toArrow().column("buckets")]
        samples += found
        marked += [y] * len(found)
    C.unstage(labelled)
    weights, bias = fit(samples, np.asarray(marked), ratios)
    return weights.astype(np.float32), float(bias)


def score(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id and score, 0 to 1. Null and empty texts get the score of the bias alone.

    Texts of any length are read whole; rows that repeat are rows of their own and null ids stay null. Empty
    tables give no rows.
    """
    C.small_batches(docs.sparkSession)
    weights, bias = model

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            data, at = C.binaries(batch, "body")
            sums = [float(weights[features(data[at[i] : at[i + 1]])].sum(dtype=np.float64)) + bias for i in range(batch.num_rows)]
            out = 1 / (1 + np.exp(-np.clip(np.asarray(sums), -30, 30)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "score": pa.array(out)})

    return docs.select(F.col(key).cast("long").alias("doc_id"), C.body(text).alias("body")).mapInArrow(scored, "doc_id long, score double")


def keep_civil(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns and in one pass.

    Null and empty texts have the score of the bias alone and stay if that is below. Texts of any length are
    scored whole; rows that repeat stay or go alike. Columns may have any names. An empty table stays empty.
    """
    C.small_batches(docs.sparkSession)
    weights, bias = model
    at = docs.columns.index(text)

    def civil(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            data, ends = C.binaries(batch, batch.schema.names[at])
            sums = np.asarray([float(weights[features(data[a:b])].sum(dtype=np.float64)) + bias for a, b in zip(ends, ends[1:], strict=False)])
            fine = 1 / (1 + np.exp(-np.clip(sums, -30, 30))) < threshold
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(civil, docs.schema)
