"""The classifiers' queries recomputed one text, one position and one n-gram at a time; mixing and codes at their edges."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from swaylark.llm import huffman, langid, mixing, queries, toxicity

SF = "/root/testdata/sf0.001"


def bucket(gram: str) -> int:
    h = len(gram)
    for c in gram:
        h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
    return (h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - toxicity.BITS)


def buckets(text: str) -> set[int]:
    x = "".join("0" if c in "0123456789" else " " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").lower())
    return {bucket(x[i : i + n]) for n in toxicity.ORDERS for i in range(len(x) - n + 1)}


def test_features_are_of_characters():
    features = toxicity.Features()
    for text in ("", "abc", "Ünïcödé 12 語 TEXT\tİ", "plain ascii 99\n", "語" * 9):
        assert set(features(np.frombuffer(text.encode(), np.uint8)).tolist()) == buckets(text)


def test_toxicity_query_against_counts_by_hand(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    learned = [i for i in docs if not held[i] and marks.get(i) in (0, 1)]
    have, total = [Counter(), Counter()], [0, 0]
    for i in learned:
        total[marks[i]] += 1
        have[marks[i]].update(buckets(docs[i]))
    df, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train = df.where(~queries.held_out(3, 1))
    labelled = train.join(labels, "doc_id").select(F.col("toxic").cast("int").alias("label"), F.col("text").cast("binary").alias("body"))
    got, n = toxicity.document_counts(labelled)
    assert n.tolist() == total and all({int(b): int(got[y, b]) for b in np.flatnonzero(got[y])} == dict(have[y]) for y in (0, 1))
    ratios = toxicity.log_count_ratios(got, n)
    for b in list(have[1])[:500] + list(have[0])[:500]:
        share = [(have[y][b] + toxicity.SMOOTH * total[y] / sum(total)) / total[y] for y in (0, 1)]
        assert ratios[b] == pytest.approx(math.log(share[1] / share[0]))
    weights, bias = toxicity.train(train, labels)
    scores = {r["doc_id"]: r for r in queries.op10_toxicity(spark, SF).collect()}
    assert scores.keys() == docs.keys()
    for i, text in docs.items():
        want = 1 / (1 + math.exp(-min(30, max(-30, sum(float(weights[b]) for b in buckets(text)) + bias))))
        assert scores[i]["score"] == pytest.approx(want, abs=1e-6) and scores[i]["held_out"] == held[i] and scores[i]["predicted"] == int(scores[i]["score"] >= 0.7)


def test_language_query_against_position_by_position(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.fit(docs.where(~queries.held_out(4, 2)))
    got = {r["doc_id"]: r for r in queries.op6_language_id(spark, SF).collect()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h = net.recur.shape[1]

    def states(side, codes):
        state, out = np.zeros(h), []
        for c in codes:
            given, recur = net.table[side][c].astype(float), state @ net.recur[side].astype(float)
            z, r = sigmoid(given[:h] + recur[:h]), sigmoid(given[h : 2 * h] + recur[h : 2 * h])
            n = np.tanh(given[2 * h :] + r * recur[2 * h :])
            state = z * state + (1 - z) * n
            out.append(state)
        return out

    rows = [r for r in docs.collect() if got[r["doc_id"]]["held_out"]]
    assert len(rows) > 30
    for row in rows[:25]:
        data, sums = (row["text"] or "").encode(), np.zeros(len(net.languages))
        if not any(map(str.isalpha, row["text"] or "")):
            assert got[row["doc_id"]]["lang_pred"] == "und"
            continue
        for a in range(0, len(data), langid.WINDOW):
            codes = list(data[a : a + langid.WINDOW])
            whole = codes + [langid.PAD] * (langid.WINDOW - len(codes))
            for f, b in list(zip(states(0, whole), states(1, whole[::-1])[::-1], strict=True))[: len(codes)]:
                e = f @ net.out[0] + b @ net.out[1] + net.bias
                p = np.exp(e - e.max())
                sums += p / p.sum()
        mean = sums / len(data)
        assert got[row["doc_id"]]["lang_pred"] == net.languages[int(mean.argmax())] and got[row["doc_id"]]["score"] == pytest.approx(mean.max(), abs=2e-3)


def test_any_number_of_languages_is_learned(spark):
    rows = [(i, chr(97 + i % 26) * 3 + chr(97 + i // 26 % 26) * 3, f"l{i % 300:03d}") for i in range(600)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=5)
    assert len(net.languages) == 300


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["_source", "_draws", "_steps", "_u", "_count", "_copy", "_order", "_row", "_of", "_id", "_run", "copy_no", "order_key"]
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), *[F.concat(F.lit(n), F.col("id")).alias(n) for n in names])
    got = mixing.mix(df, with_order=True)
    assert got.columns == [*df.columns, "copy_no_", "order_key_"]
    assert all(r[n] == f"{n}{r['doc_id']}" for r in got.collect() for n in names) and mixing.mix(df).columns == df.columns


def test_mixing_of_copies_beyond_a_run(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    got = mixing.mix(df, weights={"a": 1.0}, size=5000.0, with_order=True)
    copies = sorted(r["copy_no"] for r in got.collect())
    assert copies == list(range(len(copies))) and 9000 < len(copies) < 11000


def test_codes_grow_with_the_vocabulary(monkeypatch):
    monkeypatch.setattr(huffman, "LONGEST", 3)
    counts = np.random.default_rng(1).integers(1, 50, 40)
    lengths = huffman.code_lengths(counts)
    assert (lengths > 0).all() and np.sum(2.0 ** -lengths.astype(float)) <= 1
    with pytest.raises(ValueError):
        huffman.code_lengths(counts, 3)
