"""Token alignment, piece encoding and clusters around centroids, against the libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from swaylark.llm import align_tokens, centroids, idtools, pieces, queries
from swaylark.llm import common as C
from swaylark.llm import simhash
from swaylark.llm.components import Sets

SF = "/root/testdata/sf0.001"
ODD = [
    (9001, None), (9002, ""), (9003, " "), (9004, "x▁y"), (9005, "<|endoftext|> a<|endoftext|>"), (9006, "a\n\n  b\t c\x1c\x1dd \x0b\x0ce​ f　g\x85h\xa0 i"),
    (9007, "梦\U0001f600 don't 123 456\r\n\r\n  x  "), (None, "null id"), (9001, "again"), (9008, "   \n"), (9009, "a" * 5000 + " b" * 3000), (9010, "<s> </s> <0x41> <unk>"), (9010, "<s> </s> <0x41> <unk>"), (9011, "\x00 é Ж"),
]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=pieces.model_path())


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.model_path())


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + ODD


def test_pieces_equal_the_library_on_made_up_strings(model, library):
    rng = random.Random(5)
    parts = ["a", "e", "t", "h", " ", " ", "▁", "\n", "  ", "é", "梦", "\U0001f600", "the", "ing", "1", "\x00", "<s>", "<0x41>", "∑", " " * 7]
    letters = [x for x in model.scores if len(x) == 1]
    for k in range(3000):
        text = "".join(rng.choice(letters if k % 3 == 0 else parts) for _ in range(rng.randint(0, 40)))
        ids, n = model.encode([text])
        assert ids.tolist() == library.encode(text), repr(text)
        assert model.decode(ids, n)[0].decode() == library.decode(ids.tolist())


def test_any_ids_decode_as_in_the_library(model, library):
    rng = random.Random(6)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3), rng.randrange(3, 259), 259, 28705]) for _ in range(rng.randint(0, 12))]
        assert model.decode(np.array(ids, np.int32), np.array([len(ids)]))[0].decode() == library.decode(ids), ids


def test_tokens_side_by_side_encode_as_themselves(model):
    model.tokens("▁a")
    rng, known = random.Random(7), list(model.steps)
    for _ in range(4000):
        a, b = rng.choice(known), rng.choice(known)
        if rng.random() < 0.5:  # two parts of one piece
            at = rng.randrange(1, len(a)) if len(a) > 1 else 1
            a, b = a[:at], a[at:] or b
            if a not in model.steps or b not in model.steps:
                continue
        assert model.side_by_side(a, b) == (model.merged(a + b)[0] == [a, b]), (a, b)


def test_results_do_not_depend_on_what_is_kept(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_PREFIXES", 40)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 30)
    small = pieces.PieceModel(pieces.model_path())
    small.kept = idtools.Kept(small.kept.encode, most=20)
    rng = random.Random(8)
    for _ in range(60):
        some = [" ".join("".join(rng.choice("etaoinsrhl") for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(0, 9))) for _ in range(8)]
        ids, n = small.encode(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == library.encode(some)


def test_piece_digests_query_against_the_library(spark, texts, library):
    def want(rows):
        for i, x in rows:
            ids = library.encode(x or "")
            yield i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"ids_sha256": F.lit(1), "n_tokens": F.lit(2)})
    assert sorted(map(tuple, pieces.digests(df).collect()), key=str) == sorted(want(texts), key=str)
    got = queries.queries()["op12_piece_digests"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want(texts[: -len(ODD)]))
    assert pieces.digests(df.limit(0)).count() == 0


def test_pieces_round_trip_as_tables(spark, texts):
    df = spark.createDataFrame([x for x in texts if x[1] and "▁" not in x[1]], "doc_id long, text string").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    back = pieces.decode(pieces.encode(df)).withColumnRenamed("text", "back")
    assert df.join(back, "doc_id").where("text = back").count() == df.count()


def brute_alignment(rows):
    a_side, b_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_side.encode_special_tokens = True
    back = {c: b for b, c in align_tokens.byte_characters().items()}

    def a_bytes(i):
        return bytes(back[c] for c in a_side.id_to_token(i))

    def b_bytes(i):
        x = b_side.id_to_piece(i)
        return bytes([int(x[3:5], 16)]) if b_side.is_byte(i) else x.replace("▁", " ").encode()

    def placed(ids, size):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(size(i)), i))
            at = out[-1][1]
        return out

    found, held = [], Counter()
    for key, text in rows:
        a, b, whole = a_side.encode(" " + (text or ""), add_special_tokens=False).ids, b_side.encode(text or ""), (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            found.append((key, [], [], [], []))
            continue
        left, right = placed(a, a_bytes), placed(b, b_bytes)
        groups, i, j = [], 0, 0
        for cut in sorted({x[1] for x in left} & {x[1] for x in right}):
            one, two = [x[2] for x in left[i:] if x[1] <= cut], [x[2] for x in right[j:] if x[1] <= cut]
            i, j = i + len(one), j + len(two)
            groups.append(",".join(map(str, one)) + "|" + ",".join(map(str, two)))
        links, first = [], 0
        for s, e, x in left:
            while right[first][1] <= s:
                first += 1
            k = first
            while k < len(right) and right[k][0] < e:
                links.append((x, right[k][2]))
                k += 1
        held.update(set(links))
        found.append((key, a, b, groups, links))
    best = Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    for key, a, b, groups, links in found:
        yield key, len(a), len(b), len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""


def test_alignment_against_brute_force(spark, texts):
    rows = texts[:60] + ODD[:10] + ODD[11:]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit(1), "n_a": F.lit("x")}).repartition(3)
    assert sorted(map(tuple, align_tokens.aligned_groups(df).collect()), key=str) == sorted(brute_alignment(rows), key=str)
    assert align_tokens.aligned_groups(df.limit(0)).count() == 0
    assert align_tokens.aligned_groups(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).where("n_a + n_b + n_groups + n_links = 0 AND groups_sha256 = ''").count() == 2


def test_alignment_in_many_blocks_and_spans(spark, texts, monkeypatch):
    rows = [x for x in texts if x[0] is not None][:12]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(align_tokens, "BLOCK", 2000)
    monkeypatch.setattr(align_tokens, "PART", 900)
    assert sorted(map(tuple, align_tokens.aligned_groups(df).collect())) == sorted(brute_alignment(rows))
    a, b = align_tokens.byte_model_of(public_tokenizers.path("byte_bpe_50k.json")), pieces.library_model_of(pieces.model_path())
    found = align_tokens._encoded([x for _, x in rows], a, b)
    whole = align_tokens._aligned(*found, a, b)
    monkeypatch.setattr(align_tokens, "SPAN", 7)
    parts = align_tokens._aligned(*found, a, b)
    for name in ("groups_a", "groups_b", "link_a", "link_b", "upto_groups", "upto_links"):
        assert (getattr(whole, name) == getattr(parts, name)).all()


def test_a_batch_is_aligned_in_parts_that_hold_little_memory(texts):
    a, b = align_tokens.byte_model_of(public_tokenizers.path("byte_bpe_50k.json")), pieces.library_model_of(pieces.model_path())
    long = " ".join(x for _, x in texts if x)
    batch = pa.record_batch({"text": [long[i : i + 5000] for i in range(0, len(long), 5000)] * (1 + (3 << 20) // len(long))})
    whole = C.values(batch, "text")
    want = align_tokens._encoded(whole, a, b)  # and no word is new any more
    held = Counter(dict(zip(*map(np.ndarray.tolist, align_tokens._aligned(*want, a, b).pairs()), strict=True)))
    got, found = [], Counter()
    tracemalloc.start()
    for i, j in C.blocks(batch, "text", align_tokens.PART):
        got.append(align_tokens._encoded(C.values(batch.slice(i, j - i), "text"), a, b))
        found.update(dict(zip(*map(np.ndarray.tolist, align_tokens._aligned(*got[-1], a, b).pairs()), strict=True)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [np.concatenate(x).tolist() for x in zip(*got, strict=True)] == [x.tolist() for x in want] and found == held
    assert most < 64 << 20, f"{most >> 20} MB at once"


def test_words_are_cut_where_the_byte_tokenizer_cuts():
    rng, path = random.Random(9), public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, own = Tokenizer.from_file(path), align_tokens.ByteModel(path)
    tokenizer.encode_special_tokens = True
    parts = ["a", "the", "don't", "'ll", "1", "23", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "​", " ", "　", " ", "﻿", ".", "é", "Å", "²", "梦", "<|endoftext|>", "_", "ª", "×"]
    for _ in range(3000):
        text = " " + "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert own.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def brute_clusters(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), x[1]))[:k]
    centres = [x[1] for x in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            members = [v for (_, v), c in zip(kept, own, strict=True) if c == j]
            if members:
                centres[j] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    out = [(i, *nearest(v)) for i, v in kept]
    sums = Counter()
    for _, d, j in out:
        sums[j] += d
    return [(i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in out]


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(10)
    near = rng.normal(size=(6, 64)) * 3
    rows = [(i, (near[i % 6] + rng.normal(size=64) * 0.05).tolist()) for i in range(250)] + [(1000 + i, near[0].tolist()) for i in range(60)]
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [1.0] * 65), (2003, [None] + [1.0] * 63), (2004, [float("nan")] + [1.0] * 63), (2005, [float("inf")] * 64), (3, near[1].tolist()), (3, near[1].tolist()), (None, near[2].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"key": F.lit(1), "cluster": F.lit("x"), "q": F.lit(0)}).repartition(5)
    got = sorted(map(tuple, centroids.cluster(df).collect()), key=str)
    assert got == sorted(brute_clusters(rows), key=str) and len(got) == 313
    assert centroids.cluster(df.limit(0)).count() == 0 and centroids.cluster(df.where("vec_id = 2000")).count() == 0
    few = [(i, [float(i)] * 64) for i in range(5)]
    assert sorted(map(tuple, centroids.cluster(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect())) == sorted(brute_clusters(few))


@pytest.mark.parametrize("seed", range(4))
def test_trees_settle_as_distances_do(seed):
    rng = np.random.default_rng(seed)
    size = [1, 3, 64, 64][seed]
    vectors = np.floor(rng.normal(size=(900, size)) * [40, 3, 60, 1 << 20][seed]).astype(np.int64)
    vectors[:200] = vectors[0]
    vectors[300:500] += 5000
    centres = np.concatenate([vectors[rng.choice(900, 11)], vectors[:1], vectors[:1]])
    tree = centroids.BallTree.of(vectors)
    want = np.stack([((vectors - c) ** 2).sum(1) for c in centres], 1)
    labels, away = tree.labels(centres)
    assert (labels == want.argmin(1)).all() and (away == want.min(1)).all()
    n, sums = tree.totals(centres)
    assert (n == np.bincount(labels, minlength=len(centres))).all() and all((sums[c] == vectors[labels == c].sum(0)).all() for c in range(len(centres)))
    balls = tree.settled(centres)[0]
    if size == 64:  # most copies share balls of their own; in few dimensions a ball may be as near to two centroids, and is then measured
        assert (tree.last - tree.first)[balls].sum() >= 100
    if size == 64 and seed == 2:
        far = np.array([[0] * 64, [10000] * 64])
        assert len(tree.settled(far)[2]) < 900


def test_line_dedup_keeps_the_lines_of_rows_that_share_or_lack_an_id(spark):
    from swaylark.llm import line_dedup

    shared = "passage one\npassage two\npassage three"
    rows = [(1, shared), (5, shared), (5, "unique x\nunique y\nunique z"), (None, "alpha one\nalpha two"), (None, "only a\nonly b\nonly c"), (7, "head\n" + shared + "\ntail"), (7, "head\n" + shared + "\ntail")]
    for pairs in (False, True):
        got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), pairs=pairs).collect()), key=str)
        assert {(5, "unique x\nunique y\nunique z"), (None, "alpha one\nalpha two"), (None, "only a\nonly b\nonly c"), (1, shared)} <= set(got) and len(got) == len(rows)
    assert got.count((7, "head\ntail")) == 2 and got.count((5, "")) == 1


def test_staged_tables_of_two_threads_stay_apart(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from swaylark.llm import common as C

    meet = Barrier(2)

    def run(k):
        with C.Scope(spark) as scope:
            one, two = C.staged(spark.range(k + 3), "one"), C.staged(spark.range(k + 5), "two")
            scope.keep(C.PATHS[two])
            meet.wait(60)
        meet.wait(60)
        return C.PATHS[one], two.count()

    with ThreadPoolExecutor(2) as pool:
        (gone_a, n_a), (gone_b, n_b) = pool.map(run, (0, 1))
    assert (n_a, n_b) == (5, 6)
    for path in (gone_a, gone_b):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_near_copies_are_regions_before_pairs_are_listed(spark):
    """Pairs that come out grow with the members of a group of near copies, not with its square, and each is told of once a partition."""
    told = {}
    for n in (200, 800):
        rng = np.random.default_rng(n)
        flips = (np.uint64(1) << rng.integers(0, 64, (n, 4)).astype(np.uint64)) * (rng.random((n, 4)) < 0.7)
        one = np.uint64(0x0F1E2D3C4B5A6978) ^ np.bitwise_xor.reduce(flips.astype(np.uint64), axis=1)
        fps = np.unique(np.concatenate([one, rng.integers(0, 1 << 63, 300).astype(np.uint64)])).view(np.int64)
        nodes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fps)], "node long, fp0 long")
        plain = nodes.withColumnRenamed("fp0", "fp")
        groups = simhash.cut(plain)
        links = simhash.crowds(nodes, ["fp0"], [groups[0]], 11).collect()
        assert links and len(links) <= 4 * len(fps)
        sets = Sets()
        for u, v in links:
            sets.join(u, v)
        region = {i: sets.find(i) for i in range(len(fps))}
        placed = nodes.withColumnRenamed("fp0", "fp").join(spark.createDataFrame(list(region.items()), "node long, region long"), "node")
        got = simhash.candidates(placed, 11, groups=groups).collect()
        told[n] = len(links) + len(got)
        for u, v, _ in got:
            sets.join(u, v)
        close = [(i, j) for i in range(len(fps)) for j in range(i) if ((int(fps[i]) ^ int(fps[j])) & (1 << 64) - 1).bit_count() <= 11]
        assert all(sets.find(i) == sets.find(j) for i, j in close)  # no link is lost
    assert told[800] < 5 * told[200]


def test_two_balls_have_one_middle():
    rng = np.random.default_rng(4)
    one, two = rng.integers(0, 1 << 16, 4000), rng.integers(0, 1 << 16, 4000)
    two = np.where(rng.random(4000) < 0.9, one ^ (1 << rng.integers(0, 16, 4000)) ^ (1 << rng.integers(0, 16, 4000)) ^ (1 << rng.integers(0, 16, 4000)), two)
    r, s = rng.integers(0, 3, 4000), rng.integers(0, 3, 4000)
    middle = simhash._middle(one, two, r)
    inside = (np.bitwise_count(middle ^ one) <= r) & (np.bitwise_count(middle ^ two) <= s)
    assert (inside == (np.bitwise_count(one ^ two) <= r + s)).all()
