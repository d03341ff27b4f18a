"""The text operators against brute force, round trips and held-out rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from swaylark.llm import chat, components, decontaminate, exact_dedup, huffman, langid, line_dedup, mixing, queries, simhash, suffix_dedup, tokens, toxicity

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
#: Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash with ours.
ROWS = [
    (1, "Hello there WORLD again", "en", "a", 5, "x"), (2, "hello there world again", "en", "a", 5, None), (3, None, None, None, None, "y"), (4, "", "en", "b", 0, "z"), (5, LONG, "en", "b", 9, "z"), (6, LONG, "en", None, 9, "z"),
    (7, "un deux trois quatre cinq\nsix sept huit neuf dix", "fr", "a", 1, "k"), (7, "un deux trois quatre cinq\nsix sept huit neuf dix", "fr", "a", 1, "k"), (None, "null id", "en", "a", 1, "k"), (8, " \t\n", "en", "a", 3, "k"), (9, "éàü ÉÀÜ 日本 İ", "xx", "c", 3, "k"),
]
NAMES = ["keep", "place", "fp", "sha", "u", "v", "n", "body", "steps", "doc", "id", "label", "_body", "_gone", "_key", "marked", "at", "key", "unit", "root", "node", "_sha", "_doc"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    for name in NAMES:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_sql_agrees(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SF)
        columns = sorted(got.columns)
        want = con.sql(sql)
        text = ", ".join(f'"{c}"' for c in columns)
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(con.sql(f"SELECT {text} FROM want").fetchall()), name


# 1


def brute_exact(rows):
    best: dict = {}
    for r in rows:
        best.setdefault((r[1] or "").encode().lower(), []).append(r[0])
    return best


@pytest.mark.parametrize("options", [{}, {"bits": 3, "capacity": 50}])
def test_exact_groups(odd, options):
    best = brute_exact(ROWS)
    got = exact_dedup.exact_groups(odd, **options).collect()
    assert len(got) == len(ROWS)
    for r in got:
        texts = [t for t, ids in best.items() if r["doc_id"] in ids and hashlib.sha256(t).hexdigest() == r["text_sha256"]]
        ids = best[texts[0]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None) and r["kept"] == (r["keep_id"] == r["doc_id"])


def test_exact_dedup_and_empty(odd):
    assert {r["doc_id"] for r in exact_dedup.exact_dedup(odd).collect()} == {2, 4, 6, 7, 8, 9, None}
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0


def test_directory_doubles_and_covers():
    load = np.random.default_rng(0).integers(0, 100, 256)
    load[7] = 5000  # one prefix that cannot be split
    d = exact_dedup.Directory(load, 400).grow()
    assert len(d.slots) == 1 << d.depth and d.depth == 8 and set(d.slots) == set(range(len(d.local)))
    for b in range(len(d.local)):
        assert d.size(b) <= 400 or d.local[b] == 8
    assert sum(d.size(b) for b in range(len(d.local))) == load.sum()
    assert all(d.bucket(p << 56) == d.slots[p] for p in range(256))


def test_colliding_addresses_of_different_texts_stay_apart(spark):
    df = spark.createDataFrame([(k, f"text {k // 2}") for k in range(40)], "doc_id long, text string")
    got = exact_dedup.exact_groups(df, bits=1).collect()
    assert all(r["keep_id"] == r["doc_id"] // 2 * 2 + 1 and r["group_size"] == 2 for r in got)


# 2


def brute_suffix(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), suffix_dedup.spans(gone), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "options"), [(0, {}), (1, {"unit": 90}), (2, {"most": 1}), (3, {"most": 2, "unit": 150, "bucket": 40})])
def test_suffix_dedup_against_brute_force(spark, seed, options):
    rng = np.random.default_rng(seed)
    shared = ["".join(rng.choice(list("abcd é"), n)) for n in (25, 60, 200)]
    texts = []
    for _ in range(60):
        parts = ["".join(rng.choice(list("abcdefgh ijklé"), rng.integers(0, 80))), shared[rng.integers(3)] if rng.random() < 0.5 else "", "ab" * int(rng.integers(0, 40))]
        texts.append("".join(parts))
    texts += [texts[0], texts[0], "", "x" * 20, "x" * 19, "z" * 300, None]
    ids = [None if i % 17 == 3 else i // 3 for i in range(len(texts))]  # ids repeat and are null
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = suffix_dedup.suffix_dedup(df, length=20, **options).collect()
    want = [(i, *x) for i, x in zip(ids, brute_suffix([(t or "").encode() for t in texts], 20), strict=True)]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 2])
def test_suffix_dedup_of_crowded_edges(spark, most):
    rng = np.random.default_rng(20)
    word = lambda n: "".join(rng.choice(list("abcdefghij klmnop"), n))
    passages = [word(n) for n in (120, 260)]
    texts = [word(rng.integers(0, 90)) + passages[i % 2][rng.integers(0, 9) * (i % 3 == 0) :] + word(rng.integers(0, 90)) for i in range(80)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=100, most=most, unit=1000).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == brute_suffix([t.encode() for t in texts], 100)


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(1 << n))


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 2])
def test_suffix_dedup_compares_bytes(spark, most):
    rng = np.random.default_rng(21)
    one, two = ("x" * 100 + thue_morse(7, *pair) + "x" * 44 for pair in (("Ko", "qQ"), ("qQ", "Ko")))
    word = lambda: "".join(rng.choice(list("abcdefghij"), 60))
    texts = ["1" + one + "q", "2" + two + "w"] + [word() + (one, two)[i % 2][1:399] + word() for i in range(12)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most=most).orderBy("doc_id").collect()
    want = brute_suffix([t.encode() for t in texts], 400)
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == want and all(x[1] == 0 for x in want[:2])


def test_suffix_dedup_of_odd_rows(odd):
    got = suffix_dedup.suffix_dedup(odd).collect()
    want = brute_suffix([(r[1] or "").encode() for r in ROWS], 400)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((r[0], *x) for r, x in zip(ROWS, want, strict=True)), key=key)
    assert suffix_dedup.suffix_dedup(odd.limit(0)).count() == 0
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.suffix_dedup(odd.where("doc_id in (1, 5, 6)"), with_text=True).collect()}
    assert kept[5] == b"" and kept[1] == ROWS[0][1].encode()


def test_suffix_dedup_query_against_brute_force(spark, docs):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    got = {r["doc_id"]: tuple(r)[1:5] for r in queries.queries()["op2_suffix_dedup"](spark, SF).collect()}
    assert got == {i: x for (i, _), x in zip(rows, brute_suffix([t for _, t in rows], 400), strict=True)}


def test_multikey_sort():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (300, 20)).astype(np.uint8)
    rows[100:200, :15] = rows[:100, :15]
    rows[200:250] = rows[50:100]
    order, common = suffix_dedup.multikey_sort(suffix_dedup.tokens(rows))
    sorted_rows = [rows[i].tobytes() for i in order]
    assert sorted_rows == sorted(r.tobytes() for r in rows)
    for a, b, n in zip(sorted_rows, sorted_rows[1:], common[1:], strict=False):
        want = next((k for k in range(20) if a[k] != b[k]), 24)
        assert n == want


# 3


def slow_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_distance_against_dynamic_programming():
    rng = np.random.default_rng(2)
    for _ in range(100):
        item, text = ("".join(rng.choice(list("abc"), n)) for n in (rng.integers(1, 90), rng.integers(0, 150)))
        assert decontaminate.least_distance(decontaminate.masks(item), len(item), text)[0] == min(slow_distance(item, text), len(item))


def test_matcher_against_brute_force():
    rng = np.random.default_rng(3)
    items = [(k, "".join(rng.choice(list("abcde "), 60)).strip()) for k in range(6)]
    m = decontaminate.Matcher(items, 0.1)
    for _ in range(60):
        x = list(items[rng.integers(6)][1])
        for _ in range(rng.integers(0, 9)):
            at = rng.integers(0, len(x))
            x[at : at + rng.integers(0, 2)] = rng.choice(list("abcde "), rng.integers(0, 2))
        text = decontaminate.normal("".join(rng.choice(list("abcde "), 40)) + "".join(x) + "".join(rng.choice(list("abcde "), 40)))
        want = {(i, slow_distance(y, text)) for i, y in items if slow_distance(y, text) <= int(len(y) * 0.1)}
        assert {(i, d) for i, d, _ in m.find(text)} == want


def test_decontamination_query_against_every_item_in_every_text(spark, docs):
    items = [(r["item_id"], decontaminate.normal(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    masks = {i: decontaminate.masks(x) for i, x in items}
    want = {}
    for r in docs.where("length(text) < 6000").collect():  # longer ones take the slow way too long
        text = decontaminate.normal(r["text"])
        for i, x in items:
            d = 0 if x in text else decontaminate.least_distance(masks[i], len(x), text)[0]
            if d <= int(len(x) * decontaminate.ERROR_RATE):
                want[r["doc_id"], i] = d
    short = {r["doc_id"] for r in docs.where("length(text) < 6000").collect()}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in queries.queries()["op3_decontamination"](spark, SF).collect()}
    assert want and {k: d for k, d in got.items() if k[0] in short} == want


def test_decontamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "HELLO   there world"), (2, None), (3, ""), (4, "hello there world")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(odd, bench).collect()}
    assert got == {(1, 1), (2, 1), (1, 4), (2, 4)}
    assert decontaminate.matches(odd, bench.limit(0)).count() == 0 and decontaminate.matches(odd.limit(0), bench).count() == 0
    clean = decontaminate.keep_clean(odd, bench)
    assert clean.columns == odd.columns and clean.count() == len(ROWS) - 2


# 4


def brute_links(fps, distance):
    root = {f: f for f in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def planted_prints(n=300):
    rng = np.random.default_rng(4)
    out = set()
    for _ in range(n // 6):
        f = int(rng.integers(0, 1 << 63))
        out.add(f)
        for _ in range(5):
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                f ^= 1 << int(b)
            out.add(f)
    return sorted(out)


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize(("distance", "parts"), [(0, None), (1, None), (2, None), (5, None), (2, 3)])
def test_links_are_complete(spark, distance, parts):
    fps = planted_prints()
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {(r["u"], r["v"]) for r in simhash.links(df, distance, parts).collect()}
    want = {(min(signed(a), signed(b)), max(signed(a), signed(b))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= distance}
    assert {(min(p), max(p)) for p in got} == want


@pytest.mark.parametrize("most", [simhash.MOST, 40])
def test_candidates_are_all_pairs_of_different_regions(spark, most):
    fps = planted_prints()
    df = spark.createDataFrame([(signed(f), k, k // 7) for k, f in enumerate(fps)], "fp long, node long, region long")
    got = [tuple(r) for r in simhash.candidates(df, 11, most=most, dense=1000).collect()]
    want = {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 11 and i // 7 != j // 7}
    assert len(got) == len(want) and {x[:2] for x in got} == want and not any(x[2] for x in got)


def test_candidates_of_crowds_are_pairs_or_in_one_region(spark):
    rng = np.random.default_rng(22)
    base = int(rng.integers(0, 1 << 63))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, 6, replace=False)) for _ in range(900)} | set(planted_prints()))
    df = spark.createDataFrame([(signed(f), k) for k, f in enumerate(fps)], "fp long, node long")
    got = simhash.candidates(df, 11).collect()
    region = simhash.Sets()
    for r in got:
        if r["crowd"]:
            region.join(r["u"], r["v"])
    pairs = {(r["u"], r["v"]) for r in got if not r["crowd"]}
    want = {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 11}
    assert len(want) > 50_000 and len(got) < 30_000
    assert all((i, j) in pairs or region.find(i) == region.find(j) for i, j in want)


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_links_within_a_region_connect_what_is_similar(most, monkeypatch):
    rng = np.random.default_rng(23)
    monkeypatch.setattr(simhash.Compared.__init__, "__defaults__", (most,))
    base = rng.integers(0, 1 << 60, 100).astype(np.uint64)
    sets = []
    for _ in range(120):
        x = base.copy()
        x[rng.choice(100, rng.integers(0, 25), replace=False)] = rng.integers(0, 1 << 60, 1)[0]
        sets.append(np.unique(x))
    like = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    fps = np.zeros((120, 4), np.uint64)
    for first in (np.ones(120, bool), np.arange(120) < 50):
        want, got = simhash.Sets(), simhash.Sets()
        for a in range(120):
            for b in range(a):
                if (first.all() or first[a] != first[b]) and like(a, b):
                    want.join(a, b)
        found = simhash.linked(sets, fps, first, 11, 0.8)
        assert len(found) < 120 and all(like(a, b) for a, b in found)
        for a, b in found:
            got.join(a, b)
        groups = lambda x: {frozenset(i for i in range(120) if x.find(i) == x.find(j)) for j in range(120)}
        assert groups(got) == groups(want)


def test_near_dedup_of_a_crowd_around_a_template(spark, monkeypatch):
    monkeypatch.setattr(simhash.region_links, "__defaults__", (60, 1 << 16))
    rng = np.random.default_rng(24)
    base = [f"w{x}" for x in rng.integers(0, 1 << 30, 150)]
    rows = []
    for g in range(500):
        text = list(base)
        for at in rng.choice(30, rng.integers(1, 8), replace=False):
            text[int(at) * 5] = f"own{g}x{at}"
        rows.append(" ".join(text))
    sets = [set(simhash.shingle_hashes(x.encode(), 5)) for x in rows]
    want = simhash.Sets()
    for i in range(500):
        for j in range(i):
            if want.find(i) != want.find(j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                want.join(*sorted((want.find(i), want.find(j))))
    left = {want.find(i) for i in range(500)}
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert 5 < len(left) < 480 and left <= kept and len(kept) <= len(left) + 5


def test_near_dedup_finds_pairs_little_over_its_similarity(spark):
    rng, rows = np.random.default_rng(9), []
    for g in range(200):
        base = [f"w{x}" for x in rng.integers(0, 1 << 30, 300)]
        copy = list(base)
        for at in range(10, 300, 50):
            copy[at] = f"copy{g}{at}"
        rows += [" ".join(base), " ".join(copy)]
    sets = [set(simhash.shingle_hashes(x.encode(), 5)) for x in rows]
    assert all(0.8 <= len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 0.82 for i in range(0, 400, 2))
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert set(range(0, 400, 2)) <= kept and sum(i + 1 not in kept for i in range(0, 400, 2)) >= 196


def test_near_dedup_stage_against_all_similar_pairs(spark, docs):
    import corpus_pipeline as P

    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5)) for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    assert {r["doc_id"] for r in P.near_duplicates_out(spark, docs, SF).collect()} == set(root.values())


def test_near_dedup_keeps_clean_documents_that_share_a_filler(spark):
    rows = ["0 " * 200 + " ".join(f"word{g}x{k}" for k in range(60)) for g in range(20)]
    assert len({simhash.fingerprint(simhash.shingle_hashes(x.encode(), 5)) for x in rows}) == 1
    rows += [rows[3] + " more", rows[3].upper(), rows[5].replace("0 ", "0  ")]
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert kept == set(range(20))


def test_near_dedup_links_past_a_nearer_template(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(40):
        base = [f"w{x}" for x in rng.integers(0, 1 << 30, 300)]
        one, two = list(base), list(base)
        for at in range(3, 300, 38):
            one[at] = two[at] = f"own{g}{at}"
        for at in range(8, 300, 100):
            two[at] = f"two{g}{at}"
        rows += [" ".join(x) for x in (base, one, two)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = [set(simhash.shingle_hashes(x.encode(), 5)) for x in rows]
    fps = [simhash.fingerprint(simhash.shingle_hashes(x.encode(), 5)) for x in rows]
    like = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    kept = {r["doc_id"] for r in simhash.near_dedup(df).collect()}
    for g in range(0, 120, 3):
        assert not like(g, g + 1) and like(g + 1, g + 2) and g in kept
        assert (fps[g + 1] ^ fps[g + 2]).bit_count() > 11 or g + 2 not in kept


def test_thresholds_sum_to_what_the_principle_asks():
    costs = np.random.default_rng(5).uniform(0, 10, (4, 4, 50))
    costs[:, 0] = 0
    t = simhash.allocate(costs)
    assert ((t + 1).sum(0) == 3).all()
    for q in range(50):
        best = min(sum(costs[i, s, q] for i, s in enumerate(x)) for x in np.ndindex(4, 4, 4, 4) if sum(x) == 3)
        assert sum(costs[i, t[i, q] + 1, q] for i in range(4)) == pytest.approx(best)


def test_near_groups_query_against_all_pairs(spark, docs):
    import re

    import xxhash

    prints = {}
    for r in docs.collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (r["text"] or "").encode()))
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
        hashes = [xxhash.xxh64(x, seed=42).intdigest() for x in shingles]
        prints[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = brute_links(sorted(set(prints.values())), 2)
    least: dict = {}
    for i, f in prints.items():
        least[root[f]] = min(i, least.get(root[f], i))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.queries()["op4_simhash"](spark, SF).collect()}
    assert got == {i: (f"{f:016x}", least[root[f]]) for i, f in prints.items()}


def test_near_groups_of_odd_rows(odd):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_groups(odd).collect()]
    by = {i: (f, c) for i, f, c in got}
    assert len(got) == len(ROWS) and by[1] == by[2] and by[3] == by[4] == by[8] == ("0" * 16, 3) and by[5][1] == 5 == by[6][1]
    assert simhash.near_groups(odd.limit(0)).count() == 0


def test_fingerprint_of_one_shingle_is_its_hash():
    import xxhash

    assert simhash.fingerprint(simhash.shingle_hashes(b"One  two\nTHREE")) == xxhash.xxh64_intdigest(b"one two three", 42)


def test_near_dedup_of_odd_rows(odd):
    got = simhash.near_dedup(odd)
    ids = Counter(r["doc_id"] for r in got.collect())
    assert got.columns == odd.columns and ids == Counter({1: 1, 3: 1, 5: 1, 7: 2, 9: 1, None: 1})
    assert simhash.near_dedup(odd.limit(0)).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)]
    rows, k = [], 0
    for g in range(25):
        base = [str(x) for x in rng.choice(words, 300)]
        for copy in range(4):
            text = list(base)
            for at in rng.choice(300, copy, replace=False):
                text[at] = "changed"
            rows.append((k, " ".join(text), g))
            k += 1
    rows += [(k + j, " ".join(str(x) for x in rng.choice(words, 300)), 100 + j) for j in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grp int")
    kept = simhash.near_dedup(df).collect()
    by = Counter(r["grp"] for r in kept)
    assert set(by) == {g for _, _, g in rows} and all(by[100 + j] == 1 for j in range(40)) and sum(by[g] for g in range(25)) <= 27
    assert simhash.near_dedup(df.limit(0)).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(5, 5), (None, 1)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(e).collect()}
    assert got == {i: i // 10 * 10 for i in range(40)}
    assert components.components(e.limit(0)).count() == 0


# 5


def brute_chats(rows):
    convs: dict = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    seqs = {c: tuple(y[2:] for y in sorted(v)) for c, v in convs.items()}
    out = {}
    for c, s in seqs.items():
        if any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            continue
        alike = [d for d, o in seqs.items() if o == s]
        out[min(alike)] = (len(s), len(alike))
    return out


def test_chats_against_brute_force(spark):
    rng = np.random.default_rng(7)
    base = [[("user" if j % 2 == 0 else "assistant", f"t{rng.integers(3)}") for j in range(12)] for _ in range(4)]
    rows = [(c, t, *x) for c in range(60) for b in [base[rng.integers(4)]] for t, x in enumerate(b[: rng.integers(1, 13)])]
    rows += [(99, None, None, None), (99, None, None, None), (98, 0, "user", ""), (97, 0, "user", None)]
    rows += [(96, t, "user", f"long {t}") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).repartition(7)
    got = chat.format_chats(df).collect()
    assert {r["conv_id"]: (r["n_turns"], r["n_alike"]) for r in got} == brute_chats(rows)
    long = sorted((r["part_no"], r["chat"]) for r in got if r["conv_id"] == 96)
    assert "".join(x for _, x in long) == "".join(f"<|user|>\nlong {t}<|end|>\n" for t in range(300)) and len(long) == 5
    assert chat.format_chats(df.limit(0)).count() == 0


# 6


def test_gradients_by_differences():
    rng = np.random.default_rng(8)
    net = langid.new_network(["a", "b", "c"], 3)
    net.table, net.recur, net.out = (x.astype(float) for x in (net.table, net.recur, net.out))
    x, y = rng.integers(0, 256, (6, 4)), rng.integers(0, 3, 4)
    x[4:, 1] = langid.PAD
    _, grads = langid.gradients(net, x, y)
    for w, g in zip(net.weights, grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was = w[at]
        ends = []
        for e in (1e-3, -1e-3):
            w[at] = was + e
            ends.append(langid.gradients(net, x, y)[0])
        w[at] = was
        assert g[at] == pytest.approx((ends[0] - ends[1]) / 2e-3, rel=1e-3)


def test_reader_agrees_with_the_network():
    rng = np.random.default_rng(9)
    net = langid.new_network(["a", "b"], 4)
    x = rng.integers(0, 256, (langid.WINDOW, 5))
    x[40:, 2] = langid.PAD
    p = langid.probabilities(net, langid.forward(net, x))
    logits = langid.Reader(net).logits(x)
    q = np.exp(logits - logits.max(1, keepdims=True))
    assert np.abs(p - (q / q.sum(1, keepdims=True)).transpose(0, 2, 1)).max() < 1e-4


def test_language_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_language_id(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.9 and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()


def test_most_frequent_languages_are_learned(odd):
    net = langid.fit(odd, sample=50, most=2)
    assert net.languages == ["en", "fr"]
    assert {r["lang_pred"] for r in langid.predict(odd, net).collect()} <= {"en", "fr", "und"}


def test_rows_without_an_id_are_held_out(odd):
    got = odd.where("doc_id is null").select(queries.held_out(4, 2).alias("a"), queries.held_out(3, 1).alias("b")).first()
    assert got["a"] and got["b"]


def test_language_of_odd_rows(odd):
    net = langid.fit(odd, sample=50)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd, net).collect()}
    assert got[3] == got[4] == got[8] == "und" and got[9] != "und"
    assert langid.fit(odd.limit(0)) is None and {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}


# 7


@pytest.mark.parametrize("seed", range(4))
def test_huffman_round_trip(seed):
    rng = np.random.default_rng(seed)
    ids = (rng.zipf(1.2, 20_000) % 3000).astype(np.uint32) if seed else np.full(77, 5, np.uint32)
    counts = np.bincount(ids, minlength=3000)
    lengths = huffman.code_lengths(counts, 12)
    assert lengths.max() <= 12 and sum(2.0 ** -int(x) for x in lengths[lengths > 0]) <= 1
    codes = huffman.canonical(lengths)
    bits, checkpoints = huffman.encode(ids, lengths, codes)
    table, width = huffman.decoding_table(lengths, codes)
    assert (huffman.decode(bits, checkpoints, len(ids), table, width) == ids).all()


def test_unlimited_lengths_are_huffman_optimal():
    import heapq

    counts = np.random.default_rng(10).integers(1, 1000, 60)
    heap, total = list(map(int, counts)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    assert int((huffman.code_lengths(counts) * counts).sum()) == total


def test_token_files_against_the_tokenizer(spark, odd):
    from tokenizers import Tokenizer

    extra = spark.createDataFrame([(20, "It's 3.5kg, l'été <|endoftext|> don't!! é naïve...?! ÆØß × foo_bar"), (21, "ÀÉ,;:!? x.y A.B. İstanbul")], "doc_id long, text string")
    df = odd.select("doc_id", "text").unionByName(extra)
    got = sorted(tokens.token_files(df).collect(), key=lambda r: (r["start"]))
    t = Tokenizer.from_file(tokens.tokenizer_path())
    rows = sorted([(r["doc_id"], r["text"] or "") for r in df.collect()], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start = 0
    for (i, x), r in zip(rows, got, strict=True):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokens.token_files(df.limit(0)).count() == 0


def test_words_part_where_the_tokenizer_parts():
    from tokenizers import Tokenizer

    odd = [*map(chr, range(0xA1)), "\u1680", "\u180e", *map(chr, range(0x2000, 0x2010)), "\u2028", "\u2029", "\u202f", "\u205f", "\u2060", "\u3000", "\ufeff"]
    texts = [x for c in odd for x in (f"a{c}b", c, f"{c}\x1d", f"one {c} two", f"Ab,{c}{c}é.")] + ["".join(odd)]
    t = Tokenizer.from_file(tokens.tokenizer_path())
    flat, sizes = tokens.PieceEncoder(tokens.tokenizer_path(), 1)(texts)
    ends = np.cumsum(sizes)
    for x, end, n in zip(texts, ends, sizes, strict=True):
        assert flat[end - n : end].tolist() == [*t.encode(x, add_special_tokens=False).ids, 1], repr(x)


def test_pieces_after_forgetting(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "KEPT_PIECES", 50)
    rng = np.random.default_rng(14)
    kinds = ["It's", "don't", "'sun", "l'\u00e9t\u00e9", "3.14", "\u00df\u00d8", "a\u0301", "\u4e2d\u6587", "<|endoftext|>", "...'ll", "x\x00y", "\u00aa1\u00b2", "\u0130", "tab\tx", "WE'RE", "\u00d7\u00f7"]
    texts = [" ".join(str(x) for x in rng.choice([*kinds, *("".join(rng.choice(list("abCDé'. "), 6)) for _ in range(20))], 12)) for _ in range(150)]
    t, encoder = Tokenizer.from_file(tokens.tokenizer_path()), tokens.PieceEncoder(tokens.tokenizer_path(), 1)
    for a in range(0, 150, 10):
        flat, sizes = encoder(texts[a : a + 10])
        ends = np.cumsum(sizes)
        for x, end, n in zip(texts[a : a + 10], ends, sizes, strict=True):
            assert flat[end - n : end].tolist() == [*t.encode(x, add_special_tokens=False).ids, 1], repr(x)
    assert len(encoder.places) < 2000


def test_new_pieces_go_to_the_tokenizer_in_runs(monkeypatch):
    from tokenizers import Tokenizer

    class Counting:
        def __init__(self, inner):
            self.inner, self.given = inner, 0

        def encode_batch_fast(self, texts, **options):
            self.given += len(texts)
            return self.inner.encode_batch_fast(texts, **options)

    rng = np.random.default_rng(15)
    kinds = ["'s", "'t", "'re", "'v", "'ll", "''", "\x00", "\x00\x00", "\x1c", "\t", " ", "\n", "7", "\u00df", "\u00c9t", "a" * 15, "a" * 16, "-" * 40, "x", "Y", ".", "</w>"]
    texts = ["", *("".join(rng.choice(kinds, rng.integers(1, 12))) for _ in range(3000))]
    t, encoder = Tokenizer.from_file(tokens.tokenizer_path()), tokens.PieceEncoder(tokens.tokenizer_path(), 1)
    encoder.bare = Counting(encoder.bare)
    for side in (tokens.SIDE, 7):  # met for the first time, and known
        monkeypatch.setattr(tokens, "SIDE", side)
        flat, sizes = encoder(texts)
        ends = np.cumsum(sizes)
        for x, end, n in zip(texts, ends, sizes, strict=True):
            assert flat[end - n : end].tolist() == [*t.encode(x, add_special_tokens=False).ids, 1], repr(x)
    assert encoder.known > 400 and encoder.bare.given < encoder.known / 20


def test_piece_table_tells_keys_of_one_slot_apart(monkeypatch):
    monkeypatch.setattr(tokens, "MIX", np.zeros(2, np.uint64))  # every key starts at slot 0
    table = tokens.PieceTable()
    keys = np.stack([np.arange(300, dtype=np.uint64) // np.uint64(7), np.arange(300, dtype=np.uint64) % np.uint64(7)])
    table.add(keys[:, :100], np.arange(100))
    table.add(keys[:, 100:200], np.arange(100, 200))
    assert table.find(keys).tolist() == [*range(200), *[-1] * 100]
    stays = np.arange(200) % 3 == 0
    left = table.kept(stays, np.cumsum(stays) - 1)
    assert left.find(keys).tolist() == [i // 3 if i < 200 and i % 3 == 0 else -1 for i in range(300)]


# 8


def brute_lines(rows):
    seen, out = {}, {}
    for i, x in sorted(rows):
        text, kept, removed = x.encode(), [], 0
        for a, b, n in line_dedup.chunks(text):
            c = text[a:b].removesuffix(b"\n")
            if n >= 2 and c in seen:
                removed += n
                continue
            if n >= 2:
                seen[c] = i
            kept.append(text[a:b])
        out[i] = removed
    return out


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(11)
    lines = [f"line {k} of them" for k in range(60)]
    rows = [(i, "\n".join(str(x) for x in [*rng.choice(lines, rng.integers(0, 8)), *lines[10:30], *rng.choice(lines, rng.integers(0, 8))])) for i in range(40)]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["n_removed"] for i, r in got.items()} == brute_lines(rows) and sum(r["n_removed"] for r in got.values()) > 300
    assert all(r["text"].count("\n") + 1 == r["n_lines"] - r["n_removed"] for r in got.values() if r["text"])


def test_chunks_join_to_the_text_and_follow_content():
    rng = np.random.default_rng(12)
    text = "\n".join("".join(rng.choice(list("abc"), 9)) for _ in range(200)).encode()
    cut = line_dedup.chunks(text)
    assert b"".join(text[a:b] for a, b, _ in cut) == text
    moved = b"new first line\n" + text
    again = {moved[a:b] for a, b, _ in line_dedup.chunks(moved)}
    assert len({text[a:b] for a, b, _ in cut} & again) >= len({text[a:b] for a, b, _ in cut}) - 2


def brute_pairs(rows):
    """Lines that stay, by id, when all but the first of each two adjacent lines go; of equal lines in a row two stay."""
    seen, out = set(), {}
    for i, x in sorted(rows):
        lines = x.split("\n")
        gone, later = set(), set()
        for k in range(len(lines) - 1):
            pair = tuple(lines[k : k + 2])
            if pair in seen:
                later.add(k)
                gone |= {k + 1} if k and k - 1 not in later and lines[k - 1] == lines[k] == lines[k + 1] else {k, k + 1}
            seen.add(pair)
        out[i] = [y for k, y in enumerate(lines) if k not in gone]
    return out


def test_repeated_runs_of_lines_go_whole(spark):
    rng = np.random.default_rng(13)
    runs = [[f"run {r} line {k} {rng.integers(1 << 30)}" for k in range(r % 6 + 2)] for r in range(30)]
    rows = []
    for i in range(80):
        parts = [[f"own {i} {k}"] + runs[rng.integers(30)] for k in range(3)]
        rows.append((i, "\n".join(str(x) for p in parts for x in p) + "\nsame" * (i % 5)))
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), pairs=True).collect()}
    want = brute_pairs(rows)
    assert {i: r["text"] for i, r in got.items()} == {i: "\n".join(x) for i, x in want.items()}
    assert all(r["n_lines"] - r["n_removed"] == len(want[i]) for i, r in got.items())
    left = Counter(x for r in got.values() for x in r["text"].split("\n"))
    assert all(left[x] == 1 for r in runs for x in r if x in "\n".join(t for _, t in rows).split("\n"))


def test_line_dedup_query_leaves_no_repeated_run(spark, docs):
    got = {r["doc_id"]: r["text"] for r in queries.queries()["op8_line_dedup"](spark, SF).collect()}
    assert got == {i: "\n".join(x) for i, x in brute_pairs([(r["doc_id"], r["text"]) for r in docs.collect()]).items()}


def test_line_dedup_of_odd_rows(odd):
    got = line_dedup.line_dedup(odd)
    assert got.count() == len(ROWS) and got.where("doc_id = 7").agg(F.sum("n_removed")).first()[0] == 0
    assert line_dedup.line_dedup(odd.limit(0)).count() == 0


# 9


def test_mixing_meets_its_weights(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise("small").alias("source"))
    got = {r[0]: r[1] for r in mixing.mix(df, weights={"big": 0.2, "mid": 0.3, "small": 0.5}).groupBy("source").count().collect()}
    for name, w in (("big", 0.2), ("mid", 0.3), ("small", 0.5)):
        assert got[name] / 6000 == pytest.approx(w, abs=0.035)
    assert "big" not in {r["source"] for r in mixing.mix(df, weights={"mid": 1.0}).select("source").distinct().collect()}


def test_mixing_of_large_means(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 100, "small").otherwise("big").alias("source"))
    got = [r["count"] for r in mixing.mix(df, weights={"small": 1.0}, size=1000.0).groupBy("doc_id").count().collect()]
    assert len(got) == 100 and np.mean(got) == pytest.approx(2000, abs=20) and 30 < np.std(got) < 60


@pytest.mark.parametrize("mean", [0, 1, 745, 746, 5000])
def test_mixing_meets_any_mean(spark, mean):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "one").otherwise("other").alias("source"))
    weights = {"one": mean / 10_000, "other": 1 - mean / 10_000}
    got = {r["source"]: r["count"] for r in mixing.mix(df, weights=weights, size=5000.0).groupBy("source").count().collect()}
    want = {x: 5000 * 400 * w for x, w in weights.items()}
    for name, n in want.items():
        assert got.get(name, 0) == pytest.approx(n, rel=0.03, abs=40)


def test_mixing_sql_of_large_means(spark, tmp_path):
    df = spark.range(3001).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") == 7, "one").otherwise("many").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.sql(queries.MIXING_SQL.replace("sqrt(n)", "pow(n, 0.0)")).fetchall()  # even weights: a mean of 1500
    got = [tuple(r) for r in mixing.mix(spark.read.parquet(str(tmp_path / "d")), temperature=0.0, with_order=True).collect()]
    assert sorted(got) == sorted(want) and sum(r[3] == "one" for r in got) == pytest.approx(1500, abs=200)


def test_mixing_joins_many_sources_alike(odd, monkeypatch):
    want = sorted((r["order_key"], r["copy_no"]) for r in mixing.mix(odd, with_order=True).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted((r["order_key"], r["copy_no"]) for r in mixing.mix(odd, with_order=True).collect()) == want


def test_mixing_of_odd_rows_repeats_exactly(odd):
    a, b = (mixing.mix(x, with_order=True) for x in (odd, odd.repartition(5)))
    key = lambda d: [(r["order_key"], r["doc_id"], r["copy_no"]) for r in d.collect()]
    assert key(a) == key(b) == sorted(key(a), key=lambda x: x[0])
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd.limit(0)).count() == 0
    assert "Python" not in a._jdf.queryExecution().executedPlan().toString()


# 10


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op10_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert held[held.toxic == 1].predicted.mean() > 0.6 and held[held.toxic == 0].predicted.mean() < 0.02 and got.score.between(0, 1).all()


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (2, 0), (5, 1), (6, 1), (3, None), (None, 1), (4, 7), (77, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.score(odd, model)
    assert got.count() == len(ROWS)
    by = {r["doc_id"]: r["score"] for r in got.collect()}
    assert by[3] == by[4] and by[5] == by[6]
    assert toxicity.keep_civil(odd, model, 2.0).columns == odd.columns and toxicity.keep_civil(odd, model, 2.0).count() == len(ROWS)
    none = toxicity.train(odd, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd, none).collect()} == {0.5}


def test_a_feature_counts_once():
    f = toxicity.Features()
    x = f(np.frombuffer(b"abcabcabcabc" * 50, np.uint8))
    assert len(x) == len(set(x.tolist())) == 9


# pipeline


def test_pipeline_stages_against_brute_force(spark, docs):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "source_mixing", "token_files"]
    civil = P.toxic_out(spark, docs, SF)
    model = toxicity.train(docs.where(~queries.held_out(3, 1)), spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).collect()}
    assert {r["doc_id"] for r in civil.collect()} == want
    one = P.near_duplicates_out(spark, docs, SF)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5)) for i, t in texts.items()}
    gone = set(texts) - {r["doc_id"] for r in one.collect()}
    like = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert gone and all(any(like(i, j) for j in texts if j < i) for i in gone)
    for i in set(texts) - gone:
        assert not any(texts[i].lower() == texts[j].lower() for j in texts if j < i)
    clean = P.benchmark_out(spark, docs, SF)
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in clean.collect()}
    assert all(not any(x in decontaminate.normal(texts[i]) for x in items) for i in left) and len(left) > 0.8 * len(texts)
    assert all(f.columns == docs.columns for f in (civil, one, clean, P.mixed(spark, docs, SF)))
    last = P.run(spark, SF)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and last.count() > 0


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline as P

    labels = spark.createDataFrame([(1, 0), (5, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "un deux trois quatre cinq"), (2, None), (3, "")], "item_id long, text string")
    for name, rows in (("odd", odd), ("empty", odd.limit(0))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.where(F.lit(name == "odd")).write.parquet(f"{folder}/labels.parquet")
        bench.where(F.lit(name == "odd")).write.parquet(f"{folder}/benchmark.parquet")
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, rows, folder)
            assert out.columns == rows.columns and (out.count() > 0) == (name == "odd")
        last = P.run(spark, folder).collect()
        assert {r["doc_id"] for r in last} <= {r[0] for r in ROWS} and bool(last) == (name == "odd") and not any(r["doc_id"] == 7 for r in last)
