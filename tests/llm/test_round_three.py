"""Importance resampling, sketches and hard negatives against brute force on odd and skewed rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceloom.llm import hard_negatives as mining
from sourceloom.llm import importance, sketch_join
from sourceloom.llm.importance import importance_resample

DOCS = "doc_id long, text string, digest string, n int, words int, weight string, rank int, id string, key long"


def odd_docs(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "Beta", "γάμμα", "d4", "e", "ZETA", "日本", "x" * 70])
    texts = [None, "", " ,.;", "one", "one two", "Ünï ÇØDÉ a_b", *[" ".join(word() for _ in range(rng.randint(15, 40))) for _ in range(30)], " ".join(word() for _ in range(20_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[10]), (None, None), (7, texts[7]), (7, texts[7]), (8, texts[9])] + [(1000 + i, texts[12]) for i in range(60)]
    return rows, spark.createDataFrame([(i, t, "d", 1, 2, "w", 3, "x", 4) for i, t in rows], DOCS)


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def features(text):
    ws = words(text)
    return [zlib.crc32(x.encode()) % 10_000 for x in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]]


def literal_resample(rows, target, percent=25):
    s, t = Counter(b for _, x in rows for b in features(x)), Counter(b for x in target for b in features(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10_000) / ((s[b] + 1) * (sum(t.values()) + 10_000))))
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= 20))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter()
    ranks = {}
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        ranks.setdefault(r, []).append(place)
    for r in out:
        own = ranks.get(r, [])
        drawn[(*r[:4], own.pop(0) if own else None)] += 1
    return drawn


@pytest.mark.parametrize("percent", [25, 100, 0])
def test_resampling_against_brute_force(spark, percent):
    rows, docs = odd_docs(spark)
    target = ["alpha Beta " * 30, None, "", "d4 e d4"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, m long")
    got = importance_resample(docs, bench, percent=percent)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
    assert Counter(tuple(r) for r in got.collect()) == literal_resample(rows, target, percent)


def test_resampling_of_empty_tables(spark):
    rows, docs = odd_docs(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert Counter(tuple(r) for r in importance_resample(docs, none).collect()) == literal_resample(rows, [])
    assert importance_resample(docs.limit(0), none).collect() == []


def test_a_text_is_hashed_once(spark):
    """Copies are grouped by their full text before anything is computed: one row of features, however many rows hold it."""
    docs = spark.createDataFrame([(i, "the same words " * 9 if i % 3 else f"text {i}") for i in range(90)], "doc_id long, text string")
    texts = importance.hashed_texts(docs, "text")
    assert texts.count() == 31 and texts.agg(F.sum("m")).first()[0] == 90 and texts.agg(F.max("m")).first()[0] == 60


def test_ranks_of_equal_rows_lie_in_several_ranges(spark):
    rows = spark.range(4000).select(F.lit(5).alias("score"), F.monotonically_increasing_id().alias("tie"))
    got = importance.ranked(rows, [F.col("score").desc(), F.col("tie")])
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 4001))
    at = rows.repartitionByRange(4, F.col("score").desc(), F.col("tie")).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in at) < 2000


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))) if ws else frozenset()


def literal_components(rows, num=80, den=100):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and label[i] != label[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    names = {x: min((rows[i][0] for i in range(len(rows)) if label[i] == x and rows[i][0] is not None), default=None) for x in set(label)}
    return Counter((i, len(sets[r]), names[label[r]], i == names[label[r]]) for r, (i, _) in enumerate(rows))


def near_copies(rng, vocabulary=400):
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([3, 4, 9, 40, 150, 400]))]
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    common = " ".join(f"c{i}" for i in range(60))  # a passage that many share
    rows += [(len(rows) + i, common + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([5, 12, 16, 40])))) for i in range(40)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, rows[5][1].upper()), (3, rows[3][1]), (3, "another text of the same id here"), (None, rows[8][1]), (None, "nothing like it at all"), (904, "long words " * 30_000)]
    return rows


@pytest.mark.parametrize("shard", [None, 1500])
def test_sketches_against_all_pairs(spark, monkeypatch, shard):
    if shard:  # components larger than a shard are cut into chunks
        monkeypatch.setattr(sketch_join, "SHARD_VALUES", shard)
    rows = near_copies(random.Random(5))
    docs = spark.createDataFrame([(i, t, 0, "b", "v", 1) for i, t in rows], "doc_id long, text string, key long, block string, value string, n int")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in sketch_join.sketch_join(docs).collect())
    assert got == literal_components(rows)
    assert sketch_join.sketch_join(docs.limit(0)).collect() == []


def test_bound_of_shared_values():
    for size in (16, 128):
        c = sketch_join.least_shared(size, 80, 100)
        below = sum(math.comb(size, i) * 0.8**i * 0.2 ** (size - i) for i in range(c))
        assert below <= sketch_join.RISK < below + math.comb(size, c) * 0.8**c * 0.2 ** (size - c)
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 102, 103, 150, 2000):  # pairs on the threshold share at least the bound
        for _ in range(50):
            union = np.sort(rng.choice(2**62, -(-n * 5 // 4), replace=False).astype(np.uint64))
            a, b = union, np.sort(rng.choice(union, -(-4 * len(union) // 5), replace=False))
            shared = len(np.intersect1d(a[:128], b[:128]))
            assert shared >= max(sketch_join.bound(len(a), 128, 80, 100), sketch_join.bound(len(b), 128, 80, 100))
            agree, kept = sketch_join.union_share(a[:128], b[:128], 128)
            head = union[:128]
            assert (agree, kept) == (len(np.intersect1d(head, b)), len(head))


def test_near_copies_cost_one_comparison_each():
    rng = np.random.default_rng(2)
    base = rng.choice(2**62, 500, replace=False).astype(np.uint64)
    copies = [np.sort(np.concatenate([base[:-2], rng.choice(2**62, 2).astype(np.uint64)])) for _ in range(200)]
    seen = Counter()
    links = sketch_join.sketch_links(copies, 128, 80, 100, seen)
    assert len(links) == 199 == seen["compared"] == seen["estimates"]


def test_sets_below_the_threshold_are_compared_in_batches():
    """A large group of sets just below the threshold is compared whole, in few array operations a set, and what links among them is found."""
    rng = np.random.default_rng(3)
    base = rng.choice(2**62, 500, replace=False).astype(np.uint64)
    own = lambda n: np.sort(np.concatenate([rng.choice(base, 500 - n, replace=False) if n % 2 else base[n:], rng.choice(2**62, n).astype(np.uint64)]))
    sets = [own(int(n)) for n in rng.choice([60, 64, 45, 57], 400, p=[0.6, 0.3, 0.05, 0.05])]
    sets = sorted([*sets, *[x[5:] for x in sets[::50]], *[x[:-5] for x in sets[::50]]], key=len)
    seen = Counter()
    links = sketch_join.sketch_links(sets, 128, 80, 100, seen)
    assert seen["compared"] > 40_000 and 0 < seen["batches"] <= 12 * len(sets)
    whole = [set(x.tolist()) for x in sets]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (both := len(whole[i] & whole[j])) >= 80 * (len(whole[i]) + len(whole[j]) - both)]
    assert set(links) <= set(near) and 8 <= len(links) < len(near)
    assert sorted(sketch_join.stars(links)) == sorted(sketch_join.stars(near))


def test_a_shard_names_the_least_connected():
    chain = [(i, i + 1) for i in range(0, 60, 2)] + [(i + 1, i) for i in range(59, 0, -2)] + [(103, 101), (102, 103)]
    assert sorted(sketch_join.stars(chain)) == [(i, 0) for i in range(1, 61)] + [(102, 101), (103, 101)]
    assert sketch_join.stars([]) == []


def literal_negatives(rows, anchor=lambda i: i % 10 == 0, k=5):
    rows = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * z for x, z in zip(a, b, strict=True))
    out = Counter()
    for r, (i, y, v) in enumerate(rows):
        if not anchor(i):
            continue
        all_ = sorted((-dot(v, w), j, q, z) for q, (j, z, w) in enumerate(rows) if q != r and len(w) == len(v))
        for p, j, _, _ in [x for x in all_ if x[3] == y][:5]:
            good = [x for x in all_ if x[3] != y and 80 * -p <= 100 * -x[0] <= 100 * -p][:k]
            out.update((i, j, rank, x[1], -p, -x[0]) for rank, x in enumerate(good, 1))
    return out


def vectors(rng, n=300, dim=6):
    centre = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centre)
        rows.append((i, [float(np.float32(x + rng.choice([0, 0, 0.05, -0.1]))) for x in c], rng.randrange(4)))  # many ties
    nan, inf = math.nan, math.inf
    rows += [(20, rows[20][1], rows[20][2])] * 3 + [(400 + i, rows[10][1], 1) for i in range(80)]  # repeated rows, one hot vector
    rows += [(500, None, 1), (510, [1.0, None] * 3, 1), (520, [nan] + [0.0] * 5, 1), (530, [inf] + [0.0] * 5, 1), (540, [], 1), (550, [0.1] * 6, None), (None, [0.2] * 6, 1), (560, [0.5, 0.5], 2), (561, [0.5, 0.4], 2), (562, [0.5, 0.45], 3), (570, [-0.9] * 6, 77), (580, [0.9] * 6, 88), (581, [-0.9] * 6, 88)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_negatives_against_all_pairs(spark, monkeypatch, small):
    if small:  # several blocks of anchors, tiles of a few rows
        for name, n in (("BLOCK_BYTES", 8 * 6 * 7), ("TILE_ROWS", 3), ("TILE_COLS", 11)):
            monkeypatch.setattr(mining, name, n)
    rows = vectors(random.Random(8))
    df = spark.createDataFrame([(i, v, y, 1, "s") for i, v, y in rows], "vec_id long, embedding array<float>, label int, row int, slot string")
    got = mining.hard_negatives(df.repartition(5), F.col("vec_id") % 10 == 0)
    want = literal_negatives(rows)
    assert Counter(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == want and len(want) > 300
    assert mining.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_large_components_stay_exact(spark):
    """Sums beyond 2^53 are computed in integers."""
    rows = [(i, [2.0**20 + i / 256, 2.0**19 - i / 128], i % 2) for i in range(0, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = mining.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert Counter(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == literal_negatives(rows)


def test_lists_merge():
    rng = np.random.default_rng(4)
    s, ids, rows = rng.integers(-5, 5, (7, 400)), rng.integers(0, 90, 400), np.arange(400)
    whole, parts = mining.Best(7, 5), mining.Best(7, 5)
    whole.offer(0, s, np.ones_like(s, bool), ids, rows)
    for cut in mining.tiles(400, 13):
        for a in mining.tiles(7, 2):
            parts.offer(a.start, s[a, cut], np.ones_like(s[a, cut], bool), ids[cut], rows[cut])
    for x, y in ((whole.score, parts.score), (whole.id, parts.id), (whole.row, parts.row)):
        assert (x == y).all()
    want = sorted((-s[0, c], ids[c], rows[c]) for c in range(400))[:5]
    assert [tuple(map(int, x)) for x in zip(-whole.score[0], whole.id[0], whole.row[0], strict=True)] == [tuple(map(int, x)) for x in want]
