"""Joins, searches and sorts against brute force."""

import bisect
import heapq
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceloom.llm import jaccard_join as jj
from sourceloom.llm import mtree, repeat_removal, suffix_sort
from sourceloom.llm.components import components


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(400 + i, 401 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = {x: find(x) for x in list(parent)}
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def words(rng, n):
    return [f"w{rng.randint(0, 40)}" for _ in range(n)]


def corpus(rng):
    """Groups of near copies around one text, chains, exact copies, short and empty texts."""
    base = [words(rng, rng.randint(20, 60)) for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(rng.randint(1, 14)):
            t = list(b)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"x{rng.randint(0, 9)}"
            texts.append(" ".join(t))
    texts += [texts[0], texts[1].upper(), "", "a b", "A  b", "a b c", None, "q"]
    rng.shuffle(texts)
    return texts


def brute_components(texts, k, num, den):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {x: a if y == b else y for x, y in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize(("seed", "k", "num", "shard", "heavy"), [(1, 4, 85, 1_500_000, 16), (2, 4, 85, 300, 3), (3, 5, 80, 200, 2), (4, 2, 70, 1_500_000, 16)])
def test_jaccard_join(spark, monkeypatch, seed, k, num, shard, heavy):
    monkeypatch.setattr(jj, "SHARD_SHINGLES", shard)
    monkeypatch.setattr(jj, "HEAVY", heavy)
    texts = corpus(random.Random(seed))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_join(df, k=k, num=num).collect()}
    assert got == brute_components(texts, k, num, 100)


def test_divide_skip_links_what_all_pairs_link():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sets = sorted((set(rng.integers(0, 14, rng.integers(1, 12)).tolist()) for _ in range(14)), key=len)
        bounds = np.cumsum([0] + [len(s) for s in sets])
        tokens = np.array([t for s in sets for t in sorted(s)], np.uint64)
        got = jj.divide_skip(np.array([len(s) for s in sets]), tokens, bounds, 60, 100)
        for i, j, n in got:
            assert 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j]) and n == len(sets[i] & sets[j])

        def classes(links):
            label = list(range(len(sets)))
            for i, j in links:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
            return label

        every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])]
        assert classes([x[:2] for x in got]) == classes(every)
        found = sorted(jj.divide_skip(np.array([len(s) for s in sets]), tokens, bounds, 60, 100, every=True))
        assert found == sorted((i, j, len(sets[i] & sets[j])) for i, j in every) == heap_search(sets, 60, 100)


def heap_search(sets, num, den):
    """DivideSkip with a heap over the heads of the short lists and bisection in the long ones."""
    out, lists = [], {}
    for x, own in enumerate(sets):
        mine = sorted((lists[t] for t in own if t in lists), key=len)
        smallest = -(-len(own) * num // den)
        least = -(-num * (len(own) + smallest) // (num + den))
        short = mine[: len(mine) - jj.n_long(least, len(mine[-1]))] if mine else []
        longs = mine[len(short) :]
        heap = [(own_list[0], i, 0) for i, own_list in enumerate(short)]
        heapq.heapify(heap)
        while heap:
            y, n = heap[0][0], 0
            while heap and heap[0][0] == y:
                _, i, at = heapq.heappop(heap)
                n += 1
                if at + 1 < len(short[i]):
                    heapq.heappush(heap, (short[i][at + 1], i, at + 1))
            need = -(-num * (len(own) + len(sets[y])) // (num + den))
            if n + len(longs) >= need and len(sets[y]) >= smallest:
                n += sum((k := bisect.bisect_left(p, y)) < len(p) and p[k] == y for p in longs)
                if n >= need:
                    out.append((x, y, n))
        for t in own:
            lists.setdefault(t, []).append(x)
    return sorted(out)


@pytest.mark.parametrize(("shard", "heavy"), [(1_500_000, 16), (300, 3)])
def test_every_link(spark, monkeypatch, shard, heavy):
    """All links between different sets, and the number of rows that each row is linked with."""
    monkeypatch.setattr(jj, "SHARD_SHINGLES", shard)
    monkeypatch.setattr(jj, "HEAVY", heavy)
    texts = corpus(random.Random(6))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    membership, links = jj.jaccard_links(df)
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))) if w else frozenset())
    linked = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 85 * len(a | b)
    got = {r.doc_id: r for r in membership.collect()}
    assert {i: (r.n_shingles, r.n_links) for i, r in got.items()} == {i: (len(a), sum(linked(a, b) for j, b in enumerate(sets) if j != i)) for i, a in enumerate(sets)}
    of = {r["class"]: sets[i] for i, r in got.items() if r["class"] is not None}
    rows = [(frozenset((of[r.a], of[r.b])), r.overlap) for r in links.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(frozenset((a, b)), len(a & b)) for a in of.values() for b in of.values() if a != b and linked(a, b)}


def test_hot_keys_stay_where_they_are(spark, monkeypatch):
    from sourceloom.llm import common

    monkeypatch.setattr(common, "FEW_ROWS", 5)
    rows = spark.createDataFrame([(i % 7 if i % 3 else 99, i) for i in range(300)], "k long, i long")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    got = common.join_by_key(rows, table, "k")
    assert sorted(got.columns) == ["i", "k", "v"]
    assert sorted((r.i, r.k, r.v) for r in got.collect()) == sorted((i, k := i % 7 if i % 3 else 99, 2 * k) for i in range(300))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def brute_starts(text, w):
    seen = {}
    for i in range(len(text) - w + 1):
        if 0 not in text[i : i + w]:
            seen.setdefault(bytes(text[i : i + w]), []).append(i)
    return {i for v in seen.values() if len(v) > 1 for i in v}


def test_suffix_sort():
    rng = random.Random(8)
    for _ in range(300):
        pieces = [[rng.randint(1, rng.choice([1, 2, 5, 20])) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 8))]
        pieces += [p[rng.randrange(len(p)) :] for p in pieces if rng.random() < 0.5]
        text = np.array([x for p in pieces for x in [*p, 0]], np.uint8)
        w, memory = rng.choice([1, 2, 3, 5, 8, 12]), rng.choice([1 << 26, 300])
        want = brute_starts(text.tolist(), w)
        assert set(np.flatnonzero(suffix_sort.repeated_starts(text, w, memory)).tolist()) == want
        s, e = repeat_removal.repeats(text, w, memory)
        assert {x for a, b in zip(s, e, strict=True) for x in range(a, b)} == want


def test_suffix_array_and_prefixes():
    rng = random.Random(9)
    for _ in range(60):
        text = np.array([x for _ in range(rng.randint(1, 4)) for x in [*(rng.randint(1, 3) for _ in range(rng.randint(1, 25))), 0]], np.uint8)
        n, s = len(text), text.tolist()
        # separators grow towards the front, so each is unlike the others
        key = lambda i: [(x, 0) if x else (0, n - (i + d)) for d, x in enumerate(s[i:])]
        want = sorted((i for i in range(n) if s[i]), key=key, reverse=True)
        parts = list(suffix_sort.suffix_pairs(text, 50))
        got = np.concatenate([p[0] for p in parts]).tolist()
        assert got == want
        common = np.concatenate([p[1] for p in parts]).tolist()
        for i in range(1, len(got)):
            a, b, c = got[i - 1], got[i], 0
            while s[a + c] == s[b + c] != 0:
                c += 1
            assert common[i] == c


@pytest.mark.parametrize("tiny", [False, True])
def test_repeat_removal(spark, monkeypatch, tiny):
    if tiny:
        for name, value in {"HEAVY": 3, "SHARD_BYTES": 4000, "SHARD_POSTINGS": 300, "SEGMENT_BYTES": 1500, "CHUNK_BYTES": 900}.items():
            monkeypatch.setattr(repeat_removal, name, value)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [text(n) for n in (150, 198, 210, 420, 900)]
    texts = [text(rng.randint(0, 900)) + "".join(rng.choice([*shared, text(30)]) for _ in range(rng.randint(0, 4))) + text(rng.randint(0, 300)) for _ in range(50)]
    texts += [texts[3], texts[4], "ab" * 500, "", None, "é" * 99, "é" * 100, "é" * 100, shared[4][:199], "z" * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), [tuple(x) for x in r.removed]) for r in repeat_removal.repeat_removal(df, memory=3000 if tiny else 1 << 26).collect()}
    data = {i: (t or "").encode() for i, t in enumerate(texts)}
    count = Counter(b[p : p + 200] for b in data.values() for p in range(len(b) - 199))
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        assert got[i] == (len(b), int(gone.sum()), len(spans), bytes(x for x, g in zip(b, gone, strict=True) if not g), spans), i


@pytest.mark.parametrize(("leaf", "shard"), [(128, 8192), (4, 60)])
def test_exact_top_k(spark, monkeypatch, leaf, shard):
    for name, value in {"LEAF": leaf, "SHARD": shard, "BLOCK": 3, "SEEDS": 20, "PIVOTS": 5}.items():
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(c, 0.3, (80, 6)) for c in (-1, 0, 2)] + [np.ones((60, 6))]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    q = np.floor(v.astype(float) * 256).astype(np.int64)
    want = []
    for i in range(0, len(v), 50):
        order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-int(q[i] @ q[j]), j))[:5]
        want += [(i, r + 1, j, int(q[i] @ q[j])) for r, j in enumerate(order)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.exact_top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == want
    twice = df.unionByName(df.where("vec_id IN (0, 3, 200)"))  # each row is one of its own
    ids, q = [*range(len(v)), 0, 3, 200], np.concatenate([q, q[[0, 3, 200]]])
    want = []
    for i in (x for x in range(len(ids)) if ids[x] % 50 == 0):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-int(q[i] @ q[j]), ids[j]))[:5]
        want += [(ids[i], r + 1, ids[j], int(q[i] @ q[j])) for r, j in enumerate(order)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.exact_top_k(twice, F.col("vec_id") % 50 == 0).collect()) == sorted(want)


def test_pages_go_to_blocks_that_reach_them(spark, monkeypatch):
    """On clustered vectors what is dealt grows with the table, not with its square."""
    for name, value in {"LEAF": 8, "SHARD": 64, "BLOCK": 16}.items():
        monkeypatch.setattr(mtree, name, value)
    dealt, search = {}, mtree.search_pages
    rng = np.random.default_rng(8)
    for n in (600, 1200, 2400):
        centres = rng.normal(0, 4, (n // 60, 8))
        centres *= 8 / np.linalg.norm(centres, axis=1)[:, None]
        v = (centres[np.arange(n) % len(centres)] + rng.normal(0, 0.05, (n, 8))).astype(np.float32)
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
        count = spark.sparkContext.accumulator(0)

        def counting(pages, *rest, count=count):
            count.add(sum(map(len, pages["rows"])) // 8)
            return search(pages, *rest)

        monkeypatch.setattr(mtree, "search_pages", counting)
        assert mtree.exact_top_k(df, F.col("vec_id") % 10 == 0).count() == n // 10 * 5
        dealt[n] = count.value
    assert all(0 < x < 5 * n for n, x in dealt.items()), dealt  # a block of 16 queries for each 160 rows would make it n * n / 160


def test_pages_hold_their_vectors():
    rng = np.random.default_rng(3)
    v = rng.integers(-300, 300, (700, 5)).astype(np.int64)
    top = float((v.astype(float) ** 2).sum(1).max())
    pages = mtree.build_pages(np.arange(700), np.arange(700) + 7, v, top)
    points = mtree.lift(v, top)
    children = {}
    for p in pages:
        children.setdefault(p["parent"], []).append(p)

    def members(p):
        return np.frombuffer(p["ids"], np.int64).tolist() if p["leaf"] else [i for c in children[p["page"]] for i in members(c)]

    assert sorted(members(pages[0])) == list(range(700))
    for p in pages:
        r = mtree.lift(np.frombuffer(p["router"], np.int64).reshape(1, 5), top)[0]
        assert np.linalg.norm(points[members(p)] - r, axis=1).max() <= p["radius"] + 1e-6
