"""The pipeline: stages in order, what each does to a small corpus, and agreement with a brute-force version."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sourceloom.llm.common import UPPER
from sourceloom.llm.mixing import MIX_SQL
from sourceloom.llm.pii import pii_spans
from sourceloom.llm.quality import quality
from sourceloom.llm.queries import ORACLES, QUERIES

NAMES = ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "mixing sources to target weights"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(1)
    good = lambda n=60: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 99)) for _ in range(n)) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "CHEAP!!", "$$$"]) for _ in range(60))
    texts = [good() for _ in range(120)] + [bad() for _ in range(40)]
    texts[10] = texts[11] = texts[12]
    near = texts[20].split()
    near[-1] = "changed"
    texts[21] = " ".join(near)
    texts[30] = texts[30] + " mail me@example.com or +1 310 555 4510"
    item = " ".join(f"bench{i}" for i in range(14))
    texts[40] = texts[40] + " " + item + " tail"
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)] + [(500, None, None, None, None), (501, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "zzz yyy")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    assert [n for n, _ in cp.STAGES] == NAMES and cp.ORACLE_SQL is None
    docs = cp.table(spark, folder, "documents")
    kept = []
    for i, (_, stage) in enumerate(cp.STAGES):
        docs = cp.staged(stage(spark, docs, folder), "t")
        kept.append({r.doc_id: r for r in docs.collect()})
        if i < 4:
            assert tuple(docs.columns) == cp.COLUMNS
    first, second, third, fourth, last = kept
    assert set(range(120)) <= set(first) and not set(range(120, 160)) & set(first)
    assert set(first) - set(second) == {11, 12, 21}
    assert set(second) - set(third) == {40}
    assert set(fourth) == set(third) and "<EMAIL>" in fourth[30].text and "<PHONE>" in fourth[30].text and fourth[30].n_chars == len(fourth[30].text)
    assert all(fourth[i].text == third[i].text for i in third if i != 30)
    assert set(last) <= set(fourth) and all(r.copies >= 1 and r.taken == r.copies * r["size"] for r in last.values())
    want = {r.doc_id: r.taken for r in cp.run(spark, folder).collect()}
    assert want == {i: r.taken for i, r in last.items()}


def test_repeated_rows_leave_one(spark, folder):
    docs = cp.table(spark, folder, "documents")
    twice = docs.unionByName(docs.where("doc_id IN (5, 501)")).unionByName(docs.where("doc_id = 6").withColumn("text", F.concat("text", F.lit(" x"))))
    got = cp.near_duplicates_stage(spark, twice, folder).groupBy("doc_id").count().where("count > 1").collect()
    assert [r.doc_id for r in got] == [501]
    assert cp.near_duplicates_stage(spark, docs.limit(0), folder).count() == 0


def test_names():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)


DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are missing")
def test_against_brute_force(spark):
    """run() on the smallest tables, stage by stage in plain Python; the classifier's answers are taken from its operator."""
    docs = {r.doc_id: r for r in cp.table(spark, DIR, "documents").collect()}
    good = {r.doc_id for r in quality(cp.table(spark, DIR, "documents"), cp.table(spark, DIR, "labels")).where("predicted = 1").collect()}
    docs = {i: r.text or "" for i, r in docs.items() if i in good}

    sets = {}
    for i, t in docs.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    lead = {i: i for i in docs}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                lead[b] = a
    docs = {i: t for i, t in docs.items() if find(i) == i}

    lower = str.maketrans(UPPER, UPPER.lower())
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))
    windows = {tuple(w[k : k + 10]) for r in cp.table(spark, DIR, "benchmark").collect() for w in [words(r.text or "")] for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    docs = {i: t for i, t in docs.items() if not hit(words(t))}

    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for r in pii_spans(frame).where(F.size("spans") > 0).collect():
        text, out, at = docs[r.doc_id], "", 0
        for s, e, kind in sorted(((x.s, x.e, x.kind) for x in r.spans), key=lambda x: (x[0], -x[1])):
            if s >= at:
                out += text[at:s] + f"<{kind.upper()}>"
            at = max(at, e)
        docs[r.doc_id] = out + text[at:]

    source = {r.doc_id: r.source for r in cp.table(spark, DIR, "documents").collect()}
    con = duckdb.connect()
    con.sql("CREATE TABLE kept (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO kept VALUES (?, ?, ?)", [[i, t, source[i]] for i, t in docs.items()])
    want = {r[0]: r[4] for r in con.sql(MIX_SQL.format(docs="kept")).fetchall() if r[4] > 0}
    got = {r.doc_id: (r.taken, r.text) for r in cp.run(spark, DIR).collect()}
    assert got == {i: (n, docs[i]) for i, n in want.items()}
