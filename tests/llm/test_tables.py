"""Odd rows through every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import math

import pytest
from pyspark.sql import functions as F

from sourceloom.llm import quality as quality_module
from sourceloom.llm.decontamination import contamination
from sourceloom.llm.jaccard_join import jaccard_join
from sourceloom.llm.mixing import mix_sources
from sourceloom.llm.mtree import exact_top_k
from sourceloom.llm.pii import pii_spans
from sourceloom.llm.quality import quality
from sourceloom.llm.queries import tokenizer_path
from sourceloom.llm.repeat_removal import repeat_removal
from sourceloom.llm.secrets import secret_spans
from sourceloom.llm.token_counts import token_counts
from sourceloom.llm.toxicity import toxicity

LONG = ("lorem ipsum dolor sit amet " * 9000) + "a@b.co end"
#: Columns whose names operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, id string, n int, token string, size double, th string, of int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two three"), (4, "one two three"), (5, "one two three"), (6, LONG), (None, "no id at all here"), (7, "ünï cødé " * 40), (8, "word " * 300), (None, None)]
    return spark.createDataFrame([(i, t, None, s, None, 0, "x", 1, "t", 0.5, "h", 2) for (i, t), s in zip(rows, ["a", None, "b", "a", "a", "b", "a", None, "c", "c", "c"], strict=True)], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2 if i else None, (i + 1) % 2) for i in range(9)] + [(None, 1, 1), (4, 0, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "One, two: THREE", 5), (2, None, 5), (3, "", 5), (4, "word " * 12, 5)], "item_id long, text string, h int")


def operators(docs, labels, benchmark):
    return {
        "quality": lambda d: quality(d, labels), "tokens": lambda d: token_counts(d, tokenizer_path()), "mix": mix_sources, "pii": pii_spans, "jaccard": jaccard_join, "toxicity": lambda d: toxicity(d, labels),
        "contamination": lambda d: contamination(d, benchmark), "secrets": secret_spans, "repeats": repeat_removal,
    }


@pytest.mark.parametrize("name", ["quality", "tokens", "mix", "pii", "jaccard", "toxicity", "contamination", "secrets", "repeats"])
def test_odd_rows(docs, labels, benchmark, name):
    run = operators(docs, labels, benchmark)[name]
    rows = run(docs).collect()
    assert len(rows) == docs.count()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    empty = run(docs.limit(0))
    assert empty.count() == 0 and empty.schema.names == run(docs).schema.names
    if name == "quality":
        assert all(0 <= r["score"] <= 1 for r in rows)
    if name == "tokens":
        assert {r["doc_id"]: r["n_tokens"] for r in rows}[1] == 0
    if name == "mix":
        assert all(r["taken"] <= 3 * r["size"] for r in rows)
    if name == "jaccard":
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"]}
        assert got[1] == (0, 1) and got[3] == (0, 3) and got[4] == (1, 4) and got[5] == (1, 4)
    if name == "contamination":
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in rows if r["doc_id"]}
        assert got[4] == (3, 3, ["1"]) and got[1] == (0, 0, []) and got[8] == (300, 300, ["4"])
    if name == "pii":
        got = {r["doc_id"]: [(x["kind"], x["s"], x["e"]) for x in r["base"]] for r in rows}
        assert got[6] == [("email", len(LONG) - 10, len(LONG) - 4)] and got[1] == []
    if name == "repeats":
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in rows}
        assert got[1] == (0, 0, 0) and got[8] == (1500, 1500, 1) and got[4] == (13, 0, 0)


def test_embeddings(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, None, 1), (6, [-0.001, 0.25], 1), (6, [-0.001, 0.25], 1), (7, [], 1), (None, [1.0, 1.0], 1), (50, [0.25], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in exact_top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 256 * 256 + 128 * 128), (0, 2, 6, -256 + 64 * 128), (0, 3, 6, -256 + 64 * 128)]  # a repeated row is one of its own
    assert exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_labels_of_one_kind(spark, docs):
    none = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").limit(0)
    assert {r["score"] for r in toxicity(docs, none).collect()} == {0.5}
    assert {r["score"] for r in quality(docs, none).collect()} == {0.5}
    assert quality_module.MAX_DOCS > 0
