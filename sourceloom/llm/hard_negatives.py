"""Hard negatives by blocked dense matrix products.

Anchors are cut into blocks of bounded size. A block is broadcast, every task multiplies it with its own candidates in tiles - in
float64 while all sums lie below 2^53, where that is exact, else in integers - and keeps each anchor's best candidates so far. These
lists merge: the best of all tasks' lists are the best of all candidates. The first pass finds the positives, against candidates of the
anchor's label alone; the second, with the window of scores that each positive allows, the best negatives inside it.

What leaves a task is k rows an anchor and pass. The driver holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .mtree import products, quantised

#: Bytes of anchors in a block, anchors and candidates in a tile.
BLOCK_BYTES, TILE_ROWS, TILE_COLS = 1 << 24, 512, 2048
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Best:
    """Per list the k best (score, id, row) offered so far: by score from the highest, then by id and row."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.id, self.row = k, np.full((n, k), LEAST), np.full((n, k), MOST), np.full((n, k), MOST)

    def floor(self) -> np.ndarray:
        """Each list's last score: what is below it can't enter."""
        return self.score[:, -1]

    def offer(self, first: int, scores: np.ndarray, able: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """A tile of scores for the lists from `first` on; able tells which of them count."""
        crowded = np.flatnonzero(able.sum(1) > 4 * self.k)
        if len(crowded):
            own = np.where(able[crowded], scores[crowded], LEAST)
            able[crowded] &= own >= np.partition(own, -self.k, axis=1)[:, [-self.k]]
        at, col = np.nonzero(able)
        if not len(at):
            return
        used = np.unique(at)
        old = np.repeat(used, self.k)
        at, score = np.concatenate([old, at]), np.concatenate([self.score[first + used].ravel(), scores[at, col]])
        name, row = np.concatenate([self.id[first + used].ravel(), ids[col]]), np.concatenate([self.row[first + used].ravel(), rows[col]])
        order = np.lexsort((row, name, ~score, at))  # ~ turns the order round without an overflow
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.k
        where = (first + at[keep], place[keep])
        self.score[where], self.id[where], self.row[where] = score[order][keep], name[order][keep], row[order][keep]

    def lists(self) -> tuple[np.ndarray, ...]:
        """(list, score, id, row) of all that was kept."""
        at, col = np.nonzero(self.row != MOST)
        return at, self.score[at, col], self.id[at, col], self.row[at, col]


def tiles(n: int, size: int) -> Iterator[slice]:
    return (slice(i, min(i + size, n)) for i in range(0, n, size))


def columns_of(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, ...]:
    """(ids, rows, labels, vectors) of rows (id, row, label, v) whose vectors have dim components."""
    ids, rows, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    return ids, rows, labels, batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def find_positives(block: dict, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    dim, best = block["v"].shape[1], Best(len(block["row"]), k)
    for batch in batches:
        for cut in tiles(batch.num_rows, TILE_COLS):
            ids, rows, labels, v = columns_of(batch.slice(cut.start, cut.stop - cut.start), dim)
            for label in np.unique(labels):
                own = np.flatnonzero(labels == label)
                lo, hi = np.searchsorted(block["label"], [label, label + 1])  # anchors are in order of their labels
                for t in tiles(hi - lo, TILE_ROWS):
                    a = slice(lo + t.start, lo + t.stop)
                    s = products(block["v"][a], v[own])
                    able = (s >= best.floor()[a, None]) & (block["row"][a, None] != rows[own][None])
                    best.offer(a.start, s, able, ids[own], rows[own])
    at, score, ids, rows = best.lists()
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block["row"][at], ids, rows, score)], ["anchor_row", "id", "row", "score"])


def find_negatives(block: dict, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """block["low"] and block["high"]: a column of bounds for each positive, LEAST above where there is none."""
    dim, slots = block["v"].shape[1], block["low"].shape[1]
    best = [Best(len(block["row"]), k) for _ in range(slots)]
    for batch in batches:
        for cut in tiles(batch.num_rows, TILE_COLS):
            ids, rows, labels, v = columns_of(batch.slice(cut.start, cut.stop - cut.start), dim)
            for a in tiles(len(block["row"]), TILE_ROWS):
                s = products(block["v"][a], v)
                other = block["label"][a, None] != labels[None]
                for slot in range(slots):
                    low = np.maximum(block["low"][a, slot], best[slot].floor()[a])
                    best[slot].offer(a.start, s, other & (s >= low[:, None]) & (s <= block["high"][a, slot][:, None]), ids, rows)
    for slot in range(slots):
        at, score, ids, rows = best[slot].lists()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block["row"][at], np.full(len(at), slot + 1, np.int32), ids, rows, score)], ["anchor_row", "slot", "id", "row", "score"])


def over_blocks(anchors: DataFrame, rows: DataFrame, find: Callable, columns: tuple[str, ...], kind: str, k: int) -> DataFrame:
    """find's rows for every block of anchors against all rows of vectors of the same length, block by block, each staged."""
    spark, parts = anchors.sparkSession, []
    for dim, n in anchors.groupBy("dim").agg(F.count(F.lit(1))).collect():  # a row for each length of vectors
        blocks = -(-n * dim * 8 // BLOCK_BYTES)
        candidates = rows.where(F.col("dim") == dim).select("id", "row", "label", "v")
        for b in range(blocks):
            some = anchors.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)).orderBy("label", "row").toArrow().combine_chunks()
            if not some.num_rows:
                continue
            block = {c: some[c].to_numpy() for c in ("row", "label")} | {"v": np.array(some["v"].combine_chunks().flatten(), np.int64).reshape(-1, dim)}
            block |= {c: np.array(some[c].combine_chunks().flatten(), np.int64).reshape(some.num_rows, -1) for c in columns}
            sent = spark.sparkContext.broadcast(block)
            parts.append(staged(candidates.mapInArrow(lambda batches, sent=sent: find(sent.value, batches, k), kind), "best"))
            sent.unpersist()
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], kind)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: str | Column = "label", positives: int = 5, negatives: int = 5, num: int = 80, den: int = 100, id_col: str = "vec_id",
    vector_col: str = "embedding", scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score).

    An anchor's positives are its `positives` best other rows of its label, fewer if there are fewer. For each, the `negatives` best rows
    of other labels follow whose score s satisfies num p <= den s <= den p, p the positive's score. Scores are integer inner
    products, the higher the better, ties to the smaller id. label gives a row's integer label. Rows without an id or a label
    and vectors that are null, empty or hold null or non-finite components take no part; vectors of different lengths
    never meet; a repeated row is a row of its own, as an anchor, a positive and a negative. A negative p allows nothing, as num p > den p;
    an anchor without positives gives no rows; neither does an empty table. Other columns are not read.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), quantised(vector_col, scale).alias("v"))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()})
    rows = staged(rows, "vectors")
    anchors = rows.where("is_anchor").select("id", "row", "label", "dim", "v")

    own = Window.partitionBy("anchor_row").orderBy(F.col("score").desc(), "id", "row")
    found = over_blocks(anchors, rows, find_positives, (), "anchor_row long, id long, row long, score long", positives)
    found = found.withColumn("slot", F.row_number().over(own)).where(F.col("slot") <= positives)
    found = staged(found.select("anchor_row", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # each anchor with a window for every place; empty ones where it has fewer positives
    low = F.expr(f"({num} * positive_score + {den - 1}) div {den}")  # rounded up; behind a negative score too it lies above it
    window = F.struct("slot", low.alias("low"), F.col("positive_score").alias("high"))
    by_anchor = found.groupBy(F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_list(window)).alias("windows"))  # at most `positives` a row
    place = lambda name, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("windows", i)[name], F.lit(none).cast("long")))
    anchors = anchors.join(by_anchor, "row").select("id", "row", "label", "dim", "v", place("low", MOST).alias("low"), place("high", LEAST).alias("high"))
    mined = over_blocks(staged(anchors, "windows"), rows, find_negatives, ("low", "high"), "anchor_row long, slot int, id long, row long, score long", negatives)
    best = Window.partitionBy("anchor_row", "slot").orderBy(F.col("score").desc(), "id", "row")
    mined = mined.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = found.join(rows.where("is_anchor").select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    return mined.join(named, ["anchor_row", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: DuckDB SQL for hard_negatives with its default parameters over {vectors}, anchors by `vec_id % 100 = 0`, labels of every seventh id moved on by one.
NEGATIVES_SQL = r"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM {vectors}
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS MATERIALIZED (SELECT a.rid AS rid, a.vec_id AS anchor_id, c.rid AS other, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.rid <> c.rid AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, other) AS slot FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.rid, p.slot ORDER BY s.score DESC, s.vec_id, s.other) AS rank
  FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.slot <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
