"""Toxicity by maximum-scoring segments.

A word's units are itself and its byte n-grams (stems of compounds show there). Log-odds of units between toxic and
other labelled documents, under an informative Dirichlet prior, give each word a score: positive where a unit is clearly
toxic, else a small negative drift. All maximal scoring segments of a document are found in linear time. Segment scores
are calibrated by extreme-value theory - lambda * S - ln(K N) has a Gumbel tail in clean text, lambda from the scores of its
words and K from the best segments and lengths of its documents - and the best segment and the sum of the significant
ones give the document's probability by a logistic fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, mod_crc32, staged
from .textbytes import BYTE, FOLD, IS_LETTER, buffers, chunks, mix, powers, word_hashes

BITS = 20
GRAMS = (4, 5)
CHUNK_BYTES = 1 << 20
RANGES = 64
#: Labelled documents that a fit sees at most: those whose ids have the least hashes.
MAX_DOCS = 40_000
#: Bounds of a document's best normalised segment, and steps of evidence in which documents are counted for the logistic fit.
BEST, EVIDENCE_STEP = (-10.0, 40.0), 0.02
#: Standard errors from zero at which a unit counts and its least log-odds: with many documents, topics that toxic ones merely
#: lean to are significant too. Then the drift of a word without evidence and the weight of the prior against all counts.
Z, LEAST, DRIFT, PRIOR = 2.5, 1.0, 0.25, 0.1
#: Probability below which a segment by itself is significant in a clean text of its length.
ALPHA = 0.05


def units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, word of each unit in order of words, bucket of each unit) of texts cut by bounds."""
    low = FOLD[data]
    start, length, word = word_hashes(low, IS_LETTER[low], bounds[1:-1])
    of = np.searchsorted(bounds, start, "right") - 1
    owner, bucket = [np.arange(len(start))], [word >> np.uint64(64 - BITS)]
    for g in GRAMS:
        count = np.maximum(length - g + 1, 0)
        own = np.repeat(np.arange(len(start)), count)
        at = start[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        h = np.full(len(at), g, np.uint64)
        for k in range(g):
            h = h + BYTE[low[at + k]] * powers(16)[k + 1]
        owner.append(own)
        bucket.append(mix(h) >> np.uint64(64 - BITS))
    owner, bucket = np.concatenate(owner), np.concatenate(bucket).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return of, owner[order], bucket[order]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) by the linear-time algorithm of Ruzzo and Tompa.

    Each candidate keeps a link to the last one before it whose left total is lower. A search follows links, and what it
    passes over lies behind the new candidate for ever, so all searches together take linear time.
    """
    # each candidate: start, end, total before it, total at its end, place of the last one that begins lower
    stack: list[tuple[int, int, float, float, int]] = []
    total = scores[0] * 0 if scores else 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s > 0:
            start, left = i, before
            j = len(stack) - 1
            while True:
                while j >= 0 and stack[j][2] >= left:
                    j = stack[j][4]
                if j < 0 or stack[j][3] >= total:
                    break
                # from that candidate on they are one; it begins where it began, and so does its own search
                start, left, j = stack[j][0], stack[j][2], _cut(stack, j)
            stack.append((start, i + 1, left, total, j))
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def _cut(stack: list[tuple], j: int) -> int:
    """Drop the candidates from j on; j's own link."""
    link = stack[j][4]
    del stack[j:]
    return link


def word_scores(owner: np.ndarray, bucket: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    s = table[bucket]
    edge = np.searchsorted(owner, np.arange(n))
    if not n:
        return np.zeros(0)
    high, low = np.maximum.reduceat(s, edge), np.minimum.reduceat(s, edge)
    return np.where(high > 0, high, low - DRIFT)


def segments(words: np.ndarray) -> list[tuple[int, int, float]]:
    """Maximal segments of an array of word scores; stretches without a positive score are taken in one step."""
    hot = np.flatnonzero(words > 0)
    if not len(hot):
        return []
    total = np.concatenate([[0.0], np.cumsum(words)])
    scores, place = [], []
    last = 0
    for h in hot.tolist():
        if h > last:
            scores.append(float(total[h] - total[last]))
            place.append((last, h))
        scores.append(float(words[h]))
        place.append((h, h + 1))
        last = h + 1
    return [(place[a][0], place[b - 1][1], s) for a, b, s in maximal_segments(scores)]


def log_odds(toxic: np.ndarray, other: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Score of each bucket from numbers of documents: log-odds where at least Z standard errors from zero and, if toxic, at least LEAST, else 0."""
    both = toxic + other
    prior = PRIOR * both
    a, b = toxic + prior, other + prior
    big1, big0 = n1 + PRIOR * (n1 + n0), n0 + PRIOR * (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.log(a / np.maximum(big1 - a, 0.5)) - np.log(b / np.maximum(big0 - b, 0.5))
        z = d / np.sqrt(1 / a + 1 / b)
    d = np.where(both > 0, d, 0.0)
    return np.where(both > 0, np.where((z >= Z) & (d >= LEAST), d, np.where(z <= -Z, np.maximum(d, -1.0), 0.0)), 0.0)


def gumbel_rate(values: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1 for the score distribution of clean words."""
    p = weights / max(weights.sum(), 1e-12)
    if not (values[p > 0] > 0).any() or (p * values).sum() >= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * values, 700))).sum())
    while f(hi) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 1 else (lo, mid)
    return max(lo, 0.05)


def gumbel_factor(n_seen: float, exposure: float) -> float:
    """ln K: the most likely K is the number of clean documents with a segment over the sum of N exp(-lambda S) of all of them."""
    return float(np.log(np.clip(n_seen / exposure, 1e-6, 1.0))) if n_seen > 0 and exposure > 0 else float(np.log(0.1))


class ToxicModel:
    """Bucket scores, the extreme-value constants of clean text, and the logistic weights."""

    def __init__(self):
        self.table = np.zeros(1 << BITS, np.float32)
        self.rate, self.log_k = 1.0, np.log(0.1)
        self.weights = np.zeros(3)

    def bits(self, found: list[float], n: int) -> np.ndarray:
        """Normalised scores of the segments of a text of n words."""
        return self.rate * np.array(found, float) - self.log_k - np.log(max(n, 1))

    def evidence(self, found: list[float], n: int) -> tuple[float, float]:
        """(best normalised segment between the bounds of BEST, the lower one where there is none; logarithm of one and the sum of the significant ones)."""
        bits = self.bits(found, n)
        significant = bits[bits > -np.log(ALPHA)]
        return float(np.clip(bits.max(), *BEST)) if len(bits) else BEST[0], float(np.log1p(significant.sum()))

    def probability(self, best: float, total: float) -> float:
        # documents without a significant segment keep an order by their best one; the logit is bounded
        x = self.weights @ np.array([1.0, best, total])
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for a ridge logistic regression on rows that count n times. More evidence never lowers the answer: a feature
    whose slope would be below 0 is left out, the lowest first."""
    w, used = np.zeros(x.shape[1]), np.arange(x.shape[1])
    while True:
        part, v = x[:, used], np.zeros(len(used))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(part @ v, -30, 30)))
            g = part.T @ (n * (p - y)) + ridge * v
            h = (part * (n * (p * (1 - p) + 1e-6))[:, None]).T @ part + ridge * np.eye(len(v))
            v = v - np.clip(np.linalg.solve(h, g), -2, 2)
        if len(v) > 1 and v[1:].min() < 0:
            used = np.delete(used, 1 + int(v[1:].argmin()))
            continue
        w[used] = v
        return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS) -> ToxicModel:
    """Fit on at most max_docs labelled documents with a text (see labelled_sample). The driver sees counts of fixed size alone."""
    model = ToxicModel()
    chosen = labelled_sample(docs, labels, id_col, text_col, label_col, max_docs).where("text <> ''").select("text", "y")
    width = (1 << BITS) // RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column(0))
            for i, j in chunks(offsets, CHUNK_BYTES):
                of, owner, bucket = units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                seen = np.unique(of[owner].astype(np.int64) << BITS | bucket)
                toxic = y[i:j][seen >> BITS] == 1
                counts[0] += np.bincount(seen[~toxic] & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
                counts[1] += np.bincount(seen[toxic] & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
                n += np.bincount(y[i:j], minlength=2)[:2]
        rows = [(r, counts[:, r * width : (r + 1) * width].tobytes(), int(n[0]) * (r == 0), int(n[1]) * (r == 0)) for r in range(RANGES) if r == 0 or counts[:, r * width : (r + 1) * width].any()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["part", "counts", "n0", "n1"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int32) for x in pdf["counts"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "counts": [total.astype(np.int32).tobytes()], "n0": [pdf["n0"].sum()], "n1": [pdf["n1"].sum()]})

    kind = "part int, counts binary, n0 long, n1 long"
    rows = chosen.mapInArrow(count, kind).groupBy("part").applyInPandas(lambda pdf: add(pdf), kind).collect()  # RANGES rows of fixed size
    counts = np.zeros((2, 1 << BITS))
    for r in rows:
        counts[:, r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["counts"], np.int32).reshape(2, -1)
    n0, n1 = sum(r["n0"] for r in rows), sum(r["n1"] for r in rows)
    if not n0 or not n1:
        return model
    table = log_odds(counts[1], counts[0], n1, n0).astype(np.float32)
    model.table = table

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros(64, np.int64)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            out = []
            for i, words in scored_words(batch.column(0), table):
                found = [s for _, _, s in segments(words)]
                out.append((int(y[i]), len(words), max(found, default=0.0), np.array(found, float).tobytes(), b""))
                if y[i] == 0:
                    hist += np.bincount(np.clip((words + 2) * 4, 0, 63).astype(int), minlength=64)
            yield measured_batch(out)
        yield measured_batch([(-1, 0, 0.0, b"", hist.tobytes())])

    measured = staged(chosen.mapInArrow(measure, "y int, n long, top double, scores binary, hist binary"), "measured")
    rows = measured.where("y < 0").select("hist").collect()  # a row of fixed size a task
    hist = sum((np.frombuffer(r["hist"], np.int64) for r in rows), np.zeros(64, np.int64)).astype(float)
    values = np.arange(64) / 4 - 2 + 0.125
    hist += (values > 0) * 1e-9 * hist.sum()
    model.rate = gumbel_rate(values, hist)
    seen = measured.where("y = 0 AND n > 0").agg(F.count_if(F.col("top") > 0), F.sum(F.col("n") * F.exp(-model.rate * F.col("top")))).first()
    model.log_k = gumbel_factor(float(seen[0] or 0), float(seen[1] or 0))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, n, scores = (batch.column(i).to_pylist() for i in range(3))
            x = np.array([model.evidence(np.frombuffer(s).tolist(), k) for s, k in zip(scores, n, strict=True)]).reshape(-1, 2)
            cell = np.rint(x / EVIDENCE_STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(cell[:, 0]), pa.array(cell[:, 1])], ["y", "best", "total"])

    cells = measured.where("y >= 0").select("y", "n", "scores").mapInArrow(evidence, "y int, best long, total long")
    rows = cells.groupBy("y", "best", "total").count().collect()  # bounded values in steps: cells that occur, a bounded number
    at = np.array([[r["best"], r["total"]] for r in rows], float) * EVIDENCE_STEP
    x = np.concatenate([np.ones((len(rows), 1)), at], axis=1)
    model.weights = logistic(x, np.array([r["y"] for r in rows], float), np.array([r["count"] for r in rows], float))
    return model


def measured_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["y", "n", "top", "scores", "hist"])


def scored_words(column: pa.Array, table: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word scores) of every text."""
    data, offsets = buffers(column)
    for i, j in chunks(offsets, CHUNK_BYTES):
        of, owner, bucket = units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        scores = word_scores(owner, bucket, len(of), table)
        edge = np.searchsorted(of, np.arange(j - i + 1))
        for r in range(j - i):
            yield i + r, scores[edge[r] : edge[r + 1]]


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' id, `keep` columns, score and segments (array of significant [start, end) in words, with their normalised scores).

    The whole text counts. Null or empty texts have no segment and the score of any text without one; without labels of both
    kinds all scores are one half; repeated rows are answered each; an empty table gives no rows.
    """
    own = docs.select(F.col(text_col).cast("string").alias("__text"), id_col, *keep)
    schema = T.StructType([*own.schema.fields[1:], *T._parse_datatype_string("score double, segments array<struct<s:int,e:int,bits:double>>").fields])
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("bits", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, spans = np.zeros(batch.num_rows), [[]] * batch.num_rows
            for i, words in scored_words(batch.column(0), model.table):
                found = segments(words)
                best, total = model.evidence([s for _, _, s in found], len(words))
                out[i] = model.probability(best, total)
                if found:
                    bits = model.bits([s for _, _, s in found], len(words))
                    spans[i] = [{"s": a, "e": b, "bits": float(x)} for (a, b, _), x in zip(found, bits, strict=True) if x > -np.log(ALPHA)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out), pa.array(spans, kind)], schema.names)

    return own.mapInArrow(score, schema)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, held_out, score, predicted, segments: fitted on labels outside the held-out fold, applied to every row of docs.

    The fold of an id is crc32 of its text modulo `folds`; a null id is in no fold. See score_toxicity for odd rows.
    """
    model = fit_toxicity(docs, labels.where(mod_crc32(F.col(id_col), folds) != held_out), id_col, text_col, label_col)
    scored = score_toxicity(docs, model, id_col, text_col)
    return scored.select(
        id_col, F.coalesce(mod_crc32(F.col(id_col), folds) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "segments",
    )
