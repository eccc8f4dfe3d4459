"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of bytes. A passage becomes frequencies of pairs of byte classes and a
few word statistics; an encoder, a gated attention over the passages and a logistic head are trained together on
document labels by gradient descent. A document's score is the head's answer for the attention-weighted sum of its passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, mod_crc32
from .textbytes import FOLD, IS_SPACE, buffers, chunks, word_hashes

PASSAGE = 512
CHUNK_BYTES = 1 << 20
N_CLASSES = 12
CLASS = np.full(256, 9, np.int64)
CLASS[IS_SPACE], CLASS[10], CLASS[97:123], CLASS[65:91], CLASS[48:58] = 0, 1, 2, 3, 4
CLASS[46], CLASS[44], CLASS[[33, 63]], CLASS[[34, 39, 40, 41, 91, 93]] = 5, 6, 7, 8
CLASS[192:], CLASS[128:192] = 10, 11
N_FEATURES = N_CLASSES**2 + 6
#: Labelled documents that a fit sees at most, each with all its passages, and bytes of their texts: the driver holds some four times as much.
MAX_DOCS, MAX_BYTES = 6000, 64_000_000


def passage_features(data: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Features of n passages; of gives each byte's passage, in order."""
    size = np.bincount(of, minlength=n).astype(float)
    kind = CLASS[data]
    same = of[:-1] == of[1:]
    cell = of[:-1][same] * N_CLASSES**2 + kind[:-1][same] * N_CLASSES + kind[1:][same]
    pairs = np.bincount(cell, minlength=n * N_CLASSES**2).reshape(n, -1) / np.maximum(size - 1, 1)[:, None]
    cuts = np.flatnonzero(~same) + 1
    start, length, word = word_hashes(FOLD[data], ~IS_SPACE[data], cuts)
    at = of[start]
    words = np.maximum(np.bincount(at, minlength=n), 1)
    again = (word[1:] == word[:-1]) & (at[1:] == at[:-1])
    order = np.lexsort((word, at))
    w, a = word[order], at[order]
    distinct = np.ones(len(w), bool)
    distinct[1:] = (w[1:] != w[:-1]) | (a[1:] != a[:-1])
    more = np.stack([
        np.bincount(at[1:][again], minlength=n) / words, np.bincount(a[distinct], minlength=n) / words, np.bincount(at, length, n) / words / 10,
        np.bincount(at, kind[start] == 3, n) / words, np.minimum(size / PASSAGE, 1), (size == 0).astype(float),
    ], axis=1)
    return np.concatenate([np.sqrt(pairs), more], axis=1)


def bags(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, passages, features of each text's passages, row after row) in chunks; an empty text is one empty passage.

    A text longer than a chunk comes in several items with the same first row.
    """
    data, offsets = buffers(column)
    step = CHUNK_BYTES // PASSAGE * PASSAGE
    for i, j in chunks(offsets, CHUNK_BYTES):
        for a in range(int(offsets[i]), max(int(offsets[j]), int(offsets[i]) + 1), step if j == i + 1 else 1 << 62):
            b = min(a + step, int(offsets[j])) if j == i + 1 else int(offsets[j])
            edges = np.concatenate([[a], offsets[i + 1 : j], [b]])
            lengths = np.diff(edges)
            count = np.maximum(-(-lengths // PASSAGE), 1)
            first = np.cumsum(count) - count
            row = np.repeat(np.arange(j - i), lengths)
            of = first[row] + (np.arange(b - a) - (edges[:-1] - a)[row]) // PASSAGE
            yield i, count, passage_features(data[a:b], of, int(count.sum()))


class AttentionModel:
    """Encoder tanh(W x), attention softmax of a . (tanh(V h) * sigmoid(U h)), head sigmoid(c . z + bias)."""

    def __init__(self, n_in: int = N_FEATURES, width: int = 16, gate: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(n_in), np.ones(n_in)
        self.p = {
            "W": rng.normal(0, 1 / np.sqrt(n_in), (n_in, width)), "b": np.zeros(width), "V": rng.normal(0, 0.3, (width, gate)),
            "U": rng.normal(0, 0.3, (width, gate)), "a": rng.normal(0, 0.3, gate), "c": np.zeros(width), "d": np.zeros(1),
        }

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage encodings, attention logits)."""
        h = np.tanh((x - self.mean) / self.scale @ self.p["W"] + self.p["b"])
        gated = np.tanh(h @ self.p["V"]) / (1 + np.exp(-h @ self.p["U"]))
        return h, gated @ self.p["a"]

    def pool(self, h: np.ndarray, logit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(attention weights, bag representations) for bags that start at `first`."""
        count = np.diff(np.append(first, len(h)))
        e = np.exp(logit - np.repeat(np.maximum.reduceat(logit, first), count))
        w = e / np.repeat(np.add.reduceat(e, first), count)
        return w, np.add.reduceat(w[:, None] * h, first)

    def score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.p["c"] + self.p["d"][0], -40, 40)))

    def gradient(self, xs: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean log loss over bags of scaled passages xs that start at `first`, its gradient by parameter)."""
        p = self.p
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(xs))))
        h = np.tanh(xs @ p["W"] + p["b"])
        tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        w, z = self.pool(h, (tv * su) @ p["a"], first)
        score = self.score(z)
        err = (score - y) / len(y)
        by_bag = (err[:, None] * p["c"])[bag]
        dw = (by_bag * h).sum(1)
        dlogit = w * (dw - np.add.reduceat(w * dw, first)[bag])
        dgate = dlogit[:, None] * p["a"]
        dtv, dsu = dgate * su * (1 - tv**2), dgate * tv * su * (1 - su)
        dh = (by_bag * w[:, None] + dtv @ p["V"].T + dsu @ p["U"].T) * (1 - h**2)
        grad = {"W": xs.T @ dh, "b": dh.sum(0), "V": h.T @ dtv, "U": h.T @ dsu, "a": ((tv * su) * dlogit[:, None]).sum(0), "c": z.T @ err, "d": np.array([err.sum()])}
        loss = -np.mean(y * np.log(score + 1e-12) + (1 - y) * np.log(1 - score + 1e-12))
        return float(loss), grad

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.02, decay: float = 1e-4) -> AttentionModel:
        """Adam on the mean log loss over all bags at once; the same bags give the same model."""
        self.mean, self.scale = x.mean(0), x.std(0) + 0.05
        xs = (x - self.mean) / self.scale
        share = y.mean()
        self.p["d"][0] = np.log((share + 0.01) / (1.01 - share))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            for k, g in self.gradient(xs, first, y)[1].items():
                g = g + decay * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                self.p[k] -= rate * m[k] / (1 - 0.9**t) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> AttentionModel:
    """Fit on at most max_docs labelled documents (see labelled_sample) and on all their passages.

    Of these documents, in order of hashes, each stays that still fits into max_bytes of text with those before it that stay; where none fits, the smallest does.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, max_docs).withColumn("h", F.xxhash64("id", "text"))
    within, left = [], max_bytes
    # at most about max_docs rows of a hash and a length; repeated (id, text) rows are one already
    sizes = sorted(sample.select("h", F.octet_length("text").alias("size")).collect())
    for r in sizes:
        if r["size"] <= left:
            within.append((r["h"],))
            left -= r["size"]
    if sizes and not within:
        within.append((min(sizes, key=lambda r: (r["size"], r["h"]))["h"],))
    chosen = sample.join(F.broadcast(docs.sparkSession.createDataFrame(within, "h long")), "h", "left_semi").select("id", "y", "text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[int, list[np.ndarray]] = {}
            for i, count, x in bags(batch.column(2)):
                for r, (a, n) in enumerate(zip(np.cumsum(count) - count, count, strict=True)):
                    parts.setdefault(i + r, []).append(x[a : a + n].astype(np.float32))
            rows = sorted(parts)
            whole = [np.concatenate(parts[r]) for r in rows]
            pick = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick).cast(pa.string()), batch.column(1).take(pick), pa.array([x.tobytes() for x in whole], pa.binary())], ["id", "y", "x"])

    got = chosen.mapInArrow(featurise, "id string, y int, x binary").collect()  # at most max_docs bags of max_bytes of text
    got.sort(key=lambda r: (r["id"], r["x"]))
    model = AttentionModel()
    if got:
        x = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in got]
        first = np.cumsum([len(b) for b in x]) - [len(b) for b in x]
        model.fit(np.concatenate(x).astype(float), first, np.array([r["y"] for r in got], float))
    return model


def score_quality(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' id, `keep` columns and score, row by row.

    Every passage of the whole text counts. A null or empty text is one empty passage and has a score like any other; without any
    label all scores are one half; repeated rows are answered each; an empty table gives no rows.
    """
    own = docs.select(F.col(text_col).cast("string").alias("__text"), id_col, *keep)
    schema = T.StructType([*own.schema.fields[1:], T.StructField("score", T.DoubleType())])
    names = schema.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            # a text that comes in several items: its row, greatest logit, sum of weights and of weighted encodings so far
            held: tuple[int, float, float, np.ndarray] | None = None
            for i, count, x in bags(batch.column(0)):
                h, logit = model.encode(x)
                if len(count) == 1:
                    top = max(float(logit.max()), held[1] if held and held[0] == i else -np.inf)
                    e = np.exp(logit - top)
                    total, z = float(e.sum()), e @ h
                    if held and held[0] == i:
                        back = np.exp(held[1] - top)
                        total, z = total + back * held[2], z + back * held[3]
                    held = (i, top, total, z)
                    z = (z / total)[None]
                else:
                    _, z = model.pool(h, logit, np.cumsum(count) - count)
                out[i : i + len(count)] = model.score(z)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out)], names)

    return own.mapInArrow(score, schema)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), label_col: str = "quality") -> DataFrame:
    """id, `keep` columns, held_out, score, predicted: fitted on labels outside the held-out fold, applied to every row of docs.

    The fold of an id is crc32 of its text modulo `folds`; a null id is in no fold. See score_quality for odd rows.
    """
    model = fit_quality(docs, labels.where(mod_crc32(F.col(id_col), folds) != held_out), id_col, text_col, label_col)
    scored = score_quality(docs, model, id_col, text_col, keep)
    return scored.select(
        id_col, *keep, F.coalesce(mod_crc32(F.col(id_col), folds) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
