"""Target-distribution importance resampling over hashed word n-grams.

Identical texts collapse first: rows are grouped by their full text, so that a text's features are hashed once however many
rows hold it, and its counts are multiplied by its number of rows. Bucket counts of the documents and of the target give each
bucket a gain, a text's weight is the floored mean of the gains of its features, and weights go back to the rows by the
text's digest. Only then does each row get noise of its own, from its id, which turns the highest scores into a draw
without replacement.

What crosses a shuffle: each task's different texts once, bucket counts of fixed size, and a digest, an id and four numbers a row.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, staged, text_of

BUCKETS = 10_000
#: What lies between words (ASCII that is neither a digit nor a letter) becomes a blank, A-Z become small; other bytes stay.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Places of a row inside its task, as monotonically_increasing_id numbers them.
PLACE_BITS = 33


def feature_buckets(text: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(words, bucket of every run of one and of two consecutive words, repeats included) of a text in UTF-8."""
    words = text.translate(WORDS).split()
    one = [zlib.crc32(w) for w in words]
    # the checksum of "a b" goes on from that of "a"
    two = [zlib.crc32(b" " + w, c) for w, c in zip(words[1:], one, strict=False)]
    return len(words), np.array(one + two, np.uint32) % np.uint32(buckets)


def hashed_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(digest, m, words, features) of each different text: m rows hold it; features are its buckets as packed uint16."""
    texts = docs.select(text_of(F.col(text_col).cast("string")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("m"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # what is held at a time
                part = batch.slice(i, 256)
                found = [feature_buckets(t.as_py().encode()) for t in part.column(0)]
                n, packed = [x for x, _ in found], [x.astype(np.uint16).tobytes() for _, x in found]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], ["digest", "m", "words", "features"])

    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    return staged(texts.select("text", digest.alias("digest"), "m").mapInArrow(features, "digest binary, m long, words long, features binary"), "texts")


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs among all rows: a vector of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            m = batch.column(0).to_numpy(zero_copy_only=False)
            packed = batch.column(1).to_pylist()
            single = b"".join(x for x, k in zip(packed, m, strict=True) if k == 1)
            total += np.bincount(np.frombuffer(single, np.uint16), minlength=BUCKETS)
            for x, k in zip(packed, m.tolist(), strict=True):
                if k > 1:  # each of its counts stands for k rows
                    at, n = np.unique(np.frombuffer(x, np.uint16), return_counts=True)
                    total[at] += n * k
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    rows = texts.select("m", "features").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target against that of the source."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(((t + 1) * s_all) / ((s + 1) * t_all))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def text_weights(texts: DataFrame, gains: np.ndarray) -> DataFrame:
    """(digest, n, words, n_features, weight) of each different text, n the number of its rows."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.frombuffer(x, np.uint16) for x in batch.column(3).to_pylist()]
            n = [len(x) for x in packed]
            weight = [int(gains[x].sum()) // len(x) if len(x) else 0 for x in packed]  # integers: // goes down
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], ["digest", "n", "words", "n_features", "weight"])

    return staged(texts.select("digest", "m", "words", "features").mapInArrow(weigh, "digest binary, n long, words long, n_features long, weight long"), "weights")


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """rows with their place, from 1, in the given total order: sorted by ranges, each range counted, none gathered in one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", PLACE_BITS)
    before, offsets = 0, []
    for r in sorted(at.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a range
        offsets.append((r["part"], before))
        before += r["n"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part long, before long"))
    place = F.col("before") + F.col("__at").bitwiseAND((1 << PLACE_BITS) - 1) + 1
    return at.withColumn("part", part).join(offsets, "part").withColumn(name, place).drop("part", "before", "__at")


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: str = "7", id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: id, n_features, weight, score, rank (null for rows not drawn), all numbers long.

    Of the N rows of at least `least_words` words the floor(percent * N / 100) highest scores are drawn, ties to the smaller id, a null id
    last. A null text is the empty one: no features, weight 0; its noise is that of its id, a null id's that of an empty
    name. Rows that repeat an id and a text are rows of their own with equal scores and adjoining ranks; ids that repeat with other texts
    share the noise alone. An empty target gives every bucket the count 0; an empty table gives no rows; other columns are not read.
    """
    texts = hashed_texts(docs, text_col)
    gains = bucket_gains(bucket_counts(texts), bucket_counts(hashed_texts(target, target_text_col)))
    weights = text_weights(texts, gains)
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text_of(F.col(text_col).cast("string")).cast("binary"), 256)).alias("digest"))
    rows = join_by_key(rows, weights, "digest")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = rows.select("id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("words") >= least_words).alias("able"))
    # equal rows are told apart by their place alone, so that many of them can lie in several ranges
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    rows = staged(rows, "scored")
    drawn = percent * rows.where("able").count() // 100
    rows = ranked(rows, [F.col("able").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("tie")])
    return rows.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


#: DuckDB SQL for importance_resample with its default parameters over {docs}. The checksum of a feature goes byte by byte, for all features at once.
RESAMPLE_SQL = r"""
WITH RECURSIVE bits AS (SELECT b, b::BIGINT AS c, 0 AS k FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
texts AS (SELECT 's' AS side, row_number() OVER () AS rid, doc_id, text FROM {docs} UNION ALL SELECT 't', -row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, rid, doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM texts),
f AS (SELECT side, rid, unnest(ws) AS g FROM w UNION ALL SELECT side, rid, unnest([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) FROM w),
g AS MATERIALIZED (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM f)),
step AS (SELECT g, x, 4294967295::BIGINT AS c, 0 AS i FROM g
  UNION ALL SELECT g, x, xor(c >> 8, t[(xor(c, ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) & 255) + 1]), i + 1 FROM step, crc WHERE 2 * i < length(x)),
h AS MATERIALIZED (SELECT g, xor(c, 4294967295) % 10000 AS bucket FROM step WHERE 2 * i = length(x)),
n AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM f JOIN h USING (g) GROUP BY 1),
every AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM n),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM n, every),
weight AS (SELECT rid, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN h USING (g) JOIN gain USING (bucket) WHERE side = 's' GROUP BY 1),
d AS (SELECT rid, doc_id, len(ws) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN weight USING (rid) WHERE side = 's'),
z AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score FROM d),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank, count(*) OVER () AS n FROM z WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END::BIGINT AS rank FROM z LEFT JOIN r USING (rid)
"""
