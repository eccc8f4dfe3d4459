"""Benchmark decontamination: a broadcast hash set of the benchmark's windows of words, DataFrame operations alone.

Every window of `width` consecutive benchmark words (a shorter item is one window of its own length) becomes a 64-bit
hash. Each document's words are generated in place, once for all widths that occur, the windows that start at each word are
hashed in the same stage, and hits are compared word by word. Only hits leave the task that reads the document.

A set of windows too large to broadcast is joined by a shuffle of hashes and positions, without words; the texts of
documents that some hash hits are read again and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged, text_of, word_array

#: What lies between words: ASCII that is neither a digit nor a letter, after lower-casing.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The set of windows is broadcast up to so many and so many characters; a larger one is joined by a shuffle on the hash.
BROADCAST_WINDOWS, BROADCAST_CHARS = 1_000_000, 200_000_000
#: Documents with hits that a broadcast may hold when hits are compared with texts behind a shuffle, and their hits.
BROADCAST_DOCS, BROADCAST_HITS = 200_000, 5_000_000


def words_of(text: Column) -> Column:
    return word_array(ascii_lower(text), GAP)


def window_hash(words: Column, at: Column, width: int) -> Column:
    """Hash of the width and the `width` words from position `at`, counted from 0."""
    return F.xxhash64(F.lit(width), *[F.get(words, at + k) for k in range(width)])


def hashed_positions(docs: DataFrame, widths: list[int], kept: tuple[str, ...]) -> DataFrame:
    """Columns `kept` of rows (doc_id, th, ws), at, w and h of every window of the given widths: words are generated once."""
    at = docs.where(F.size("ws") >= min(widths)).select("doc_id", "th", "ws", F.posexplode("ws").alias("at", "word"))
    if len(widths) == 1:
        w = widths[0]
        return at.where(F.col("at") <= F.size("ws") - w).select(*kept, "at", F.lit(w).alias("w"), window_hash(F.col("ws"), F.col("at"), w).alias("h"))
    fits = lambda w: F.col("at") <= F.size("ws") - w
    # all in generated code: an expression outside of it would make the stage hold a copy of the word array for each word
    each = F.array(*[F.when(fits(w), F.struct(F.lit(w).alias("w"), window_hash(F.col("ws"), F.col("at"), w).alias("h"))) for w in widths])
    return at.select(*kept, "at", F.explode(each).alias("x")).where(F.col("x").isNotNull()).select(*kept, "at", "x.w", "x.h")


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """(width, grams, items): each different window, its words joined by a blank, and the sorted ids that hold it."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(text_of(text_col)).alias("ws"))
    items = items.where(F.size("ws") > 0).withColumn("width", F.least(F.size("ws"), F.lit(width)))
    at = F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("width") + 1))
    grams = items.select("item", "width", "ws", at.alias("at")).select("item", "width", F.slice("ws", F.col("at"), F.col("width")).alias("g"))
    by_gram = grams.groupBy("width", F.array_join("g", " ").alias("grams")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return by_gram


def keyed(windows: DataFrame, widths: list[int]) -> DataFrame:
    """(h, grams, items) of windows of the given widths."""
    words = F.split("grams", " ")
    h = F.lit(None).cast("long")
    for w in widths:
        h = F.when(F.col("width") == w, window_hash(words, F.lit(0), w)).otherwise(h)
    return windows.select(h.alias("h"), "grams", "items")


def spans_of(hits: DataFrame) -> DataFrame:
    """(doc_id, th, span, items) of rows (doc_id, th, ws, at, w, grams, items) whose words are the window's."""
    same = hits.where(F.array_join(F.slice("ws", F.col("at") + 1, F.col("w")), " ") == F.col("grams"))
    return same.select("doc_id", "th", F.struct(F.col("at").alias("s"), (F.col("at") + F.col("w")).alias("e")).alias("span"), "items")


def broadcast_hits(base: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    return spans_of(hashed_positions(base, widths, ("doc_id", "th", "ws")).join(F.broadcast(keyed(windows, widths)), "h"))


def shuffled_hits(base: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    """What crosses the shuffle is an id, two hashes and a position a window; words are compared in documents that have hits.

    A window that very many documents hold is one hash: hits are semi-joined, which Spark's adaptive join splits by map output, and the
    names of windows are looked up again after they are known to be there.
    """
    own = keyed(windows, widths)
    at = hashed_positions(base, widths, ("doc_id", "th")).join(own.select("h").distinct(), "h", "left_semi")
    by_doc = at.groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "w", "h")).alias("hits"))
    by_doc = staged(by_doc.select(F.col("doc_id").alias("of"), F.col("th").alias("ot"), "hits"), "hit-documents")
    size = by_doc.agg(F.count(F.lit(1)), F.sum(F.size("hits"))).first()
    by_doc = F.broadcast(by_doc) if size[0] <= BROADCAST_DOCS and (size[1] or 0) <= BROADCAST_HITS else by_doc
    rows = base.join(by_doc, F.equal_null("doc_id", "of") & (F.col("th") == F.col("ot")))
    rows = rows.select("doc_id", "th", "ws", F.explode("hits").alias("x")).select("doc_id", "th", F.slice("ws", F.col("x.at") + 1, F.col("x.w")).alias("g"), "x.at", "x.w", "x.h")
    rows = rows.select("doc_id", "th", "at", "w", "h", F.array_join("g", " ").alias("g"))
    same = rows.join(own, "h").where("g = grams")
    return same.select("doc_id", "th", F.struct(F.col("at").alias("s"), (F.col("at") + F.col("w")).alias("e")).alias("span"), "items")


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, items (sorted ids as text), hits (array of [start, end) in words), text_hash (xxhash64).

    A word is hit if it lies in any occurrence of a benchmark window. Null texts have no words. Rows that repeat an id
    are judged each by its own text; an empty benchmark hits nothing; other columns are not read. The result of long texts is
    exact, as hits are merged as intervals.
    """
    windows = staged(benchmark_windows(benchmark, item_col, item_text_col, width), "windows")
    size_of = F.length("grams") + F.aggregate("items", F.lit(0), lambda a, x: a + F.length(x))
    stats = windows.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.sum(size_of).alias("chars")).collect()  # at most `width` rows
    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), words_of(text).alias("ws"))
    small = sum(r["n"] for r in stats) <= BROADCAST_WINDOWS and sum(r["chars"] for r in stats) <= BROADCAST_CHARS
    found = (broadcast_hits if small else shuffled_hits)(base, windows, sorted(r["width"] for r in stats)) if stats else None
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), F.size(words_of(text)).cast("long").alias("n_words"))
    if found is None:
        none = F.array().cast("array<struct<s:int,e:int>>")
        return plain.select(F.col("doc_id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), none.alias("hits"), F.col("th").alias("text_hash"))
    by_doc = found.groupBy("doc_id", "th").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.array_sort(F.collect_set("span")).alias("spans"))
    # spans in order of start: each adds what lies beyond the furthest end so far
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["e"]).alias("end"))
    by_doc = by_doc.withColumn("n_hit", F.aggregate("spans", zero, step)["n"])
    by_doc = by_doc.select(F.col("doc_id").alias("of"), F.col("th").alias("ot"), "n_hit", "items", "spans")
    joined = plain.join(by_doc, F.equal_null("doc_id", "of") & (F.col("th") == F.col("ot")), "left")
    return joined.select(
        F.col("doc_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("hits"), F.col("th").alias("text_hash"),
    )


#: DuckDB SQL for the digest of contamination() over {docs}; windows of 10 words.
CONTAMINATION_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM {docs}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM benchmark),
b1 AS (SELECT item, ws, least(len(ws), 10) AS w, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, w, array_to_string(ws[p:p + w - 1], ' ') AS g FROM b1),
widths AS (SELECT DISTINCT w FROM bw),
dp AS (SELECT rid, w, ws, unnest(range(1, len(ws) - w + 2)) AS p FROM d, widths WHERE len(ws) >= w),
hit AS (SELECT rid, p, bw.w, item FROM dp JOIN bw ON dp.w = bw.w AND array_to_string(ws[p:p + dp.w - 1], ' ') = bw.g),
cov AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + w)) AS q FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)
"""
