"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone.

A source's target is its share of all words, stopped at `most` times its own words (water filling). Each document gets
the whole part of target / source size as certain copies. The fraction f is shared out by unequal probabilities
p = min(1, c w): w is a document's weight (the root of its words, unless a column says otherwise), and c is such that the words
expected are f times the source's; who reaches 1 is certain too. The others are ranked by (u / (1 - u)) / (p / (1 - p)), u a
uniform number made from id and text, and the lowest ranks are taken until the source's words are filled, so the sample has
a fixed size in words, up to half a document.

Rows that repeat an id and a text are numbered, so each has its own u: the numbers come from counts of runs of rows, and
no row's place in a file changes what the result holds.

No source meets in one task: ranks are cut into about sqrt(n) buckets a source, words are summed by bucket, and only
the rows of the bucket in which the source's words are filled are sorted. The result is a rank per source to take documents
up to. The one table that is ordered as a whole has a row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, staged, text_of

WEIGHTS = (1, 2, 3)
#: Repeated rows are numbered in runs of so many rows, and the runs by their counts.
RUN_ROWS = 1 << 16
#: Names of repeated rows that a broadcast may hold, eight bytes each.
BROADCAST_NAMES = 1_000_000


def uniform(doc_id: Column, tag: Column, nth: Column, seed: str) -> Column:
    """A number in (0, 1) with 52 bits from the md5 of seed, id, text and repetition: the same in every run and engine."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), tag, nth.cast("string"))
    whole = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double")
    return (whole + F.lit(0.5)) / F.lit(float(2**52))


def repeated_names(sizes: DataFrame) -> DataFrame:
    """(name) of the rows that are not the only ones with their id, source and text; rows without words need no number."""
    return staged(sizes.where("size > 0").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "repeated")


def numbered(rows: DataFrame, repeated: DataFrame, n_repeated: int) -> DataFrame:
    """rows (name, row, ...) with nth, 0, 1, ... among those of one name, in runs of bounded size however many share it."""
    repeated = F.broadcast(repeated) if n_repeated <= BROADCAST_NAMES else repeated
    marked = rows.join(repeated.withColumn("again", F.lit(True)), "name", "left")
    single = marked.where(F.col("again").isNull()).drop("again").withColumn("nth", F.lit(0).cast("long"))
    multi = marked.where("again").drop("again").withColumn("run", F.floor(F.col("row") / RUN_ROWS))
    before = Window.partitionBy("name").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = multi.groupBy("name", "run").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    multi = multi.join(counts.drop("n"), ["name", "run"])
    multi = multi.withColumn("nth", F.col("first") + F.row_number().over(Window.partitionBy("name", "run").orderBy("row")) - 1)
    return single.unionByName(multi.drop("run", "first"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    Sources in code point order, null last, weigh weights[0], weights[1], ... repeating. Targets share all words by
    weight; none exceeds `most` times its source's words, and the excess is shared again by weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    by_source = by_source.withColumn("w", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    by_source = by_source.withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levelled = by_source.withColumn("level", left / F.sum("w").over(after))
    target = F.least(F.col("cap"), F.max("level").over(all_rows) * F.col("w"))
    return levelled.select("source", "source_size", "n_docs", target.alias("target"))


def with_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (of, source_size, n_docs, target) with f and c from rows (source, size, weight).

    Words are summed by source and weight first, so what is ordered has a row per different weight. c is the greatest of the
    values that make the words expected right if all heavier documents are certain.
    """
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("f", share - F.floor(share))
    by_weight = sizes.where("size > 0").groupBy("source", "weight").agg(F.sum("size").alias("words"))
    by_weight = by_weight.join(targets.select("of", "source_size", "f"), F.equal_null("source", "of"))
    order = Window.partitionBy("of").orderBy(F.col("weight").desc())
    heavier = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.col("f") * F.col("source_size") - heavier) / F.sum(F.col("words") * F.col("weight")).over(order.rowsBetween(0, Window.unboundedFollowing))
    rates = by_weight.select("source", level.alias("level")).groupBy(F.col("source").alias("ro")).agg(F.max("level").alias("c"))
    return targets.join(rates, F.equal_null("of", "ro"), "left").drop("ro").withColumn("c", F.coalesce("c", F.lit(0.0)))


def rounded(weight: Column) -> Column:
    """A positive weight to four digits, so that a source has a bounded number of different ones."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(weight)) - 3)
    return F.round(weight / unit) * unit


def ranked(rows: DataFrame, seed: str) -> DataFrame:
    """rows (doc_id, size, weight, tag, nth, and their source's source_size, n_docs, target, f, c) with certain copies, odds and bucket.

    A row without words has no odds.
    """
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.col("c") * F.col("weight")).otherwise(0.0))
    rows = rows.withColumn("certain", F.floor(share).cast("long") + (F.col("p") >= 1).cast("long"))
    rows = rows.withColumn("u", uniform(F.col("doc_id"), F.col("tag"), F.col("nth"), seed))
    odds = F.when((F.col("p") > 0) & (F.col("p") < 1), F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p"))))
    # odds times the source's own odds, back on (0, 1): uniform where all p are equal, so buckets are even
    usual = F.least(F.greatest("f", F.lit(1e-9)), F.lit(1 - 1e-9))
    scaled = F.col("odds") * usual / (1 - usual)
    n_buckets = F.ceil(F.sqrt("n_docs"))
    rows = rows.withColumn("odds", odds)
    bucket = F.least(F.floor(scaled / (1 + scaled) * n_buckets), n_buckets - 1).cast("long")
    return rows.withColumn("bucket", F.coalesce(bucket, n_buckets.cast("long"))).drop("p", "u")


def rank_key() -> Column:
    return F.struct("odds", "doc_id", "size")


def mixing_plan(sizes: DataFrame, seed: str = "mix", most: int = 3) -> DataFrame:
    """A row per source from rows (doc_id, source, size, weight, tag, nth): (of, source_size, n_docs, target, f, c, cut, last).

    Documents in buckets before `cut` are taken once more than their certain copies, those in it up to the rank `last`. Only the
    rows of one bucket a source, about sqrt(n) of them, are ever sorted.
    """
    targets = staged(source_targets(sizes, most=most).withColumnRenamed("source", "of"), "targets")
    targets = staged(with_rates(sizes, targets), "rates")
    rows = ranked(sizes.join(targets, F.equal_null("source", "of")), seed)
    by_bucket = rows.groupBy("of", "bucket").agg(F.sum("size").alias("words"), F.sum(F.col("certain") * F.col("size")).alias("sure"), F.first("target").alias("target"))
    order = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = by_bucket.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    by_bucket = by_bucket.withColumn("need", F.col("target") - F.sum("sure").over(Window.partitionBy("of")))
    cuts = by_bucket.where(F.col("before") < F.col("need")).groupBy("of").agg(F.max_by(F.struct("bucket", "before", "need"), "bucket").alias("x"))
    cuts = staged(cuts.select("of", F.col("x.bucket").alias("cut"), F.col("x.before").alias("before"), F.col("x.need").alias("need")), "cuts")
    own = cuts.select(F.col("of").alias("co"), "cut", "before", "need")
    near = rows.join(own, F.equal_null("of", "co") & (F.col("bucket") == F.col("cut"))).where(F.col("odds").isNotNull())
    inside = Window.partitionBy("of").orderBy("odds", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    last = near.withColumn("so_far", so_far).where(F.col("so_far") + F.col("size") / 2 < F.col("need"))
    last = last.groupBy(F.col("of").alias("lo")).agg(F.max(rank_key()).alias("last"))
    plan = targets.join(own.select("co", "cut"), F.equal_null("of", "co"), "left").join(last, F.equal_null("of", "lo"), "left")
    return staged(plan.select("of", "source_size", "n_docs", "target", "f", "c", F.coalesce("cut", F.lit(-1).cast("long")).alias("cut"), "last"), "plan")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weight_col: str | None = None, seed: str = "mix", most: int = 3, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of docs: id, source, `keep` columns, size (words), source_size, target, taken (words), copies.

    Null text: size 0, nothing taken. Null source: a source of its own, last in order. Rows that share an id but not a text are
    drawn apart, and so are rows that repeat both: however many there are, the words taken come near the target. An empty
    table gives no rows. weight_col (positive, null as 1, read to four digits) takes the place of the root of the words; whole copies don't depend on it. No row gets more than `most` copies. The rows of docs are never shuffled but for those that repeat: the plan
    that they are joined with has a row per source.
    """
    size = n_words(text_of(text_col))
    weight = F.sqrt(size.cast("double")) if weight_col is None else rounded(F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)))
    tag = F.md5(text_of(text_col).cast("binary"))
    doc_id, source = F.col(id_col), F.col(source_col).cast("string")
    own = [
        doc_id.alias("doc_id"), source.alias("source"), size.alias("size"), weight.alias("weight"), tag.alias("tag"),
        F.xxhash64(doc_id, source, tag).alias("name"), F.monotonically_increasing_id().alias("row"),
    ]
    sizes = staged(docs.select(*own), "sizes")
    kept = [F.col(c).alias(f"__{c}") for c in keep]
    repeated = repeated_names(sizes)
    n_repeated = repeated.count()
    if n_repeated:
        sizes = staged(numbered(sizes, repeated, n_repeated), "numbered")
        rows = numbered(staged(docs.select(*own, *kept), "rows"), repeated, n_repeated) if keep else sizes
    else:
        sizes = sizes.withColumn("nth", F.lit(0).cast("long"))
        rows = docs.select(*own, *kept).withColumn("nth", F.lit(0).cast("long")) if keep else sizes
    plan = mixing_plan(sizes, seed, most)
    rows = ranked(rows.join(plan, F.equal_null("source", "of")), seed)
    upto = (F.col("bucket") == F.col("cut")) & F.col("last").isNotNull() & (rank_key() <= F.col("last"))
    extra = F.col("odds").isNotNull() & ((F.col("bucket") < F.col("cut")) | F.coalesce(upto, F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("certain") + extra.cast("long")).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("copies", copies)
    return rows.select(
        F.col("doc_id").alias(id_col), F.col("source").alias(source_col), *[F.col(f"__{c}").alias(c) for c in keep],
        "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies",
    )


#: DuckDB SQL for mix_sources without a weight column over {docs}.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS tag,
    row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1 AS nth FROM {docs}),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
s1 AS (SELECT *, (place % 3 + 1)::DOUBLE AS w, (source_size * 3)::DOUBLE AS cap, (source_size * 3)::DOUBLE / (place % 3 + 1)::DOUBLE AS ratio FROM s0),
s2 AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM s2),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS share, share - floor(share) AS f FROM s3),
c0 AS (SELECT source, sqrt(size::DOUBLE) AS w, sum(size) AS words FROM d WHERE size > 0 GROUP BY 1, 2),
c1 AS (SELECT c0.source, (f * source_size - coalesce(sum(words) OVER (PARTITION BY c0.source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(words * w) OVER (PARTITION BY c0.source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c0 JOIN s4 ON c0.source IS NOT DISTINCT FROM s4.source),
c2 AS (SELECT source, max(level) AS c FROM c1 GROUP BY source),
r0 AS (SELECT d.doc_id, d.source, d.size, source_size, target, share, CASE WHEN size > 0 THEN c * sqrt(size::DOUBLE) ELSE 0.0 END AS p,
    (('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || tag || '|' || nth), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source LEFT JOIN c2 ON d.source IS NOT DISTINCT FROM c2.source),
r1 AS (SELECT *, floor(share)::BIGINT + (p >= 1)::INT AS certain, CASE WHEN p > 0 AND p < 1 THEN u / (1 - u) / (p / (1 - p)) END AS odds FROM r0),
r2 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far,
    sum(certain * size) OVER (PARTITION BY source) AS sure FROM r1)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size > 0 THEN certain + (odds IS NOT NULL AND so_far + size / 2.0 < target - sure)::INT ELSE 0 END * size)::BIGINT AS taken FROM r2
"""
