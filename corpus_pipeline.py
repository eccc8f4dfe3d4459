"""A corpus pipeline of five stages: each works on all that the one before kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm.common import staged, table
from sourceloom.llm.decontamination import contamination
from sourceloom.llm.jaccard_join import jaccard_join
from sourceloom.llm.mixing import mix_sources
from sourceloom.llm.pii import masked, pii_spans
from sourceloom.llm.quality import quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of a set of decisions that a broadcast may hold; beyond, texts are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows that gone names by doc_id and hash of the text."""
    gone = staged(gone.select(F.col("doc_id").alias("gid"), F.col("text_hash").alias("gh")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    same = F.equal_null("doc_id", "gid") & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("gh"))
    return docs.join(gone, same, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Its labels are those of the labels table outside the held-out fold."""
    scored = quality(docs, table(spark, sf_dir, "labels"), keep=COLUMNS[1:])
    return scored.where("predicted = 1").select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked at a Jaccard similarity of 0.8 on five-word shingles stays: that of the least id.

    Texts without words are linked with nothing and stay. Of rows that repeat an id and a text one stays.
    """
    joined = jaccard_join(docs, k=5, num=80, den=100)
    joined = staged(joined.select("doc_id", "component_id", "component_key", "text_hash"), "joined")
    leads = F.equal_null("doc_id", "component_id")
    others = joined.where(~leads)
    # rows of one component that share its least id, with the same text or another one that is linked: the least hash stays
    tied = joined.where(leads & F.col("component_key").isNotNull()).groupBy("component_key").agg(F.min("text_hash").alias("first"), F.count(F.lit(1)).alias("n"))
    tied = staged(tied.where("n > 1"), "tied")
    kept = without(docs, others)
    if tied.isEmpty():
        return kept.select(*COLUMNS)
    rows = joined.where(leads).join(tied, "component_key")
    kept = without(kept, rows.where("text_hash <> first"))
    firsts = staged(rows.where("text_hash = first").select("doc_id", "text_hash"), "firsts")
    again = kept.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    named = firsts.select(F.col("doc_id").alias("gid"), F.col("text_hash").alias("gh")).distinct()
    again = again.join(named, F.equal_null("doc_id", "gid") & (F.col("text_hash") == F.col("gh")), "left_semi")
    return without(kept, firsts).select(*COLUMNS).unionByName(again.dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any window of ten words of a benchmark item go."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("n_hit > 0")).select(*COLUMNS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in angle brackets; n_chars follows. No document goes."""
    found = pii_spans(docs, keep=COLUMNS[1:])
    changed = F.size("spans") > 0
    found = found.withColumn("text", F.when(changed, masked(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: documents with the number of copies and of words taken; those not taken go."""
    mixed = mix_sources(docs, keep=("text", "lang", "n_chars"))
    return mixed.where("copies > 0").select(*COLUMNS, "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", personal_data_stage),
    ("mixing sources to target weights", mixing_stage),
]
#: The classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage{i}")
    return docs
