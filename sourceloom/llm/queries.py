"""The training-data queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontamination import CONTAMINATION_SQL, contamination
from .hard_negatives import NEGATIVES_SQL, hard_negatives
from .importance import RESAMPLE_SQL, importance_resample
from .jaccard_join import JACCARD_SQL, jaccard_join
from .mixing import MIX_SQL, mix_sources
from .mtree import TOP_K_SQL, exact_top_k
from .pii import BASE as PII_KINDS
from .pii import pii_spans, span_list
from .quality import quality
from .repeat_removal import REPEATS_SQL, repeat_removal
from .secrets import BASE as SECRET_KINDS
from .secrets import secret_spans
from .sketch_join import SKETCH_SQL, sketch_join
from .token_counts import token_counts
from .toxicity import toxicity


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def kind_counts(spans: str, kinds: tuple[str, ...]) -> list[Column]:
    of = lambda kind: F.filter(spans, lambda x: x["kind"] == kind)
    return [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]


def digest(spans: str) -> Column:
    return F.sha2(span_list(spans).cast("binary"), 256)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *kind_counts("base", PII_KINDS), digest("base").alias("base_sha256"), span_list("spans").alias("spans"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("segments").cast("long").alias("n_segments"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *kind_counts("base", SECRET_KINDS), digest("base").alias("base_sha256"), span_list("spans").alias("spans"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeat_removal(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_mix_sources": op3_mix_sources,
    "op4_personal_data": op4_personal_data,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_secrets": op8_secrets,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_repeat_removal": op10_repeat_removal,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_minhash": op12_minhash,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op3_mix_sources": MIX_SQL.format(docs="documents"),
    "op5_jaccard_join": JACCARD_SQL.format(docs="documents"),
    "op10_repeat_removal": REPEATS_SQL.format(docs="documents"),
    "op9_exact_top_k": TOP_K_SQL.format(vectors="embeddings"),
    "op7_decontamination": CONTAMINATION_SQL.format(docs="documents"),
    "op11_importance_resampling": RESAMPLE_SQL.format(docs="documents"),
    "op12_minhash": SKETCH_SQL.format(docs="documents"),
    "op13_hard_negatives": NEGATIVES_SQL.format(vectors="embeddings"),
}
