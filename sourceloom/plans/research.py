"""The deterministic run: from recorded search results to labelled, stored stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import title_tokens
from ..operators.analysis import overlay
from ..operators.ingest import merge_candidates
from ..operators.normalize import normalize_sources
from ..operators.relevance import contexts, fallback_label, hard_rule, join_research, judge_stories, score_relevance
from ..operators.stories import story_clusters, with_tokens
from ..operators.store import source_rows
from ..sources.scratch import staged


def primary_first(sources: DataFrame) -> DataFrame:
    """sources (canonical_url once a research) with seq: most searches, dated, with a snippet, news, then arrival.

    Ranks come from what decides alone, sorted by range; a stretch's first rank is what lies before it in the research. No task holds all sources of one.
    """
    keys = sources.select("research_id", "canonical_url", (-F.size("found_by")).alias("k1"), F.col("published_at").isNull().alias("k2"), F.col("snippet").isNull().alias("k3"), (F.col("type") != "news").alias("k4"), F.col("arrival").alias("k5"))
    named = ["k1", "k2", "k3", "k4", "k5"]
    dealt = staged(keys.repartitionByRange("research_id", *named).withColumn("part", F.spark_partition_id()), "order")
    before = F.coalesce(F.sum("n").over(W.partitionBy("research_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("research_id", "part").agg(F.count(F.lit(1)).alias("n")).select("research_id", "part", before.alias("before"))
    place = dealt.withColumn("place", F.row_number().over(W.partitionBy("research_id", "part").orderBy(*named)))
    ranks = place.join(starts, ["research_id", "part"]).select("research_id", "canonical_url", (F.col("before") + F.col("place")).cast("long").alias("seq"))
    return sources.join(ranks, ["research_id", "canonical_url"])


def run_research(researches: DataFrame, candidates: DataFrame, now: Column, classified: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables merged, sources (with seq), clusters, scored, stories and rows from researches (research_id, query, focus) and candidates.

    What several steps read is written to the shared folder once: sources, tokens, clusters and scores.
    classified: model answers (research_id, id, label, score, reason), id the canonical URL of a primary; without them the keyword labels stand.
    """
    researches = researches.withColumn("research_id", F.col("research_id").cast("string"))
    merged = merge_candidates(candidates.withColumn("research_id", F.col("research_id").cast("string"))).withColumnRenamed("seq", "arrival")
    sources = staged(primary_first(staged(normalize_sources(staged(merged, "merged"), now), "normalized")), "sources")
    asked = researches.select("research_id", title_tokens(F.concat_ws(" ", "query", F.coalesce("focus", F.lit("")))).alias("asked"))
    tokens = staged(with_tokens(join_research(sources, asked, "left"), "title", "asked"), "tokens")
    clusters = staged(story_clusters(tokens), "clusters")
    scored = score_relevance(sources.withColumn("found_by_count", F.size("found_by")), contexts(researches), now)
    scored = staged(scored, "scored")
    members = scored.join(clusters.withColumnRenamed("reason", "match_reason"), ["research_id", "seq"])
    stories = judge_stories(members)
    lead = members.where("seq = primary_seq").select("research_id", "primary_seq", F.col("canonical_url").alias("id"), "title", "url", "reasons")
    labelled = stories.join(lead, ["research_id", "primary_seq"]).withColumn("f", fallback_label(F.col("score"), F.col("relevant"), F.col("reasons")))
    labelled = labelled.select("research_id", "primary_seq", "id", "title", "url", "f.label", F.col("f.score").alias("score"), "f.reason", "promoted")
    if classified is not None:
        labelled = overlay(labelled, classified)
    labelled = hard_rule(labelled)
    own = labelled.select("research_id", "primary_seq", F.col("id").alias("primary_url"), "label", F.col("score").alias("story_score"), "reason")
    full = members.withColumnRenamed("score", "keyword_score").join(own, ["research_id", "primary_seq"]).withColumnRenamed("story_score", "score")
    return {"merged": merged, "sources": sources, "clusters": clusters, "scored": scored, "stories": labelled, "rows": source_rows(full)}
