"""From search plans and raw responses to candidate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_keywords
from ..functions.url import canonical_url, display_host, is_tracking

__all__ = ["canonical_url", "display_host", "is_tracking", "search_plan", "merge_candidates", "merge_stats", "top_per_site"]


def search_plan(researches: DataFrame) -> DataFrame:
    """(research_id, pos, provider, text, type, max_results): web 10, news 10, feeds 40, and web 10 with the focus where there is one.

    researches: research_id, query, focus. A null query gives no searches.
    """
    task = lambda p, t, k, n: F.struct(F.lit(p).alias("provider"), t.alias("text"), F.lit(k).alias("type"), F.lit(n).alias("max_results"))
    query, focus = F.col("query"), F.nullif(F.trim("focus"), F.lit(""))
    both = F.when(focus.isNotNull(), F.concat_ws(" ", query, focus))
    tasks = F.array(task("web", query, "web", 10), task("web", query, "news", 10), task("feeds", query, "news", 40), task("web", both, "web", 10))
    tasks = F.filter(tasks, lambda t: t["text"].isNotNull())
    return researches.where(query.isNotNull()).select("research_id", F.posexplode(tasks).alias("pos", "t")).select("research_id", "pos", "t.*")


def feed_requests(plan: DataFrame, sites: DataFrame) -> DataFrame:
    """One request per feed task and site with the URL of its search feed; tasks without a keyword ask nothing. sites has a few rows."""
    keyed = plan.where("provider = 'feeds'").withColumn("keywords", search_keywords(F.col("text"))).where("keywords IS NOT NULL")
    url = F.concat("base_url", F.lit("/?s="), F.url_encode("keywords"), F.lit("&feed=rss2"))
    return keyed.crossJoin(F.broadcast(sites)).select("research_id", "pos", "site_id", url.alias("feed_url"))


def top_per_site(items: DataFrame, per_site: int = 6, keys: tuple[str, ...] = ("research_id", "site_id"), order: str = "pos") -> DataFrame:
    """The first per_site items of each site."""
    w = Window.partitionBy(*keys).orderBy(order)
    return items.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_site).drop("__n")


def first_known(value: str, seq: Column) -> Column:
    """The first value that isn't null, in order of seq."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), seq))


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """One source per (research_id, canonical_url), in order of arrival.

    candidates: research_id, search_no, provider, query, pos (from 0), url, title, publisher, published_at, snippet, type, score.
    The first row gives the URL; each other field is the first that isn't null; a source is news if any row is. found_by lists
    every discovery in order. Rows without a canonical URL are left out. One aggregation, partial before the shuffle.
    """
    seq = F.struct("search_no", "pos")
    rows = candidates.withColumn("canonical_url", canonical_url(F.col("url"))).where("canonical_url IS NOT NULL")
    found = F.struct(F.col("search_no"), F.col("pos"), F.struct("provider", "query", "type", (F.col("pos") + 1).alias("rank"), "score").alias("d"))
    merged = rows.groupBy("research_id", "canonical_url").agg(
        F.min(seq).alias("seq"), F.min_by("url", seq).alias("url"), *[first_known(c, seq).alias(c) for c in ("title", "publisher", "published_at", "snippet")],
        F.when(F.max((F.col("type") == "news").cast("int")) == 1, F.lit("news")).otherwise(F.min_by("type", seq)).alias("type"),
        F.sort_array(F.collect_list(found)).alias("found"),
    )
    return merged.withColumn("found_by", F.transform("found", lambda x: x["d"])).drop("found")


def merge_stats(candidates: DataFrame) -> DataFrame:
    """(research_id, received, invalid_urls, duplicates)."""
    rows = candidates.withColumn("c", canonical_url(F.col("url")))
    return rows.groupBy("research_id").agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("c").isNull()).alias("invalid_urls"),
        (F.count("c") - F.countDistinct("c")).alias("duplicates"),
    )
