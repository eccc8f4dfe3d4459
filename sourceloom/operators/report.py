"""The read side: summaries, citations, rankings and tables of a report."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import lexicon as L
from ..functions.geo import norm_country

LABEL_RANK = {"direct": 0, "contextual": 1, "unclassified": 2}


def display_label(label: Column, is_relevant: Column) -> Column:
    """The stored label; without one irrelevant if the old flag says so, else unclassified."""
    return F.coalesce(label, F.when(F.equal_null(is_relevant, F.lit(False)), "irrelevant"), F.lit("unclassified"))


def group_stories(sources: DataFrame) -> DataFrame:
    """sources (research_id, id, duplicate_of, pos) with story_id: the primary, or the source itself where that is missing. story_pos is the
    place of the story's first source."""
    ids = sources.select("research_id", F.col("id").alias("pid"), F.lit(True).alias("known"))
    rows = sources.join(ids, (sources["research_id"] == ids["research_id"]) & (sources["duplicate_of"] == ids["pid"]), "left").select(sources["*"], "known")
    rows = rows.withColumn("story_id", F.when(F.col("known"), F.col("duplicate_of")).otherwise(F.col("id"))).drop("known")
    return rows.withColumn("story_pos", F.min("pos").over(Window.partitionBy("research_id", "story_id")))


def with_company(findings: DataFrame, entities: DataFrame) -> DataFrame:
    """findings (research_id, entity_key, ...) with the name of the company they are about, null where there is none."""
    names = entities.select("research_id", F.col("key").alias("entity_key"), F.col("name").alias("company"))
    return findings.join(names, ["research_id", "entity_key"], "left")


def citation_numbers(stories: DataFrame) -> DataFrame:
    """stories (research_id, story_id, label, story_pos) with number: direct, contextual, unclassified, each in order; the rest has none."""
    rank = F.create_map(*[F.lit(x) for kv in LABEL_RANK.items() for x in kv])
    shown = stories.where(F.col("label").isin(list(LABEL_RANK)))
    w = Window.partitionBy("research_id").orderBy(rank[F.col("label")], "story_pos", "story_id")
    return shown.withColumn("number", F.row_number().over(w))


def funnel(sources: DataFrame) -> DataFrame:
    """(research_id, collected, stories, direct, contextual, filtered) from sources with story_id and label, primaries marked by id = story_id."""
    primary = F.col("id") == F.col("story_id")
    of = lambda x: F.count_if(primary & (F.col("label") == x))
    return sources.groupBy("research_id").agg(
        F.count(F.lit(1)).alias("collected"), F.count_if(primary).alias("stories"), of("direct").alias("direct"), of("contextual").alias("contextual"), of("irrelevant").alias("filtered"))


def with_children(parents: DataFrame, children: DataFrame, key: str, child: str, name: str) -> DataFrame:
    """parents with the sorted distinct children of each, an empty list where there are none."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_set(child)).alias(name))
    joined = parents.join(lists, key, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def history(parents: DataFrame, counts: dict[str, DataFrame], key: str, newest: str, limit: int = 50) -> DataFrame:
    """The newest parents with the number of rows that each table of counts has for them, pre-aggregated before it is joined."""
    out = parents.orderBy(F.col(newest).desc(), F.col(key)).limit(limit)
    for name, table in counts.items():
        out = out.join(table.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def sources_order() -> list[Column]:
    return [F.col("published_at").desc_nulls_last(), F.col("created_at").asc()]


def findings_order() -> list[Column]:
    return [F.col("occurred_at").desc_nulls_last(), F.col("ordinal").asc()]


def focus_stem(word: str) -> str:
    w = word.lower()
    for end in ("ics", "ic", "ing", "ed", "s"):
        if w.endswith(end) and len(w) - len(end) >= 4:
            return w[: -len(end)]
    return w


def about_topic(focus: Column, topic: str) -> Column:
    """0 if a focus is about a topic, or there is no topic; 1 if not, or the focus is unknown."""
    words = [w for w in re.split(r"[^\w]+|_+", topic) if len(w) >= 2]
    if not topic.strip():
        return F.lit(0)
    if not words:
        return F.when(F.coalesce(focus, F.lit("")) == "", 1).otherwise(0)
    tokens = F.split(F.lower(focus), r"[^\p{L}\p{N}]+")
    hit = F.lit(False)
    for w in words:
        hit = hit | (geo.mentions(focus, [w]) if len(w) <= 3 else _starts(tokens, focus_stem(w)))
    return F.when(F.coalesce(focus, F.lit("")) == "", 1).when(hit, 0).otherwise(1)


def _starts(tokens: Column, stem: str) -> Column:
    return F.exists(tokens, lambda t: t.startswith(stem))


def in_geography(country: Column, geography: list[str]) -> Column:
    """0 in one of the places or without any, 1 unknown, 2 elsewhere."""
    if not geography:
        return F.lit(0)
    phrases = list(dict.fromkeys(x for g in geography for x in [*geo.place_phrases(g), geo.norm_place(g)]))
    return F.when(F.coalesce(country, F.lit("")) == "", 1).when(norm_country(country).isin(phrases), 0).otherwise(2)


def rank_companies(companies: DataFrame, entity_type: str = "any", geography: list[str] | None = None, topic: str = "", keys: tuple[str, ...] = ("research_id",)) -> DataFrame:
    """companies (entity_type, country, focus, confidence, citations, pos) with rank: the wanted kind, the place, the topic, the confidence, citations, order."""
    grade = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).when(F.col("confidence") == "low", 2).otherwise(3)
    kind = F.lit(0) if entity_type == "any" else F.when(F.col("entity_type") == entity_type, 0).otherwise(1)
    rows = companies.withColumns({"__k": kind, "__g": in_geography(F.col("country"), geography or []), "__t": about_topic(F.col("focus"), topic), "__c": grade})
    w = Window.partitionBy(*keys).orderBy("__k", "__g", "__t", "__c", F.col("citations").desc(), "pos")
    return rows.withColumn("rank", F.row_number().over(w)).drop("__k", "__g", "__t", "__c")


def filter_companies(companies: DataFrame, text: str = "", high_only: bool = False) -> DataFrame:
    """Companies whose name, country, focus or domain holds a text in any case, those of high evidence alone if wanted."""
    hit = F.lit(False)
    for c in ("name", "country", "focus", "domain"):
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.strip().lower())), F.lit(False))
    rows = companies.where(hit) if text.strip() else companies
    return rows.where("confidence = 'high'") if high_only else rows


def by_name(companies: DataFrame, column: str = "name") -> DataFrame:
    """In dictionary order of a column, rows without it last."""
    return companies.orderBy(F.collate(F.col(column), "UNICODE").asc_nulls_last(), "pos")


def set_aside_reason(stored: Column, off_topic: Column, reasons: Column) -> Column:
    words = F.nullif(F.array_join(F.filter(reasons, lambda r: ~r.startswith("found by")), "; "), F.lit(""))
    return F.coalesce(stored, F.when(off_topic, "off topic"), words, F.lit("weak match for the question"))


def split_companies(ranked: DataFrame, entity_type: str, keys: tuple[str, ...] = ("research_id",)) -> DataFrame:
    """ranked with part: 'main' or 'ecosystem', the latter for other kinds if a kind is wanted and any company is classified."""
    any_ = F.max(F.col("entity_type").isNotNull()).over(Window.partitionBy(*keys))
    other = F.lit(entity_type != "any") & any_ & ~F.equal_null(F.col("entity_type"), F.lit(entity_type))
    return ranked.withColumn("part", F.when(other, "ecosystem").otherwise("main"))


def evidence_histogram(companies: DataFrame) -> DataFrame:
    of = lambda x: F.count_if(F.col("confidence") == x).alias(x)
    return companies.groupBy("research_id").agg(of("high"), of("medium"), of("low"))


def landing(parents: DataFrame, limit: int = 12, most: int = 4) -> DataFrame:
    """The newest completed researches that have an overview: most of the newest `limit`."""
    newest = [F.col("created_at").desc(), F.col("research_id")]
    return parents.where("status = 'completed'").orderBy(*newest).limit(limit).where("overview IS NOT NULL").orderBy(*newest).limit(most)


TYPE_LABELS = {t: t.replace("_", " ").capitalize() for t in L.ENTITY_TYPES}


def citation_chips(items: DataFrame, numbers: DataFrame, key: str = "item_id") -> DataFrame:
    """(item_id, numbers): the distinct citation numbers of items' sources in order. items: research_id, item_id, source_id; numbers: research_id, source_id, number."""
    found = items.join(numbers, ["research_id", "source_id"])
    return found.groupBy("research_id", key).agg(F.array_sort(F.collect_set("number")).alias("numbers"))


def story_evidence(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """(research_id, company_no, urls, text): all outlets' URLs and texts of the stories that a company's citations belong to.

    cited: research_id, company_no, source_id (a primary). sources: research_id, id, story_id, url, title, snippet.
    """
    own = sources.select("research_id", F.col("story_id").alias("source_id"), "url", F.concat_ws(" ", "title", "snippet").alias("t"))
    rows = cited.distinct().join(own, ["research_id", "source_id"])
    return rows.groupBy("research_id", "company_no").agg(F.array_sort(F.collect_set("url")).alias("urls"), F.array_join(F.array_sort(F.collect_set("t")), "\n").alias("text"))


def resolution_stats(companies: DataFrame, merged: DataFrame) -> DataFrame:
    """(research_id, resolved, ambiguous, unresolved, sources, wikidata, clearbit, search, merged) over the companies that are left.

    companies: research_id, status, website_source. merged: research_id, n - how many were taken in by others.
    """
    of = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    counts = companies.groupBy("research_id").agg(*[of("status", v) for v in ("resolved", "ambiguous", "unresolved")], *[of("website_source", v) for v in ("sources", "wikidata", "clearbit", "search")])
    return counts.join(merged.select("research_id", F.col("n").alias("merged")), "research_id", "left").withColumn("merged", F.coalesce("merged", F.lit(0).cast("long")))


def company_rows(entities: DataFrame) -> DataFrame:
    """Companies as shown: type_label (none for other), website_label, evidence text and kb_link.

    entities: name, entity_type, country, description, domain, website_source, signals, status, kb_id, kb_label, kb_description.
    """
    labels = F.create_map(*[F.lit(x) for k, v in TYPE_LABELS.items() if k != "other" for x in (k, v)])
    # Where a website came from, as shown.
    sites = {"sources": "Website from the collected sources", "wikidata": "Website from Wikidata", "clearbit": "Website from Clearbit (name match)", "search": "Website from web search (name match)"}
    site = F.try_element_at(F.create_map(*[F.lit(x) for kv in sites.items() for x in kv]), F.col("website_source"))
    known = (F.col("status") == "resolved") & F.col("kb_id").isNotNull()
    about = F.concat(F.lit("Wikidata "), "kb_id", F.coalesce(F.concat(F.lit(" ("), "kb_label", F.lit(")")), F.lit("")), F.lit(": "), F.coalesce("kb_description", F.lit("")))
    said = F.when(F.size("signals") > 0, F.concat(F.lit("Evidence: "), F.array_join("signals", "; ")))
    return entities.select(
        "name", F.try_element_at(labels, F.col("entity_type")).alias("type_label"), "country", F.col("description").alias("focus"), "domain", site.alias("website_label"),
        F.concat_ws("\n", said, F.when(known, about)).alias("evidence"), F.when(known, F.concat(F.lit("https://www.wikidata.org/wiki/"), "kb_id")).alias("kb_link"))


def results_collected(events: DataFrame, fallback: DataFrame) -> DataFrame:
    """(research_id, collected): what the first processing event (research_id, id, stage, received) says, else the fallback (research_id, n)."""
    first = events.where((F.col("stage") == "processing") & F.col("received").isNotNull()).groupBy("research_id").agg(F.min_by("received", "id").alias("received"))
    return fallback.join(first, "research_id", "left").select("research_id", F.coalesce("received", "n").alias("collected"))


def run_summary(duration: Column, analyzed: Column, provider: Column) -> Column:
    """40s · 39 sources analyzed · Gemini"""
    names = F.create_map(F.lit("gemini"), F.lit("Gemini"), F.lit("groq"), F.lit("Groq"))
    return F.nullif(F.concat_ws(" · ", duration, F.when(analyzed > 0, F.concat(analyzed, F.lit(" sources analyzed"))), F.coalesce(F.try_element_at(names, provider), provider)), F.lit(""))
