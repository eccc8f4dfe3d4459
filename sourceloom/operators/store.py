"""The write side on Parquet: idempotent inserts, logs, a cache with expiry, and atomic saves by publishing a version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..sources import versions

STALE_MS = 6 * 60 * 1000
TERMINAL = ("completed", "failed")
UUID = "^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def source_id(research_id: Column, canonical_url: Column) -> Column:
    """An id that depends on content alone, so that a repeated insert meets itself."""
    return F.sha2(F.concat_ws("|", research_id, canonical_url), 256)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("research_id", "canonical_url"), order: str | None = None) -> DataFrame:
    """existing and those rows of new whose keys it doesn't have; of several new rows with one key the first by order."""
    if order:
        w = Window.partitionBy(*keys).orderBy(order)
        new = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    else:
        new = new.dropDuplicates(list(keys))
    return existing.unionByName(new.join(existing.select(*keys), list(keys), "left_anti"))


def source_rows(stories: DataFrame) -> DataFrame:
    """Rows of the sources table: duplicates point to their primary and carry the story's label, with their own score in metadata.

    stories: research_id, canonical_url, primary_url (of the story), url, title, publisher, published_at, type, snippet, found_by, label, score, reason,
    keyword_score, reasons, title_truncated, match_reason, similarity.
    """
    dedup = F.when(F.col("match_reason").isNotNull(), F.struct(F.col("match_reason").alias("reason"), "similarity"))
    meta = F.struct("found_by", F.struct("keyword_score", "reasons").alias("relevance"), F.when(F.col("title_truncated"), F.lit(True)).alias("title_truncated"), dedup.alias("dedup"))
    own, lead = source_id(F.col("research_id"), F.col("canonical_url")), source_id(F.col("research_id"), F.col("primary_url"))
    return stories.select(
        own.alias("id"), "research_id", "url", "canonical_url", "title", "publisher", "published_at", F.col("type").alias("source_type"), F.col("snippet").alias("extracted_text"),
        F.to_json(meta).alias("metadata"), F.when(own != lead, lead).alias("duplicate_of"), F.col("score").alias("relevance_score"),
        (F.col("label") != "irrelevant").alias("is_relevant"), F.col("label").alias("relevance_label"), F.col("reason").alias("relevance_reason"),
    )


def latest(log: DataFrame, keys: tuple[str, ...], order: Column, *columns: str) -> DataFrame:
    """The last row's columns for each key of a log, in one partial aggregation."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("x")).select(*keys, "x.*")


def is_stale(status: Column, touched: Column, created: Column, now: Column) -> Column:
    """Whether a run that hasn't ended was last touched more than six minutes ago; pending ones count from their creation."""
    since = F.when(status == "pending", created).otherwise(touched)
    return ~status.isin(*TERMINAL) & (F.unix_millis(now) - F.unix_millis(since) > STALE_MS)


def cache_fresh(entries: DataFrame, now: Column) -> DataFrame:
    """The latest entry of each (provider, cache_key), if it hasn't expired."""
    last = latest(entries, ("provider", "cache_key"), F.struct("fetched_at", "expires_at"), "response", "fetched_at", "expires_at")
    return last.where(F.col("expires_at") > now)


def through_cache(requests: DataFrame, entries: DataFrame, fetched: DataFrame, now: Column, ttl_seconds: Column) -> tuple[DataFrame, DataFrame]:
    """(answers: provider, cache_key, response, from_cache; rows to append to entries) of requests (provider, cache_key).

    A fresh entry answers at once; for the others fetched (provider, cache_key, response) has what the provider said, and a request without either has no answer.
    Repeated requests are asked once.
    """
    keys = ["provider", "cache_key"]
    fresh = cache_fresh(entries, now).select(*keys, F.col("response").alias("held"), F.lit(True).alias("hit"))
    asked = requests.select(*keys).distinct().join(fresh, keys, "left").join(fetched.select(*keys, "response").dropDuplicates(keys), keys, "left")
    answers = asked.select(*keys, F.coalesce("held", F.when(F.col("hit").isNull(), F.col("response"))).alias("response"), F.coalesce("hit", F.lit(False)).alias("from_cache")).where("response IS NOT NULL")
    expires = F.timestamp_millis(F.unix_millis(now) + 1000 * ttl_seconds)
    return answers, answers.where("NOT from_cache").select(*keys, "response", now.alias("fetched_at"), expires.alias("expires_at"))


RUN_FIELDS = ("status", "constraints", "error_message", "completed_at")


def run_update(research: DataFrame, now: Column, **fields: Column) -> DataFrame:
    """A row of the run log for each research (research_id, seq of its last row): what has changed, null for the rest."""
    unknown = set(fields) - set(RUN_FIELDS)
    if unknown:
        raise KeyError(f"no such field of a run: {', '.join(sorted(unknown))}")
    none = {f: F.lit(None).cast("timestamp" if f == "completed_at" else "string") for f in RUN_FIELDS}
    return research.select("research_id", (F.col("seq") + 1).alias("seq"), now.alias("updated_at"), *[fields.get(f, none[f]).alias(f) for f in RUN_FIELDS])


def failed(research: DataFrame, now: Column, message: Column) -> DataFrame:
    return run_update(research, now, status=F.lit("failed"), error_message=message, completed_at=now)


def completed(research: DataFrame, now: Column) -> DataFrame:
    return run_update(research, now, status=F.lit("completed"), completed_at=now)


def run_state(log: DataFrame) -> DataFrame:
    """(research_id, seq, updated_at, RUN_FIELDS): the last known value of each field, in one partial aggregation."""
    known = lambda f: F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f)
    return log.groupBy("research_id").agg(F.max("seq").alias("seq"), F.max_by("updated_at", "seq").alias("updated_at"), *[known(f) for f in RUN_FIELDS])


def cache_sweep(entries: DataFrame, now: Column) -> DataFrame:
    return entries.where(F.col("expires_at") >= now)


def within_limit(rows: DataFrame, now: Column, limit: int = 20, created: str = "created_at", hours: int = 1) -> DataFrame:
    """(n, allowed): how many rows of the last hours there are, and whether one more is allowed."""
    recent = rows.where(F.col(created) >= now - F.expr(f"INTERVAL {hours} HOURS"))
    return recent.agg(F.count(F.lit(1)).alias("n")).withColumn("allowed", F.col("n") < limit)


def valid_input(query: Column, focus: Column) -> Column:
    """struct<query, focus> with white space collapsed; null unless the query has 3 to 500 characters and the focus at most 500."""
    q = F.trim(F.regexp_replace(query, r"[\s\x{00A0}]+", " "))
    f = F.nullif(F.trim(F.regexp_replace(focus, r"[\s\x{00A0}]+", " ")), F.lit(""))
    ok = F.length(q).between(3, 500) & (F.coalesce(F.length(f), F.lit(0)) <= 500)
    return F.when(ok, F.struct(q.alias("query"), f.alias("focus")))


def is_uuid(c: Column) -> Column:
    return c.rlike(UUID)


def violations(sources: DataFrame, entities: DataFrame) -> DataFrame:
    """(rule, n): rows that break the tables' constraints."""
    rule = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
    twice = lambda df, *k: df.groupBy(*k).count().where("count > 1")
    checks = [
        rule("unique source", twice(sources, "research_id", "canonical_url")), rule("own duplicate", sources.where("duplicate_of = id")),
        rule("score", sources.where("relevance_score < 0 OR relevance_score > 1")), rule("label", sources.where(~F.col("relevance_label").isin(L.LABELS))),
        rule("unique domain", twice(entities.where("domain IS NOT NULL"), "research_id", "domain")), rule("lower domain", entities.where("domain <> lower(domain)")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


class Store(versions.Store):
    """Published versions of the library's tables."""

    def save_report(self, analysis: DataFrame, companies: DataFrame, sources: DataFrame) -> str:
        """Publish the reports of researches in one step: entities, findings and those of their citations whose source belongs to the research.

        A research has one report: where one of these has it in the version that the save is based on, nothing is published. The version is taken
        before it is looked at, so of two writers of a research one is refused, and writers of others lose nothing.
        """
        payload = save_payload(analysis, companies)
        payload["finding_sources"] = valid_links(payload["finding_sources"], sources)
        payload["reports"] = analysis.select("research_id").unionByName(companies.select("research_id")).distinct()

        def once(at: versions.Version) -> None:
            if self.has("reports", at):
                again = payload["reports"].join(self.read("reports", at), "research_id", "left_semi").limit(3).collect()
                if again:
                    raise ValueError(f"a report is saved already: {', '.join(str(r.research_id) for r in again)}")

        return self.append(payload, once)


def claim(log: DataFrame, research_id: str, now: Column) -> DataFrame:
    """The log row that claims a pending research - no row if its latest status is another. Append it to the log."""
    own = latest(log.where(F.col("research_id") == research_id), ("research_id",), F.col("seq"), "status", "seq")
    return own.where("status = 'pending'").select("research_id", (F.col("seq") + 1).alias("seq"), F.lit("planning").alias("status"), now.alias("ts"))


def save_payload(analysis: DataFrame, companies: DataFrame) -> dict[str, DataFrame]:
    """Tables entities, findings and finding_sources of a report.

    analysis: rows of parse_analysis. companies: merged ones (research_id, pos, name, names, domain, country, focus, ids). The first company with a
    domain keeps it; a development's company is found by any merged name in either case.
    """
    first = F.row_number().over(Window.partitionBy("research_id", "domain").orderBy("pos")) == 1
    entities = companies.withColumn("key", F.concat(F.lit("c"), F.col("pos"))).withColumn("domain", F.when(first, F.col("domain")))
    names = entities.select("research_id", "key", "pos", F.explode("names").alias("n")).groupBy("research_id", F.lower("n").alias("lname")).agg(F.min_by("key", "pos").alias("entity_key"))
    kinds = F.create_map(*[F.lit(x) for kv in {"key_findings": "key_finding", "developments": "development", "trends": "trend"}.items() for x in kv])
    found = analysis.where("section <> 'companies'").withColumn("type", kinds[F.col("section")]).withColumn("lname", F.lower("company"))
    found = found.join(names, ["research_id", "lname"], "left").withColumn("finding_id", F.sha2(F.concat_ws("|", "research_id", "section", "at"), 256))
    findings = found.select("finding_id", "research_id", "entity_key", "type", "title", "summary", F.col("event_date").alias("occurred_at"), F.col("n").alias("ordinal"))
    links = found.select("finding_id", "research_id", F.explode("ids").alias("source_id"))
    return {"entities": entities, "findings": findings, "finding_sources": links}


def valid_links(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Links whose source belongs to the same research."""
    return links.join(sources.select("research_id", F.col("id").alias("source_id")), ["research_id", "source_id"], "left_semi")
