"""Requests to outside services and their recorded answers, around the tables that stand for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse

#: Ids per fetch, hits per search, waits and statuses of retries, methods that may be repeated.
BATCH, HITS, FIRST_WAIT_MS, MOST_WAIT_MS, RATE_WAIT_MS = 50, 5, 500, 10_000, 2_000
REPEATABLE = ("GET", "HEAD", "PATCH", "DELETE")


def kb_candidates(by_text: DataFrame, by_label: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """(name, ids): the first hits of the text search, then those of the label search, each once. Both: name, pos, id."""
    rows = by_text.withColumn("k", F.lit(0)).unionByName(by_label.withColumn("k", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*keys, "k").orderBy("pos", "id"))
    rows = rows.withColumn("n", place).where(F.col("n") <= HITS)
    return rows.groupBy(*keys).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("k", "n", "id"))), lambda x: x["id"])).alias("ids"))


def entity_batches(ids: DataFrame, column: str = "id", size: int = BATCH, buckets: int = 64) -> DataFrame:
    """(bucket, batch, ids): distinct ids in order, at most `size` in a fetch. Order and batches hold inside hash buckets, so no task sorts all ids."""
    one = ids.select(F.col(column).alias("id")).where("id IS NOT NULL").distinct().withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    n = F.row_number().over(Window.partitionBy("bucket").orderBy("id")) - 1
    return one.withColumn("batch", F.floor(n / size)).groupBy("bucket", "batch").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def suggestions(raw: DataFrame, response: str = "response") -> DataFrame:
    """raw's other columns and suggestions array<struct<name, domain>> of recorded answers; entries of another shape are left out."""
    v = F.coalesce(F.try_variant_get(F.try_parse_json(F.col(response)), "$", "array<variant>"), F.array().cast("array<variant>"))
    text = lambda x, f: F.when(F.schema_of_variant(F.try_variant_get(x, f"$.{f}", "variant")) == "STRING", F.try_variant_get(x, f"$.{f}", "string"))
    rows = F.transform(v, lambda x: F.struct(text(x, "name").alias("name"), text(x, "domain").alias("domain")))
    return raw.withColumn("suggestions", F.filter(rows, lambda s: s["name"].isNotNull() & s["domain"].isNotNull())).drop(response)


def website_query(name: Column, hint: Column) -> Column:
    return collapse(F.concat_ws(" ", name, F.coalesce(hint, F.lit("")), F.lit("official website")))


def prune_plan(plan: DataFrame, configured: DataFrame) -> DataFrame:
    """Tasks whose provider is configured; see plan_gaps for what is left out. configured: a row per provider, a handful."""
    return plan.join(F.broadcast(configured.select("provider").distinct()), "provider", "left_semi")


def plan_gaps(plan: DataFrame, configured: DataFrame) -> DataFrame:
    """(research_id, runnable, skipped, failure): how many tasks can run, which providers aren't configured, and why a research can't run at all."""
    known = F.broadcast(configured.select("provider").distinct().withColumn("known", F.lit(True)))
    rows = plan.join(known, "provider", "left").groupBy("research_id").agg(
        F.count("known").alias("runnable"), F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("provider")))).alias("skipped"))
    return rows.withColumn("failure", F.when(F.col("runnable") == 0, "No data sources are configured on this deployment."))


def feed_outcome(sites: DataFrame) -> DataFrame:
    """(research_id, failed, total, ok, warning) of feed requests (research_id, name, reason - null where it was read): all failed is a failure, some a warning."""
    bad = F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat("name", F.lit(": "), "reason"))))
    rows = sites.groupBy("research_id").agg(F.count("reason").alias("failed"), F.count(F.lit(1)).alias("total"), bad.alias("b"))
    text = F.concat(F.format_string("Could not read %d of %d news sites (", "failed", "total"), F.array_join("b", "; "), F.lit(")."))
    return rows.select("research_id", "failed", "total", (F.col("failed") < F.col("total")).alias("ok"), F.when((F.col("failed") > 0) & (F.col("failed") < F.col("total")), text).alias("warning"))


def error_kind(status: Column, error: Column | None = None, quota: tuple[int, ...] = ()) -> Column:
    """Why a request failed, null where it didn't: timeout or network by `error` (no answer came), else by status. quota: statuses of a used-up plan."""
    spent = status.isin(*quota) if quota else F.lit(False)
    kind = F.when(spent, "quota_exceeded").when(status == 429, "rate_limited").when(status.isin(401, 403), "unauthorized").when(~status.between(200, 299), "http")
    return kind if error is None else F.when(error.isNotNull(), F.when(error == "timeout", "timeout").otherwise("network")).otherwise(kind)


def failure_text(kind: Column, status: Column) -> Column:
    """A failure in words fit to show."""
    told = F.when(kind == "timeout", "timed out").when(kind == "network", "unreachable").when(kind == "malformed", "not a readable feed").when(kind == "rate_limited", "rate-limited")
    return F.when(kind.isNotNull(), told.when(status.isNotNull(), F.format_string("HTTP %d", status)).otherwise(kind))


def retry_wait_ms(status: Column, attempt: Column, retry_after_s: Column) -> Column:
    """How long to wait before the next attempt (attempt from 0); null where a repetition wouldn't help."""
    kind, wait = error_kind(status), FIRST_WAIT_MS * F.pow(F.lit(2), attempt)
    wait = F.when(kind == "rate_limited", F.coalesce(retry_after_s * 1000, F.greatest(wait, F.lit(RATE_WAIT_MS)))).otherwise(wait)
    return F.when((kind == "rate_limited") | (status >= 500), F.least(wait, F.lit(MOST_WAIT_MS)).cast("long"))


def is_repeatable(method: Column, upsert: Column, marked: Column) -> Column:
    m = F.upper(F.coalesce(method, F.lit("GET")))
    return F.coalesce(marked, F.lit(False)) | m.isin(*REPEATABLE) | ((m == "POST") & F.coalesce(upsert, F.lit(False)))


def vendor_schema(schema: dict) -> dict:
    """A JSON schema with upper-case type names, enums as a format, and the order of properties."""
    kind, text = schema["type"], {"description": schema["description"]} if schema.get("description") else {}
    if kind == "object":
        parts = {k: vendor_schema(v) for k, v in schema["properties"].items()}
        return {"type": "OBJECT", "properties": parts, "required": schema["required"], "propertyOrdering": list(parts)}
    if kind == "array":
        return {"type": "ARRAY", "items": vendor_schema(schema["items"])}
    return {"type": kind.upper()} | text | ({"format": "enum", "enum": schema["enum"]} if schema.get("enum") else {})
