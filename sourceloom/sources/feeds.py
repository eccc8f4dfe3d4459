"""Raw responses of outside services, read as tables: search results, feeds, the knowledge base, name suggestions.

Each parser takes a table of recorded responses, so nothing here calls a service. A response that isn't of the expected
shape is malformed: it gives no rows here and a row in `malformed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, html_to_text
from ..functions.url import display_host

def _text(v: Column, path: str) -> Column:
    """A string field of a variant; null if it is missing, of another type or blank."""
    value = F.try_variant_get(v, path, "string")
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", blank_to_null(value))


def search_results(raw: DataFrame, response: str = "response") -> DataFrame:
    """Candidates of web and news searches from raw (research_id, search_no, provider, query, type, response JSON)."""
    parsed = raw.withColumn("v", F.try_parse_json(F.col(response)))
    items = parsed.withColumn("items", F.try_variant_get("v", "$.results", "array<variant>")).where("items IS NOT NULL")
    rows = items.select("research_id", "search_no", "provider", "query", "type", F.posexplode("items").alias("pos", "r"))
    url = _text(F.col("r"), "$.url")
    number = F.schema_of_variant(F.try_variant_get("r", "$.score", "variant")) != "STRING"
    rows = rows.select(
        "research_id", "search_no", "provider", "query", url.alias("url"), _text(F.col("r"), "$.title").alias("title"), display_host(url).alias("publisher"),
        _text(F.col("r"), "$.published_date").alias("published_at"), _text(F.col("r"), "$.content").alias("snippet"), "type",
        F.when(number, F.try_variant_get("r", "$.score", "double")).alias("score"), "pos",
    ).where("url IS NOT NULL")
    # positions count kept results
    place = F.row_number().over(Window.partitionBy("research_id", "search_no").orderBy("pos")) - 1
    return rows.withColumn("pos", place)


def malformed(raw: DataFrame, response: str = "response") -> DataFrame:
    """Search responses without an array of results."""
    return raw.where(F.try_variant_get(F.try_parse_json(F.col(response)), "$.results", "array<variant>").isNull())


def feed_time(c: Column) -> Column:
    """RFC 822 and ISO dates as times; null for others."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},?\s+", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s(?:GMT|UTC|UT|Z)$", " +0000"), r"\s+", " ")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z")), F.try_to_timestamp(c))


def feed_items(raw: DataFrame, xml: str = "xml") -> DataFrame:
    """raw's columns and, per item of an RSS 2.0 feed, pos, url, title, snippet (600 characters), published_at. Items without a link are dropped."""
    shape = "struct<channel:struct<item:array<struct<title:string,link:string,description:string,pubDate:string>>>>"
    keep = [c for c in raw.columns if c != xml]
    doc = raw.withColumn("d", F.from_xml(F.col(xml), F.lit(shape), {"mode": "PERMISSIVE"})).where(F.col(xml).contains("<channel"))
    rows = doc.select(*keep, F.posexplode("d.channel.item").alias("pos", "i"))
    text = lambda f: F.nullif(html_to_text(F.col(f"i.{f}")), F.lit(""))
    rows = rows.select(*keep, "pos", blank_to_null(F.col("i.link")).alias("url"), text("title").alias("title"), F.left(text("description"), F.lit(600)).alias("snippet"), feed_time(F.col("i.pubDate")).alias("published_at"))
    return rows.where("url IS NOT NULL")


_CLAIM = "array<struct<mainsnak:struct<datavalue:struct<value:variant>>,rank:string>>"
_ENTITY = f"map<string,struct<id:string,missing:string,labels:map<string,struct<value:string>>,aliases:map<string,array<struct<value:string>>>,descriptions:map<string,struct<value:string>>,claims:map<string,{_CLAIM}>>>"


def kb_entities(raw: DataFrame, response: str = "response") -> DataFrame:
    """(id, label, aliases, description, instance_of, country_ids, websites, inception_year) of knowledge-base responses.

    Missing entities and deprecated claims are left out; an id that several responses hold counts once.
    """
    got = raw.select(F.from_json(F.col(response), f"struct<entities:{_ENTITY}>").alias("d")).select(F.explode("d.entities").alias("k", "e"))
    got = got.where(F.col("e.id").isNotNull() & F.col("e.missing").isNull())

    def values(prop: str) -> Column:
        live = F.filter(F.coalesce(F.try_element_at(F.col("e.claims"), F.lit(prop)), F.array().cast(_CLAIM)), lambda c: F.coalesce(c["rank"], F.lit("")) != "deprecated")
        return F.transform(live, lambda c: c["mainsnak"]["datavalue"]["value"])

    ids = lambda p: F.filter(F.transform(values(p), lambda v: F.try_variant_get(v, "$.id", "string")), lambda x: x.isNotNull())
    plain = lambda p: F.filter(F.transform(values(p), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda x: x.isNotNull())
    year = F.transform(values("P571"), lambda v: F.regexp_extract(F.coalesce(F.try_variant_get(v, "$.time", "string"), F.lit("")), r"^\+?(\d{4})-", 1))
    english = lambda m: F.try_element_at(F.col(m), F.lit("en"))
    return got.select(
        F.col("e.id").alias("id"), english("e.labels")["value"].alias("label"),
        F.coalesce(F.transform(english("e.aliases"), lambda a: a["value"]), F.array().cast("array<string>")).alias("aliases"),
        english("e.descriptions")["value"].alias("description"), ids("P31").alias("instance_of"), ids("P17").alias("country_ids"), plain("P856").alias("websites"),
        F.try_element_at(F.filter(year, lambda y: y != ""), F.lit(1)).cast("int").alias("inception_year"),
    ).dropDuplicates(["id"])


def first_success(attempts: DataFrame, keys: tuple[str, ...] = ("research_id", "batch")) -> DataFrame:
    """Of ordered attempts (attempt_no, provider, text, ok) per key the first that succeeded; keys where none did keep null."""
    ok = F.when(F.col("ok"), F.col("attempt_no"))
    return attempts.groupBy(*keys).agg(F.min_by("provider", ok).alias("provider"), F.min_by("text", ok).alias("text"), F.count_if(~F.col("ok")).alias("failed"))


def provider_order(config: str | None, known: tuple[str, ...] = ("gemini", "groq")) -> list[str]:
    """Providers of a comma-separated setting in order, each once, unknown ones dropped; all known ones by default."""
    names = [x.strip().lower() for x in (config or ",".join(known)).split(",")]
    return [x for x in dict.fromkeys(names) if x in known]


def ddl_of(schema: dict) -> str:
    """Spark DDL of a JSON-schema subset: object, array, string, number, integer, boolean."""
    kind = schema["type"]
    if kind == "object":
        return "struct<" + ",".join(f"{k}:{ddl_of(v)}" for k, v in schema["properties"].items()) + ">"
    return f"array<{ddl_of(schema['items'])}>" if kind == "array" else {"string": "string", "number": "double", "integer": "bigint", "boolean": "boolean"}[kind]
