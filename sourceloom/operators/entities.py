"""Organisations: which knowledge-base entity a name is, what its website is, and how well it is supported."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.geo import norm_country
from ..functions.url import affix_names, domain_matches_name, label_matches_names, name_keys, registrable_domain, registrable_domains

_WB, _WE = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# Words of organisations, in descriptions and in labels of classes.
ORG_WORDS = rf"(?i){_WB}(company|startup|firm|provider|platform|bank|business|enterprise|fintech|manufacturer|developer|organi[sz]ation|corporation|conglomerate){_WE}"
CLASS_WORDS = rf"(?i){_WB}(compan(y|ies)|startup|firm|corporation|business|enterprise|bank|organi[sz]ation){_WE}"
#: Score and lead that decide, age of a startup at most, lookups that cost.
ACCEPT, LEAD, STARTUP_YEARS, PAID = 3, 2, 15, 3
STRINGS = "array<string>"


def _empty(c: str | Column) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.array().cast(STRINGS))


def official_domain(urls: Column, name: Column) -> Column:
    """The first URL's registrable domain that is nobody else's and fits the name."""
    domains = registrable_domains(_empty(urls))
    return F.try_element_at(F.filter(domains, lambda d: d.isNotNull() & ~d.isin(L.NOT_OFFICIAL) & domain_matches_name(d, name)), F.lit(1))


def country_tld(domain: Column) -> Column:
    tld = F.element_at(F.split(domain, r"\."), -1)
    return F.when((F.length(tld) == 2) & ~tld.isin(L.GENERIC_TLDS), tld)


def suggested_domain(suggestions: Column, name: Column, country: Column) -> Column:
    """The one domain left of suggestions array<struct<name, domain>>: equal names, fitting domains, no other country's code."""
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in L.COUNTRY_TLD.items() for x in kv]), F.lower(country))
    key = lambda n: F.element_at(name_keys(n), -1)  # noqa: E731  the name without corporate words
    same = F.filter(suggestions, lambda s: key(s["name"]) == key(name))
    domains = F.filter(F.transform(same, lambda s: registrable_domain(s["domain"])), lambda d: d.isNotNull() & ~d.isin(L.NOT_OFFICIAL) & domain_matches_name(d, name))
    domains = F.array_distinct(F.filter(domains, lambda d: own.isNull() | country_tld(d).isNull() | (country_tld(d) == own)))
    local = F.filter(domains, lambda d: country_tld(d) == own)
    return F.when(F.size(domains) == 1, domains[0]).when((F.size(domains) > 1) & (F.size(local) == 1), local[0])


def context_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(L.CONTEXT_STOPWORDS)))


def with_labels(entities: DataFrame, labels: DataFrame) -> DataFrame:
    """entities with country_labels and class_labels, arrays of the labels (id, label) of their country_ids and instance_of, in order."""

    def named(df: DataFrame, ids: str, out: str) -> DataFrame:
        flat = df.select("id", F.posexplode_outer(ids).alias("k", "lid"))
        got = flat.join(labels.select(F.col("id").alias("lid"), F.col("label").alias("l")), "lid", "left")
        per = got.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("l").isNotNull(), F.struct("k", "l")))), lambda x: x["l"]).alias(out))
        return df.join(per, "id", "left")

    return named(named(entities, "country_ids", "country_labels"), "instance_of", "class_labels")


def score_candidates(pairs: DataFrame) -> DataFrame:
    """pairs of a company (name, country, focus, domain, context) and an entity (label, aliases, description, instance_of, country_labels,
    class_labels, websites) with score, signals, matched_country and rejected; score is null where rejected."""
    col, n = F.col, lambda c, k: F.when(c, k).otherwise(0)
    # what several rules use is a column of its own, and a pair that is rejected goes no further
    names = F.filter(F.concat(F.array("label"), _empty("aliases")), lambda x: F.coalesce(x, F.lit("")) != "")
    rows = pairs.withColumns({"__keys": name_keys(col("name")), "__names": names})
    rows = rows.withColumn("__named", F.exists("__names", lambda x: F.arrays_overlap(name_keys(x), col("__keys"))))
    about = F.coalesce("description", F.lit(""))
    is_org = F.arrays_overlap(_empty("instance_of"), F.array(*map(F.lit, L.ORG_CLASSES))) | F.exists(_empty("class_labels"), lambda x: x.rlike(CLASS_WORDS)) | about.rlike(ORG_WORDS)
    rows = rows.withColumns({"__org": F.when(col("__named"), is_org), "__wanted": norm_country(col("country")), "__countries": F.when(col("__named"), F.transform(_empty("country_labels"), norm_country)), "__about": about})
    patterns = F.create_map(*[y for c, ds in L.DEMONYMS.items() for y in (F.lit(c), F.lit("(^|[^a-z])(" + "|".join(d.replace(".", r"\.") for d in ds) + ")([^a-z]|$)"))])
    said = F.coalesce(F.rlike(F.lower("__about"), F.try_element_at(patterns, col("__wanted"))), F.lit(False))
    known = col("country").isNotNull() & (col("country") != "")
    rows = rows.withColumn("__agrees", F.when(col("__org"), known & (F.array_contains("__countries", col("__wanted")) | said)))
    differs = known & ~col("__agrees") & (F.size("__countries") > 0)
    rejected = F.when(~col("__named"), F.lit("name differs")).when(~col("__org"), F.lit("not an organization")).when(differs, F.concat(F.lit("country differs ("), F.array_join("__countries", ", "), F.lit(")")))
    rows = rows.withColumn("rejected", rejected)
    stays = col("rejected").isNull()
    domains = F.filter(registrable_domains(_empty("websites")), lambda d: d.isNotNull())
    ctx = context_words(F.concat_ws(" ", F.coalesce("context", F.lit("")), F.coalesce("focus", F.lit(""))))
    rows = rows.withColumns({"__domains": F.when(stays, domains), "__own": F.when(stays, registrable_domain(col("domain"))), "__ctx": F.when(stays, ctx), "__labels": F.when(stays, affix_names(col("name")))})
    have = col("domain").isNotNull() & (F.size("__domains") > 0)
    held = F.coalesce(F.array_contains("__domains", col("__own")), F.lit(False))
    like_name = ~have & F.exists("__domains", lambda d: label_matches_names(d, col("__labels")))
    demonyms = F.array(*[F.struct(F.lit(c).alias("c"), F.array(*map(F.lit, ds)).alias("d")) for c, ds in L.DEMONYMS.items()])
    place = ~known & F.exists(demonyms, lambda x: F.array_contains("__ctx", x["c"]) & F.exists(x["d"], lambda d: F.contains(F.lower("__about"), d)))
    fits = F.arrays_overlap(context_words(col("__about")), col("__ctx")) | place
    rows = rows.withColumns({"__same": have & held, "__other": have & ~held, "__like": F.when(stays, like_name), "__fits": F.when(stays, fits)})
    score = F.lit(1) + n(col("__agrees"), 2) + n(col("__same"), 4) - n(col("__other"), 3) + n(col("__like"), 1) + n(col("__fits"), 1)
    signals = F.array_compact(F.array(
        F.lit("organization"), F.when(col("__agrees"), "country matches"), F.when(col("__same"), "website matches sources"), F.when(col("__other"), "website differs from sources"),
        F.when(col("__like"), "website matches name"), F.when(col("__fits"), "description fits the research")))
    spelled = F.try_element_at(F.filter(_empty("country_labels"), lambda c: norm_country(c) == col("__wanted")), F.lit(1))
    out = rows.withColumns({"score": F.when(stays, score), "signals": F.when(stays, signals), "matched_country": F.when(stays & col("__agrees"), F.coalesce(spelled, col("country")))})
    return out.select(*pairs.columns, "rejected", "score", "signals", "matched_country")


def resolve(scored: DataFrame, keys: tuple[str, ...] = ("research_id", "company_no"), order: str = "pos") -> DataFrame:
    """A row per company: status, id, score, confidence, candidates (three at most, if ambiguous), reason.

    scored: a row per (company, candidate) with score (null if rejected), candidate id and order; companies without candidates have a row
    with a null id.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc_nulls_last(), order)
    rows = scored.withColumn("__r", F.row_number().over(w)).withColumn("__next", F.lead("score").over(w))
    one = rows.groupBy(*keys).agg(
        F.count("id").alias("n"), F.count("score").alias("ok"), F.max(F.when(F.col("__r") == 1, F.struct("id", "score", "__next"))).alias("b"),
        F.slice(F.transform(F.sort_array(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("__r", "id")))), lambda x: x["id"]), 1, 3).alias("top"))
    lead = F.col("b.score") - F.col("b.__next")
    reason = F.when(F.col("n") == 0, "no Wikidata candidates").when(F.col("ok") == 0, "no candidate matched").when(F.col("b.score") < ACCEPT, "not enough evidence")
    status = F.when(reason.isNotNull(), "unresolved").when(lead < LEAD, "ambiguous").otherwise("resolved")
    good = status == "resolved"
    return one.select(
        *keys, status.alias("status"), F.when(good, F.col("b.id")).alias("id"), F.when(good, F.col("b.score")).alias("score"),
        F.when(good, F.least(F.lit(0.95), F.lit(0.5) + F.col("b.score") * F.lit(0.08))).alias("confidence"), F.when(status == "ambiguous", F.col("top")).alias("candidates"), reason.alias("reason"),
    )


def reconcile_type(proposed: Column, evidence: Column, inception_year: Column, instance_of: Column, year: Column) -> Column:
    """struct<type, evidence>: a claimed startup that is listed or older than STARTUP_YEARS is an established company."""
    listed = F.array_contains(_empty(instance_of), L.PUBLIC_COMPANY)
    old = F.coalesce((inception_year > 0) & (year - inception_year > STARTUP_YEARS), F.lit(False))
    row = lambda e: F.struct(F.lit("established_company").alias("type"), e.alias("evidence"))
    return F.when((proposed == "startup") & listed, row(F.lit("publicly listed company (Wikidata)"))).when(
        (proposed == "startup") & old, row(F.format_string("founded %d (Wikidata)", inception_year))).otherwise(F.struct(proposed.alias("type"), evidence.alias("evidence")))


def merge_companies(companies: DataFrame) -> DataFrame:
    """Companies (research_id, pos, name, kb_id, domain, country, focus, ids) with one row per organisation: the first kept row that shares
    its knowledge-base id or domain takes a company in, with its name, its citations, and its country and focus where missing.

    Keys of what was taken in don't count. One research's companies - fifteen at most by the limits - are folded in one group.
    """
    kind = "research_id string, pos long, name string, names array<string>, kb_id string, domain string, country string, focus string, ids array<string>"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        by_kb: dict[str, dict] = {}
        by_domain: dict[str, dict] = {}
        for r in pdf.sort_values("pos").to_dict("records"):
            ids = [] if r["ids"] is None else list(r["ids"])
            homes = [h for h in (by_kb.get(r["kb_id"]) if r["kb_id"] else None, by_domain.get(r["domain"]) if r["domain"] else None) if h]
            if homes:
                home = min(homes, key=lambda h: h["pos"])
                home["names"].append(r["name"])
                home["ids"] = list(dict.fromkeys(home["ids"] + ids))
                home["country"], home["focus"] = home["country"] or r["country"], home["focus"] or r["focus"]
                continue
            row = {**r, "names": [r["name"]], "ids": list(dict.fromkeys(ids))}
            kept.append(row)
            if r["kb_id"]:
                by_kb.setdefault(r["kb_id"], row)
            if r["domain"]:
                by_domain.setdefault(r["domain"], row)
        return pd.DataFrame(kept)[[c.split()[0] for c in kind.split(", ")]]

    own = companies.select(F.col("research_id").cast("string").alias("research_id"), F.col("pos").cast("long").alias("pos"), "name", "kb_id", "domain", "country", "focus", "ids")
    return own.groupBy("research_id").applyInPandas(lambda pdf: fold(pdf), kind)


def verify(companies: DataFrame) -> DataFrame:
    """companies (kb_match, website_source, cited_urls, country, kb_country, domain) with outlets, independent, reputable, confidence, signals."""
    outlets = F.array_distinct(F.filter(F.transform(_empty("cited_urls"), registrable_domain), lambda d: d.isNotNull()))
    rows = companies.withColumn("__o", outlets)
    rows = rows.withColumn("__i", F.filter("__o", lambda d: ~F.equal_null(d, F.col("domain")) & ~d.isin(L.WIRES)))
    under = "(^|\\.)(" + "|".join(x.replace(".", r"\.") for x in L.REPUTABLE) + ")$"
    rows = rows.withColumn("__r", F.filter("__i", lambda d: d.rlike(under)))
    official = F.coalesce(F.col("website_source").isin("sources", "wikidata"), F.lit(False))
    matched = F.coalesce(F.col("website_source").isin("clearbit", "search"), F.lit(False))
    site, n, good, kb = official | matched, F.size("__i"), F.size("__r"), F.coalesce("kb_match", F.lit(False))
    tld = F.try_element_at(F.create_map(*[F.lit(x) for kv in L.TLD_COUNTRY.items() for x in kv]), F.element_at(F.split("domain", r"\."), -1))
    own = norm_country(F.col("country"))
    consistent = F.coalesce(norm_country(F.col("kb_country")) == own, F.lit(False)) | F.coalesce(tld == own, F.lit(False))
    confidence = (
        F.when((site & (good > 0)) | (n >= 3) | (kb & (site | (n >= 2))), "high").when(site | (good > 0) | (n >= 2) | kb, "medium").otherwise("low")
    )
    where = F.when(F.col("website_source") == "sources", "from the sources").otherwise("from Wikidata")
    signals = F.array_compact(F.array(
        F.when(official, F.concat(F.lit("official website ("), where, F.lit(")"))).when(matched, F.lit("website found by name match")),
        F.when(good > 0, F.concat(F.lit("covered by "), F.array_join(F.slice("__r", 1, 3), ", "))), F.when(n >= 2, F.format_string("%d independent sources", n)),
        F.when(kb, "matched on Wikidata"), F.when(consistent, "country consistent across evidence"), F.when(confidence == "low", "single, weak source")))
    return rows.withColumns({"outlets": F.size("__o"), "independent": n, "reputable": good, "confidence": confidence, "signals": signals}).drop("__o", "__i", "__r")


def website_chain(companies: DataFrame) -> DataFrame:
    """companies (from_sources, from_kb, from_suggestion, from_search) with domain and website_source, the most trusted first."""
    steps = [("from_sources", "sources"), ("from_kb", "wikidata"), ("from_suggestion", "clearbit"), ("from_search", "search")]
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(s)) for c, s in steps])
    return companies.withColumn("domain", F.coalesce(*[F.col(c) for c, _ in steps])).withColumn("website_source", source)


def paid_lookups(companies: DataFrame, most: int = PAID) -> DataFrame:
    """Companies (research_id, pos, domain, cached, citations) to look up for money: without a domain or a cached answer, most cited first."""
    open_ = companies.where(F.col("domain").isNull() & ~F.coalesce("cached", F.lit(False)))
    w = Window.partitionBy("research_id").orderBy(F.col("citations").desc(), "pos")
    return open_.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def country_chain(matched: Column, kb: Column, extracted: Column, mentioned: Column) -> Column:
    """The matched country, the knowledge base's first, the extracted one, or the only one that the evidence mentions."""
    return F.coalesce(matched, F.try_element_at(kb, F.lit(1)), F.nullif(extracted, F.lit("")), F.when(F.size(mentioned) == 1, mentioned[0]))
