"""Operators on small tables of our own."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import analysis, entities, ingest, relevance, report, store, stories
from sourceloom.plans.research import run_research
from sourceloom.sources import feeds, versions
from sourceloom.streaming import events



def now():
    return F.lit("2026-09-24T00:00:00Z").cast("timestamp")


CANDIDATE = "research_id string, search_no int, pos int, provider string, query string, url string, title string, publisher string, published_at string, snippet string, type string, score double"


def candidate(no, pos, url, title=None, snippet=None, kind="web", at=None):
    return ("r", no, pos, "web", "q", url, title, None, at, snippet, kind, None)


def test_merge_fills_fields_in_order(spark):
    rows = [candidate(0, 0, "http://a.com/x?utm_source=1"), candidate(1, 0, "https://www.a.com/x/", "T", kind="news"), candidate(1, 1, "https://a.com/x", "U", "s"), candidate(1, 2, "bad")]
    df = spark.createDataFrame(rows, CANDIDATE)
    (m,) = ingest.merge_candidates(df).collect()
    assert (m.canonical_url, m.url, m.title, m.snippet, m.type) == ("https://a.com/x", "http://a.com/x?utm_source=1", "T", "s", "news")
    assert [(d["rank"], d["type"]) for d in m.found_by] == [(1, "web"), (1, "news"), (2, "web")]
    assert tuple(ingest.merge_stats(df).first())[1:] == (4, 1, 2)
    assert ingest.merge_candidates(df.limit(0)).count() == 0


SOURCE = "research_id string, seq long, title string, published_at timestamp"


def sources(spark, *rows):
    df = spark.createDataFrame([("r", i, t, None) for i, (t, _) in enumerate(rows)], SOURCE)
    days = spark.createDataFrame([(i, d) for i, (_, d) in enumerate(rows)], "seq long, d int")
    df = df.join(days, "seq").withColumn("published_at", F.when(F.col("d").isNotNull(), F.expr("timestamp'2026-09-01 00:00:00' + make_dt_interval(d)"))).select("research_id", "seq", "title", "published_at")
    return stories.with_tokens(df)


def test_story_rules(spark):
    s = sources(
        spark, ("Exein raises $270 Million for chips", 1), ("Italy's Exein hits unicorn status with $270m", 3), ("Weekly robot funding digest edition", 1), ("Weekly robot funding digest edition", 9), ("Weekly robot funding digest edition", None),
        ("Alpha Beta Gamma Delta Epsilon launch", 1), ("Alpha Beta Gamma Delta Zeta launch", 2), ("Alpha Beta Gamma Delta Eta launch", None), (None, 1))
    got = {(r.a, r.b): r.reason for r in stories.story_pairs(s).collect()}
    assert got == {(0, 1): "same_figure", (2, 4): "same_title", (3, 4): "same_title", (5, 6): "similar_title"}


def literal_fold(n, edge):
    groups = []
    out = {}
    for s in range(n):
        for g in groups:
            m = edge.get((g[0], s)) or next((edge[(d, s)] for d in g[1:] if edge.get((d, s)) and edge[(d, s)][0] == "same_figure"), None)
            if m:
                g.append(s)
                out[s] = (g[0], m[0])
                break
        else:
            groups.append([s])
            out[s] = (s, None)
    return out


def test_fold_is_the_greedy_one():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(1, 12)
        edge = {(a, b): (rng.choice(["same_title", "same_figure", "similar_title"]), 1.0) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.3}
        earlier = {}
        for (a, b), (reason, sim) in edge.items():
            earlier.setdefault(b, []).append((a, reason, sim))
        got = {s: (p, r) for s, p, r, _ in stories.fold_stories(list(range(n)), earlier)}
        assert got == literal_fold(n, edge)


def test_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    words = ["red", "blue", "green", "gold", "iron", "wood", "16m", "2b", "stone", "glass"]
    rows = [(" ".join(rng.sample(words, rng.randint(1, 8))), rng.choice([None, 1, 2, 6])) for _ in range(60)]
    s = sources(spark, *rows)
    got = {(r.a, r.b, r.reason, r.similarity) for r in stories.story_pairs(s).collect()}
    side = lambda k: s.select("research_id", F.col("seq").alias(k), F.struct("tokens", "all_tokens", "published_at").alias(f"r{k}"))
    every = side("a").join(side("b"), "research_id").where("a < b").withColumn("m", stories.match("ra", "rb")).where("m IS NOT NULL")
    assert got == {(r.a, r.b, r.m["reason"], r.m["similarity"]) for r in every.collect()} and got


def test_clusters_don_t_depend_on_files(spark):
    s = sources(spark, *[(f"Alpha Beta Gamma Delta {w} launch", d) for w in ("One", "Two", "Three") for d in (1, 2)])
    a = sorted(map(tuple, stories.story_clusters(s).collect()))
    assert a == sorted(map(tuple, stories.story_clusters(s.orderBy(F.rand(4)).repartition(3)).collect()))
    primaries = {r[2] for r in a}
    assert all(r[2] == r[1] for r in a if r[1] in primaries)


SCORE = "research_id string, title string, snippet string, url string, published_at timestamp, found_by_count int"


def score(spark, query, *rows, focus=None):
    df = spark.createDataFrame([("r", t, s, u, None, n) for t, s, u, n in rows], SCORE)
    asked = spark.createDataFrame([("r", query, focus)], "research_id string, query string, focus string")
    return relevance.score_relevance(df, relevance.contexts(asked), now()).orderBy("url").collect()


def test_relevance(spark):
    got = score(
        spark, "robotics startups in Japan", ("Tokyo robot maker raises money", None, "https://a.com/1", 1), ("China's humanoid robot industry", None, "https://a.com/2", 2), ("Robotics jobs in Japan", None, "https://a.com/3", 1),
        ("Weather", None, "https://a.com/4", 1), ("x", "japanese robotics firm", "https://a.com/5", 1), ("y", None, "https://a.com/japan-robotics-6", 1))
    assert [r.score for r in got] == [1.0, 0.4, 0.2, 0.0, 0.6, 0.4]
    assert got[1].reasons == ["not about Japan", "found by 2 searches"] and got[2].reasons == ["job listing"]
    assert got[3].reasons == ["does not mention robotic", "not about Japan"]
    (r,) = score(spark, "AI in India", ("AI news", None, "https://inc42.com/x", 1))
    assert r.score == 0.86 and r.relevant


def test_promotion_and_labels(spark):
    rows = [("r", i, i, s, s >= 0.45, ["job listing"] if i == 2 else []) for i, s in enumerate([0.9, 0.3, 0.3, 0.2, 0.26])]
    df = spark.createDataFrame(rows, "research_id string, primary_seq long, seq long, score double, relevant boolean, reasons array<string>")
    got = {r.primary_seq: r.promoted for r in relevance.judge_stories(df).collect()}
    assert got == {0: False, 1: True, 2: False, 3: False, 4: True}
    f = df.select(relevance.fallback_label(F.col("score"), F.col("relevant"), F.col("reasons")).alias("f")).collect()
    assert [x.f["label"] for x in f] == ["direct", "irrelevant", "irrelevant", "irrelevant", "irrelevant"] and f[2].f["reason"] == "job listing"
    text = relevance.reason_text(relevance.summarize_reasons(df)).first().text
    assert text.startswith("3 weak match") and "1 job listing" in text


def test_analysis(spark):
    answer = {
        "overview": {"summary": "s", "key_findings": [{"text": "f", "source_ids": ["s1", "S9"]}, {"text": " ", "source_ids": ["S1"]}]},
        "companies": [{"name": "A", "entity_type": "x", "website": "https://a.com", "source_ids": ["S9"]}, {"name": "a", "entity_type": "startup", "website": "a.com", "source_ids": ["SOURCE_2"]}, {"name": "A", "source_ids": ["S1"]}],
        "recent_developments": [{"title": "d", "date": "2026-02-30", "source_ids": ["S1"]}], "emerging_trends": [{"title": "t", "source_ids": ["S1", "S1"]}, {"title": "u", "source_ids": ["S1", "S2"]}]}
    outputs = spark.createDataFrame([("r", json.dumps(answer)), ("bad", "{"), ("empty", "{}")], "research_id string, text string")
    aliases = spark.createDataFrame([("r", "S1", "x"), ("r", "S2", "y")], "research_id string, alias string, id string")
    seen = spark.createDataFrame([("r", "www.a.com said")], "research_id string, text string")
    got = {(r.section, r.n): r for r in analysis.parse_analysis(outputs, aliases, seen, now()).collect()}
    assert set(got) == {("key_findings", 1), ("companies", 1), ("developments", 1), ("trends", 1)}
    c = got["companies", 1]
    assert (c.name, c.entity_type, c.domain, c.ids) == ("a", "startup", "a.com", ["y"]) and got["trends", 1].title == "u" and got["developments", 1].event_date is None


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([("r", i, c) for i, c in enumerate([3, 5, 9, 1])], "research_id string, pos int, cost long")
    assert [r.pos for r in analysis.budget_prefix(df, "cost", F.lit(10)).orderBy("pos").collect()] == [0, 1]


def test_entities(spark):
    pair = "name string, country string, focus string, domain string, context string, label string, aliases array<string>, description string, instance_of array<string>, country_labels array<string>, class_labels array<string>, websites array<string>"
    rows = [
        ("XFlow", "India", None, None, "", "Xflow", [], "Indian fintech company", [], ["India"], [], ["https://xflowpay.com"]), ("XFlow", "India", None, None, "", "XFlow", [], "Danish company", [], ["Denmark"], [], []),
        ("XFlow", "India", None, "other.com", "", "Xflow Inc", [], "payment company", [], [], [], ["https://xflow.com"]), ("Acme", None, None, None, "german robots", "Acme", [], "German firm", [], [], [], []), ("Acme", None, None, None, "", "Acme", [], "a river", [], [], [], []),
    ]
    got = entities.score_candidates(spark.createDataFrame(rows, pair)).collect()
    assert [r.score for r in got] == [4, None, -2, 2, None]
    assert got[1].rejected == "country differs (denmark)" and got[0].matched_country == "India" and got[4].rejected == "not an organization"
    scored = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 1, 4), (2, "c", 0, 5), (3, None, 0, None), (4, "d", 0, None), (5, "e", 0, 2)], "company_no int, id string, pos int, score int")
    status = {r.company_no: (r.status, r.id, r.reason) for r in entities.resolve(scored, ("company_no",)).collect()}
    assert status == {1: ("ambiguous", None, None), 2: ("resolved", "c", None), 3: ("unresolved", None, "no Wikidata candidates"), 4: ("unresolved", None, "no candidate matched"), 5: ("unresolved", None, "not enough evidence")}


def test_company_merge_keeps_the_first_keys(spark):
    rows = [("r", 0, "A", "q1", None, None, None, ["1"]), ("r", 1, "B", "q1", "d", "x", None, ["2"]), ("r", 2, "C", None, "d", None, None, ["3"])]
    df = spark.createDataFrame(rows, "research_id string, pos long, name string, kb_id string, domain string, country string, focus string, ids array<string>")
    got = [(r.names, r.country, r.ids) for r in entities.merge_companies(df).orderBy("pos").collect()]
    assert got == [(["A", "B"], "x", ["1", "2"]), (["C"], None, ["3"])]


def test_verification(spark):
    rows = [(False, "sources", ["https://x.reuters.com/a"], "Germany", None, "a.de"), (False, None, ["https://a.de", "https://www.prnewswire.com/b"], None, None, "a.de"), (True, None, ["https://b.org", "https://c.org"], None, None, None), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "kb_match boolean, website_source string, cited_urls array<string>, country string, kb_country string, domain string")
    got = entities.verify(df).collect()
    assert [r.confidence for r in got] == ["high", "low", "high", "low"]
    assert got[0].signals == ["official website (from the sources)", "covered by reuters.com", "country consistent across evidence"]


def test_sources(spark):
    body = {"results": [{"url": "https://www.a.com/x", "title": " T ", "score": 0.5}, {"title": "no url"}, {"url": "https://b.com", "title": 7, "content": "c", "score": "x"}]}
    raw = spark.createDataFrame([("r", 0, "web", "q", "news", json.dumps(body)), ("r", 1, "web", "q", "web", "{}"), ("r", 2, "web", "q", "web", "<html>")], "research_id string, search_no int, provider string, query string, type string, response string")
    got = feeds.search_results(raw).orderBy("pos").collect()
    assert [(r.url, r.title, r.publisher, r.snippet, r.score, r.pos) for r in got] == [("https://www.a.com/x", "T", "a.com", None, 0.5, 0), ("https://b.com", None, "b.com", "c", None, 1)]
    assert feeds.malformed(raw).count() == 2
    xml = "<rss><channel><item><title>2026</title><link>https://a.com/1</link><description>&lt;p&gt;Hi&lt;/p&gt;</description><pubDate>Tue, 22 Sep 2026 10:00:00 GMT</pubDate></item><item><title>x</title></item></channel></rss>"
    items = feeds.feed_items(spark.createDataFrame([(1, xml), (2, "<html></html>")], "site_id int, xml string")).collect()
    assert [(r.site_id, r.url, r.title, r.snippet) for r in items] == [(1, "https://a.com/1", "2026", "Hi")]
    claim = lambda v, rank="normal": {"mainsnak": {"datavalue": {"value": v}}, "rank": rank}
    kb = {"entities": {"Q1": {"id": "Q1", "labels": {"en": {"value": "A"}}, "aliases": {"en": [{"value": "B"}]}, "claims": {"P31": [claim({"id": "Q5"}), claim({"id": "Q6"}, "deprecated")], "P856": [claim("https://a.com")], "P571": [claim({"time": "+2013-00-00T00:00:00Z"})]}}, "Q2": {"id": "Q2", "missing": ""}}}
    (e,) = feeds.kb_entities(spark.createDataFrame([(json.dumps(kb),)], "response string")).collect()
    assert (e.id, e.label, e.aliases, e.description, e.instance_of, e.country_ids, e.websites, e.inception_year) == ("Q1", "A", ["B"], None, ["Q5"], [], ["https://a.com"], 2013)


def test_run_and_store(spark, tmp_path):
    rows = [
        candidate(0, 0, "https://a.com/1", "Tokyo robot maker Alpha raises money", "s", at="2026-09-20T00:00:00Z"), candidate(1, 0, "https://b.com/1", "Tokyo robot maker Alpha raises money", None, "news", "2026-09-21T00:00:00Z"),
        candidate(1, 1, "https://a.com/1?utm_id=1", "Other", kind="news"), candidate(0, 2, "https://c.com", "Robotics jobs in Japan"), candidate(0, 3, "https://d.com", "Access denied"),
    ]
    asked = spark.createDataFrame([("r", "robotics startups in Japan", None)], "research_id string, query string, focus string")
    got = run_research(asked, spark.createDataFrame(rows, CANDIDATE), now())
    saved = {r.canonical_url: r for r in got["rows"].collect()}
    a, b = saved["https://a.com/1"], saved["https://b.com/1"]
    assert len(saved) == 3 and b.duplicate_of == a.id and a.duplicate_of is None and a.relevance_label == b.relevance_label == "direct"
    assert saved["https://c.com/"].relevance_label == "irrelevant"
    box = store.Store(spark, f"file://{tmp_path}/store")
    assert box.version() is None
    first = box.save({"sources": got["rows"]}, {"sources": "research_id"})
    assert box.version() == first and box.read("sources").count() == 3
    again = store.insert_ignore(box.read("sources"), got["rows"].select(*box.read("sources").columns))
    assert again.count() == 3
    entities_ = spark.createDataFrame([("r", "A.com")], "research_id string, domain string")
    assert {r.rule: r.n for r in store.violations(got["rows"], entities_).collect()} == {"unique source": 0, "own duplicate": 0, "score": 0, "label": 0, "unique domain": 0, "lower domain": 1}
    log = spark.createDataFrame([("r", 1, "pending"), ("x", 1, "pending"), ("x", 2, "failed")], "research_id string, seq long, status string")
    assert store.claim(log, "r", now()).count() == 1 and store.claim(log, "x", now()).count() == 0


def test_report_is_saved_once(spark, tmp_path):
    schema = "research_id string, section string, at int, n int, title string, summary string, company string, event_date string, ids array<string>"
    analysis = spark.createDataFrame([("r", "developments", 0, 1, "D", "s", "ACME", "2024-01-01", ["a", "x"]), ("r", "trends", 1, 1, "T", "s", None, None, ["b"]), ("r", "companies", 2, 1, None, None, None, None, ["a"])], schema)
    companies = spark.createDataFrame(
        [("r", 0, "Acme Inc", ["Acme Inc", "Acme"], "acme.com", "fr", None, ["a"]), ("r", 1, "Other", ["Other"], "acme.com", None, None, ["b"])],
        "research_id string, pos int, name string, names array<string>, domain string, country string, focus string, ids array<string>")
    sources = spark.createDataFrame([("r", "a"), ("r", "b"), ("q", "x")], "research_id string, id string")
    box = store.Store(spark, f"file://{tmp_path}/store")
    first = box.save_report(analysis, companies, sources)
    found = {r.title: r for r in report.with_company(box.read("findings"), box.read("entities")).collect()}
    assert (found["D"].entity_key, found["D"].company, found["T"].company) == ("c0", "Acme Inc", None)  # any merged name, in either case
    assert sorted((r.source_id) for r in box.read("finding_sources").collect()) == ["a", "b"]  # x belongs to another research
    assert {r.name: r.domain for r in box.read("entities").collect()} == {"Acme Inc": "acme.com", "Other": None}  # the first one keeps a domain
    with pytest.raises(ValueError, match="saved already: r"):
        box.save_report(analysis, companies, sources)
    assert box.version() == first
    other = lambda df: df.withColumn("research_id", F.lit("q"))
    second = box.save_report(other(analysis), other(companies), sources)
    assert box.version() == second and box.read("findings").count() == 4 and sorted(r.source_id for r in box.read("finding_sources").collect()) == ["a", "b", "x"]
    with pytest.raises(versions.Conflict):
        box.publish(versions.Version(1, first, {}), {})  # another writer was first
    assert box.version() == second and len(box.last().tables["findings"]) == 2  # a save adds a segment


def test_report(spark):
    s = spark.createDataFrame([("r", 1, None, 1), ("r", 2, 1, 2), ("r", 3, 9, 3)], "research_id string, id int, duplicate_of int, pos int")
    assert {r.id: r.story_id for r in report.group_stories(s).collect()} == {1: 1, 2: 1, 3: 3}
    c = spark.createDataFrame([("r", "startup", "Japan", "industrial robots", "low", 1, 0, "A", None), ("r", "investor", "Germany", "robots", "high", 9, 1, "B", None), ("r", "startup", "Germany", "AI robotics", "high", 2, 2, "C", None), ("r", "startup", None, None, None, 2, 3, "D", "z.com")], "research_id string, entity_type string, country string, focus string, confidence string, citations int, pos int, name string, domain string")
    assert [r.name for r in report.rank_companies(c, "startup", ["europe"], "robotics").orderBy("rank").collect()] == ["C", "D", "A", "B"]
    assert [r.name for r in report.rank_companies(c).orderBy("rank").collect()] == ["B", "C", "A", "D"]
    assert [r.name for r in report.filter_companies(c, "Z.CO").collect()] == ["D"] and report.filter_companies(c, high_only=True).count() == 2
    assert {r.name: r.part for r in report.split_companies(c, "startup").collect()}["B"] == "ecosystem"


def test_stream(spark, tmp_path):
    rows = [(1, "a", "pending", "info", "m"), (2, "a", "planning", "info", "m"), (3, "b", "pending", "odd", "m")]
    df = spark.createDataFrame(rows, "id long, research_id string, stage string, level string, message string").withColumn("created_at", F.lit("2026-01-01 00:05:00").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    stream = events.valid_events(events.event_stream(spark, f"{tmp_path}/in"))
    q = events.append_log(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    q = events.to_memory(events.latest_status(stream), "latest")
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM latest").collect()] == [("a", "planning", 2)]
    assert events.rate_per_hour(df).count() == 6


def test_an_answer_is_reduced_in_its_row(spark, monkeypatch):
    """Read once, without windows or joins of its citations; aliases may repeat, items may be null or without citations."""
    kept = {}

    def staged(df, name, write=analysis.staged):
        kept[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(analysis, "staged", staged)
    text = """{"overview": {"summary": "s", "key_findings": [null, {"text": "one", "source_ids": ["S2", "s1", "S2", "S9"]}, {"text": "two"}, {"text": " ", "source_ids": ["S1"]}]},
      "companies": [{"name": "A", "source_ids": ["S9"]}, {"name": "a ", "source_ids": ["S1"]}, {"name": "A", "source_ids": ["S2"]}], "emerging_trends": [{"title": "t", "source_ids": ["S1", "S1"]}, {"title": "u", "source_ids": ["S1"]}]}"""
    outputs = spark.createDataFrame([("r", text), ("blank", text.replace('"s"', '" "')), ("none", None), ("bare", text)], "research_id string, text string")
    aliases = spark.createDataFrame([("r", "S1", "x"), ("r", "S1", "w"), ("r", "S2", "y"), ("r", "S2", None)], "research_id string, alias string, id string")
    got = analysis.parse_analysis(outputs, aliases, spark.createDataFrame([], "research_id string, text string"), F.current_timestamp()).collect()
    assert sorted((r.section, r.at, r.n, r.name or r.title, r.ids, r.domain) for r in got) == [
        ("companies", 1, 1, "a", ["w", "x"], None), ("key_findings", 1, 1, "one", ["y", "w", "x"], None), ("trends", 0, 1, "t", ["w", "x"], None), ("trends", 1, 2, "u", ["w", "x"], None)]
    assert kept["items"].count("from_json(") == 1 and "Window" not in kept["items"]


def test_ranks_of_one_research_over_many_tasks(spark):
    """One research over several partitions: the ranks are those of one sort, and no window over whole rows makes them."""
    from sourceloom.plans.research import primary_first

    rng = random.Random(2)
    rows = [("r" if i % 5 else None, f"u{i}", ["x"] * rng.randint(1, 3), rng.choice([None, "2024-01-01"]), rng.choice([None, "s"]), rng.choice(["news", "web"]), (i % 2, i)) for i in range(400)]
    df = spark.createDataFrame(rows, "research_id string, canonical_url string, found_by array<string>, published_at string, snippet string, type string, arrival struct<search_no:int,pos:int>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = primary_first(df.where("research_id IS NOT NULL"))
        got = {r.canonical_url: r.seq for r in ranked.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted((r for r in rows if r[0]), key=lambda r: (-len(r[2]), r[3] is None, r[4] is None, r[5] != "news", r[6]))
    assert got == {r[1]: i for i, r in enumerate(want, 1)}
    assert not [line for line in ranked._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in line and "snippet" in line]
