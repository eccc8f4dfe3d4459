"""Providers behind a plan, their recorded answers as a data source, and model calls that fall back."""

import json

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import fallback
from sourceloom.sources import lookups, providers
from sourceloom.sources.scratch import staged_path

FEED = "<rss><channel>{}</channel></rss>"
ITEM = "<item><title>{0}</title><link>https://{0}.example.org/</link></item>"


def answers(spark, rows):
    full = [(r, n, p, "q", "web", part, name, status, error, body) for r, n, p, part, name, status, error, body in rows]
    return staged_path(spark.createDataFrame(full, providers.ANSWER).repartition(3), "answers")


def results(*urls):
    return json.dumps({"results": [{"url": u, "title": "t"} for u in urls]})


def test_answers_as_a_data_source(spark):
    path = answers(spark, [("r", i, "web" if i % 2 else "feeds", 0, None, 200, None, f"b{i}") for i in range(40)])
    spark.dataSource.register(providers.AnswersSource)
    every = spark.read.format("provider_answers").load(path)
    assert every.count() == 40 and every.schema.simpleString() == spark.createDataFrame([], providers.ANSWER).schema.simpleString()
    web = providers.read_answers(spark, path, "web")
    assert sorted(r.search_no for r in web.collect()) == list(range(1, 40, 2))
    with pytest.raises(KeyError, match="nobody"):
        providers.read_answers(spark, path, "nobody")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = providers.read_answers(spark, path, "web").where("search_no = 7 AND body > 'a'")
        assert [r.body for r in some.collect()] == ["b7"]
        assert [r.search_no for r in providers.read_answers(spark, path, "web").where("search_no IN (3, 4, 5)").orderBy("search_no").collect()] == [3, 5]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_task_reads_row_groups_up_to_its_bound(spark):
    path = answers(spark, [("r", i, "web", 0, None, 200, None, "x" * 500) for i in range(60)])
    sizes = [spark.read.format("provider_answers").option("split_bytes", n).load(path).rdd.getNumPartitions() for n in (1, 1 << 30)]
    assert sizes == [3, 3]  # a file has one row group here, and a task never reads parts of two files
    assert [p.groups for p in providers.AnswersReader(path, "web", ["body"], 1).partitions()] == [(0,)] * 3
    assert providers.AnswersReader(path, "feeds", ["body"], 1).partitions() == []  # pruned by statistics


def test_collect_judges_and_parses(spark):
    rows = [
        ("a", 0, "web", 0, None, 200, None, results("https://x.com/1", "https://x.com/2")), ("b", 0, "web", 0, None, 432, None, "spent"), ("c", 0, "web", 0, None, 200, None, '{"results": 1}'),
        ("d", 0, "web", 0, None, None, "timeout", None), ("z", 0, "web", 0, None, 200, None, results("https://not.asked.com/")),
        ("a", 1, "feeds", 0, "One", 200, None, FEED.format("".join(ITEM.format(f"a{i}") for i in range(9)))), ("a", 1, "feeds", 1, "Two", 200, None, FEED.format(ITEM.format("b0"))), ("a", 1, "feeds", 2, "Three", None, "network", None),
        ("b", 1, "feeds", 0, "One", 200, None, "<html>"), ("b", 1, "feeds", 1, "Two", 429, None, ""), ("c", 1, "feeds", 0, "One", 200, None, FEED.format("")),
    ]
    plan = spark.createDataFrame([(r, n, p, "q", "web", 7) for r in "abcd" for n, p in ((0, "web"), (1, "feeds"), (2, "other"))], "research_id string, pos int, provider string, text string, type string, max_results int")
    found, outcomes = providers.collect(spark, plan, answers(spark, rows), {"SEARCH_KEY": "k"})
    got = [(r.research_id, r.search_no, r.pos, r.url, r.publisher) for r in found.orderBy("research_id", "search_no", "pos").collect()]
    feed = [("a", 1, i, f"https://a{i}.example.org/", "One") for i in range(6)] + [("a", 1, 6, "https://b0.example.org/", "Two")]
    assert got == [("a", 0, 0, "https://x.com/1", "x.com"), ("a", 0, 1, "https://x.com/2", "x.com"), *feed]
    assert {(r.research_id, r.search_no): (r.failed, r.total, r.ok, r.warning) for r in outcomes.collect()} == {
        ("a", 0): (0, 1, True, None), ("b", 0): (1, 1, False, None), ("c", 0): (1, 1, False, None), ("d", 0): (1, 1, False, None),
        ("a", 1): (1, 3, True, "Could not read 1 of 3 news sites (Three: unreachable)."), ("b", 1): (2, 2, False, None), ("c", 1): (0, 1, True, None),
    }
    # without its key the web isn't asked; max_results cuts what the sites give together
    found, outcomes = providers.collect(spark, plan.withColumn("max_results", F.lit(2)), answers(spark, rows), {})
    assert [r.url for r in found.orderBy("pos").collect()] == ["https://a0.example.org/", "https://a1.example.org/"] and {r.provider for r in outcomes.collect()} == {"feeds"}


def test_a_plan_names_a_provider_that_is_added(spark, monkeypatch):
    monkeypatch.setattr(providers, "REGISTRY", dict(providers.REGISTRY))
    lines = lambda a: a.select("research_id", "search_no", "provider", "query", F.posexplode(F.split("body", "\n")).alias("pos", "url"), *[F.lit(None).cast("string").alias(c) for c in ("title", "publisher", "snippet")], F.lit(None).cast("timestamp").alias("published_at"), "type", F.lit(None).cast("double").alias("score")).select(*providers.CANDIDATE)
    providers.register(providers.Provider("lines", "Lines", ("web",), lambda b: b.startswith("http"), lines))
    plan = spark.createDataFrame([("a", 0, "lines", 5), ("b", 0, "lines", 5)], "research_id string, pos int, provider string, max_results int")
    found, outcomes = providers.collect(spark, plan, answers(spark, [("a", 0, "lines", 0, None, 200, None, "https://x.org/1\nhttps://x.org/2"), ("b", 0, "lines", 0, None, 200, None, "oops")]), {})
    assert [(r.research_id, r.url) for r in found.orderBy("pos").collect()] == [("a", "https://x.org/1"), ("a", "https://x.org/2")]
    assert {(r.research_id, r.ok) for r in outcomes.collect()} == {("a", True), ("b", False)}


def test_entities_of_the_knowledge_base(spark):
    body = json.dumps({"entities": {"Q1": {"id": "Q1", "labels": {"en": {"value": "One"}}}, "Q2": {"id": "Q2", "missing": ""}}})
    path = answers(spark, [("a", 0, "kb", 0, None, 200, None, body)])
    kb = providers.REGISTRY["kb"]
    rows = kb.parse(providers.judged(providers.read_answers(spark, path, "kb"), kb).where("kind IS NULL"))
    assert [(r.id, r.label) for r in rows.collect()] == [("Q1", "One")]


def test_kinds_of_failures(spark):
    rows = spark.createDataFrame([(None, "timeout"), (None, "refused"), (429, None), (401, None), (403, None), (432, None), (500, None), (404, None), (301, None), (200, None)], "status int, error string")
    kind = lookups.error_kind(F.col("status"), F.col("error"), (432,))
    got = [(r[0], r[1]) for r in rows.select(kind, lookups.failure_text(kind, F.col("status"))).collect()]
    assert got == [("timeout", "timed out"), ("network", "unreachable"), ("rate_limited", "rate-limited"), ("unauthorized", "HTTP 401"), ("unauthorized", "HTTP 403"), ("quota_exceeded", "HTTP 432"), ("http", "HTTP 500"), ("http", "HTTP 404"), ("http", "HTTP 301"), (None, None)]


def test_gaps_of_a_plan(spark):
    plan = spark.createDataFrame([("a", "web"), ("a", "feeds"), ("b", "web"), ("b", "x")], "research_id string, provider string")
    known = providers.configured(spark, {})
    assert {r.provider for r in known.collect()} == {"feeds", "kb"}
    got = {r.research_id: (r.runnable, r.skipped, r.failure) for r in lookups.plan_gaps(plan, known).collect()}
    assert got == {"a": (1, ["web"], None), "b": (0, ["web", "x"], "No data sources are configured on this deployment.")}
    assert [(r.research_id, r.provider) for r in lookups.prune_plan(plan, known).collect()] == [("a", "feeds")]


def parts(*texts, stop="STOP"):
    return json.dumps({"candidates": [{"content": {"parts": [{"text": x} for x in texts]}, "finishReason": stop}], "usageMetadata": {"promptTokenCount": 1, "candidatesTokenCount": 2}})


def choice(text, stop="stop"):
    return json.dumps({"choices": [{"message": {"content": text}, "finish_reason": stop}]})


GOOD = '{"overview": {"summary": "fine"}}'
FIRST, SECOND = fallback.Model("first", "m1", fallback.parts_answer, 1000), fallback.Model("second", "m2", fallback.choice_answer, 1000)


def run(spark, recorded, models=(FIRST, SECOND), settings=None, prepare=None):
    """recorded: research to (status, error, body) by model."""
    requests = spark.createDataFrame([(r, f"question {r}") for r in sorted(recorded)], "research_id string, query string")
    asked = []

    def ask(model, rows):
        ids = [r.research_id for r in rows.select("research_id").collect()]
        asked.append((model.model, sorted(ids)))
        return spark.createDataFrame([(r, *recorded[r][model.model]) for r in ids if model.model in recorded[r]], "research_id string, status int, error string, body string")

    out = fallback.generate(requests, list(models), ask, prepare or (lambda m, rows: (rows, fallback.analysis_parser())), settings or {})
    return {r.research_id: (r.value and r.value.overview.summary, r.provider, [tuple(x) for x in r.failed], r.error) for r in out.collect()}, asked


def test_the_next_model_gets_what_failed_alone(spark):
    got, asked = run(spark, {
        "a": {"m1": (200, None, parts(GOOD[:5], GOOD[5:]))}, "b": {"m1": (429, None, ""), "m2": (200, None, choice(GOOD))}, "c": {"m1": (200, None, parts("not json")), "m2": (200, None, choice(GOOD))},
        "d": {"m1": (200, None, parts('{"overview": {"summary": " "}}')), "m2": (None, "timeout", None)}, "e": {"m1": (200, None, parts(GOOD, stop="MAX_TOKENS")), "m2": (200, None, choice(GOOD, "length"))}, "f": {"m2": (200, None, choice("{}"))},
    })
    assert asked == [("m1", list("abcdef")), ("m2", list("bcdef"))]
    assert got["a"] == ("fine", "first", [], None)
    assert got["b"] == ("fine", "second", [("first", "m1", "rate_limited, HTTP 429")], None)
    assert got["c"] == ("fine", "second", [("first", "m1", "output was not valid JSON")], None)
    assert got["d"][1:] == (None, [("first", "m1", "output had no overview summary"), ("second", "m2", "timeout")], "All AI providers failed: first (output had no overview summary); second (timeout)")
    assert got["e"][3] == "All AI providers failed: first (malformed: generation stopped early (MAX_TOKENS)); second (malformed: generation stopped early (length))"
    assert got["f"][2] == [("first", "m1", "network"), ("second", "m2", "output had no overview summary")]


def test_models_that_are_not_configured_are_passed_over(spark):
    keyed = fallback.Model("first", "m1", fallback.parts_answer, 1000, "KEY")
    rows = {"a": {"m1": (200, None, parts(GOOD)), "m2": (200, None, choice(GOOD))}}
    got, asked = run(spark, rows, (keyed, SECOND))
    assert got["a"] == ("fine", "second", [], None) and asked == [("m2", ["a"])]
    got, asked = run(spark, rows, (keyed, SECOND), {"KEY": "k"})
    assert got["a"][1] == "first" and asked == [("m1", ["a"])]
    got, asked = run(spark, rows, (keyed,))
    assert got["a"] == (None, None, [], "All AI providers failed: ") and asked == []


def test_each_model_has_its_own_request_and_parser(spark):
    seen = []

    def prepare(model, rows):
        seen.append((model.model, model.max_input_tokens))
        strict = (F.try_variant_get(F.try_parse_json("text"), "$.overview.summary", "string") != "long enough", "too short for this one")
        parser = fallback.by_rule(F.from_json("text", fallback.ANALYSIS), strict) if model.model == "m1" else fallback.analysis_parser()
        return rows.withColumn("prompt", F.left("query", F.lit(model.max_input_tokens))), parser

    got, _ = run(spark, {"a": {"m1": (200, None, parts(GOOD)), "m2": (200, None, choice(GOOD))}}, prepare=prepare)
    assert got["a"] == ("fine", "second", [("first", "m1", "too short for this one")], None) and seen == [("m1", 1000), ("m2", 1000)]


def test_classifications_need_a_usable_source(spark):
    aliases = spark.createDataFrame([("a", "S1"), ("b", "S1")], "research_id string, alias string")
    parse = fallback.relevance_parser(aliases, ("research_id",), ("direct", "irrelevant"))
    rows = [("a", '{"sources": [{"id": "source_1", "label": "direct"}, {"id": "S9", "label": "direct"}]}'), ("b", '{"sources": [{"id": "S1", "label": "odd"}]}'), ("c", '{"sources": [{"id": "S1", "label": "direct"}]}'), ("d", '{"sources": 3}'), ("e", "[]"), ("f", "no"), ("g", None)]
    got = {r.research_id: r.problem for r in parse(spark.createDataFrame(rows, "research_id string, text string")).collect()}
    assert got == {"a": None, "b": "no usable classifications", "c": "no usable classifications", "d": "output had no sources array", "e": "output was not an object", "f": "output was not valid JSON", "g": "output was not valid JSON"}


def test_an_answer_is_read_once_and_not_kept(spark, monkeypatch):
    kept = []

    def staged(df, name, write=fallback.staged):
        kept.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(fallback, "staged", staged)
    body = '{"candidates": [{"content": {"parts": [{"text": "{\\"overview\\": {\\"summary\\": \\"s\\"}}"}]}, "finishReason": "STOP"}], "usageMetadata": {"promptTokenCount": 3}}'
    ask = lambda m, rows: rows.select("research_id", F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"), F.concat(F.lit(body), F.left("research_id", F.lit(0))).alias("body"))
    requests = spark.createDataFrame([("a",), ("b",)], "research_id string")
    (a, b) = fallback.generate(requests, [FIRST], ask, lambda m, rows: (rows, fallback.analysis_parser()), {}).collect()
    assert {a.research_id, b.research_id} == {"a", "b"} and a.value.overview.summary == "s" and (a.input_tokens, a.model, a.error) == (3, "m1", None)
    ((columns, plan),) = kept
    assert columns == ["research_id", "failed", "why", "got"]
    assert plan.count("parseJson") == 2 and plan.count("from_json(") == 1  # the body and its text, and the text by its schema
