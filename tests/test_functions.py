"""Scalar rules on rows of our own."""

import pytest
from pyspark.sql import functions as F

from sourceloom.functions import format as fmt
from sourceloom.functions import geo, text, url
from sourceloom.operators import analysis, entities, normalize, relevance, report, store
from sourceloom.sources import feeds, lookups


def apply(spark, f, values, schema="x string"):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    cols = [F.col(c) for c in df.columns]
    return [r[0] for r in df.select(f(*cols)).collect()]


@pytest.mark.parametrize(("raw", "want"), [
    ("http://www.Example.com/a/?utm_source=x&b=2&a=1#t", "https://example.com/a?a=1&b=2"), ("https://u:p@ex.com:443/A b/../c/", "https://ex.com/c"), ("ftp://x", None), ("http://ex.com", "https://ex.com/"),
    ("https://ex.com:8080/x//?q=a+b", "https://ex.com:8080/x?q=a+b"), ("nonsense", None), ("", None), (None, None), ("https://ex.com./Case", "https://ex.com/Case"), ("https://ex.com/a b", "https://ex.com/a%20b"),
    ("https://ex.com/?a=2&B=1&fbclid=z", "https://ex.com/?a=2&B=1"), ("https://ex.com/é", "https://ex.com/%C3%A9"), ("http:///x", "https://x/"), ("http://", None),
])
def test_canonical_url(spark, raw, want):
    assert apply(spark, url.canonical_url, [(raw,)]) == [want]


def test_domains(spark):
    assert apply(spark, url.registrable_domain, ["app.navi.com", "https://www.example.co.uk/x", "localhost", "1.2.3.4", "a.b.com.au"]) == ["navi.com", "example.co.uk", None, None, "b.com.au"]
    f = lambda d, n: url.domain_matches_name(d, n)
    rows = [("cred.club", "CRED"), ("recurclub.com", "Recur Club"), ("cashfree.com", "Cashfree Payments"), ("getcred.in", "CRED"), ("creditsuisse.com", "CRED"), ("ab.com", "AB"), (None, "x")]
    assert apply(spark, f, rows, "d string, n string") == [True, True, True, True, False, False, False]


def test_text(spark):
    assert apply(spark, text.decode_entities, ["a &amp; b &#233; &#x1F600; &foo; &lt;&#0;", "&amp;lt;", None, ""]) == ["a & b é 😀 &foo; <&#0;", "&lt;", None, ""]
    assert apply(spark, text.html_to_text, ["<p>Hi&nbsp;there</p><script>x<y</script><style>p{}</style> The post A appeared first on B."]) == ["Hi there"]
    assert apply(spark, text.squash, ["EU-Startups", "Zürich ﬁn ½", "日本 5"]) == ["eustartups", "zurichfin12", "日本5"]
    tokens = apply(spark, text.title_tokens, ["Exein raises $270 Million, hits 1.7bn valuation: 10,000 users in Europe", "B2B firm gets €16M for startups", "10 M&A deals", ""])
    assert tokens[0] == ["exein", "raise", "270m", "hits", "1.7b", "valuation", "10000", "user", "europe"]
    assert "2b" in tokens[1] and "16m" in tokens[1] and "10m" in tokens[2] and tokens[3] == []
    assert apply(spark, text.search_keywords, ["Research cybersecurity startups in Europe", "the of", None]) == ["cybersecurity startups europe", None, None]
    assert apply(spark, text.round2, [(0.285,), (-0.125,), (1.005,)], "x double") == [0.28, -0.12, 1.0]
    assert apply(spark, text.estimate_tokens, ["", "12345678"]) == [0, 3]


def test_places(spark):
    assert set(geo.find_places("Robotics in South Africa and the US")) == {"south africa", "africa", "united states"}
    assert set(geo.find_places("Latin America fintech")) == {"latin america", "united states"}
    assert geo.find_places("contact us") == []
    assert apply(spark, geo.countries_mentioned, ["Tokyo-based startup and a German firm", "contact us", "US firm", "Germany2024"]) == [["germany", "japan"], [], ["united states"], ["germany"]]
    assert apply(spark, geo.norm_country, ["The U.S.", "Holland", "Peru"]) == ["united states", "netherlands", "peru"]


def test_titles(spark):
    clean = lambda t, p, u: normalize.clean_title(t, p, u)
    rows = [
        ("Big news about robots | Wellfound", None, "https://wellfound.com/x"), ("Big news about robots - Other Place", None, "https://wellfound.com/x"), ("10 startups to watch…", None, "https://a.com"), ("2026", None, "https://a.com"),
        ("• Robots &amp; more ...", None, "https://a.com"), ("One two - Wikipedia", None, "https://en.wikipedia.org/x"), (None, None, "https://a.com"), ("A b c – d e f – EU Startups", "EU-Startups", "https://x.org"),
    ]
    got = apply(spark, clean, rows, "t string, p string, u string")
    assert [g and (g["title"], g["truncated"]) for g in got] == [
        ("Big news about robots", False), ("Big news about robots - Other Place", False), ("startups to watch", True), None, ("Robots & more", True), ("One two - Wikipedia", False), None, ("A b c – d e f", False)]
    assert apply(spark, normalize.is_junk_title, ["Access denied", "404 | site", "Errors happen", "just a moment...", "404-page"]) == [True, True, False, True, False]
    pub = lambda u, p: normalize.canonical_publisher(u, p)
    assert apply(spark, pub, [("https://www.inc42.com/a", "x"), ("https://a.org/", "a.org"), ("https://a.org/", "The A"), ("https://a.org/", None)], "u string, p string") == ["Inc42", "a.org", "The A", "a.org"]


def test_off_purpose(spark):
    f = lambda t, u: relevance.off_purpose(t, u)
    rows = [("Robotics jobs in Japan", "https://a.com"), ("The robot isn't coming for your job", "https://a.com"), ("Log in", "https://a.com"), ("Fine", "https://www.indeed.com/x"), (None, "https://a.com"), ("We're actively hiring", "https://a.com")]
    assert apply(spark, f, rows, "t string, u string") == ["job listing", None, "not an article", "job listing", None, "job listing"]


def test_small_rules(spark):
    now = F.lit("2026-09-24T00:00:00Z").cast("timestamp")
    assert [str(d) if d else None for d in apply(spark, lambda x: analysis.valid_date(x, now), ["2026-09-25", "2026-09-26", "2026-02-30", "1 May", " 2020-01-02 ", None])] == ["2026-09-25", None, None, None, "2020-01-02", None]
    assert apply(spark, lambda t, h: analysis.mentions_host(t, h), [("see aimagazine.com", "ai.com"), ("x AI.com y", "ai.com")], "t string, h string") == [False, True]
    assert apply(spark, lambda a, b: report.display_label(a, b), [("direct", False), (None, False), (None, None), (None, True)], "a string, b boolean") == ["direct", "irrelevant", "unclassified", "unclassified"]
    got = apply(spark, lambda a, b: store.valid_input(a, b), [("  a  b c ", " "), ("ab", None), ("x" * 501, None), (None, None)], "a string, b string")
    assert [g and (g["query"], g["focus"]) for g in got] == [("a b c", None), None, None, None]
    assert apply(spark, store.is_uuid, ["3f2504e0-4f89-11d3-9a0c-0305e82c3301", "x"]) == [True, False]
    times = apply(spark, feeds.feed_time, ["Tue, 22 Sep 2026 10:00:00 GMT", "22 Sep 2026 10:00:00 +0200", "2026-09-22T10:00:00Z", "soon", None])
    assert [t and t.isoformat() for t in times] == ["2026-09-22T10:00:00", "2026-09-22T08:00:00", "2026-09-22T10:00:00", None, None]
    r = apply(spark, lambda p, y: entities.reconcile_type(p, F.lit("said"), y, F.array(F.lit("Q1")), F.lit(2026)), [("startup", 2010), ("startup", 2015), ("investor", 1900), ("startup", None)], "p string, y int")
    assert [x["type"] for x in r] == ["established_company", "startup", "investor", "startup"]
    assert feeds.provider_order(" Groq, x,groq ") == ["groq"] and feeds.provider_order(None) == ["gemini", "groq"]
    assert feeds.ddl_of({"type": "object", "properties": {"a": {"type": "array", "items": {"type": "number"}}}}) == "struct<a:array<double>>"


def test_formats_and_lookups(spark):
    now = F.lit("2026-09-24T12:00:00Z").cast("timestamp")
    rel = lambda x: fmt.show_relative(x.cast("timestamp"), now)
    assert apply(spark, rel, ["2026-09-24T11:59:30Z", "2026-09-24T09:00:00Z", "2026-09-23T12:00:00Z", "2025-09-01T00:00:00Z", "2026-09-26T12:00:00Z", None]) == ["just now", "3 hours ago", "yesterday", "last year", "in 2 days", None]
    assert apply(spark, lambda x: fmt.show_time(x.cast("timestamp")), ["2026-09-24T10:05:00Z"]) == ["24 Sept 2026, 10:05 UTC"]
    assert apply(spark, fmt.show_duration, [(41_600,), (185_000,), (-5,)], "x long") == ["42s", "3m 05s", "0s"]
    assert apply(spark, lambda n: fmt.plural(n, "match", "matches"), [(1,), (2,)], "n int") == ["1 match", "2 matches"]
    rows = spark.createDataFrame([('[{"name": "A", "domain": "a.com"}, {"name": 1, "domain": "b.com"}, {"name": "C"}]',), ("{}",), (None,)], "response string")
    assert [[tuple(s) for s in r.suggestions] for r in lookups.suggestions(rows).collect()] == [[("A", "a.com")], [], []]
    waits = apply(spark, lambda s, a, r: lookups.retry_wait_ms(s, a, r), [(503, 0, None), (503, 9, None), (429, 0, None), (429, 0, 3), (404, 0, None)], "s int, a int, r int")
    assert waits == [500, 10_000, 2_000, 3_000, None]
    ok = apply(spark, lambda m, u, k: lookups.is_repeatable(m, u, k), [("get", None, None), ("POST", True, None), ("POST", False, None), ("POST", None, True), (None, None, None)], "m string, u boolean, k boolean")
    assert ok == [True, True, False, True, True]
    assert lookups.vendor_schema({"type": "object", "properties": {"a": {"type": "string", "enum": ["x"]}}, "required": ["a"]})["properties"]["a"] == {"type": "STRING", "format": "enum", "enum": ["x"]}
