"""Registered queries over whole titles and texts, against the literal rules on small tables of our own."""

import math
import os
import re
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from sourceloom import queries as Q
from sourceloom.functions import lexicon as L

FILL = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu"
TEXTS = {
    1: f"{FILL} erst hation\nbody", 2: f"{FILL} maple cedar birch aspen willow poplar\nbody", 3: f"{FILL} erst hation\nother body", 4: "the\nx " + "pad " * 90 + "erst hation ther", 5: "the of and\n",
    6: f"{'the ' * 45}granite marble basalt slate\nbody", 7: f"{'of ' * 60}granite marble basalt slate\nbody", 8: "short words here now", 9: "no topic " + "pad " * 90, 11: f"{FILL}\nhation",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    docs = [(k, v, "en", "web" if k % 2 else "news", len(v)) for k, v in TEXTS.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("source", F.lit("web")).write.parquet(f"{path}/documents.parquet")
    pages = [(1, "https://a.com/x", f"<title>T</title><p>{'pad ' * 200}erst</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def line(text):
    return text.split("\n")[0]


def tokens(title):
    t = title.lower()
    for words, unit in (("million|mn|mln|m", "m"), ("billion|bn|b", "b")):
        t = re.sub(rf"(\d+)[.,](\d+)\s*(?:{words})(?!\w)", rf" \1.\2{unit} ", t)
        t = re.sub(rf"(?<![\d][.,])(?<!\d)(\d+)\s*(?:{words})(?!\w)", rf" \1{unit} ", t)
    t = re.sub(r"(\d)[.,](?=\d{3}(?!\w))", r"\1", t)
    raw = [x.strip(".") for x in re.split(r"[^a-z0-9.]+", t)]
    kept = [x for x in raw if x and x not in L.TITLE_STOPWORDS]
    return list(dict.fromkeys(x[:-1] if len(x) > 4 and x.endswith("s") and not x.endswith("ss") else x for x in kept))


def sql_rows(name, path):
    """Rows of a query's SQL over the tables at path."""
    con = duckdb.connect()
    for table in os.listdir(path):
        if table.endswith(".parquet"):
            con.sql(f"CREATE VIEW {table[:-8]} AS SELECT * FROM '{path}/{table}/*.parquet'")
    return sorted(con.sql(Q.ORACLES[name]).fetchall())



def day(k):
    return datetime(2024, 1, 1) + timedelta(k % 30) if k % 5 else None


def literal_match(a, b):
    x, y, gap = set(a[0]), set(b[0]), abs(a[1] - b[1]).days if a[1] and b[1] else None
    if gap is not None and gap > 4:
        return None
    shared = len(x & y)
    j, c = shared / max(len(x | y), 1), shared / max(min(len(x), len(y)), 1)
    money = [t for t in x & y if re.fullmatch(r"\d+(\.\d+)?[mb]", t)]
    subject = [t for t in x & y if t not in money and t not in L.GENERIC_WORDS and not t.isdigit()]
    r2 = lambda v: math.floor(v * 100 + 0.5) / 100
    if shared >= 3 and j >= 0.9:
        return "same_title", r2(j)
    if gap is not None and gap <= 3 and money and subject:
        return "same_figure", 1.0
    if gap is not None and shared >= 3 and max(j, c * 0.85) >= 0.7:
        return "similar_title", r2(max(j, c * 0.85))
    return None


def literal_pairs(rows):
    """{(a, b): (reason, similarity)} of {id: (tokens, time)}."""
    return {(a, b): m for a in rows for b in rows if a < b and (m := literal_match(rows[a], rows[b]))}


def literal_clusters(rows):
    """{id: primary} of the greedy loop over stories in order."""
    pairs, groups, out = literal_pairs(rows), [], {}
    for s in sorted(rows):
        for g in groups:
            if (g[0], s) in pairs or any(pairs.get((d, s), ("",))[0] == "same_figure" for d in g[1:]):
                g.append(s)
                out[s] = g[0]
                break
        else:
            groups.append([s])
            out[s] = s
    return out


def test_titles_are_whole(spark, tables):
    want = {k: " ".join(sorted(tokens(line(v)))) for k, v in TEXTS.items()}
    assert {r.doc_id: r.tokens for r in Q.q_title_tokens(spark, tables).collect()} == want
    words = {}
    for k, v in TEXTS.items():
        found = [w for w in dict.fromkeys(x.strip("-") for x in re.split("[^a-z-]+", line(v).lower())) if len(w) >= 3 and w not in L.KEYWORD_STOPWORDS]
        if found:
            words[k] = " ".join(found[:3])
    assert {r.doc_id: r.keywords for r in Q.q_search_keywords(spark, tables).collect()} == words and words[7].startswith("granite")
    assert all(line(TEXTS[r.doc_id]) in r.line for r in Q.q_prompt_lines(spark, tables).collect())


def test_stories_of_whole_titles(spark, tables):
    rows = {k: (tokens(line(v)), day(k)) for k, v in TEXTS.items()}
    want = literal_pairs(rows)
    assert {(r.a, r.b): (r.reason, r.similarity) for r in Q.q_story_pairs(spark, tables).collect()} == want and want[1, 2][0] == "similar_title" and (6, 7) in want
    primary = literal_clusters(rows)
    assert {r.seq: r.primary_seq for r in Q.q_story_clusters(spark, tables).collect()} == primary
    sizes = {p: list(primary.values()).count(p) for p in primary.values()}
    assert {r.primary_seq: r.members for r in Q.q_story_sizes(spark, tables).collect()} == sizes


def test_relevance_of_whole_texts(spark, tables):
    want = {}
    for k, v in TEXTS.items():
        hit = lambda w, s: re.search(rf"(?i)(^|[^a-z])({w}|{w}s)($|[^a-z])", s)
        field = lambda w: 1.0 if hit(w, line(v)) else 0.6 if hit(w, v) else 0.4 if w == "erst" else 0.0  # noqa: B023, E731
        raw = sum(map(field, Q.TOPIC)) / 2 + 0.1 * field(Q.SIDE) + 0.1 * (k % 3 == 2) - 0.15 * (k % 5 != 0)
        raw = min(max(raw, 0.0), 1.0)
        want[k] = (math.floor(raw * 100 + 0.5) / 100, raw >= 0.45)
    got = {r.seq: r for r in Q.q_keyword_relevance(spark, tables).collect()}
    assert {k: (r.score, r.relevant) for k, r in got.items()} == want and want[4][1]
    labels = {r.seq: r.label for r in Q.q_fallback_labels(spark, tables).collect()}
    assert labels == {k: "irrelevant" if not rel else "direct" if s >= 0.7 else "contextual" for k, (s, rel) in want.items()}
    (funnel,) = Q.q_relevance_funnel(spark, tables).collect()
    assert (funnel.collected, funnel.filtered) == (len(TEXTS), list(labels.values()).count("irrelevant"))
    assert {r.primary_seq: r.score for r in Q.q_promote_top_stories(spark, tables).collect()} == {k: s for k, (s, _) in want.items()}
    best = {}
    for k, (s, _) in want.items():
        best[k - k % 4] = max(s, best.get(k - k % 4, 0))
    assert {r.primary_seq: r.score for r in Q.q_best_member(spark, tables).collect()} == best
    assert sum(r.n for r in Q.q_reason_histogram(spark, tables).collect()) == sum(not rel for _, rel in want.values())
    assert [(a, b) for a, b, *_ in sql_rows("keyword_relevance", tables)] == sorted((k, x) for k, (x, _) in want.items())
    (found,) = Q.candidates(spark, tables).collect()
    assert found.snippet.endswith("erst")


def test_titles_with_figures(spark, tmp_path):
    texts = {
        11: "Exein raises $270 Million for chips", 13: "Italy's Exein hits unicorn status with $270m", 16: "Fresh Exein money: 270 mn confirmed yesterday", 17: "Other people got 270 million euro", 18: "A 1,500 strong crew won 2.5 bn and 16 million",
        19: "Crew with 1500 people gets 2,5 billion", 20: "Sums 1,500,000,000 or 1m 2m 3.5m of 1.000.000 and v.500 x,500 12,34m9", 21: "Model 7 of 2024 released early today", 22: "Model 7 of 2024 released early today\nbody",
    }
    docs = [(k, v, "en", "web", len(v)) for k, v in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {k: (tokens(line(v)), day(k)) for k, v in texts.items()}
    got = {r.doc_id: r.tokens for r in Q.q_title_tokens(spark, str(tmp_path)).collect()}
    assert got == {k: " ".join(sorted(v)) for k, (v, _) in rows.items()} and {"1500", "2.5b", "16m"} <= set(got[18].split())
    want = literal_pairs(rows)
    assert {(r.a, r.b): (r.reason, r.similarity) for r in Q.q_story_pairs(spark, str(tmp_path)).collect()} == want
    assert want[11, 13][0] == want[18, 19][0] == "same_figure" and (11, 16) not in want and want[21, 22][0] == "same_title"
    primary = literal_clusters(rows)
    assert {r.seq: r.primary_seq for r in Q.q_story_clusters(spark, str(tmp_path)).collect()} == primary
    assert primary[16] == 11  # through a duplicate
    assert sql_rows("title_tokens", tmp_path) == sorted((k, " ".join(sorted(v))) for k, (v, _) in rows.items())
    assert sql_rows("story_pairs", tmp_path) == sorted(("web", a, b, r, x) for (a, b), (r, x) in want.items())
    assert sql_rows("story_clusters", tmp_path) == sorted(("web", a, b) for a, b in primary.items())
    sizes = {p: list(primary.values()).count(p) for p in primary.values()}
    assert {r.primary_seq: r.members for r in Q.q_story_sizes(spark, str(tmp_path)).collect()} == sizes


def test_site_suffix_of_all_pages(spark, tmp_path):
    titles = {2: "One two three", 4: "Short head", 6: "Some news: a - b of them", 8: "Head words here | Acme", 10: "", 1: "Short", 3: "A - b | c", 5: "", 7: "One two three - Zzyzx Nowhere", 12: "Well-known things of today"}
    rows = [(k, f"https://www.acme.com/{k}", f"<html><title>{v}</title></html>") for k, v in titles.items()] + [(14, "https://acme.com/", "<p>no title</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {}
    for k, v in (titles | {14: ""}).items():
        full = f"{v} | " + ("Zzyzx Nowhere" if k % 2 else "acme.com")
        cut = [m for m in re.finditer(r"\s+[|·:–—-]\s+", full)][-1:]  # the last separator
        head, tail = (full[: cut[0].start()], re.sub("[^a-z0-9]", "", full[cut[0].end() :].lower())) if cut else ("", "")
        site = any(tail.startswith(n) or n.startswith(tail) for n in ("acmecom", "acme"))
        want[k] = head if head and tail and site and len(head.split()) >= 3 else full
    assert {r.page_id: r.title for r in Q.q_site_suffix(spark, str(tmp_path)).collect()} == want
    assert sql_rows("site_suffix", tmp_path) == sorted(want.items())
    assert want[2] == "One two three" and want[4] == "Short head | acme.com" and want[8] == "Head words here | Acme"


def test_clean_title_keeps_what_only_looks_like_a_site(spark, tmp_path):
    titles = {1: "One two three | t", 2: "One two three | The", 3: "One two three - Theory", 4: "12 • Robots &amp; more ...", 5: "2026", 6: "One two three | x"}
    rows = [(k, f"https://www.theory.com/{k}", f"<html><title>{v}</title></html>") for k, v in titles.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {k: (v, False) for k, v in titles.items()} | {4: ("Robots & more", True), 5: (None, False)}
    assert {r.page_id: (r.title, r.truncated) for r in Q.q_clean_title(spark, str(tmp_path)).collect()} == want
    assert sql_rows("clean_title", tmp_path) == sorted((k, *v) for k, v in want.items())


def test_site_suffix_behind_a_separator_at_the_end(spark, tmp_path):
    titles = {2: "One two three |", 4: "One two three | |", 6: "One | two | three -", 8: "One two |", 1: "One two three |"}
    rows = [(k, f"https://www.acme.com/{k}", f"<html><title>{v}</title></html>") for k, v in titles.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {**titles, 1: "One two three | | Zzyzx Nowhere"}
    assert {r.page_id: r.title for r in Q.q_site_suffix(spark, str(tmp_path)).collect()} == want
    assert sql_rows("site_suffix", tmp_path) == sorted(want.items())


def test_amounts_that_touch(spark, tmp_path):
    texts = {1: "password 1053b640f4974d8b5b today", 2: "token 4fd40b1b", 3: "x1b2b3b and 1m2m", 4: "1 million 2 million 3 mn 4m 5m", 5: "7m8b of 2.5m3b"}
    docs = [(k, v, "en", "web", len(v)) for k, v in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.tokens for r in Q.q_title_tokens(spark, str(tmp_path)).collect()}
    assert got[1] == "1053b640f4974d 5b 8b password today" and got[2] == "1b 40b 4fd token"
    assert sql_rows("title_tokens", tmp_path) == sorted(got.items())
