"""Story pairs and clusters against the literal rules on random titles with amounts, by the fold and by rounds; sizes of candidate joins."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import stories

from .test_whole_inputs import literal_clusters, literal_pairs

NAMES = [f"name{i}" for i in range(12)]
MONEY = ["5m", "270m", "1.5b", "16m"]
FILL = [f"word{i}" for i in range(40)]


def titles(rng, n):
    """{seq: (tokens, time)}: rewritten, extended and bridged titles of a few events."""
    events = [rng.sample(FILL, rng.choice([3, 6, 10, 18])) + [rng.choice(NAMES)] + rng.sample(MONEY, rng.choice([0, 1, 1, 2])) for _ in range(8)]
    rows = {}
    for i in range(n):
        own = list(rng.choice(events))
        for _ in range(rng.choice([0, 0, 1, 2])):
            own[rng.randrange(len(own))] = rng.choice(FILL + NAMES + MONEY + ["funding", "2024"])
        own += rng.sample(FILL, rng.choice([0, 0, 0, 2, 9]))
        when = None if rng.random() < 0.25 else datetime(2024, 1, 1) + timedelta(days=rng.randrange(12))
        rows[i] = (list(dict.fromkeys(own)) if rng.random() > 0.03 else [], when)
    return rows


def frame(spark, researches):
    rows = [(r, s, tk, tk, ts) for r, of in researches.items() for s, (tk, ts) in of.items()]
    return spark.createDataFrame(rows, "research_id string, seq long, tokens array<string>, all_tokens array<string>, published_at timestamp").repartition(4)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(12)
    return {f"r{i}": titles(rng, n) for i, n in enumerate((60, 90, 40))}


def test_pairs_against_all_pairs(spark, cases):
    got = {(r.research_id, r.a, r.b): (r.reason, r.similarity) for r in stories.story_pairs(frame(spark, cases)).collect()}
    want = {(r, a, b): m for r, rows in cases.items() for (a, b), m in literal_pairs(rows).items()}
    assert got == want and {m for m, _ in want.values()} == {"same_title", "similar_title", "same_figure"}


@pytest.mark.parametrize("most", [stories.FOLD_EDGES, 0, 150])
def test_clusters_against_the_loop(spark, cases, monkeypatch, most):
    """All researches folded, all settled in rounds, or each as its matches are few or many."""
    monkeypatch.setattr(stories, "FOLD_EDGES", most)
    got = {(r.research_id, r.seq): r.primary_seq for r in stories.story_clusters(frame(spark, cases)).collect()}
    assert got == {(r, s): p for r, rows in cases.items() for s, p in literal_clusters(rows).items()}


def test_rounds_record_the_same_matches(spark, cases):
    pairs = stories.story_pairs(frame(spark, cases)).select("research_id", F.col("b").alias("s"), F.col("a").alias("m"), "reason", "similarity").cache()
    a, b = (sorted(map(tuple, f(pairs).collect())) for f in (stories.fold_edges, stories.settle_in_rounds))
    assert a == b and any(reason == "same_figure" for _, _, _, reason, _ in a)


def test_copies_settle_in_few_rounds(spark, monkeypatch):
    """Many copies of one title by figure: each round settles all that see a story none can beat, not one copy."""
    edges = spark.createDataFrame([("r", s, m, "same_figure", 1.0) for s in range(40) for m in range(s)], "research_id string, s long, m long, reason string, similarity double")
    names = []
    monkeypatch.setattr(stories, "staged", lambda df, name, staged=stories.staged: names.append(name) or staged(df, name))
    assert {(r.seq, r.primary_seq) for r in stories.settle_in_rounds(edges).collect()} == {(s, 0) for s in range(1, 40)}
    assert names.count("open-matches") <= 3


def test_a_common_amount_makes_no_square(spark):
    """A thousand titles of one amount, each with its own subject: no candidates; over a year: those of near days alone."""
    day = lambda i: datetime(2024, 1, 1) + timedelta(days=i)
    own = {i: (["5m", f"firm{i}", "funding"], day(0)) for i in range(1000)}
    n = lambda rows: stories.figure_candidates(frame(spark, {"r": rows}).withColumns({"n": F.size("tokens"), "ms": F.unix_millis("published_at")})).distinct().count()
    assert n(own) == 0
    assert n({i: (["5m", "acme"], day(i)) for i in range(300)}) == 299 + 298 + 297


def test_similar_titles_meet_on_near_days_alone(spark):
    day = lambda i: datetime(2024, 1, 1) + timedelta(days=i)
    rows = {i: (["one", "two", "three", "four", f"x{i}"], day(5 * i)) for i in range(200)}
    made = stories.title_candidates(frame(spark, {"r": rows}).withColumns({"n": F.size("tokens"), "ms": F.unix_millis("published_at")}))
    assert made.count() == 0 and literal_pairs(rows) == {}


def test_copies_against_the_loop(spark, monkeypatch):
    """Many copies of few titles, with and without figures: primaries and recorded matches are those of all pairs, and compared are classes alone."""
    rng = random.Random(4)
    some = list(titles(rng, 14).values()) + [(["5m", "acme"], datetime(2024, 1, 2)), (["5m", "acme", "ipo"], datetime(2024, 1, 3)), (["one", "two"], datetime(2024, 1, 2)), (["alpha", "bravo", "charlie"], None)]
    cases = {r: dict(enumerate(rng.choices(some, k=80))) for r in ("r0", "r1", "r2")}
    rows = frame(spark, cases)
    pairs = stories.story_pairs(rows)
    assert {(r.research_id, r.a, r.b): (r.reason, r.similarity) for r in pairs.collect()} == {(r, a, b): m for r, of in cases.items() for (a, b), m in literal_pairs(of).items()}
    want = sorted(map(tuple, stories.story_clusters(rows, pairs).collect()), key=repr)
    assert {(r, s): p for r, s, p, *_ in want} == {(r, s): p for r, of in cases.items() for s, p in literal_clusters(of).items()}
    for most in (stories.FOLD_EDGES, 0):
        monkeypatch.setattr(stories, "FOLD_EDGES", most)
        assert sorted(map(tuple, stories.story_clusters(rows).collect()), key=repr) == want


def test_copies_make_no_square(spark):
    """300 copies of a title: a class without candidates, and no match that decides."""
    copies = {i: (["one", "two", "three", "four"], None) for i in range(300)}
    members, classes = stories.title_classes(frame(spark, {"r": copies}))
    edges, followers = stories.deciding_matches(members, classes)
    assert (classes.count(), edges.count(), followers.count()) == (1, 0, 299)
    assert {r.primary_seq for r in stories.story_clusters(frame(spark, {"r": copies})).collect()} == {0}


def test_pairs_of_copies_come_from_lists(spark, monkeypatch):
    """250 copies over lists of 40 rows and a near copy: every pair once, though one pair of classes was found."""
    monkeypatch.setattr(stories, "LIST", 40)
    rows = {i: (["one", "two", "three", "four"], None) for i in range(250)} | {250: (["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"], None)} | {251: (["five", "six", "seven", "eight", "nine", "ten", "one", "two", "three", "four", "eleven"], None)}
    df = frame(spark, {"r": rows})
    members, classes = stories.title_classes(df)
    assert stories.class_pairs(classes).count() == 1 and members.count() == 252
    got = [(r.a, r.b) for r in stories.story_pairs(df).collect()]
    assert len(got) == len(set(got)) == 250 * 249 // 2 + 1 and (250, 251) in got


def test_common_words_make_few_candidates(spark):
    """400 titles of one day and 60 words: each rare word leads to dozens of titles, of which those that may match go on."""
    rng = random.Random(7)
    rows = {i: (rng.sample([f"word{k}" for k in range(60)], rng.choice([8, 10, 12])), datetime(2024, 1, 1)) for i in range(400)}
    rows |= {400 + i: (rows[i][0] + [f"word{60 + i}"], datetime(2024, 1, 2)) for i in range(20)}
    made = stories.title_candidates(frame(spark, {"r": rows}).withColumns({"n": F.size("tokens"), "ms": F.unix_millis("published_at")}))
    made = {(min(r.ps, r.seq), max(r.ps, r.seq)) for r in made.collect()}
    want = set(literal_pairs(rows))
    assert len(want) >= 20 and want <= made and len(made) <= 3 * len(want)


def test_sizes_of_copies_grow_with_the_rows(spark, monkeypatch):
    """Copies of few titles with amounts: what is written on the way to the sizes of stories grows with the copies, not with their square."""
    written = []

    def counted(df, name, staged=stories.staged):
        out = staged(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(stories, "staged", counted)
    some = [(["one", "two", "three", "four"], None), (["alpha", "bravo", "charlie", "delta"], datetime(2024, 1, 2)), (["5m", "acme", "ipo"], datetime(2024, 1, 3))]

    def most(copies):
        written.clear()
        got = stories.story_sizes(stories.story_clusters(frame(spark, {"r": {i: some[i % 3] for i in range(3 * copies)}}))).collect()
        assert {(r.primary_seq, r.members, r.also_reported_by) for r in got} == {(i, copies, copies - 1) for i in range(3)}
        return max(written)

    assert most(120) <= 4.4 * most(30)
