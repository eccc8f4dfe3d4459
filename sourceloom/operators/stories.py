"""Stories: which sources report the same one.

Pairs come from inverted indexes, not from all pairs. Titles' tokens are ordered from the rarest on, in one order for all titles of a research.

* Equal titles have a Jaccard similarity of 0.9: the rarest floor(n / 10) + 1 tokens of both hold a common one, whatever the dates.
* Similar titles share at least 14 / 17 of the smaller one's tokens and are dated within four days of each other: one of its rarest floor(3 n / 17) + 1
  tokens is in the larger title, among those of the same days.
* Titles that match by figure share an amount, a subject and three days: one index of all three.

A common token still makes pairs by the square of its titles. So each posting has its title's set of token hashes, a few machine words: a pair goes on only
if the bits that the larger title lacks leave the smaller one enough tokens to match. What is shuffled with whole titles are then about the matches.

Clusters are greedy in the sources' order. Researches of few matches are folded, match by match; those of many are settled in rounds
of joins: a source is settled as soon as what is still open can't lead it to an earlier story.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import is_money, round2, title_tokens
from ..sources.scratch import staged

DAY_MS = 24 * 60 * 60 * 1000
#: Shared tokens, Jaccard of equal titles, weight of containment, similarity, days apart by veto and for figures.
MIN_SHARED, SAME, CONTAINMENT, SIMILAR, VETO_DAYS, FIGURE_DAYS = 3, 0.9, 0.85, 0.7, 4, 3
#: Machine words of a title's set of token hashes.
SET_WORDS = 4
#: Matches of a research that one task folds; researches of more are settled in rounds.
FOLD_EDGES = 100_000


def with_tokens(sources: DataFrame, title: str = "title", ignore: str | None = None, passes: int = 1) -> DataFrame:
    """sources with all_tokens and tokens (those not in the array column `ignore`)."""
    out = sources.withColumn("all_tokens", F.coalesce(title_tokens(F.col(title), passes), F.array().cast("array<string>")))
    return out.withColumn("tokens", F.array_except("all_tokens", F.coalesce(F.col(ignore), F.array().cast("array<string>"))) if ignore else F.col("all_tokens"))


def is_subject(t: Column) -> Column:
    """Whether a token says what a title is about: no amount, no number, no word of all such titles."""
    return ~is_money(t) & ~t.isin(L.GENERIC_WORDS) & ~t.rlike(r"^\d+$")


def match(a: str, b: str) -> Column:
    """struct<reason, similarity> of two sources' structs (tokens, all_tokens, published_at), null if they don't match."""
    c = lambda x: F.col(x)
    at, bt = c(f"{a}.tokens"), c(f"{b}.tokens")
    gap = F.abs(F.unix_millis(f"{a}.published_at") - F.unix_millis(f"{b}.published_at"))
    shared = F.size(F.array_intersect(at, bt)).cast("double")
    jaccard = shared / F.greatest(F.size(F.array_union(at, bt)), F.lit(1))
    held = shared / F.greatest(F.least(F.size(at), F.size(bt)), F.lit(1))
    both = F.array_intersect(f"{a}.all_tokens", f"{b}.all_tokens")
    figure = (gap <= FIGURE_DAYS * DAY_MS) & F.exists(both, is_money) & F.exists(both, is_subject)
    similarity = F.greatest(jaccard, held * CONTAINMENT)
    row = lambda r, s: F.struct(F.lit(r).alias("reason"), s.alias("similarity"))
    return (
        F.when(gap > VETO_DAYS * DAY_MS, None)
        .when((shared >= MIN_SHARED) & (jaccard >= SAME), row("same_title", round2(jaccard)))
        .when(F.coalesce(figure, F.lit(False)), row("same_figure", F.lit(1.0)))
        .when(gap.isNotNull() & (shared >= MIN_SHARED) & (similarity >= SIMILAR), row("similar_title", round2(similarity)))
    )


def _bucket(days: int, step: int = 0) -> Column:
    return F.floor(F.col("ms") / (days * DAY_MS)) + step


def title_candidates(rows: DataFrame) -> DataFrame:
    """(research_id, ps, seq): pairs that may match by title, from rows research_id, seq, n, ms, tokens."""
    posted = rows.where(F.col("n") >= MIN_SHARED).select("research_id", "seq", "n", "ms", F.explode("tokens").alias("token"))
    df = posted.groupBy("research_id", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # tokens of one title alone are the rarest and lead nowhere: they use up their places
    order = Window.partitionBy("research_id", "seq").orderBy("df", "token")
    whole = Window.partitionBy("research_id", "seq")
    alone = F.col("n") - F.count(F.lit(1)).over(whole)
    sets = [f"set{k}" for k in range(SET_WORDS)]
    bit = F.pmod(F.xxhash64("token"), F.lit(64 * SET_WORDS))
    word = lambda k: F.bit_or(F.expr(f"IF(bit DIV 64 = {k}, shiftleft(1L, CAST(bit % 64 AS INT)), 0L)")).over(whole)
    shared = posted.join(df, ["research_id", "token"]).withColumn("bit", bit).withColumns({"r": F.row_number().over(order) + alone, "alone": alone} | {x: word(k) for k, x in enumerate(sets)})
    shared = staged(shared.select("research_id", "token", "seq", "n", "ms", "r", "alone", *sets), "postings")
    own = [F.col("seq").alias("ps"), F.col("n").alias("pn"), F.col("ms").alias("pms"), F.col("alone").alias("palone"), *[F.col(x).alias(f"p{x}") for x in sets]]
    probe = lambda cols, most: shared.where(F.col("r") <= most).select("research_id", "token", *own, *cols)
    # at least so many tokens of the smaller title aren't in the larger one
    lacks = reduce(Column.__add__, [F.bit_count(F.col(f"p{x}").bitwiseAND(F.bitwise_not(x))) for x in sets], F.col("palone"))
    larger = (F.col("n") > F.col("pn")) | ((F.col("n") == F.col("pn")) & (F.col("seq") > F.col("ps")))
    near = lambda days: F.abs(F.col("ms") - F.col("pms")) <= days * DAY_MS
    first = F.floor(F.col("n") / 10) + 1
    same = probe([], first).join(shared.where(F.col("r") <= first), ["research_id", "token"])
    same = same.where(larger & (10 * F.col("pn") >= 9 * F.col("n")) & F.coalesce(near(VETO_DAYS), F.lit(True)) & (10 * lacks <= F.col("pn")))
    dated = shared.where("ms IS NOT NULL").withColumn("days", _bucket(VETO_DAYS))
    around = F.explode(F.array(*[_bucket(VETO_DAYS, i) for i in (-1, 0, 1)])).alias("days")
    similar = probe([around], F.floor(F.col("n") * 3 / 17) + 1).where("pms IS NOT NULL").join(dated, ["research_id", "token", "days"]).where(larger & near(VETO_DAYS) & (17 * lacks <= 3 * F.col("pn")))
    return same.select("research_id", "ps", "seq").unionByName(similar.select("research_id", "ps", "seq"))


def figure_candidates(rows: DataFrame) -> DataFrame:
    """(research_id, ps, seq): pairs within three days that share an amount and a subject. Each row stands in two of the stretches of six days that begin every three."""
    money = rows.where("ms IS NOT NULL").select("research_id", "seq", "ms", "all_tokens", F.explode(F.filter("all_tokens", is_money)).alias("money"))
    keyed = money.select("research_id", "seq", "ms", "money", F.explode(F.filter("all_tokens", is_subject)).alias("subject"))
    keyed = keyed.withColumn("days", F.explode(F.array(_bucket(FIGURE_DAYS), _bucket(FIGURE_DAYS, 1))))
    keys = ["research_id", "money", "subject", "days"]
    # what one source alone has leads nowhere
    keyed = keyed.join(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), keys, "left_semi")
    other = keyed.select(*keys, F.col("seq").alias("ps"), F.col("ms").alias("pms"))
    return keyed.join(other, keys).where((F.col("ps") < F.col("seq")) & (F.abs(F.col("ms") - F.col("pms")) <= FIGURE_DAYS * DAY_MS)).select("research_id", "ps", "seq")


def title_classes(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of the titles that have tokens. Rows of one research with the same tokens and time are a class, named by its first row.

    members: research_id, seq, cls. classes: research_id, seq, tokens, all_tokens, published_at, n, ms, a row a class.
    """
    rows = sources.where((F.size("all_tokens") > 0) & F.col("research_id").isNotNull()).select("research_id", "seq", "tokens", "all_tokens", "published_at")
    rows = rows.withColumns({"n": F.size("tokens"), "ms": F.unix_millis("published_at")})
    key = F.sha2(F.to_json(F.struct(F.array_sort("tokens").alias("t"), F.array_sort("all_tokens").alias("a"), "ms")), 256)
    rows = staged(rows.withColumn("key", key), "titles")
    first = rows.groupBy("research_id", "key").agg(F.min("seq").alias("cls"))
    members = staged(rows.select("research_id", "seq", "key").join(first, ["research_id", "key"]).drop("key"), "members")
    return members, staged(rows.drop("key").join(members.where("seq = cls").drop("cls"), ["research_id", "seq"]), "classes")


def class_pairs(classes: DataFrame) -> DataFrame:
    """(research_id, a, b, reason, similarity) of matching classes, a < b by their first rows; every pair once."""
    found = title_candidates(classes).unionByName(figure_candidates(classes))
    pairs = found.select("research_id", F.least("ps", "seq").alias("a"), F.greatest("ps", "seq").alias("b"))
    # dealt by pair first: a task's set of pairs is then its share of them, not what one common token makes
    pairs = pairs.repartition("research_id", "a", "b").distinct()
    side = lambda k: classes.select("research_id", F.col("seq").alias(k), F.struct("tokens", "all_tokens", "published_at").alias(f"r{k}"))
    judged = pairs.join(side("a"), ["research_id", "a"]).join(side("b"), ["research_id", "b"]).withColumn("m", match("ra", "rb"))
    return judged.where("m IS NOT NULL").select("research_id", "a", "b", "m.reason", "m.similarity")


def own_pairs(classes: DataFrame) -> DataFrame:
    """class_pairs' rows of classes whose rows match each other. A class without such a match matches nothing else either."""
    row = F.struct("tokens", "all_tokens", "published_at")
    same = classes.select("research_id", F.col("seq").alias("a"), F.col("seq").alias("b"), row.alias("ra"), row.alias("rb")).withColumn("m", match("ra", "rb"))
    return same.where("m IS NOT NULL").select("research_id", "a", "b", "m.reason", "m.similarity")


#: Rows of a class that stand in one list while pairs of classes become pairs of rows.
LIST = 1000


def story_pairs(sources: DataFrame) -> DataFrame:
    """(research_id, a, b, reason, similarity) with a < b by seq, from rows research_id, seq, tokens, all_tokens, published_at.

    Rows without tokens match nothing. Every matching pair is found once: classes of copies are compared, and their pairs spread over lists of their rows.
    """
    members, classes = title_classes(sources)
    place = F.row_number().over(Window.partitionBy("research_id", "cls").orderBy("seq"))
    lists = members.withColumn("part", F.floor((place - 1) / LIST)).groupBy("research_id", "cls", "part").agg(F.collect_list("seq").alias("seqs"))
    lists = staged(lists, "lists")
    side = lambda k: lists.select("research_id", F.col("cls").alias(k), F.col("seqs").alias(f"s{k}"))
    both = class_pairs(classes).unionByName(own_pairs(classes)).join(side("a"), ["research_id", "a"]).join(side("b"), ["research_id", "b"])
    rows = both.withColumn("x", F.explode("sa")).withColumn("y", F.explode("sb")).where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return rows.select("research_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "reason", "similarity")


def deciding_matches(members: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, followers): the matches that decide where a source goes, and the copies that go where the first of their class goes.

    Only the first row of a class can be a primary, as a later one has all matches of those before it; so matches by title lead to first rows. Primaries don't rise
    along a class; so of the matches by figure with a class, the latest earlier row holds the best (the first is kept, which settles most at once). Classes
    without an amount, a subject or a time match by title alone: their later rows go with the first.
    edges: research_id, s, m, reason, similarity. followers: research_id, seq, cls.
    """
    figured = F.exists("all_tokens", is_money) & F.exists("all_tokens", is_subject) & F.col("ms").isNotNull()
    kinds = classes.select("research_id", F.col("seq").alias("cls"), figured.alias("figured"), F.col("n"))
    named = staged(members.join(kinds, ["research_id", "cls"]), "kinds")
    acting = named.where("figured OR seq = cls").select("research_id", "cls", "seq")
    pairs = staged(class_pairs(classes).unionByName(own_pairs(classes.where(figured))), "class-pairs")
    title, figure = pairs.where("reason <> 'same_figure'"), pairs.where("reason = 'same_figure'")
    to = lambda x, y: title.select("research_id", F.col(x).alias("cls"), F.col(y).alias("m"), "reason", "similarity")
    # own pairs once
    by_title = to("b", "a").unionByName(to("a", "b").where("cls <> m")).join(acting, ["research_id", "cls"]).where("m < seq")
    by_title = by_title.select("research_id", F.col("seq").alias("s"), "m", "reason", "similarity")
    rows = lambda x, side: figure.select("research_id", "a", "b", F.col(x).alias("cls")).join(acting, ["research_id", "cls"]).select("research_id", "a", "b", "seq", F.lit(side).alias("side"))
    before = Window.partitionBy("research_id", "a", "b").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    other = lambda side: (F.col("a") == F.col("b")) | (F.col("side") != side)
    held = rows("a", 0).unionByName(rows("b", 1).where("a <> b"))
    one = lambda f, **k: F.when(other(0), f(F.when(other(1), F.col("seq")), **k).over(before)).otherwise(f(F.when(other(0), F.col("seq")), **k).over(before))
    held = held.select("research_id", F.col("seq").alias("s"), one(F.min).alias("first"), one(F.max).alias("latest"))
    by_figure = held.where("first IS NOT NULL").select("research_id", "s", F.explode(F.array_distinct(F.array("first", "latest"))).alias("m"), F.lit("same_figure").alias("reason"), F.lit(1.0).alias("similarity"))
    return by_title.unionByName(by_figure), named.where(f"NOT figured AND seq <> cls AND n >= {MIN_SHARED}").select("research_id", "seq", "cls")


CLUSTER = "research_id string, seq long, primary_seq long, reason string, similarity double"


def fold_stories(seqs: list[int], edges: dict[int, list[tuple[int, str, float]]]) -> list[tuple[int, int, str | None, float | None]]:
    """(seq, primary, reason, similarity) in order of seq; edges lists each source's earlier matches.

    A source joins the earliest story whose primary it matches, or one of whose duplicates it matches by figure; the match
    recorded is that with the primary if there is one, else that with the first such duplicate.
    """
    primary: dict[int, int] = {}
    out = []
    for s in seqs:
        best: tuple[int, bool, int, str, float] | None = None
        for m, reason, sim in sorted(edges.get(s, ())):
            if primary[m] == m or reason == "same_figure":
                key = (primary[m], primary[m] != m, m, reason, sim)
                if best is None or key[:3] < best[:3]:
                    best = key
        primary[s] = best[0] if best else s
        out.append((s, primary[s], best[3] if best else None, best[4] if best else None))
    return out


def fold_edges(edges: DataFrame) -> DataFrame:
    """CLUSTER rows of the sources that have an earlier match, a research in a group: its matches alone, FOLD_EDGES at most."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        own: dict[int, list] = {}
        for s, m, r, x in zip(pdf["s"], pdf["m"], pdf["reason"], pdf["similarity"], strict=True):
            own.setdefault(int(s), []).append((int(m), r, float(x)))
        later = set(own)
        out = fold_stories(sorted(later | {int(m) for m in pdf["m"]}), own)
        out = pd.DataFrame([r for r in out if r[0] in later], columns=["seq", "primary_seq", "reason", "similarity"])
        out.insert(0, "research_id", pdf["research_id"].iloc[0])
        return out

    return edges.groupBy("research_id").applyInPandas(lambda pdf: fold(pdf), CLUSTER)


def least_of_component(edges: DataFrame) -> DataFrame:
    """(research_id, m, least): the first source that a chain of matches leads to; labels move on until none changes."""
    one = lambda x, y: edges.select("research_id", F.col(x).alias("m"), F.col(y).alias("o"))
    both = staged(one("s", "m").unionByName(one("m", "s")), "neighbours")
    labels = staged(both.groupBy("research_id", "m").agg(F.least("m", F.min("o")).alias("least")), "labels")
    while True:
        other = labels.select("research_id", F.col("m").alias("o"), F.col("least").alias("far"))
        far = both.join(other, ["research_id", "o"]).groupBy("research_id", "m").agg(F.min("far").alias("far"))
        moved = labels.join(far, ["research_id", "m"]).select("research_id", "m", F.least("least", "far").alias("least"), (F.col("far") < F.col("least")).alias("changed"))
        moved = staged(moved, "labels")
        labels = moved.drop("changed")
        if moved.where("changed").isEmpty():
            return labels


def settle_in_rounds(edges: DataFrame) -> DataFrame:
    """fold_edges' rows by rounds of joins; no group holds more than the earlier matches of one source.

    A settled earlier match leads to its story if it is the story's primary or the match is by figure. A source is settled when no open match can lead
    to an earlier story than the best one so far: an open match by title leads to itself at best, one by figure to the first source of
    its component.
    """
    figure = F.col("reason") == "same_figure"
    bounds = edges.withColumn("far", F.col("m"))
    if not edges.where(figure).isEmpty():
        bounds = edges.join(least_of_component(edges), ["research_id", "m"]).withColumn("far", F.when(figure, F.col("least")).otherwise(F.col("m"))).drop("least")
    later = edges.select("research_id", F.col("s").alias("m")).distinct().withColumn("waits", F.lit(True))
    open_ = bounds.join(later, ["research_id", "m"], "left").withColumn("prim", F.when(F.col("waits").isNull(), F.col("m"))).drop("waits")
    done: list[DataFrame] = []
    while True:
        open_ = staged(open_, "open-matches")
        leads = F.when(F.col("prim").isNotNull() & ((F.col("prim") == F.col("m")) | figure), F.struct("prim", (F.col("prim") != F.col("m")).alias("via"), "m", "reason", "similarity"))
        state = open_.groupBy("research_id", "s").agg(F.min(leads).alias("b"), F.min(F.when(F.col("prim").isNull(), F.col("far"))).alias("hope"))
        ready = state.where(F.col("hope").isNull() | (F.col("hope") >= F.col("b.prim")))
        ready = staged(ready.select("research_id", F.col("s").alias("seq"), F.coalesce("b.prim", "s").alias("primary_seq"), "b.reason", "b.similarity"), "settled")
        if ready.isEmpty():
            break
        done.append(ready)
        open_ = open_.join(ready.select("research_id", F.col("seq").alias("s")), ["research_id", "s"], "left_anti")
        now = ready.select("research_id", F.col("seq").alias("m"), F.col("primary_seq").alias("p"))
        open_ = open_.join(now, ["research_id", "m"], "left").withColumn("prim", F.coalesce("prim", "p")).drop("p")
    return reduce(DataFrame.unionByName, done).select(*[c.split()[0] for c in CLUSTER.split(", ")]) if done else edges.sparkSession.createDataFrame([], CLUSTER)


def settle(edges: DataFrame) -> DataFrame:
    """CLUSTER rows of the sources that have an earlier match: researches of few matches folded, larger ones in rounds."""
    edges = staged(edges.select(F.col("research_id").cast("string").alias("research_id"), F.col("s").cast("long").alias("s"), F.col("m").cast("long").alias("m"), "reason", F.col("similarity").cast("double").alias("similarity")), "matches")
    many = staged(edges.groupBy("research_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > FOLD_EDGES).select("research_id"), "large")
    if many.isEmpty():
        return fold_edges(edges)
    # a null research has an id of its own in joins below
    held = F.col("research_id").eqNullSafe(F.col("large"))
    named = many.withColumnRenamed("research_id", "large")
    few, lots = edges.join(named, held, "left_anti"), edges.join(named, held, "left_semi")
    return fold_edges(few).unionByName(settle_in_rounds(lots))


def story_clusters(sources: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(research_id, seq, primary_seq, reason, similarity) for every source (research_id, seq; seq once a research).

    What is gathered by research are the matches that decide, where there are few; sources without an earlier match are primaries and take no part.
    """
    if pairs is not None:
        joined = settle(pairs.select("research_id", F.col("b").alias("s"), F.col("a").alias("m"), "reason", "similarity"))
    else:
        edges, followers = deciding_matches(*title_classes(sources))
        joined = staged(settle(edges), "settled-firsts")
        copies = followers.select(F.col("research_id").cast("string").alias("research_id"), F.col("seq").cast("long").alias("own"), F.col("cls").cast("long").alias("seq")).join(joined, ["research_id", "seq"], "left")
        copies = copies.select("research_id", F.col("own").alias("seq"), F.coalesce("primary_seq", "seq").alias("primary_seq"), F.coalesce("reason", F.lit("same_title")).alias("reason"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
        joined = joined.unionByName(copies)
    ids = sources.select(F.col("research_id").cast("string").alias("rid"), F.col("seq").cast("long").alias("own"))
    rows = ids.join(joined, (F.col("rid").eqNullSafe(F.col("research_id"))) & (F.col("own") == F.col("seq")), "left")
    return rows.select(F.col("rid").alias("research_id"), F.col("own").alias("seq"), F.coalesce("primary_seq", "own").alias("primary_seq"), "reason", "similarity")


def story_sizes(clusters: DataFrame) -> DataFrame:
    """(research_id, primary_seq, members, also_reported_by), in no order."""
    return clusters.groupBy("research_id", "primary_seq").agg(F.count(F.lit(1)).alias("members"), (F.count(F.lit(1)) - 1).alias("also_reported_by"))
