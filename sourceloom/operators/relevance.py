"""How well sources answer a question, by rules, with reasons."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import lexicon as L
from ..functions.phrases import PhraseSet
from ..functions.text import round2
from ..functions.url import display_host, url_path_words

#: Fixed values of the score.
TITLE, SNIPPET, PATH, OUTLET = 1.0, 0.6, 0.4, 0.6
TOPIC_WEIGHT, PLACE_WEIGHT, BONUS, THRESHOLD, OFF_CAP = 0.65, 0.35, 0.1, 0.45, 0.2
PROMOTE_TO, PROMOTE_FROM, DIRECT_FROM, HARD_CAP = 15, 0.25, 0.7, 0.15
YEAR_MS = 365.25 * 24 * 60 * 60 * 1000
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# Phrases of job listings and of pages that aren't articles.
JOBS = rf"(?i){_B}(jobs? (in|at|for)|job openings|open roles|(now|we'?re|actively) hiring|hiring (in|now)|to work for|best places to work|careers at|vacanc(y|ies)|salar(y|ies) (in|at|for)){_E}|&\s*hiring{_E}"
NO_ARTICLE = rf"(?i)^(log ?in|sign ?in|sign ?up){_E}|{_B}(coupon|promo code)s?{_E}"
CONTEXT = "research_id string, topic array<string>, focus_topic array<string>, place_names array<string>, place_keys array<string>"
#: Sets of phrases that a worker keeps.
KEPT_SETS = 1000


def stem(w: str) -> str:
    return w[:-1] if len(w) > 4 and w.endswith("s") and not w.endswith("ss") else w


def topic_terms(text: str, place_words: set[str]) -> list[str]:
    """Topic words of a question in order, plural s dropped."""
    terms = (t.strip("-") for t in re.split(r"(?:[^\w-]|_)+", text.lower()))
    kept = [t for t in terms if t and t not in L.NON_TOPIC_WORDS and t not in place_words and (len(t) >= 3 or t in L.ACRONYMS)]
    return list(dict.fromkeys(map(stem, kept)))


def term_forms(term: str) -> list[str]:
    """Phrases of which one stands for the term: itself, its plural, its variants."""
    return [term, f"{term}s", *L.VARIANTS.get(term, [])]


def context_row(query: str, focus: str | None) -> dict:
    """Topic and place of a question: what scoring needs, as plain values."""
    places = geo.find_places(f"{query} {focus or ''}")
    phrases = list(dict.fromkeys(x for p in places for x in geo.place_phrases(p)))
    place_words = {w for p in [*places, *phrases, *(x for p in places for x in L.REGION_WORDS.get(p, []))] for w in p.split()}
    topic = topic_terms(query, place_words)
    focus_topic = [t for t in topic_terms(focus or "", place_words) if t not in topic]
    return {"topic": topic, "focus_topic": focus_topic, "place_names": places, "place_keys": [geo.norm_place(p) for p in places]}


def contexts(researches: DataFrame) -> DataFrame:
    """A context row per research from research_id, query, focus; one small row each, joined by research_id. The phrases follow from it."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"research_id": r.research_id, **context_row(r.query or "", r.focus)} for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CONTEXT.split(", ")])

    return researches.select(F.col("research_id").cast("string").alias("research_id"), "query", "focus").mapInPandas(build, CONTEXT)


def off_purpose(title: Column, url: Column) -> Column:
    """Why a page answers no question: 'job listing', 'not an article', or null."""
    t = F.coalesce(title, F.lit(""))
    return F.when(t.rlike(JOBS), "job listing").when(t.rlike(NO_ARTICLE), "not an article").when(display_host(url).isin(L.JOB_HOSTS), "job listing")


def _shown(terms: Column) -> Column:
    return F.array_join(F.transform(terms, lambda t: F.when(t.isin(L.ACRONYMS), F.upper(t)).otherwise(t)), ", ")


FOUND = "struct<topic:array<double>,focus:array<double>,place:double>"


def field_scores(title: Column, snippet: Column, path: Column) -> Column:
    """FOUND: the weight of the best field that mentions each topic term, each focus term, and any of the places.

    From the columns topic, focus_topic and place_names; fields are read in order of their weights, for what isn't found yet.
    """
    sets: dict[tuple, tuple[PhraseSet, int, int]] = {}

    def made(topic: tuple, focus: tuple, places: tuple) -> tuple[PhraseSet, int, int]:
        key = (topic, focus, places)
        if key not in sets:
            if len(sets) >= KEPT_SETS:
                sets.clear()
            groups = [term_forms(t) for t in (*topic, *focus)] + [[x for p in places for x in geo.place_phrases(p)]]
            sets[key] = (PhraseSet(groups), len(topic), len(focus))
        return sets[key]

    @F.arrow_udf(FOUND)
    def found(title: pa.Array, snippet: pa.Array, path: pa.Array, topic: pa.Array, focus: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for *texts, t, f, p in zip(*[c.to_pylist() for c in (title, snippet, path, topic, focus, places)], strict=True):
            phrases, n, m = made(tuple(t or ()), tuple(f or ()), tuple(p or ()))
            scores, left = [0.0] * (n + m + 1), phrases.every
            for text, weight in zip(texts, (TITLE, SNIPPET, PATH), strict=True):
                hit = phrases.mentioned(text, left)
                left &= ~hit
                while hit:
                    low = hit & -hit
                    scores[low.bit_length() - 1] = weight
                    hit ^= low
            out.append({"topic": scores[:n], "focus": scores[n : n + m], "place": scores[-1]})
        return pa.array(out, pa.struct([("topic", pa.list_(pa.float64())), ("focus", pa.list_(pa.float64())), ("place", pa.float64())]))

    return found(title, snippet, path, F.col("topic"), F.col("focus_topic"), F.col("place_names"))


#: Parts into which the sources of one research are dealt where they meet its one row.
PARTS = 64


def join_research(sources: DataFrame, researches: DataFrame, how: str = "inner") -> DataFrame:
    """sources with the columns of their research's one row, which is repeated for each of PARTS parts: no task holds all sources of a research."""
    dealt = sources.withColumn("__part", F.pmod(F.xxhash64("url"), F.lit(PARTS)))
    every = researches.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return dealt.join(every, ["research_id", "__part"], how).drop("__part")


def score_relevance(sources: DataFrame, context: DataFrame, now: Column) -> DataFrame:
    """sources (research_id, title, snippet, url, published_at, found_by_count) with score, relevant and reasons.

    context comes from contexts(); it is joined by research_id. Each field is read once, by an automaton of all phrases of its question.
    """
    rows = join_research(sources, context)
    rows = rows.withColumn("__found", field_scores(F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), url_path_words(F.col("url"))))
    rows = rows.withColumns({"__ts": F.col("__found.topic"), "__fs": F.col("__found.focus")})
    total = F.aggregate("__ts", F.lit(0.0), lambda a, x: a + x)
    topic = F.when(F.size("__ts") > 0, total / F.size("__ts")).otherwise(F.lit(1.0))
    focus = F.coalesce(F.array_max("__fs"), F.lit(0.0))
    homes = F.create_map(*[F.lit(x) for kv in L.OUTLET_PLACES.items() for x in kv])
    inside = F.create_map(*[y for r, cs in L.REGION_COUNTRIES.items() for y in (F.lit(r), F.array(*map(F.lit, cs)))])
    home = F.try_element_at(homes, display_host(F.col("url")))
    near = F.exists("place_keys", lambda q: (q == home) | F.coalesce(F.array_contains(F.try_element_at(inside, home), q), F.lit(False)))
    outlet = F.when(F.coalesce(near, F.lit(False)), OUTLET).otherwise(0.0)
    placed = F.size("place_names") > 0
    place = F.when(placed, F.greatest(F.col("__found.place"), outlet)).otherwise(F.lit(1.0))
    rows = rows.withColumns({"__topic": topic, "__place": place, "__off": off_purpose(F.col("title"), F.col("url"))})
    age = (F.unix_millis(now) - F.unix_millis("published_at")) / YEAR_MS
    old = F.when(age > 5, 0.3).when(age > 2, 0.15).otherwise(0.0)
    many = F.col("found_by_count") >= 2
    score = F.when(placed, TOPIC_WEIGHT * F.col("__topic") + PLACE_WEIGHT * F.col("__place")).otherwise(F.col("__topic"))
    score = score + BONUS * focus + F.when(many, BONUS).otherwise(0.0) - F.coalesce(old, F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    score = F.when(placed & (F.col("__place") == 0), F.least(score, F.lit(THRESHOLD - 0.05))).otherwise(score)
    score = F.when(F.col("__off").isNotNull(), F.least(score, F.lit(OFF_CAP))).otherwise(score)
    missing = F.filter(F.zip_with("topic", "__ts", lambda t, s: F.when(s == 0, t)), lambda t: t.isNotNull())
    names = F.array_join(F.transform("place_names", lambda p: F.initcap(p)), ", ")
    reasons = F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("does not mention "), _shown(missing))), F.when(placed & (F.col("__place") == 0), F.concat(F.lit("not about "), names)),
        F.when(many, F.format_string("found by %d searches", F.col("found_by_count"))), F.col("__off"),
        F.when(age > 2, F.format_string("published %d years ago", F.floor(age))),
    )
    rows = rows.withColumns({"score": round2(score), "relevant": score >= THRESHOLD, "reasons": F.array_compact(reasons)})
    return rows.drop("__found", "__ts", "__fs", "__topic", "__place", "__off", *[c.split()[0] for c in CONTEXT.split(", ")[1:]])


def judge_stories(members: DataFrame) -> DataFrame:
    """(research_id, primary_seq, score, relevant, promoted) from scored members (research_id, primary_seq, seq, score, relevant, reasons).

    A story is as good as its best member, the earliest of equals. Where fewer than PROMOTE_TO stories of a research are relevant,
    the best of the others from PROMOTE_FROM up, without a job listing among their members, fill up.
    """
    best = F.max_by(F.struct("score", "relevant"), F.struct("score", -F.col("seq")))
    stories = members.groupBy("research_id", "primary_seq").agg(best.alias("b"), F.max(F.array_contains("reasons", "job listing")).alias("jobs"))
    stories = stories.select("research_id", "primary_seq", "b.score", "b.relevant", "jobs")
    able = ~F.col("relevant") & (F.col("score") >= PROMOTE_FROM) & ~F.col("jobs")
    place = F.row_number().over(Window.partitionBy("research_id", able).orderBy(F.col("score").desc(), "primary_seq"))
    room = PROMOTE_TO - F.sum(F.col("relevant").cast("int")).over(Window.partitionBy("research_id"))
    stories = stories.withColumn("promoted", able & (place <= room))
    return stories.select("research_id", "primary_seq", "score", (F.col("relevant") | F.col("promoted")).alias("relevant"), "promoted")


def summarize_reasons(judged: DataFrame) -> DataFrame:
    """(research_id, reason, n) of set-aside stories from their primaries' rows (research_id, relevant, reasons), one reason each."""
    pick = lambda test: F.try_element_at(F.filter("reasons", test), F.lit(1))
    main = F.coalesce(
        pick(lambda r: r.isin("job listing", "not an article")), pick(lambda r: r.startswith("not about")), pick(lambda r: r.startswith("does not mention")),
        pick(lambda r: r.startswith("published")), F.lit("weak match"),
    )
    shown = F.when(main.startswith("published"), F.lit("too old")).otherwise(F.regexp_replace(main, "^does not mention", "not about"))
    return judged.where(~F.col("relevant")).groupBy("research_id", shown.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def reason_text(summary: DataFrame) -> DataFrame:
    """(research_id, text): counts and reasons, most frequent first."""
    word = F.when((F.col("n") > 1) & (F.col("reason") == "job listing"), "job listings").otherwise(F.col("reason"))
    rows = summary.select("research_id", F.struct((-F.col("n")).alias("k"), F.concat_ws(" ", "n", word).alias("t")).alias("x"))
    return rows.groupBy("research_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), ", ").alias("text"))


def fallback_label(score: Column, relevant: Column, reasons: Column) -> Column:
    """struct<label, score, reason> of the keyword score."""
    why = F.nullif(F.array_join(F.filter(reasons, lambda r: ~r.startswith("found by")), "; "), F.lit(""))
    row = lambda label, default: F.struct(label.alias("label"), score.alias("score"), F.coalesce(why, F.lit(default)).alias("reason"))
    good = F.when(score >= DIRECT_FROM, F.lit("direct")).otherwise(F.lit("contextual"))
    return F.when(relevant, row(good, "mentions the topic and place")).otherwise(row(F.lit("irrelevant"), "weak match for the question"))


def fallback_constraints(query: Column, focus: Column, topic: Column, place_names: Column) -> Column:
    """The question's constraints without a model: kind of organisation by its first listed word."""
    q = F.lower(F.concat_ws(" ", query, F.coalesce(focus, F.lit(""))))
    word = lambda p: q.rlike(f"{_B}(?:{p}){_E}")
    kind = (
        F.when(word("start-?ups?"), "startup").when(word("investors?|vcs?|venture capital|funds?"), "investor")
        .when(word("universit(?:y|ies)|research (?:institutes?|labs?)"), "research_institution").otherwise("any")
    )
    none = F.lit(None).cast("string")
    return F.struct(F.array_join(topic, " ").alias("topic"), place_names.alias("geography"), kind.alias("entity_type"), none.alias("industry"), none.alias("time_range"))


def hard_rule(stories: DataFrame) -> DataFrame:
    """stories (label, score, reason, title, url of the primary) in which no off-purpose page is of use, whatever its label."""
    off = off_purpose(F.col("title"), F.col("url"))
    hit = off.isNotNull() & (F.col("label") != "irrelevant")
    return stories.withColumn("__o", F.when(hit, off)).withColumns({
        "label": F.when(F.col("__o").isNotNull(), "irrelevant").otherwise(F.col("label")),
        "score": F.when(F.col("__o").isNotNull(), F.least("score", F.lit(HARD_CAP))).otherwise(F.col("score")),
        "reason": F.coalesce("__o", "reason"),
    }).drop("__o")
