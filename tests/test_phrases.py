"""One pass for all phrases, against a regex for each; scores by field."""

import random
import re

from pyspark.sql import functions as F

from sourceloom.functions import geo
from sourceloom.functions import lexicon as L
from sourceloom.functions.phrases import PhraseSet
from sourceloom.operators import relevance


def literal(text, phrase):
    if len(phrase.replace(".", "")) <= 3:
        return bool(re.search(rf"(^|[^A-Za-z]){re.escape(phrase.upper())}($|[^A-Za-z])", text))
    return any(m for m in re.finditer(re.escape(phrase.lower()), text.lower()) if not text.lower()[m.start() - 1 : m.start()].isalpha() and not text.lower()[m.end() : m.end() + 1].isalpha())


def test_automaton_against_regexes():
    rng = random.Random(6)
    phrases = ["us", "u.s.", "uk", "eu", "ai", "a.i.", "germany", "german", "são paulo", "zürich", "new york", "york", "cyber", "cyber-security", "ot", "κόσμος", "мир и", "日本語語", "robot", "robots"]
    bits = ["US", "us", "U.S.", "UK", "ukraine", "EU", "AI", "a.i.", "A.I.", "Germany", "GERMANY", "germanyx", "German", "São Paulo", "SÃO PAULO", "Zürich", "zürichs", "New York", "Yorkshire", "cyber", "Cyber-Security", "Κόσμος", "МИР И", "日本語語", "x日本語語", "robots", "Robot", " ", "-", ".", "é", "1", "\n", "ſ", "_"]
    hits = 0
    for _ in range(3000):
        groups = [rng.sample(phrases, rng.randint(0, 3)) for _ in range(rng.randint(1, 6))]
        text = "".join(rng.choice(bits) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 9)))
        found = PhraseSet(groups)
        want = sum(1 << i for i, g in enumerate(groups) if any(literal(text, p) for p in g))
        assert found.mentioned(text) == want, (text, groups)
        some = rng.randrange(1 << len(groups))
        assert found.mentioned(text, some) == want & some
        hits += want > 0
    assert hits > 500 and PhraseSet([]).mentioned("us") == 0 and PhraseSet([["germany"]]).mentioned(None) == 0
    assert PhraseSet([["istanbul"]]).mentioned("in İSTANBUL") and PhraseSet([["sars"]]).mentioned("ſarſ")  # folded character by character


def test_same_as_the_column_rule(spark):
    """The regexes that columns use and the automaton agree on all place phrases."""
    rng = random.Random(7)
    names = [*L.DEMONYMS][:25]
    texts = ["".join(rng.choice([p, p.upper(), p.title(), f"x{p}", f"{p}s "]) + rng.choice([" ", ", ", "-", ""]) for p in rng.choices([x for n in names for x in geo.place_phrases(n)], k=6)) for _ in range(60)]
    found = PhraseSet([geo.place_phrases(n) for n in names])
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[geo.mentions(F.col("t"), geo.place_phrases(n)).alias(f"c{i}") for i, n in enumerate(names)]).collect()
    for r in rows:
        assert found.mentioned(r.t) == sum(1 << i for i in range(len(names)) if r[f"c{i}"]), r.t


def test_fields_are_weighed(spark):
    asked = spark.createDataFrame([("r", "robotics startups in Germany", "sensors"), ("s", "AI companies", None), ("t", "the startups", "")], "research_id string, query string, focus string")
    rows = [
        ("r", "Humanoid maker", "from Munich", "https://a.com/sensor-news"), ("r", "ROBOTS", None, "https://a.com/germany"), ("r", None, "robotics and sensors", "https://tech.eu/x"), ("r", "Robot", "", "https://inc42.com/x"),
        ("s", "said", "A.I. tools", "https://a.com/x"), ("s", "An LLM", "", "https://a.com/x"), ("t", "any", "", "https://a.com/x"),
    ]
    d = spark.createDataFrame([(r, i, a, b, u) for i, (r, a, b, u) in enumerate(rows)], "research_id string, seq int, title string, snippet string, url string").withColumns({"published_at": F.lit(None).cast("timestamp"), "found_by_count": F.lit(1)})
    got = [r for r in relevance.score_relevance(d, relevance.contexts(asked), F.current_timestamp()).orderBy("seq").collect()]
    assert [r.score for r in got] == [0.9, 0.79, 0.66, 0.4, 0.6, 1.0, 1.0]
    assert got[0].reasons == [] and got[3].reasons == ["not about Germany"] and got[6].relevant
