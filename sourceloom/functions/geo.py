"""Places: phrases that stand for them, and whether a text mentions them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def norm_country(c: Column) -> Column:
    k = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "^the ", ""), r"\.", ""))
    aliases = F.create_map(*[F.lit(x) for kv in L.COUNTRY_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, k), k)


def norm_place(place: str) -> str:
    k = re.sub("^the ", "", place.lower()).replace(".", "").strip()
    return L.COUNTRY_ALIASES.get(k, k)


def country_phrases(country: str) -> list[str]:
    return [country, *L.DEMONYMS.get(country, []), *L.CITIES.get(country, []), *(k for k, v in L.COUNTRY_ALIASES.items() if v == country)]


def place_phrases(place: str) -> list[str]:
    """All phrases that indicate a country or region, in order, each once."""
    p = norm_place(place)
    if p in L.REGION_WORDS:
        return list(dict.fromkeys([*L.REGION_WORDS[p], *(x for c in L.REGION_COUNTRIES[p] for x in country_phrases(c))]))
    return list(dict.fromkeys(country_phrases(p)))


def phrase_patterns(phrases: list[str]) -> list[str]:
    """At most two regexes that find any of the phrases: short ones in capitals, others in any case, between non-letters."""
    short = [p for p in phrases if len(p.replace(".", "")) <= 3]
    long = [p for p in phrases if len(p.replace(".", "")) > 3]
    quote = lambda ps: "|".join(re.escape(p) for p in ps)
    out = []
    if short:
        out.append(f"(?:^|[^A-Za-z])(?:{quote([p.upper() for p in short])})(?:$|[^A-Za-z])")
    if long:
        out.append(f"(?iu)(?:^|[^\\p{{L}}])(?:{quote(long)})(?:$|[^\\p{{L}}])")
    return out


def mentions(text: Column, phrases: list[str]) -> Column:
    """Whether a text mentions any of the phrases."""
    found = F.lit(False)
    for pattern in phrase_patterns(phrases):
        found = found | text.rlike(pattern)
    return found


def py_mentions(text: str, phrase: str) -> bool:
    """mentions() for one short text on the driver: a question."""
    if len(phrase.replace(".", "")) <= 3:
        return bool(re.search(f"(^|[^A-Za-z]){re.escape(phrase.upper())}($|[^A-Za-z])", text))
    return bool(re.search(rf"(^|[^\W\d_]{{0}}(?<![^\W\d_])){re.escape(phrase)}(?![^\W\d_])", text, re.I))


def find_places(text: str) -> list[str]:
    """Countries and regions that a question names; overlapping names all count."""
    names = [*L.DEMONYMS, *L.COUNTRY_ALIASES, *L.REGION_WORDS]
    return list(dict.fromkeys(n if n in L.REGION_WORDS else norm_place(n) for n in names if py_mentions(text, n)))


def countries_mentioned(text: Column) -> Column:
    """Countries whose name, demonym, alias or city a text mentions, in fixed order."""
    found = [F.when(mentions(text, place_phrases(c)), F.lit(c)) for c in L.DEMONYMS]
    return F.array_compact(F.array(*found))


def display_place(p: str) -> str:
    return re.sub(r"\b[^\W\d_]", lambda m: m[0].upper(), p)
