"""Text rules as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def _bare(c: str) -> str:
    """NFKD of a character without the marks U+0300-036F."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not "\u0300" <= x <= "\u036f")


#: Decompositions into one character, of all scripts but Hangul, and into several, of Latin letters, signs and ligatures.
_ONE = {chr(c): _bare(chr(c)) for c in (*range(0xA0, 0x3100), *range(0xF900, 0xFFF0)) if len(_bare(chr(c))) == 1 and _bare(chr(c)) != chr(c)}
_MANY = {chr(c): _bare(chr(c)) for c in (*range(0xA0, 0x250), *range(0x2000, 0x2190), *range(0xFB00, 0xFB07)) if len(_bare(chr(c))) > 1}
#: White space as a regex class: the JVM's own leaves out no-break space and the byte-order mark.
WS = r"[\s\x{00A0}\x{FEFF}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}]"


def strip_marks(c: Column) -> Column:
    """NFKD without the marks U+0300-036F, inside the JVM: Spark has no normalisation of its own. Hangul stays composed, see split_hangul."""
    single = F.regexp_replace(F.translate(c, "".join(_ONE), "".join(_ONE.values())), "[\\x{0300}-\\x{036F}]", "")
    keys, values = F.lit("".join(_MANY)), F.split(F.lit("\n".join(_MANY.values())), "\n")
    one = lambda x: F.when(F.instr(keys, x) > 0, F.get(values, F.instr(keys, x) - 1)).otherwise(x)
    several = F.array_join(F.transform(F.split(single, ""), one), "")
    several = F.when(single.rlike("[" + "".join(_MANY) + "]"), several).otherwise(single)
    return F.when(c.rlike("[^\\x00-\\x7F]"), several).otherwise(c)


#: Parts of Hangul syllables by their numbers: 19 leading, 21 vowels, 28 trailing of which the first is none.
_JAMO = tuple([chr(first + i) if first + i != 0x11A7 else "" for i in range(n)] for first, n in ((0x1100, 19), (0x1161, 21), (0x11A7, 28)))


def split_hangul(c: Column) -> Column:
    """Hangul syllables as their two or three parts: a syllable's number is (leading * 21 + vowel) * 28 + trailing."""
    lead, vowel, trail = (F.array(*map(F.lit, part)) for part in _JAMO)
    place = lambda x: F.ascii(x) - 0xAC00
    whole = lambda a, b: F.floor(a / b).cast("int")
    parts = lambda x: F.concat(F.get(lead, whole(place(x), 588)), F.get(vowel, whole(place(x) % 588, 28)), F.get(trail, place(x) % 28))
    each = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(c, i, F.lit(1)))
    spread = F.array_join(F.transform(each, lambda x: F.when(x.rlike("[\\x{AC00}-\\x{D7A3}]"), parts(x)).otherwise(x)), "")
    return F.when(c.rlike("[\\x{AC00}-\\x{D7A3}]"), spread).otherwise(c)


def once(value: Column, rule: Callable[[Column], Column]) -> Column:
    """rule of a value that is worked out once however often the rule names it."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def squash(c: Column) -> Column:
    """Letters and digits only, without marks, lower case."""
    return F.regexp_replace(F.lower(strip_marks(c)), r"[^\p{L}\p{N}]+", "")


def squash_ascii(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip_marks(c)), "[^a-z0-9]+", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def decode_entities(c: Column) -> Column:
    """Decode numeric and the listed named character references in one pass; others stay as written."""
    token = r"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z]+);"
    names = F.create_map(*[F.lit(x) for kv in L.ENTITIES.items() for x in kv])

    def decode(t: Column) -> Column:
        hexa = F.conv(F.regexp_extract(t, r"^&#[xX](?:0*)([0-9a-fA-F]{1,8});$", 1), 16, 10)
        deci = F.regexp_extract(t, r"^&#0*([0-9]{1,9});$", 1)
        n = F.when(t.rlike("^&#[xX]"), hexa).when(t.rlike("^&#"), deci).try_cast("bigint")
        # UTF-32 bytes of the code point, decoded
        point = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        named = F.try_element_at(names, F.lower(F.regexp_extract(t, "^&([a-zA-Z]+);$", 1)))
        good = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(good, point).otherwise(F.coalesce(named, t))

    found = F.regexp_extract_all(c, F.lit(token), F.lit(0))
    gaps = F.split(c, token, -1)
    parts = F.zip_with(gaps, F.transform(found, decode), lambda g, d: F.concat(g, F.coalesce(d, F.lit(""))))
    return F.when(c.contains("&"), F.array_join(parts, "")).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Script and style blocks and tags become blanks, references are decoded, and a syndication footer goes."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[\s\S]*?</\1>", " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(collapse(once(bare, decode_entities)), r"\s*The post .{1,300}? appeared first on .{1,100}?\.?$", ""))


def title_tokens(title: Column, passes: int = 1) -> Column:
    """Distinct comparable tokens of a title in order: marks and case gone, amounts as 16m or 2b, plural s gone, stopwords out.

    passes: how often whole amounts are set apart; a second pass finds one that the first has laid bare, as the 8b of x8b5b.
    """
    t = F.lower(split_hangul(strip_marks(title)))
    for words, unit in (("million|mn|mln|m", "m"), ("billion|bn|b", "b")):
        t = F.regexp_replace(t, rf"(\d+)[.,](\d+)\s*(?:{words})(?![A-Za-z0-9_])", rf" $1.$2{unit} ")
        for _ in range(passes):
            t = F.regexp_replace(t, rf"(?<![\d][.,])(?<!\d)(\d+)\s*(?:{words})(?![A-Za-z0-9_])", rf" $1{unit} ")
    t = F.regexp_replace(t, r"(\d)[.,](?=\d{3}(?![A-Za-z0-9_]))", "$1")
    raw = F.transform(F.split(t, r"[^\p{L}\p{N}.]+"), lambda x: F.regexp_replace(x, r"^\.+|\.+$", ""))
    kept = F.filter(raw, lambda x: (x != "") & ~x.isin(L.TITLE_STOPWORDS))
    return F.array_distinct(F.transform(kept, stem_plural))


def stem_plural(x: Column) -> Column:
    return F.when((F.length(x) > 4) & x.endswith("s") & ~x.endswith("ss"), F.left(x, F.length(x) - 1)).otherwise(x)


def is_money(x: Column) -> Column:
    return x.rlike(r"^\d+(\.\d+)?[mb]$")


def search_keywords(c: Column, most: int = 3) -> Column:
    """The first `most` distinct topic words, joined by blanks; null if there are none."""
    raw = F.transform(F.split(F.lower(c), r"[^\p{L}\p{N}-]+"), lambda x: F.regexp_replace(x, "^-+|-+$", ""))
    terms = F.array_distinct(F.filter(raw, lambda x: (F.length(x) >= 3) & ~x.isin(L.KEYWORD_STOPWORDS)))
    return F.nullif(F.array_join(F.slice(terms, 1, most), " "), F.lit(""))


def round2(x: Column) -> Column:
    """Two decimals, halves up, as floor: round() of doubles differs between engines."""
    return F.floor(x * 100 + F.lit(0.5)) / F.lit(100.0)


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / F.lit(3.5)).cast("long")


def stable_key(*fields: tuple[str, Column]) -> Column:
    """SHA-256 of JSON with sorted keys and nulls left out: equal for equal content whatever the order of fields."""
    ordered = [c.alias(n) for n, c in sorted(fields, key=lambda f: f[0])]
    return F.sha2(F.to_json(F.struct(*ordered)), 256)
