"""Personal data by weak supervision, in DataFrame operations alone.

Patterns propose spans. Three labelers - a strict shape, a gazetteer, words in the context - vote yes, no or nothing on
each. Votes are counted by pattern of votes - a table whose size depends on the number of labelers and kinds only - and
expectation-maximisation on these counts estimates each labeler's reliability and each pattern's posterior. A logistic span
classifier over kind, votes and what no labeler sees - length, shape, the characters beside the span, the place in its
line - is then trained on the posteriors and decides which proposed spans are reported. Spans of the base kinds are always
reported.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("tel", "id", "iban", "name")
# First names, titles and context words that the labelers know.
FIRST_NAMES = "Anna|Antonio|Carlos|Carmen|Charles|David|Elizabeth|Hans|James|Jean|Jennifer|John|José|Karl|Laura|Linda|Lucía|Luis|Marie|Maria|María|Mary|Michael|Patricia|Paul|Peter|Pierre|Robert|Sarah|Sophie|Susan|Thomas|William"
TITLES = "Dr|Frau|Herr|Mme|Mr|Mrs|Ms|Prof|Sra|Sr"
#: Starts are held to the start of a run or the end of the last match, and repeats are possessive: the leftmost
#: non-overlapping matches stay the same, and no text makes them back off over and over.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "tel": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "name": rf"(?=[A-Z])(?<!\p{{L}})(?:(?:{TITLES})\.?\x20|(?:{FIRST_NAMES})\x20)\p{{Lu}}\p{{Ll}}++(?:\x20\p{{Lu}}\p{{Ll}}++)?",
}
#: Cheap tests that a text must pass to hold a match at all.
NEEDS = {
    "email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"), "tel": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), "id": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), "name": lambda t: t.rlike(rf"(?=[A-Z])(?<!\p{{L}})(?:{TITLES}|{FIRST_NAMES})[.\x20]"),
}
STRICT = {
    "email": r"^[A-Za-z0-9][^@]*[A-Za-z0-9]@[^@]*\.[A-Za-z]{2,}$", "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{4}[\x20-]?){4}[0-9]{0,3}$", "phone": r"^\+[0-9]{1,3}[\x20.(-]", "tel": r"^(?:\([0-9]{3}\)\x20|[2-9][0-9]{2}[.-])",
    "id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", "iban": r"^[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4})+$|^[A-Z]{2}[0-9]{2}[A-Z0-9]+$",
    "name": rf"^(?:{TITLES})\b",
}
GAZETTEER = {
    "email": r"\.(?:com|de|edu|es|eu|fr|gov|io|net|org|uk)$", "ip": r"^(?!0|10\.|127\.|192\.168\.|255)", "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", "tel": r"^\(?(?:2|3|4|5|6|7|8|9)[0-8][0-9]",
    "id": r"^[0-8]", "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)", "name": rf"(?<!\p{{L}})(?:{FIRST_NAMES})\b",
}
CONTEXT = {
    "email": r"mail|contact|write|reach|correo|courriel", "ip": r"\bip\b|host|server|address|login|adresse|dirección",
    "card": r"card|visa|credit|debit|karte|carte|tarjeta", "phone": r"call|phone|tel|mobile|fax|llam|appel|ruf",
    "tel": r"call|phone|tel|mobile|fax|llam|appel|ruf", "id": r"ssn|social|security|tax|passport", "iban": r"iban|bank|account|konto|compte|cuenta",
    "name": r"name|sign|contact|dear|regards|author|by\b|nombre|nom\b",
}
#: Words in the context that speak for another number or name.
AGAINST = {
    "email": r"example|pattern|regex", "ip": r"version|release|build|section|chapter|kapitel", "card": r"isbn|serial|order|tracking|invoice", "phone": r"isbn|serial|order|version",
    "tel": r"isbn|serial|order|part|model|tracking", "id": r"isbn|part|model|order|invoice", "iban": r"serial|part|model|order|version", "name": r"street|avenue|school|saint|theorem|day\b",
}
CONTEXT_CHARS = 40
LABELERS = ("v_strict", "v_gaz", "v_ctx")
#: What the span classifier sees beside kind and votes; each has a few values, so patterns are counted.
FEATURES = ("len", "shape", "left", "right", "starts")
#: Matches that one step of the inner fold may copy.
BLOCK = 256


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(rows: Column, state: dict[str, Column], step, item: str, done) -> Column:
    """Go through an array with a running state and collect items: done(last state, items).

    step(state, element) gives the new state by name and an array of items (of type `item`) to add. Items are collected in blocks that are
    flattened once, so an array of many is not copied for each that joins it.
    """
    pack = lambda of, out: F.struct(*[of[n].alias(n) for n in state], out.alias("out"))

    def inner(a: Column, x: Column) -> Column:
        new, out = step(a, x)
        return pack(new, F.concat(a["out"], out))

    def outer(a: Column, part: Column) -> Column:
        return let(F.aggregate(part, pack(a, F.array().cast(f"array<{item}>")), inner), lambda r: pack(r, F.concat(a["out"], F.array(r["out"]))))

    last = lambda p: F.greatest(F.floor((F.size(p) - 1) / BLOCK), F.lit(0)).cast("int")
    blocks = let(rows, lambda p: F.transform(F.sequence(F.lit(0), last(p)), lambda b: F.slice(p, b * BLOCK + 1, F.lit(BLOCK))))
    return F.aggregate(blocks, pack(state, F.array().cast(f"array<array<{item}>>")), outer, lambda a: done(a, F.flatten(a["out"])))


def matches(text: Column) -> Column:
    """By kind as listed, an array<struct<s, e, m, before, after>> of the leftmost non-overlapping matches: code points, end exclusive, what was
    matched, at most CONTEXT_CHARS characters before it and the one behind it. One expression serves all kinds."""
    row = "struct<s:int,e:int,m:string,before:string,after:string>"

    def step(a: Column, z: Column) -> tuple[dict[str, Column], Column]:
        s = a["at"] + F.length(z["g"])
        e = s + F.length(z["m"])
        before = F.right(F.concat(a["tail"], z["g"]), F.lit(CONTEXT_CHARS))
        new = F.struct(s.alias("s"), e.alias("e"), z["m"].alias("m"), before.alias("before"), F.left(z["h"], F.lit(1)).alias("after"))
        return {"at": e, "tail": F.right(F.concat(before, z["m"]), F.lit(CONTEXT_CHARS))}, F.array(new)

    def positions(x: Column) -> Column:
        f, g = x["f"], x["g"]
        pairs = F.zip_with(F.slice(g, F.lit(1), F.size(f)), f, lambda x, m: F.struct(x.alias("g"), m.alias("m")))
        pairs = F.zip_with(pairs, F.slice(g, F.lit(2), F.size(f)), lambda x, h: F.struct(x["g"].alias("g"), x["m"].alias("m"), h.alias("h")))
        folded = fold(pairs, {"at": F.lit(0), "tail": F.lit("")}, step, row, lambda a, out: out)
        return F.when(F.size(f) > 0, folded).otherwise(F.array().cast(f"array<{row}>"))

    none = F.array().cast("array<string>")

    def found(kind: str) -> Column:
        able, pattern = NEEDS[kind](text), PATTERNS[kind]
        return F.struct(F.when(able, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias("f"), F.when(able, F.split(text, pattern, -1)).otherwise(none).alias("g"))

    return F.transform(F.array(*[found(k) for k in (*BASE, *ADDED)]), positions)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.reverse(digits)
    places = F.sequence(F.lit(1), F.length(digits))

    def add(a: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return a + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":  # every part, without leading zeros, has at most three digits and is at most 255
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).cast("int")), F.lit(999)) <= 255)
    if kind == "card":
        digits = F.regexp_replace(m, "[^0-9]", "")
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, F.lit(1)).otherwise(F.lit(0) if no is None else F.when(no, F.lit(-1)).otherwise(F.lit(0)))


def char_class(c: Column) -> Column:
    """A character's class: 0 none, 1 blank, 2 letter, 3 digit, 4 sign of a label or bracket, 5 other."""
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3).when(c.rlike(r"^[:=<>()\[\]\"']"), 4).otherwise(5)


def proposals(spans: Column, kind: str) -> Column:
    """The valid ones of a kind's matches with the labelers' votes and the classifier's features: array<struct<kind, s, e, votes..., features...>>."""
    spans = F.filter(spans, lambda x: valid(kind, x["m"])) if kind in BASE else spans

    def label(x: Column) -> Column:
        before = F.lower(x["before"])
        digits = F.length(F.regexp_replace(x["m"], "[^0-9]", "")) * 2 >= F.length(x["m"])
        signs = F.length(F.regexp_replace(x["m"], r"[\p{L}0-9]", ""))
        return F.struct(
            F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"),
            vote(x["m"].rlike(STRICT[kind]), F.lit(True)).alias("v_strict"), vote(x["m"].rlike(GAZETTEER[kind]), F.lit(True)).alias("v_gaz"),
            vote(before.rlike(CONTEXT[kind]), before.rlike(AGAINST[kind])).alias("v_ctx"), F.least((x["e"] - x["s"]) / 8, F.lit(3)).cast("int").alias("len"),
            (digits.cast("int") * 3 + F.least(signs, F.lit(2))).alias("shape"), char_class(F.right(x["before"], F.lit(1))).alias("left"), char_class(x["after"]).alias("right"),
            x["before"].rlike(r"(^|\n)\s*$").cast("int").alias("starts"))

    return F.transform(spans, label)


def fit_reliabilities(counts: dict[tuple, int], rounds: int = 60) -> tuple[dict[tuple, float], dict[tuple, float]]:
    """EM over counts of (kind, v1, v2, ...): (posterior that the span is personal data by pattern, accuracy by (labeler, vote)).

    A labeler has, for either truth, a distribution over its votes no / none / yes, shared by all kinds; each kind has its
    own prior. The start is the share of yes votes, so which class is which can't flip.
    """
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    votes = np.array([[v + 1 for v in k[1:]] for k in keys], int).reshape(len(keys), len(keys[0]) - 1 if keys else 0)
    kinds = sorted({k[0] for k in keys})
    of = np.array([kinds.index(k[0]) for k in keys], int)
    post = (1 + (votes == 2).sum(1)) / (2 + (votes != 1).sum(1)) if len(keys) else np.zeros(0)
    table = np.full((2, votes.shape[1] if len(keys) else len(LABELERS), 3), 1 / 3)
    for _ in range(rounds if len(keys) else 0):
        for truth, w in ((1, post * n), (0, (1 - post) * n)):
            for j in range(votes.shape[1]):
                c = np.bincount(votes[:, j], w, 3) + np.array([1, 1, 1 + truth])
                table[truth, j] = c / c.sum()
        prior = np.array([((post * n)[of == k].sum() + 2) / (n[of == k].sum() + 3) for k in range(len(kinds))])
        like = [np.log(np.where(truth, prior, 1 - prior))[of] + sum(np.log(table[truth, j][votes[:, j]]) for j in range(votes.shape[1])) for truth in (0, 1)]
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
    return dict(zip(keys, post.tolist(), strict=True)), {(j, v - 1): float(table[1, j, v]) for j in range(table.shape[1]) for v in range(3)}


def fit_classifier(patterns: dict[tuple, float], counts: dict[tuple, int], steps: int = 400) -> dict[tuple, float]:
    """Logistic regression on soft labels: weight by (feature name, value), ("bias",) included.

    patterns: (kind, votes..., features...) to the posterior of its votes; counts: how many spans have it.
    """
    names = ("kind", *LABELERS, *FEATURES)
    keys = sorted(patterns)
    features = sorted({(names[i], k[i]) for k in keys for i in range(len(names))}, key=str)
    place = {f: i for i, f in enumerate(features)}
    x = np.zeros((len(keys), len(features) + 1))
    x[:, -1] = 1
    for r, k in enumerate(keys):
        for i, name in enumerate(names):
            x[r, place[name, k[i]]] = 1
    y, n = np.array([patterns[k] for k in keys]), np.log1p(np.array([counts[k] for k in keys], float))
    w = np.zeros(x.shape[1])
    for _ in range(steps if len(keys) else 0):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 0.5 * (x.T @ (n * (p - y)) / n.sum() + 1e-3 * w)
    return {**{f: float(w[i]) for f, i in place.items()}, ("bias",): float(w[-1])}


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: id, `keep` columns, base and spans, arrays of struct<kind, s, e> (code points, end exclusive).

    base holds the spans of the base kinds by kind as listed, then start. spans holds these and, by kind as listed, what the
    classifier accepts of the other kinds unless it overlaps a base span. Null texts count as empty and have no spans;
    repeated rows are answered each; an empty table gives no rows. One pass reads the texts; models are fitted
    on counts over all documents.
    """
    found = docs.select(F.col(id_col), *keep, matches(text_of(text_col)).alias("__m"))
    of = {k: proposals(F.get("__m", F.lit(i)), k) for i, k in enumerate((*BASE, *ADDED))}
    found = found.select(id_col, *keep, F.concat(*[of[k] for k in BASE]).alias("base"), F.concat(*[of[k] for k in ADDED]).alias("added"))
    found = staged(found, "spans")
    names = ("kind", *LABELERS, *FEATURES)
    counted = found.select(F.explode(F.concat("base", "added")).alias("x")).groupBy(*[f"x.{c}" for c in names])
    rows = [tuple(r) for r in counted.count().collect()]  # patterns that occur; their number depends on kinds, votes and feature values alone
    full = {r[:-1]: r[-1] for r in rows}
    n_votes = 1 + len(LABELERS)
    by_votes: dict[tuple, int] = {}
    for key, c in full.items():
        by_votes[key[:n_votes]] = by_votes.get(key[:n_votes], 0) + c
    posterior, _ = fit_reliabilities(by_votes)
    weights = fit_classifier({k: posterior[k[:n_votes]] for k in full}, full)

    def accepted(x: Column) -> Column:
        score = F.lit(weights[("bias",)])
        for name in names:
            cases = [(f[1], w) for f, w in weights.items() if f[0] == name]
            if cases:
                part = F.lit(0.0)
                for value, w in cases:
                    part = F.when(x[name] == F.lit(value), F.lit(w)).otherwise(part)
                score = score + part
        return score > float(np.log(threshold / (1 - threshold)))

    slim = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    taken = slim(F.filter("added", accepted))
    return found.select(id_col, *keep, slim("base").alias("base"), F.concat(slim("base"), apart(taken, slim("base"))).alias("spans"))


def apart(spans: Column, others: Column) -> Column:
    """Those of spans (struct<kind, s, e>) that overlap none of others, in order.

    Both are sorted together; a span is free if no other one before it ends behind its start, and none behind it starts before its end.
    """
    def caught(rows: Column, start: int, reach, meets) -> Column:
        """Places in spans of what meets an other row before it in the order of rows."""

        def step(a: Column, x: Column) -> tuple[dict[str, Column], Column]:
            hit = (x["i"] >= 0) & meets(a["reach"], x)
            return {"reach": F.when(x["i"] < 0, reach(a["reach"], x)).otherwise(a["reach"])}, F.when(hit, F.array(x["i"])).otherwise(F.array().cast("array<int>"))

        return fold(rows, {"reach": F.lit(start)}, step, "int", lambda a, out: out)

    def filtered(own: Column, other: Column) -> Column:
        sides = (F.transform(other, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(-1).alias("i"))), F.transform(own, lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), i.alias("i"))))

        def free(rows: Column) -> Column:
            ahead = caught(rows, -1, lambda a, x: F.greatest(a, x["e"]), lambda a, x: a > x["s"])
            behind = caught(F.reverse(rows), 2**31 - 1, lambda a, x: F.least(a, x["s"]), lambda a, x: a < x["e"])
            return F.array_except(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), ahead), behind)

        return F.transform(let(F.array_sort(F.concat(*sides)), free), lambda i: F.get(own, i))

    both = F.struct(spans.alias("own"), others.alias("other"))
    return let(both, lambda x: F.when((F.size(x["own"]) > 0) & (F.size(x["other"]) > 0), filtered(x["own"], x["other"])).otherwise(x["own"]))


def span_list(spans: Column | str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


PAGE = 1024


def cut_out(pages: Column, a: Column, b: Column) -> Column:
    """Characters a to b of a text that is given as pages of PAGE characters: it takes time for what is cut, not for what lies before."""
    pa, pb = F.floor(a / PAGE).cast("int"), F.floor(b / PAGE).cast("int")
    whole = F.substring(F.get(pages, pa), F.pmod(a, F.lit(PAGE)) + 1, b - a)
    inner = F.array_join(F.slice(pages, pa + 2, F.greatest(pb - pa - 1, F.lit(0))), "")
    first, last = F.substring(F.get(pages, pa), F.pmod(a, F.lit(PAGE)) + 1, F.lit(PAGE)), F.substring(F.get(pages, pb), F.lit(1), F.pmod(b, F.lit(PAGE)))
    return F.coalesce(F.when(pa == pb, whole).otherwise(F.concat(first, inner, F.coalesce(last, F.lit("")))), F.lit(""))


def masked(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in angle brackets; overlapping spans are merged under the first one's kind."""
    order = F.array_sort(spans, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(b["e"] - a["e"]))
    length = F.length(text)

    def step(a: Column, x: Column) -> tuple[dict[str, Column], Column]:
        gap = F.struct(a["at"].alias("a"), x["s"].alias("b"), x["kind"].alias("kind"))
        new = F.when(x["s"] >= a["at"], F.array(gap)).otherwise(F.array().cast("array<struct<a:int,b:int,kind:string>>"))
        return {"at": F.greatest(a["at"], x["e"])}, new

    def joined(pages: Column) -> Column:
        done = lambda a, gaps: F.concat(
            F.array_join(F.transform(gaps, lambda g: F.concat(cut_out(pages, g["a"], g["b"]), F.lit("<"), F.upper(g["kind"]), F.lit(">"))), ""), cut_out(pages, a["at"], length))
        return fold(order, {"at": F.lit(0)}, step, "struct<a:int,b:int,kind:string>", done)

    pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(pages, joined)).otherwise(text)
