"""URL rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .hosts import ascii_host
from .text import squash_ascii

_SPLIT = r"^(?i)(https?):[/\\]{2,}([^/?#\\]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.regexp_replace(F.trim(url), r"[\t\n\r]", ""), _SPLIT, group)


def host(url: Column) -> Column:
    """Lower-case host without credentials and port; null if the URL isn't an absolute http(s) one or the host is malformed."""
    h = F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), "^.*@", ""), r":\d*$", ""))
    return F.when(h.rlike(r"^[^\s<>^|%:@\[\]]+$|^\[[0-9a-f:.]+\]$"), h)


def display_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def is_tracking(name: Column) -> Column:
    return F.lower(name).startswith("utm_") | F.lower(name).isin(L.TRACKING_PARAMS)


def _decode(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _path(raw: Column) -> Column:
    """Dot segments resolved, what a URL may not hold percent-encoded."""
    steps = F.split(F.regexp_replace(F.regexp_replace(raw, r"\\", "/"), "^/", ""), "/", -1)
    dot = lambda s: F.lower(s).isin(".", "%2e")
    dots = lambda s: F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e")
    zero = F.array().cast("array<string>")
    tail = F.element_at(steps, -1)

    def walk(a: Column, s: Column) -> Column:
        return F.when(dots(s), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(dot(s), a).otherwise(F.concat(a, F.array(s)))

    walked = F.aggregate(steps, zero, walk)
    walked = F.when(dot(tail) | dots(tail), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    plain = F.when(raw.rlike(r"(?i)[/\\](\.|%2e)"), F.array_join(walked, "/")).otherwise(F.array_join(steps, "/"))
    path = F.concat(F.lit("/"), plain)
    safe = F.array_join(F.transform(F.split(path, ""), lambda c: F.when(c.rlike(r"[^\x21\x23-\x3B\x3D\x3F-\x5F\x61-\x7A\x7C\x7E]"), F.regexp_replace(F.url_encode(c), r"\+", "%20")).otherwise(c)), "")
    return F.when(path.rlike(r"[^\x21\x23-\x3B\x3D\x3F-\x5F\x61-\x7A\x7C\x7E]"), safe).otherwise(path)


def canonical_url(url: Column) -> Column:
    """The form that equal documents share; null for anything but an absolute http(s) URL.

    https; host lower, in ASCII, without www. and a trailing dot; no credentials, fragment, port 80 or 443, tracking parameters or trailing
    slashes; parameters by name and value in dictionary order. The case of the path stays.
    """
    authority = F.regexp_replace(_part(url, 2), "^.*@", "")
    port = F.regexp_extract(authority, r":0*(\d*)$", 1)
    name = ascii_host(F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r"\.$", ""))
    path = _path(_part(url, 3))
    path = F.when(F.length(path) > 1, F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/"))).otherwise(path)
    pairs = F.transform(F.filter(F.split(_part(url, 4), "&"), lambda x: x != ""), lambda x: F.struct(
        _decode(F.regexp_extract(x, "^([^=]*)", 1)).alias("n"), _decode(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v")))

    def before(a: Column, b: Column) -> Column:
        return F.when(a < b, -1).when(a > b, 1).otherwise(0)

    def order(a: Column, b: Column) -> Column:
        c = lambda x: F.collate(x, "UNICODE")
        names = before(c(a["n"]), c(b["n"]))
        return F.when(names != 0, names).otherwise(before(c(a["v"]), c(b["v"])))

    kept = F.filter(pairs, lambda p: ~is_tracking(p["n"]))
    kept = F.when(F.size(kept) > 1, F.array_sort(kept, order)).otherwise(kept)
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["n"]), F.lit("="), F.url_encode(p["v"]))), "&")
    good = host(url).isNotNull() & (F.length(port) <= 5) & (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535) & (name != "")
    port = F.when(port.isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    return F.when(good, F.concat(F.lit("https://"), name, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def url_path_words(url: Column) -> Column:
    """The decoded path with runs of - _ / as blanks; empty if it can't be decoded."""
    return F.regexp_replace(F.coalesce(F.try_url_decode(F.regexp_replace(_path(_part(url, 3)), r"\+", "%2B")), F.lit("")), "[-_/]+", " ")


def _site_host(host_or_url: Column) -> Column:
    return display_host(F.when(host_or_url.rlike(r"^(?i)[a-z]+://"), host_or_url).otherwise(F.concat(F.lit("https://"), host_or_url)))


def _domain_of(h: Column) -> Column:
    labels = F.split(h, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    three = two.isin(L.SECOND_LEVEL) & (F.size(labels) >= 3)
    return F.when(h.contains(".") & ~h.rlike(r"^\d+(\.\d+){3}$"), F.when(three, F.array_join(F.slice(labels, -3, 3), ".")).otherwise(two))


def registrable_domain(host_or_url: Column) -> Column:
    """The last two labels of a host, three under a known second level; null for hosts without a dot and IPv4."""
    return _domain_of(_site_host(host_or_url))


def registrable_domains(hosts_or_urls: Column) -> Column:
    """registrable_domain of each element. In two steps, as nothing is computed once for several uses inside a lambda."""
    return F.transform(F.transform(hosts_or_urls, _site_host), _domain_of)


def _without(name: Column, words: list[str]) -> Column:
    return F.regexp_replace(name, r"(?<![A-Za-z0-9_])(?:" + "|".join(words) + r")(?![A-Za-z0-9_])", " ")


def name_keys(name: Column, words: list[str] = L.NAME_SUFFIX_WORDS) -> Column:
    """The squashed name, as it is and without corporate words; empty ones left out."""
    plain = F.regexp_replace(F.lower(name), r"\.", "")
    return F.array_remove(F.array_distinct(F.array(squash_ascii(plain), squash_ascii(_without(plain, words)))), "")


def affix_names(name: Column) -> Column:
    """What a domain's label may say of a name: its keys of three characters or more."""
    return F.filter(name_keys(name, L.DOMAIN_SUFFIX_WORDS), lambda n: F.length(n) >= 3)


def domain_matches_name(domain: Column, name: Column) -> Column:
    """Whether the domain's first label is the name, with or without corporate words, but for one listed affix."""
    return label_matches_names(registrable_domain(domain), affix_names(name))


def label_matches_names(domain: Column, names: Column) -> Column:
    """domain_matches_name of a registrable domain and affix_names."""
    label = squash_ascii(F.split_part(domain, F.lit("."), F.lit(1)))
    front = lambda lab, n: lab.startswith(n) & F.substr(lab, F.length(n) + 1).isin(L.DOMAIN_AFFIXES)
    back = lambda lab, n: lab.endswith(n) & F.left(lab, F.length(lab) - F.length(n)).isin(L.DOMAIN_AFFIXES)
    same = lambda lab: (F.length(lab) >= 3) & F.exists(names, lambda n: (lab == n) | front(lab, n) | back(lab, n))
    return F.coalesce(F.exists(F.array(label), same), F.lit(False))  # an array of one binds the label, which is used often
