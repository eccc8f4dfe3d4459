"""Secret scans with multipart credential linking.

Three base patterns find what is a secret by itself. Weak parts - access identifiers, bare high-entropy strings,
endpoints - prove nothing alone: inside a scope (a paragraph) they are joined by role, secrets with identifiers and endpoints whose
intervals lie within reach of each other, and a weak part is reported only where the join finds it a partner.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The matches of [0-9a-f]+ are maximal runs, so those long enough can be sought alone.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: No part has a greatest length: a run is taken whole and ends its pattern, so long ones take linear time.
WEAK = {
    "identifier": re.compile(r"""(?:access[_ -]?(?:key[_ -]?)?id|client[_ -]?id|user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.I | re.A),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"),
    "endpoint": re.compile(r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{3,}|(?<![A-Za-z0-9.-])(?:[a-z0-9-]+\.){2,}[a-z]{2,}:[0-9]{2,5}", re.A),
}
SCOPE = re.compile(r"\n[\x20\t\r]*\n")


def entropy(s: str) -> float:
    """Bits per character."""
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out = []
    low = text.lower() if any(c in text for c in "=:") else ""
    if low and ("pass" in low or "secret" in low or "token" in low or "api" in low):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, BASE[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def weak_parts(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak candidates outside the base spans, by start. Bare strings need three kinds of characters and 3.5 bits each."""
    starts, furthest = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))

    def free(s: int, e: int) -> bool:
        """Whether no base span that starts before e ends behind s."""
        k = bisect_left(starts, e)
        return k == 0 or furthest[k - 1] <= s

    out = []
    for kind, pattern in WEAK.items():
        if kind == "endpoint" and ":" not in text or kind == "identifier" and not (":" in text or "=" in text):
            continue
        for m in pattern.finditer(text):
            s, e = m.span(1) if kind == "identifier" else m.span()
            if kind == "secret":
                v = m[0]
                if not (re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v) and entropy(v) >= 3.5):
                    continue
            if free(s, e):
                out.append((s, e, kind))
    return sorted(out)


ROLE = {"assign": "secret", "access": "identifier", "hex": "secret"}


def link(text: str, base: list[tuple[int, int, str]], reach: int = 200) -> list[tuple[int, int, str]]:
    """The weak parts that have a complementary part in their scope within reach: secrets need an identifier or endpoint, these need a secret.

    Distances are from the end of the one to the start of the other; parts that overlap are one string and don't support each other.
    The other role's nearest end before a part and nearest start behind it decide, so the join is two look-ups a part.
    """
    weak = weak_parts(text, base)
    if not weak:
        return []
    cuts = [m.start() for m in SCOPE.finditer(text)]
    ends: dict[tuple[int, bool], list[int]] = {}
    starts: dict[tuple[int, bool], list[int]] = {}
    for s, e, role in [(s, e, ROLE[k]) for s, e, k in base] + weak:
        key = bisect_left(cuts, s), role == "secret"
        starts.setdefault(key, []).append(s)
        ends.setdefault(key, []).append(e)
    for lists in (starts, ends):
        for x in lists.values():
            x.sort()
    out = []
    for s, e, kind in weak:
        other = bisect_left(cuts, s), kind != "secret"
        before, behind = ends.get(other, []), starts.get(other, [])
        k, j = bisect_right(before, s), bisect_left(behind, e)
        if k and s - before[k - 1] <= reach or j < len(behind) and behind[j] - e <= reach:
            out.append((s, e, f"linked_{kind}"))
    return out


SPAN = "array<struct<kind:string,s:int,e:int>>"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """One row per row of docs: id, base and spans, arrays of struct<kind, s, e> in code points, end exclusive.

    base: by start, then kind as listed. spans: these and the linked weak parts (kinds linked_identifier, linked_secret,
    linked_endpoint), by start, base first. Null texts count as empty; repeated rows are answered each; an empty table gives
    no rows; other columns are not read. Work is linear in the text but for the sorting of its parts.
    """
    spans_type = T._parse_datatype_string(f"base {SPAN}, spans {SPAN}")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *spans_type.fields])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))
    order = lambda x: (x[0], x[2] not in BASE, BASE.index(x[2]) if x[2] in BASE else 0, x[1])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda x: {"kind": x[2], "s": x[0], "e": x[1]}
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                own = base_spans(text)
                base.append([row(x) for x in own])
                spans.append([row(x) for x in sorted(own + link(text, own, reach), key=order)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, arrow), pa.array(spans, arrow)], [id_col, "base", "spans"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t")).mapInArrow(scan, schema)
