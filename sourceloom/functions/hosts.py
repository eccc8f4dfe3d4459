"""Hosts of other scripts in ASCII, by the bootstring rule (RFC 3492), as Column expressions inside the JVM.

Numbers are longs throughout. A label's characters beyond ASCII are inserted from the smallest code point on; each insertion is a number of
variable length whose digits depend on a bias that adapts to the insertions before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rule's parameters for host names.
BASE, TMIN, TMAX, SKEW, DAMP, FIRST_BIAS, FIRST_POINT = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Steps that suffice for a label of 63 characters: its largest number is below 2^27.
MOST_DIGITS, MOST_HALVINGS = 8, 6
DOTS = "[.\\x{3002}\\x{FF0E}\\x{FF61}]"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs that aren't negative, exact below 2^53."""
    return F.floor(a / b).cast("long")


def _steps(n: int) -> Column:
    return F.sequence(_long(1), _long(n))


def _adapt(delta: Column, points: Column, first: Column) -> Column:
    start = F.when(first, _div(delta, _long(DAMP))).otherwise(_div(delta, _long(2)))
    zero = lambda d: F.struct((d + _div(d, points)).alias("d"), _long(0).alias("k"))
    wide = _long((BASE - TMIN) * TMAX // 2)

    def step(a: Column, _: Column) -> Column:
        big = a["d"] > wide
        return F.struct(F.when(big, _div(a["d"], _long(BASE - TMIN))).otherwise(a["d"]).alias("d"), (a["k"] + F.when(big, _long(BASE)).otherwise(_long(0))).alias("k"))

    ended = lambda a: a["k"] + _div(_long(BASE - TMIN + 1) * a["d"], a["d"] + _long(SKEW))
    return _let(start, lambda d: F.aggregate(_steps(MOST_HALVINGS), zero(d), step, ended))


def _digit(d: Column) -> Column:
    return F.substr(F.lit(DIGITS), (d + _long(1)).cast("int"), F.lit(1))


def _number(delta: Column, bias: Column) -> Column:
    """delta in digits."""
    zero = F.struct(delta.alias("q"), F.lit("").alias("s"), F.lit(False).alias("done"))

    def step(a: Column, i: Column) -> Column:
        least = F.least(_long(TMAX), F.greatest(_long(TMIN), i * _long(BASE) - bias))
        last = a["q"] < least
        more = F.struct(_div(a["q"] - least, _long(BASE) - least).alias("q"), F.concat(a["s"], _digit(least + (a["q"] - least) % (_long(BASE) - least))).alias("s"), F.lit(False).alias("done"))
        return F.when(a["done"], a).when(last, F.struct(a["q"].alias("q"), F.concat(a["s"], _digit(a["q"])).alias("s"), F.lit(True).alias("done"))).otherwise(more)

    return F.aggregate(_steps(MOST_DIGITS), zero, step, lambda a: a["s"])


def _label(label: Column) -> Column:
    points = F.transform(F.sequence(F.lit(1), F.length(label)), lambda i: F.ascii(F.substr(label, i, F.lit(1))).cast("long"))
    plain = F.regexp_replace(label, "[^\\x00-\\x7F]", "")
    state = lambda n, delta, bias, h, s: F.struct(n.alias("n"), delta.alias("delta"), bias.alias("bias"), h.alias("h"), s.alias("s"))

    def encode(p: Column) -> Column:
        b = F.length(plain).cast("long")
        zero = state(_long(FIRST_POINT), _long(0), _long(FIRST_BIAS), b, F.concat(plain, F.when(b > 0, "-").otherwise("")))

        def insert(a: Column, m: Column) -> Column:
            begun = state(m, a["delta"] + (m - a["n"]) * (a["h"] + 1), a["bias"], a["h"], a["s"])

            def pass_by(x: Column, c: Column) -> Column:
                hit = state(x["n"], _long(0), _adapt(x["delta"], x["h"] + 1, x["h"] == b), x["h"] + 1, F.concat(x["s"], _number(x["delta"], x["bias"])))
                return F.when(c == m, hit).when(c < m, state(x["n"], x["delta"] + 1, x["bias"], x["h"], x["s"])).otherwise(x)

            return F.aggregate(p, begun, pass_by, lambda x: state(m + 1, x["delta"] + 1, x["bias"], x["h"], x["s"]))

        rare = F.array_sort(F.array_distinct(F.filter(p, lambda c: c >= FIRST_POINT)))
        return F.aggregate(rare, zero, insert, lambda a: F.concat(F.lit("xn--"), a["s"]))

    return F.when(label.rlike("[^\\x00-\\x7F]"), _let(points, encode)).otherwise(label)


def ascii_host(host: Column) -> Column:
    """A lower-case host with each label of other characters in its ASCII form. Characters are taken as they are, in composed form."""
    labels = F.split(host, DOTS)
    return F.when(host.rlike("[^\\x00-\\x7F]"), F.array_join(F.transform(labels, _label), ".")).otherwise(host)
