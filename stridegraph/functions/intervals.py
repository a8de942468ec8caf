"""Column functions over stepped intervals struct<b,s,e> and products of them (arrays).

An interval holds b, b+s, ... up to e. The empty one is (1, 1, 0); one element has step 1; e is always an element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IVL = "struct<b:bigint,s:bigint,e:bigint>"
DIMS = f"array<{IVL}>"
#: The largest natural, which stands for no bound.
INF = 2**63 - 1


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once."""
    return F.get(F.transform(F.array(x), use), 0)


def whole(x: Column) -> Column:
    return x.cast("bigint")


def div(a: Column, b: Column) -> Column:
    """Floor of a / b for b > 0."""
    return let(F.struct(whole(a).alias("a"), whole(b).alias("b")), lambda v: F.call_function("div", v["a"] - F.pmod(v["a"], v["b"]), v["b"]))


def ceil_div(a: Column, b: Column) -> Column:
    return -div(-a, b)


def raw(b: Column, s: Column, e: Column) -> Column:
    return F.struct(whole(b).alias("b"), whole(s).alias("s"), whole(e).alias("e"))


def empty() -> Column:
    return raw(F.lit(1), F.lit(1), F.lit(0))


def interval(b: Column, s: Column, e: Column) -> Column:
    """Canonical interval; a step below 1 counts as 1."""
    made = lambda v: F.when(v["e"] < v["b"], empty()).otherwise(let(div(v["e"] - v["b"], v["s"]), lambda n: raw(v["b"], F.when(n == 0, F.lit(1)).otherwise(v["s"]), v["b"] + n * v["s"])))
    return let(raw(b, F.greatest(whole(s), F.lit(1)), e), made)


def is_empty(i: Column) -> Column:
    return i["e"] < i["b"]


def cardinal(i: Column) -> Column:
    return F.when(is_empty(i), F.lit(0).cast("bigint")).otherwise(div(i["e"] - i["b"], i["s"]) + 1)


def is_member(x: Column, i: Column) -> Column:
    return (x >= i["b"]) & (x <= i["e"]) & (F.pmod(x - i["b"], i["s"]) == 0)


def offset(i: Column, k: Column) -> Column:
    return F.when(is_empty(i), i).otherwise(raw(i["b"] + k, i["s"], i["e"] + k))


def least(i: Column, j: Column) -> Column:
    """The one that begins first; the first of two that begin alike."""
    return F.when(j["b"] < i["b"], j).otherwise(i)


def equal(i: Column, j: Column) -> Column:
    """Of canonical intervals: the same members."""
    return i == j


def less(i: Column, j: Column) -> Column:
    """Whether the one begins before the other; the empty one comes last."""
    return ~is_empty(i) & (is_empty(j) | (i["b"] < j["b"]))


def min_elem(i: Column) -> Column:
    return F.when(~is_empty(i), i["b"])


def max_elem(i: Column) -> Column:
    return F.when(~is_empty(i), i["e"])


def compacted(i: Column, j: Column) -> Column:
    """Their union, if that is one interval of the same step; else null."""
    s = F.when(i["b"] == i["e"], F.when(j["b"] == j["e"], F.abs(i["b"] - j["b"])).otherwise(j["s"])).otherwise(i["s"])
    fits = lambda x: (x["b"] == x["e"]) | (x["s"] == s)
    gap = F.greatest(i["b"], j["b"]) - F.least(i["e"], j["e"])
    joined = let(F.greatest(s, F.lit(1)), lambda t: F.when(fits(i) & fits(j) & (F.pmod(i["b"] - j["b"], t) == 0) & (gap <= t), interval(F.least(i["b"], j["b"]), t, F.greatest(i["e"], j["e"]))))
    return F.when(is_empty(i), j).when(is_empty(j), i).otherwise(joined)


def gcd(a: Column, b: Column) -> Column:
    """By Euclid; a fold over as many steps as the smaller number can need."""
    start = F.struct(F.abs(whole(a)).alias("x"), F.abs(whole(b)).alias("y"))
    step = lambda v, _: F.when(v["y"] == 0, v).otherwise(F.struct(v["y"].alias("x"), (v["x"] % F.greatest(v["y"], F.lit(1))).alias("y")))
    return let(start, lambda v: F.aggregate(_steps(F.least(v["x"], v["y"])), v, step)["x"])


def _steps(n: Column) -> Column:
    """As many entries as Euclid's method needs with n as its smaller number: 3/2 for each of its bits, and two."""
    return F.sequence(F.lit(1), F.floor(F.length(F.bin(n)) * 1.5).cast("int") + 2)


def lcm(a: Column, b: Column) -> Column:
    return F.call_function("div", a, gcd(a, b)) * b


def inverse_mod(a: Column, n: Column) -> Column:
    """The x in [0, n) with a * x = 1 modulo n, for coprime a and n."""
    start = F.struct(whole(n).alias("r"), whole(a).alias("q"), F.lit(0).cast("bigint").alias("t"), F.lit(1).cast("bigint").alias("u"))

    def step(v: Column, _: Column) -> Column:
        k = F.call_function("div", v["r"], F.greatest(v["q"], F.lit(1)))
        return F.when(v["q"] == 0, v).otherwise(F.struct(v["q"].alias("r"), (v["r"] - k * v["q"]).alias("q"), v["u"].alias("t"), (v["t"] - k * v["u"]).alias("u")))

    return let(start, lambda v: F.pmod(F.aggregate(_steps(v["q"]), v, step)["t"], n))


def intersection(i: Column, j: Column) -> Column:
    """Common members, by the Chinese remainder theorem; equal steps and step 1 need no Euclid."""
    return let(F.struct(i.alias("i"), j.alias("j")), lambda v: _intersection(v["i"], v["j"]))


def _intersection(i: Column, j: Column) -> Column:
    low, high = F.greatest(i["b"], j["b"]), F.least(i["e"], j["e"])

    def general(g: Column) -> Column:
        n = F.call_function("div", j["s"], g)
        k = F.pmod(F.pmod(F.call_function("div", j["b"] - i["b"], g), n) * inverse_mod(F.pmod(F.call_function("div", i["s"], g), n), n), n)
        return F.when(F.pmod(j["b"] - i["b"], g) != 0, empty()).otherwise(let(F.struct((i["b"] + i["s"] * k).alias("x"), (i["s"] * n).alias("l")), lambda v: interval(v["x"] + ceil_div(low - v["x"], v["l"]) * v["l"], v["l"], high)))

    aligned = lambda a: interval(a["b"] + ceil_div(low - a["b"], a["s"]) * a["s"], a["s"], high)
    return (
        F.when(is_empty(i) | is_empty(j) | (high < low), empty())
        .when((i["s"] == j["s"]) & (F.pmod(i["b"] - j["b"], i["s"]) == 0), aligned(i))
        .when(i["s"] == 1, aligned(j))
        .when(j["s"] == 1, aligned(i))
        .otherwise(let(gcd(i["s"], j["s"]), general))
    )


# products of intervals: arrays, one interval per dimension; empty if any is


def product(dims: Column) -> Column:
    return F.when(F.exists(dims, is_empty), F.array().cast(DIMS)).otherwise(dims)


def product_cardinal(dims: Column) -> Column:
    return F.when(F.size(dims) == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(dims, F.lit(1).cast("bigint"), lambda a, i: a * cardinal(i)))


def product_is_empty(dims: Column) -> Column:
    return F.size(dims) == 0


def product_min(dims: Column) -> Column:
    return F.transform(dims, lambda i: i["b"])


def product_max(dims: Column) -> Column:
    return F.transform(dims, lambda i: i["e"])


def product_intersection(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.array().cast(DIMS)).otherwise(let(F.zip_with(a, b, intersection), product))


def product_offset(dims: Column, by: Column) -> Column:
    return F.zip_with(dims, by, offset)


def product_least(a: Column, b: Column) -> Column:
    return F.when(product_min(b) < product_min(a), b).otherwise(a)


def product_equal(a: Column, b: Column) -> Column:
    return a == b


def product_less(a: Column, b: Column) -> Column:
    """By the least elements, dimension by dimension; the empty product comes last."""
    return (F.size(a) > 0) & ((F.size(b) == 0) | (product_min(a) < product_min(b)))


def product_is_member(x: Column, dims: Column) -> Column:
    return (F.size(dims) > 0) & F.forall(F.zip_with(x, dims, is_member), lambda v: v)


def is_one_dimensional(dims: Column) -> Column:
    return F.size(dims) <= 1


def arity(dims: Column) -> Column:
    return F.size(dims)


def product_compacted(a: Column, b: Column) -> Column:
    """Their union if they differ in one dimension and are one interval there; else null."""
    same = F.zip_with(a, b, lambda i, j: i == j)
    n = F.size(F.filter(same, lambda v: ~v))
    merged = F.zip_with(a, b, lambda i, j: F.when(i == j, i).otherwise(compacted(i, j)))
    return F.when(n == 0, a).when((n == 1) & ~F.exists(merged, lambda v: v.isNull()), merged)


def elements(i: Column) -> Column:
    """The members, as an array."""
    return F.when(is_empty(i), F.array().cast("array<bigint>")).otherwise(F.sequence(i["b"], i["e"], i["s"]))
