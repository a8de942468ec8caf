"""Column functions over rationals struct<num,den> and linear expressions struct<m,h>: x -> m * x + h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stridegraph.functions.intervals import empty, gcd, interval, is_empty, let, raw, whole

RAT = "struct<num:bigint,den:bigint>"
LEXP = f"struct<m:{RAT},h:{RAT}>"
EXP = f"array<{LEXP}>"


def ratio(num: Column | int, den: Column | int = 1) -> Column:
    """A reduced rational; null for a denominator of 0."""
    n, d = (whole(F.lit(x) if isinstance(x, int) else x) for x in (num, den))
    if isinstance(den, int) and den == 1:
        return F.struct(n.alias("num"), F.lit(1).cast("bigint").alias("den"))
    return let(F.struct(n.alias("n"), d.alias("d")), lambda v: _reduced(v["n"], v["d"]))


def _reduced(n: Column, d: Column) -> Column:
    sign = F.when(d < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    div = lambda a, g: F.call_function("div", a, g)
    return F.when(d != 0, F.when(d == 1, F.struct(n.alias("num"), d.alias("den"))).otherwise(let(F.greatest(gcd(n, d), F.lit(1)), lambda g: F.struct((sign * div(n, g)).alias("num"), (sign * div(d, g)).alias("den")))))


def radd(a: Column, b: Column) -> Column:
    return ratio(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def rsub(a: Column, b: Column) -> Column:
    return ratio(a["num"] * b["den"] - b["num"] * a["den"], a["den"] * b["den"])


def rmul(a: Column, b: Column) -> Column:
    return ratio(a["num"] * b["num"], a["den"] * b["den"])


def rdiv(a: Column, b: Column) -> Column:
    return ratio(a["num"] * b["den"], a["den"] * b["num"])


def rneg(a: Column) -> Column:
    return F.struct((-a["num"]).alias("num"), a["den"].alias("den"))


def rless(a: Column, b: Column) -> Column:
    return a["num"] * b["den"] < b["num"] * a["den"]


def requal(a: Column, b: Column) -> Column:
    return (a["num"] == b["num"]) & (a["den"] == b["den"])


def to_natural(a: Column) -> Column:
    """0 for what is no natural."""
    return F.when((a["den"] == 1) & (a["num"] >= 0), a["num"]).otherwise(F.lit(0).cast("bigint"))


def to_integer(a: Column) -> Column:
    return F.when(a["den"] == 1, a["num"]).otherwise(F.lit(0).cast("bigint"))


def power(a: Column, n: Column) -> Column:
    """Exact power of naturals."""
    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1).cast("bigint"))), F.lit(1).cast("bigint"), lambda x, k: F.when(k <= n, x * a).otherwise(x))


def lexp(m: Column, h: Column) -> Column:
    return F.struct(m.alias("m"), h.alias("h"))


def linear(m: Column | int, h: Column | int) -> Column:
    """With integer coefficients."""
    return lexp(ratio(m), ratio(h))


def identity() -> Column:
    return linear(1, 0)


def ladd(f: Column, g: Column) -> Column:
    return lexp(radd(f["m"], g["m"]), radd(f["h"], g["h"]))


def lsub(f: Column, g: Column) -> Column:
    return lexp(rsub(f["m"], g["m"]), rsub(f["h"], g["h"]))


def lequal(f: Column, g: Column) -> Column:
    return requal(f["m"], g["m"]) & requal(f["h"], g["h"])


def lcompose(f: Column, g: Column) -> Column:
    """f after g."""
    return lexp(rmul(f["m"], g["m"]), radd(rmul(f["m"], g["h"]), f["h"]))


def linverse(f: Column) -> Column:
    """The inverse; a constant has none, which a null slope says (any point may be meant)."""
    return F.when(f["m"]["num"] == 0, lexp(F.lit(None).cast(RAT), F.lit(None).cast(RAT))).otherwise(lexp(rdiv(ratio(1), f["m"]), rneg(rdiv(f["h"], f["m"]))))


def is_identity(f: Column) -> Column:
    return (f["m"]["num"] == 1) & (f["m"]["den"] == 1) & (f["h"]["num"] == 0)


def is_constant(f: Column) -> Column:
    return f["m"]["num"] == 0


def value(f: Column, x: Column) -> Column:
    """f(x) as a rational."""
    return radd(rmul(f["m"], ratio(x)), f["h"])


def at(f: Column, x: Column) -> Column:
    """f(x) where it is an integer, else null."""
    over = F.struct((f["m"]["num"] * x * f["h"]["den"] + f["h"]["num"] * f["m"]["den"]).alias("num"), (f["m"]["den"] * f["h"]["den"]).alias("den"))
    return let(over, lambda v: F.when(v["num"] % v["den"] == 0, F.call_function("div", v["num"], v["den"])))


def is_whole_on(f: Column, i: Column) -> Column:
    """Whether f maps all of an interval to integers."""
    return is_empty(i) | (at(f, i["b"]).isNotNull() & (at(f, F.least(i["b"] + i["s"], i["e"])).isNotNull()))


def image(f: Column, i: Column) -> Column:
    """The image of an interval; null if it is not of integers. A decreasing f swaps the ends."""
    return let(F.struct(f.alias("f"), i.alias("i")), lambda v: let(F.struct(at(v["f"], v["i"]["b"]).alias("lo"), at(v["f"], v["i"]["e"]).alias("hi")), lambda w: _image(v["f"], v["i"], w["lo"], w["hi"])))


def _image(f: Column, i: Column, lo: Column, hi: Column) -> Column:
    step = F.call_function("div", F.abs(f["m"]["num"]) * i["s"], f["m"]["den"])
    return F.when(is_empty(i), empty()).when(~is_whole_on(f, i), F.lit(None)).when(is_constant(f), raw(lo, F.lit(1), lo)).otherwise(interval(F.least(lo, hi), step, F.greatest(lo, hi)))


def product_image(exp: Column, dims: Column) -> Column:
    return F.zip_with(exp, dims, image)


def product_compose(f: Column, g: Column) -> Column:
    return F.zip_with(f, g, lcompose)


def rendered_ratio(r: Column) -> Column:
    return F.when(r["den"] == 1, r["num"].cast("string")).otherwise(F.concat_ws("/", r["num"].cast("string"), r["den"].cast("string")))


def rendered(f: Column) -> Column:
    """As text: 3x/4+5/4, x, -1x-3, 0."""
    n, d = f["m"]["num"], f["m"]["den"]
    slope = F.when(n == 0, F.lit("")).otherwise(F.concat(F.when((n == 1), F.lit("")).otherwise(n.cast("string")), F.lit("x"), F.when(d == 1, F.lit("")).otherwise(F.concat(F.lit("/"), d.cast("string")))))
    h = f["h"]["num"]
    return F.when(n == 0, rendered_ratio(f["h"])).when(h == 0, slope).otherwise(F.concat(slope, F.when(h > 0, F.lit("+")).otherwise(F.lit("")), rendered_ratio(f["h"])))
