"""Piecewise linear maps, by pieces and by elements.

By pieces: a DataFrame (map_id, dims, exp), each row sending the product dims through the linear
expressions exp, dimension by dimension. By elements: a DataFrame (x, y), with map_id where the order
of maps counts; in more than one dimension x and y are arrays. Pieces are met by a range join
(sets.overlapping).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stridegraph.functions import intervals as iv
from stridegraph.functions import linear as ln
from stridegraph.functions.intervals import let
from stridegraph.operators import sets
from stridegraph.sources.scratch import Scratch

# by pieces


def identity(s: DataFrame) -> DataFrame:
    return s.select(F.lit(0).alias("map_id"), "dims", F.transform("dims", lambda _: ln.identity()).alias("exp"))


def domain(f: DataFrame) -> DataFrame:
    return f.select("dims")


def piece_image(f: DataFrame) -> DataFrame:
    """Each piece with its image; fails where an expression leaves the integers."""
    img = ln.product_image(F.col("exp"), F.col("dims"))
    return f.withColumn("img", F.when(F.exists(img, lambda i: i.isNull()), F.raise_error(F.lit("an expression maps a piece outside the integers"))).otherwise(img))


def restrict(f: DataFrame, s: DataFrame) -> DataFrame:
    pairs = sets.overlapping(f, s.select(F.col("dims").alias("other")), "dims", "other")
    return pairs.withColumn("dims", iv.product_intersection(F.col("dims"), F.col("other"))).where("size(dims) > 0").drop("other")


def image(f: DataFrame, s: DataFrame | None = None) -> DataFrame:
    got = piece_image(f if s is None else restrict(f, s))
    return sets.disjoint(got.select(F.col("img").alias("dims")))


def _back(exp: Column, dims: Column, target: Column) -> Column:
    """Part of a piece that its expression sends into target, which is part of its image."""

    def one(v: Column) -> Column:
        f, i, t = v["f"], v["i"], v["t"]
        there = lambda y: ln.at(ln.linverse(f), y)
        step = F.call_function("div", t["s"] * f["m"]["den"], F.abs(f["m"]["num"]))
        return F.when(iv.is_empty(t), iv.empty()).when(ln.is_constant(f), i).otherwise(iv.interval(F.least(there(t["b"]), there(t["e"])), step, F.greatest(there(t["b"]), there(t["e"]))))

    return iv.product(F.transform(F.arrays_zip(exp.alias("f"), dims.alias("i"), target.alias("t")), one))


def pre_image(f: DataFrame, s: DataFrame | None = None) -> DataFrame:
    if s is None:
        return domain(f)
    pairs = sets.overlapping(piece_image(f), s.select(F.col("dims").alias("other")), "img", "other")
    pairs = pairs.withColumn("hit", iv.product_intersection(F.col("img"), F.col("other"))).where("size(hit) > 0")
    return pairs.select(_back(F.col("exp"), F.col("dims"), F.col("hit")).alias("dims")).where("size(dims) > 0")


def compose(f: DataFrame, g: DataFrame) -> DataFrame:
    """f after g."""
    inner = piece_image(g).select("map_id", F.col("dims").alias("gd"), F.col("exp").alias("ge"), "img")
    outer = f.select(F.col("map_id").alias("fm"), F.col("dims").alias("fd"), F.col("exp").alias("fe"))
    pairs = sets.overlapping(inner, outer, "img", "fd").withColumn("hit", iv.product_intersection(F.col("img"), F.col("fd"))).where("size(hit) > 0")
    return pairs.select("map_id", _back(F.col("ge"), F.col("gd"), F.col("hit")).alias("dims"), ln.product_compose(F.col("fe"), F.col("ge")).alias("exp")).where("size(dims) > 0")


def combine(f: DataFrame, g: DataFrame) -> DataFrame:
    """f, and g where f is not defined."""
    rest = restrict(g, sets.difference(domain(g), domain(f)))
    last = f.agg(F.coalesce(F.max("map_id"), F.lit(-1)) + 1).first()[0]
    return f.select("map_id", "dims", "exp").unionByName(rest.select((F.col("map_id") + last).alias("map_id"), "dims", "exp"))


def concatenation(f: DataFrame, g: DataFrame) -> DataFrame:
    return f.unionByName(g)


def filter_maps(f: DataFrame, keep: Column) -> DataFrame:
    return f.where(keep)


def add(f: DataFrame, g: DataFrame) -> DataFrame:
    """Sum on the common domain, as one expression a piece."""
    other = g.select(F.col("dims").alias("od"), F.col("exp").alias("oe"))
    pairs = sets.overlapping(f, other, "dims", "od").withColumn("dims", iv.product_intersection(F.col("dims"), F.col("od"))).where("size(dims) > 0")
    return pairs.select("map_id", "dims", F.zip_with("exp", "oe", ln.ladd).alias("exp"))


def offset_domain(f: DataFrame, by: list[int]) -> DataFrame:
    """Moves the domain; what was at x is at x + by."""
    k = F.array(*[F.lit(v).cast("bigint") for v in by])
    moved = F.zip_with("exp", k, lambda e, v: ln.lcompose(e, ln.linear(1, -v)))
    return f.select("map_id", iv.product_offset(F.col("dims"), k).alias("dims"), moved.alias("exp"))


def offset_image(f: DataFrame, by: list[int]) -> DataFrame:
    k = F.array(*[F.lit(v).cast("bigint") for v in by])
    return f.withColumn("exp", F.zip_with("exp", k, lambda e, v: ln.lcompose(ln.linear(1, v), e)))


def inverse(f: DataFrame) -> DataFrame:
    """Of a bijective map; a constant piece has as image of its value the least of its domain."""
    got = piece_image(f)
    back = F.transform(F.arrays_zip(F.col("exp").alias("f"), F.col("dims").alias("i")), lambda v: F.when(ln.is_constant(v["f"]), ln.lexp(ln.ratio(0), ln.ratio(v["i"]["b"]))).otherwise(ln.linverse(v["f"])))
    return got.select("map_id", F.col("img").alias("dims"), back.alias("exp"))


def compact(f: DataFrame, stretch: int = sets.STRETCH) -> DataFrame:
    """One-dimensional pieces of equal expression, step and residue that follow each other become one, within stretches of the line."""
    i = F.col("dims")[0]
    low, high, n = f.agg(F.min(i["b"]), F.max(i["e"]), F.count(F.lit(1))).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // max(1, n // stretch)))
    key = ["exp", "s", "r", "part"]
    w = W.partitionBy(*key).orderBy("b")
    d = f.select("exp", "map_id", i["s"].alias("s"), F.pmod(i["b"], i["s"]).alias("r"), iv.div(i["b"] - (low or 0), F.lit(width)).alias("part"), i["b"].alias("b"), i["e"].alias("e"))
    d = d.withColumn("run", F.sum(F.when(F.col("b") - F.lag("e").over(w) <= F.col("s"), F.lit(0)).otherwise(F.lit(1))).over(w))
    d = d.groupBy(*key, "run").agg(F.min("map_id").alias("map_id"), F.min("b").alias("b"), F.max("e").alias("e"))
    return d.select("map_id", F.array(iv.interval(F.col("b"), F.col("s"), F.col("e"))).alias("dims"), "exp")


def offset_domain_by(f: DataFrame, by: DataFrame) -> DataFrame:
    """Each piece's domain becomes its image under by; the expressions stay as they are. Fails where by is not defined or leaves the integers."""
    own = f.select("map_id", "dims", "exp", F.monotonically_increasing_id().alias("_piece"))
    own = Scratch(f.sparkSession, "moved").keep(own)
    pairs = sets.overlapping(own, by.select(F.col("dims").alias("od"), F.col("exp").alias("oe")), "dims", "od")
    pairs = pairs.withColumn("hit", iv.product_intersection(F.col("dims"), F.col("od"))).where("size(hit) > 0")
    return piece_image(pairs.select("map_id", F.col("exp").alias("_exp"), F.col("hit").alias("dims"), F.col("oe").alias("exp"))).select("map_id", F.col("img").alias("dims"), F.col("_exp").alias("exp"))


def offset_image_by(f: DataFrame, exp: Column) -> DataFrame:
    """Adds linear expressions, one a dimension, to those of all pieces."""
    return f.withColumn("exp", F.zip_with("exp", exp, ln.ladd))


# two maps by pieces on their common domain, in any number of dimensions


def _common(f: DataFrame, g: DataFrame) -> DataFrame:
    """Rows (map_id, dims, fe, ge): where pieces of both meet."""
    pairs = sets.overlapping(f.select("map_id", "dims", F.col("exp").alias("fe")), g.select(F.col("dims").alias("od"), F.col("exp").alias("ge")), "dims", "od")
    return pairs.withColumn("dims", iv.product_intersection(F.col("dims"), F.col("od"))).where("size(dims) > 0").drop("od")


def _parts(i: Column, f: Column, g: Column) -> Column:
    """Struct (low, high): the parts of an interval on which f <= g and on which f > g."""
    d = ln.lsub(f, g)

    def cut(v: Column) -> Column:
        i, m, h = v["i"], v["d"]["m"], v["d"]["h"]
        # the greatest x with m x + h <= 0 for m > 0; for m < 0 the least x is the ceiling
        num, den = -h["num"] * m["den"], h["den"] * m["num"]
        upto = lambda t: iv.interval(i["b"], i["s"], F.least(i["e"], t))
        after = lambda t: iv.interval(i["b"] + iv.ceil_div(F.greatest(t - i["b"], F.lit(0)), i["s"]) * i["s"], i["s"], i["e"])
        both = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
        rising = let(iv.div(num, den), lambda t: both(upto(t), after(t + 1)))
        falling = let(iv.ceil_div(-num, -den), lambda t: both(after(t), upto(t - 1)))
        level = F.when(h["num"] <= 0, both(i, iv.empty())).otherwise(both(iv.empty(), i))
        return F.when(m["num"] == 0, level).when(m["num"] > 0, rising).otherwise(falling)

    return let(F.struct(i.alias("i"), d.alias("d")), cut)


def _cut(f: DataFrame, g: DataFrame) -> DataFrame:
    """_common with cut: an array of _parts, one a dimension."""
    zipped = F.arrays_zip(F.col("dims").alias("i"), F.col("fe").alias("f"), F.col("ge").alias("g"))
    return _common(f, g).withColumn("cut", F.transform(zipped, lambda v: _parts(v["i"], v["f"], v["g"])))


def min_of(f: DataFrame, g: DataFrame) -> DataFrame:
    """On the common domain f where no coordinate of it is above g's, else g. Cost follows pieces that meet."""
    d = _cut(f, g)
    n = F.size("cut")
    low = F.transform("cut", lambda c: c["low"])
    # the rest of the box: its first k dimensions low, the next high, the others whole
    rest = lambda k: F.concat(F.slice(low, F.lit(1), k), F.slice(F.transform("cut", lambda c: c["high"]), k + 1, F.lit(1)), F.slice("dims", k + 2, n))
    piece = lambda dims, exp: F.struct(iv.product(dims).alias("dims"), exp.alias("exp"))
    pieces = F.concat(F.array(piece(low, F.col("fe"))), F.transform(F.sequence(F.lit(0), n - 1), lambda k: piece(rest(k), F.col("ge"))))
    return d.select("map_id", F.inline(pieces)).where("size(dims) > 0")


def minus_of(f: DataFrame, g: DataFrame) -> DataFrame:
    """Truncated difference on the common domain, coordinate by coordinate. Cost follows pieces that meet."""
    d = _cut(f, g)
    zero = lambda e: ln.linear(0, 0)
    n = sets.dimensions(f.select("dims"))
    d = d.select("map_id", "dims", "cut", F.zip_with("fe", "ge", ln.lsub).alias("diff"), F.array().cast(iv.DIMS).alias("done"), F.array().cast(ln.EXP).alias("exp"))
    for k in range(n):
        c, e = F.col("cut")[k], F.col("diff")[k]
        side = lambda part, exp: F.struct(part.alias("part"), exp.alias("e"))
        d = d.withColumn("_side", F.explode(F.array(side(c["low"], zero(e)), side(c["high"], e)))).where(~iv.is_empty(F.col("_side.part")))
        d = d.withColumns({"done": F.concat("done", F.array("_side.part")), "exp": F.concat("exp", F.array("_side.e"))}).drop("_side")
    return d.select("map_id", F.col("done").alias("dims"), "exp")


def equal_image_of(f: DataFrame, g: DataFrame) -> DataFrame:
    """The set on which both agree: in each dimension all, one point or none of a piece."""

    def agree(v: Column) -> Column:
        i, d = v["i"], ln.lsub(v["f"], v["g"])

        def where(w: Column) -> Column:
            m, h = w["m"], w["h"]
            num, den = -h["num"] * m["den"], h["den"] * m["num"]
            at = F.call_function("div", num, den)
            point = F.when((num % den == 0) & iv.is_member(at, i), iv.raw(at, F.lit(1), at)).otherwise(iv.empty())
            return F.when(m["num"] != 0, point).when(h["num"] == 0, i).otherwise(iv.empty())

        return let(d, where)

    zipped = F.arrays_zip(F.col("dims").alias("i"), F.col("fe").alias("f"), F.col("ge").alias("g"))
    return _common(f, g).select(iv.product(F.transform(zipped, agree)).alias("dims")).where("size(dims) > 0")


def equal_pieces(f: DataFrame, g: DataFrame) -> DataFrame:
    """One row: equal, as functions, however they are split: same domains, and agreement on all of it."""
    same = sets.equal(domain(f), domain(g)).select(F.col("equal").alias("p"))
    on, all_ = sets.cardinal(equal_image_of(f, g)).select(F.col("card").alias("a")), sets.cardinal(domain(f)).select(F.col("card").alias("b"))
    return same.crossJoin(on).crossJoin(all_).select((F.col("p") & (F.col("a") == F.col("b"))).alias("equal"))  # one row each


# many pieces of one dimension that may overlap


def _first(p: DataFrame) -> DataFrame:
    """Rows (rank, dims, exp), each only where no other precedes it: one of a lower rank, or of the same rank and a lower value.

    A piece loses to another on one stepped interval at most, so cost follows pairs that meet. What is left
    of each is a set difference with the piece's number as a dimension of its own.
    """
    scratch = Scratch(p.sparkSession, "first")
    i, e = F.col("dims")[0], F.col("exp")[0]
    # many pieces may be sent to one value: of constants on equal pieces only the first meets the others
    p = p.select("rank", "dims", F.when(i["b"] == i["e"], F.array(ln.linear(F.lit(0), ln.at(e, i["b"])))).otherwise(F.col("exp")).alias("exp"))
    p = scratch.keep(p.withColumn("level", ln.is_constant(e) & (e["h"]["den"] == 1)))
    level = p.where("level").groupBy("dims").agg(F.min(F.struct("rank", e["h"]["num"].alias("y"))).alias("v"))
    p = p.where("not level").select("rank", "dims", "exp").unionByName(level.select("v.rank", "dims", F.array(ln.linear(F.lit(0), F.col("v.y"))).alias("exp")))
    p = scratch.keep(p.withColumn("piece", F.monotonically_increasing_id()))
    other = p.select(F.col("rank").alias("orank"), F.col("dims").alias("od"), F.col("exp").alias("oe"), F.col("piece").alias("other"))
    pairs = sets.overlapping(p, other, "dims", "od").where("piece <> other and rank >= orank")
    pairs = pairs.withColumn("hit", iv.product_intersection(F.col("dims"), F.col("od"))).where("size(hit) > 0")
    # where both have one value, the one of the lower number stays
    before = F.col("other") < F.col("piece")
    own, its = F.col("exp")[0], F.col("oe")[0]
    parts = _parts(F.col("hit")[0], F.when(before, its).otherwise(own), F.when(before, own).otherwise(its))
    beaten = F.when(F.col("orank") < F.col("rank"), F.col("hit")[0]).otherwise(let(parts, lambda c: F.when(before, c["low"]).otherwise(c["high"])))
    point = iv.raw(F.col("piece"), F.lit(1), F.col("piece"))
    lost = pairs.select(iv.product(F.array(point, beaten)).alias("dims")).where("size(dims) > 0")
    won = sets.difference(p.select(F.concat(F.array(point), F.col("dims")).alias("dims")), lost)
    won = won.select(F.col("dims")[0]["b"].alias("piece"), F.slice("dims", 2, 1).alias("dims"))
    return won.join(p.select("piece", F.col("rank").alias("map_id"), "exp"), "piece").select("map_id", "dims", "exp")


def _line_only(f: DataFrame) -> None:
    if arity(f) != 1:
        raise ValueError("by pieces in one dimension only; use the form by elements")


def min_adjacent_of(f: DataFrame, g: DataFrame) -> DataFrame:
    """For each y = f(x) the least g(x), in one dimension. Cost follows pieces that meet."""
    _line_only(f)
    d = piece_image(_common(f, g).withColumnRenamed("fe", "exp"))
    i, fe, ge = F.col("dims")[0], F.col("exp")[0], F.col("ge")[0]
    ends = ln.linear(F.lit(0), F.least(ln.at(ge, i["b"]), ln.at(ge, i["e"])))
    back = F.when(ln.is_constant(fe), ends).otherwise(ln.lcompose(ge, ln.linverse(fe)))
    return _first(d.select(F.lit(0).alias("rank"), F.col("img").alias("dims"), F.array(back).alias("exp")))


def first_inverse_of(f: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """For each image the least element of the first map (by map_id) that has it, in one dimension. Cost follows pieces that meet."""
    _line_only(f)
    return _first(inverse(f if allowed is None else restrict(f, allowed)).withColumnRenamed("map_id", "rank"))


def reduce(f: DataFrame) -> DataFrame:
    """Closed form of endless iteration of x + h and x - h on one-dimensional pieces.

    With h the step, all of a piece ends one step beyond its last element (or before its first, if
    that is a natural). With h a multiple of the step and more than h*h elements, it is split by
    residue first. Other pieces stay.
    """
    i, e = F.col("dims")[0], F.col("exp")[0]
    h = e["h"]["num"]
    shift = (e["m"]["num"] == 1) & (e["m"]["den"] == 1) & (e["h"]["den"] == 1) & (h != 0)
    split = shift & (F.abs(h) % i["s"] == 0) & ((F.abs(h) == i["s"]) | (iv.cardinal(i) > h * h)) & ((h > 0) | (i["b"] + h >= 0))
    parts = F.explode(F.when(split, F.sequence(i["b"], i["b"] + F.abs(h) - i["s"], i["s"])).otherwise(F.array(i["b"])))
    d = f.select("map_id", "dims", "exp", split.alias("split"), parts.alias("at"))
    i, h = F.col("dims")[0], F.col("exp")[0]["h"]["num"]
    piece = iv.interval(F.col("at"), F.abs(h), i["e"])
    ends = let(piece, lambda p: F.when(h > 0, p["e"] + h).otherwise(p["b"] + h))
    return d.select("map_id", F.when(F.col("split"), F.array(piece)).otherwise(F.col("dims")).alias("dims"), F.when(F.col("split"), F.array(ln.linear(0, ends))).otherwise(F.col("exp")).alias("exp")).where("size(dims) > 0")


def arity(f: DataFrame) -> int:
    """Number of dimensions; 1 of the empty map."""
    return sets.dimensions(f.select("dims")) or 1


def expand(f: DataFrame, n: int = 1) -> DataFrame:
    """By elements; in one dimension x and y are naturals, else arrays. Fails if pieces have another number of dimensions."""
    wrong = F.raise_error(F.lit(f"a piece has not {n} dimensions"))
    d = f.withColumn("dims", F.when(F.size("dims") == n, F.col("dims")).otherwise(wrong))
    for k in range(n):
        d = d.withColumn(f"_x{k}", F.explode(iv.elements(F.col("dims")[k])))
    x = [F.col(f"_x{k}") for k in range(n)]
    y = [ln.at(F.col("exp")[k], x[k]) for k in range(n)]
    return d.select("map_id", (x[0] if n == 1 else F.array(*x)).alias("x"), (y[0] if n == 1 else F.array(*y)).alias("y"))


def compress(fn: DataFrame, stretch: int = sets.STRETCH) -> DataFrame:
    """Pieces from elements: runs of neighbours with one slope, found within stretches of the line; in more dimensions along the last one."""
    if fn.schema["x"].dataType.typeName() == "array":
        return _compressed_lines(fn)
    low, high, n = fn.agg(F.min("x"), F.max("x"), F.count(F.lit(1))).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // max(1, n // stretch)))
    w = W.partitionBy("part").orderBy("x")
    d = fn.select("x", "y", iv.div(F.col("x") - (low or 0), F.lit(width)).alias("part"))
    d = d.withColumn("slope", F.when(F.lead("x").over(w) == F.col("x") + 1, F.lead("y").over(w) - F.col("y")))
    d = d.withColumn("new", F.when((F.lag("x").over(w) == F.col("x") - 1) & (F.lag("slope").over(w) == F.coalesce("slope", F.lag("slope").over(w))), F.lit(0)).otherwise(F.lit(1)))
    d = d.withColumn("run", F.sum("new").over(w))
    d = d.groupBy("part", "run").agg(F.min("x").alias("b"), F.max("x").alias("e"), F.min_by("y", "x").alias("y"), F.min_by("slope", "x").alias("m"))
    m = F.when(F.col("b") == F.col("e"), F.lit(0)).otherwise(F.coalesce("m", F.lit(0)))
    return d.select(F.lit(0).alias("map_id"), F.array(iv.interval(F.col("b"), F.lit(1), F.col("e"))).alias("dims"), F.array(ln.linear(m, F.col("y") - m * F.col("b"))).alias("exp"))


def _compressed_lines(fn: DataFrame) -> DataFrame:
    """Elements in several dimensions: runs along the last one in which only its own coordinate changes, by one slope."""
    n = F.size("x")
    d = fn.select(F.slice("x", F.lit(1), n - 1).alias("xs"), F.element_at("x", -1).alias("x"), F.slice("y", F.lit(1), n - 1).alias("ys"), F.element_at("y", -1).alias("y"))
    w = W.partitionBy("xs", "ys").orderBy("x")
    d = d.withColumn("slope", F.when(F.lead("x").over(w) == F.col("x") + 1, F.lead("y").over(w) - F.col("y")))
    d = d.withColumn("new", F.when((F.lag("x").over(w) == F.col("x") - 1) & (F.lag("slope").over(w) == F.coalesce("slope", F.lag("slope").over(w))), F.lit(0)).otherwise(F.lit(1)))
    d = d.withColumn("run", F.sum("new").over(w))
    d = d.groupBy("xs", "ys", "run").agg(F.min("x").alias("b"), F.max("x").alias("e"), F.min_by("y", "x").alias("y"), F.min_by("slope", "x").alias("m"))
    m = F.when(F.col("b") == F.col("e"), F.lit(0)).otherwise(F.coalesce("m", F.lit(0)))
    dims = F.concat(F.transform("xs", lambda x: iv.raw(x, F.lit(1), x)), F.array(iv.interval(F.col("b"), F.lit(1), F.col("e"))))
    exp = F.concat(F.transform("ys", lambda y: ln.linear(F.lit(0), y)), F.array(ln.linear(m, F.col("y") - m * F.col("b"))))
    return d.select(F.lit(0).alias("map_id"), dims.alias("dims"), exp.alias("exp"))


# by elements: (x, y), and map_id where it counts


def at_both(f: DataFrame, g: DataFrame, y: Column) -> DataFrame:
    """y over the columns f and g, on the common domain."""
    return f.select("x", F.col("y").alias("f")).join(g.select("x", F.col("y").alias("g")), "x").select("x", y.alias("y"))


def _each(f: DataFrame, one: Callable[[Column, Column], Column]) -> Column:
    """one over f and g, or over each coordinate."""
    a, b = F.col("f"), F.col("g")
    return F.zip_with(a, b, one) if f.schema["y"].dataType.typeName() == "array" else one(a, b)


def min_map(f: DataFrame, g: DataFrame) -> DataFrame:
    """f where no coordinate of it is above g's, else g."""
    if f.schema["y"].dataType.typeName() != "array":
        return at_both(f, g, F.least("f", "g"))
    return at_both(f, g, F.when(F.forall(F.zip_with("f", "g", lambda a, b: a <= b), lambda v: v), F.col("f")).otherwise(F.col("g")))


def plus(f: DataFrame, g: DataFrame) -> DataFrame:
    return at_both(f, g, _each(f, lambda a, b: a + b))


def minus(f: DataFrame, g: DataFrame) -> DataFrame:
    """Truncated difference, coordinate by coordinate."""
    return at_both(f, g, _each(f, lambda a, b: F.greatest(a - b, F.lit(0))))


def equal_image(f: DataFrame, g: DataFrame) -> DataFrame:
    """The elements on which both agree."""
    return f.select("x", "y").join(g.select("x", "y"), ["x", "y"]).select("x")


def min_adjacent(f: DataFrame, g: DataFrame) -> DataFrame:
    """For each y = f(x), the least g(x); in more dimensions the first in lexicographic order."""
    return f.select("x", F.col("y").alias("to")).join(g.select("x", "y"), "x").groupBy("to").agg(F.min("y").alias("y")).withColumnRenamed("to", "x")


def shared_image(f: DataFrame) -> DataFrame:
    """The elements whose image has another one, too."""
    many = f.groupBy("y").count().where("count > 1").select("y")
    return f.join(many, "y", "left_semi").select("x")


def first_inverse(f: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """For each image the least element of the first map (by map_id) that has it."""
    if allowed is not None:
        f = f.join(allowed.select("x"), "x", "left_semi")
    order = F.struct("map_id", "x") if "map_id" in f.columns else F.col("x")
    return f.groupBy("y").agg(F.min_by("x", order).alias("x")).select(F.col("y").alias("x"), F.col("x").alias("y"))


def combine_elements(f: DataFrame, g: DataFrame) -> DataFrame:
    return f.select("x", "y").unionByName(g.join(f.select("x"), "x", "left_anti").select("x", "y"))


def compose_elements(f: DataFrame, g: DataFrame) -> DataFrame:
    """f after g."""
    return g.select("x", F.col("y").alias("mid")).join(f.select(F.col("x").alias("mid"), "y"), "mid").select("x", "y")


def map_infinite(f: DataFrame, times: int | None = None) -> DataFrame:
    """f after itself until nothing changes, by doubling; elements whose orbit leaves the domain drop out.

    times: compose so often instead. Fails if an orbit does not settle.
    """
    scratch = Scratch(f.sparkSession, "orbits")
    once = f = scratch.keep(f.select("x", "y"))
    if times is not None:
        out = f
        for _ in range(times):
            out = scratch.keep(compose_elements(f, out))
        return out
    for _ in range(max(1, f.count()).bit_length() + 1):
        new = scratch.keep(compose_elements(f, f))
        if new.count() == f.count() and new.join(f, ["x", "y"], "left_anti").isEmpty():
            # a cycle whose length divides a power of two comes back, too; what is settled does not move by one more step
            if compose_elements(once, new).join(new, ["x", "y"], "left_anti").isEmpty():
                return new
            break
        f = new
    raise ValueError("an orbit does not settle")


def equal(f: DataFrame, g: DataFrame) -> DataFrame:
    """One row: equal."""
    a, b = f.select("x", "y"), g.select("x", "y")
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg((F.count(F.lit(1)) == 0).alias("equal"))


