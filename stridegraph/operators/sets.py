"""Sets of naturals, or of tuples of them, as tables of pieces: one row per product of stepped intervals.

A set is a DataFrame with a column dims (array of struct<b,s,e>); pieces are disjoint. Costs follow
the number of pieces, not of elements. Intersections join pieces that meet. Other one-dimensional algebra is a sweep: pieces are split into
residue classes of the steps' least common multiple, in which they are contiguous, and running sums
over their ends tell what each side covers. The line is cut in stretches of about STRETCH ends, and
what a stretch starts with is summed up over stretches, so that no task holds a whole line. More
dimensions are cut into the cells of all pieces' bounds, and cells are matched by equality.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stridegraph.functions import intervals as iv
from stridegraph.sources.scratch import Scratch
from stridegraph.functions.intervals import DIMS

#: Interval ends per stretch of the line.
STRETCH = 100_000


def pieces(spark: SparkSession, rows: Iterable) -> DataFrame:
    """A table of pieces from literals, each a list of (begin, step, end), or one such triple."""
    made = [[row] if row and not isinstance(row[0], (tuple, list)) else list(row) for row in rows]
    df = canonical(spark.createDataFrame([([{"b": b, "s": s, "e": e} for b, s, e in dims],) for dims in made], f"dims {DIMS}"))
    meet = lambda p, q: all(b <= f and c <= e and (c - b) % math.gcd(s, t) == 0 for (b, s, e), (c, t, f) in zip(p, q))
    return disjoint(df) if any(meet(p, q) for i, p in enumerate(made) for q in made[:i]) else df


def canonical(df: DataFrame) -> DataFrame:
    """Pieces in canonical form, without empty ones."""
    return df.select(iv.product(F.transform("dims", lambda i: iv.interval(i["b"], i["s"], i["e"]))).alias("dims")).where("size(dims) > 0")


def of_keys(df: DataFrame, key: Column | str, stretch: int = STRETCH) -> DataFrame:
    """The set of a column's values, compressed: runs of neighbours become one piece each."""
    x = (F.col(key) if isinstance(key, str) else key).cast("bigint")
    points = df.select(x.alias("x")).where("x is not null").distinct()
    return _islands(points, stretch)


def _islands(points: DataFrame, stretch: int) -> DataFrame:
    low, high, n = points.agg(F.min("x"), F.max("x"), F.count(F.lit(1))).first()
    if not n:
        return points.select(F.array().cast(DIMS).alias("dims")).limit(0)
    width = max(1, -(-(high - low + 1) // max(1, n // stretch)))
    own = W.partitionBy("part").orderBy("x")
    runs = points.withColumn("part", iv.div(F.col("x") - low, F.lit(width))).withColumn("run", F.col("x") - F.row_number().over(own))
    runs = runs.groupBy("part", "run").agg(F.min("x").alias("b"), F.max("x").alias("e"))
    return runs.select(F.array(iv.interval(F.col("b"), F.lit(1), F.col("e"))).alias("dims"))


def expand(df: DataFrame) -> DataFrame:
    """One row per element: x, an array of as many naturals as there are dimensions."""
    n = dimensions(df)
    out = df
    for k in range(n):
        out = out.withColumn(f"_x{k}", F.explode(iv.elements(F.col("dims")[k])))
    return out.select(F.array(*[f"_x{k}" for k in range(n)]).cast("array<bigint>").alias("x"))


def dimensions(df: DataFrame) -> int:
    """Number of dimensions; 0 of the empty set."""
    got = df.agg(F.max(F.size("dims"))).first()[0]
    return got or 0


def is_empty(df: DataFrame) -> bool:
    return df.where("size(dims) > 0").isEmpty()


def cardinal(df: DataFrame) -> DataFrame:
    """One row: card."""
    return df.agg(F.coalesce(F.sum(iv.product_cardinal(F.col("dims"))), F.lit(0)).cast("bigint").alias("card"))


def extremes(df: DataFrame) -> DataFrame:
    """One row: min_elem and max_elem, the least and the greatest element in lexicographic order; null for none."""
    return df.agg(F.min(iv.product_min(F.col("dims"))).alias("min_elem"), F.max(iv.product_max(F.col("dims"))).alias("max_elem"))


def offset(df: DataFrame, by: list[int]) -> DataFrame:
    return df.withColumn("dims", iv.product_offset(F.col("dims"), F.array(*[F.lit(k).cast("bigint") for k in by])))


def filtered(df: DataFrame, keep: Column) -> DataFrame:
    """The pieces for which a condition over dims holds."""
    return df.where(keep)


def concatenation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of sets known to be disjoint."""
    return a.select("dims").unionByName(b.select("dims"))


def measured(df: DataFrame) -> tuple[list[int], int, int, int]:
    """In one pass: by what each dimension is split, least and greatest member in the first, and number of pieces.

    A dimension is split by residues of the least common multiple of its steps, or, where that is beyond
    the greatest member, by members: a piece never has more classes than members.
    """
    n = dimensions(df)
    if not n:
        return [], 0, 0, 0
    own = [F.col("dims")[k] for k in range(n)]
    step = lambda k: F.collect_set(own[k]["s"])
    got = df.where("size(dims) > 0").agg(F.struct(*[step(k) for k in range(n)]), F.struct(*[F.max(i["e"]) for i in own]), F.min(own[0]["b"]), F.count(F.lit(1))).first()
    ls = []
    for steps, top in zip(got[0], got[1]):
        l = 1
        for x in steps:
            l = min(math.lcm(l, x), top + 1)
            if l > top:
                break
        ls.append(max(1, l))
    return ls, got[2], got[1][0], got[3]


def _classes(side: DataFrame, k: int, l: int) -> DataFrame:
    """Splits dimension k by residue modulo l: adds r{k}, lo{k}, hi{k}, the quotients of its ends."""
    i = F.col("dims")[k]
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(l).cast("bigint"), i["e"] - i["b"] + i["s"]) - 1, i["s"])).alias("_k")
    d = side.select("*", at).withColumn("_b", F.col("dims")[k]["b"] + F.col("_k"))
    d = d.withColumn(f"r{k}", F.pmod(F.col("_b"), F.lit(l).cast("bigint")))
    d = d.withColumn(f"lo{k}", F.call_function("div", F.col("_b") - F.col(f"r{k}"), F.lit(l).cast("bigint")))
    d = d.withColumn(f"hi{k}", F.col(f"lo{k}") + iv.div(F.col("dims")[k]["e"] - F.col("_b"), F.lit(l).cast("bigint")))
    return d.drop("_k", "_b")


def _rebuilt(k: int, l: int) -> Column:
    r, step = F.col(f"r{k}"), F.lit(l).cast("bigint")
    return iv.interval(F.col(f"lo{k}") * step + r, step, F.col(f"hi{k}") * step + r)


def _sweep(a: DataFrame, b: DataFrame, keep: Column, stretch: int, known) -> DataFrame:
    """One-dimensional pieces where keep holds; keep is over the counts a and b of pieces that cover a stretch."""
    both = a.select("dims", F.lit(1).alias("da"), F.lit(0).alias("db")).unionByName(b.select("dims", F.lit(0).alias("da"), F.lit(1).alias("db")))
    (l,), low, high, n = known
    ends = _classes(both, 0, l)
    ends = ends.select(F.col("r0").alias("r"), F.inline(F.array(F.struct(F.col("lo0").alias("at"), "da", "db"), F.struct((F.col("hi0") + 1).alias("at"), (-F.col("da")).alias("da"), (-F.col("db")).alias("db")))))
    ends = ends.groupBy("r", "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    low, high = low // l, high // l + 1
    width = max(1, -(-(high - low + 1) // max(1, 2 * n // stretch)))
    ends = ends.withColumn("part", iv.div(F.col("at") - low, F.lit(width)))
    # what earlier stretches leave open, and where the next one begins: a row per stretch
    whole = W.partitionBy("r").orderBy("part")
    before = whole.rowsBetween(W.unboundedPreceding, -1)
    heads = ends.groupBy("r", "part").agg(F.sum("da").alias("ta"), F.sum("db").alias("tb"), F.min("at").alias("first"))
    heads = heads.select("r", "part", F.coalesce(F.sum("ta").over(before), F.lit(0)).alias("a0"), F.coalesce(F.sum("tb").over(before), F.lit(0)).alias("b0"), F.lead("first").over(whole).alias("next"))
    own = W.partitionBy("r", "part").orderBy("at")
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    seg = ends.join(heads, ["r", "part"]).select("r", "part", "at", (F.col("a0") + F.sum("da").over(upto)).alias("a"), (F.col("b0") + F.sum("db").over(upto)).alias("b"), F.coalesce(F.lead("at").over(own), F.col("next")).alias("to"))
    seg = seg.withColumn("on", keep & F.col("to").isNotNull())
    # neighbours that are kept become one piece
    seg = seg.withColumn("island", F.sum(F.when(F.col("on") & F.coalesce(F.lag("on").over(own), F.lit(False)), F.lit(0)).otherwise(F.lit(1))).over(upto))
    out = seg.where("on").groupBy("r", "part", "island").agg(F.min("at").alias("lo0"), (F.max("to") - 1).alias("hi0")).withColumnRenamed("r", "r0")
    return out.select(F.array(_rebuilt(0, l)).alias("dims"))


def _cells(a: DataFrame, b: DataFrame, ls: list[int]) -> tuple[DataFrame, DataFrame]:
    """Both sets cut into cells of a local grid: in each dimension, at the bounds of those that share a cell of the dimensions before.

    Pieces meet bounds in buckets as wide as pieces are on average; no task holds a whole dimension.
    """
    both = a.select("dims", F.lit(0).alias("side")).unionByName(b.select("dims", F.lit(1).alias("side")))
    n = len(ls)
    d = both
    for k, l in enumerate(ls):
        d = _classes(d, k, l)
    scratch = Scratch(a.sparkSession, "cells")
    d = scratch.keep(d.drop("dims"))
    widths = d.agg(*[F.ceil(F.avg(F.col(f"hi{k}") - F.col(f"lo{k}") + 1)) for k in range(n)]).first()
    keys = []
    for k in range(n):
        width, lo, hi = F.lit(max(1, int(widths[k] or 1))).cast("bigint"), F.col(f"lo{k}"), F.col(f"hi{k}")
        first = lambda x: x - F.pmod(x, width)  # noqa: B023, E731
        keys.append(f"r{k}")
        bounds = d.select(*keys, F.explode(F.array(lo, hi + 1)).alias("g")).distinct().withColumn("bucket", first(F.col("g")))
        met = d.withColumn("bucket", F.explode(F.sequence(first(lo), first(hi), width))).join(bounds, [*keys, "bucket"]).where((F.col("g") >= lo) & (F.col("g") <= hi))
        cut = met.groupBy(*d.columns).agg(F.array_sort(F.collect_set("g")).alias("g"))
        cut = cut.withColumn("g", F.explode(F.transform("g", lambda g, i: F.struct(g.alias("lo"), (F.coalesce(F.get("g", i + 1), hi + 1) - 1).alias("hi")))))
        d = scratch.keep(cut.withColumn(f"lo{k}", F.col("g.lo")).withColumn(f"hi{k}", F.col("g.hi")).drop("g"))
        keys += [f"lo{k}", f"hi{k}"]
    return d.where("side = 0").select(*keys).distinct(), d.where("side = 1").select(*keys).distinct()


def _algebra(a: DataFrame, b: DataFrame, keep: Column, how: str, stretch: int) -> DataFrame:
    known = measured(a.select("dims").unionByName(b.select("dims")))
    ls = known[0]
    if not ls:
        return a.select("dims").limit(0)
    if len(ls) == 1:
        return _sweep(a, b, keep, stretch, known)
    x, y = _cells(a, b, ls)
    if how == "either":
        out = x.exceptAll(y).unionByName(y.exceptAll(x))
    else:
        out = x.unionByName(y).distinct() if how == "union" else x.join(y, x.columns, how)
    return out.select(F.array(*[_rebuilt(k, l) for k, l in enumerate(ls)]).alias("dims"))


def overlapping(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of rows whose products meet in the first dimension; names must differ between a and b.

    Each length of interval, by powers of two, has buckets as wide; a pair of lengths meets in the
    buckets of the longer, of which an interval is in two at most. So a few long pieces do not put
    all short ones into one bucket. Both sides are written first.
    """
    scratch = Scratch(a.sparkSession, "overlap")
    span = lambda c: F.col(c)[0]
    size = lambda c: F.length(F.bin(span(c)["e"] - span(c)["b"]))
    a, b = scratch.keep(a.where(F.size(left) > 0).withColumn("_p", size(left))), scratch.keep(b.where(F.size(right) > 0).withColumn("_q", size(right)))
    lengths = [[r[0] for r in d.select(c).distinct().collect()] for d, c in ((a, "_p"), (b, "_q"))]  # at most 64 each

    def deal(df: DataFrame, c: str, own: str, other: str, met: list[int]) -> DataFrame:
        df = df.withColumn(other, F.explode(F.array(*[F.lit(x) for x in met]).cast("array<int>")))
        width = F.expr(f"shiftleft(1L, greatest({own}, {other}))")
        return df.withColumn("_at", F.explode(F.sequence(iv.div(span(c)["b"], width), iv.div(span(c)["e"], width))))

    pairs = deal(a, left, "_p", "_q", lengths[1]).join(deal(b, right, "_q", "_p", lengths[0]), ["_p", "_q", "_at"])
    begin = F.greatest(span(left)["b"], span(right)["b"])
    here = iv.div(begin, F.expr("shiftleft(1L, greatest(_p, _q))")) == F.col("_at")
    return pairs.where((begin <= F.least(span(left)["e"], span(right)["e"])) & here).drop("_p", "_q", "_at")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of pieces that meet, by the Chinese remainder theorem in each dimension; cost follows such pairs, whatever the steps."""
    pairs = overlapping(a.select("dims"), b.select(F.col("dims").alias("other")), "dims", "other")
    return pairs.select(iv.product_intersection(F.col("dims"), F.col("other")).alias("dims")).where("size(dims) > 0")


def union(a: DataFrame, b: DataFrame, stretch: int = STRETCH) -> DataFrame:
    return _algebra(a, b, (F.col("a") > 0) | (F.col("b") > 0), "union", stretch)


def difference(a: DataFrame, b: DataFrame, stretch: int = STRETCH) -> DataFrame:
    return _algebra(a, b, (F.col("a") > 0) & (F.col("b") <= 0), "left_anti", stretch)


def disjoint(df: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The same elements in disjoint pieces, neighbours joined."""
    return union(df, df.limit(0), stretch)


def complement(df: DataFrame, low: int = 0, high: int = iv.INF - 1) -> DataFrame:
    """What a one-dimensional set lacks between two bounds."""
    every = df.sparkSession.range(1).select(F.array(iv.interval(F.lit(low), F.lit(1), F.lit(high))).alias("dims"))
    return difference(every, df)


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: equal, by elements, however they are split into pieces."""
    rest = _algebra(a, b, (F.col("a") > 0) != (F.col("b") > 0), "either", STRETCH)
    return rest.agg((F.count(F.lit(1)) == 0).alias("equal"))


def less(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: less, whether a's least element is below b's; the empty set comes last."""
    x, y = extremes(a).select(F.col("min_elem").alias("p")), extremes(b).select(F.col("min_elem").alias("q"))
    return x.crossJoin(y).select(F.when(F.col("p").isNull(), F.lit(False)).when(F.col("q").isNull(), F.lit(True)).otherwise(F.col("p") < F.col("q")).alias("less"))  # one row each


def compacted(df: DataFrame) -> DataFrame:
    """Fewer pieces with the same elements: neighbours in one dimension that agree in all others become one, until none do.

    In one dimension this is the sweep; a step other than 1 comes back where all residues share it.
    """
    n = dimensions(df)
    if n <= 1:
        return disjoint(df)
    scratch = Scratch(df.sparkSession, "compact")
    df = scratch.keep(df.select("dims"))
    while True:  # each round but the last has fewer pieces
        before = df.count()
        for k in range(n):
            rest = [F.col("dims")[j] for j in range(n) if j != k]
            own = F.col("dims")[k]
            d = df.select("dims", F.array(*rest).alias("rest"), own["s"].alias("s"), F.pmod(own["b"], own["s"]).alias("r"), own["b"].alias("b"), own["e"].alias("e"))
            w = W.partitionBy("rest", "s", "r").orderBy("b")
            d = d.withColumn("new", F.when(F.col("b") - F.lag("e").over(w) <= F.col("s"), F.lit(0)).otherwise(F.lit(1))).withColumn("run", F.sum("new").over(w))
            d = d.groupBy("rest", "s", "r", "run").agg(F.min("b").alias("b"), F.max("e").alias("e"))
            joined = [iv.interval(F.col("b"), F.col("s"), F.col("e")) if j == k else F.col("rest")[j - (j > k)] for j in range(n)]
            df = d.select(F.array(*joined).alias("dims"))
        df = scratch.keep(df)
        if df.count() == before:
            return df
