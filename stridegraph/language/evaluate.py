"""Evaluates programs: scalars on the driver, sets, maps and graphs as DataFrames."""

from __future__ import annotations

import time
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridegraph.functions import intervals as iv
from stridegraph.functions import linear as ln
from stridegraph.language.parse import Parser
from stridegraph.operators import graphs, maps, sets
from stridegraph.operators.graphs import Graph
from stridegraph.plans import algorithms as alg
from stridegraph.sources.scratch import Scratch
from stridegraph.sources.tables import as_json


@dataclass(frozen=True)
class SetValue:
    df: DataFrame


@dataclass(frozen=True)
class MapValue:
    df: DataFrame


@dataclass(frozen=True)
class Line:
    """m * x + h in one dimension."""

    m: Fraction
    h: Fraction

    def __str__(self) -> str:
        if not self.m:
            return str(self.h)
        slope = ("" if self.m.numerator == 1 else str(self.m.numerator)) + "x" + ("" if self.m.denominator == 1 else f"/{self.m.denominator}")
        return slope + ("" if not self.h else f"{'+' if self.h > 0 else ''}{self.h}")


@dataclass(frozen=True)
class Lines:
    """One line a dimension."""

    parts: tuple[Line, ...]

    def __str__(self) -> str:
        return "|".join(map(str, self.parts))


class Evaluator:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.names, self.scratch = spark, {}, Scratch(spark, "program")
        #: Documents of JSON (DataFrames of one row), one for each chain of matching, components and sorting.
        self.documents: list[DataFrame] = []

    def run(self, text: str) -> list:
        """The values of a program's expressions."""
        return [v for _, v, _ in self.steps(text)]

    def steps(self, text: str):
        """(expression, value, seconds) one by one."""
        parser = Parser(text)
        statements, expressions = parser.program()
        for name, e in statements:
            self.names[name] = self.of(e)
        for source, e in zip(parser.sources, expressions):
            began = time.perf_counter()
            value = self.of(e)
            yield source, value, time.perf_counter() - began

    def of(self, e):
        return getattr(self, f"_{e[0]}")(*e[1:])

    def _nat(self, n):
        return n

    def _name(self, name):
        if name == "x":
            return Line(Fraction(1), Fraction(0))
        if name not in self.names:
            raise NameError(f"{name} has no value")
        return self.names[name]

    def _tuple(self, parts):
        return tuple(self.of(p) for p in parts)

    def _lines(self, parts):
        return Lines(tuple(self.as_line(self.of(p)) for p in parts))

    def _parts(self, parts):
        return [self.of(p) for p in parts]

    def _interval(self, parts):
        return [tuple(self.of(p) for p in parts)]

    def _product(self, parts):
        return [self.of(p)[0] for p in parts]

    def _set(self, parts):
        rows = [self.of(p) for p in parts] or [[(1, 1, 0)]]
        return SetValue(self.kept(sets.pieces(self.spark, rows)))

    def kept(self, df: DataFrame) -> DataFrame:
        return self.scratch.keep(df)

    def as_set(self, v) -> DataFrame:
        return v.df if isinstance(v, SetValue) else sets.pieces(self.spark, [v])

    def as_line(self, v) -> Line:
        return v if isinstance(v, Line) else Line(Fraction(0), Fraction(v))

    def _map(self, domain, parts):
        lines = [self.as_line(v) for v in self.of(parts)]
        exp = F.array(*[ln.lexp(ln.ratio(v.m.numerator, v.m.denominator) if v.m.denominator != 1 else ln.ratio(v.m.numerator), ln.ratio(v.h.numerator, v.h.denominator) if v.h.denominator != 1 else ln.ratio(v.h.numerator)) for v in lines])
        return MapValue(self.kept(self.as_set(self.of(domain)).select(F.lit(0).alias("map_id"), "dims", exp.alias("exp"))))

    def _pw(self, parts):
        out = None
        for k, p in enumerate(parts):
            d = self.of(p).df.withColumn("map_id", F.lit(k))
            out = d if out is None else out.unionByName(d)
        return MapValue(self.kept(out))

    def _graph(self, fields):
        v = {k: self.of(e) for k, e in fields.items()}
        directed = "mapB" in v
        one, two = (v["mapB"], v["mapD"]) if directed else (v["map1"], v["map2"])
        return graphs.of_pieces(self.as_set(v["V"]), v["Vmap"].df, one.df, two.df, v["Emap"].df, directed)

    def _neg(self, e):
        v = self.of(e)
        return Line(-v.m, -v.h) if isinstance(v, Line) else -v

    def _card(self, e):
        return sets.cardinal(self.as_set(self.of(e))).first()[0]

    def _op(self, op, left, right):
        a, b = self.of(left), self.of(right)
        if isinstance(a, Lines):
            if op == "==":
                return int(a == b)
            return Lines(tuple({"+": lambda x, y: Line(x.m + y.m, x.h + y.h), "-": lambda x, y: Line(x.m - y.m, x.h - y.h)}[op](x, y) for x, y in zip(a.parts, b.parts, strict=True)))
        if isinstance(a, Line) or isinstance(b, Line):
            a, b = self.as_line(a), self.as_line(b)
            if op == "*" and not (a.m and b.m):
                k, v = (a.h, b) if not a.m else (b.h, a)
                return Line(k * v.m, k * v.h)
            return {"+": lambda: Line(a.m + b.m, a.h + b.h), "-": lambda: Line(a.m - b.m, a.h - b.h), "==": lambda: int(a == b)}[op]()
        if isinstance(a, (int, Fraction)):
            got = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "^": lambda: a**b, "==": lambda: int(a == b), "!=": lambda: int(a != b), "<": lambda: int(a < b)}[op]()
            return int(got) if isinstance(got, Fraction) and got.denominator == 1 else got
        if isinstance(a, MapValue):
            if op == "==":
                return int(maps.equal_pieces(a.df, b.df).first()[0])
            if op == "+":
                return MapValue(self.kept(maps.add(a.df, b.df)))
            if op == "-":
                return MapValue(self.kept(maps.minus_of(a.df, b.df)))
        x, y = self.as_set(a), self.as_set(b)
        if op in ("==", "!="):
            return int(sets.equal(x, y).first()[0] == (op == "=="))
        if op == "<":
            if isinstance(a, list):
                return int(a[0][0] < b[0][0])
            return int(sets.less(x, y).first()[0])
        return SetValue(self.kept({"/\\": sets.intersection, "\\/": sets.union, "\\": sets.difference}[op](x, y)))

    def _call(self, name, args):
        v = [self.of(a) for a in args]
        if name == "r":
            return Fraction(v[0], v[1])
        f = getattr(self, f"call_{name}", None)
        if f is None:
            raise NameError(f"{name} is no function")
        return f(*v)

    # the functions

    def call_isEmpty(self, s):
        return int(sets.is_empty(self.as_set(s)))

    def call_isMember(self, x, s):
        x = F.array(*[F.lit(k).cast("bigint") for k in (x if isinstance(x, tuple) else (x,))])
        return int(not self.as_set(s).where(iv.product_is_member(x, F.col("dims"))).isEmpty())

    def _end(self, s, k):
        got = sets.extremes(self.as_set(s)).first()[k]
        return None if got is None else got[0] if len(got) == 1 else tuple(got)

    def call_minElem(self, s):
        return self._end(s, 0)

    def call_maxElem(self, s):
        return self._end(s, 1)

    def call_compose(self, f, g):
        if isinstance(f, Line):
            return Line(f.m * g.m, f.m * g.h + f.h)
        if isinstance(f, Lines):
            return Lines(tuple(self.call_compose(x, y) for x, y in zip(f.parts, g.parts, strict=True)))
        return MapValue(self.kept(maps.compose(f.df, g.df)))

    def call_inv(self, f):
        if isinstance(f, Lines):
            return Lines(tuple(map(self.call_inv, f.parts)))
        if not f.m:
            raise ValueError("a constant has no inverse")
        return Line(1 / f.m, -f.h / f.m)

    def call_image(self, *v):
        return SetValue(self.kept(maps.image(v[-1].df, self.as_set(v[0]) if len(v) > 1 else None)))

    def call_preImage(self, *v):
        return SetValue(self.kept(maps.pre_image(v[-1].df, self.as_set(v[0]) if len(v) > 1 else None)))

    def call_dom(self, f):
        return SetValue(maps.domain(f.df))

    def call_combine(self, f, g):
        return MapValue(self.kept(maps.combine(f.df, g.df)))

    def elements(self, f: MapValue) -> DataFrame:
        return maps.expand(f.df, maps.arity(f.df))

    def _scalar(self, df):
        return MapValue(self.kept(maps.compress(self.kept(df))))

    def _joined(self, df):
        """Pieces as one map, neighbours of one expression together."""
        return MapValue(self.kept(maps.compact(self.kept(df.withColumn("map_id", F.lit(0))))))

    def call_firstInv(self, f, allowed=None):
        if allowed is not None:
            f = MapValue(self.kept(maps.restrict(f.df, self.as_set(allowed))))
        if maps.arity(f.df) == 1:
            return self._joined(maps.first_inverse_of(f.df))
        return self._scalar(maps.first_inverse(self.elements(f)))

    def call_minMap(self, f, g):
        return MapValue(self.kept(maps.min_of(f.df, g.df)))

    def call_reduce(self, f):
        return MapValue(self.kept(maps.reduce(f.df)))

    def call_minAdj(self, f, g):
        if maps.arity(f.df) == 1:
            return self._joined(maps.min_adjacent_of(f.df, g.df))
        return self._scalar(maps.min_adjacent(self.elements(f), self.elements(g)))

    def call_mapInf(self, f):
        return self._scalar(maps.map_infinite(self.elements(f)))

    def _labels(self, df, g: Graph, of: str = "rep", shape: tuple[int, ...] | None = None):
        shape = g.shape if shape is None else shape
        spell = lambda c: graphs.coordinates(F.col(c), shape) if shape else F.col(c)
        return self._scalar(df.select(spell("id").alias("x"), spell(of).alias("y")))

    def _keys(self, df, shape: tuple[int, ...]):
        if not shape:
            return SetValue(self.kept(sets.of_keys(df, "id")))
        point = F.transform(graphs.coordinates(F.col("id"), shape), lambda x: iv.raw(x, F.lit(1), x))
        return SetValue(self.kept(sets.compacted(self.kept(df.select(point.alias("dims")).distinct()))))

    def call_CC(self, g: Graph):
        return self._labels(alg.connected_components(g), g)

    def call_matching(self, g: Graph, n: int = 1):
        m, full = alg.matching(g.copy(n) if n > 1 else g)
        return self._keys(m, g.edge_shape), full

    def call_scc(self, g: Graph):
        return self._labels(alg.strong_components(g), g)

    def call_sort(self, g: Graph):
        return self._labels(alg.topological_sort(g), g, "pred")

    def call_matchSCC(self, g: Graph, n: int = 1):
        return self._labels(alg.match_strong(g.copy(n) if n > 1 else g), g, shape=g.edge_shape)

    def call_matchSCCTS(self, g: Graph, n: int = 1):
        """The order of the components, as a map; the matching, the components and the order go to documents as JSON."""
        got = alg.match_strong_sort(g.copy(n) if n > 1 else g)
        order, rep = (self._labels(got[k], g, c, g.edge_shape) for k, c in (("sort", "pred"), ("scc", "rep")))
        self.documents.append(self.kept(as_json(self._keys(got["matching"], g.edge_shape).df, rep.df, order.df)))
        return order

    def call_cut(self, g: Graph):
        return self._keys(alg.cut_set(g), g.shape)


#: Most pieces of a value that is rendered as text.
SHOWN = 100_000


def rendered(v) -> str:
    """A value as text; sets and maps list their pieces in order. Fails beyond SHOWN pieces: write those as tables."""
    if isinstance(v, (SetValue, MapValue)):
        rows = v.df.limit(SHOWN + 1).collect()
        if len(rows) > SHOWN:
            raise ValueError(f"over {SHOWN} pieces to render")
        rows = sorted((r.asDict(True) for r in rows), key=str)
        spell = lambda r: "x".join(f"[{i['b']}:{i['e']}]" if i["s"] == 1 else f"[{i['b']}:{i['s']}:{i['e']}]" for i in r["dims"])
        if isinstance(v, SetValue):
            return "{" + ", ".join(sorted(map(spell, rows))) + "}"
        line = lambda e: str(Line(Fraction(e["m"]["num"], e["m"]["den"]), Fraction(e["h"]["num"], e["h"]["den"])))
        return "<<" + ", ".join("{" + spell(r) + "} -> " + "|".join(map(line, r["exp"])) for r in rows) + ">>"
    if isinstance(v, tuple) and len(v) == 2 and isinstance(v[0], SetValue):
        return rendered(v[0]) + (" [FULLY MATCHED]" if v[1] else " [UNMATCHED]")
    if isinstance(v, tuple):
        return "(" + ", ".join(map(rendered, v)) + ")"
    if isinstance(v, list):
        return "x".join(f"[{b}:{e}]" if s == 1 else f"[{b}:{s}:{e}]" for b, s, e in v)
    return "" if v is None else str(v)


def run(spark: SparkSession, text: str) -> list[str]:
    """The rendered values of a program's expressions."""
    return [rendered(v) for v in Evaluator(spark).run(text)]


def run_file(spark: SparkSession, path: str, log: str | None = None) -> list[str]:
    """Runs a program file, from wherever Spark reads: a line `expression --> value` for each expression.

    log: a folder that gets these lines with their seconds, and the documents of JSON, as text.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    program, lines, times = Evaluator(spark), [], []
    for source, value, seconds in program.steps(text):
        lines.append(f"{source} --> {rendered(value)}")
        times.append(f"{lines[-1]} ({seconds * 1e6:.0f} us)")
    if log:
        spark.createDataFrame([(x,) for x in times], "line string").coalesce(1).write.mode("append").text(f"{log}/log")
        for d in program.documents:
            d.write.mode("append").text(f"{log}/json")
    return lines
