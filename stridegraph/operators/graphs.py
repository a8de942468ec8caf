"""Graphs as tables: vertices (id, sv) and edges (id, src, dst, se); sv and se name the set-vertex and the set-edge of each.

An undirected graph's edges have their first end in src. From pieces, vertices are expanded sets and
edges expanded maps with a common domain; in several dimensions ids number the tuples in lexicographic
order within the graph's shape.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridegraph.functions import intervals as iv
from stridegraph.operators import maps, sets


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = False
    #: In several dimensions, what ids stand for: bounds of the coordinates of vertices and of edges.
    shape: tuple[int, ...] = ()
    edge_shape: tuple[int, ...] = ()

    def copy(self, n: int) -> "Graph":
        """n disjoint translated copies."""
        whole = lambda n, shape: -(-n // math.prod(shape[1:])) * math.prod(shape[1:])  # noqa: E731  copies shift the first coordinate only
        top = whole((self.vertices.agg(F.max("id")).first()[0] or 0) + 1, self.shape)
        last = whole((self.edges.agg(F.max("id")).first()[0] or 0) + 1, self.edge_shape)
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("i")
        v = self.vertices.select("*", each).withColumn("id", F.col("id") + F.col("i") * top).drop("i")
        e = self.edges.select("*", each).withColumns({"src": F.col("src") + F.col("i") * top, "dst": F.col("dst") + F.col("i") * top, "id": F.col("id") + F.col("i") * last}).drop("i")
        return replace(self, vertices=v, edges=e)

    def erase_vertices(self, gone: DataFrame) -> "Graph":
        """Without some vertices (id) and the edges at them."""
        gone = gone.select("id")
        e = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return replace(self, vertices=self.vertices.join(gone, "id", "left_anti"), edges=e.select(*self.edges.columns))

    def add_set_vertex(self, ids: DataFrame) -> "Graph":
        """One more set-vertex; fails if an element is a vertex already."""
        if not ids.join(self.vertices, "id", "left_semi").isEmpty():
            raise ValueError("a set-vertex must be disjoint from the graph's vertices")
        sv = (self.vertices.agg(F.max("sv")).first()[0] or 0) + 1
        return replace(self, vertices=self.vertices.unionByName(ids.select("id", F.lit(sv).cast("bigint").alias("sv"))))

    def add_set_edge(self, edges: DataFrame) -> "Graph":
        """One more set-edge (id, src, dst); fails if an id is an edge already or an end is no vertex."""
        if not edges.join(self.edges, "id", "left_semi").isEmpty():
            raise ValueError("a set-edge must be disjoint from the graph's edges")
        ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
        if not ends.join(self.vertices, "id", "left_anti").isEmpty():
            raise ValueError("an edge must end at vertices")
        se = (self.edges.agg(F.max("se")).first()[0] or 0) + 1
        return replace(self, edges=self.edges.unionByName(edges.select("id", "src", "dst", F.lit(se).cast("bigint").alias("se"))))


def graph(vertices: DataFrame, edges: DataFrame, directed: bool = False) -> Graph:
    v = vertices if "sv" in vertices.columns else vertices.withColumn("sv", F.lit(1).cast("bigint"))
    e = edges if "se" in edges.columns else edges.withColumn("se", F.lit(1).cast("bigint"))
    return Graph(v.select("id", "sv"), e.select("id", "src", "dst", "se"), directed)


def number(x: Column, shape: tuple[int, ...]) -> Column:
    """The place of a tuple in lexicographic order of all within the shape."""
    out = x[0]
    for k, n in enumerate(shape[1:], 1):
        out = out * n + x[k]
    return out


def coordinates(i: Column, shape: tuple[int, ...]) -> Column:
    """The tuple of a number; its first coordinate is not bounded."""
    out = []
    for n in reversed(shape[1:]):
        out.append(F.pmod(i, F.lit(n)))
        i = iv.div(i, F.lit(n))
    return F.array(*reversed([*out, i]))


def of_pieces(v: DataFrame, vmap: DataFrame, one: DataFrame, two: DataFrame, emap: DataFrame, directed: bool = False) -> Graph:
    """From a set of vertices and maps by pieces: set-vertices, the edges' two ends, set-edges. Tuples become numbers."""
    n, m = sets.dimensions(v) or 1, maps.arity(one)

    def bounds(df: DataFrame, k: int) -> tuple[int, ...]:
        top = df.select(*[F.max(F.col("dims")[j]["e"]).alias(f"t{j}") for j in range(k)]).first()
        return tuple((x or 0) + 1 for x in top)

    shape, edge_shape = bounds(v, n), bounds(one.select("dims").unionByName(two.select("dims")), m)
    of = lambda c, k, s: F.col(c) if k == 1 else number(F.col(c), s)
    ids = sets.expand(v).select((F.col("x")[0] if n == 1 else number(F.col("x"), shape)).alias("id"))
    # the images under vmap and emap are names only
    name = lambda k: F.col("y") if k == 1 else F.xxhash64("y")
    sv = maps.expand(vmap, n).select(of("x", n, shape).alias("id"), name(n).alias("sv"))
    a = maps.expand(one, m).select(of("x", m, edge_shape).alias("id"), of("y", m, shape).alias("src"))
    b = maps.expand(two, m).select(of("x", m, edge_shape).alias("id"), of("y", m, shape).alias("dst"))
    se = maps.expand(emap, m).select(of("x", m, edge_shape).alias("id"), name(m).alias("se"))
    g = graph(ids.join(sv, "id", "left"), a.join(b, "id").join(se, "id", "left"), directed)
    return replace(g, shape=shape if n > 1 else (), edge_shape=edge_shape if m > 1 else ())
