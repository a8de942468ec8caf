"""Graph algorithms as loops of joins and aggregations over vertex and edge tables.

Each round's table is written to the shared folder, so that plans do not grow and a lost executor
costs one round. Outputs are tables (id, rep) or the like.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stridegraph.operators.graphs import Graph, graph
from stridegraph.sources.scratch import Scratch

#: Rounds after which a loop that should have ended fails; more than any graph of this many vertices needs.
ROUNDS = 2**40


def _changed(new: DataFrame, old: DataFrame, on: str = "id") -> bool:
    a, b = new.select(on, F.col("rep").alias("p")), old.select(on, F.col("rep").alias("q"))
    return not a.join(b, on).where("p != q").isEmpty()


def connected_components(g: Graph) -> DataFrame:
    """(id, rep): the least vertex of each one's component. Neighbours' least label, then a jump to the label's own label."""
    scratch = Scratch(g.vertices.sparkSession, "components")
    ends = g.edges.select("src", "dst").where("src != dst")
    both = scratch.keep(ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    r = scratch.keep(g.vertices.select("id", F.col("id").alias("rep")))
    for _ in range(ROUNDS):
        near = both.join(r, both.dst == r.id).groupBy("src").agg(F.min("rep").alias("near"))
        new = r.join(near, r.id == near.src, "left").select("id", F.least("rep", F.coalesce("near", "rep")).alias("rep"))
        new = scratch.keep(new)
        up = new.select(F.col("id").alias("_id"), F.col("rep").alias("top"))
        new = scratch.keep(new.join(up, new.rep == up._id, "left").select("id", F.least("rep", F.coalesce("top", "rep")).alias("rep")))
        if not _changed(new, r):
            return new
        r = new
    raise RuntimeError("components did not settle")


def least_reachable(scratch: Scratch, v: DataFrame, e: DataFrame) -> DataFrame:
    """(id, rep): the least vertex that a path along e reaches, the vertex itself included.

    Vertices with one edge out are chains: doubling takes each to the chain's end, with the least
    vertex on the way, so long chains and rings need rounds by the logarithm of their length. Labels
    then travel along what is left.
    """
    out = e.groupBy("src").agg(F.countDistinct("dst").alias("n"), F.min("dst").alias("p"))
    chain = scratch.keep(out.where("n = 1").select("src", "p", F.least("src", "p").alias("m")))
    for _ in range(max(1, chain.count()).bit_length()):
        on = chain.select(F.col("src").alias("p"), F.col("p").alias("q"), F.col("m").alias("m2"))
        chain = scratch.keep(chain.join(on, "p", "left").select("src", F.coalesce("q", "p").alias("p"), F.least("m", F.coalesce("m2", "m")).alias("m")))
    many = e.join(chain.select("src"), "src", "left_anti").select("src", "dst")
    e = scratch.keep(many.unionByName(chain.select("src", F.col("p").alias("dst"))))
    r = scratch.keep(v.join(chain.select(F.col("src").alias("id"), "m"), "id", "left").select("id", F.least("id", F.coalesce("m", "id")).alias("rep")))
    for _ in range(ROUNDS):
        ahead = e.join(r, e.dst == r.id).groupBy("src").agg(F.min("rep").alias("far"))
        new = scratch.keep(r.join(ahead, r.id == ahead.src, "left").select("id", F.least("rep", F.coalesce("far", "rep")).alias("rep")))
        if not _changed(new, r):
            return new
        r = new
    raise RuntimeError("reachability did not settle")


def trimmed(scratch: Scratch, e: DataFrame) -> DataFrame:
    """Edges left after taking out, again and again, vertices that lack edges in or out; these are in no cycle."""
    e = scratch.keep(e.where("src != dst"))
    n = e.count()
    for _ in range(ROUNDS):
        heads, tails = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
        e = scratch.keep(e.join(heads, "src", "left_semi").join(tails, "dst", "left_semi"))
        left = e.count()
        if left == n:
            return e
        n = left
    raise RuntimeError("trimming did not settle")


def strong_components(g: Graph) -> DataFrame:
    """(id, rep): the least vertex of each one's strongly connected component.

    Edges whose ends reach different least vertices go, in turn along and against the edges, until
    neither direction takes any.
    """
    scratch = Scratch(g.vertices.sparkSession, "strong")
    e = trimmed(scratch, g.edges.select("src", "dst").distinct())
    v = scratch.keep(e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct())
    n, quiet, r = e.count(), 0, v.select("id", F.col("id").alias("rep"))
    while quiet < 2 and n:
        r = least_reachable(scratch, v, e)
        a, b = r.select(F.col("id").alias("src"), F.col("rep").alias("p")), r.select(F.col("id").alias("dst"), F.col("rep").alias("q"))
        e = scratch.keep(e.join(a, "src").join(b, "dst").where("p = q").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        left = e.count()
        quiet, n = (quiet + 1 if left == n else 0), left
    known = r if n else v.select("id", F.col("id").alias("rep"))
    return g.vertices.select("id").join(known, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))


def condensation(g: Graph, rep: DataFrame) -> Graph:
    """Vertices: representatives; edges: those between components, each once."""
    a, b = rep.select(F.col("id").alias("src"), F.col("rep").alias("p")), rep.select(F.col("id").alias("dst"), F.col("rep").alias("q"))
    e = g.edges.select("src", "dst").join(a, "src").join(b, "dst").where("p != q").select(F.col("p").alias("src"), F.col("q").alias("dst")).distinct()
    return graph(rep.where("id = rep").select("id"), e.withColumn("id", F.struct("src", "dst")), True)


def levels(g: Graph) -> DataFrame:
    """(id, level): 0 for vertices without outgoing edges, else one more than the highest of those that its edges lead to. Fails on a cycle."""
    scratch = Scratch(g.vertices.sparkSession, "levels")
    left, e, k = scratch.keep(g.vertices.select("id")), scratch.keep(g.edges.select("src", "dst").distinct()), 0
    none = left.select("id", F.lit(0).cast("bigint").alias("level"))
    scratch.append("levels", none.limit(0))
    n = left.count()
    while n:
        now = scratch.keep(left.join(e.select(F.col("src").alias("id")), "id", "left_anti").select("id", F.lit(k).cast("bigint").alias("level")))
        peeled = now.count()
        if not peeled:
            raise ValueError("the graph has a cycle")
        scratch.append("levels", now)
        left = scratch.keep(left.join(now.select("id"), "id", "left_anti"))
        e = scratch.keep(e.join(now.select(F.col("id").alias("dst")), "dst", "left_anti"))
        n, k = n - peeled, k + 1
    return scratch.read("levels", none.schema)


def partitioned(g: Graph) -> Graph:
    """Set-vertices split by the set-edges that leave and reach their vertices; a part is named by its least vertex."""
    ends = g.edges.select("se", F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("id")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("id")))).alias("at"))
    own = ends.groupBy("at.id").agg(F.sort_array(F.collect_set(F.struct("at.side", "se"))).alias("kinds"))
    v = g.vertices.join(own, "id", "left")
    names = v.groupBy("sv", "kinds").agg(F.min("id").alias("part"))
    parts = v.join(names, v.sv.eqNullSafe(names.sv) & v.kinds.eqNullSafe(names.kinds)).select("id", F.col("part").alias("sv"))
    return replace(g, vertices=parts)


def topological_sort(g: Graph) -> DataFrame:
    """(id, pred, place): what an edge leads to comes before what it starts from; by level, then id. The first one's pred is itself.

    Places are counted within levels first, and the levels' sizes summed up, so that no task sorts all.
    """
    scratch = Scratch(g.vertices.sparkSession, "sort")
    v = scratch.keep(levels(g))
    parts = max(1, v.count() // 200_000)
    cut = v.withColumn("part", F.ntile(1).over(W.partitionBy("level").orderBy("id"))) if parts == 1 else v.withColumn("part", F.spark_partition_id())
    if parts > 1:
        cut = scratch.keep(v.repartitionByRange(parts, "level", "id").withColumn("part", F.spark_partition_id()))
    sizes = cut.groupBy("level", "part").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("level", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row per level and range
    own = W.partitionBy("level", "part").orderBy("id")
    placed = scratch.keep(cut.join(before.select("level", "part", "before"), ["level", "part"]).select("id", (F.col("before") + F.row_number().over(own) - 1).alias("place")))
    last = placed.select((F.col("place") + 1).alias("place"), F.col("id").alias("pred"))
    return placed.join(last, "place", "left").select("id", F.coalesce("pred", "id").alias("pred"), "place")


def matching(g: Graph) -> tuple[DataFrame, bool]:
    """(matched edges (id, src, dst), whether every right vertex is matched): a largest matching of a bipartite graph.

    A phase searches in layers from the free right vertices, along unmatched edges to the left and
    matched ones back, until it meets free left vertices; of the paths found, one per root is kept,
    and they are flipped.
    """
    scratch = Scratch(g.vertices.sparkSession, "matching")
    e = scratch.keep(g.edges.select("id", F.col("src").alias("f"), F.col("dst").alias("u")))
    m = e.limit(0)
    for _ in range(ROUNDS):
        m = scratch.keep(m)
        taken_u, taken_f = m.select("u"), m.select("f")
        rest = scratch.keep(e.join(m.select("id"), "id", "left_anti"))
        layer = scratch.keep(e.select("u").distinct().join(taken_u, "u", "left_anti").select("u", F.col("u").alias("root"), F.array().cast("array<bigint>").alias("path")))
        seen = layer.select("u")
        found = None
        while not layer.isEmpty():
            step = layer.join(rest, "u").select("f", "root", F.concat("path", F.array("id")).alias("path"))
            step = step.groupBy("f").agg(F.min_by(F.struct("root", "path"), F.struct("root", "path")).alias("b")).select("f", "b.root", "b.path")
            step = scratch.keep(step)
            done = scratch.keep(step.join(taken_f, "f", "left_anti"))
            if not done.isEmpty():
                found = done
                break
            back = step.join(m.select("f", F.col("u").alias("u2"), F.col("id").alias("mid")), "f").select(F.col("u2").alias("u"), "root", F.concat("path", F.array("mid")).alias("path"))
            layer = scratch.keep(back.join(seen, "u", "left_anti"))
            seen = scratch.keep(seen.unionByName(layer.select("u")))
        if found is None:
            break
        # of a root's paths the first; of the paths that are left, those that share no vertex with an earlier one
        paths = found.groupBy("root").agg(F.min_by(F.struct("f", "path"), F.struct("f", "path")).alias("b")).select("root", "b.path")
        edges = scratch.keep(paths.select("root", F.posexplode("path").alias("at", "id")).join(e, "id"))
        sides = edges.select("root", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("f").alias("x")), F.struct(F.lit(1).alias("side"), F.col("u").alias("x")))).alias("w"))
        clash = sides.groupBy("w").agg(F.min("root").alias("first")).join(sides, "w").where("root != first").select("root").distinct()
        edges = scratch.keep(edges.join(clash, "root", "left_anti"))
        drop = edges.where("at % 2 = 1").select("id")
        m = m.join(drop, "id", "left_anti").unionByName(edges.where("at % 2 = 0").select("id", "f", "u"))
    full = e.select("u").distinct().join(m.select("u"), "u", "left_anti").isEmpty()
    return m.select("id", F.col("f").alias("src"), F.col("u").alias("dst")), full


def matched_graph(g: Graph, matched: DataFrame) -> Graph:
    """Vertices: matched edges; each other edge becomes an arc from the matched edge at its left end to the one at its right end."""
    other = g.edges.select("id", "src", "dst").join(matched.select("id"), "id", "left_anti")
    a, b = matched.select(F.col("id").alias("from"), "src"), matched.select(F.col("id").alias("to"), "dst")
    arcs = other.join(a, "src").join(b, "dst").select("id", F.col("from").alias("src"), F.col("to").alias("dst"))
    return graph(matched.select("id"), arcs, True)


def match_strong(g: Graph) -> DataFrame:
    m, _ = matching(g)
    return strong_components(matched_graph(g, m))


def match_strong_sort(g: Graph) -> dict[str, DataFrame]:
    """The chain of matching, strong components and sorting: its three tables."""
    scratch = Scratch(g.vertices.sparkSession, "chain")
    m = scratch.keep(matching(g)[0])
    d = matched_graph(g, m)
    rep = scratch.keep(strong_components(d))
    return {"matching": m, "scc": rep, "sort": topological_sort(condensation(d, rep))}


def cut_set(g: Graph) -> DataFrame:
    """(id): vertices whose removal leaves no cycle of two or more. In rounds, of each strong component the vertex of highest degree (least id of several) goes."""
    scratch = Scratch(g.vertices.sparkSession, "cut")
    gone = None
    e = trimmed(scratch, g.edges.select("src", "dst"))
    for _ in range(ROUNDS):
        v = scratch.keep(e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct())
        if v.isEmpty():
            return gone if gone is not None else v
        rep = scratch.keep(strong_components(graph(v, e.withColumn("id", F.struct("src", "dst")), True)))
        a, b = rep.select(F.col("id").alias("src"), F.col("rep").alias("p")), rep.select(F.col("id").alias("dst"), F.col("rep").alias("q"))
        e = scratch.keep(e.join(a, "src").join(b, "dst").where("p = q").select("src", "dst", "p"))
        degree = e.select(F.col("p"), F.explode(F.array("src", "dst")).alias("id")).groupBy("p", "id").count()
        worst = scratch.keep(degree.groupBy("p").agg(F.min_by("id", F.struct(-F.col("count"), "id")).alias("id")).select("id"))
        gone = scratch.keep(worst if gone is None else gone.unionByName(worst))
        e = e.select("src", "dst").join(worst.withColumnRenamed("id", "src"), "src", "left_anti").join(worst.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
        e = trimmed(scratch, e)
    raise RuntimeError("the cut set did not settle")
