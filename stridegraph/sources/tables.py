"""Driver tables as intervals, sets, maps and graphs; and the JSON sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridegraph.functions import intervals as iv
from stridegraph.functions import linear as ln
from stridegraph.operators import sets
from stridegraph.operators.graphs import Graph, graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two intervals an order, i and j."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select("o_orderkey", "o_custkey", iv.interval(c % 50, 1 + c % 7, c % 50 + 40).alias("i"), iv.interval(k % 40, 1 + k % 6, k % 40 + k % 90 - 5).alias("j"))


#: The same in SQL: members as lists.
INTERVAL_PAIRS = """with p as (select o_orderkey, o_custkey, range(o_custkey % 50, o_custkey % 50 + 41, 1 + o_custkey % 7) as i,
 range(o_orderkey % 40, o_orderkey % 40 + o_orderkey % 90 - 4, 1 + o_orderkey % 6) as j from orders)"""


def order_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order keys of one status, and those of the two highest priorities, by pieces."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return sets.of_keys(o.where("o_orderstatus = 'O'"), "o_orderkey"), sets.of_keys(o.where("o_orderpriority < '3'"), "o_orderkey")


def order_maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """From order to customer, and from order (of those with lines) to its least part; (x, y) by elements."""
    f = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("x"), F.col("o_custkey").alias("y"))
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("x")).agg(F.min("l_partkey").alias("y"))
    return f, g


def part_maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two maps by pieces over suppliers' intervals of part keys: pieces of ten keys each, with slopes by key."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    dims = lambda b, step, e: F.array(iv.interval(b, step, e))
    f = s.select(F.lit(0).alias("map_id"), dims(F.col("k") * 10, F.lit(1), F.col("k") * 10 + 9).alias("dims"), F.array(ln.linear(F.col("k") % 3, F.col("k"))).alias("exp"))
    g = s.select(F.lit(0).alias("map_id"), dims(F.col("k") * 14, F.lit(2), F.col("k") * 14 + 12).alias("dims"), F.array(ln.linear(1 + F.col("k") % 2, -F.col("k") % 5 + 5)).alias("exp"))
    return f, g


PART_MAPS = """with f as (select k * 10 + i as x, (k % 3) * (k * 10 + i) + k as y from (select s_suppkey as k from supplier), range(10) t(i)),
g as (select k * 14 + 2 * i as x, (1 + k % 2) * (k * 14 + 2 * i) - (k % 5) + 5 as y from (select s_suppkey as k from supplier), range(7) t(i))"""


def nation_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers (ids from 0), nations, and parts hashed to nations: a graph of one component per nation and part group."""
    s = read(spark, sf_dir, "supplier")
    a = s.select(F.col("s_suppkey").alias("src"), (F.col("s_nationkey").cast("bigint") + 1_000_000).alias("dst"))
    e = a.withColumn("id", F.col("src"))
    v = a.select(F.col("src").alias("id")).unionByName(read(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("bigint") + 1_000_000).alias("id")))
    return graph(v, e)


def supplier_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed: each supplier leads to (7 k + 3) mod n, and those divisible by 10 to k + 1."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    n = s.count()
    e = s.select(F.col("k").alias("id"), F.col("k").alias("src"), ((7 * F.col("k") + 3) % n).alias("dst"))
    e = e.unionByName(s.where((F.col("k") % 10 == 0) & (F.col("k") + 1 < n)).select((F.col("k") + n).alias("id"), F.col("k").alias("src"), (F.col("k") + 1).alias("dst")))
    return graph(s.select(F.col("k").alias("id")), e, True)


SUPPLIER_EDGES = """n as (select count(*) as n from supplier), e as (select s_suppkey as src, (7 * s_suppkey + 3) % n as dst from supplier, n
 union select s_suppkey, s_suppkey + 1 from supplier, n where s_suppkey % 10 = 0 and s_suppkey + 1 < n)"""


def part_tree(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed: each part key but 0 leads to its half, as in a heap."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return graph(p.select(F.col("k").alias("id")), p.where("k > 0").select(F.col("k").alias("id"), F.col("k").alias("src"), F.expr("k div 2").alias("dst")), True)


def grid_maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two maps by pieces in two dimensions: a box a supplier, in f with steps, in g without; slopes and offsets by key."""
    k, one = F.col("k"), F.lit(1)
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    f = s.select((k % 4).cast("int").alias("map_id"), F.array(iv.interval(6 * k, 1 + k % 2, 6 * k + 4), iv.interval(k % 5, one, k % 5 + 3)).alias("dims"), F.array(ln.linear(k % 3, k % 7 + 3), ln.linear(F.lit(1), k % 4)).alias("exp"))
    g = s.select(F.lit(0).alias("map_id"), F.array(iv.interval(6 * k + 1, one, 6 * k + 5), iv.interval(k % 3, F.lit(2), k % 3 + 6)).alias("dims"), F.array(ln.linear(F.lit(1), k % 5), ln.linear(k % 2, F.lit(4))).alias("exp"))
    return f, g


GRID_MAPS = """with f as (select k % 4 as map_id, x0, x1, (k % 3) * x0 + k % 7 + 3 as y0, x1 + k % 4 as y1 from (select s_suppkey as k from supplier), range(5) t(i), range(4) u(j), lateral (select 6 * k + i as x0, k % 5 + j as x1) where i % (1 + k % 2) = 0),
g as (select x0, x1, x0 + k % 5 as y0, (k % 2) * x1 + 4 as y1 from (select s_suppkey as k from supplier), range(5) t(i), range(4) u(j), lateral (select 6 * k + 1 + i as x0, k % 3 + 2 * j as x1))"""


def equation_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Bipartite: right vertex k (a supplier) to left vertices 10**6 + k and 10**6 + k + 1 (modulo n); every right vertex can be matched."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    n = s.count()
    left = lambda c: c % n + 1_000_000
    e = s.select((2 * F.col("k")).alias("id"), left(F.col("k")).alias("src"), F.col("k").alias("dst")).unionByName(s.select((2 * F.col("k") + 1).alias("id"), left(F.col("k") + 1).alias("src"), F.col("k").alias("dst")))
    return graph(s.select(F.col("k").alias("id")).unionByName(s.select((F.col("k") + 1_000_000).alias("id"))), e)


#: Most pieces of a set or map in one document of JSON.
JSON_PIECES = 100_000


def as_json(matching: DataFrame | None, scc: DataFrame | None, sort: DataFrame | None) -> DataFrame:
    """One row: json, with arrays of matched intervals [[b, s, e], ...] and of maps {dom, exp: [[m, h], ...]}. Fails beyond JSON_PIECES pieces, as one row holds all."""
    for df in (matching, scc, sort):
        if df is not None and df.limit(JSON_PIECES + 1).count() > JSON_PIECES:
            raise ValueError(f"over {JSON_PIECES} pieces in a document of JSON")

    def interval_lists(df: DataFrame) -> DataFrame:
        return df.select(F.transform("dims", lambda i: F.array(i["b"], i["s"], i["e"])).alias("interval"))

    def maps_(df: DataFrame) -> DataFrame:
        e = F.transform("exp", lambda x: F.array(ln.rendered_ratio(x["m"]), ln.rendered_ratio(x["h"])))
        return df.select(F.transform("dims", lambda i: F.array(i["b"], i["s"], i["e"])).alias("dom"), e.alias("exp"))

    parts = []
    for name, df in (("matching", interval_lists(matching) if matching is not None else None), ("scc", maps_(scc) if scc is not None else None), ("sort", maps_(sort) if sort is not None else None)):
        if df is not None:
            parts.append(df.select(F.struct(*df.columns).alias("v")).agg(F.to_json(F.sort_array(F.collect_list("v"))).alias("j")).select(F.concat(F.lit(f'"{name}":'), F.coalesce("j", F.lit("[]"))).alias("j")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("j")), ","), F.lit("}")).alias("json"))
