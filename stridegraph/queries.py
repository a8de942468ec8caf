"""Queries over the driver tables, one per operator, each with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridegraph.functions import intervals as iv
from stridegraph.functions import linear as ln
from stridegraph.language.evaluate import Evaluator, rendered
from stridegraph.operators import maps, sets
from stridegraph.operators.graphs import graph
from stridegraph.plans import algorithms as alg
from stridegraph.sources import tables as t
from stridegraph.sources.scratch import Scratch

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


P = t.INTERVAL_PAIRS

# scalars and intervals


@query(P + " select o_orderkey, len(j)::bigint as card, len(j) = 0 as is_empty, list_min(j) as min_elem, list_max(j) as max_elem from p")
def interval_cardinal(spark, sf_dir):
    j = F.col("j")
    return t.interval_pairs(spark, sf_dir).select("o_orderkey", iv.cardinal(j).alias("card"), iv.is_empty(j).alias("is_empty"), iv.min_elem(j).alias("min_elem"), iv.max_elem(j).alias("max_elem"))


@query(P + " select o_orderkey, list_contains(j, o_orderkey % 97) as member from p")
def interval_member(spark, sf_dir):
    return t.interval_pairs(spark, sf_dir).select("o_orderkey", iv.is_member(F.col("o_orderkey") % 97, F.col("j")).alias("member"))


@query(P + """, q as (select o_orderkey, list_sort(list_intersect(i, j)) as c from p)
 select o_orderkey, len(c)::bigint as n, case when len(c) > 0 then c[1] else 1 end as b, case when len(c) > 1 then c[2] - c[1] else 1 end as s, case when len(c) > 0 then c[-1] else 0 end as e from q""")
def interval_intersection(spark, sf_dir):
    d = t.interval_pairs(spark, sf_dir).select("o_orderkey", iv.intersection(F.col("i"), F.col("j")).alias("c"))
    return d.select("o_orderkey", iv.cardinal(F.col("c")).alias("n"), "c.*")


@query(P + " select o_orderkey, case when len(j) > 0 then j[1] + 7 else 1 end as b, case when len(j) > 0 then j[-1] + 7 else 0 end as e, case when (case when len(j) > 0 then j[1] else 1 end) < i[1] then 'j' else 'i' end as first from p")
def interval_offset_least(spark, sf_dir):
    i, j = F.col("i"), F.col("j")
    moved = iv.offset(j, F.lit(7))
    return t.interval_pairs(spark, sf_dir).select("o_orderkey", moved["b"].alias("b"), moved["e"].alias("e"), F.when(iv.least(i, j) == i, "i").otherwise("j").alias("first"))


@query(P + ", q as (select a.o_orderkey, range(a.o_orderkey % 9, 60, 3) as i, range(a.o_orderkey % 9 + a.o_orderkey % 80, a.o_orderkey % 9 + a.o_orderkey % 80 + 40, 3) as j from p a), r as (select o_orderkey, list_sort(list_distinct(list_concat(i, j))) as u from q) select o_orderkey, len(u)::bigint as n from r where len(u) = (u[-1] - u[1]) // 3 + 1 and list_bool_and(list_transform(u, lambda x: (x - u[1]) % 3 = 0))")
def interval_compact(spark, sf_dir):
    k = F.col("o_orderkey")
    at = k % 9 + k % 80
    d = t.read(spark, sf_dir, "orders").select("o_orderkey", iv.compacted(iv.interval(k % 9, F.lit(3), F.lit(59)), iv.interval(at, F.lit(3), at + 39)).alias("c"))
    return d.where("c is not null").select("o_orderkey", iv.cardinal(F.col("c")).alias("n"))


@query("select o_orderkey, (o_orderkey + 2) * 3 - o_custkey as a, ((o_orderkey % 5 + 1) ** (o_custkey % 7))::bigint as p from orders")
def scalar_arithmetic(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.read(spark, sf_dir, "orders").select("o_orderkey", ((k + 2) * 3 - c).alias("a"), ln.power(k % 5 + 1, c % 7).alias("p"))


@query(P + " select o_orderkey, len(i)::bigint * len(j) as card, len(list_intersect(i, j))::bigint * len(list_intersect(j, i)) as n from p")
def product_intersection(spark, sf_dir):
    d = t.interval_pairs(spark, sf_dir).select("o_orderkey", iv.product(F.array("i", "j")).alias("a"), iv.product(F.array("j", "i")).alias("b"))
    return d.select("o_orderkey", iv.product_cardinal(F.col("a")).alias("card"), iv.product_cardinal(iv.product_intersection(F.col("a"), F.col("b"))).alias("n"))


_Q = "with q as (select o_orderkey, o_orderkey % 9 - 4 as a, o_orderkey % 5 + 1 as b, o_custkey % 7 - 3 as c, o_custkey % 4 + 1 as d from orders) "
_RED = lambda n, d, name: f"({n}) // gcd({n}, {d}) * sign({d})::bigint as {name}_num, abs(({d}) // gcd({n}, {d})) as {name}_den"


@query(_Q + "select o_orderkey, " + ", ".join([_RED("a * d + c * b", "b * d", "sum"), _RED("a * d - c * b", "b * d", "diff"), _RED("a * c", "b * d", "prod"), _RED("-a", "b", "neg"), _RED("a * d", "b * c", "quot")]) + ", a * d < c * b as less, c * b < a * d as greater, a * d = c * b as same from q where c <> 0")
def scalar_rationals(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y = ln.ratio(k % 9 - 4, k % 5 + 1), ln.ratio(c % 7 - 3, c % 4 + 1)
    made = {"sum": ln.radd(x, y), "diff": ln.rsub(x, y), "prod": ln.rmul(x, y), "neg": ln.rneg(x), "quot": ln.rdiv(x, y)}
    parts = [v[f].alias(f"{n}_{f}") for n, v in made.items() for f in ("num", "den")]
    return t.read(spark, sf_dir, "orders").where(c % 7 != 3).select("o_orderkey", *parts, ln.rless(x, y).alias("less"), ln.rless(y, x).alias("greater"), ln.requal(x, y).alias("same"))


@query(P + " select o_orderkey, i = j as same, i <> j as differ, len(i) > 0 and (len(j) = 0 or i[1] < j[1]) as less, len(j) > 0 and (len(i) = 0 or j[1] < i[1]) as greater from p")
def interval_compare(spark, sf_dir):
    i, j = F.col("i"), F.col("j")
    return t.interval_pairs(spark, sf_dir).select("o_orderkey", iv.equal(i, j).alias("same"), (~iv.equal(i, j)).alias("differ"), iv.less(i, j).alias("less"), iv.less(j, i).alias("greater"))


@query(P + """, q as (select o_orderkey, i, j, len(j) = 0 as none, range(o_custkey % 50 + 41, o_custkey % 50 + 61) as m from p)
 select o_orderkey, none, case when none then 0 else 2 end as arity, none as flat, case when not none then i[1] else -1 end as min0, case when not none then j[1] else -1 end as min1, case when not none then i[-1] else -1 end as max0, case when not none then j[-1] else -1 end as max1,
 case when not none then i[1] + 3 else -1 end as off0, case when not none then j[-1] + 4 else -1 end as off1, not none and list_contains(i, 40) and list_contains(j, 30) as member,
 none or (i[1], j[1]) >= (j[1], i[1]) as second, not none and (i[1], j[1]) < (j[1], i[1]) as less, not none and (i = j) as same from q""")
def product_shape(spark, sf_dir):
    d = t.interval_pairs(spark, sf_dir).select("o_orderkey", iv.product(F.array("i", "j")).alias("a"), iv.product(F.array("j", "i")).alias("b"))
    a, b = F.col("a"), F.col("b")
    low, high, off = iv.product_min(a), iv.product_max(a), iv.product_offset(a, F.array(F.lit(3), F.lit(4)).cast("array<bigint>"))
    some = ~iv.product_is_empty(a)
    at = lambda x, k, f=None: F.when(some, F.get(x, F.lit(k))[f] if f else F.get(x, F.lit(k))).otherwise(F.lit(-1))
    point = F.array(F.lit(40), F.lit(30)).cast("array<bigint>")
    return d.select(
        "o_orderkey", iv.product_is_empty(a).alias("none"), iv.arity(a).alias("arity"), iv.is_one_dimensional(a).alias("flat"), at(low, 0).alias("min0"), at(low, 1).alias("min1"), at(high, 0).alias("max0"), at(high, 1).alias("max1"),
        at(off, 0, "b").alias("off0"), at(off, 1, "e").alias("off1"), iv.product_is_member(point, a).alias("member"),
        (F.when(some, iv.product_equal(iv.product_least(b, a), b)).otherwise(F.lit(True))).alias("second"), iv.product_less(a, b).alias("less"), (some & iv.product_equal(a, b)).alias("same"),
    )


@query("""with q as (select o_orderkey as k, range(o_orderkey % 9, 60, 3) as i, range(o_orderkey % 9 + o_orderkey % 80, o_orderkey % 9 + o_orderkey % 80 + 40, 3) as j from orders), r as (select k, list_sort(list_distinct(list_concat(i, j))) as u from q)
 select k as o_orderkey, len(u)::bigint * (1 + k % 4) as n from r where len(u) = (u[-1] - u[1]) // 3 + 1 and list_bool_and(list_transform(u, lambda x: (x - u[1]) % 3 = 0))""")
def product_compact(spark, sf_dir):
    k = F.col("o_orderkey")
    at, other = k % 9 + k % 80, iv.interval(F.lit(0), F.lit(1), k % 4)
    one, two = F.array(iv.interval(k % 9, F.lit(3), F.lit(59)), other), F.array(iv.interval(at, F.lit(3), at + 39), other)
    d = t.read(spark, sf_dir, "orders").select("o_orderkey", iv.product_compacted(one, two).alias("c"))
    return d.where("c is not null").select("o_orderkey", iv.product_cardinal(F.col("c")).alias("n"))


# sets

_A, _B = "(select o_orderkey as x from orders where o_orderstatus = 'O')", "(select o_orderkey as x from orders where o_orderpriority < '3')"


def _line(df: DataFrame) -> DataFrame:
    return df.select(F.explode(iv.elements(F.col("dims")[0])).alias("x"))


@query(f"select x from {_A} intersect select x from {_B}")
def set_intersection(spark, sf_dir):
    return _line(sets.intersection(*t.order_sets(spark, sf_dir)))


@query(f"select x from {_A} union select x from {_B}")
def set_union(spark, sf_dir):
    return _line(sets.union(*t.order_sets(spark, sf_dir)))


@query(f"select x from {_A} except select x from {_B}")
def set_difference(spark, sf_dir):
    return _line(sets.difference(*t.order_sets(spark, sf_dir)))


@query(f"select count(*) as card, min(x) as min_elem, max(x) as max_elem from {_A}")
def set_cardinal(spark, sf_dir):
    a = t.order_sets(spark, sf_dir)[0]
    return sets.cardinal(a).crossJoin(sets.extremes(a)).select("card", F.col("min_elem")[0].alias("min_elem"), F.col("max_elem")[0].alias("max_elem"))  # one row each


@query(f"""with a as {_A}, b as {_B} select count(*) = 0 as same, (select count(*) = 0 from (from a except from b union all (from b except from a))) as other,
 (select min(x) from a) < (select min(x) from b) as less, (select count(*) = 0 from a) as none, (select count(*) = 0 from (from a intersect (select x + 10000000 from b))) as apart from (select * from a where x is null)""")
def set_equal(spark, sf_dir):
    scratch = Scratch(spark, "sets")
    a, b = (scratch.keep(x) for x in t.order_sets(spark, sf_dir))
    split = scratch.keep(sets.concatenation(sets.difference(a, b), sets.intersection(a, b)))
    apart = scratch.keep(sets.intersection(a, sets.offset(b, [10_000_000])))
    one = sets.equal(a, split).select(F.col("equal").alias("same")).crossJoin(sets.equal(a, b).select(F.col("equal").alias("other"))).crossJoin(sets.less(a, b))  # one row each
    return one.select("*", F.lit(sets.is_empty(a)).alias("none"), F.lit(sets.is_empty(apart)).alias("apart"))


@query("select o_orderkey - o_orderkey % 10 + i as x from orders, range(3) t(i) where o_orderkey % 10 = 0 and o_orderkey % 4 = 0 union select o_orderkey from orders where o_orderkey < 0")
def set_filter(spark, sf_dir):
    """Pieces [10 k : 10 k + 2] of which those that begin at a multiple of 4 stay."""
    k = F.col("o_orderkey")
    s = t.read(spark, sf_dir, "orders").where(k % 10 == 0).select(F.array(iv.interval(k, F.lit(1), k + 2)).alias("dims"))
    return _line(sets.filtered(s, F.col("dims")[0]["b"] % 4 == 0))


@query("select count(*) as pieces, 2 as arity, count(*) * 3 as card, min(s_suppkey) as min0, 0 as min1, max(s_suppkey) as max0, 6 as max1 from supplier")
def set_shape(spark, sf_dir):
    s = t.read(spark, sf_dir, "supplier").select(F.array(iv.interval(F.col("s_suppkey"), F.lit(1), F.col("s_suppkey")), iv.interval(F.lit(0), F.lit(3), F.lit(6))).alias("dims"))
    ends = sets.extremes(s).select(*[F.col(f"{c}_elem")[k].alias(f"{c}{k}") for c in ("min", "max") for k in range(2)])
    return s.agg(F.count(F.lit(1)).alias("pieces")).crossJoin(sets.cardinal(s)).crossJoin(ends).withColumn("arity", F.lit(sets.dimensions(s)))  # one row each


@query("""with p as (select s_suppkey as k, (select max(s_suppkey) from supplier) * 1009 + 2000000 as top from supplier) select k * 1000003 % 1999993 as x from p where k % 2 = 0 and k % 3 <> 0""")
def set_steps_of_any_size(spark, sf_dir):
    """Single points and pieces with prime steps, whose least common multiple is beyond 2**20."""
    k = F.col("s_suppkey")
    at = k * 1000003 % 1999993
    s = t.read(spark, sf_dir, "supplier")
    point = lambda d: d.select(F.array(iv.raw(at, F.lit(1), at)).alias("dims"))
    steps = spark.createDataFrame([([{"b": 2_000_000, "s": p, "e": 2_000_000 + 5 * p}],) for p in (1009, 1013, 1019, 1021)], f"dims {iv.DIMS}")
    a = sets.union(point(s.where(k % 2 == 0)), steps)
    return _line(sets.difference(sets.difference(a, point(s.where(k % 3 == 0))), steps)).where("x < 2000000")


@query(f"select x + 5 as x from {_A}")
def set_offset_compact(spark, sf_dir):
    return _line(sets.compacted(sets.offset(t.order_sets(spark, sf_dir)[0], [5])))


@query(f"select max(x) - count(*) + 1 as gaps from {_A} where x >= 0")
def set_complement(spark, sf_dir):
    a = t.order_sets(spark, sf_dir)[0]
    top = sets.extremes(a).first()["max_elem"][0]
    return sets.cardinal(sets.complement(a, 0, top)).select(F.col("card").alias("gaps"))


@query("""with s as (select s_suppkey as k from supplier), a as (select distinct x, y from s, range(12) u(i), range(8) v(j), lateral (select k * 2 + i * (1 + k % 2) as x, k % 7 + j as y) where i < 6),
 b as (select distinct k + i as x, k % 5 + 2 * j as y from s, range(9) u(i), range(3) v(j))
 select 'cap' as op, count(*) as n from (from a intersect from b) union all select 'cup', count(*) from (from a union from b) union all select 'diff', count(*) from (from a except from b)""")
def set_two_dimensional(spark, sf_dir):
    k, one = F.col("s_suppkey"), F.lit(1)
    s, scratch = t.read(spark, sf_dir, "supplier"), Scratch(spark, "grid")
    a = s.select(F.array(iv.interval(2 * k, 1 + k % 2, 2 * k + 5 * (1 + k % 2)), iv.interval(k % 7, one, k % 7 + 7)).alias("dims"))
    b = s.select(F.array(iv.interval(k, one, k + 8), iv.interval(k % 5, F.lit(2), k % 5 + 4)).alias("dims"))
    a, b = (scratch.keep(sets.disjoint(x)) for x in (a, b))
    out = [sets.cardinal(f(a, b)).select(F.lit(n).alias("op"), F.col("card").alias("n")) for n, f in (("cap", sets.intersection), ("cup", sets.union), ("diff", sets.difference))]
    return out[0].unionByName(out[1]).unionByName(out[2])


# linear expressions

_L = "with c as (select c_custkey as k, 1 + c_custkey % 4 as a, 1 + c_custkey % 3 as b, c_custkey % 11 - 5 as p, 1 + c_custkey % 2 as q from customer), "


def _expressions(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return t.read(spark, sf_dir, "customer").select("c_custkey", ln.lexp(ln.ratio(1 + k % 4, 1 + k % 3), ln.ratio(k % 11 - 5, 1 + k % 2)).alias("f"), ln.linear(k % 5 - 2, k % 3).alias("g"))


@query(_L + "r as (select k, a * (k % 5 - 2) as mn, b as md, a * (k % 3) * q + p * b as hn, b * q as hd from c) select k as c_custkey, mn // gcd(mn, md) as m_num, md // gcd(mn, md) as m_den, hn // gcd(hn, hd) as h_num, hd // gcd(hn, hd) as h_den from r")
def lexp_compose(spark, sf_dir):
    d = _expressions(spark, sf_dir).select("c_custkey", ln.lcompose(F.col("f"), F.col("g")).alias("r"))
    return d.select("c_custkey", F.col("r.m.num").alias("m_num"), F.col("r.m.den").alias("m_den"), F.col("r.h.num").alias("h_num"), F.col("r.h.den").alias("h_den"))


@query(_L + "r as (select k, b as mn, a as md, -p * b as hn, q * a as hd from c) select k as c_custkey, mn // gcd(mn, md) as m_num, md // gcd(mn, md) as m_den, hn // gcd(hn, hd) as h_num, hd // gcd(hn, hd) as h_den from r")
def lexp_inverse(spark, sf_dir):
    d = _expressions(spark, sf_dir).select("c_custkey", ln.linverse(F.col("f")).alias("r"))
    return d.select("c_custkey", F.col("r.m.num").alias("m_num"), F.col("r.m.den").alias("m_den"), F.col("r.h.num").alias("h_num"), F.col("r.h.den").alias("h_den"))


@query(_L + "r as (select k, a + (k % 5 - 2) * b as mn, b as md, a - (k % 5 - 2) * b as sn from c) select k as c_custkey, mn // gcd(mn, md) as sum_num, md // gcd(mn, md) as sum_den, sn // gcd(sn, md) as diff_num, md // gcd(sn, md) as diff_den from r")
def lexp_sum(spark, sf_dir):
    d = _expressions(spark, sf_dir).select("c_custkey", ln.ladd(F.col("f"), F.col("g")).alias("r"), ln.lsub(F.col("f"), F.col("g")).alias("s"))
    return d.select("c_custkey", F.col("r.m.num").alias("sum_num"), F.col("r.m.den").alias("sum_den"), F.col("s.m.num").alias("diff_num"), F.col("s.m.den").alias("diff_den"))


@query("""with c as (select c_custkey as k, c_custkey % 3 as m, c_custkey % 4 - 1 as h, c_custkey % 50 as b, 1 + c_custkey % 6 as s from customer), l as (select *, range(b, b + 31, s) as x from c)
 select k as c_custkey, m = 1 and h = 0 as is_id, m = 0 as is_constant, m = 2 and h = 1 as same, list_min(list_transform(x, lambda v: m * v + h))::bigint as low, list_max(list_transform(x, lambda v: m * v + h))::bigint as high, list_bool_and(list_transform(x, lambda v: (v + m) % 2 = 0)) as half_fits,
 case when m = 0 then h::varchar else case when m = 1 then 'x' else m::varchar || 'x' end || case when h > 0 then '+' || h::varchar when h < 0 then h::varchar else '' end end as spelled, len(list_distinct(list_transform(x, lambda v: m * v + h)))::bigint * 31 as box from l""")
def lexp_properties(spark, sf_dir):
    k = F.col("c_custkey")
    f, half = ln.linear(k % 3, k % 4 - 1), ln.lexp(ln.ratio(F.lit(1), F.lit(2)), ln.ratio(k % 3, F.lit(2)))
    i = iv.interval(k % 50, 1 + k % 6, k % 50 + 30)
    img, box = ln.image(f, i), ln.product_image(F.array(f, ln.identity()), F.array(i, iv.interval(F.lit(0), F.lit(1), F.lit(30))))
    return t.read(spark, sf_dir, "customer").select("c_custkey", ln.is_identity(f).alias("is_id"), ln.is_constant(f).alias("is_constant"), ln.lequal(f, ln.linear(2, 1)).alias("same"), img["b"].alias("low"), img["e"].alias("high"), ln.is_whole_on(half, i).alias("half_fits"), ln.rendered(f).alias("spelled"), iv.product_cardinal(box).alias("box"))


# maps by pieces

M = t.PART_MAPS


def _pieces(spark, sf_dir):
    return t.part_maps(spark, sf_dir)


@query(M + " select distinct y as x from f")
def map_image(spark, sf_dir):
    return _line(maps.image(_pieces(spark, sf_dir)[0]))


@query(M + " select x, y from f where x in (select x from g)")
def map_restrict(spark, sf_dir):
    f, g = _pieces(spark, sf_dir)
    return maps.expand(maps.restrict(f, maps.domain(g))).select("x", "y")


@query(M + " select x from f where y in (select x from g)")
def map_preimage(spark, sf_dir):
    f, g = _pieces(spark, sf_dir)
    return _line(maps.pre_image(f, maps.domain(g)))


@query(M + " select g.x, f.y from g join f on f.x = g.y")
def map_compose(spark, sf_dir):
    f, g = _pieces(spark, sf_dir)
    return maps.expand(maps.compose(f, g)).select("x", "y")


@query(M + " select x, y from f union all select x, y from g where x not in (select x from f)")
def map_combine(spark, sf_dir):
    f, g = _pieces(spark, sf_dir)
    return maps.expand(maps.combine(f, g)).select("x", "y")


@query(M + " select f.x, f.y + g.y as y from f join g using (x)")
def map_sum(spark, sf_dir):
    f, g = _pieces(spark, sf_dir)
    return maps.expand(maps.add(f, g)).select("x", "y")


@query(M + " select x + 3 as x, y + 4 as y from f")
def map_offset(spark, sf_dir):
    return maps.expand(maps.offset_image(maps.offset_domain(_pieces(spark, sf_dir)[0], [3]), [4])).select("x", "y")


@query("select p_partkey as x, case when p_partkey < 500 then least(500, (select count(*) from part)) else (p_partkey - 500) % 3 + 500 - 3 end as y from part")
def map_reduce(spark, sf_dir):
    n = t.read(spark, sf_dir, "part").count()
    one = spark.range(1).select(F.lit(0).alias("map_id"), F.array(iv.interval(F.lit(0), F.lit(1), F.lit(min(n, 500) - 1))).alias("dims"), F.array(ln.linear(1, 1)).alias("exp"))
    two = spark.range(1).select(F.lit(1).alias("map_id"), F.array(iv.interval(F.lit(500), F.lit(1), F.lit(n - 1))).alias("dims"), F.array(ln.linear(1, -3)).alias("exp"))
    return maps.expand(maps.reduce(one.unionByName(two) if n > 509 else one)).select("x", "y")


@query("select (1 + k % 2) * (k * 14 + 2 * i) + (1 - k % 2) * 14 * k as x, k * 14 + 2 * i as y from (select s_suppkey as k from supplier), range(7) t(i)")
def map_inverse(spark, sf_dir):
    """Of all suppliers' pieces, of slopes 1 and 2, whose images begin at 28 k and do not meet."""
    k = F.col("s_suppkey")
    dims, exp = F.array(iv.interval(k * 14, F.lit(2), k * 14 + 12)), F.array(ln.linear(1 + k % 2, (1 - k % 2) * 14 * k))
    g = t.read(spark, sf_dir, "supplier").select(F.lit(0).alias("map_id"), dims.alias("dims"), exp.alias("exp"))
    return maps.expand(maps.inverse(g)).select("x", "y")


@query(M + " select x, y from g")
def map_compact(spark, sf_dir):
    return maps.expand(maps.compact(_pieces(spark, sf_dir)[1])).select("x", "y")


@query("select o_orderkey as x, o_orderkey // 4 * 2 + 1 as y from orders")
def map_compress(spark, sf_dir):
    fn = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("x"), (F.expr("o_orderkey div 4") * 2 + 1).alias("y"))
    return maps.expand(maps.compress(fn)).select("x", "y")


@query(M + " select x, least(f.y, g.y) as y from f join g using (x)")
def map_min(spark, sf_dir):
    f, g = _pieces(spark, sf_dir)
    return maps.expand(maps.min_of(f, g)).select("x", "y")


@query(M + " select x, greatest(f.y - g.y, 0) as y from f join g using (x)")
def map_minus(spark, sf_dir):
    f, g = _pieces(spark, sf_dir)
    return maps.expand(maps.minus_of(f, g)).select("x", "y")


@query(M + " select x from f join g using (x) where f.y <= g.y")
def map_equal_image(spark, sf_dir):
    """Where a map agrees with the least of itself and another."""
    f, g = _pieces(spark, sf_dir)
    return _line(maps.equal_image_of(maps.min_of(f, g), f))


@query(M + ", u as (select x, x as y from f union all (select x, y from g where x not in (select x from f))) select (select count(*) from u) as size, (select min(x) from f) as low, (select max(x) from f) as high, (select bool_and(y = x) from f) as f_is_id, (select count(*) = (select count(*) from f) from f join f f2 using (x, y)) as same, (select count(*) = (select count(*) from f) and count(*) = (select count(*) from g) from f join g using (x, y)) as other, 1 as arity, (select count(*) from supplier) as pieces, false as empty")
def map_shape(spark, sf_dir):
    scratch = Scratch(spark, "shape")
    f, g = (scratch.keep(x) for x in _pieces(spark, sf_dir))
    rest = scratch.keep(maps.restrict(g, sets.difference(maps.domain(g), maps.domain(f))))
    both = scratch.keep(maps.concatenation(maps.identity(maps.domain(f)), rest.select("map_id", "dims", "exp")))
    ends = sets.extremes(maps.domain(f))
    same = [maps.equal_pieces(f, x).select(F.col("equal").alias(n)) for n, x in (("same", maps.compact(f)), ("other", g))]
    out = sets.cardinal(maps.domain(both)).select(F.col("card").alias("size")).crossJoin(ends)  # one row each
    out = out.crossJoin(f.agg(F.every(ln.is_identity(F.col("exp")[0])).alias("f_is_id"), F.count(F.lit(1)).alias("pieces"))).crossJoin(same[0]).crossJoin(same[1])
    return out.select("size", F.col("min_elem")[0].alias("low"), F.col("max_elem")[0].alias("high"), "f_is_id", "pieces", "same", "other", F.lit(maps.arity(f)).alias("arity"), F.lit(sets.is_empty(maps.domain(f))).alias("empty"))


@query(M + " select x, y from f where x // 10 % 3 = 1")
def map_filter(spark, sf_dir):
    return maps.expand(maps.filter_maps(_pieces(spark, sf_dir)[0], F.col("exp")[0]["m"]["num"] == 1)).select("x", "y")


@query(M + " select 2 * x + 1 as x, y from f")
def map_offset_domain_by(spark, sf_dir):
    """The expressions of f at the places that 2 x + 1 sends its domain to, where x is the old place."""
    f = _pieces(spark, sf_dir)[0]
    moved = maps.offset_domain_by(f, f.select("map_id", "dims", F.array(ln.linear(2, 1)).alias("exp")))
    # an expression stays as it is: at 2 x + 1 it gives m (2 x + 1) + h; brought back for the comparison
    back = ln.lcompose(F.col("exp")[0], ln.lexp(ln.ratio(F.lit(1), F.lit(2)), ln.ratio(F.lit(-1), F.lit(2))))
    return maps.expand(moved.withColumn("exp", F.array(back))).select("x", "y")


@query(M + " select x, y + 2 * x + 5 as y from f")
def map_offset_image_by(spark, sf_dir):
    return maps.expand(maps.offset_image_by(_pieces(spark, sf_dir)[0], F.array(ln.linear(2, 5)))).select("x", "y")


@query("with p as (select s_suppkey as k from supplier) select k, 1000000000 * k + 400000000 + k as at, case when k % 2 = 0 then 1 else 3 end as m, (400000000 + k) // 1 + 1 as n_low from p")
def map_min_of_long_pieces(spark, sf_dir):
    """Pieces of 10**9 elements, cut where the two lines cross: costs follow pieces."""
    k = F.col("s_suppkey")
    s = t.read(spark, sf_dir, "supplier").select(k.alias("k"))
    dims = F.array(iv.interval(1000000000 * F.col("k"), F.lit(1), 1000000000 * F.col("k") + 999999999))
    m = F.when(F.col("k") % 2 == 0, F.lit(1)).otherwise(F.lit(3))
    at = 1000000000 * F.col("k") + 400000000 + F.col("k")
    f = s.select(F.lit(0).alias("map_id"), dims.alias("dims"), F.array(ln.linear(m, F.lit(0))).alias("exp"))
    g = s.select(F.lit(0).alias("map_id"), dims.alias("dims"), F.array(ln.linear(m - 1, at)).alias("exp"))
    got = maps.min_of(f, g).where(F.col("dims")[0]["b"] % 1000000000 == 0)
    i = F.col("dims")[0]
    return got.select(F.expr("dims[0].b div 1000000000").alias("k"), i["e"].alias("at"), F.col("exp")[0]["m"]["num"].cast("int").alias("m"), iv.cardinal(i).alias("n_low"))


@query(M + " select y as x, min(x) as y from f group by 1")
def map_first_inverse(spark, sf_dir):
    return maps.expand(maps.first_inverse_of(_pieces(spark, sf_dir)[0])).select("x", "y")


@query(M + " select f.y as x, min(g.y) as y from f join g using (x) group by 1")
def map_min_adjacent(spark, sf_dir):
    return maps.expand(maps.min_adjacent_of(*_pieces(spark, sf_dir))).select("x", "y")


@query("with p as (select s_suppkey as k, s_suppkey % 2 = 1 and s_suppkey - 1 in (select s_suppkey from supplier) as half, s_suppkey % 2 = 1 as odd from supplier) select k, 1000000000 * k - case when odd and not half then 500000000 else 0 end as first, cast(case when half then 500000000 else 1000000000 end as bigint) as n from p")
def map_first_inverse_of_long_pieces(spark, sf_dir):
    """Odd pieces of 10**9 elements are moved half onto the one before, which has the lesser elements."""
    k, wide = F.col("s_suppkey").cast("bigint"), 1000000000
    dims = F.array(iv.interval(wide * k, F.lit(1), wide * k + wide - 1))
    by = F.when(k % 2 == 0, F.lit(0)).otherwise(F.lit(-wide // 2)).cast("bigint")
    f = t.read(spark, sf_dir, "supplier").select(F.lit(0).alias("map_id"), dims.alias("dims"), F.array(ln.linear(F.lit(1), by)).alias("exp"))
    i, back = F.col("dims")[0], F.col("exp")[0]["h"]["num"]
    got = maps.first_inverse_of(f).select(iv.div(i["b"] + back, F.lit(wide)).alias("k"), i["b"].alias("b"), iv.cardinal(i).alias("n"))
    return got.groupBy("k").agg(F.min("b").alias("first"), F.sum("n").alias("n"))


# maps by pieces in two dimensions

G2 = t.GRID_MAPS


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), F.col("y")[0].alias("y0"), F.col("y")[1].alias("y1"))


@query(G2 + " select x0, x1, case when f.y0 <= g.y0 and f.y1 <= g.y1 then f.y0 else g.y0 end as y0, case when f.y0 <= g.y0 and f.y1 <= g.y1 then f.y1 else g.y1 end as y1 from f join g using (x0, x1)")
def pw_min_map_2d(spark, sf_dir):
    return _flat(maps.expand(maps.min_of(*t.grid_maps(spark, sf_dir)), 2))


@query(G2 + " select x0, x1, greatest(f.y0 - g.y0, 0) as y0, greatest(f.y1 - g.y1, 0) as y1 from f join g using (x0, x1)")
def pw_minus_2d(spark, sf_dir):
    return _flat(maps.expand(maps.minus_of(*t.grid_maps(spark, sf_dir)), 2))


@query(G2 + ", m as (select f.y0 as x0, f.y1 as x1, min((g.y0, g.y1)) as y from f join g using (x0, x1) group by 1, 2) select x0, x1, y[1] as y0, y[2] as y1 from (select x0, x1, [struct_extract(y, 1), struct_extract(y, 2)] as y from m)")
def pw_min_adj_2d(spark, sf_dir):
    return _flat(maps.min_adjacent(*(maps.expand(x, 2) for x in t.grid_maps(spark, sf_dir))))


@query(G2 + " select x0, x1 from f join g using (x0, x1) where f.y0 <= g.y0 and f.y1 <= g.y1")
def pw_equal_image_2d(spark, sf_dir):
    """Where a map agrees with the least of itself and another."""
    f, g = t.grid_maps(spark, sf_dir)
    return sets.expand(maps.equal_image_of(maps.min_of(f, g), f)).select(F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))


@query(G2 + " select (select count(*) = (select count(*) from f) from f join f f2 using (x0, x1, y0, y1)) as same, (select count(*) = greatest((select count(*) from f), (select count(*) from g)) from f join g using (x0, x1, y0, y1)) as other")
def pw_equal_2d(spark, sf_dir):
    scratch = Scratch(spark, "equal")
    f, g = (scratch.keep(x) for x in t.grid_maps(spark, sf_dir))
    again = scratch.keep(maps.compress(maps.expand(f, 2)))
    return maps.equal_pieces(f, again).select(F.col("equal").alias("same")).crossJoin(maps.equal_pieces(f, g).select(F.col("equal").alias("other")))  # one row each


@query(G2 + ", h as (select y0, y1, min((map_id, x0, x1)) as b from f group by 1, 2) select y0 as x0, y1 as x1, struct_extract(b, 2) as y0, struct_extract(b, 3) as y1 from h")
def pw_first_inv_2d(spark, sf_dir):
    return _flat(maps.first_inverse(maps.expand(t.grid_maps(spark, sf_dir)[0], 2)))


@query("select x as x0, y as x1, x % 3 as y0, y % 2 as y1 from (select s_suppkey as x from supplier), range(6) t(y)")
def pw_map_inf_2d(spark, sf_dir):
    s = t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("b"))
    down = lambda c, n: F.when(F.col(c) < n, F.col(c)).otherwise(F.col(c) - n)
    return _flat(maps.map_infinite(s.select(F.array("a", "b").alias("x"), F.array(down("a", 3), down("b", 2)).alias("y"))))


# maps by elements

_F, _G = "(select o_orderkey as x, o_custkey as y from orders)", "(select l_orderkey as x, min(l_partkey) as y from lineitem group by 1)"
_FG = f"with f as {_F}, g as {_G} "


@query(_FG + "select x, least(f.y, g.y) as y from f join g using (x)")
def pw_min_map(spark, sf_dir):
    return maps.min_map(*t.order_maps(spark, sf_dir))


@query(_FG + "select x, f.y + g.y as y from f join g using (x)")
def pw_plus(spark, sf_dir):
    return maps.plus(*t.order_maps(spark, sf_dir))


@query(_FG + "select x, greatest(f.y - g.y, 0) as y from f join g using (x)")
def pw_minus(spark, sf_dir):
    return maps.minus(*t.order_maps(spark, sf_dir))


@query(_FG + "select f.y as x, min(g.y) as y from f join g using (x) group by 1")
def pw_min_adj(spark, sf_dir):
    return maps.min_adjacent(*t.order_maps(spark, sf_dir))


@query(_FG + "select x from f join g using (x, y)")
def pw_equal_image(spark, sf_dir):
    return maps.equal_image(*t.order_maps(spark, sf_dir))


@query(_FG + "select x from f where y in (select y from f group by y having count(*) > 1)")
def pw_shared_image(spark, sf_dir):
    return maps.shared_image(t.order_maps(spark, sf_dir)[0])


@query(f"select y as x, min(x) as y from {_F} group by 1")
def pw_first_inv(spark, sf_dir):
    return maps.first_inverse(t.order_maps(spark, sf_dir)[0])


@query("with f as (select o_orderkey as x, o_custkey % 50 as y, o_orderkey % 3 as map_id from orders where o_orderkey % 2 = 0) select y as x, struct_extract(min((map_id, x)), 2) as y from f group by f.y")
def pw_first_inv_in_order(spark, sf_dir):
    """Of the first map, by map_id, that has an image, the least element among those that are allowed."""
    o = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("x"), (F.col("o_custkey") % 50).alias("y"), (F.col("o_orderkey") % 3).alias("map_id"))
    return maps.first_inverse(o, o.where("x % 2 = 0").select("x"))


@query(_FG + "select x, y from g union all select x, y from f where x not in (select x from g)")
def pw_combine(spark, sf_dir):
    f, g = t.order_maps(spark, sf_dir)
    return maps.combine_elements(g, f)


@query(_FG + "select g.x, f.y from g join f on f.x = g.y")
def pw_compose(spark, sf_dir):
    return maps.compose_elements(*t.order_maps(spark, sf_dir))


@query("select p_partkey as x, p_partkey % 8 as y from part")
def pw_map_inf(spark, sf_dir):
    f = t.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("x"), F.expr("case when p_partkey < 8 then p_partkey else p_partkey - 8 end").alias("y"))
    return maps.map_infinite(f)


# graphs


@query("select count(*) * 3 as vertices, (select count(*) from supplier) * 3 as edges from (select s_suppkey from supplier union all select n_nationkey from nation)")
def graph_copy(spark, sf_dir):
    g = t.nation_graph(spark, sf_dir).copy(3)
    return g.vertices.agg(F.countDistinct("id").alias("vertices")).crossJoin(g.edges.agg(F.countDistinct("id").alias("edges")))  # one row each


@query("select s_suppkey as src, s_nationkey::bigint + 1000000 as dst from supplier where s_suppkey % 3 > 0")
def graph_erase(spark, sf_dir):
    g = t.nation_graph(spark, sf_dir)
    return g.erase_vertices(g.vertices.where("id < 1000000 and id % 3 = 0")).edges.select("src", "dst")


@query("select s_suppkey as id, 1::bigint as sv from supplier union all select n_nationkey::bigint + 1000000, 1 from nation union all select r_regionkey::bigint + 2000000, 2 from region")
def graph_add_set_vertex(spark, sf_dir):
    more = t.read(spark, sf_dir, "region").select((F.col("r_regionkey").cast("bigint") + 2_000_000).alias("id"))
    return t.nation_graph(spark, sf_dir).add_set_vertex(more).vertices


@query("select s_suppkey as src, s_nationkey::bigint + 1000000 as dst, 1::bigint as se from supplier union all select s_suppkey, (s_suppkey + 1) % (select count(*) from supplier), 2 from supplier")
def graph_add_set_edge(spark, sf_dir):
    g = t.nation_graph(spark, sf_dir)
    s = t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return g.add_set_edge(s.select((F.col("k") + 5_000_000).alias("id"), F.col("k").alias("src"), ((F.col("k") + 1) % s.count()).alias("dst"))).edges.select("src", "dst", "se")


@query("""with n as (select count(*) as n from supplier), e as (select s_suppkey as src, (7 * s_suppkey + 3) % n as dst, s_suppkey % 4 as se from supplier, n), o as (select src as id, list_sort(list(distinct se)) as o from e group by 1), i as (select dst as id, list_sort(list(distinct se)) as i from e group by 1)
 select s_suppkey as id, min(s_suppkey) over (partition by o, i) as part from supplier left join o on o.id = s_suppkey left join i on i.id = s_suppkey""")
def graph_partition(spark, sf_dir):
    s = t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    e = s.select(F.col("k").alias("id"), F.col("k").alias("src"), ((7 * F.col("k") + 3) % s.count()).alias("dst"), (F.col("k") % 4).alias("se"))
    return alg.partitioned(graph(s.select(F.col("k").alias("id")), e, True)).vertices.select("id", F.col("sv").alias("part"))


@query("with m as (select s_nationkey as n, min(s_suppkey) as rep from supplier group by 1) select s_suppkey as id, rep from supplier join m on n = s_nationkey union all select n_nationkey::bigint + 1000000, coalesce(rep, n_nationkey + 1000000) from nation left join m on n = n_nationkey")
def connected_components(spark, sf_dir):
    return alg.connected_components(t.nation_graph(spark, sf_dir))


_R = "with recursive " + t.SUPPLIER_EDGES + ", r as (select s_suppkey as a, s_suppkey as b from supplier union select r.a, e.dst from r join e on e.src = r.b), c as (select x.a as id, min(x.b) as rep from r x join r y on x.a = y.b and x.b = y.a group by 1) "


@query(_R + "select id, rep from c")
def strong_components(spark, sf_dir):
    return alg.strong_components(t.supplier_graph(spark, sf_dir))


#: Rings of eight suppliers, whose first vertex has an arc to the next ring.
_RINGS = """with recursive e as (select s_suppkey as src, case when s_suppkey % 8 = 7 then s_suppkey - 7 else s_suppkey + 1 end as dst from supplier where s_suppkey // 8 < (select count(*) // 8 from supplier)
 union all select s_suppkey, s_suppkey + 8 from supplier where s_suppkey % 8 = 0 and s_suppkey // 8 + 1 < (select count(*) // 8 from supplier)) """


def _rings(spark, sf_dir):
    s = t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    n, k = s.count() // 8, F.col("k")
    ring = s.where(F.expr(f"k div 8 < {n}")).select(k.alias("src"), F.when(k % 8 == 7, k - 7).otherwise(k + 1).alias("dst"))
    e = ring.unionByName(s.where((k % 8 == 0) & F.expr(f"k div 8 + 1 < {n}")).select(k.alias("src"), (k + 8).alias("dst")))
    return graph(s.select(k.alias("id")), e.select(F.struct("src", "dst").alias("id"), "src", "dst"), True)


@query(_RINGS + "select distinct src - src % 8 as src, dst - dst % 8 as dst from e where src // 8 <> dst // 8")
def condensation(spark, sf_dir):
    g = _rings(spark, sf_dir)
    return alg.condensation(g, alg.strong_components(g)).edges.select("src", "dst")


@query("with l as (select p_partkey as id, case when p_partkey = 0 then 0 else length(bin(p_partkey)) end as lv from part) select id, coalesce(lag(id) over (order by lv, id), id) as pred, row_number() over (order by lv, id) - 1 as place from l")
def topological_sort(spark, sf_dir):
    return alg.topological_sort(t.part_tree(spark, sf_dir))


@query("select count(*) as size, true as fully_matched from supplier")
def matching(spark, sf_dir):
    m, full = alg.matching(t.equation_graph(spark, sf_dir))
    return m.agg(F.count(F.lit(1)).alias("size"), F.lit(full).alias("fully_matched"))


@query("select s_suppkey as src, s_suppkey + 1000000 as dst from supplier")
def matching_of_a_path(spark, sf_dir):
    """Right vertex k reaches left k and left k - 1: only one matching is largest, each with its own."""
    s = t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    e = s.select((2 * F.col("k")).alias("id"), F.col("k").alias("src"), (F.col("k") + 1_000_000).alias("dst"))
    e = e.unionByName(s.where("k > 0").select((2 * F.col("k") + 1).alias("id"), (F.col("k") - 1).alias("src"), (F.col("k") + 1_000_000).alias("dst")))
    v = s.select(F.col("k").alias("id")).unionByName(s.select((F.col("k") + 1_000_000).alias("id")))
    return alg.matching(graph(v, e))[0].select("src", "dst")


def _blocks(spark, sf_dir):
    """Equations k, an unknown each, in chains of eight, which can be matched in one way only."""
    s = t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    k, left = F.col("k"), F.col("k") + 1_000_000
    own = s.select((3 * k).alias("id"), left.alias("src"), k.alias("dst"))
    # within eights an equation also needs the unknown before its own, so components are single and sorting is forced
    chain = s.where("k % 8 > 0").select((3 * k + 1).alias("id"), (left - 1).alias("src"), k.alias("dst"))
    return graph(s.select(k.alias("id")).unionByName(s.select(left.alias("id"))), own.unionByName(chain))


@query("select 3 * s_suppkey as id, 3 * s_suppkey as rep from supplier")
def match_scc(spark, sf_dir):
    """The only largest matching pairs k with its own unknown, which leaves chains: each matched edge is a component."""
    return alg.match_strong(_blocks(spark, sf_dir)).select("id", "rep")


@query("with l as (select 3 * s_suppkey as id, least(s_suppkey // 8 * 8 + 7, (select max(s_suppkey) from supplier)) - s_suppkey as lv from supplier) select id, coalesce(lag(id) over (order by lv, id), id) as pred, row_number() over (order by lv, id) - 1 as place from l")
def match_scc_sort(spark, sf_dir):
    """Chains are sorted from their ends, which have no arc out."""
    return alg.match_strong_sort(_blocks(spark, sf_dir))["sort"].select("id", "pred", "place")


@query(_RINGS + ", c as (select 8 * i as id from range((select count(*) // 8 from supplier)) t(i)), l as (select src, dst from e where src not in (select id from c) and dst not in (select id from c)), r as (select src as a, dst as b from l union select r.a, l.dst from r join l on l.src = r.b) select id, (select count(*) from r where a = b) as cycles from c")
def cut_set(spark, sf_dir):
    """Of each ring the vertex with the arcs to other rings has the highest degree; without it no cycle is left."""
    g = _rings(spark, sf_dir)
    gone = Scratch(spark, "cut").keep(alg.cut_set(g))
    rep = alg.strong_components(g.erase_vertices(gone)).agg(F.sum((F.col("id") != F.col("rep")).cast("long")).alias("cycles"))
    return gone.crossJoin(rep).select("id", "cycles")  # one row


@query("""select '{"matching":[{"interval":[[0,1,' || (count(*) - 1)::varchar || ']]}],"scc":[{"dom":[[0,1,' || (count(*) - 1)::varchar || ']],"exp":[["0","0"]]}],"sort":[{"dom":[[1,1,' || (count(*) - 1)::varchar || ']],"exp":[["1","-1"]]}]}' as json from supplier""")
def json_sink(spark, sf_dir):
    s = t.read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    scc = maps.compress(s.select(k.alias("x"), F.lit(0).cast("bigint").alias("y")))
    sort = maps.compress(s.where(k > 0).select(k.alias("x"), (k - 1).alias("y")))
    return t.as_json(sets.of_keys(s, "s_suppkey"), scc, sort)


# the language


def _program(spark, text: str) -> DataFrame:
    rows = [(i, e, rendered(v)) for i, (e, v, _) in enumerate(Evaluator(spark).steps(text))]
    return spark.createDataFrame(rows, "n int, expression string, value string").select("n", "value")


@query("""select * from (values (0, (2 + 3)::varchar), (1, (2 ** 10)::int::varchar), (2, '-' || (5 - 3)::varchar), (3, ((1 < 2)::int)::varchar), (4, '5/6'), (5, (select count(*)::varchar from range(1, 101, 7))), (6, (select max(x)::varchar from range(1, 101, 7) t(x))), (7, '1'), (8, '0'),
 (9, '4x-1|x+7'), (10, 'x/2-1/2|x-4'), (11, '1'), (12, '6'), (13, '(1, 2)')) v(n, value)""")
def language_scalars(spark, sf_dir):
    return _program(spark, """two = 2; pair = (1, two)
        two + 3; two ^ 10; -(5 - 3); 1 < two; r(1, 2) + r(1, 3); #[1:7:100]; maxElem([1:7:100]); isEmpty([5:1:4]); isMember(3, [2:2:8]);
        compose(2*x+1 | 1*x+3, 2*x-1 | 1*x+4); inv(2*x+1 | 1*x+4); (1*x+0 | 1*x+1) == (1*x+0 | 1*x+1); minElem({[8:1:9] [6:3:30]}); pair""")


@query("""with a as (select x, y from range(0, 12, 2) s(x), range(3, 9) t(y)), b as (select x, y from range(0, 12, 3) s(x), range(1, 6) t(y)) select * from (values (0, (select count(*)::varchar from (from a intersect from b))), (1, (select count(*)::varchar from (from a union from b))), (2, (select count(*)::varchar from (from a except from b))),
 (3, (select count(distinct (2 * x + 1, y))::varchar from a)), (4, (select count(*)::varchar from a where x + 1 <= 5 and y <= 6)), (5, (select '(' || max(x) || ', ' || max(y) || ')' from a)), (6, '1'), (7, '1'), (8, '0')) v(n, value)""")
def language_sets(spark, sf_dir):
    return _program(spark, r"""a = {[0:2:10]x[3:1:8]}; b = {[0:3:9]x[1:1:5]}; f = <<a -> 2*x+1 | 1*x+0>>
        #(a /\ b); #(a \/ b); #(a \ b); #image(f); #preImage({[0:1:5]x[0:1:6]}, <<a -> 1*x+1 | 1*x+0>>); maxElem(a); dom(f) == a; (a \ b) != a; (a \/ b) == b""")


@query("""with f as (select x, y, x + 2 as u, 9 - y as v from range(0, 6) s(x), range(0, 8) t(y)), g as (select x, y, 2 * x as u, y as v from range(2, 9) s(x), range(1, 9) t(y)), fg as (select x, y, f.u as fu, f.v as fv, g.u as gu, g.v as gv from f join g using (x, y)), w as (select x, y, case when fu <= gu and fv <= gv then fu else gu end as u, case when fu <= gu and fv <= gv then fv else gv end as v from fg)
 select * from (values (0, (select count(*)::varchar from w)), (1, (select count(*)::varchar from (select distinct fu, fv from fg))), (2, '1'), (3, (select count(*)::varchar from (select x, y from f union select x, y from g))), (4, '0'), (5, (select count(distinct (u, v))::varchar from w))) t(n, value)""")
def language_maps(spark, sf_dir):
    return _program(spark, """f = <<{[0:1:5]x[0:1:7]} -> 1*x+2 | 9-1*x>>; g = <<{[2:1:8]x[1:1:8]} -> 2*x+0 | 1*x+0>>
        #dom(minMap(f, g)); #dom(minAdj(f, g)); firstInv(firstInv(f)) == f; #dom(combine(f, g)); f == g; #image(minMap(f, g))""")


@query("""select x as x0, y as x1, case when x < 4 then 0 else x end as y0, y as y1 from range(0, 6) s(x), range(0, 3) t(y)""")
def language_graph_2d(spark, sf_dir):
    """Rows of a grid: in each the first four vertices form a ring."""
    v = Evaluator(spark).run("""scc(V %= {[0:1:5]x[0:1:2]}; Vmap %= <<{[0:1:5]x[0:1:2]} -> 0*x+1 | 0*x+1>>;
        mapB %= <<{[0:1:2]x[0:1:2]} -> 1*x+0 | 1*x+0, {[3:1:3]x[0:1:2]} -> 0*x+3 | 1*x+0, {[4:1:4]x[0:1:2]} -> 0*x+3 | 1*x+0>>;
        mapD %= <<{[0:1:2]x[0:1:2]} -> 1*x+1 | 1*x+0, {[3:1:3]x[0:1:2]} -> 0*x+0 | 1*x+0, {[4:1:4]x[0:1:2]} -> 0*x+4 | 1*x+0>>; Emap %= <<{[0:1:4]x[0:1:2]} -> 0*x+1 | 0*x+1>>)""")[0]
    return _flat(maps.expand(v.df, 2))
