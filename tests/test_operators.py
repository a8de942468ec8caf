import itertools
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from stridegraph import queries
from stridegraph.functions import intervals as iv
from stridegraph.functions import linear as ln
from stridegraph.operators import maps, sets
from stridegraph.operators.graphs import graph
from stridegraph.plans import algorithms as alg


def elements(df):
    return sorted(tuple(r.x) for r in sets.expand(df).collect())


def test_intervals_match_sets(spark):
    rng = random.Random(2)
    rows = [tuple(v for _ in range(2) for v in (rng.randrange(60), rng.randrange(1, 13), rng.randrange(200))) for _ in range(400)]
    i, j = iv.interval(F.col("a"), F.col("b"), F.col("c")), iv.interval(F.col("d"), F.col("e"), F.col("f"))
    df = spark.createDataFrame(rows, "a long, b long, c long, d long, e long, f long")
    got = df.select(iv.elements(iv.intersection(i, j)), iv.cardinal(i), iv.is_member(F.lit(30), i), iv.max_elem(i), iv.elements(iv.compacted(i, j))).collect()
    for (a, b, c, d, e, f), r in zip(rows, got):
        x, y = set(range(a, c + 1, b)), set(range(d, f + 1, e))
        assert (sorted(x & y), len(x), 30 in x, max(x, default=None)) == tuple(r)[:4]
        assert r[4] is None or set(r[4]) == x | y


def test_linear_expressions_match_fractions(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(-9, 10), rng.randrange(1, 7), rng.randrange(-9, 10), rng.randrange(1, 7), rng.randrange(-5, 6), rng.randrange(50)) for _ in range(200)]
    f, g = ln.lexp(ln.ratio(F.col("a"), F.col("b")), ln.ratio(F.col("c"), F.col("d"))), ln.linear(F.col("e"), 3)
    got = spark.createDataFrame(rows, "a long, b long, c long, d long, e long, x long").select(ln.lcompose(f, g).alias("c"), ln.at(f, F.col("x")).alias("v"), ln.linverse(f).alias("i")).collect()
    for (a, b, c, d, e, x), r in zip(rows, got):
        m, h = Fraction(a, b), Fraction(c, d)
        assert (Fraction(r.c.m.num, r.c.m.den), Fraction(r.c.h.num, r.c.h.den)) == (m * e, m * 3 + h)
        assert r.v == (m * x + h if (m * x + h).denominator == 1 else None)
        assert r.i.m is None if m == 0 else Fraction(r.i.m.num, r.i.m.den) == 1 / m


@pytest.mark.parametrize("n,stretch", [(1, 100_000), (1, 3), (2, 100_000)])
def test_set_algebra_matches_sets(spark, n, stretch):
    rng = random.Random(n)
    some = lambda k: [[(b := rng.randrange(15), rng.choice([1, 1, 2, 3]), b + rng.randrange(15)) for _ in range(n)] for _ in range(k)]
    spell = lambda ps: {x for p in ps for x in itertools.product(*[range(b, e + 1, s) for b, s, e in p])}
    p, q = some(4), some(3)
    a, b, x, y = sets.pieces(spark, p), sets.pieces(spark, q), spell(p), spell(q)
    assert elements(sets.intersection(a, b)) == sorted(x & y)
    assert elements(sets.union(a, b, stretch)) == sorted(x | y)
    assert elements(sets.difference(a, b, stretch)) == sorted(x - y)
    assert sets.cardinal(a).first()[0] == len(x)
    assert sets.equal(a, sets.compacted(a)).first()[0] and sets.equal(a, b).first()[0] == (x == y)


def test_cells_are_cut_by_their_neighbours_only(spark):
    p = [[(10 * k, 1, 10 * k + 9), (k, 1, k + 300)] for k in range(60)]
    a, b = sets._cells(sets.pieces(spark, p), sets.pieces(spark, p[:1]), [1, 1])
    assert (a.count(), b.count()) == (60, 1)


def test_two_dimensional_algebra_over_all_suppliers(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    keys = [r[0] for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect()]
    a = {(2 * k + i * (1 + k % 2), k % 7 + j) for k in keys for i in range(6) for j in range(8)}
    b = {(k + i, k % 5 + 2 * j) for k in keys for i in range(9) for j in range(3)}
    assert len(keys) == 100
    assert dict(tuple(r) for r in queries.set_two_dimensional(spark, sf).collect()) == {"cap": len(a & b), "cup": len(a | b), "diff": len(a - b)}


def test_inverse_over_all_suppliers(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    keys = [r[0] for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect()]
    want = sorted(((1 + k % 2) * x + (1 - k % 2) * 14 * k, x) for k in keys for x in range(14 * k, 14 * k + 13, 2))
    assert len({y for y, _ in want}) == len(want) == 700
    assert sorted(tuple(r) for r in queries.map_inverse(spark, sf).collect()) == want


def test_empty_sets(spark):
    none, some = sets.pieces(spark, [(5, 1, 4)]), sets.pieces(spark, [(1, 2, 9)])
    assert sets.cardinal(none).first()[0] == 0 and elements(sets.union(none, some)) == [(1,), (3,), (5,), (7,), (9,)]
    assert sets.intersection(none, none).count() == 0 and sets.extremes(none).first()[0] is None


def test_minimum_adjacent_and_priority(spark):
    f = spark.createDataFrame([(1, 10, 0), (2, 10, 0), (3, 11, 1), (4, 11, 0)], "x long, y long, map_id int")
    g = spark.createDataFrame([(1, 5), (2, 4), (3, 9)], "x long, y long")
    assert {tuple(r) for r in maps.min_adjacent(f, g).collect()} == {(10, 4), (11, 9)}
    assert {tuple(r) for r in maps.first_inverse(f).collect()} == {(10, 1), (11, 4)}


def test_pieces_that_overlap_give_what_elements_give(spark):
    """Steps, falling lines, constants, ties and map order against the forms by elements."""
    rows = [(0, 0, 2, 40, 1, 3), (0, 1, 2, 41, -1, 60), (0, 50, 1, 70, 0, 9), (1, 80, 3, 110, 2, -150), (1, 111, 1, 130, 1, -100), (2, 140, 1, 150, 1, -130), (2, 160, 1, 160, 0, 9)]
    other = [(0, 5, 1, 62, 3, 0), (0, 63, 1, 120, -2, 400), (0, 121, 1, 170, 1, 0)]
    f, g = (
        spark.createDataFrame(r, "map_id int, b long, s long, e long, m long, h long").select("map_id", F.array(iv.interval(F.col("b"), F.col("s"), F.col("e"))).alias("dims"), F.array(ln.linear(F.col("m"), F.col("h"))).alias("exp"))
        for r in (rows, other)
    )
    allowed = sets.pieces(spark, [[(7, 1, 155)]])
    plain = lambda d: sorted(tuple(r) for r in d.select("x", "y").collect())
    e = maps.expand(f)
    assert plain(maps.expand(maps.first_inverse_of(f))) == plain(maps.first_inverse(e))
    assert plain(maps.expand(maps.first_inverse_of(f, allowed))) == plain(maps.first_inverse(e, e.where("x between 7 and 155")))
    assert plain(maps.expand(maps.min_adjacent_of(f, g))) == plain(maps.min_adjacent(e, maps.expand(g)))
    assert maps.first_inverse_of(f.limit(0)).count() == 0


def test_many_pieces_of_one_value(spark):
    """Those of one value are settled before pieces meet: no pair for each two of them."""
    n = 20000
    f = spark.range(n).select(F.lit(0).alias("map_id"), F.array(iv.interval(3 * F.col("id") + 5, F.lit(1), 3 * F.col("id") + 6)).alias("dims"), F.array(ln.linear(F.lit(0), F.lit(9))).alias("exp"))
    assert [(r.x, r.y) for r in maps.expand(maps.first_inverse_of(f)).collect()] == [(9, 5)]


def test_cycles_do_not_settle(spark):
    for n in (2, 3, 4):
        with pytest.raises(ValueError):
            maps.map_infinite(spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "x long, y long"))
    paths = spark.createDataFrame([(i, max(0, i - 1)) for i in range(9)], "x long, y long")
    assert {r.y for r in maps.map_infinite(paths).collect()} == {0}


def test_steps_beyond_the_old_bound(spark):
    steps = (1009, 1013, 1019, 1021)
    a, b = sets.pieces(spark, [(5, p, 5 + 9 * p) for p in steps]), sets.pieces(spark, [(0, 997, 9970)])
    x, y = {v for p in steps for v in range(5, 6 + 9 * p, p)}, set(range(0, 9971, 997))
    assert elements(sets.union(a, b)) == sorted((v,) for v in x | y) and elements(sets.difference(a, b)) == sorted((v,) for v in x - y)
    assert elements(sets.intersection(a, b)) == sorted((v,) for v in x & y)


def test_a_long_piece_does_not_meet_all_short_ones_in_one_bucket(spark):
    short = spark.range(2000).select(F.array(iv.interval(10 * F.col("id"), F.lit(1), 10 * F.col("id") + 3)).alias("dims"))
    long = sets.pieces(spark, [(0, 1, 10**9), (10**9 + 5, 1, 10**9 + 9)])
    assert sets.cardinal(sets.intersection(short, long)).first()[0] == 8000
    assert sets.overlapping(short, long.withColumnRenamed("dims", "other"), "dims", "other").count() == 2000


def scalar_graph(spark, n, edges, directed=True):
    v = spark.createDataFrame([(i,) for i in range(n)], "id long")
    return graph(v, spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "id long, src long, dst long"), directed)


def closure(n, edges):
    reach = [{i} for i in range(n)]
    for _ in range(n):
        for a, b in edges:
            reach[a] |= reach[b]
    return reach


def test_strong_components_sort_and_cut(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(16)]
    reach = closure(12, edges)
    g = scalar_graph(spark, 12, edges)
    want = {i: min(j for j in range(12) if j in reach[i] and i in reach[j]) for i in range(12)}
    rep = alg.strong_components(g)
    assert dict(tuple(r) for r in rep.collect()) == want
    placed = {r.id: r.place for r in alg.topological_sort(alg.condensation(g, rep)).collect()}
    assert all(placed[want[b]] < placed[want[a]] for a, b in edges if want[a] != want[b])
    gone = {r.id for r in alg.cut_set(g).collect()}
    left = [(a, b) for a, b in edges if a != b and not {a, b} & gone]
    reach = closure(12, left)
    assert all(not (j in reach[i] and i in reach[j]) for i in range(12) for j in range(i))
    with pytest.raises(ValueError):
        alg.topological_sort(scalar_graph(spark, 2, [(0, 1), (1, 0)]))


def test_matching_is_largest(spark):
    rng = random.Random(3)
    edges = sorted({(100 + rng.randrange(8), rng.randrange(8)) for _ in range(16)})
    near = defaultdict(list)
    for f, u in edges:
        near[u].append(f)
    owner = {}

    def place(u, seen):
        return any(f not in seen and (seen.add(f) or f not in owner or place(owner[f], seen)) and (owner.update({f: u}) or True) for f in near[u])

    size = sum(place(u, set()) for u in list(near))
    v = spark.createDataFrame([(i,) for i in range(108)], "id long")
    m, full = alg.matching(graph(v, spark.createDataFrame([(i, f, u) for i, (f, u) in enumerate(edges)], "id long, src long, dst long")))
    got = m.collect()
    assert len(got) == size == len({r.src for r in got}) == len({r.dst for r in got}) and full == (size == len(near))
