import itertools
import json
import random

import pytest

from stridegraph.language import run, run_file
from stridegraph.language.evaluate import Evaluator, MapValue, SetValue
from stridegraph.operators import maps, sets


def values(spark, text):
    """Sets as their elements, maps as dicts."""
    out = []
    for v in Evaluator(spark).run(text):
        if isinstance(v, SetValue):
            v = {r.x[0] if len(r.x) == 1 else tuple(r.x) for r in sets.expand(v.df).collect()} if v.df.count() else set()
        elif isinstance(v, MapValue):
            v = {r.x: r.y for r in maps.expand(v.df).collect()}
        out.append(v)
    return out


def test_scalars_and_lines(spark):
    got = run(spark, "M = 7 // a comment\n4+M; r(3,4); 6*9-4 /* more /* nested */ */; r(1,6)+r(1,3); r(2,5)-r(9,10); 3^4; (4*x+1)+(1*x+8); inv(5*x+3); compose(4*x+1, 2*x+9); false; M")
    assert got == ["11", "3/4", "50", "1/2", "-1/2", "81", "5x+9", "x/5-3/5", "8x+37", "0", "7"]


def test_intervals_and_sets(spark):
    got = values(spark, r"""#[2:4:31]; [3:5:60] /\ [1:4:50]; [2:4:40] /\ [1:4:41]; minElem([6:7:90]); maxElem([6:7:90]); isMember(20, [6:7:90]); [9:1:12] < [11:1:12];
    #{[0:4:40],[41:2:61]}; {[0:5:60],[2:5:62]} /\ {[10:1:24]}; {[20:3:80],[90:1:120]} \ {[0:2:50],[95:5:130]}""")
    want = set(range(20, 81, 3)) | set(range(90, 121))
    assert got == [len(range(2, 32, 4)), set(range(3, 61, 5)) & set(range(1, 51, 4)), set(), 6, 90, 1, 1, 11 + 11, {x for x in range(10, 25) if x % 5 in (0, 2)}, want - set(range(0, 51, 2)) - set(range(95, 131, 5))]


def test_maps(spark):
    got = values(spark, """image([5:4:41] -> 3*x+2); preImage({[6:1:8]}, {[10:1:20],[40:1:44]} -> 7); reduce(<<{[30:1:60]} -> 1*x-1>>); firstInv(<<{[4:1:9]} -> 25>>);
    combine(<<{[0:1:2]} -> 0*x+8>>, <<{[1:1:6]} -> 2*x+0>>); minAdj(<<{[3:1:7]} -> 0*x+5>>, <<{[4:2:8]} -> 3*x+1>>); <<{[0:1:9]} -> 1*x+6>> - <<{[2:1:12]} -> 3*x+0>>""")
    assert got == [{3 * x + 2 for x in range(5, 42, 4)}, set(range(10, 21)) | set(range(40, 45)), {x: 29 for x in range(30, 61)}, {25: 4}, {0: 8, 1: 8, 2: 8, 3: 6, 4: 8, 5: 10, 6: 12}, {5: 13}, {x: max(0, 6 - 2 * x) for x in range(2, 10)}]


def brute_map(pieces):
    out = {}
    for dims, exp in pieces:
        for x in itertools.product(*[range(b, e + 1, s) for b, s, e in dims]):
            out[x] = tuple(m * v + h for v, (m, h) in zip(x, exp))
    return out


def spelled(pieces):
    return "<<" + ", ".join("{" + "x".join(f"[{b}:{s}:{e}]" for b, s, e in dims) + "} -> " + " | ".join(f"{m}*x+{h}" for m, h in exp) for dims, exp in pieces) + ">>"


def elements(v, n):
    """A map as a dict of tuples."""
    one = (lambda x: (x,)) if n == 1 else tuple
    return {one(r.x): one(r.y) for r in maps.expand(v.df, n).collect()}


@pytest.mark.parametrize("n", [2, 3])
def test_maps_in_more_dimensions_match_dicts(spark, n):
    rng = random.Random(n)

    def some(k):
        return [([(30 * i + rng.randrange(4), rng.choice([1, 2]), 30 * i + 4 + rng.randrange(5 - n)), *[(rng.randrange(3), rng.choice([1, 1, 3]), 3 + rng.randrange(4 - n + 1)) for _ in range(n - 1)]], [(rng.randrange(3), 90 + rng.randrange(9)) for _ in range(n)]) for i in range(k)]

    p, q = some(3), some(2)
    f, g = brute_map(p), brute_map(q)
    both = f.keys() & g.keys()
    head = f"f = {spelled(p)}; g = {spelled(q)}; minMap(f, g); f - g"
    got = Evaluator(spark).run(head + ("; minAdj(f, g); firstInv(f); f == g" if n == 2 else ""))
    assert elements(got[0], n) == {x: f[x] if all(a <= b for a, b in zip(f[x], g[x])) else g[x] for x in both}
    assert elements(got[1], n) == {x: tuple(max(0, a - b) for a, b in zip(f[x], g[x])) for x in both}
    if n != 2:
        return
    near, first = {}, {}
    for x in sorted(both):
        near[f[x]] = min(near.get(f[x], g[x]), g[x])
    assert elements(got[2], n) == near
    for i, (dims, exp) in enumerate(p):
        for x, y in sorted(brute_map([(dims, exp)]).items()):
            first.setdefault(y, x)
    assert elements(got[3], n) == first and got[4] == 0


def test_lines_of_several_dimensions(spark):
    assert run(spark, "(2*x+1 | 1*x+0) + (1*x+1 | 3*x+2); compose(2*x+1 | 3*x+0, 1*x+4 | 1*x+5); inv(2*x+0 | 1*x+7); (1*x+0|1*x+0) == (1*x+0|2*x+0)") == ["3x+2|4x+2", "2x+9|3x+15", "x/2|x-7", "0"]


RING = "V %= {[1:1:6]}; Vmap %= <<{[1:1:6]} -> 0*x+1>>; mapB %= <<{[1:1:5]} -> 1*x+0, {[6:1:6]} -> 0*x+6>>; mapD %= <<{[1:1:5]} -> 1*x+1, {[6:1:6]} -> 0*x+1>>; Emap %= <<{[1:1:6]} -> 0*x+1>>"


def test_graphs(spark):
    assert values(spark, f"scc({RING})") == [{i: 1 for i in range(1, 7)}]
    with pytest.raises(ValueError):
        values(spark, f"sort({RING})")


def test_chain_writes_json_and_files_give_lines(spark, tmp_path):
    chain = "V %= {[1:1:8]}; Vmap %= <<{[1:1:8]} -> 0*x+1>>; map1 %= <<{[1:1:4]} -> 1*x+0, {[5:1:7]} -> 1*x-4>>; map2 %= <<{[1:1:4]} -> 1*x+4, {[5:1:7]} -> 1*x+1>>; Emap %= <<{[1:1:7]} -> 0*x+1>>"
    program = tmp_path / "program.txt"
    program.write_text(f"N = 4\n2*N; {{[1:1:N]}}\nmatchSCCTS({chain})")
    lines = run_file(spark, str(program), str(tmp_path / "out"))
    assert lines[:2] == ["2*N --> 8", "{[1:1:N]} --> {[1:4]}"] and lines[2].startswith("matchSCCTS(V %=")
    told = [x for f in (tmp_path / "out" / "json").glob("part-*") for x in f.read_text().splitlines()]
    got = json.loads(told[0])
    assert got["matching"] == [{"interval": [[1, 1, 4]]}] and got["scc"] == [{"dom": [[1, 1, 4]], "exp": [["1", "0"]]}]
    order = {x: int(m) * x + int(h) for p in got["sort"] for b, s, e in p["dom"] for m, h in p["exp"] for x in range(b, e + 1, s)}
    assert order in ({4: 4, 3: 4, 2: 3, 1: 2}, {1: 1, 2: 1, 3: 2, 4: 3})
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "out" / "log").glob("part-*")) == 3


def test_errors(spark):
    for text in ("1 +", "[1:2:3", "{[1:1:2]", "$"):
        with pytest.raises(SyntaxError):
            run(spark, text)
    with pytest.raises(NameError):
        run(spark, "y + 1")
