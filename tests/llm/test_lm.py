import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stridegraph.llm import lm
from stridegraph.llm.common import Scratch
from stridegraph.llm.merge_tree import Tree, in_blocks


def plain_counts(tokens, docs):
    out = [Counter(), Counter(), Counter()]
    for d in docs:
        w = tokens[d]
        out[0].update(w)
        out[1].update(zip(["<s>", *w], w))
        out[2].update(zip(["<s>", "<s>", *w], ["<s>", *w], w))
    return out


def estimates(counts, w):
    """Of each token: shares by three, two and one words, and how often the two contexts were seen."""
    n, docs = sum(counts[0].values()), counts[0][None]
    for a, b, c in zip(["<s>", "<s>", *w], ["<s>", *w], w):
        two = docs if b == "<s>" else counts[0][b]
        three = docs if b == "<s>" else counts[1][a, b]
        yield (counts[2][a, b, c] / three if three else 0.0, counts[1][b, c] / two if two else 0.0, counts[0][c] / n, three, two)


def bucket(c):
    return min(lm.CONTEXTS - 1, int(math.log2(c + 1)))


def bins(*f):
    return lm.bins(np.array(f)).tolist()


@pytest.mark.parametrize("rows,tree", [(lm.BLOCK, None), (13, (3, 4))])
def test_scores_match_a_plain_model(spark, sf_dir, rows, tree):
    """In one level of merges, and in three of a small radix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "unseenword ÀÉ")], "doc_id long, text string"))
    docs = docs.withColumns({c: docs.doc_id for c in ("block", "place", "kind", "child", "n")})
    read = [(r.doc_id, r.text or "") for r in docs.collect()]
    lower = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)) + [None] for d, t in read}
    train = [d for d in tokens if zlib.crc32(str(d).encode()) % 5 != 1]
    apart = {d for d in train if zlib.crc32(str(d).encode()) // 5 % lm.DELETED == 0}
    if tree:
        tree = Tree(17, 4, *tree)
        assert tree.levels > 2
    got = {r.doc_id: r for r in lm.scored(docs, rows, tree).collect()}
    assert got.keys() == tokens.keys()
    # the weights, from the same counts without the documents held out for them
    rest = plain_counts(tokens, [d for d in train if d not in apart])
    floor = 1 / (len(rest[0]) + 1)
    seen = Counter((bucket(c2), *bins(f2, f1)) for d in apart for _, f2, f1, _, c2 in estimates(rest, tokens[d]))
    two = lm.learned([(*k, x) for k, x in sorted(seen.items())], floor)
    by_two = lambda f2, f1, c2, u: two[bucket(c2)] @ [f2, f1, u]
    seen = Counter((bucket(c3), *bins(f3, by_two(f2, f1, c2, floor))) for d in apart for f3, f2, f1, c3, c2 in estimates(rest, tokens[d]) if c3)
    three = lm.learned([(*k, x) for k, x in sorted(seen.items())], None)
    counts = plain_counts(tokens, train)
    n, v = sum(counts[0].values()), len(counts[0])
    for d, w in tokens.items():
        r, total = got[d], 0.0
        base = sum(math.log10((counts[0][x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        for f3, f2, f1, c3, c2 in estimates(counts, w):
            p = by_two(f2, f1, c2, 1 / (v + 1))
            total += math.log10(three[bucket(c3)] @ [f3, p] if c3 else p)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[0][x] > 0 for x in w), n, d not in train)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base) and abs(r.score - total) < 1e-6 * max(1, -total)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_weights_are_those_of_greatest_likelihood():
    rng = np.random.default_rng(4)
    f = rng.random((400, 2)) ** 3
    n = rng.integers(1, 20, 400)
    i = lm.bins(f)
    w = lm.learned([(3, a, b, int(k)) for (a, b), k in zip(i.tolist(), n)], None, 2000)[3]
    m = 10 ** (lm._LOW + (i - 0.5) * lm._STEP)
    worth = lambda x: (n * np.log(x * m[:, 0] + (1 - x) * m[:, 1])).sum()
    assert abs(max(np.linspace(0.0005, 0.9995, 2000), key=worth) - w[0]) < 0.01


def test_blocks_are_cut_by_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(50)] + [(99, "y" * 90_000)], "doc_id long, text string")
    got = in_blocks(Scratch(spark, "t"), docs.coalesce(1), 100, 10_000).groupBy("block").sum("doc_id").count()
    assert 8 <= got <= 14


def test_no_rows(spark):
    assert lm.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0
