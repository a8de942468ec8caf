import re
from collections import Counter, defaultdict

from stridegraph.llm import mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            budget -= out[s]
        free -= over
    return out | {s: weight[s] * level for s in free}


def test_mix_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(None, None, "a", None, 1), (9001, "x y", None, None, 1), (9002, "é ü z" * 9, None, None, 1), (9003, "", "lone", None, 1)], docs.schema)
    docs = docs.select("doc_id", "text", "source").unionByName(extra.select("doc_id", "text", "source"))
    rows = mixing.mix(docs).collect()
    truth = {r.doc_id: (len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in docs.collect()}
    sizes = defaultdict(int)
    for n, s in truth.values():
        sizes[s] += n
    targets, taken = brute_targets(sizes), defaultdict(int)
    for r in rows:
        n, s = truth[r.doc_id]
        assert r.size == n and r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-6
        assert r.taken in (0, n, 2 * n)
        taken[s] += r.taken
    largest = max(n for n, _ in truth.values())
    assert all(abs(taken[s] - targets[s]) <= largest for s in sizes)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, rows))
    own = ("key", "size", "hash", "tie", "copies", "below", "below_tie", "n", "row", "target")
    again = mixing.repeated(docs.withColumns({c: docs.doc_id for c in own}))
    assert again.columns == ["doc_id", "text", "source", *own]
    again = again.collect()
    assert all(r[c] == r.doc_id for r in again for c in own)
    assert Counter(r.doc_id for r in again) == {r.doc_id: r.copies for r in rows if r.copies}
    assert sorted(map(str, mixing.mix(docs.withColumns({c: docs.doc_id for c in own})).collect())) == sorted(map(str, rows))


def test_a_source_of_copies_meets_its_target(spark):
    rows = [(1, "a b c", "x")] * 40 + [(2, "a b", "y")] * 90 + [(i, "w " * i, "z") for i in range(10, 40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s, n in (("x", 3), ("y", 2)):
        own = [r for r in got if r.size == n and r.doc_id == "_xy".index(s)]
        assert abs(sum(r.taken for r in own) - own[0].target) <= n and {r.taken for r in own} <= {0, n, 2 * n}


def test_larger_budgets_take_supersets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small, large = ({r.doc_id: r.copies for r in mixing.mix(docs, share=s).collect()} for s in (0.4, 0.9))
    assert all(large[k] >= v for k, v in small.items())


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == mixing.repeated(none).count() == 0
