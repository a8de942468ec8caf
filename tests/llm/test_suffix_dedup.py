import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from stridegraph.llm import suffix_dedup
from stridegraph.llm.merge_tree import Tree
from stridegraph.llm.suffix_array import common_prefixes, suffix_array


def brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        last = -1
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                for j in range(max(i, last), i + window):
                    gone[j] = True
                last = i + window
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(left).hexdigest()))
    return out


def test_suffix_arrays_match_sorting():
    rng = random.Random(1)
    for _ in range(200):
        n, letters = rng.randrange(0, 120), rng.choice([1, 2, 3, 10, 255])
        d = bytes(rng.randrange(1, letters + 1) for _ in range(n))
        d = d + d[: rng.randrange(0, n + 1)] if rng.random() < 0.5 else d
        want = sorted(range(len(d)), key=lambda i: d[i:])
        sa = suffix_array(np.frombuffer(d, np.uint8).astype(np.int64), 255)
        assert sa.tolist() == want
        lcp = [0] * len(d)
        for i in range(1, len(d)):
            a, b = d[want[i - 1] :], d[want[i] :]
            while lcp[i] < min(len(a), len(b)) and a[lcp[i]] == b[lcp[i]]:
                lcp[i] += 1
        assert common_prefixes(d, sa).tolist() == lcp


def made_up():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, line = text(12), text(5)
    rows = [None, "", "short", "a" * 300, "ab" * 100, "exact copy of a text that is long enough", "exact copy of a text that is long enough"]
    rows += [text(rng.randrange(0, 8)) + shared + text(rng.randrange(0, 8)) for _ in range(30)]
    rows += [text(20) + line + text(20) for _ in range(30)]
    rows += [text(200), shared + "x" + shared, "é" * 30]
    base = text(60)
    for i in range(20):
        k = rng.randrange(len(base))
        rows.append(base[:k] + "#" + base[k + 1 :])
    return rows


@pytest.mark.parametrize("hot,segment,shard,tree", [(10**6, 1 << 20, 1 << 20, None), (2, 97, 500, (3, 4))])
def test_removal_matches_brute_force(spark, hot, segment, shard, tree):
    rows = made_up()
    docs = spark.createDataFrame([(i, t, "b", "k", 7) for i, t in enumerate(rows)], "doc_id long, text string, block string, kind string, place int")
    more = {"rows": 9, "tree": Tree(17, 4, *tree)} if tree else {}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(docs, window=24, gram=9, hot=hot, segment=segment, shard=shard, **more).collect()}
    want = brute(rows, 24)
    assert [got[i] for i in range(len(rows))] == want
    assert 0 < sum(x[1] for x in want) < sum(x[0] for x in want)


def test_a_passage_with_more_edges_than_the_bound(spark):
    """Over 1024 contexts that differ at one anchor, with the production parameters; and just below, by suffix arrays."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(260)
    rows = [text(rng.randrange(80, 150)) + passage + text(rng.randrange(80, 150)) for _ in range(suffix_dedup.HOT + 300)]
    for part in (rows, rows[: suffix_dedup.HOT - 300]):
        docs = spark.createDataFrame(list(enumerate(part)), "doc_id long, text string").coalesce(1)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(docs, rows=400).collect()}
        assert [got[i] for i in range(len(part))] == brute(part, 200)


def test_contexts_of_equal_hash_are_told_apart_by_bytes():
    c = suffix_dedup.Contexts([b"a" * 30 + b"b" * 30 + b"a" * 30 + b"c" * 40], 24, 9)
    c.hash[:], c.anchor[:] = 1, 1
    lead, times, which, number = suffix_dedup._sent(c, np.ones(len(c.n), int))
    for i, k in zip(which, number):
        a, b = (c.data[c.place[x] : c.place[x] + c.n[x] + 23] for x in (i, lead[k]))
        assert a == b
    assert times.sum() == len(which) == len(c.n)


def test_removal_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(docs).collect()}
    assert [got[r.doc_id] for r in rows] == brute([r.text for r in rows], 200)


def test_no_rows_and_kept_bytes(spark):
    assert suffix_dedup.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = suffix_dedup.removed(spark.createDataFrame([(None, "x" * 500), (None, "y")], "doc_id long, text string"), with_bytes=True).collect()
    assert sorted(bytes(r.kept) for r in one) == [b"", b"y"]
