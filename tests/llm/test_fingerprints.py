import hashlib

import numpy as np

from stridegraph.llm import fingerprints as fp


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)


def test_documents_in_ranges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = fp.fingerprinted(docs).collect()
    check(rows, got)
    prints = {r.doc_id: r.fingerprint for r in got}
    by_text = {}
    for d, t in rows:
        assert by_text.setdefault(t, prints[d]) == prints[d]
    long = [r for r in got if r.n_chars > 2000]
    assert np.mean([r.near_edited for r in long]) > 0.35 and np.mean([r.near_next for r in long]) < 0.1


def test_nulls_ties_and_single_rows(spark):
    rows = [(5, "a b c"), (5, "a b d"), (None, "n"), (None, None), (3, ""), (2, "é" * 7), (1, "x " * 500)]
    check(rows, fp.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    one = fp.fingerprinted(spark.createDataFrame([(1, "a b c d e f " * 40, 7)], "doc_id long, text string, part int")).collect()
    assert one[0].near_next == 1.0
    assert fp.fingerprinted(spark.createDataFrame([(None, "q"), (None, "r")], "doc_id long, text string")).count() == 2
    assert fp.fingerprinted(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_rows_of_one_document_are_split(spark):
    rows = [(7, f"text {i % 40} of many") for i in range(200)] + [(None, f"none {i}") for i in range(50)] + [(i, "w " * i) for i in range(20, 60)]
    extra = ("part", "tail", "key", "mark", "at", "to", "size")
    docs = spark.createDataFrame([(d, t, *[t] * len(extra)) for d, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))
    whole, cut = (sorted(map(str, fp.fingerprinted(docs, size=n).collect())) for n in (10**6, 7))
    assert whole == cut and len(cut) == len(rows)
    parts = fp.ranges(docs.select(fp._key(docs.doc_id).alias("key"), fp.F.xxhash64("text").alias("mark")), 7)
    assert sum(k == ~7 for k in parts.keys.tolist()) > 10 and sum(k == 2**63 - 1 for k in parts.keys.tolist()) > 2


def test_containment_estimates_truth():
    memo, rng = fp.WordHashes(), np.random.default_rng(1)
    words = [str(x) for x in rng.integers(0, 10**9, 8000)]
    small, large = fp.sketch(" ".join(words[:800]), memo), fp.sketch(" ".join(words), memo)
    assert fp.containment(small, large) == 1.0
    half = fp.sketch(" ".join(words[:400] + [str(x) for x in rng.integers(0, 10**9, 400)]), memo)
    assert abs(fp.containment(half, large) - 0.5) < 0.12
    assert fp.from_text(fp.to_text(small)).tolist() == small.tolist()
