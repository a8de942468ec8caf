import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from stridegraph.llm import quality_rules as qr


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    cover = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_counts_match_and_junk_goes(spark, sf_dir):
    own = [(9001, None), (9002, ""), (9003, "a b c a b c a b"), (9004, "\n \nx\nx\n x\n"), (9005, "é ü 😀 " * 30), (9006, "w " * 3000), (9006, "w " * 3000), (9007, "#*$%&|<> x\x0by\x0cz")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame(own, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    docs = docs.select("doc_id", "text", "lang", "source").unionByName(more).withColumn("key", F.lit(1)).withColumn("n", F.lit(2))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = qr.judged(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [r.kept for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert np.mean(clean) > 0.95


def test_outliers_do_not_move_the_estimate(spark):
    rng = np.random.default_rng(2)
    cov = np.array([[0.04, 0.01, 0, 0], [0.01, 0.02, 0, 0], [0, 0, 0.01, 0.003], [0, 0, 0.003, 0.02]])
    x = np.concatenate([rng.multivariate_normal([1.6, 0.3, 0.2, 0.1], cov, 900), rng.normal(5, 0.1, (150, 4))])
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "key string, x0 double, x1 double, x2 double, x3 double")
    from stridegraph.llm.common import Scratch

    scratch = Scratch(spark, "t")
    r = qr.estimates(scratch, scratch.keep(rows)).collect()[0]
    mean = np.array([r[f"m{i}"] for i in range(4)])
    low = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    assert np.abs(mean - [1.6, 0.3, 0.2, 0.1]).max() < 0.03
    assert np.abs(low @ low.T - cov - np.diag(np.square(qr.FLOOR))).max() < 0.006
    inv = np.linalg.inv(low @ low.T)
    d = rows.join(spark.createDataFrame([r]), "key").select("x0", "x1", "x2", "x3", qr.squared_distance().alias("d")).collect()
    assert all(abs(v.d - (np.array(v[:4]) - mean) @ inv @ (np.array(v[:4]) - mean)) < 1e-6 for v in d)


def test_windows_of_equal_bits_hide_nothing(spark, monkeypatch):
    """With two bits of hash nearly all windows meet; equal ones are found all the same."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdef"), rng.integers(1, 80))) for _ in range(60)]
    hashed = qr.F.xxhash64
    monkeypatch.setattr(qr.F, "xxhash64", lambda *c: qr.F.shiftleft(hashed(*c), 62))
    docs = spark.createDataFrame([(i, t, "l", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in qr.statistics(docs).collect():
        assert r.n_repeat_words == brute(texts[r.doc_id])[4]


def test_over_a_million_words(spark):
    n = 2**20 + 50
    words = [f"w{i}" for i in range(n)]
    words[-3:] = words[1000:1003]
    docs = spark.createDataFrame([(1, " ".join(words), "l", "s")], "doc_id long, text string, lang string, source string")
    got = qr.statistics(docs).first()
    assert (got.n_words, got.n_repeat_words) == (n, 6)


def test_estimates_match_an_exact_determinant(spark):
    """Steps over all vectors, sorted, from the same starts."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal([1.5, 0.2, 0.1, 0.1], [0.2, 0.1, 0.05, 0.1], (700, 4)), rng.normal(3, 0.2, (120, 4))])
    floor, h = np.diag(np.square(qr.FLOOR)), qr.HALF * len(x)

    def step(near):
        m = x[near].mean(0)
        return m, qr.consistent(qr.HALF) * ((x[near] - m).T @ (x[near] - m) / len(near)) + floor

    distance = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    best = None
    for low, high, width in ((0.25, 0.75, 1.349), (0.1, 0.9, 2.563)):
        m, c = np.median(x, 0), np.diag(((np.quantile(x, high, 0) - np.quantile(x, low, 0)) / width) ** 2) + floor
        for _ in range(40):
            m, c = step(np.argsort(distance(m, c))[: int(h)])
        if best is None or np.linalg.det(c) < best[0]:
            best = np.linalg.det(c), m, c
    on = distance(best[1], best[2]) <= qr.chi2_quantile(0.975, 4)
    m = x[on].mean(0)
    c = qr.consistent(0.975) * np.cov(x[on].T, bias=True) + floor
    from stridegraph.llm.common import Scratch

    scratch = Scratch(spark, "t")
    r = qr.estimates(scratch, scratch.keep(spark.createDataFrame([("g", *map(float, v)) for v in x], "key string, x0 double, x1 double, x2 double, x3 double"))).first()
    low = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    assert np.abs(np.array([r[f"m{i}"] for i in range(4)]) - m).max() < 0.01 and np.abs(low @ low.T - c).max() < 0.003


def test_no_rows(spark):
    assert qr.judged(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
