import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stridegraph.llm import ngram_join
from stridegraph.llm.common import sifted


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    m = min(k, len(w))
    return frozenset(tuple(w[i : i + m]) for i in range(len(w) - m + 1)) if w else frozenset()


def brute(rows):
    """(class, links) of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    links, top = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        same = (rows[i][1] or "") == (rows[j][1] or "")
        if a and b and len(a & b) * 5 >= 4 * len(a | b):
            links[i] += 1
            links[j] += 1
            same = True
        if same:
            top[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    return [(min((x for x in ids[root(i)] if x is not None), default=None), links[i]) for i in range(len(rows))]


def made_up():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(4))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "one two"), (None, "one two"), (6, "one  two"), (7, "x"), (7, "x"), (8, "x y z u v w " * 30)]
    base = [word() for _ in range(200)]
    for i in range(150):  # a large group of near copies, all different
        w = list(base)
        w[rng.randrange(200)] = word()
        rows.append((100 + i, " ".join(w)))
    for i in range(30):  # a chain: each is like the next, not like those far off
        rows.append((300 + i, " ".join(f"c{x}" for x in range(i * 5, i * 5 + 100))))
    rows += [(400 + i, "a passage that many have " * 3 + " ".join(word() for _ in range(30))) for i in range(20)]
    return rows


@pytest.mark.parametrize("block", [8, 64])
def test_join_matches_all_pairs(spark, block):
    rows = made_up()
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, key string")
    got = ngram_join.joined(docs, block=block).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == sorted((str(d), str(c), n) for (d, _), (c, n) in zip(rows, brute(rows)))


def test_join_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.joined(docs).collect()}
    assert got == {d: x for (d, _), x in zip(rows, brute(rows))}


def test_one_of_each_keeps_columns_and_one_row(spark):
    rows = made_up()
    names = ("n", "cid", "key", "_key", "_doc", "row", "first", "doc", "none", "group", "mark", "chunk")
    docs = spark.createDataFrame([(d, t, *[i] * len(names)) for i, (d, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    out = ngram_join.one_of_each(docs).collect()
    assert len(out) == len({(c if c is not None else "none") for c, _ in brute(rows)})
    assert tuple(out[0].asDict()) == ("doc_id", "text", *names)
    for r in out:
        assert rows[r.n] == (r.doc_id, r.text) and {r[c] for c in names} == {r.n}
    least = spark.createDataFrame([(None, "a b c d e f g"), (-(2**63), "a b c d e f g"), (None, "q")], "doc_id long, text string")
    assert sorted(map(str, ngram_join.one_of_each(least).collect())) == sorted(["Row(doc_id=-9223372036854775808, text='a b c d e f g')", "Row(doc_id=None, text='q')"])
    assert ngram_join.one_of_each(least.limit(0)).count() == 0


def test_a_cluster_of_5000_near_copies(spark):
    """All differ; each pair is alike by its number of shared words, so links are known without all pairs."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(300)]
    rows, ends = [], []
    for i in range(5000):  # a part of the base up to an end, and a word of its own
        end = rng.randrange(280, 301)
        ends.append(end)
        rows.append((i, " ".join([*base[:end], f"own{i}"])))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {(0, 4999)}


def test_recall_is_measured(spark, sf_dir):
    """At sf0.01, of pairs of different texts that share a five-word shingle."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts = sorted({t or "" for _, t in rows})
    times, sets, near = Counter(t or "" for _, t in rows), [shingles(t) for t in texts], defaultdict(list)
    for i, x in enumerate(sets):
        for g in x:
            near[g].append(i)
    want = Counter()
    for i, x in enumerate(sets):
        shared = Counter(j for g in x for j in near[g])
        for j, n in shared.items():
            if j != i and n * 5 >= 4 * (len(x) + len(sets[j]) - n):
                want[texts[i]] += times[texts[j]]
    got = {r.doc_id: r.n_links for r in ngram_join.joined(docs).collect()}
    whole = {d: want[t or ""] + (times[t or ""] - 1 if shingles(t) else 0) for d, t in rows}
    assert sum(whole.values()) > 100 and all(got[d] <= n for d, n in whole.items())
    assert sum(got.values()) >= 0.99 * sum(whole.values())


def test_no_rows(spark):
    assert ngram_join.joined(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_banding_reaches_recall():
    for s in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.banding(s, 0.999)
        assert 1 - (1 - s**rows) ** bands >= 0.999 and bands * rows <= ngram_join.HASHES or rows == 1


def test_texts_without_candidates_are_not_shuffled(spark, monkeypatch):
    """As on a table with more classes in shared buckets than may be broadcast."""
    monkeypatch.setattr(ngram_join, "small", lambda df, *_: df, raising=False)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before, sc = spark.conf.get(threshold), spark.sparkContext._jsc.sc()
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    base = [word() for _ in range(100)]
    rows = [(i, " ".join(word() for _ in range(1000))) for i in range(400)] + [(1000 + i, " ".join([*base, f"own{i}"])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(4)

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    spark.conf.set(threshold, "-1")
    try:
        at = written()
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.joined(docs).collect()}
        shuffled = written() - at
    finally:
        spark.conf.set(threshold, before)
    assert got == {d: (min(d, 1000), 19 if d >= 1000 else 0) for d, _ in rows}
    assert 0 < shuffled < 0.2 * sum(len(t) for _, t in rows)


def test_a_filter_keeps_all_that_is_wanted(spark, tmp_path):
    spark.range(40_000).withColumn("key", F.md5(F.col("id").cast("string"))).write.parquet(f"{tmp_path}/keys")
    rows = spark.read.parquet(f"{tmp_path}/keys")
    wanted = rows.where("id % 8 = 0").select("key")
    for words, most in ((1 << 20, 0.03), (16, 1)):  # the second is full
        got = sifted(rows, wanted, "key", words)
        assert got.columns == ["id", "key"] and got.where("id % 8 = 0").count() == 5000
        assert got.where("id % 8 != 0").count() <= most * 35_000
    assert sifted(rows, wanted.limit(0), "key").count() == 0
