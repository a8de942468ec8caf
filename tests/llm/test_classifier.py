import tracemalloc

import numpy as np

from stridegraph.llm import classifier


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.where("doc_id % 3 != 0")
    model = classifier.fitted(docs, train)
    got = {r.doc_id: r for r in classifier.scored(docs, model).collect()}
    test = [(r.quality, got[r.doc_id]) for r in labels.where("doc_id % 3 = 0").collect()]
    assert np.mean([r.kept == bool(q) for q, r in test]) > 0.95
    assert np.mean([r.kept for q, r in test if q == 1]) > 0.97
    assert np.mean([(r.text_score >= 0.5) == bool(q) for q, r in test]) > 0.9 and np.mean([(r.meta_score >= 0.5) == bool(q) for q, r in test]) > 0.9
    names = ("score", "y", "_id", "row", "block", "kept")
    more = docs.withColumns({c: docs.doc_id for c in names})
    rows = classifier.kept(more, classifier.fitted(more, train)).collect()
    assert {r.doc_id for r in rows} == {d for d, r in got.items() if r.kept} and all(r[c] == r.doc_id for r in rows for c in names)


def test_rounds_of_exchange_help_a_view_with_few_labels(monkeypatch):
    rng = np.random.default_rng(1)
    n = 600
    y = (rng.random(n) < 0.5).astype(float)
    view = lambda noise: (np.arange(n), np.where(rng.random(n) < noise, rng.integers(0, 50, n), (y * 25 + rng.integers(0, 25, n)).astype(int)), np.full(n, 3.0))
    labelled = np.zeros(n, bool)
    labelled[:60] = True
    apart = np.zeros(n, bool)
    apart[40:60] = True
    # words of a hundred kinds a class, of which few labels show few: the other view's labels show the rest
    text = (np.arange(n), (y * 100 + rng.integers(0, 100, n)).astype(int), np.full(n, 3.0))
    rest = ~labelled
    right = []
    for rounds in (0, classifier.ROUNDS):
        monkeypatch.setattr(classifier, "ROUNDS", rounds)
        models = classifier.exchanged([text, view(0.02)], np.where(labelled, y, 0.0), labelled, labelled & ~apart)
        right.append(np.mean((models[0].raw(text, n) > 0)[rest] == y[rest]))
    assert right[1] > right[0] + 0.1
    model = classifier.CoTrained().fit([text, view(0.02)], np.where(labelled, y, 0.0), labelled, apart)
    assert model.model is not None and len(model.model) == 2


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, None, None, None), (1, "", "en", "s", 0), (None, "x y", "en", "s", 3), (2, "z " * 50_000, "en", None, -4)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = classifier.scored(docs, classifier.fitted(docs, none)).collect()
    assert len(got) == 4 and all(r.kept and r.score == 0.5 for r in got)
    some = spark.createDataFrame([(1, 1), (2, 0), (2, None), (2, 0), (None, 1), (77, 1)], "doc_id long, quality int")
    assert classifier.scored(docs, classifier.fitted(docs, some)).count() == 4
    twice = spark.createDataFrame([(i, t, "en", "s", 9) for i in range(60) for t in (f"good calm prose {i}" if i % 2 else f"buy cheap now {i}", f"other {i}")], schema)
    known = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    first, again = (sorted(map(str, classifier.scored(twice, classifier.fitted(d, known)).collect())) for d in (twice, twice.orderBy("text", ascending=False)))
    assert first == again
    empty = spark.createDataFrame([], schema)
    assert classifier.scored(empty, classifier.fitted(empty, some)).count() == 0


def test_pseudo_labels_come_from_all_unlabelled_documents(spark):
    pool, own = 100, range(1000, 1600)
    text = lambda i: ("fine clear careful prose " if i % 2 else "buy cheap click now ") * 3 + f"marker{i}q{i * 7919}"
    docs = spark.createDataFrame([(i, text(i), "en", "s" if i % 2 else "t", 60) for i in [*range(200), *own]], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    w = classifier.fitted(docs, labels, pool=pool).model[0][0]
    feature = lambda word: int(classifier.hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0] >> np.uint64(64 - classifier.TEXT_BITS))
    # only a document with a marker's word gives weight to it
    assert sum(w[feature(text(i).split()[-1].encode())] != 0 for i in own) > pool


def plain(view, n, y, weight, features, steps):
    """Linear.fit on whole arrays."""
    rows, cols, vals = (c.astype(t) for c, t in zip(view, (np.int64, np.int64, float)))
    w, b, seen, seen_b, total = np.zeros(features), 0.0, np.full(features, 1e-6), 1e-6, max(1e-9, weight.sum())
    for _ in range(steps):
        g = weight * (1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols] * vals, n) + b, -30, 30))) - y) / total
        gw = np.bincount(cols, g[rows] * vals, features) + 1e-4 * w / total
        seen, seen_b = seen + gw * gw, seen_b + g.sum() ** 2
        w, b = w - 0.5 * gw / np.sqrt(seen), b - 0.5 * g.sum() / np.sqrt(seen_b)
    return w, b


def test_a_fit_widens_a_slice_at_a_time_and_gives_what_whole_arrays_give(monkeypatch):
    rng = np.random.default_rng(3)
    n, size = 5000, 1_500_000
    rows = np.sort(rng.choice(np.flatnonzero(np.arange(n) % 7), size)).astype(np.int32)  # each seventh row has no entries
    view = rows, (rng.integers(0, 300, size) ** 2).astype(np.int32), rng.random(size).astype(np.float32)
    y, weight = (rng.random(n) < 0.3).astype(float), rng.choice([0.0, 0.5, 1.0], n)
    m = classifier.Linear(classifier.TEXT_BITS)
    tracemalloc.start()
    m.fit(view, n, y, weight, steps=3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 * size
    w, b = plain(view, n, y, weight, len(m.w), 3)
    assert np.allclose(m.w, w, atol=1e-9) and np.isclose(m.b, b)
    for step in (1, 999, 10**9):
        monkeypatch.setattr(classifier, "STEP", step)
        few = tuple(c[:2000] for c in view)
        m.fit(few, n, y, weight, steps=3)
        w, b = plain(few, n, y, weight, len(m.w), 3)
        assert np.allclose(m.w, w, atol=1e-9) and np.isclose(m.b, b)
    m.fit(tuple(c[:0] for c in view), n, y, weight, steps=3)
    assert not m.w.any()


def test_features_do_not_depend_on_portions(monkeypatch):
    texts = ["a b c a b c", "", "long " * 3000, "x", "y é z " * 40, "w" * 5000, "end"]
    more = [["en"] * 7, ["s"] * 7, [None] * 7]
    whole = classifier.summed(texts, *more)
    monkeypatch.setattr(classifier, "CHARS", 4000)
    assert [texts[lo:hi] for lo, hi in classifier.portions(texts)] == [texts[:2], texts[2:3], texts[3:5], texts[5:6], texts[6:]]
    parts = classifier.summed(texts, *more)
    after = classifier.summed(texts[3:], *(c[3:] for c in more), classifier.summed(texts[:3], *(c[:3] for c in more)), 3)
    assert all(np.array_equal(a, b) and np.array_equal(a, c) and a.dtype == c.dtype for v in zip(whole, parts, after) for a, b, c in zip(*v))
    assert not list(classifier.portions([]))
