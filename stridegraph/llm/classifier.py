"""Quality classifier by co-training.

Two views of a document have a classifier each: the words of the text, and the page's metadata
(language, source, length, layout). Over rounds, each labels the pool's documents of which it is
most certain, for the other to learn from. Both are then calibrated on labelled documents held
apart, and their calibrated log odds are added (less the prior) to score every document.

Fitting uses at most LABELLED labelled documents, those with the least hashes of doc_id, and all
others without their labels. The others are dealt by hash into blocks of about POOL documents; each
block is co-trained with the labelled sample on an executor, and the blocks' weights are averaged, as
exact sums. So the ranking by certainty is within a block, not over all. All documents are scored, in
one narrow pass. The model is of fixed size.

Null text: empty. Null lang or source: a value of its own. Labels that are null are ignored, and of
a document's several labels the mean decides (a half counts as good). Without labels of both classes every document
has score 0.5 and is kept. Of rows with one doc_id the least teaches; all are scored. Of documents that
are equally certain the first by doc_id is labelled. Very long texts: portions of 2**18 code points,
or one text, are made to features at once. An empty table gives an empty result. kept() returns all columns as they are,
whatever their names; other columns than doc_id, text, lang, source and n_chars count for nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridegraph.llm.bytewords import SPACE, hashes, mixed, runs
from stridegraph.llm.common import Scratch, given_back, trimmed

#: Production parameters: bound of the labelled sample, documents of a block, rounds of exchange, part of the pool that a view labels in a round, least certainty, and the score from which a document is kept.
LABELLED, POOL, ROUNDS, SHARE, CERTAIN, KEEP = 4000, 4000, 4, 0.08, 0.95, 0.5
TEXT_BITS, META_BITS = 17, 12
#: Weight of a text's shares; logistic regression sees shares of words, which are small.
SCALE = 20.0
#: Steps of one in which weights are summed over blocks: whole numbers, so that the order of summing does not matter.
UNIT = 2.0**32
#: Entries of a view that are widened at once. Does not change what is learnt but for the order of sums.
STEP = 1 << 17
#: Texts, and their code points, that are made to features at once. Does not change them.
TEXTS, CHARS = 200, 1 << 18


def layout(buf: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Per text: bytes, line feeds, capitals, digits, symbols, other punctuation. buf: the texts with a space after each."""
    kind = np.zeros(256, np.uint8)
    kind[10], kind[65:91], kind[48:58] = 1, 2, 3
    kind[[ord(c) for c in "#*$%&|<>@=_~^\\{}[]/"]] = 4
    kind[[ord(c) for c in ".,;:!?()'\"-+"]] = 5
    k = kind[buf]
    out = [np.diff(np.concatenate(([0], stops))) - 1]
    for i in range(1, 6):
        at = np.flatnonzero(k == i)
        out.append(np.diff(np.concatenate(([0], np.searchsorted(at, stops)))))
    return np.stack(out, 1)


def bucket(x: np.ndarray) -> np.ndarray:
    """Twelve log steps of a share."""
    return np.clip(np.round(-2 * np.log2(np.maximum(x, 1e-4))), 0, 24).astype(int)


def features(texts: list[str], langs: list, sources: list, sizes: list):
    """(text view, metadata view), each (text number, feature, value) in arrays."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    n = len(raw)
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    stops = np.cumsum(np.fromiter(map(len, raw), np.int64, n) + 1)
    lower = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    begins, ends = runs(SPACE[buf])
    doc = np.searchsorted(stops, begins, "right")
    words = np.bincount(doc, minlength=n)
    h = hashes(lower, begins, ends)
    long_ = lambda a: buf[a].astype(np.uint64)
    size = (ends - begins).astype(np.uint64)
    last, mid = long_(ends - 1), long_(np.maximum(ends - 2, begins))
    shape = mixed(last * np.uint64(65536) + mid * np.uint64(256) + np.minimum(size, np.uint64(3)) + np.uint64(1 << 40))
    first = mixed(long_(begins) * np.uint64(256) + long_(np.minimum(begins + 1, ends - 1)) + np.uint64(1 << 41))
    cut = np.uint64(64 - TEXT_BITS)
    weight = SCALE / np.maximum(1, words[doc])
    # how much of a text repeats: shares of three-word windows seen before
    three = mixed(h[:-2] * np.uint64(3) + mixed(h[1:-1] * np.uint64(5) + h[2:])) if len(h) > 2 else np.empty(0, np.uint64)
    whole = doc[: len(three)] == doc[2:] if len(three) else np.empty(0, bool)
    keys = mixed(three[whole] + doc[: len(three)][whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    fresh = np.zeros(len(keys), bool)
    fresh[np.unique(keys, return_index=True)[1]] = True
    again = np.bincount(doc[: len(three)][whole], ~fresh, n) / np.maximum(1, words)
    text = [(doc, (x >> cut).astype(np.int64), weight) for x in (h, shape, first)]
    text.append((np.arange(n), np.array([zlib.crc32(b"again%d" % b) % (1 << TEXT_BITS) for b in bucket(again)], np.int64), np.full(n, 2.0)))
    lay = layout(buf, stops)
    share = lay[:, 1:] / np.maximum(1, lay[:, :1])
    names = []
    steps = [bucket(share[:, i]) for i in range(5)]
    for i in range(n):
        size = lay[i, 0] if sizes[i] is None else max(0, sizes[i])
        row = ["bias", f"lang {langs[i]}", f"source {sources[i]}", f"size {int(np.log2(size + 1))}", f"line {int(2 * np.log2(1 + lay[i, 0] / (1 + lay[i, 1])))}"]
        row += [f"{k} {steps[k][i]}" for k in range(5)]
        row += [f"{k} over {s}" for k in range(5) for s in range(2, 24, 3) if steps[k][i] <= s]
        names.append(row)
    at = np.repeat(np.arange(n), [len(r) for r in names])
    meta = [(at, np.array([zlib.crc32(x.encode()) % (1 << META_BITS) for r in names for x in r], np.int64), np.ones(len(at)))]
    return [tuple(np.concatenate(c) for c in zip(*view)) for view in (text, meta)]


def portions(texts: list[str]):
    """Bounds of stretches of at most TEXTS texts and, where it is more than one, CHARS code points."""
    lo = chars = 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo == TEXTS or chars + len(t) > CHARS):
            yield lo, i
            lo, chars = i, 0
        chars += len(t)
    if texts:
        yield lo, len(texts)


def summed(texts: list[str], langs: list, sources: list, sizes: list, views=(), n: int = 0):
    """As features(), in slices; each feature of a text once and in order, in narrow types. views: the same of n texts that go before."""
    parts = [tuple([x] for x in view) for view in views] or [([], [], []), ([], [], [])]
    for lo, hi in portions(texts):
        for out, (at, col, val) in zip(parts, features(*(c[lo:hi] for c in (texts, langs, sources, sizes)))):
            keys, back = np.unique(at.astype(np.int64) << 32 | col, return_inverse=True)
            out[0].append(((keys >> 32) + n + lo).astype(np.int32))
            out[1].append((keys & 0xFFFFFFFF).astype(np.int32))
            out[2].append(np.bincount(back, val, len(keys)).astype(np.float32))
    out = []
    for view in parts:
        out.append([])
        for c in view:
            out[-1].append(np.concatenate(c))
            c.clear()  # so one column at a time is there twice
    given_back()
    return [tuple(view) for view in out]


def sliced(view, on: np.ndarray, features: int):
    """The rows of a view (in order) that are on, in slices of whole rows, of some STEP entries; and the features, those of most entries first.

    A slice: rows, where each begins, entries of each, places of their features in that order (so that
    the frequent ones share cache lines), values.
    """
    begins = np.append(0, np.flatnonzero(view[0][1:] != view[0][:-1]) + 1)
    cuts = np.append(np.unique(begins[np.searchsorted(begins, np.arange(0, len(view[0]), STEP), "right") - 1]), len(view[0]))
    out, count = [], np.zeros(features, np.int64)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        take = on[view[0][lo:hi]]
        rows, cols, vals = (c[lo:hi][take] for c in view)
        if len(rows):
            heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            out.append([rows[heads], heads, np.diff(np.append(heads, len(rows))), cols, vals])
            count += np.bincount(cols, minlength=features)
    order = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
    place = np.zeros(features, np.int32)
    place[order] = np.arange(len(order))
    for part in out:
        part[3] = place[part[3]]
    return out, order


class Linear:
    """Logistic regression on sparse rows, fitted by AdaGrad over all rows. Entries stay in their narrow types; only those of a slice are widened."""

    def __init__(self, bits: int) -> None:
        self.w, self.bits, self.b = np.zeros(1 << bits), bits, 0.0

    def raw(self, view, n: int) -> np.ndarray:
        rows, cols, vals = view
        z = np.zeros(n)
        for lo in range(0, len(rows), STEP):
            np.add.at(z, rows[lo : lo + STEP], self.w[cols[lo : lo + STEP]] * vals[lo : lo + STEP])
        return z + self.b

    def fit(self, view, n: int, y: np.ndarray, weight: np.ndarray, steps: int = 60, rate: float = 0.5, decay: float = 1e-4) -> None:
        slices, order = sliced(view, weight > 0, len(self.w))
        w, self.b = np.zeros(len(order)), 0.0
        seen, seen_b, total = np.full(len(w), 1e-6), 1e-6, max(1e-9, weight.sum())
        slope = lambda z, at: weight[at] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / total
        for _ in range(steps):
            # rows without entries have the offset alone
            g, gw = slope(np.full(n, self.b), slice(None)), decay * w / total
            for at, heads, sizes, cols, vals in slices:
                cols = cols.astype(np.int64)
                g[at] = slope(np.add.reduceat(w[cols] * vals, heads) + self.b, at)
                gw += np.bincount(cols, np.repeat(g[at], sizes) * vals, len(gw))
            seen += gw * gw
            w -= rate * gw / np.sqrt(seen)
            seen_b += g.sum() ** 2
            self.b -= rate * g.sum() / np.sqrt(seen_b)
        self.w[:] = 0
        self.w[order] = w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make log odds of raw scores, by damped Newton steps on smoothed labels."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale, middle = max(1e-9, float(z.std())), float(z.mean())
    x = np.stack([(z - middle) / scale, np.ones(len(z))], 1)
    # logaddexp keeps the loss finite where a score is far out
    loss = lambda v: float((np.logaddexp(0, x @ v) - t * (x @ v)).sum() + 1e-2 * v[0] ** 2)
    v = np.array([1.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        g = x.T @ (p - t) + np.array([2e-2 * v[0], 0.0])
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag([2e-2, 1e-9])
        step, now = np.linalg.solve(h, g), loss(v)
        for k in range(30):
            if loss(v - step * 0.5**k) <= now:
                break
        v = v - step * 0.5**k
        if np.abs(step).max() < 1e-8:
            break
    slope = max(1e-6, float(v[0])) / scale
    return slope, float(v[1]) - slope * middle


def exchanged(views, y: np.ndarray, labelled: np.ndarray, train: np.ndarray, first=None) -> list[Linear]:
    """The two views' models after the rounds. first: what the labelled rows alone give, where that is known."""
    n = len(y)
    models = [Linear(TEXT_BITS), Linear(META_BITS)]
    known = [np.where(train, y, 0.0) for _ in models]
    weight = [train.astype(float) for _ in models]
    free = [~labelled for _ in models]
    good = float(y[train].mean())
    for r in range(ROUNDS + 1):
        for i, (m, v, k, w) in enumerate(zip(models, views, known, weight)):
            if r == 0 and first:
                m.w, m.b = first[i]
            else:
                m.w = np.zeros(len(m.w))
                m.fit(v, n, k, w)
        if r == ROUNDS or not (~labelled).any():
            break
        for i, m in enumerate(models):
            p = 1 / (1 + np.exp(-np.clip(m.raw(views[i], n), -30, 30)))
            other = 1 - i
            quota = SHARE * (~labelled).sum()
            for side, part in ((1.0, good), (0.0, 1 - good)):
                sure = p if side else 1 - p
                pick = np.flatnonzero(free[other] & (sure >= CERTAIN))
                pick = pick[np.argsort(-sure[pick], kind="stable")][: int(np.ceil(quota * part))]
                known[other][pick], weight[other][pick], free[other][pick] = side, 0.5, False
    return models


def parted(y: np.ndarray, labelled: np.ndarray, apart: np.ndarray):
    """Rows that train and rows that calibrate: the same ones where either part lacks a class, None where all labels do."""
    train, held = labelled & ~apart, labelled & apart
    if any(len(np.unique(y[x])) < 2 for x in (train, held)):
        return None if len(np.unique(y[labelled])) < 2 else (labelled, labelled)
    return train, held


class CoTrained:
    """Two calibrated views; .model is None without labels of both classes."""

    def __init__(self) -> None:
        self.model = None

    def fit(self, views, y: np.ndarray, labelled: np.ndarray, apart: np.ndarray) -> "CoTrained":
        """y: labels where labelled; apart: labelled rows that only calibrate. All rows are one block."""
        parts = parted(y, labelled, apart)
        if parts is None:
            return self
        return self.calibrated([(m.w, m.b) for m in exchanged(views, y, labelled, parts[0])], views, y, labelled, parts[1])

    def calibrated(self, weights, views, y: np.ndarray, labelled: np.ndarray, held: np.ndarray) -> "CoTrained":
        n, self.model = len(y), []
        for (w, b), (rows, cols, vals) in zip(weights, views):
            z = np.bincount(rows, w[cols] * vals, n) + b
            self.model.append((w, b, *platt(z[held], y[held])))
        p = (y[labelled].sum() + 1) / (labelled.sum() + 2)
        self.prior = float(np.log(p / (1 - p)))
        return self

    def score(self, texts, langs, sources, sizes) -> np.ndarray:
        """Per text: probability by words, by metadata, and by both."""
        n = len(texts)
        if self.model is None or not n:
            return np.full((n, 3), 0.5)
        odds = []
        for (rows, cols, vals), (w, b, slope, offset) in zip(features(texts, langs, sources, sizes), self.model):
            odds.append(np.clip(slope * (np.bincount(rows, w[cols] * vals, n) + b) + offset, -30, 30))
        both = odds[0] + odds[1] - self.prior
        return 1 / (1 + np.exp(-np.stack([*odds, both], 1)))


def teaching(views, y: np.ndarray, train: np.ndarray):
    """Views and labels of the rows that train. Those that only calibrate teach no block, so they do not travel."""
    place = (np.cumsum(train) - 1).astype(np.int32)
    return [(place[v[0][on]], v[1][on], v[2][on]) for v in views for on in (train[v[0]],)], y[train]


def learner(shared):
    """The function that co-trains a block of unlabelled rows with the labelled ones and returns its weights (view, feature, weight); feature -1 is the offset, view -1 counts blocks. shared: a broadcast of what teaching() gives and of the models that those rows alone give; a worker holds it once, a closure twice."""

    def learn(block: pa.Table) -> pa.Table:
        block = block.sort_by([(c, "ascending") for c in ("doc_id", "text", "lang", "source", "n_chars")])
        ids = block.column("doc_id").to_numpy()
        block = block.take(pa.array(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))))
        (views, y, first), k = shared.value, block.num_rows
        n = len(y)
        both = summed(*(block.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars")), views, n)
        del block
        known = np.arange(n + k) < n
        models = exchanged(both, np.concatenate((y, np.zeros(k))), known, known, first)
        out = [([-1], [0], [1])]
        for i, m in enumerate(models):
            at = np.flatnonzero(m.w)
            out.append((np.full(len(at) + 1, i), np.append(at, -1), np.rint(np.append(m.w[at], m.b) * UNIT)))
        return pa.table([pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(*out), ("i4", "i4", "i8"))], names=["view", "feature", "weight"])

    return lambda block: list(trimmed([learn(block)]))[0]


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, pool: int = POOL) -> CoTrained:
    """Learns from a labelled sample of bounded size, whose features reach the driver, and from all other documents in blocks on the executors."""
    scratch = Scratch(docs.sparkSession, "classifier")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("y"))
    known = scratch.keep(known.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(labelled))
    known = F.broadcast(known.select(F.col("doc_id").alias("_id"), "y"))  # at most labelled rows
    cols = ["text", "lang", "source", "n_chars"]
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    rows = docs.join(known, docs.doc_id == F.col("_id")).groupBy("_id", "y").agg(F.min(F.struct(*cols)).alias("row")).select("_id", "y", "row.*")

    def made(batches):
        """Rows become their features, so that what travels is small."""
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part, out = b.slice(lo, 200), []
                for at, col, val in summed(*(part.column(i).to_pylist() for i in range(2, 6))):
                    cut = np.searchsorted(at, np.arange(1, part.num_rows))
                    out += [pa.array([x.tobytes() for x in np.split(c, cut)], pa.binary()) for c in (col, val)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *out], names=["id", "y", "a", "b", "c", "d"])

    got = rows.mapInArrow(lambda batches: trimmed(made(batches)), "id long, y double, a binary, b binary, c binary, d binary").sort("id").toArrow()
    model = CoTrained()
    if not got.num_rows:
        return model
    y = (np.array(got.column("y").to_pylist(), float) >= 0.5).astype(float)
    on = np.ones(len(y), bool)
    parts = parted(y, on, np.array([zlib.crc32(str(i).encode()) % 4 == 0 for i in got.column("id").to_pylist()]))
    if parts is None:
        return model
    views = []
    for c, v in (("a", "b"), ("c", "d")):
        each = [np.frombuffer(x, "<i4") for x in got.column(c).to_pylist()]
        views.append((np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each]), np.concatenate(each), np.frombuffer(b"".join(got.column(v).to_pylist()), "<f4")))
    del got, each
    weights = [(m.w, m.b) for m in exchanged(views, y, on, parts[0])]
    rest = docs.where("doc_id is not null").join(known, docs.doc_id == F.col("_id"), "left_anti")
    n = rest.count()
    if n:
        # a sum per feature is all that comes back, whatever the number of blocks
        block = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(-(-n // pool))).alias("block")
        shared = docs.sparkSession.sparkContext.broadcast((*teaching(views, y, parts[0]), weights))
        learnt = rest.select(block, F.col("doc_id").cast("long").alias("doc_id"), *cols).groupBy("block").applyInArrow(learner(shared), "view int, feature int, weight long")
        view, at, total = (c.to_numpy() for c in learnt.groupBy("view", "feature").agg(F.sum("weight").alias("weight")).toArrow().columns)
        shared.destroy()
        blocks = total[view == -1][0]
        for i, (w, _) in enumerate(weights):
            mean = np.zeros(len(w))
            mean[at[(view == i) & (at >= 0)]] = total[(view == i) & (at >= 0)] / UNIT / blocks
            weights[i] = mean, float(total[(view == i) & (at < 0)][0] / UNIT / blocks)
    return model.calibrated(weights, views, y, on, parts[1])


def _scores(model: CoTrained, batch: pa.RecordBatch) -> np.ndarray:
    names = batch.schema.names
    cols = [batch.column(names.index(c)).to_pylist() for c in ("text", "lang", "source", "n_chars")]
    cols[0] = [t or "" for t in cols[0]]
    out = [model.score(*(c[lo:hi] for c in cols)) for lo, hi in portions(cols[0])]
    return np.concatenate(out) if out else np.empty((0, 3))


def scored(docs: DataFrame, model: CoTrained, keep: float = KEEP) -> DataFrame:
    def run(batches):
        for b in batches:
            s = _scores(model, b)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[:, i]) for i in range(3)), pa.array(s[:, 2] >= keep)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", "n_chars").mapInArrow(lambda batches: trimmed(run(batches)), "doc_id long, text_score double, meta_score double, score double, kept boolean")


def kept(docs: DataFrame, model: CoTrained, keep: float = KEEP) -> DataFrame:
    """The rows of docs that the model keeps, all columns as they are."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(model, b)[:, 2] >= keep))

    return docs.mapInArrow(lambda batches: trimmed(run(batches)), docs.schema)
