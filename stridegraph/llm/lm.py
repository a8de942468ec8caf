"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates: of trigrams with the model of two words, which mixes
bigrams, unigrams and a uniform part. Weights depend on how often the context was seen (buckets by
powers of two) and are learned by expectation-maximisation on the counts of held-out training
documents, with counts of the others: first those of two words, then of three.

Counting and looking up go by blocks of documents and a tree of merges (merge_tree). So a token
never is a row, frequent words are summed before they move, and no task holds more than one range
or one block. Nothing of the model is broadcast but its weights (16 x 5 numbers) and two sums.

Documents whose crc32(doc_id as text) mod 5 is 1 are not learned from (null doc_id: text "").
Null or empty text: only the end token. Repeated rows count as often as they occur. Very long texts:
a block has about BLOCK_BYTES of text, unless a single text has more, which a task then holds whole.
With no documents to learn weights from, the weights are those of DEFAULT and DEFAULT3. An empty
table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridegraph.llm.bytewords import mixed
from stridegraph.llm.common import Scratch, trimmed
from stridegraph.llm.fingerprints import WordHashes
from stridegraph.llm.merge_tree import MESSAGE, Tree, in_blocks, in_key_order, table_of

#: Production parameters: documents per block, buckets of context counts, one in so many training documents is held out for the weights.
BLOCK, CONTEXTS, DELETED = 2048, 16, 10
#: Weights where none can be learned: of bigrams, unigrams and the uniform part; of trigrams and the model of two words.
DEFAULT, DEFAULT3 = (0.6, 0.3, 0.1), (0.5, 0.5)
ROUNDS = 100
_END, _START, _START2, _PAIR = (np.uint64(x) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x6C62272E07BB0142, 0x2545F4914F6CDD1D))
_LOW = -12.0  # least log10 of a frequency that has a bin of its own
_STEP = 0.05


def remainder(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def is_held_out(doc_id) -> bool:
    return remainder(doc_id) % 5 == 1


def is_deleted(doc_id) -> bool:
    """Training documents whose counts set the weights."""
    c = remainder(doc_id)
    return c % 5 != 1 and c // 5 % DELETED == 0


def grams(texts: list[str | None], memo: WordHashes) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all tokens of all texts, as unigrams, bigrams and trigrams, and the number of tokens of each text."""
    parts, sizes = [], []
    for t in texts:
        w = (t or "").encode("utf-8", "replace").lower().split()
        parts.append(np.fromiter(map(memo.__getitem__, w), np.uint64, len(w)))
        sizes.append(len(w) + 1)
    n = np.array(sizes, np.int64)
    uni = np.empty(int(n.sum()), np.uint64)
    ends = np.cumsum(n) - 1
    inner = np.ones(len(uni), bool)
    inner[ends] = False
    if parts:
        uni[inner] = mixed(np.concatenate(parts))
    uni[ends] = _END
    starts = ends - n + 1
    out = [uni]
    for first in (_START, _START2):  # what stands before a text
        before = np.empty_like(uni)
        before[1:] = out[-1][:-1]
        before[starts] = first
        out.append(mixed(before * _PAIR + uni))
    return out, n


def counted(hashes: np.ndarray, train: np.ndarray, deleted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, with their counts in training documents and in the deleted ones among them."""
    keys, at = np.unique(hashes, return_inverse=True)
    return keys, np.bincount(at, train, len(keys)), np.bincount(at, deleted, len(keys))


def asked(blocks: DataFrame, tree: Tree) -> DataFrame:
    """Messages of each block; a block that two tasks read sends some from both."""

    def run(batches):
        memo = WordHashes()

        def tell(block, ids, texts):
            hashes, n = grams(texts, memo)
            train = np.repeat([not is_held_out(i) for i in ids], n).astype(float)
            out = np.repeat([is_deleted(i) for i in ids], n).astype(float)
            for kind, h in enumerate(hashes):
                yield table_of(tree.messages(kind, block, *counted(h, train, out)), MESSAGE)

        block, ids, texts = None, [], []
        for b in batches:
            for i, t, k in zip(*(b.column(j).to_pylist() for j in range(3))):
                if k != block:
                    if ids:
                        yield from tell(block, ids, texts)
                    block, ids, texts = k, [], []
                ids.append(i)
                texts.append(t)
        if ids:
            yield from tell(block, ids, texts)

    return blocks.select("doc_id", "text", "block").mapInArrow(lambda batches: trimmed(run(batches)), MESSAGE)


def looked_up(hashes: list[np.ndarray], told: pa.Table, column: str) -> list[np.ndarray]:
    """The total of each n-gram; told has those of the distinct ones, in ascending order."""
    return [in_key_order(told, kind, column)[np.unique(h, return_inverse=True)[1]] for kind, h in enumerate(hashes)]


def before(totals: np.ndarray, starts: np.ndarray, docs: int) -> np.ndarray:
    """How often the context of each token was seen: what stands before it, or the start, which is seen once a document."""
    out = np.empty_like(totals)
    out[1:] = totals[:-1]
    out[starts] = docs
    return out


def frequencies(counts: list[np.ndarray], n: np.ndarray, tokens: int):
    """Maximum-likelihood estimates of each token by three, two and one words, and how often the contexts of the first two were seen."""
    starts = np.cumsum(n) - n
    docs = int(counts[0][starts[0] + n[0] - 1])  # each document ends once
    c2, c3 = before(counts[0], starts, docs), before(counts[1], starts, docs)
    share = lambda x, c: np.where(c > 0, x / np.maximum(c, 1), 0.0)
    return share(counts[2], c3), share(counts[1], c2), counts[0] / max(1, tokens), c3, c2


def bucket_of(c: np.ndarray) -> np.ndarray:
    return np.minimum(CONTEXTS - 1, np.floor(np.log2(c + 1.0))).astype(np.int64)


def bins(f: np.ndarray) -> np.ndarray:
    """Bin of a frequency on a log scale; 0 for none."""
    with np.errstate(divide="ignore"):
        return np.where(f > 0, 1 + np.floor((np.maximum(np.log10(np.maximum(f, 1e-300)), _LOW) - _LOW) / _STEP), 0).astype(np.int64)


def learned(counts: list[tuple], floor: float | None, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by bucket of context counts, from held-out tokens counted by bucket and bins of two estimates, by expectation-maximisation.

    With a floor (the uniform part) there are three parts, else two.
    """
    parts = DEFAULT if floor is not None else DEFAULT3
    out = np.tile(np.array(parts), (CONTEXTS, 1))
    middle = lambda i: np.where(i > 0, 10 ** (_LOW + (i - 0.5) * _STEP), 0.0)
    x = np.array(counts, np.int64).reshape(-1, 4)
    for b in range(CONTEXTS):
        own = x[x[:, 0] == b]
        if not len(own):
            continue
        f = np.stack([middle(own[:, 1]), middle(own[:, 2])] + ([np.full(len(own), floor)] if floor is not None else []), 1)
        w = out[b]
        for _ in range(rounds):
            part = f * w
            part *= (own[:, 3] / np.maximum(part.sum(1), 1e-300))[:, None]
            new = (part.sum(0) + 1e-3) / (part.sum() + 1e-3 * len(parts))
            if np.abs(new - w).max() < 1e-6:
                break
            w = new
        out[b] = w
    return out


def by_two(w: np.ndarray, f2: np.ndarray, f1: np.ndarray, uniform: float, c2: np.ndarray) -> np.ndarray:
    """The bigram model: its own estimate, unigrams and the uniform part."""
    w = w[bucket_of(c2)]
    return w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] * uniform


def by_three(w: np.ndarray, f3: np.ndarray, p2: np.ndarray, c3: np.ndarray) -> np.ndarray:
    w = np.where((c3 > 0)[:, None], w[bucket_of(c3)], [[0.0, 1.0]])  # an unseen context leaves the bigram model
    return w[:, 0] * f3 + w[:, 1] * p2


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
BINNED = "b int, i int, j int, n long"


def scored(docs: DataFrame, rows: int = BLOCK, tree: Tree | None = None) -> DataFrame:
    """Scores every document: reads the texts to count, a part of them to learn the weights of two and of three words, and again to score."""
    scratch = Scratch(docs.sparkSession, "lm")
    blocks = in_blocks(scratch, docs, rows)
    tree = tree or Tree.over(blocks)
    told = tree.totals(scratch, asked(blocks, tree))
    n_all, v_all, n_kept, v_kept = tree.totals_of(0)
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    out = blocks.where((crc % 5 != 1) & (F.floor(crc / 5) % DELETED == 0))

    def weigh(weights2):
        """Held-out tokens by bucket and bins: of two words and one, or, with the weights of those, of three words and that model."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            code = np.empty(0, np.int64)
            if left.num_rows and right.num_rows:
                hashes, n = grams(left.column("text").to_pylist(), WordHashes())
                f3, f2, f1, c3, c2 = frequencies(looked_up(hashes, right, "c"), n, n_kept)
                if weights2 is None:
                    code = (bucket_of(c2) * 1000 + bins(f2)) * 1000 + bins(f1)
                else:
                    seen = c3 > 0
                    code = ((bucket_of(c3) * 1000 + bins(f3)) * 1000 + bins(by_two(weights2, f2, f1, 1.0 / (v_kept + 1), c2)))[seen]
            keys, times = np.unique(code, return_counts=True)
            return pa.table([pa.array(keys // 1_000_000, pa.int32()), pa.array(keys // 1000 % 1000, pa.int32()), pa.array(keys % 1000, pa.int32()), pa.array(times, pa.int64())], names=["b", "i", "j", "n"])

        pairs = out.select("block", "text").groupBy("block").cogroup(told.select(F.col("child").alias("block"), "kind", "range", "c").groupBy("block")).applyInArrow(run, BINNED)
        return [tuple(r) for r in pairs.groupBy("b", "i", "j").agg(F.sum("n")).collect()]  # at most CONTEXTS x 242 x 242 rows, whatever the input

    weights2 = learned(weigh(None), 1.0 / (v_kept + 1))
    weights3 = learned(weigh(weights2), None)
    floor = n_all + 0.5 * (v_all + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("doc_id").to_pylist()
        if ids:
            hashes, n = grams(left.column("text").to_pylist(), WordHashes())
            counts = looked_up(hashes, right, "a")
            del hashes
            f3, f2, f1, c3, c2 = frequencies(counts, n, n_all)
            p = by_three(weights3, f3, by_two(weights2, f2, f1, 1.0 / (v_all + 1), c2), c3)
            add = lambda x: np.add.reduceat(x, np.cumsum(n) - n)
            known, base, total = add((counts[0] > 0).astype(np.int64)), add(np.log10((counts[0] + 0.5) / floor)), add(np.log10(p))
        else:
            n = known = np.empty(0, np.int64)
            base = total = np.empty(0)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(map(is_held_out, ids), pa.bool_()), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([n_all] * len(ids), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(total, pa.float64())})

    known = told.select(F.col("child").alias("block"), "kind", "range", "a")
    return blocks.select(F.col("doc_id").cast("long"), "block", "text").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lambda l, r: list(trimmed([score(l, r)]))[0], SCORED)
