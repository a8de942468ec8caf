"""N-gram Jaccard self-join by MinHash banding.

Texts are compared as sets of five-word shingles. Copies of a text form one class and are compared
once. A class's MinHash signature is cut in bands; classes that share a band's hash are candidates.
The numbers of bands and rows are chosen so that a pair at the threshold is found with at least the
target recall. Candidates are verified on their full shingle sets.

A band's bucket can hold any number of classes. Classes that share their largest bucket are dealt to
chunks of about BLOCK, which are packed to a row each, so sets are made once; two chunks are compared,
on full sets and in a group of their own, if some bucket has classes of both. So a bucket is compared in blocks, whatever its size, and classes that
only a chain of buckets connects are not. No pairs are emitted: a block returns the number of links
per class and the ties that connect its linked classes, and ties are merged to groups.

Null or empty text: no shingles, so no links; such copies still form a class. A text of one to four
words is one shingle. A null doc_id is a document like others, and stays in one_of_each() only if
its group has no other. Repeated rows are copies. Very long texts: a task holds a batch of 200, or
two chunks. An empty table gives an empty result. joined() reads doc_id and text and ignores other
columns; one_of_each() returns all columns as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridegraph.llm.bytewords import mixed, word_hashes
from stridegraph.llm.common import Scratch, components, folded, sifted, trimmed
from stridegraph.llm.merge_tree import pack, pack_keys, unpack, unpack_keys

#: Production parameters: words per shingle, least similarity (as a fraction), recall of pairs at that similarity, most hash functions, classes per side of a block.
SHINGLE, NUMERATOR, DENOMINATOR, RECALL, HASHES, BLOCK = 5, 4, 5, 0.999, 144, 128
_STEP = np.uint64(0x9E3779B97F4A7C15)


def banding(similarity: float, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, for which enough bands to reach the recall fit in the hashes."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = np.ceil(np.log1p(-recall) / np.log1p(-(similarity**rows))) if similarity < 1 else 1
        if bands * rows > hashes:
            break
        best = (int(bands), rows)
    return best


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending."""
    h, sizes = word_hashes(texts)
    out, at = [], 0
    for n in sizes.tolist():
        w = h[at : at + n]
        at += n
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        m = min(k, n)
        x = np.zeros(n - m + 1, np.uint64)
        for i in range(m):
            x = mixed(x * _STEP + w[i : n - m + 1 + i])
        out.append(np.unique(x))
    return out


class Signer:
    """Band hashes of a shingle set."""

    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.default_rng(7)
        self.a = rng.integers(0, 2**63, (bands * rows, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, (bands * rows, 1), np.uint64)
        self.shape, self.salt = (bands, rows), mixed(np.arange(bands, dtype=np.uint64) + np.uint64(99))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        step = max(1, 60_000 // len(x))  # hash functions at once: as many as stay in the cache
        low = np.concatenate([(self.a[i : i + step] * x + self.b[i : i + step]).min(1) for i in range(0, len(self.a), step)]).reshape(self.shape)
        out = self.salt.copy()
        for r in range(self.shape[1]):
            out = mixed(out * _STEP + low[:, r])
        return out.astype(np.int64)


def copy_key(text: Column) -> Column:
    """128 bits that tell texts apart."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def signatures(texts: DataFrame, bands: int, rows: int, k: int = SHINGLE) -> DataFrame:
    """(doc_id, key, n_grams, bands) of (doc_id, text)."""

    def run(batches):
        sign = Signer(bands, rows)
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                sets = shingle_sets([t or b"" for t in part.column(2).to_pylist()], k)
                marks = [sign(x) if len(x) else [] for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "key", "n_grams", "bands"])

    return texts.select(F.col("doc_id").cast("long"), copy_key(F.col("text")).alias("key"), F.col("text").cast("binary")).mapInArrow(lambda batches: trimmed(run(batches)), "doc_id long, key string, n_grams long, bands array<bigint>")


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, numerator: int, denominator: int) -> np.ndarray:
    """Which sets of a are similar to which of b (of a itself, for None)."""
    sets = a + (b or [])
    sizes = np.array([len(x) for x in sets], np.int64)
    keys, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(at, minlength=len(keys)) > 1
    place = np.cumsum(shared) - 1
    on = shared[at]
    owner, col = owner[on], place[at[on]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    common = np.zeros((len(a), len(b) if b is not None else len(a)), np.float64)
    wide = 1 << 15
    for lo in range(0, int(shared.sum()), wide):
        s = slice(*np.searchsorted(col, (lo, lo + wide)))
        m = np.zeros((len(sets), min(wide, int(shared.sum()) - lo)), np.float32)
        m[owner[s], col[s] - lo] = 1
        common += m[: len(a)] @ (m[len(a) :] if b is not None else m).T
    other = sizes[len(a) :] if b is not None else sizes
    union = sizes[: len(a), None] + other[None, :] - common
    out = (common * denominator >= numerator * union) & (common > 0)
    if b is None:
        np.fill_diagonal(out, False)
    return out


def ties(cid: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """For each the place of the least cid in its group."""
    rank = np.argsort(np.argsort(cid))
    top = list(range(len(cid)))
    for i, j in rank[pairs].tolist():
        while top[i] != i:
            top[i] = i = top[top[i]]
        while top[j] != j:
            top[j] = j = top[top[j]]
        top[max(i, j)] = min(i, j)
    for i in range(len(top)):
        top[i] = top[top[i]]
    return np.argsort(rank)[np.array(top, np.int64)[rank]]


#: A chunk as one row: its classes, and their sets as places in a dictionary of all shingles, which copies mostly share.
PACKED = "cid binary, n binary, sizes binary, dictionary binary, places binary"


def _packed(rows: pa.Table, k: int) -> pa.Table:
    rows = rows.sort_by([("cid", "ascending")])
    sets = shingle_sets([t or b"" for t in rows.column("text").to_pylist()], k)
    dictionary, places = np.unique(np.concatenate(sets), return_inverse=True)
    cols = [pack(rows.column("cid").to_numpy()), pack(rows.column("n").to_numpy()), pack(np.array([len(x) for x in sets])), pack_keys(dictionary), pack(places, "<u4")]
    names = [x.split()[0] for x in PACKED.split(", ")]
    return pa.table([rows.column("chunk").slice(0, 1).combine_chunks(), *(pa.array([c], pa.binary()) for c in cols)], names=["chunk", *names])


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    sizes = unpack(row["sizes"]).astype(np.int64)
    hashes = unpack_keys(row["dictionary"])[unpack(row["places"], "<u4")]
    return unpack(row["cid"]).astype(np.int64), unpack(row["n"]).astype(np.int64), np.split(hashes, np.cumsum(sizes)[:-1])


class Joined:
    """Results of the join, as written tables: docs (doc_id, key) and classes (key, cid, n, first, group, links)."""

    def __init__(self, docs: DataFrame, classes: DataFrame) -> None:
        self.docs, self.classes = docs, classes


def chunked(scratch: Scratch, marks: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """members (cid, chunk) and pairs (i, j) of chunks that share a bucket, i <= j. marks: (cid, mark), written.

    A class's home is the largest of its buckets, so classes that are alike mostly share it; a home is
    dealt to chunks of about block classes. Chunks meet if a bucket has classes of both.
    """
    buckets = scratch.keep(marks.groupBy("mark").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    met = scratch.keep(marks.join(buckets, "mark"))
    homes = scratch.keep(met.groupBy("cid").agg(F.max(F.struct("c", "mark")).alias("home")).select("cid", F.col("home.mark").alias("home")))
    sizes = scratch.keep(homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n")))
    chunk = F.struct("home", F.pmod(F.xxhash64("cid"), F.col("n")).cast("int").alias("part"))
    members = scratch.keep(homes.join(sizes, "home").select("cid", chunk.alias("chunk")))
    at = scratch.keep(met.select("cid", "mark").join(members, "cid").select("mark", "chunk").distinct())
    pairs = at.select("mark", F.col("chunk").alias("i")).join(at.select("mark", F.col("chunk").alias("j")), "mark").where("i <= j")
    return members, scratch.keep(pairs.select("i", "j").distinct())


def join(docs: DataFrame, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, recall: float = RECALL, k: int = SHINGLE, block: int = BLOCK) -> Joined:
    scratch = Scratch(docs.sparkSession, "ngrams")
    bands, rows = banding(numerator / denominator, recall)
    signed = scratch.keep(signatures(docs, bands, rows, k))
    classes = signed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    classes = scratch.keep(classes.withColumn("cid", F.monotonically_increasing_id()))
    members, pairs = chunked(scratch, classes.select("cid", F.explode("bands").alias("mark")), block)

    members = scratch.keep(members.join(classes.select("cid", "key", "n"), "cid"))
    # only texts of members travel, whatever their number; the join with members drops what else the filter lets through
    texts = sifted(docs.select(copy_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text")), members.select("key"), "key")
    texts = texts.groupBy("key").agg(F.first("text").alias("text"))
    alone = lambda f: lambda t: list(trimmed([f(t)]))[0]
    packed = members.join(texts, "key").select("chunk", "cid", "n", "text").groupBy("chunk").applyInArrow(alone(lambda t: _packed(t, k)), "chunk struct<home:long,part:int>, " + PACKED)
    packed = scratch.keep(packed, "zstd")
    sides = pairs.select(F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("chunk"), "i", "j")
    each = packed.join(sides, "chunk").select("i", "j", (F.col("chunk") == F.col("j")).alias("right"), "cid", "n", "sizes", "dictionary", "places")

    def compare(rows_: pa.Table) -> pa.Table:
        sides = [_unpacked(r) for r in sorted(rows_.to_pylist(), key=lambda r: r["right"])]
        cid, n = (np.concatenate([s[c] for s in sides]) for c in (0, 1))
        if len(sides) == 1:
            on = linked(sides[0][2], None, numerator, denominator)
            links = on @ n
            pairs = np.argwhere(np.triu(on))
        else:
            cut = len(sides[0][0])
            on = linked(sides[0][2], sides[1][2], numerator, denominator)
            links = np.concatenate([on @ n[cut:], on.T @ n[:cut]])
            pairs = np.argwhere(on) + np.array([0, cut])
        to = cid[ties(cid, pairs)]
        some = (links > 0) | (to != cid)
        return pa.table({"cid": pa.array(cid[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "to": pa.array(to[some], pa.int64())})

    got = scratch.keep(each.groupBy("i", "j").applyInArrow(alone(compare), "cid long, links long, to long"))
    groups = scratch.keep(components(scratch, got.select(F.col("cid").alias("a"), F.col("to").alias("b"))))
    links = scratch.keep(got.groupBy("cid").agg(F.sum("links").alias("links")))
    info = classes.drop("bands").join(links, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
    info = info.withColumn("group", F.coalesce("root", "cid")).withColumn("links", F.coalesce("links", F.lit(0)) + F.when(F.col("n_grams") > 0, F.col("n") - 1).otherwise(F.lit(0)))
    return Joined(signed.select("doc_id", "key"), scratch.keep(info.select("key", "cid", "n", "first", "group", "links")))


def joined(docs: DataFrame, **options) -> DataFrame:
    """Each document's class (the least doc_id of its near-duplicate group), the number of documents linked to it, and the least doc_id among its copies."""
    made = join(docs, **options)
    scratch = Scratch(docs.sparkSession, "ngrams-out")
    least = scratch.keep(made.classes.groupBy("group").agg(F.min("first").alias("class_id")))
    info = scratch.keep(made.classes.join(least, "group").select("key", "class_id", F.col("links").alias("n_links"), F.col("first").alias("copy_of")))
    return made.docs.join(info, "key").select("doc_id", "class_id", "n_links", "copy_of")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near-duplicates: of each group a row of least doc_id stays, with all its columns."""
    made = join(docs.select("doc_id", "text"), **options)
    scratch = Scratch(docs.sparkSession, "ngrams-out")
    order = F.struct(F.col("first").isNull().alias("none"), "first", "key")
    best = scratch.keep(made.classes.groupBy("group").agg(F.min(order).alias("b")).select("b.*"))
    rows = folded(docs, copy_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("first"), F.col("doc_id").isNull().alias("none"))
    rows = rows.withColumnRenamed("first", "doc")
    kept = rows.join(best, (rows.key == best.key) & (rows.none == best.none) & rows.doc.eqNullSafe(best["first"]), "left_semi")
    # copies of the row that stays, of one doc_id: the least by its columns as JSON
    return kept.groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
