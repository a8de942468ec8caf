"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Texts become token ids (words are encoded once and remembered by a 64-bit hash). Pieces of at most
SEQUENCE tokens are dealt to shards of equal size by a hash. In every shard ISLANDS populations of
whole packings evolve apart: crossover injects well-filled bins of one parent into the other,
removes the bins that hold the same pieces, and best-fits the pieces that lost their bin. After
each epoch every island keeps its ELITE best packings and gets the best of its neighbour; at the end the best packing of a shard's
islands is used. A shard that reaches the lower bound stops at once.

Null text: empty, one piece of the end id. Repeated rows, also of null doc_id, are packed each by
itself; pieces of one size are alike to the search, which takes them in the order of their rows. A
very long text is held by one task as text and ids; its whole pieces join no shard and have a
sequence each. An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stridegraph.llm.bytewords import SPACE, hashes, runs
from stridegraph.llm.common import Scratch, trimmed

#: Production parameters: ids of a sequence and the id that ends a document; pieces of a shard, islands, epochs, generations of an epoch, packings of an island, and how many of them an island keeps from epoch to epoch.
SEQUENCE, END = 2048, 0
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITE = 4096, 2, 3, 16, 8, 3
#: Part of the capacity from which a bin counts as well filled, part of those bins that crossover injects, and part of the bins that mutation empties.
WELL, INJECTED, EMPTIED = 0.985, 0.3, 0.02


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes: those of the tokenizer as its file has it.

    A space between two other characters always begins a new unit of this vocabulary's splitting
    rule, so units are encoded by themselves and remembered by hash, new ones from the same
    vocabulary's rank file, which gives the same ids sooner (a test holds it to that). The tokenizer
    itself encodes, whole, texts in which white space meets a space, those with letters beyond Latin
    and those that hold the string of an added token.
    """

    limit = 500_000
    _other = re.compile("[^\x00-\u024f]")
    line = 198  # the id of a line feed by itself

    def __init__(self, path: str, ranks: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.path, self.model = path, None
        with open(path, encoding="utf-8") as f:
            head = f.read()
        self.added = [t["content"].encode() for t in json.JSONDecoder().raw_decode(head, head.index("[", head.index('"added_tokens"')))[0]]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.latin = tiktoken.Encoding("latin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        if self.model is None:  # large, and seldom needed
            self.model = Tokenizer.from_file(self.path)
        return [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def one(self, text: str) -> np.ndarray:
        """Of a text without added tokens."""
        return self.plain([text])[0] if self._other.search(text) else np.array(self.latin.encode_ordinary(text), "<u4")

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Remembers the ids of new words, each with a space before it; those without line feeds are encoded as the lines of one text."""
        flat = [i for i, w in enumerate(words) if b"\n" not in w]
        bent = [i for i, w in enumerate(words) if b"\n" in w]
        ids = np.array(self.latin.encode_ordinary("\n".join([" " + words[i].decode() for i in flat])), "<u4")
        line = ids == self.line
        if line.sum() != max(0, len(flat) - 1):
            flat, bent, ids, line = [], list(range(len(words))), ids[:0], line[:0]
        sizes = np.diff(np.concatenate(([-1], np.flatnonzero(line), [len(ids)]))) - 1 if flat else np.empty(0, np.int64)
        rest = [self.one(" " + words[i].decode()) for i in bent]
        size = np.concatenate([sizes, np.fromiter(map(len, rest), np.int64, len(rest))]).astype(np.int64)
        at = np.cumsum(size) - size + len(self.ids)
        self.ids = np.concatenate([self.ids, ids[~line], *rest])
        keys = keys[flat + bent]
        order = np.argsort(keys)
        into = np.searchsorted(self.keys, keys[order])
        self.keys, self.at, self.size = np.insert(self.keys, into, keys[order]), np.insert(self.at, into, at[order]), np.insert(self.size, into, size[order])

    def units(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of what follows the first space of each text."""
        buf = np.frombuffer(b" ".join(texts), np.uint8)
        begins, ends = runs(buf == 32)
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        keys = hashes(buf, begins, ends)
        first = np.zeros(len(keys), bool)
        starts = stops - np.fromiter(map(len, texts), np.int64, len(texts)) - 1
        where = np.searchsorted(begins, starts)
        inside = where < len(begins)
        where = where[inside]
        first[where[begins[where] == starts[inside]]] = True  # a text's first unit has no space before it
        keys, begins, ends = keys[~first], begins[~first], ends[~first]
        per = np.diff(np.concatenate(([0], np.searchsorted(begins, stops))))
        distinct, lead, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.limit:
            self.forget()
        place = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        new = self.keys[place] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            raw = buf.tobytes()
            self.learn(distinct[new], [raw[a:b] for a, b in zip(begins[lead[new]].tolist(), ends[lead[new]].tolist())])
        if not len(keys):
            return [np.empty(0, "<u4")] * len(texts)
        entry = np.searchsorted(self.keys, distinct)[back]
        size = self.size[entry]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[entry] - (upto - size), size) + np.arange(upto[-1])]
        return np.split(ids, np.concatenate(([0], upto))[np.cumsum(per)[:-1]])

    def __call__(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        buf = np.frombuffer(b"\0".join(raw) + b"\0\0", np.uint8)
        here, there = buf[:-1], buf[1:]
        # white space beside a space, white space of other kinds, and letters beyond Latin
        odd = (SPACE[here] & (there == 32)) | ((here == 32) & (SPACE[there] | (there == 0))) | ((here >= 28) & (here < 32))
        odd |= ((here == 0xC2) & ((there == 0x85) | (there == 0xA0))) | (here >= 0xC9)
        stops = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        seen = np.concatenate(([0], np.cumsum(odd)))[np.minimum(stops, len(odd))]
        hard = np.diff(np.concatenate(([0], seen))) > 0
        hard |= np.array([any(a in r for a in self.added) for r in raw], bool)
        out: list = [b""] * len(texts)
        whole, easy = np.flatnonzero(hard).tolist(), np.flatnonzero(~hard).tolist()
        for i, ids in zip(whole, self.plain([texts[i] for i in whole]) if whole else ()):
            out[i] = ids.tobytes()
        if easy:
            for i, ids in zip(easy, self.units([raw[i] for i in easy])):
                out[i] = self.one(texts[i].split(" ", 1)[0]).tobytes() + ids.tobytes()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str, ranks: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, ranks)
    return _encoders[path]


def cuts(total: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than size."""
    first = total % size or size
    return [(0, min(first, total))] + [(s, size) for s in range(first, total, size)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS, size: int = SEQUENCE) -> DataFrame:
    paths = public_tokenizers.path(vocabulary), public_tokenizers.path(ranks)

    def run(batches):
        encode, end = encoder(*paths), np.array([END], "<u4").tobytes()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for lo in range(0, len(ids), 400):
                rows = []
                for i, got in zip(ids[lo : lo + 400], encode(texts[lo : lo + 400])):
                    got += end
                    for k, (s, n) in enumerate(cuts(len(got) // 4, size)):
                        rows.append((i, k, s, n, zlib.crc32(got[4 * s : 4 * (s + n)])))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda batches: trimmed(run(batches)), PIECES)


class Packing:
    """One packing of the pieces of a shard: the bin of each piece; sizes are in descending order."""

    __slots__ = ("at", "load", "worth")

    def __init__(self, at: np.ndarray, sizes: np.ndarray, cap: int) -> None:
        used, self.at = np.unique(at, return_inverse=True)
        self.load = np.bincount(self.at, sizes, len(used)).astype(np.int64)
        self.worth = (-len(used), float(((self.load / cap) ** 2).sum()))


def best_fit(at: np.ndarray, load: np.ndarray, loose: np.ndarray, sizes: np.ndarray, cap: int) -> None:
    """Puts the loose pieces, in their order, each in the fullest bin that has room; at is changed in place."""
    free = cap - load
    room = sorted((int(r), int(b)) for b, r in enumerate(free) if r > 0)
    bins = len(load)
    for i, s in zip(loose.tolist(), sizes[loose].tolist()):
        k = bisect_left(room, (s, -1))
        if k < len(room):
            r, b = room.pop(k)
        else:
            r, b, bins = cap, bins, bins + 1
        at[i] = b
        if r > s:
            insort(room, (r - s, b))


def first_packing(sizes: np.ndarray, cap: int, rng: np.random.Generator, noise: float) -> Packing:
    order = np.argsort(-(sizes * (1 + noise * rng.random(len(sizes)))), kind="stable")
    at = np.zeros(len(sizes), np.int64)
    best_fit(at, np.empty(0, np.int64), order, sizes, cap)
    return Packing(at, sizes, cap)


def crossed(a: Packing, b: Packing, sizes: np.ndarray, cap: int, rng: np.random.Generator) -> Packing:
    good = np.flatnonzero(b.load >= WELL * cap)
    if not len(good):
        good = np.flatnonzero(b.load >= np.quantile(b.load, 0.75))
    chosen = np.zeros(len(b.load), bool)
    chosen[good[rng.random(len(good)) < INJECTED]] = True
    inside = chosen[b.at]
    hit = np.zeros(len(a.load), bool)
    hit[a.at[inside]] = True
    weak = np.flatnonzero(~hit)
    if len(weak):  # mutation: the least filled bins lose their pieces, too
        weak = weak[np.argsort(a.load[weak], kind="stable")[: max(1, int(EMPTIED * len(weak)))]]
        hit[weak] = True
    loose = np.flatnonzero(hit[a.at] & ~inside)
    names = np.full(len(a.load), -1)
    names[~hit] = np.arange((~hit).sum())
    at = names[a.at]
    fresh = np.full(len(b.load), -1)
    fresh[chosen] = np.arange(chosen.sum()) + (~hit).sum()
    at[inside] = fresh[b.at[inside]]
    best_fit(at, np.concatenate([a.load[~hit], b.load[chosen]]), loose, sizes, cap)
    return Packing(at, sizes, cap)


def bound(sizes: np.ndarray, cap: int) -> int:
    """Least number of bins: by volume, and by pieces over half a bin with what fits beside none of them."""
    total = -(-int(sizes.sum()) // cap)
    best = total
    half = sizes[sizes * 2 > cap]
    for k in np.unique(sizes[sizes * 2 <= cap])[:: max(1, len(sizes) // 64)].tolist():
        alone = int((half > cap - k).sum())
        mid = half[half <= cap - k]
        rest = sizes[(sizes * 2 <= cap) & (sizes >= k)]
        spare = len(mid) * cap - int(mid.sum())
        best = max(best, alone + len(mid) + max(0, -(-(int(rest.sum()) - spare) // cap)))
    return max(best, len(half))


def evolve(sizes: np.ndarray, cap: int, seed: int, guests: list[np.ndarray], generations: int = GENERATIONS, population: int = POPULATION) -> list[Packing]:
    """One epoch of one island; the best packing is first. guests: packings from this island and its neighbour."""
    rng = np.random.default_rng(seed)
    least = bound(sizes, cap)
    pool = sorted((Packing(g, sizes, cap) for g in guests), key=lambda p: p.worth, reverse=True)
    if pool and -pool[0].worth[0] <= least:
        return pool
    while len(pool) < population:
        pool.append(first_packing(sizes, cap, rng, 0.0 if not pool else 0.08 * len(pool)))
        if -pool[-1].worth[0] <= least:
            return [pool[-1]]
    for _ in range(generations):
        pool.sort(key=lambda p: p.worth, reverse=True)
        if -pool[0].worth[0] <= least:
            break
        children = []
        for _ in range(population):
            i, j = sorted(rng.choice(len(pool), 2, replace=False))
            children.append(crossed(*((pool[i], pool[j]) if rng.random() < 0.5 else (pool[j], pool[i])), sizes, cap, rng))
        pool = sorted(pool + children, key=lambda p: p.worth, reverse=True)[:population]
    return sorted(pool, key=lambda p: p.worth, reverse=True)


def ordered(rows: pa.Table) -> pa.Table:
    """The pieces of a shard in the order in which packings list them."""
    return rows.sort_by([("length", "descending"), ("uid", "ascending")])


STATE = "shard long, island int, bins long, filled double, at binary, rank int"
NAMES, KINDS = [x.split()[0] for x in STATE.split(", ")], (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.int32())


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS, size: int = SEQUENCE) -> DataFrame:
    """Each piece of docs with the sequence that holds it and its place there."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    made = scratch.keep(pieces(docs, vocabulary, ranks, size).withColumn("uid", F.monotonically_increasing_id()))
    part = made.where(F.col("length") < size)
    shards = max(1, round(part.count() / SHARD))
    part = part.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    open_ = part.select("shard", "uid", "length", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"))

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in KINDS], names=NAMES)
        shard, island = left.column("shard")[0].as_py(), left.column("island")[0].as_py()
        sizes = ordered(left).column("length").to_numpy()
        guests = [np.frombuffer(zlib.decompress(x), "<i4").astype(np.int64) for x in right.column("at").to_pylist()]
        best = evolve(sizes, size, shard * 1009 + island * 31 + 7 * len(guests), guests)[:ELITE]
        cols = [shard] * len(best), [island] * len(best), [len(p.load) for p in best], [p.worth[1] for p in best], [zlib.compress(p.at.astype("<i4").tobytes(), 1) for p in best], range(len(best))
        return pa.table([pa.array(c, t) for c, t in zip(cols, KINDS)], names=NAMES)

    state = spark.createDataFrame([], STATE)
    for epoch in range(EPOCHS):
        if epoch:  # the elite of each island also goes to the next one
            state = state.unionByName(state.where("rank = 0").withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int")))
        state = scratch.keep(open_.groupBy("shard", "island").cogroup(state.groupBy("shard", "island")).applyInArrow(step, STATE))
    best = state.groupBy("shard").agg(F.max_by("at", F.struct(-F.col("bins"), "filled", -F.col("island"))).alias("at"))

    out_schema = PIECES + ", sequence_id long, offset long"

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = ordered(left)
        sizes = rows.column("length").to_numpy()
        at = np.frombuffer(zlib.decompress(right.column("at")[0].as_py()), "<i4").astype(np.int64)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(sizes[order])
        starts = ends - sizes[order]
        first = np.r_[True, at[order][1:] != at[order][:-1]]
        offset = np.empty(len(sizes), np.int64)
        offset[order] = starts - np.maximum.accumulate(np.where(first, starts, 0))
        shard = rows.column("shard").to_numpy()
        rows = rows.select([x.split()[0] for x in PIECES.split(", ")])
        return rows.append_column("sequence_id", pa.array(shard * 2**32 + at, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    placed = part.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(place, out_schema)
    # a whole piece has a sequence to itself, whose number is negative
    whole = made.where(F.col("length") >= size).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    return placed.unionByName(whole.select(*placed.columns))
