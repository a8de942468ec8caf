"""Removal of repeated byte strings by suffix arrays of shards.

Every window of WINDOW bytes that starts at two or more places of all texts is removed where it
stands. A window is named by its anchor, the least hash among its GRAM-byte strings; so equal windows
have equal anchors. Neighbouring windows with one anchor form a context. Three passes over blocks
of documents:

1. Blocks count their contexts by anchor, and a tree of merges (merge_tree) adds the counts up. An
   anchor of one context that holds it once has no repeated window.
2. Blocks send each distinct context whose anchor repeats, as a row. These are dealt by anchor and
   sorted; the contexts of whole anchors are joined to shards of bounded size, whose suffix array is
   made; neighbours in it with a common prefix of WINDOW bytes mark repeated windows. An anchor with
   more than HOT contexts (beside a passage that very many documents share) would be an unbounded
   shard; blocks send two 64-bit hashes of each of its windows to the tree, which counts them.
3. Blocks get the marks of their contexts and windows and remove what these cover.

Nothing is broadcast; a task holds a block, a shard or a range. Contexts are equal if their bytes are;
windows at hot anchors if both hashes are. Null or empty text: nothing to remove. Texts of any length
are cut in segments that overlap by a window; a block has about BLOCK_BYTES, unless one text has more.
Repeated rows, also of one or null doc_id, are copies of each other, so windows in them repeat. An
empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridegraph.llm.bytewords import mixed, powers, running
from stridegraph.llm.common import Scratch, trimmed
from stridegraph.llm.merge_tree import MESSAGE, Tree, in_blocks, in_key_order, table_of
from stridegraph.llm.suffix_array import common_prefixes, suffix_array

#: Production parameters: bytes of a repeated string, of an anchor, contexts (distinct within a block) from which an anchor is hot, bytes of a segment, bytes of a shard, documents of a block.
WINDOW, GRAM, HOT, SEGMENT, SHARD, BLOCK = 200, 64, 1024, 1 << 19, 1 << 18, 4096


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w] for each i, from running values of blocks of w forwards and backwards."""
    n = len(x) - w + 1
    full = -(-len(x) // w) * w
    rows = np.concatenate([x, np.full(full - len(x), x[-1], x.dtype)]).reshape(-1, w)
    ahead = op.accumulate(rows, 1).ravel()
    back = op.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1 : w - 1 + n])


class Contexts:
    """The contexts of some texts: place of the first window, number of windows, anchor, hash of the bytes, whether the anchor stands twice in it."""

    def __init__(self, texts: list[bytes], window: int, gram: int, segment: int = SEGMENT) -> None:
        """texts are laid end to end; places count from the beginning of the first."""
        self.window = window
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = b"".join(texts)
        self.buf = np.frombuffer(self.data, np.uint8)
        stops = np.cumsum(self.sizes)
        parts: list[tuple] = []
        at, end = 0, len(self.data)
        while at + window <= end:
            upto = min(end, at + segment + window - 1)
            parts.append(self._segment(at, upto, stops, window, gram))
            at += segment
        names = ("place", "n", "anchor", "hash", "twice")
        for i, name in enumerate(names):
            setattr(self, name, np.concatenate([p[i] for p in parts]) if parts else np.empty(0, (np.int64, np.int64, np.uint64, np.uint64, bool)[i]))

    def _segment(self, at: int, upto: int, stops: np.ndarray, window: int, gram: int):
        buf = self.buf[at:upto]
        total, inverse = running(buf), powers(len(buf) + 1)[1]
        grams = (total[gram:] - total[:-gram]) * inverse[: len(buf) - gram + 1]
        grams ^= grams >> np.uint64(32)  # a light scramble: only the order must look random
        grams *= np.uint64(0x9E3779B97F4A7C15)
        w = window - gram + 1
        anchor = sliding(grams, w, np.minimum)
        n_places = upto - window + 1 - at
        first, last = (int(np.searchsorted(stops, x, "right")) for x in (at, at + n_places - 1))
        own_stops = stops[first : last + 1]
        stop = np.repeat(own_stops, np.diff(np.concatenate(([at], np.minimum(own_stops, at + n_places)))))
        inside = np.arange(at + window, at + window + n_places) <= stop
        anchor = np.where(inside, anchor, np.uint64(0))
        edge = np.r_[True, (anchor[1:] != anchor[:-1]) | (stop[1:] != stop[:-1])]
        begin = np.flatnonzero(edge)
        n = np.diff(np.append(begin, len(anchor)))
        on = inside[begin]
        begin, n = begin[on], n[on]
        own = anchor[begin]
        # grams that are the anchor of a window over them; only these can make an anchor stand twice
        cover = np.concatenate([np.zeros(w - 1, np.uint64), anchor, np.zeros(w - 1, np.uint64)])
        marked = np.flatnonzero(sliding(cover, w, np.maximum) == grams)
        low, high = np.searchsorted(marked, begin), np.searchsorted(marked, begin + n + w - 1)
        count = high - low
        which = np.repeat(np.arange(len(begin)), count)
        gram_at = marked[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        twice = np.bincount(which, grams[gram_at] == own[which], len(begin)) > 1
        last = begin + n + window - 1
        whole = mixed((total[last] - total[begin]) * inverse[begin] + n.astype(np.uint64))
        return begin + at, n, mixed(own), whole, twice  # least hashes are all small; scrambled, they spread over the ranges

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places and both hashes of all windows of some contexts, given in ascending order."""
        n = self.n[which]
        places = np.repeat(self.place[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = [np.empty(len(places), np.uint64) for _ in range(2)]
        lo = 0
        while lo < len(places):  # by stretches of the text, so that the running sums stay small
            hi = int(np.searchsorted(places, places[lo] + SEGMENT))
            a, b = int(places[lo]), int(places[hi - 1]) + self.window
            p = places[lo:hi] - a
            for k in range(2):
                total, inverse = running(self.buf[a:b], k), powers(b - a + 1, k)[1]
                out[k][lo:hi] = mixed((total[p + self.window] - total[p]) * inverse[p])
            lo = hi
        return places, out


def _anchors(c: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors with the number of their contexts that differ, and whether one repeats within these texts."""
    order = np.lexsort((c.hash, c.anchor))
    anchor, whole, twice = c.anchor[order], c.hash[order], c.twice[order]
    keys, at, n = np.unique(anchor, return_index=True, return_counts=True)
    fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])][: len(anchor)]
    if not len(keys):
        return keys, n, np.empty(0, bool)
    return keys, np.add.reduceat(fresh.astype(np.int64), at), (n > 1) | np.logical_or.reduceat(twice, at)


def repeated_windows(contexts: list[bytes], window: int) -> list[np.ndarray]:
    """Per context, for each window in it, whether it starts at another place of these contexts, too; by one suffix array."""
    data = b"".join(contexts)
    sa = suffix_array(np.frombuffer(data, np.uint8).astype(np.int64) + 1, 256)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    stops = np.cumsum(sizes)
    begin = np.repeat(stops - sizes, sizes)
    start = np.arange(len(data)) - begin <= np.repeat(sizes, sizes) - window  # bytes at which a window starts
    group = np.cumsum(common_prefixes(data, sa) < window)
    on = start[sa]
    n = np.bincount(group[on], minlength=int(group[-1]) + 1 if len(group) else 0)
    out = np.zeros(len(data), bool)
    out[sa[on]] = n[group[on]] > 1
    return [out[b - s : b - window + 1] for s, b in zip(sizes.tolist(), stops.tolist())]


#: What blocks send: messages of hot windows (kinds 1 and 2, a hash each) and contexts (kind 3).
SENT = MESSAGE + ", anchor long, number int, many boolean, data binary"
MARKED = "block string, number int, starts array<int>, lengths array<int>"


def _shard(rows: list[tuple], window: int) -> list[tuple]:
    """Marks of the contexts (block, number, many, data) of some whole anchors."""
    seen: dict[bytes, int] = {}
    many: list[bool] = []
    own = []
    for _, _, more, data in rows:
        i = seen.setdefault(data, len(many))
        if i == len(many):
            many.append(more)
        else:
            many[i] = True
        own.append(i)
    marks = []
    for more, m in zip(many, repeated_windows(list(seen), window)):
        edges = np.array([0, len(m)]) if more else np.flatnonzero(np.diff(np.r_[False, m, False].view(np.int8)))
        marks.append((edges[::2], edges[1::2] - edges[::2]))
    return [(block, number, *marks[i]) for (block, number, _, _), i in zip(rows, own) if len(marks[i][0])]


def _marks(batches, window: int, shard: int):
    """Of rows (anchor, block, number, many, data) in order of anchor: whole anchors, joined up to the size of a shard."""

    def made(rows):
        got = list(zip(*_shard(rows, window))) or [()] * 4
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in c]), pa.int32()), pa.array(np.concatenate([*c, np.empty(0, np.int32)]).astype(np.int32))) for c in got[2:]]
        return pa.RecordBatch.from_arrays([pa.array(got[0], pa.string()), pa.array(got[1], pa.int32()), *lists], names=["block", "number", "starts", "lengths"])

    rows, size, last = [], 0, None
    for b in batches:
        for anchor, *row in zip(*(b.column(i).to_pylist() for i in range(5))):
            if rows and size >= shard and anchor != last:
                yield made(rows)
                rows, size = [], 0
            rows.append(tuple(row))
            size, last = size + len(row[3]), anchor
    if rows:
        yield made(rows)


def _codes(c: Contexts, told: pa.Table, hot: int) -> np.ndarray:
    """Of each context's anchor: 0 does not repeat, 1 repeats, 2 is hot."""
    keys, _, repeats = _anchors(c)
    if not len(keys):
        return np.empty(0, np.int64)
    n = in_key_order(told, 0, "a")
    return np.where(n > hot, 2, (n > 1) | repeats)[np.searchsorted(keys, c.anchor)]


def _sent(c: Contexts, code: np.ndarray):
    """Distinct contexts to send: their places in c, how often they occur; and all contexts of which they are, with the number of each among the distinct ones."""
    which = np.flatnonzero(code == 1)
    order = which[np.lexsort((c.hash[which], c.anchor[which]))]
    fresh = np.r_[True, (c.anchor[order][1:] != c.anchor[order][:-1]) | (c.hash[order][1:] != c.hash[order][:-1])][: len(order)]
    place, stop = c.place[order], c.place[order] + c.n[order] + c.window - 1
    for i in np.flatnonzero(~fresh).tolist():  # equal hashes count only with equal bytes
        if c.data[place[i] : stop[i]] != c.data[place[i - 1] : stop[i - 1]]:
            fresh[i] = True
    number = np.cumsum(fresh) - 1
    return order[fresh], np.bincount(number, minlength=0), order, number


DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard: int = SHARD, with_bytes: bool = False, segment: int = SEGMENT, rows: int = BLOCK, tree: Tree | None = None) -> DataFrame:
    """Per document the digest of what is left; with_bytes adds the bytes that are left as kept."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    blocks = in_blocks(scratch, docs, rows).select(F.col("doc_id").cast("long"), "block", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    tree = tree or Tree.over(blocks)
    make = lambda texts: Contexts(texts, window, gram, segment)

    def counted(batches):
        def tell(block, texts):
            keys, n, repeats = _anchors(make(texts))
            return table_of(tree.messages(0, block, keys, n, repeats), MESSAGE)

        block, texts = None, []
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != block:
                    if texts:
                        yield tell(block, texts)
                    block, texts = k, []
                texts.append(t)
        if texts:
            yield tell(block, texts)

    told = tree.totals(scratch, blocks.select("block", "text").mapInArrow(lambda batches: trimmed(counted(batches)), MESSAGE))
    told = told.select(F.col("child").alias("block"), "kind", "range", "a")

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            block = left.column("block")[0].as_py()
            c = make(sorted(left.column("text").to_pylist()))
            code = _codes(c, right, hot)
            for k, hashes in enumerate(c.windows(np.flatnonzero(code == 2))[1]):
                keys, n = np.unique(hashes, return_counts=True)
                out += [(*m, None, None, None, None) for m in tree.messages(1 + k, block, keys, n, np.zeros(len(n)))]
            lead, times, _, _ = _sent(c, code)
            number = np.argsort(c.place[lead], kind="stable")  # neighbours overlap, which compresses well
            lead, times = lead[number], times[number]
            begin, stop = c.place[lead].tolist(), (c.place[lead] + c.n[lead] + window - 1).tolist()
            for i, anchor, more, x, y in zip(number.tolist(), c.anchor[lead].view(np.int64).tolist(), (times > 1).tolist(), begin, stop):
                out.append((3, None, None, block, None, None, None, anchor, i, more, c.data[x:y]))
        return pa.Table.from_batches([table_of(out, SENT)])

    alone = lambda f: lambda l, r: list(trimmed([f(l, r)]))[0]
    sent = scratch.keep(blocks.select("block", "text").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(alone(send), SENT), "zstd")
    dealt = sent.where("kind = 3").select("anchor", F.col("child").alias("block"), "number", "many", "data").repartition("anchor").sortWithinPartitions("anchor")
    marks = scratch.keep(dealt.mapInArrow(lambda batches: trimmed(_marks(batches, window, shard)), MARKED))
    wins = tree.totals(scratch, sent.where("kind < 3").select(*[x.split()[0] for x in MESSAGE.split(", ")]))
    both = told.unionByName(wins.select(F.col("child").alias("block"), "kind", "range", "a")).unionByName(marks.withColumn("kind", F.lit(3)), allowMissingColumns=True)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = left.column("doc_id").to_pylist(), left.column("text").to_pylist()
        order = sorted(range(len(texts)), key=texts.__getitem__)
        ids, texts = [ids[i] for i in order], [texts[i] for i in order]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        total = int(sizes.sum())
        cover = np.zeros(total + 1, np.int32)
        if len(texts) and right.num_rows:
            c = make(texts)
            code = _codes(c, right, hot)
            _, _, which, number = _sent(c, code)
            own = right.filter(pa.compute.equal(right.column("kind"), 3)).combine_chunks()
            if own.num_rows:
                lists = [own.column(k).combine_chunks() for k in ("starts", "lengths")]
                starts, lengths = (x.flatten().to_numpy().astype(np.int64) for x in lists)
                runs, at = np.zeros(int(number.max()) + 1, np.int64), np.zeros(int(number.max()) + 1, np.int64)
                n = lists[0].value_lengths().to_numpy().astype(np.int64)
                runs[own.column("number").to_numpy()] = n
                at[own.column("number").to_numpy()] = np.cumsum(n) - n
                n = runs[number]
                run = np.repeat(at[number] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                begin = np.repeat(c.place[which], n) + starts[run]
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + lengths[run] + window - 1, -1)
            places, hashes = c.windows(np.flatnonzero(code == 2))
            if len(places):
                for k, h in enumerate(hashes):
                    more = in_key_order(right, 1 + k, "a")[np.unique(h, return_inverse=True)[1]] > 1
                    hashes[k] = more
                places = places[hashes[0] & hashes[1]]
                np.add.at(cover, places, 1)
                np.add.at(cover, places + window, -1)
        gone = np.cumsum(cover)[:total] > 0
        out = []
        at = 0
        buf = np.frombuffer(b"".join(texts), np.uint8)
        for i, t, size in zip(ids, texts, sizes.tolist()):
            g = gone[at : at + size]
            left_ = buf[at : at + size][~g].tobytes() if g.any() else t
            at += size
            out.append((i, size, int(g.sum()), int((g[1:] & ~g[:-1]).sum() + g[:1].sum()), hashlib.sha256(left_).hexdigest(), left_ if with_bytes else None))
        return pa.Table.from_batches([table_of(out, DONE)])

    done = blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(alone(finish), DONE)
    return done if with_bytes else done.drop("kept")
