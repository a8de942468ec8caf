"""Totals of counts by 64-bit key over blocks of documents, told back to each block.

A block sends its distinct keys, ascending and cut in ranges of the key space, with two counts each,
a and b. A tree of merges adds them up: a unit joins the messages of some RADIX blocks for one range,
cuts what it gets in RADIX smaller ranges and sends those on, until units hold all blocks' messages
for one small range; answers come back by the same way. So a block or a unit sends as many messages
as the radix, whatever the number of blocks, and neither grows with the input. Each child gets
a's total for all its keys, and the total of a - b for those of its keys of which its own b is not 0.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridegraph.llm.common import Scratch, small, tasks_for

#: Most ranges into which a message is cut, most blocks for one level of merges, and bytes of text of a block.
RADIX, FLAT, BLOCK_BYTES = 256, 1024, 32 << 20
MESSAGE = "kind int, range long, grp long, child string, keys binary, a binary, b binary"
ANSWER = "kind int, range long, child string, a binary, c binary, n_all long, v_all long, n_kept long, v_kept long"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def table_of(rows: list, spec: str) -> pa.RecordBatch:
    fields = [x.split() for x in spec.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def pack(x: np.ndarray, kind: str = "<u8") -> bytes:
    """Byte planes, so that what is zero in most numbers takes no room."""
    raw = np.ascontiguousarray(x, kind)
    return zstandard.ZstdCompressor(level=1).compress(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes())


def unpack(x: bytes, kind: str = "<u8") -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x), dtype=np.uint64)


def cut(keys: np.ndarray, first: int, upto: int, n: int) -> np.ndarray:
    """Where the ranges first to upto of n equal ones of the key space begin in ascending keys, and the end."""
    edges = np.array([(i << 64) // n for i in range(first, upto)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def in_blocks(scratch: Scratch, docs: DataFrame, rows: int, most: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text and block: rows that are neighbours in a file, at most so many, and bytes about so many unless one text has more.

    Rows that come from no files are written first.
    """

    def dealt(df: DataFrame) -> DataFrame:
        place = F.col("_metadata.row_index")
        made = df.select("doc_id", "text", F.concat_ws("#", F.col("_metadata.file_path"), F.floor(place / rows).cast("string")).alias("block"), place.alias("place"))
        made.schema  # noqa: B018  fails without files
        return made

    try:
        got = dealt(docs)
    except AnalysisException:
        got = dealt(scratch.keep(docs.select("doc_id", "text")))
    size = F.sum(F.octet_length("text"))
    heavy = scratch.keep(got.groupBy("block").agg(F.ceil(size / most).cast("int").alias("n")).where("n > 1"))
    if not heavy.isEmpty():
        part = F.concat_ws("/", "block", F.pmod(F.xxhash64("place"), F.col("n")).cast("string"))
        got = got.join(small(heavy), "block", "left").withColumn("block", F.when(F.col("n").isNull(), F.col("block")).otherwise(part))
    return got.select("doc_id", "text", "block")


class Tree:
    def __init__(self, blocks: int, tasks: int, radix: int = RADIX, flat: int = FLAT) -> None:
        if blocks <= flat:
            self.levels, self.radix = 1, max(1, min(radix, max(tasks, blocks // 4)))
        else:
            self.levels = max(2, math.ceil(math.log(blocks) / math.log(radix)))
            self.radix = math.ceil(blocks ** (1 / self.levels))

    def __getstate__(self) -> dict:
        """What executors need."""
        return {"levels": self.levels, "radix": self.radix}

    @classmethod
    def over(cls, blocks: DataFrame) -> "Tree":
        return cls(blocks.select("block").distinct().count(), tasks_for(blocks.sparkSession))

    def messages(self, kind: int, block: str, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple]:
        """Rows of MESSAGE from a block."""
        group = zlib.crc32(block.encode()) % self.radix**self.levels // self.radix
        return self._cut(kind, 0, 1, group if self.levels > 1 else 0, block, keys, a, b)

    def _cut(self, kind, within, level, group, child, keys, a, b) -> list[tuple]:
        r = self.radix
        at = cut(keys, within * r, (within + 1) * r, r**level)
        return [(kind, within * r + i, group, child, pack_keys(keys[x:y]), pack(a[x:y]), pack(b[x:y])) for i, (x, y) in enumerate(zip(at, at[1:])) if y > x]

    def totals(self, scratch: Scratch, asked: DataFrame) -> DataFrame:
        """Answers, as a written table; child is the block. Sums over a kind's numbers are in the topmost answers, which totals_of() reads."""
        radix, levels = self.radix, self.levels

        def joined(rows: pa.Table):
            keys = [unpack_keys(x) for x in rows.column("keys").to_pylist()]
            total, at = np.unique(np.concatenate(keys), return_inverse=True)
            a, b = (np.bincount(at, np.concatenate([unpack(x) for x in rows.column(c).to_pylist()]), len(total)).astype(np.uint64) for c in "ab")
            return total, at, a, b, np.cumsum([0] + [len(k) for k in keys])

        def up(level: int):
            def merge(rows: pa.Table) -> pa.Table:
                kind, within, group = (rows.column(c)[0].as_py() for c in ("kind", "range", "grp"))
                total, _, a, b, _ = joined(rows)
                return pa.Table.from_batches([table_of(self._cut(kind, within, level + 1, group // radix, str(group), total, a, b), MESSAGE)])

            return merge

        def told(rows: pa.Table, at: np.ndarray, stops: np.ndarray, a: np.ndarray, kept: np.ndarray, sums: list[int]) -> pa.Table:
            """An answer to each child; one that sent two messages, as two tasks read it, gets one for both."""
            kind, within = rows.column("kind")[0].as_py(), rows.column("range")[0].as_py()
            own: dict[str, list[int]] = {}
            for i, child in enumerate(rows.column("child").to_pylist()):
                own.setdefault(child, []).append(i)
            b = rows.column("b").to_pylist()
            out = []
            for child, where in own.items():
                all_ = [at[stops[i] : stops[i + 1]] for i in where]
                some = [x[unpack(b[i]) > 0] for i, x in zip(where, all_)]
                x, y = (v[0] if len(v) == 1 else np.unique(np.concatenate(v)) for v in (all_, some))
                out.append((kind, within, child, pack(a[x]), pack(kept[y]), *(sums if not out else [0] * 4)))
            return pa.Table.from_batches([table_of(out, ANSWER)])

        def top(rows: pa.Table) -> pa.Table:
            _, at, a, b, stops = joined(rows)
            kept = a - b
            return told(rows, at, stops, a, kept, [int(a.sum()), int((a > 0).sum()), int(kept.sum()), int((kept > 0).sum())])

        def down(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.Table.from_batches([table_of([], ANSWER)])
            total, at, _, b, stops = joined(left)
            order = np.argsort(right.column("sub").to_numpy(), kind="stable").tolist()
            a, c = (np.concatenate([unpack(x[i]) for i in order]) for x in (right.column("a").to_pylist(), right.column("c").to_pylist()))
            kept = np.zeros(len(total), np.uint64)
            kept[b > 0] = c  # of other keys no child asks for what is kept
            return told(left, at, stops, a, kept, [0] * 4)

        sent = [asked]
        for level in range(1, levels):
            sent[-1] = scratch.keep(sent[-1])
            sent.append(sent[-1].groupBy("kind", "range", "grp").applyInArrow(up(level), MESSAGE))
        answers = self.top = scratch.keep(sent[-1].groupBy("kind", "range").applyInArrow(top, ANSWER))
        for messages in reversed(sent[:-1]):
            back = answers.select("kind", F.floor(F.col("range") / radix).alias("range"), F.col("child").cast("long").alias("grp"), F.col("range").alias("sub"), "a", "c")
            answers = scratch.keep(messages.groupBy("kind", "range", "grp").cogroup(back.groupBy("kind", "range", "grp")).applyInArrow(down, ANSWER))
        return answers

    def totals_of(self, kind: int) -> tuple[int, int, int, int]:
        """Of one kind: sum of a, keys with a, sum of a - b, keys with a - b."""
        got = self.top.where(F.col("kind") == kind).agg(*[F.sum(c) for c in ("n_all", "v_all", "n_kept", "v_kept")]).first()
        return tuple(int(x or 0) for x in got)


def in_key_order(told: pa.Table, kind: int, column: str) -> np.ndarray:
    """A block's answers of one kind, in the order of its ascending keys."""
    kinds, ranges, blobs = told.column("kind").to_numpy(), told.column("range").to_numpy(), told.column(column)
    own = np.flatnonzero(kinds == kind)
    own = own[np.argsort(ranges[own], kind="stable")].tolist()
    return np.concatenate([unpack(blobs[i].as_py()) for i in own] or [np.empty(0, np.uint64)]).astype(np.int64)
