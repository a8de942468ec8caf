"""Document fingerprints: threshold-scaled sketches.

A document's fingerprint holds every five-word shingle hash below a fixed fraction of the hash
range. Fingerprints of any sizes can be merged (union) and give containment estimates, since the
hashes kept of one set are a fixed subset of those kept of a larger one.

Null text: empty. A text of one to four words is one shingle. An empty fingerprint is like another
one only if the texts are equal (likeness 1, else 0). Documents with equal doc_id are ordered by a
hash of the text, then the text; a null doc_id comes last. Repeated rows follow each other. A single
document is its own next one. Very long texts: a task holds two of them, and a batch. An empty table
gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridegraph.llm.bytewords import mixed
from stridegraph.llm.common import tasks_for

#: Production parameters: words per shingle, and the part of all hashes that is kept.
SHINGLE, FRACTION = 5, 0.25
_ROUND = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word bytes to 64-bit hash; forgets all when it holds too many, so its memory is bounded."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(words: list[bytes], memo: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Distinct hashes, ascending, of the k-word shingles; of all words if they are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mixed(out * _ROUND + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def sketch(text: str, memo: WordHashes, k: int = SHINGLE, fraction: float = FRACTION) -> np.ndarray:
    got = shingle_hashes(text.encode("utf-8", "replace").split(), memo, k)
    return got[got < np.uint64(min(2**64 - 1, int(fraction * 2**64)))]


def to_text(s: np.ndarray) -> str:
    """16 hex digits per hash, ascending."""
    return s.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float | None:
    """Estimated part of the smaller set that the other one holds; None if a sketch is empty."""
    if not len(a) or not len(b):
        return None
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: Rows of a range.
ROWS = 20_000


def _key(doc_id: Column) -> Column:
    """Ascending where doc_id descends; nulls last."""
    return F.coalesce(F.bitwise_not(doc_id.cast("long")), F.lit(2**63 - 1))


class Ranges:
    """Ranges of rows in order of (key, mark); each begins with the last of the starts that is not above it."""

    def __init__(self, starts: list[tuple[int, int]]) -> None:
        self.keys, self.marks = (np.array(c, np.int64) for c in zip(*starts))

    def __len__(self) -> int:
        return len(self.keys)

    def of(self, key: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of each row, and whether the row equals its start."""
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        while (on := low < high).any():  # among the starts of one key, by the mark
            mid = (low + high) // 2
            up = on & (self.marks[np.minimum(mid, len(self) - 1)] <= mark)
            low, high = np.where(up, mid + 1, low), np.where(on & ~up, mid, high)
        at = np.maximum(low - 1, 0)
        return at, (self.keys[at] == key) & (self.marks[at] == mark)

    def column(self):
        """A function of (key, mark) to struct(part, first)."""

        @F.pandas_udf("part int, first boolean")
        def place(key: pd.Series, mark: pd.Series) -> pd.DataFrame:
            at, first = self.of(key.to_numpy(), mark.to_numpy())
            return pd.DataFrame({"part": at.astype(np.int32), "first": first})

        return place


def ranges(rows: DataFrame, size: int) -> Ranges:
    """Of rows (key, mark): ranges that begin at a row each.

    Cuts are quantiles of the keys; a key that covers several is cut evenly by its marks. Then the
    least row of each range is found. A number or two per task reach the driver, as for any range partitioning.
    """
    n, least = rows.agg(F.count(F.lit(1)), F.min("key")).first()
    parts = max(1, min(tasks_for(rows.sparkSession, n // size + 1), n))
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0] if parts > 1 else []
    starts = {(least or 0, -(2**63))}
    for k, times in Counter(cuts or []).items():
        starts |= {(k, -(2**63) + (i * 2**64) // times) for i in range(times)}
    rough = Ranges(sorted(starts))
    at = rough.column()(F.col("key"), F.col("mark"))["part"]
    heads = rows.groupBy(at.alias("part")).agg(F.min(F.struct("key", "mark")).alias("head")).select("head.*").collect()
    return Ranges(sorted(tuple(r) for r in heads)) if heads else rough


def fingerprinted(docs: DataFrame, k: int = SHINGLE, fraction: float = FRACTION, size: int = ROWS) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and its likeness to that and to the next document.

    Rows are dealt to ranges of doc_id and sorted within; the first row of each range also goes to
    the range before it, so that no range needs another. Each task streams its rows in order and
    holds two of them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _key(F.col("doc_id")).alias("key"), F.xxhash64(text).alias("mark"))
    parts = ranges(made.select("key", "mark"), size)
    at, n = F.col("at"), len(parts)
    here = F.struct(at["part"].alias("part"), F.lit(False).alias("tail"))
    there = F.struct(F.pmod(at["part"] - 1, F.lit(n)).cast("int").alias("part"), F.lit(True).alias("tail"))
    rows = made.withColumn("at", parts.column()(F.col("key"), F.col("mark")))
    rows = rows.withColumn("to", F.explode(F.when(at["first"], F.array(here, there)).otherwise(F.array(here))))
    rows = rows.select("to.part", "to.tail", "doc_id", "text", "key", "mark").repartitionById(n, "part")
    rows = rows.sortWithinPartitions("part", "tail", "key", "mark", "text").select("part", "tail", "doc_id", "text")

    def run(batches):
        memo = WordHashes()
        out, held, lead, place = [], None, None, None

        def emit(row, following):
            text = row[1]
            new = edited(text, following[1])
            a, b = row[2], sketch(new, memo, k, fraction)
            if following[2] is None:
                following[2] = sketch(following[1], memo, k, fraction)
            near = [containment(a, b), containment(a, following[2])]
            near = [float(same) if x is None else x for x, same in zip(near, (text == new, text == following[1]))]
            out.append((row[0], len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), to_text(a), to_text(b), *near))

        def flush():
            cols = list(zip(*out)) or [[] for _ in range(7)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)
            out.clear()
            return made

        for batch in batches:
            for part, tail, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if part != place:
                    if held:
                        emit(held, lead)
                    held, lead, place = None, None, part
                row = [doc, text, None]
                if held:
                    row[2] = sketch(text, memo, k, fraction)
                    emit(held, row)
                held = None
                if not tail:
                    if row[2] is None:
                        row[2] = sketch(text, memo, k, fraction)
                    held, lead = row, lead or row
                if len(out) >= 500:
                    yield flush()
        if held:
            emit(held, lead)
        yield flush()

    return rows.mapInArrow(run, SCHEMA)
