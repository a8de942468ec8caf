"""What the operators of this subpackage share: tables, size-checked broadcasts, components."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridegraph.sources.scratch import Scratch

#: Fixed by the contracts: a word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Rows of a small table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 20_000

#: Most 64-bit words of a filter that every executor holds.
FILTER_WORDS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns of docs as one, row, beside further ones: so names of docs never meet an operator's own. select("row.*") gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows it to be within the bound; call it on written tables only."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sifted(rows: DataFrame, wanted: DataFrame, key: str, words: int = FILTER_WORDS) -> DataFrame:
    """The rows whose key is in wanted (a written table), and about one in a hundred of the others, without a shuffle of rows.

    A Bloom filter of a word for four keys, three bits a key, is broadcast. From 4 * words keys on the
    words fill up, so more of the others pass; a wanted row always does.
    """
    n = min(words, wanted.count() // 4 + 1)
    word, places = F.pmod(F.xxhash64(key), F.lit(n)), F.xxhash64(F.lit(1), key)
    one = [F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", places, F.lit(6 * i)).bitwiseAND(63).cast("int")) for i in range(3)]
    bits = one[0].bitwiseOR(one[1]).bitwiseOR(one[2])
    held = wanted.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_held"))
    return rows.join(F.broadcast(held), (word == F.col("_word")) & (F.col("_held").bitwiseAND(bits) == bits)).drop("_word", "_held")


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def given_back() -> None:
    """Gives what this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def trimmed(batches):
    """Passes batches on; at the end of a task gives back what its worker has freed, as the worker waits for its next task."""
    try:
        yield from batches
    finally:
        given_back()


def tasks_for(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(scratch: Scratch, links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): rows (node, root), root the least node of the component.

    Alternates large-star and small-star steps, so the number of steps is logarithmic. What a step
    looks up is written first: both sides of its join then are plain exchanges, and a hub of any
    degree can be split among tasks. Nulls and loops are dropped; nodes without links have no row.
    """
    e = scratch.keep(links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        # large star: neighbours above a node are tied to the least of its neighbourhood
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")))
        large = scratch.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: neighbours below a node, and the node, are tied to the least of them
        low = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        new = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = scratch.keep(new.distinct())
        # done when nothing hangs deeper than one below its root and each node has one root
        parents = scratch.keep(new.select("v").distinct())
        deep = new.join(parents.withColumnRenamed("v", "p"), F.col("u") == F.col("p")).limit(1).count()
        e = new
        if not deep and not new.groupBy("u").count().where("count > 1").limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(parents.select(F.col("v").alias("node"), F.col("v").alias("root")))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
