"""Mixing sources to target weights by nested hash thresholds.

Each document has a hash of 60 bits and a tie of 60 bits, which only tells rows of one hash apart.
Sizes are summed by source and leading bits; running sums over these few bins find the bin in which
a source's budget ends; only that bin is binned again by further bits, until it holds one document.
Documents below the threshold are taken. No step sorts documents, and a larger budget always takes
a superset (nested budgets). Running sums go over 64 coarse bins of a source, then over the 64 fine
ones of a single coarse bin, so a source of any size is no burden for a task.

Nulls: a null text has size 0, a null source is a source of its own and comes last, a null doc_id
hashes like any value. Rows that agree in doc_id and text have one hash; their ties split them, so
as many are taken as the budget wants, and which of them does not show in the result. A source of
size 0 has target 0. Texts of any length are only counted. An empty table gives an empty result.
mix() reads doc_id, text and source and ignores other columns; repeated() returns all columns as
they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stridegraph.llm.common import Scratch, folded, n_words, small

#: Production parameters: weights by place in the order of sources, share of all sizes, and most repeats of a document.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Bits of the hash and of the tie, and bits of a round, dealt to coarse and fine bins.
BITS, STEP = 60, 12
#: Sources numbered by a task.
SOURCES = 20_000


def marked(docs: DataFrame) -> DataFrame:
    """docs folded, with source, size, hash and tie of each row. Write it before use: ties hold for one writing."""
    key = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("text")).cast("binary"))
    own = F.conv(F.substring(key, 1, BITS // 4), 16, 10).cast("long")
    tie = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS)
    return folded(docs, F.col("source").alias("source"), n_words(F.col("text")).alias("size"), own.alias("hash"), tie.alias("tie"))


def source_key(source: Column) -> Column:
    """Null-safe join key of a source."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def in_order(scratch: Scratch, sources: DataFrame) -> DataFrame:
    """sources with place, their number in the order of code points, null last. Counted within ranges, whose sizes are summed up."""
    parts = sources.count() // SOURCES + 1
    dealt = scratch.keep(sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per range
    starts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))
    place = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.join(starts, "part").withColumn("place", place).drop("part", "before")


def targets(scratch: Scratch, base: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """One row per source: key, source, source_size, target.

    Shares the budget by weight; a source whose part exceeds its limit keeps the limit and the
    excess goes to the others by weight, until none is above: each pass is one aggregation of the
    table of sources, of which only two sums reach the driver.
    """
    totals = in_order(scratch, scratch.keep(base.groupBy("source").agg(F.sum("size").alias("source_size"))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = scratch.keep(totals.select("source", "source_size", weight.alias("weight"), source_key(F.col("source")).alias("key")))
    budget = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    limit, level = F.col("source_size") * float(repeats), None
    over = lambda x: F.col("weight") * F.lit(x) > limit
    while True:
        at = F.lit(False) if level is None else over(level)
        capped, free = rows.agg(F.sum(F.when(at, limit)), F.sum(F.when(~at, F.col("weight")))).first()
        new = (budget - (capped or 0.0)) / free if free else level
        if new is None or new == level or (level is not None and new < level):
            break
        level = new
    target = F.least(F.col("weight") * F.lit(float(level or 0.0)), limit)
    return scratch.keep(rows.select("key", "source", "source_size", target.alias("target")))


def _edge(bins: DataFrame, by: str) -> DataFrame:
    """Of each key's bins, at most 64, the one in which its need ends, with what precedes it; bins has start, what precedes all of them."""
    before = F.col("start") + F.coalesce(F.sum("size").over(W.partitionBy("key").orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = bins.withColumn("before", before).where((F.col("before") < F.col("need")) & (F.col("before") + F.col("size") >= F.col("need")))
    return at.groupBy("key").agg(F.min_by(F.struct(by, "before", "size", "n"), by).alias("e"))


def thresholds(scratch: Scratch, base: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds copies (whole passes over the source), below and below_tie (documents with a smaller (hash, tie) get one more) to goals."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    state = goals.withColumn("copies", whole).withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    state = scratch.keep(state.withColumns({"hash_": zero, "tie_": zero, "open": F.col("need") > 0}))
    base = base.withColumn("key", source_key(F.col("source")))
    half = STEP // 2
    for used in range(STEP, 2 * BITS + 1, STEP):
        word, shift = ("hash", BITS - used) if used <= BITS else ("tie", 2 * BITS - used)
        part = small(state.where("open").select("key", "hash_", "tie_", "need"))
        inside = F.shiftrightunsigned(word, shift + STEP) == F.col(f"{word}_")
        if word == "tie":
            inside &= F.col("hash") == F.col("hash_")
        bins = base.join(part, "key").where(inside).groupBy("key", "need", F.shiftrightunsigned(word, shift).alias("bin"))
        bins = scratch.keep(bins.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).withColumn("coarse", F.shiftrightunsigned("bin", half)))
        coarse = bins.groupBy("key", "need", "coarse").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).withColumn("start", zero)
        first = scratch.keep(_edge(coarse, "coarse").select("key", F.col("e.coarse").alias("coarse"), F.col("e.before").alias("start")))
        edge = scratch.keep(_edge(bins.join(small(first), ["key", "coarse"]), "bin"))
        # a bin of one document is taken if most of it is needed
        last = (F.col("e.n") == 1) | F.lit(used == 2 * BITS)
        take = ((F.col("need") - F.col("e.before")) * 2 >= F.col("e.size")).cast("long")
        found = F.col("open") & F.col("e").isNotNull()
        # closed states keep their threshold as bits of the full width; the hash of an open one is full from the tie on
        at = F.when(found, F.when(last, F.shiftleft(F.col("e.bin") + take, shift)).otherwise(F.col("e.bin"))).otherwise(F.col(f"{word}_"))
        state = scratch.keep(
            state.join(small(edge), "key", "left").select(
                *[c for c in state.columns if c not in ("need", f"{word}_", "open")],
                F.when(found, F.col("need") - F.col("e.before")).otherwise(F.col("need")).alias("need"),
                at.alias(f"{word}_"),
                (found & ~last).alias("open"),
            )
        )
        if state.where("open").isEmpty():
            break
    return state.select("key", "source_size", "target", "copies", F.col("hash_").alias("below"), F.col("tie_").alias("below_tie"))


def _copies() -> Column:
    more = (F.col("hash") < F.col("below")) | ((F.col("hash") == F.col("below")) & (F.col("tie") < F.col("below_tie")))
    return F.col("copies") + more.cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of each row of docs."""
    scratch = Scratch(docs.sparkSession, "mix")
    base = scratch.keep(marked(docs.select("doc_id", "text", "source")).select(F.col("row.doc_id").alias("doc_id"), "source", "size", "hash", "tie"))
    plan = thresholds(scratch, base, targets(scratch, base, weights, share, repeats))
    got = base.withColumn("key", source_key(F.col("source"))).join(small(plan), "key", "left").withColumn("copies", _copies())
    return got.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeated(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with its own columns."""
    scratch = Scratch(docs.sparkSession, "mix")
    base = scratch.keep(marked(docs))
    plan = small(thresholds(scratch, base, targets(scratch, base, weights, share, repeats)))
    out = base.withColumn("key", source_key(F.col("source"))).join(plan, "key").withColumn("n", _copies()).where("n > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("row.*")


#: The same in SQL: sources by level of the water that fills them, documents by running sums over their hashes.
MIX_SQL = r"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
 ('0x' || substr(md5(concat_ws('|', doc_id::varchar, text)), 1, 15))::bigint as h from documents),
s as (select source, sum(size)::double as total, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w from d group by source),
r as (select *, coalesce(sum(2 * total) over q, 0) as full_before, sum(w) over (order by 2 * total / w desc, source desc nulls last) as w_from from s window q as (order by 2 * total / w, source nulls first rows between unbounded preceding and 1 preceding)),
l as (select arg_min(level, top) as level from (select (1.5 * (select sum(total) from s) - full_before) / w_from as level, 2 * total / w as top from r) where top >= level),
t as (select source, total, case when (select level from l) is null then 2 * total else least(w * (select level from l), 2 * total) end as target from s),
g as (select *, case when total > 0 then floor(target / total) else 0 end as copies from t),
o as (select d.*, g.total, g.target, g.copies, g.target - g.copies * g.total as need, coalesce(sum(size) over (partition by d.source order by h, doc_id rows between unbounded preceding and 1 preceding), 0) as before from d join g on d.source is not distinct from g.source)
select doc_id, size, total::bigint as source_size, target, (size * (copies + case when before < need and (before + size < need or (need - before) * 2 >= size) then 1 else 0 end))::bigint as taken from o"""
