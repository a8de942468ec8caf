"""Quality rules: robust multivariate outliers among transformed text statistics.

Minimum-covariance-determinant estimates are made for each language and source: from two
deterministic starts, concentration steps keep the HALF of a group's vectors that lie nearest (by
Mahalanobis distance) to the mean of those kept before, until the determinants settle; of the two,
the estimate with the smaller determinant is reweighted, and vectors beyond the cut are rejected. A
step is one aggregation: vectors are summed by group and distance bin, and the bins that hold the
nearest part are added up; of the last of them, 1/16 of a doubling wide, every vector counts by the
part that is wanted, so the subset has its exact size without a sort. All is made of built-in
functions; sums are pre-aggregated, so a group of any size is no burden for a task.

Groups of under LEAST vectors, too few for a determinant, are pooled by language, those pools if small
in one; a pool that is small still gives no verdict. A floor is added to each variance, as most documents agree in some
statistics. Null text: no words, so base_failed. Null lang or source: a group of its own.
Repeated rows count each, and vectors that tie are alike to the estimates. Very long texts: the words
of one are held as an array. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stridegraph.llm.common import Scratch, small, words_of

#: Fixed by the contract of the base rules.
MIN_WORDS, SYMBOLS = 50, r"[#*$%&|<>]"
#: Production parameters: part of a group that the determinant is minimised over, most steps, least group (twice as many vectors as the determinant needs), change of the determinants' logarithm at which steps end, floors of the standard deviations, and the part of a normal sample beyond the cut.
HALF, STEPS, LEAST, SETTLED = 0.75, 12, 10, 1e-6
FLOOR = (0.08, 0.04, 0.08, 0.08)
BEYOND = 1e-6
P = len(FLOOR)
#: Distance bins per doubling.
FINE = 16


def chi2_cdf(x: float, k: int) -> float:
    """For an even k."""
    term = total = 1.0
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return low


def consistent(part: float) -> float:
    """By how much the covariance of the nearest part of a normal sample is too small."""
    return part / chi2_cdf(chi2_quantile(part, P), P + 2)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text.

    Words in repeated windows: a long per window holds the upper bits of its hash and its place, so
    sorting longs brings equal windows together; neighbours with equal bits are compared word by word,
    and if they differ, all windows of the text with these bits.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", "source", text.alias("t")).select("*", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("w")
    d = d.select(
        "doc_id", "lang", "source", "w",
        n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.length("t").cast("long").alias("n_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n < 2**20, F.lit(2**20 - 1)).otherwise(F.lit(2**31 - 1)).cast("long").alias("low"),
    )
    word = lambda i: F.get(F.col("w"), i)
    key = lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)).bitwiseAND(F.bitwise_not("low")).bitwiseOR(i.cast("long"))
    windows = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), key)).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("s", F.sort_array(windows))

    def same(a: Column, b: Column) -> Column:
        at = [x.bitwiseAND(F.col("low")).cast("int") for x in (a, b)]
        return (a.bitwiseAND(F.bitwise_not("low")) == b.bitwiseAND(F.bitwise_not("low"))) & (word(at[0]) == word(at[1])) & (word(at[0] + 1) == word(at[1] + 1)) & (word(at[0] + 2) == word(at[1] + 2))

    # windows with equal bits, which are few, stand side by side; those of them that differ may hide an equal one, so all are looked through
    upper = lambda x: x.bitwiseAND(F.bitwise_not("low"))
    at = lambda c, k: F.get(F.col(c), k)
    d = d.withColumn("s", F.filter("s", lambda x, k: F.coalesce(upper(x) == upper(at("s", k - 1)), F.lit(False)) | F.coalesce(upper(x) == upper(at("s", k + 1)), F.lit(False))))
    beside = lambda x, k: F.coalesce(same(x, at("s", k - 1)), F.lit(False)) | F.coalesce(same(x, at("s", k + 1)), F.lit(False))
    twice = F.filter("s", lambda x, k: beside(x, k) | F.exists("s", lambda y: (x != y) & F.coalesce(same(x, y), F.lit(False))))
    d = d.withColumn("r", twice).drop("s").withColumn("r", F.sort_array(F.transform("r", lambda x: x.bitwiseAND(F.col("low"))))).drop("w", "low")
    step = F.transform("r", lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(F.col("r"), k + 1) - x, F.lit(3).cast("long"))))
    d = d.withColumn("n_repeat_words", F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)).drop("r")
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """Adds x0 to x3; the word length is taken as a logarithm, the share of symbols as a square root."""
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return stats.withColumns({"x0": F.log(F.greatest(part("word_chars", "n_words"), F.lit(1.0))), "x1": F.sqrt(part("n_symbols", "n_chars")), "x2": part("n_dup_lines", "n_lines"), "x3": part("n_repeat_words", "n_words")})


def null_safe(*cols: str) -> Column:
    return F.concat_ws("\u0001", *[F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(c))) for c in cols])


def grouped(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """From each language and source to the group that judges its documents; no row for none."""
    n = rows.where("not base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("in_lang", F.sum(F.when(F.col("n") < LEAST, F.col("n"))).over(W.partitionBy("lang")))
    kind = F.when(F.col("n") >= LEAST, F.concat(F.lit("1"), null_safe("lang", "source"))).when(F.col("in_lang") >= LEAST, F.concat(F.lit("2"), null_safe("lang"))).otherwise(F.lit("3"))
    n = scratch.keep(n.select(null_safe("lang", "source").alias("place"), "n", kind.alias("key")))
    rest = n.where("key = '3'").agg(F.sum("n")).first()[0] or 0
    return (n if rest >= LEAST else n.where("key != '3'")).select("place", "key")


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS]]


def estimate(df: DataFrame, factor: float) -> DataFrame:
    """From sums to the mean and the lower triangle of the covariance's Cholesky root."""
    df = df.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)})
    df = df.withColumns({f"c{i}{j}": F.lit(factor) * (F.greatest(F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"), F.lit(0.0)) if i == j else F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) + F.lit(FLOOR[i] ** 2 if i == j else 0.0) for i, j in PAIRS})
    for i, j in PAIRS:
        rest = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(F.col(f"c{i}{i}") - rest, F.lit(1e-12))) if i == j else (F.col(f"c{i}{j}") - rest) / F.col(f"l{j}{j}"))
    return df


MODEL = [f"m{i}" for i in range(P)] + [f"l{i}{j}" for i, j in PAIRS]


def squared_distance() -> Column:
    """Forward substitution, written out."""
    y: list[Column] = []
    for i in range(P):
        y.append((F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * y[k] for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return sum((v * v for v in y), F.lit(0.0))


def estimates(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """One row per group: key, mean and Cholesky root. rows: key and x0 to x3, written."""
    spread = rows.groupBy("key").agg(*[F.percentile_approx(f"x{i}", [0.1, 0.25, 0.5, 0.75, 0.9], 1000).alias(f"q{i}") for i in range(P)])
    starts = []
    for k, (low, high, width) in enumerate(((1, 3, 1.349), (0, 4, 2.563))):
        middle = {f"m{i}": F.col(f"q{i}")[2] if k == 0 else (F.col(f"q{i}")[0] + F.col(f"q{i}")[4]) / 2 for i in range(P)}
        root = {f"l{i}{j}": F.sqrt(((F.col(f"q{i}")[high] - F.col(f"q{i}")[low]) / width) ** 2 + F.lit(FLOOR[i] ** 2)) if i == j else F.lit(0.0) for i, j in PAIRS}
        starts.append(spread.select("key", F.lit(k).alias("start"), *[v.cast("double").alias(c) for c, v in (middle | root).items()]))
    model = scratch.keep(starts[0].unionByName(starts[1]))
    parts = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in PAIRS]]
    by = ["key", "start"]

    def nearest(g: DataFrame) -> DataFrame:
        """Sums over the nearest HALF; of the bin in which it ends every vector counts by the part that is wanted."""
        before = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        g = g.withColumn("want", F.lit(HALF) * F.sum("n").over(W.partitionBy(*by)) - before).where("want > 0")
        share = F.least(F.lit(1.0), F.col("want") / F.col("n"))
        return g.groupBy(*by).agg(*[F.sum(F.col(c) * share).alias(c) for c in parts])

    size = sum((F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0))
    bin_ = F.floor(F.log2(squared_distance() + 1e-9) * FINE).cast("int")
    for _ in range(STEPS):
        g = rows.join(small(model.select(*by, *MODEL)), "key").groupBy(*by, bin_.alias("bin")).agg(*sums())
        last, model = model, scratch.keep(estimate(scratch.keep(nearest(g)), consistent(HALF)).select(*by, *MODEL))
        moved = model.select(*by, size.alias("a")).join(last.select(*by, size.alias("b")), by).where(F.abs(F.col("a") - F.col("b")) > SETTLED)
        if moved.isEmpty():
            break
    best = model.withColumn("_size", size).groupBy("key").agg(F.min_by(F.struct(*MODEL), F.struct("_size", "start")).alias("_m")).select("key", "_m.*")
    kept = rows.join(small(scratch.keep(best)), "key").where(squared_distance() <= chi2_quantile(0.975, P)).groupBy("key").agg(*sums())
    return scratch.keep(estimate(scratch.keep(kept), consistent(0.975)).select("key", *MODEL))


def judged(docs: DataFrame) -> DataFrame:
    """The counts of each document, base_failed, its squared robust distance (null: no verdict) and kept."""
    scratch = Scratch(docs.sparkSession, "rules")
    rows = scratch.keep(vectors(statistics(docs)))
    places = small(grouped(scratch, rows))
    rows = rows.withColumn("place", null_safe("lang", "source")).join(places, "place", "left")
    model = estimates(scratch, scratch.keep(rows.where("not base_failed and key is not null").select("key", *[f"x{i}" for i in range(P)])))
    cut = chi2_quantile(1 - BEYOND, P)
    out = rows.join(small(model), "key", "left").withColumn("distance2", squared_distance())
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance2") <= cut, F.lit(True))).alias("kept"), "distance2",
    )
