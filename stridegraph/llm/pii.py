"""Personal data by weak supervision.

Strict patterns give base spans; looser ones give further candidates. Five labelers vote on each
candidate (pattern, check digits, gazetteer, context words, neighbouring characters) or abstain.
Expectation-maximisation estimates how reliable each labeler is and how likely each combination of
votes is a true span; these probabilities train the final classifier, a naive Bayes model over the
span's own features, which decides about candidates. Base spans always stay.

All is built-in functions over one row per document. What reaches the driver is a table of vote
combinations (at most 6 x 3**5 rows) and one of features (at most FEATURES rows).

Null or empty text: no spans. Spans are in code points, end exclusive. Repeated rows give repeated
rows. Further spans that tie in start are taken by kind, then end. Very long texts: a row holds the
parts between the matches of each of the nine patterns. An empty table gives an empty result, and a
model that accepts no further candidates. detected() and digests() read doc_id and text and ignore
other columns.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridegraph.llm.common import Scratch, folded

#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "id", "secret")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: (kind, base, what a text must hold, pattern). A match can only begin at the edge of a run or where the last match ended (\G); so runs are never tried twice.
RULES = (
    (0, True, "@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"),
    (1, True, "digit", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    (2, True, "digit", r"[0-9](?:[\x20-]?[0-9])++"),
    (3, True, "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    (0, False, "at", rf"(?<!{_LOCAL}){_LOCAL}++\x20?[\[({{]\x20?(?:at|AT)\x20?[\])}}]\x20?{_LABEL}++(?:\x20?(?:[\[({{]\x20?(?:dot|DOT)\x20?[\])}}]|\.)\x20?{_LABEL}++)++"),
    (2, False, "digit", r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])"),
    (3, False, "digit", r"(?<![0-9])\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    (4, False, "digit", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])"),
    (5, False, "digit", r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,})|(?i:password|passwd|pwd|token|secret|api[_-]?key)\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_.-]{8,}+[\"']?"),
)
#: Gazetteers: what a true span of a kind often begins or ends with.
GAZETTEER = (
    r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|example|test)$",
    r"^(?!0\.|127\.|255\.|0+[0-9])(?:[1-9][0-9]{0,2})\.",
    r"^(?:4[0-9 -]*|5[1-5][0-9 -]*|2[2-7][0-9 -]*|3[47][0-9 -]*|6(?:011|5)[0-9 -]*)$",
    r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    r"^(?:AT|BE|CH|DE|ES|FR|GB|IE|IT|LU|NL|PL|PT)[0-9]|^(?!000|666|9)[0-9]{3}-(?!00)",
    r"^(?:AKIA|gh[opsu]_|sk-)|(?i:pass|token|secret|key)",
)
CONTEXT = (
    r"(?i)(?:e-?mail|mail|contact|write|correo|courriel|an|to|from)\W*$", r"(?i)(?:ip|host|server|address|adresse|login)\W*$",
    r"(?i)(?:card|visa|master|credit|karte|carte|tarjeta)\W*$", r"(?i)(?:tel|phone|call|fax|mobile|telefon|portable|movil)\W*$",
    r"(?i)(?:ssn|social|iban|konto|account|compte|cuenta)\W*$", r"(?i)(?:aws|key|secret|token|login|user|auth)\W*$",
)
#: Words before a number that is no personal data.
AGAINST = r"(?i)(?:version|isbn|order|figure|page|no\.|item|section|chapter|license|id=)\W*$"
SHAPES, FEATURES, LABELERS = 32, 4000, 5


def length(c: Column) -> Column:
    return F.length(c).cast("long")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the check."""
    rev = F.reverse(d)
    at = lambda i: F.substr(rev, i, F.lit(1)).cast("int")
    twice = lambda i: F.when(at(i) >= 5, 2 * at(i) - 9).otherwise(2 * at(i))
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, at(i)).otherwise(twice(i))) % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def valid(kind: Column, m: Column) -> Column:
    d = digits(m)
    n = F.length(d)
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(kind == 2, F.when((n >= 14) & (n <= 19), luhn(d)).otherwise(F.lit(False)))
        .when(kind == 3, (n >= 10) & (n <= 15))
        .when(kind == 4, F.lit(True))
        .otherwise(m.rlike("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"))
    )


def choose(kind: Column, patterns, c: Column) -> Column:
    out = F.lit(False)
    for k, p in enumerate(patterns):
        out = F.when(kind == k, c.rlike(p)).otherwise(out)
    return out


def vote(yes: Column, no: Column | None = None) -> Column:
    """1, 0, or 2 to abstain."""
    return F.when(yes, F.lit("1")).otherwise(F.when(no, F.lit("0")).otherwise(F.lit("2")) if no is not None else F.lit("2"))


def candidates(docs: DataFrame) -> DataFrame:
    """docs with cands: array of (kind, start, end, base, votes, features), in the order of RULES and of the text.

    A match's place is the sum of what precedes it. The sums are made by blocks of as many matches
    as there are blocks, so a text with n matches takes n**1.5 steps.
    """
    keep = docs.columns
    text = F.col("text")
    has = {"@": text.contains("@"), "+": text.contains("+"), "digit": text.rlike("[0-9]"), "at": text.rlike(r"[\[({]\x20?(?:at|AT)\x20?[\])}]")}
    gates = ["@", "+", "digit", "at"]
    d = docs.select("*", *[has[g].alias(f"_g{i}") for i, g in enumerate(gates)])
    r = range(len(RULES))
    d = d.select(*keep, *[F.when(F.col(f"_g{gates.index(RULES[i][2])}"), F.regexp_extract_all("text", F.lit(RULES[i][3]), F.lit(0))).alias(f"_m{i}") for i in r])
    some = lambda i, e: F.when(F.size(f"_m{i}") > 0, e)
    d = d.select("*", *[some(i, F.split("text", RULES[i][3], -1)).alias(f"_p{i}") for i in r])
    widths = lambda i: F.transform(f"_m{i}", lambda m, k: length(F.get(F.col(f"_p{i}"), k)) + length(m))
    d = d.select("*", *[some(i, widths(i)).alias(f"_l{i}") for i in r], *[some(i, F.ceil(F.sqrt(F.size(f"_m{i}"))).cast("int")).alias(f"_b{i}") for i in r])
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    blocks = lambda i: F.sequence(F.lit(0), F.floor((F.size(f"_m{i}") - 1) / F.col(f"_b{i}")).cast("int"))
    before = lambda i: F.transform(blocks(i), lambda b: total(F.slice(f"_l{i}", F.lit(1), b * F.col(f"_b{i}"))))
    d = d.select("*", *[some(i, before(i)).alias(f"_s{i}") for i in r])

    def spans(i: int) -> Column:
        kind, base, b, p = RULES[i][0], RULES[i][1], F.col(f"_b{i}"), F.col(f"_p{i}")

        def one(m: Column, k: Column) -> Column:
            block = F.floor(k / b).cast("int")
            start = F.get(F.col(f"_s{i}"), block) + total(F.slice(f"_l{i}", block * b + 1, k - block * b)) + length(F.get(p, k))
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), length(m).alias("n"), F.lit(base).alias("base"), m.alias("m"), F.right(F.get(p, k), F.lit(24)).alias("left"), F.left(F.get(p, k + 1), F.lit(4)).alias("right"))

        return F.coalesce(some(i, F.transform(f"_m{i}", one)), F.array().cast("array<struct<kind:int,start:bigint,n:bigint,base:boolean,m:string,left:string,right:string>>"))

    d = d.select(*keep, F.concat(*[spans(i) for i in r]).alias("_c"))

    def judge(c: Column) -> Column:
        kind, m = c["kind"], c["m"]
        ok = valid(kind, m)
        votes = F.concat(
            vote(c["base"] & ok, c["base"]), vote(ok, ~ok), vote(choose(kind, GAZETTEER, m), F.lit(True)), vote(choose(kind, CONTEXT, c["left"]), c["left"].rlike(AGAINST)),
            vote(~c["left"].rlike("[A-Za-z0-9]$") & ~c["right"].rlike("^[A-Za-z0-9]"), F.lit(True)),
        )
        shape = F.pmod(F.crc32(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a").cast("binary")), F.lit(SHAPES))
        side = lambda s, p: F.when(s == "", F.lit("0")).when(s.rlike(p[0]), F.lit("1")).when(s.rlike(p[1]), F.lit("2")).otherwise(F.lit("3"))
        feature = lambda name, v: F.concat_ws(":", F.lit(name), kind.cast("string"), v)
        features = F.array(
            feature("v", votes), feature("s", shape.cast("string")), feature("n", F.least(F.lit(40), F.length(m)).cast("string")),
            feature("l", side(c["left"], (r"\s$", r"[A-Za-z0-9]$"))), feature("r", side(c["right"], (r"^\s", "^[A-Za-z0-9]"))),
        )
        return F.struct(kind.alias("kind"), c["start"].alias("start"), (c["start"] + c["n"]).alias("end"), (c["base"] & ok).alias("base"), votes.alias("votes"), features.alias("features"))

    return d.select(*keep, F.transform("_c", judge).alias("cands"))


def reliabilities(counts: dict[tuple[int, str], int], rounds: int = 100) -> dict[tuple[int, str], float]:
    """Expectation-maximisation over vote combinations: how likely each is a true span.

    Every labeler has a distribution of votes given true and given false; the share of true spans is
    the kind's own. Starts from the share of yes among the votes cast.
    """
    p = {}
    for key in counts:
        cast = [v for v in key[1] if v != "2"]
        p[key] = min(0.95, max(0.05, (cast.count("1") + 0.5) / (len(cast) + 1)))
    for _ in range(rounds):
        share: dict[int, list[float]] = {}
        seen = [[[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]] for _ in range(LABELERS)]
        for (kind, votes), n in counts.items():
            q = p[kind, votes]
            s = share.setdefault(kind, [1.0, 1.0])
            for y, w in ((1, q * n), (0, (1 - q) * n)):
                s[y] += w
                for j, v in enumerate(votes):
                    seen[j][y][int(v)] += w
        new = {}
        for kind, votes in counts:
            odds = math.log(share[kind][1] / share[kind][0])
            for j, v in enumerate(votes):
                odds += math.log(seen[j][1][int(v)] / sum(seen[j][1])) - math.log(seen[j][0][int(v)] / sum(seen[j][0]))
            new[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        moved = max((abs(new[k] - p[k]) for k in p), default=0.0)
        p = new
        if moved < 1e-9:
            break
    return p


def model(cands: DataFrame) -> dict[str, float]:
    """Log odds by feature, and by kind, of the span classifier; cands: a written table with the column cands."""
    flat = cands.select(F.explode("cands").alias("c"))
    rows = flat.groupBy("c.kind", "c.votes").count().collect()  # at most 6 x 3**5
    p = reliabilities({(r["kind"], r["votes"]): r["count"] for r in rows})
    if not p:
        return {}
    chance = F.element_at(F.from_json(F.lit(json.dumps({f"{k}:{v}": x for (k, v), x in p.items()})), "map<string,double>"), F.concat_ws(":", F.col("c.kind").cast("string"), F.col("c.votes")))
    each = flat.select(chance.alias("p"), F.explode(F.concat("c.features", F.array(F.concat(F.lit("k:"), F.col("c.kind").cast("string"))))).alias("f"))
    got = each.groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).limit(FEATURES + 1).collect()
    if len(got) > FEATURES:  # the set of features is smaller, whatever the input
        raise RuntimeError(f"more than {FEATURES} features")
    total = {r["f"][2:]: (r["yes"], r["no"]) for r in got if r["f"].startswith("k:")}
    out = {}
    for r in got:
        if r["f"].startswith("k:"):
            out[r["f"]] = math.log((r["yes"] + 1) / (r["no"] + 1))
        else:
            yes, no = total[r["f"].split(":")[1]]
            out[r["f"]] = math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1))
    return out


def found(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Replaces cands by base and spans: arrays of (start, kind, end) in order.

    A further candidate is accepted if the classifier says so and it meets no base span and no
    accepted candidate that begins before it.
    """
    keep = [c for c in df.columns if c != "cands"]
    table = F.from_json(F.lit(json.dumps(weights)), "map<string,double>")
    of = lambda f: F.coalesce(F.element_at(table, f), F.lit(0.0))
    score = lambda c: F.aggregate(c["features"], of(F.concat(F.lit("k:"), c["kind"].cast("string"))), lambda a, f: a + of(f))
    brief = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    d = df.select(*keep, F.array_sort(F.transform(F.filter("cands", lambda c: c["base"]), brief)).alias("base"), F.array_sort(F.transform(F.filter("cands", lambda c: ~c["base"] & (score(c) > 0)), brief)).alias("_more"))
    d = d.select(*keep, "base", F.filter("_more", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))).alias("_more"))
    # in order of start a candidate meets an accepted one just if it begins before the last accepted one's end
    none = F.filter("_more", lambda c: F.lit(False))
    alone = F.aggregate("_more", none, lambda a, c: F.when((F.size(a) > 0) & (F.element_at(a, F.greatest(F.size(a), F.lit(1)))["end"] > c["start"]), a).otherwise(F.concat(a, F.array(c))))
    return d.select(*keep, "base", F.array_sort(F.concat("base", F.when(F.size("_more") > 1, alone).otherwise(F.col("_more")))).alias("spans"))


def listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detected(docs: DataFrame) -> DataFrame:
    """doc_id with base and spans of each document."""
    cands = Scratch(docs.sparkSession, "pii").keep(candidates(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).drop("text"))
    return found(cands, model(cands))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span in the text replaced by its kind in angle brackets, and n_chars set to the new length. All other columns stay, whatever their names."""
    scratch = Scratch(docs.sparkSession, "pii")
    cols = docs.columns
    made = candidates(folded(docs, F.col("text").alias("text")))
    weights = model(scratch.keep(made.select("cands")))
    d = found(made, weights)
    # spans that meet are covered from the first one's start to the furthest end so far
    zero = F.array(F.lit(0).cast("long"))
    d = d.select("*", F.aggregate("spans", zero, lambda a, s: F.concat(a, F.array(F.greatest(F.element_at(a, -1), s["end"].cast("long"))))).alias("_from"))
    name = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    part = lambda a, b: F.substr(F.col("text"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    pieces = F.transform("spans", lambda s, i: F.concat(part(F.get("_from", i), s["start"]), F.when(s["end"] > F.get("_from", i), F.get(name, s["kind"])).otherwise(F.lit(""))))
    last = F.array_max(F.transform("spans", lambda s: s["end"]))
    new = F.when(F.size("spans") > 0, F.concat(F.array_join(pieces, ""), F.substr(F.col("text"), (last + 1).cast("int")))).otherwise(F.col("text"))
    some = F.size("spans") > 0
    d = d.select("row", new.alias("new"), some.alias("some"))
    size = lambda c: F.when(F.col("some"), F.length("new").cast("long")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType)
    own = {"text": lambda c: F.col("new"), "n_chars": size}
    return d.select(*[own.get(c, lambda c: F.col(f"row.`{c}`"))(c).alias(c) for c in cols])


def digests(docs: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return detected(docs).select("doc_id", *[count(k) for k in range(4)], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
