"""What the contracts fix of op1, op8, op9 and op10, as queries with the same in SQL.

The method's own columns (verdicts, further spans, scores, fingerprints) have no SQL; these queries
take the other columns from the results of the operators, over all documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stridegraph.llm import fingerprints, lm, pii, quality_rules
from stridegraph.llm.common import table


def base_quality_rules(spark, sf_dir):
    got = quality_rules.judged(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_lm_scores(spark, sf_dir):
    """Sums of logarithms are rounded, as their order is not fixed."""
    got = lm.scored(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base_pii(spark, sf_dir):
    return pii.digests(table(spark, sf_dir, "documents")).drop("spans")


def base_fingerprints(spark, sf_dir):
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


#: Windows of three words by place; those found twice cover three words each.
RULES_SQL = r"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
e as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select r, unnest(list_transform(range(1, len(w) - 1), lambda i: {'i': i, 'g': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}), recursive := true) from e),
c as (select r, i, count(*) over (partition by r, g) as n from g),
x as (select r, count(distinct i + k) as n_repeat from c, (values (0), (1), (2)) as o(k) where n > 1 group by r),
y as (select e.*, coalesce(n_repeat, 0)::bigint as n_repeat_words, len(w)::bigint as n_words from e left join x using (r))
select doc_id, n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
 (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from y"""

#: crc32 bit by bit over the digits of doc_id; the token of an end is null among words.
LM_SQL = r"""with d as (select row_number() over () as r, doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end))), 4294967295) % 5 = 1 as held_out,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
k as (select r, doc_id, held_out, unnest(list_append(w, null)) as token from d),
c as (select token, count(*) as c from k where not held_out group by token),
n as (select coalesce(sum(c), 0)::bigint as n, count(*) as v from c)
select doc_id, held_out, count(*) as n_tokens, count(c.c) as n_known, any_value(n.n) as train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.5) / (n.n + 0.5 * (n.v + 1)))), 4) as base_score
from k left join c on k.token is not distinct from c.token cross join n group by r, doc_id, held_out"""

_ONE = r"select r, {k} as k, '{kind}' as kind, regexp_extract_all(t, '{p}') as m, string_split_regex(t, '{p}') as s from d"
#: Fixed by the contract: kinds and base patterns.
_BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: A match begins after all parts between matches, and all matches, before it.
PII_SQL = rf"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
e as ({" union all ".join(_ONE.format(k=k, kind=kind, p=p) for k, (kind, p) in enumerate(_BASE))}),
f as (select r, k, kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'i': i, 'm': m[i], 'n': length(m[i]), 'gap': length(s[i])}}), recursive := true) from e),
g as (select *, (sum(gap + n) over (partition by r, k order by i))::bigint as stop, regexp_replace(m, '[^0-9]', '', 'g') as digits from f),
v as (select r, k, kind, stop - n as start, stop from g where case k when 0 then true when 1 then list_max(list_transform(string_split(m, '.'), lambda x: x::double)) <= 255
 when 2 then length(digits) between 14 and 19 and list_sum(list_transform(range(1, length(digits) + 1), lambda i: (1 + (i + 1) % 2) * digits[-i]::int - case when i % 2 = 0 and digits[-i]::int > 4 then 9 else 0 end)) % 10 = 0
 else length(digits) between 10 and 15 end)
select doc_id, count(*) filter (k = 0) as n_email, count(*) filter (k = 1) as n_ip, count(*) filter (k = 2) as n_card, count(*) filter (k = 3) as n_phone,
 sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, k), '')) as base_sha256 from d left join v using (r) group by r, doc_id"""

FINGERPRINTS_SQL = """with d as (select doc_id, coalesce(text, '') as t from documents),
e as (select *, coalesce(lead(t) over q, first_value(t) over q) as next, length(t) as n from d window q as (order by doc_id desc nulls last))
select doc_id, n::bigint as n_chars, sha256(left(t, n - n // 2) || left(next, n // 2)) as edited_sha256 from e"""

QUERIES = {f.__name__: f for f in (base_quality_rules, base_lm_scores, base_pii, base_fingerprints)}
ORACLES = {"base_quality_rules": RULES_SQL, "base_lm_scores": LM_SQL, "base_pii": PII_SQL, "base_fingerprints": FINGERPRINTS_SQL}
