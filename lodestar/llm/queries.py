"""One query per operator, with its production parameters, over the whole of its tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.llm import (code_search, language_id, lexical_search, license_scan, mixing, ngram_join, online_packing,
                          packing, quality, secret_scan, spelling, substring, toxicity)
from lodestar.session import table
from lodestar.llm.catalog import ORACLES, QUERIES, documents, query

BASE_KINDS = ("assign", "access", "hex")


def _span_list(rule, rank):
    """DuckDB list of the spans of one rule in text t."""
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    size = f"regexp_extract_all(t, {pattern}, 0)"
    gaps = f"regexp_split_to_array(t, {pattern})"
    value = f"regexp_extract_all(t, {pattern}, {rule.group})"
    chars = lambda x: f"coalesce(list_sum(list_transform({x}, lambda s: length(s))), 0)"
    at = f"{chars(f'({gaps})[1:i]')} + {chars(f'({size})[1:i-1]')}"
    return (f"case when regexp_matches(t, {pattern}) then list_transform("
            f"list_filter(range(1, len({size}) + 1), lambda i: length(({value})[i]) >= {rule.least}), "
            f"lambda i: {{'start': ({at})::bigint, 'rank': {rank}, 'finish': ({at} + length(({size})[i]))::bigint, "
            f"'kind': '{rule.kind}'}}) else [] end")


def _listed(spans):
    return f"coalesce(array_to_string(list_transform({spans}, lambda x: x.kind || ':' || x.start || ':' || x.finish), ','), '')"


OP8_SQL = f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
found as (select doc_id, list_sort({" || ".join(_span_list(r, i) for i, r in enumerate(secret_scan.RULES))}) as spans
  from docs),
base as (select *, list_filter(spans, lambda x: x.rank < 3) as own from found)
select doc_id, len(list_filter(own, lambda x: x.rank = 0))::bigint as n_assign,
  len(list_filter(own, lambda x: x.rank = 1))::bigint as n_access, len(list_filter(own, lambda x: x.rank = 2))::bigint as n_hex,
  sha256({_listed("own")}) as base_sha256, {_listed("spans")} as spans
from base"""

OP6_SQL = """
with codes as (
  select vec_id, list_transform(embedding[1:64], lambda x: x > 0) as code from embeddings
  where vec_id is not null and len(embedding) >= 64),
pairs as (
  select q.vec_id as query_id, n.vec_id as neighbour_id,
    list_sum(list_transform(range(1, 65), lambda i: (q.code[i] <> n.code[i])::int))::int as distance
  from codes q join codes n on q.vec_id % 100 = 0 and q.vec_id <> n.vec_id)
select *, (row_number() over (partition by query_id order by distance, neighbour_id))::int as rank from pairs
qualify rank <= 10"""


def _mixing_sql(looks=12):
    """Reachable targets by the largest line, raking below each cell's tokens with one step per round and margin.

    Of all looks at the error the first one counts that finds it small enough.
    """
    topic = "".join(f" when regexp_matches(text, '{p}') then '{n}'" for n, p in mixing.TOPICS)
    steps = [f"""d as materialized (
  select doc_id, coalesce(source, '{mixing.UNKNOWN}') as source, coalesce(lang, '{mixing.UNKNOWN}') as lang,
    case{topic} else '{mixing.PROSE}' end as topic,
    coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0)::bigint as n_tokens from documents)""",
             "c as materialized (select source, lang, topic, sum(n_tokens)::bigint as tokens from d group by all)"]
    for m in mixing.MARGINS:
        steps.append(f"""v_{m} as materialized (
  select {m}, own, case when own > 0 then pow(own, {mixing.TEMPER}) else 0 end as target
  from (select {m}, sum(tokens)::double as own from c group by {m}))""")
        steps.append(f"""t_{m} as materialized (
  select {m}, least(own, target * (select max(({mixing.BUDGET} * total - spent) / nullif(rest, 0)) from (
      select sum(own) over () as total, sum(own) over (o rows between unbounded preceding and 1 preceding) as s,
        coalesce(sum(own) over (o rows between unbounded preceding and 1 preceding), 0) as spent,
        sum(target) over (o rows between current row and unbounded following) as rest
      from v_{m} window o as (order by own / nullif(target, 0), {m})))) as t_{m} from v_{m})""")
    steps.append("w0 as materialized (select c.*, tokens::double as weight, t_source, t_lang, t_topic "
                 "from c join t_source using (source) join t_lang using (lang) join t_topic using (topic))")
    names = "source, lang, topic, tokens, t_source, t_lang, t_topic"
    at, seen = 0, []
    for look in range(looks):
        for m in mixing.MARGINS * mixing.ROUNDS:
            steps.append(f"""w{at + 1} as materialized (
  select {names}, weight * coalesce(greatest(t_{m} / nullif(sum(weight) over (partition by {m}), 0),
    max(line) over (partition by {m})), 0) as weight
  from (select *, (t_{m} - sum(case when weight > 0 then tokens else 0 end) over (o rows unbounded preceding))
      / nullif(sum(weight) over (o rows between 1 following and unbounded following), 0) as line
    from w{at} window o as (partition by {m} order by case when weight > 0 then tokens / weight else 'inf'::double end,
      source, lang, topic)))""")
            at += 1
        gaps = " union all ".join(f"select abs(sum(least(tokens, weight)) - max(t_{m})) as gap from w{at} group by {m}"
                                  for m in mixing.MARGINS)
        seen.append(f"select {look} as look, source, lang, topic, tokens, weight, (select max(gap) from ({gaps})) as gap from w{at}")
    return "with " + ",\n".join(steps) + f""",
seen as materialized ({" union all ".join(seen)}),
rates as (select source, lang, topic,
  case when tokens > 0 then round(least(tokens, weight) / tokens, {mixing.DIGITS}) else 0 end as rate from seen
  where look = (select min(look) from seen where gap <= {mixing.TOLERANCE} * (select sum(tokens) from c)))
select doc_id, d.source, d.lang, d.topic, n_tokens, rate,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::ubigint / 4294967296.0 < rate as kept
from d join rates using (source, lang, topic)"""


def _terms(text):
    """DuckDB list of the terms of a text."""
    folded = f"translate({text}, '{lexical_search.UPPER}', '{lexical_search.LOWER}')"
    return f"regexp_extract_all({folded}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


OP12_SQL = f"""
with i as materialized (
  select item_id, term, count(*) as times from (select item_id, unnest({_terms("text")}) as term from benchmark) group by all),
d as materialized (select doc_id, {_terms("text")} as terms from documents where len({_terms("text")}) > 0),
total as (select count(*) as n_docs, sum(len(terms))::bigint as n_terms from d),
m as (select doc_id, 100 - 75 + ((75 * len(terms) * n_docs) // n_terms)::bigint as m from d, total),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(terms) as term from d)
  where term in (select term from i) group by all),
w as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from tf, total group by term),
scored as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from i join tf using (term) join w using (term) join m using (doc_id) group by all)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 10"""

OP11_SQL = """
with recursive tab as materialized (
  select list_transform(range(256), lambda i: list_reduce([i::bigint, 1, 1, 1, 1, 1, 1, 1, 1],
    lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) as t),
found as materialized (
  select doc_id, run, count(*) as times from (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-zÀ-ÿ]+')) as run from documents) where length(run) >= 7 group by all),
hashed as materialized (
  select run, times, xor(list_reduce([4294967295::bigint] || flatten(list_transform(
      string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
      lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end)),
    lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8)), 4294967295::bigint) as h from found, tab),
v as materialized (
  select word, sum(times)::bigint as n from (
    select case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2)
      else run end as word, times from hashed)
  where length(word) >= 7 group by word having sum(times) >= 2),
cut as materialized (
  select word, n, i, left(word, i::int) as head, substr(word, i::int + 2) as rest
  from (select word, n, unnest(range(length(word))) as i from v)),
pairs as materialized (
  select a.word as a, a.n as a_n, b.word as b, b.n as b_n
  from cut a join cut b on a.i = b.i and a.head = b.head and a.rest = b.rest and a.word < b.word
  union all
  select v.word, v.n, d.word, d.n from v join (select distinct word, n, head || rest as less from cut) d on d.less = v.word),
near as materialized (
  select word, count(*)::bigint as n_near, min({'n': -m, 'form': near}) filter (m >= 10 * n) as best
  from (select a as word, a_n as n, b as near, b_n as m from pairs union all select b, b_n, a, a_n from pairs) group by word),
forms as materialized (select word, best.form as form, (-best.n)::bigint as form_n from near where best is not null),
chain as (
  select word, word as root, 0 as steps from v
  union all
  select c.word, f.form, c.steps + 1 from chain c join forms f on c.root = f.word)
select v.word, form, root, v.n, coalesce(n_near, 0)::bigint as n_near, form_n
from v left join near using (word) left join forms using (word)
join (select word, arg_max(root, steps) as root from chain group by word) using (word)"""

__all__ = ["ORACLES", "QUERIES"]


@query("op3_ngram_join")
def op3(spark, sf_dir):
    return ngram_join.ngram_join(documents(spark, sf_dir), width=5, percent=80).select(
        "doc_id", "n_shingles", "component_id", "class_id")


@query("op5_substring_dedup")
def op5(spark, sf_dir):
    out = substring.substring_dedup(documents(spark, sf_dir), width=35)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"),
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), "removed")


@query("op8_secret_scan", OP8_SQL)
def op8(spark, sf_dir):
    found = secret_scan.secret_scan(documents(spark, sf_dir))
    own = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listing(own).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.listing(F.col("spans")).alias("spans"))


@query("op2_quality_rules")
def op2(spark, sf_dir):
    out = quality.quality(documents(spark, sf_dir))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & (F.col("posterior") >= 0.5)).alias("kept"), "posterior")


@query("op10_license_scan")
def op10(spark, sf_dir):
    found = license_scan.license_scan(documents(spark, sf_dir))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    names = lambda m: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"))


def _fold(modulus):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


@query("op1_language_id")
def op1(spark, sf_dir):
    docs = documents(spark, sf_dir)
    known = language_id.prototypes(docs.filter(_fold(4) != 2))
    return language_id.language_id(docs, known).select(
        "doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op4_toxicity")
def op4(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(_fold(3) != 1))
    return model.score(docs).select(
        "doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op6_code_search", OP6_SQL)
def op6(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return code_search.search(vectors, F.col("vec_id") % 100 == 0, k=10, bits=64)


@query("op7_mixing", _mixing_sql())
def op7(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


@query("op9_packing")
def op9(spark, sf_dir):
    return packing.best_fit(documents(spark, sf_dir))


@query("op13_online_packing")
def op13(spark, sf_dir):
    return online_packing.pack_online(documents(spark, sf_dir), window=2048)


@query("op12_lexical_search", OP12_SQL)
def op12(spark, sf_dir):
    return lexical_search.lexical_search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), k=10)


@query("op11_spelling_variants", OP11_SQL)
def op11(spark, sf_dir):
    return spelling.spelling_variants(documents(spark, sf_dir), least=7, ratio=10, modulus=31)
