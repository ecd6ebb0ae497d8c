"""Registered queries of the operators, each with its SQL formulation where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import bpe, chat, decontamination, divergence, language, line_dedup, near_dup, quality_model, quality_rules, secret_links, sharding, toxicity, va_clusters
from attesta.llm.common import held_out, read_table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def ranks() -> bpe.Ranks:
    return bpe.Ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.size("_removed").cast("long").alias("n_removed"), F.col("_links").alias("n_links"), F.sha2("text", 256).alias("text_sha256"))


DECONTAMINATION_SQL = r"""
with dw as (
  select rowid_ as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select row_number() over () as rowid_, doc_id, text from documents)),
iw as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select item, least(13, len(w)) as n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) as key
  from iw where len(w) > 0),
lens as (select distinct n from win),
at_ as (
  select r, n, unnest(range(1, len(w) - n + 2)) as p, w from dw, lens where len(w) >= n),
occ as (select r, n, p, array_to_string(w[p:p + n - 1], ' ') as key from at_),
hits as (select r, occ.n, p, item from occ join win on occ.n = win.n and occ.key = win.key),
words as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from (select distinct r, p, n from hits)) group by r),
items as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as s from hits group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join words using (r) left join items using (r)
"""


@query("op3_decontamination", DECONTAMINATION_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = ranks()
    rows = bpe.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, back=True)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_links.find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    order = F.array(*[F.lit(k) for k in secret_links.KINDS])
    every = F.transform(
        F.array_sort(F.transform(F.concat("strong", "linked"), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]),
    )
    return rows.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(listed("strong"), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))


CHAT_SQL = r"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t as (
  select *, case when contains(text, '###') or contains(text, '</turn>') then replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') else text end as body from rows_)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(role) + length(body) + 4 + 2 + 9) as bigint) as formatted_chars
from t group by conv_id
"""


@query("op7_chat_format", CHAT_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = r"\### Assistant: </turn> ok"
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(rows.unionByName(extra)))


NEAR_DUP_SQL = r"""
with recursive d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') as w from documents),
s as (
  select r, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')))) as k from d where len(w) > 0),
n as (select r, count(*) as n from s group by r),
i as (select a.r as a, b.r as b, count(*) as i from s a join s b on a.k = b.k and a.r < b.r group by all),
e as (select a, b from i join n x on x.r = a join n y on y.r = b where 100 * i >= 85 * (x.n + y.n - i)),
both_ as (select a, b from e union all select b, a from e),
reach(a, b) as (select a, b from both_ union select reach.a, both_.b from reach join both_ on reach.b = both_.a),
c as (select reach.a as r, min(d.doc_id) as least from reach join d on d.r = reach.b group by reach.a)
select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(least, doc_id)) as component_id, doc_id = least(doc_id, coalesce(least, doc_id)) as kept
from d left join n using (r) left join c using (r)
"""


@query("op8_minhash_near_dup", NEAR_DUP_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), size=3, num=85, den=100).drop("th")


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = quality_model.score(docs.select("doc_id", "text"), quality_model.fit(docs, read_table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted"))


_W = r"[^ \t\n\x0B\f\r]+"
_RULE_STOPS = ", ".join(f"'{w}'" for w in sorted({w for g in quality_rules.STOP_WORDS.values() for w in g}))
QUALITY_RULES_SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '{_W}') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}')) as l from d),
win as (select r, unnest(range(1, len(w) - 6)) as p, unnest(list_transform(range(1, len(w) - 6), lambda i: w[i:i + 7])) as k from w where len(w) >= 8),
rep as (select r, p from (select r, p, count(*) over (partition by r, k) as c from win) where c > 1),
cov as (select r, sum(least(8, coalesce(p - q, 8))) as n from (select r, p, lag(p) over (partition by r order by p) as q from rep) group by r),
m as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(len(l) as bigint) as n_lines,
    cast(coalesce(n, 0) as bigint) as n_repeat_words,
    len(list_filter(w, lambda x: lower(x) in ({_RULE_STOPS}))) as n_stop, len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) as n_alpha
  from w left join cov using (r)),
v as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, greatest(n_words, 1) as c from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars / c >= 1.5 and word_chars / c <= 20 and n_symbols / c <= 0.25 and n_stop / c >= 0.02
  and n_dup_lines / greatest(n_lines, 1) <= 0.5 and n_alpha / c >= 0.5 as kept
from v
"""


@query("op10_quality_rules", QUALITY_RULES_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rounds(n: int) -> str:
    """The rounds of centroid clustering: distances, nearest centroid, floors of the means."""
    out = ""
    for i in range(n + 1):
        out += f""",
d{i} as (select r, n, list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from kept, c{i}),
a{i} as (select r, min(row(d, n)) as best from d{i} group by r)"""
        if i < n:
            out += f""",
s{i} as (select best[2] as n, j, sum(v[j]) as s, count(*) as m from a{i} join kept using (r), range(1, 65) t(j) group by all),
c{i + 1} as (
  select n, list(coalesce((s - ((s % m) + m) % m) // m, c{i}.v[j]) order by j) as v
  from c{i} cross join range(1, 65) t(j) left join s{i} using (n, j) group by n)"""
    return out


VA_CLUSTERS_SQL = f"""
with kept as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
c0 as (
  select row_number() over (order by sha256('1:' || coalesce(cast(vec_id as varchar), '')), v) - 1 as n, v from kept qualify n < 16){_rounds(3)},
out_ as (select vec_id, cast(best[2] as int) as cluster, cast(best[1] as bigint) as distance from a3 join kept using (r))
select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia,
  sha256(array_to_string(c3.v, ',')) as centroid_sha256
from out_ join c3 on c3.n = out_.cluster
"""


@query("op11_centroid_clustering", VA_CLUSTERS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return va_clusters.report(va_clusters.cluster(vectors), vectors)


DIVERGENCE_SQL = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term from t group by all having count(distinct r) >= 30),
v as (select lang, count(*) as v from k group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t group by all),
gt as (select g.lang, source, k.term, coalesce(n, 0) as n, v from g join k using (lang) join v using (lang) left join c using (lang, source, term)),
pq as (
  select lang, source, term, n,
    1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v) as p,
    1 + (1000000000::hugeint * (sum(n) over (partition by lang, term) + 5)) // (sum(n) over (partition by lang) + 5 * v) as q
  from gt),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from pq a join pq b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source),
rows_ as (
  select lang, source, 'pair' as part, item, value from pairs
  union all select lang, source, 'term', term, p - q from pq where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
from rows_ qualify part = 'pair' or rank <= 50
"""


@query("op12_source_divergence", DIVERGENCE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


@query("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, read_table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))
