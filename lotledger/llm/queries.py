"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotledger.llm import bpe, chat, collocations, fingerprints, infill, katz, language, licenses, near_dedup, packing, substring_dedup, topk, toxicity
from lotledger.llm.tables import table
from lotledger.plans.registry import Registry

REGISTRY = Registry()


@REGISTRY.query("op1_duckdb_bpe")
def op1_duckdb_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(bpe.encode(table(spark, folder, "documents"), *vocabulary), *vocabulary)


@REGISTRY.query("op4_katz_scoring")
def op4_katz_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return katz.score(table(spark, folder, "documents"))


NEAR_SQL = """
with recursive docs as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') as words
  from documents
),
shingles as (
  select distinct doc_id, array_to_string(words[i : i + 4], ' ') as shingle
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) as i from docs where len(words) > 0)
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b
  from shingles x join shingles y on x.shingle = y.shingle and x.doc_id < y.doc_id
  join sizes a on a.doc_id = x.doc_id join sizes b on b.doc_id = y.doc_id
  group by all having 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
),
reach as (
  select doc_id as a, doc_id as b from documents
  union select r.a, l.b from reach r join (select a, b from links union all select b, a from links) l on l.a = r.b
)
select a as doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(b) as component_id, a = min(b) as kept
from reach left join sizes on doc_id = a group by a
"""


@REGISTRY.query("op2_bottomk_near_dedup", NEAR_SQL)
def op2_bottomk_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_copies(table(spark, folder, "documents")).drop("text_hash")


@REGISTRY.query("op3_minhash_fingerprints")
def op3_minhash_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_and_next(table(spark, folder, "documents"))


@REGISTRY.query("op5_license_scan")
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: source/thousand/hundred/id.txt; the first ids of each hundred are licence files, the first of all one level up."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    hundred = F.floor(F.col("doc_id") / 100)
    name = F.when(F.col("doc_id") % 100 < 20, licenses.LICENCE_FILE).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    place = F.when(F.col("doc_id") % 100 < 5, F.concat_ws("/", "source", F.floor(hundred / 10).cast("string"), name)).otherwise(
        F.concat_ws("/", "source", F.floor(hundred / 10).cast("string"), hundred.cast("string"), name)
    )
    return licenses.scan(docs.select(F.col("doc_id").alias("file"), place.alias("path"), "text"))


CHAT_SQL = """
with escaped as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
lengths as (
  select *,
    {role} as role_chars, {text} as text_chars,
    lag(role) over (partition by conv_id order by turn nulls first, role, text) is not distinct from role as goes_on
  from escaped
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(text_chars + case when goes_on then {next} else {marks} + role_chars end)::bigint as formatted_chars
from lengths group by conv_id
"""


def _escaped_length(column: str) -> str:
    sql = column
    for what, instead in chat.ESCAPES:
        sql = f"replace({sql}, '{what}', '{instead}')"
    return f"length({sql})"


@REGISTRY.query(
    "op6_chat_formatting",
    CHAT_SQL.format(
        role=_escaped_length("role"), text=_escaped_length("text"), next=len(chat.NEXT), marks=len(chat.OPEN + chat.SAYS + chat.END)
    ),
)
def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    told = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    ok = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), ok.alias("text")
    )
    return chat.digests(chat.read_back(chat.format_conversations(told.union(own))))


TOPK_SQL = """
with ints as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scores as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
  from ints q join ints c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0
),
ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scores
)
select * from ranked where rank <= 5
"""


@REGISTRY.query("op7_exact_topk", TOPK_SQL)
def op7_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.quantised(table(spark, folder, "embeddings"))
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


REPEATS_SQL = """
with docs as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') as words from documents
),
windows as (
  select doc_id, i, array_to_string(words[i : i + 12], ' ') as passage
  from (select doc_id, words, unnest(range(1, len(words) - 11)) as i from docs)
),
firsts as (select passage, min(doc_id) as first_id from windows group by passage having count(distinct doc_id) > 1),
covered as (
  select distinct doc_id, unnest(range(i, i + 13)) as i from windows join firsts using (passage) where first_id < doc_id
),
words as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from docs),
kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by i) as text
  from words where (doc_id, i) not in (select doc_id, i from covered) group by doc_id
)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from docs left join kept using (doc_id)
"""


@REGISTRY.query("op8_countmin_substring_dedup", REPEATS_SQL)
def op8_countmin_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digests(table(spark, folder, "documents"))


@REGISTRY.query("op9_pu_toxicity")
def op9_pu_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    score = F.col(toxicity.SCORE)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


@REGISTRY.query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


INFILL_SQL = """
with told as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents
),
numbers as (
  select *, length(text) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from told
),
planned as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
         when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from numbers
),
parts as (
  select *, substring(text, 1, a) as prefix, substring(text, a + 1, b - a) as middle, substring(text, b + 1, n - b) as suffix from planned
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""


@REGISTRY.query("op13_seekable_infill", INFILL_SQL)
def op13_seekable_infill(spark: SparkSession, folder: str) -> DataFrame:
    return infill.digests(infill.transformed(table(spark, folder, "documents")))


COLLOCATION_SQL = """
with pieces as (
  select row_number() over () as piece, lang, words from (
    select coalesce(lang, 'und') as lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') as words
    from (
      select lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) as piece
      from documents
    )
  ) where len(words) > 0
),
totals as (select lang, sum(len(words))::hugeint as n from pieces group by lang),
grams as (
  select lang, size, words[i : i + size - 1] as gram
  from (select lang, words, size, unnest(range(1, len(words) - size + 2)) as i from pieces, (select unnest([1, 2, 3, 4, 5]) as size))
),
counts as (select lang, size, array_to_string(gram, ' ') as phrase, count(*)::hugeint as a from grams group by all having count(*) >= 100),
cuts as (
  select lang, size, phrase, a, unnest(range(1, size)) as k, string_split(phrase, ' ') as w from counts where size > 1
),
scored as (
  select c.lang, c.size, c.phrase, c.a, c.k, l.a as l, r.a as r, n, (1000 * c.a * n) // (l.a * r.a) as score
  from cuts c
  join counts l on l.lang = c.lang and l.phrase = array_to_string(c.w[1 : c.k], ' ')
  join counts r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')
  join totals t on t.lang = c.lang
),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select distinct lang, a, array_to_string(w[i : i + size - 1], ' ') as phrase
  from (
    select lang, a, w, size, unnest(range(1, len(w) - size + 2)) as i
    from (select lang, a, string_split(phrase, ' ') as w, unnest(range(2, size)) as size from counts where size > 2)
  )
),
ranked as (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
  from lowest where (lang, phrase, a) not in (select lang, phrase, a from inside)
)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked where rank <= 2000
"""


@REGISTRY.query("op12_rabin_karp_collocations", COLLOCATION_SQL)
def op12_rabin_karp_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@REGISTRY.query("op11_string_kernel_language")
def op11_string_kernel_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))
