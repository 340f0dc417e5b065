"""The registered queries of this folder, and the SQL they are checked against where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parterre.llm import alignment, bpe_chunks, decontam, filter_audit, lang_id, licenses, ngram_join, packing, pii, quality, token_files, toxicity, urls
from parterre.llm.common import fold_remainder, table


def op1_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents"))


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.url_filter(table(spark, folder, "pages"))


def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.components(table(spark, folder, "documents"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", (fold_remainder(F.col("doc_id")) == 1).alias("held_out"), "score",
                        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"),
                        pii.span_text(F.col("spans")).alias("spans"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe_chunks.encode_documents(table(spark, folder, "documents"), tokenizer_path())
    return bpe_chunks.decode_documents(encoded, tokenizer_path(), digest=True).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = lang_id.language_id(table(spark, folder, "documents"))
    return found.select("doc_id", (fold_remainder(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, folder, "documents"), tokenizer_path(), end_id=0)
    return token_files.read_token_files(files)


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(table(spark, folder, "documents")).drop("distance")


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.interaction_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return alignment.aligned(table(spark, folder, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, folder, "documents"), tokenizer_path(), size=2048, end_id=0)


QUERIES = {f.__name__: f for f in (
    op1_license_scans, op2_url_filters, op3_ngram_join, op4_toxicity, op5_pii, op6_bpe_encoding, op7_language_id, op8_benchmark_decontamination, op9_token_files,
    op10_quality_rules, op11_filter_audit, op12_tokenizer_alignment, op13_best_fit_packing)}

ORACLE = {
    "op8_benchmark_decontamination": r"""
with w as (
  select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos, len(ws) as n from (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents)),
d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
win as (
  select distinct item_id, n, gram from (
    select item_id, least(13, len(ws)) as n, ws[k:k + least(13, len(ws)) - 1] as gram
    from (select item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as k from i where len(ws) > 0))),
lens as (select distinct n from win),
occ as (
  select doc_id, k, lens.n, ws[k:k + lens.n - 1] as gram
  from d, lens, lateral (select unnest(range(1, len(ws) - lens.n + 2)) as k) where len(ws) >= lens.n),
met as (select doc_id, k, occ.n, item_id from occ join win on occ.n = win.n and occ.gram = win.gram),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from met) group by 1),
its as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from met where item_id is not null) group by 1)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join hit using (doc_id) left join its using (doc_id)
""",
    "op11_filter_audit": r"""
with lab as (
  select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as toxic
  from labels where doc_id is not null group by 1),
d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
    min(doc_id) over (partition by coalesce(text, '')) as first_id from documents),
f as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (len(ws) < 50)::int + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first_id, false)::int as mask
  from d left join lab using (doc_id)),
m as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by 1, 2),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as c, unnest([1, 2, 4, 8, 16]) as bit),
orders as (
  select a.c || b.c || c.c || d.c || e.c as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from l a, l b, l c, l d, l e where a.bit + b.bit + c.bit + d.bit + e.bit = 31
    and len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s as (
  select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0) as before
  from orders, (select unnest(range(1, 6)) as step)),
r as (
  select part, filter_order, step, bit, n, good, toxic, (mask & bit) <> 0 as fails, (mask & before::bigint) <> 0 as gone, mask = bit as alone
  from m, s),
o as (
  select part, filter_order, step, bit,
    coalesce(sum(n) filter (not gone and not fails), 0)::bigint as kept,
    coalesce(sum(n) filter (not gone and fails), 0)::bigint as removed,
    coalesce(sum(n) filter (gone and fails), 0)::bigint as redundant,
    coalesce(sum(n) filter (alone), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (not gone and fails), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (not gone and fails), 0)::bigint as toxic_lost
  from r group by 1, 2, 3, 4)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, bit))::bigint as shapley
from o
""",
}
