"""One registered query per operator, each over its whole table, with SQL counterparts where there are any."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrinse.llm import decontaminate, exact_search, hard_negatives, language_model, line_dedup, near_duplicates, packing, phrases, quality_rules, repeats, secret_scan, url_filter, warc
from sparkrinse.staging import fresh_path

QUERIES = {}
ORACLES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), word_tokenizer())


@query
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontaminate.verdicts(found).drop("text_md5")


@query
def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.with_verdict(near_duplicates.near_duplicates(table(spark, folder, "documents")))


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.assess(table(spark, folder, "documents")).drop("failed")


@query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(table(spark, folder, "documents"))


@query
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_warc(table(spark, folder, "pages"), path)
    return warc.payload_report(warc.captures(warc.read_warc(spark, path)))


@query
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.with_digest(secret_scan.secrets(table(spark, folder, "documents")))


@query
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


@query
def op3_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.with_digest(repeats.remove_repeats(table(spark, folder, "documents")))


@query
def op4_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score(table(spark, folder, "documents"))


@query
def op13_exact_search(spark: SparkSession, folder: str) -> DataFrame:
    return exact_search.top_k(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, 20, scale=64)


ORACLES["op13_exact_search"] = """
with rows as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as hugeint)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id query_id, r.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])) as bigint) score
  from rows q join rows r on q.vec_id % 20 = 0 and q.vec_id != r.vec_id
), ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) n from scored)
select query_id, cast(n as integer) "rank", vec_id, score from ranked where n <= 20
"""


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    rows = table(spark, folder, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


ORACLES["op11_hard_negatives"] = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as hugeint)) v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id anchor_id, r.vec_id, a.label = r.label same,
    list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) score
  from rows a join rows r on a.vec_id % 100 = 0 and a.vec_id != r.vec_id
), positives as (
  select anchor_id, vec_id positive_id, score positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), negatives as (
  select p.anchor_id, p.positive_id, s.vec_id negative_id, p.positive_score, s.score negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) n
  from positives p join scored s on p.anchor_id = s.anchor_id and not s.same
    and 100 * s.score between 30 * p.positive_score and 90 * p.positive_score
)
select anchor_id, positive_id, cast(n as integer) "rank", negative_id,
  cast(positive_score as bigint) positive_score, cast(negative_score as bigint) negative_score
from negatives where n <= 10
"""


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


ORACLES["op12_collocations"] = r"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
  from documents
), words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from pieces),
grams as (
  select lang, 1 size, unnest(w) phrase from words
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from words
),
counts as materialized (select lang, size, phrase, count(*) n from grams group by all having n >= 10),
totals as (select lang, sum(len(w)) n from words group by lang),
phrases as (select lang, size, phrase, n a, string_split(phrase, ' ') w from counts where size > 1),
longer as (
  select lang, phrase, max(a) most from (
    select lang, a, w[1] || ' ' || w[2] phrase from phrases where size = 3
    union all select lang, a, w[2] || ' ' || w[3] from phrases where size = 3) group by all
),
free as (
  select p.* from phrases p left join longer using (lang, phrase) where most is null or 100 * most < 50 * a
),
cuts as (
  select lang, phrase, a, 1 k, w[1] head, array_to_string(w[2:], ' ') tail from free
  union all select lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] from free where size = 3
),
scored as (
  select c.lang, c.phrase, c.a, l.n l, r.n r, cast((1000000::hugeint * c.a * c.a) // (l.n::hugeint * r.n) as bigint) score, k
  from cuts c join counts l on l.lang = c.lang and l.phrase = c.head join counts r on r.lang = c.lang and r.phrase = c.tail
),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) "rank", phrase, a, l, r,
  cast(t.n as bigint) n, score
from lowest join totals t using (lang)
qualify "rank" <= 2000
"""
