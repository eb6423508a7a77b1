"""The thin queries over the driver's tables, one per operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, exact_dedup, lattice, ngram_join, packing, pii, quality, substring_dedup, token_counts, toxicity
from .shared import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.encode(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), k=4, p=85, q=100)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_counts(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_packing, op3_ann, op4_toxicity, op5_exact_dedup, op6_substring_dedup, op7_quality, op8_ngram_join, op9_token_counts, op10_pii)}

ORACLES = {
    "op5_exact_dedup": r"""
with n as (
  select doc_id, length(coalesce(text, '')) points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) text_sha256
  from documents
)
select doc_id,
       first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id) keep_id,
       count(*) over (partition by text_sha256) group_size,
       doc_id = first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id) kept,
       text_sha256
from n
""",
    "op8_ngram_join": r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents
),
s as (
  select distinct doc_id, unnest(case when len(ws) >= 4 then list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) g from w
),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * i >= 85 * (a.n + b.n - i)),
l as (select x, y from e union all select y, x from e),
r as (select doc_id a, doc_id b from documents union select r.a, l.y from r join l on r.b = l.x)
select a doc_id, coalesce(n.n, 0) n_shingles, min(b) component_id from r left join n on n.doc_id = a group by a, n.n
""",
}
