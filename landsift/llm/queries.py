"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, exact_dedup, mixing, near_dedup, quality, recurrent_lm, topk, url_filter, warc
from ._spark import table


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda c: c % 100 == 0)


def op2_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat_format.summary(rows.unionByName(own))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spark, table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), keep="max")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.probabilities(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = warc.derive(warc.responses(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return derived.select(F.col("id").alias("page_id"), "kind", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length", "block")


def queries() -> dict:
    own = (op1_exact_top_k, op2_recurrent_lm, op3_url_filter, op4_chat_format, op5_minhash_near_dedup, op6_byte_bpe, op7_exact_dedup, op8_quality, op9_mixing, op10_warc_derivatives)
    return {f.__name__: f for f in own}


def _escaped(column: str) -> str:
    for plain, code in chat_format.ESCAPES:
        column = f"replace({column}, '{plain}', '{code}')"
    return column


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_top_k": """
            with v as materialized (
                select row_number() over () as own, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
                where embedding is not null and vec_id is not null
                    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
            ), s as (
                select q.own, q.vec_id as query_id, c.vec_id as vec_id, coalesce(cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint), 0) as score
                from v q join v c on q.vec_id % 100 = 0 and q.own <> c.own
            ), r as (select *, row_number() over (partition by own order by score desc, vec_id) as rank from s)
            select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10""",
        "op4_chat_format": f"""
            with t as (
                select conv_id, case when conv_id is null then row_number() over () end as alone, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                union all select -7, null, 0, 'user', '\\### Assistant: </turn> ok'
                union all select -7, null, 1, 'assistant', '\\### Assistant: </turn> ok'
            ), g as (
                select conv_id, count(*) as n_turns,
                    string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
                    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
                    sum(4 + length({_escaped("role")}) + 2 + length({_escaped("text")}) + 8) as formatted_chars,
                    string_agg(role, ' ' order by turn, role, text) as roles
                from t group by conv_id, alone
            )
            select conv_id, cast(n_turns as bigint) as n_turns, sha256(turns) as turns_sha256, cast(length(loss) as bigint) as loss_chars,
                sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars,
                regexp_full_match(roles, '(system )?user assistant( user assistant)*') as valid
            from g""",
        "op7_exact_dedup": """
            select doc_id, max(doc_id) over g as keep_id, cast(count(*) over g as bigint) as group_size,
                row_number() over (g order by doc_id desc nulls last) = 1 as kept, sha256(text) as text_sha256
            from (select doc_id, coalesce(text, '') as text from documents) window g as (partition by text)""",
    }
