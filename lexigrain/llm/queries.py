"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import brown_lm, byte_bpe, html_crf, license_scan, line_dedup, minhash_dedup, packing, rp_forest, toxicity, transport_stream
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract_main_text(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, json_path=public_tokenizers.path("byte_bpe_50k.json"))


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of ``op3_packing`` for instruction data, where tokens, segments and loss-bearing tokens all have their limits."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack_conversations(table(spark, sf_dir, "conversations"), ranks, public_tokenizers.PATTERN, json_path=public_tokenizers.path("byte_bpe_50k.json"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"))


def op5_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.store_texts(table(spark, sf_dir, "documents"))


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.link_lines(table(spark, sf_dir, "documents"), line_dedup.ALL_LINES)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.group_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_html_extraction": op2_html_extraction,
    "op3_packing": op3_packing,
    "pack_conversations": pack_conversations,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_transport_streams": op5_transport_streams,
    "op6_brown_lm": op6_brown_lm,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_minhash_dedup": op10_minhash_dedup,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op10_minhash_dedup": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as t from documents),
s as (
  select doc_id, case when len(t) = 0 then [] when len(t) < 3 then [array_to_string(t, ' ')]
    else list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) end as shingles from w),
n as (select doc_id, len(shingles) as n from s),
e as (select doc_id, unnest(shingles) as shingle from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
d as (select a, b from l union select b, a from l),
r(a, b) as (select doc_id, doc_id from documents union select r.a, d.b from r join d on r.b = d.a)
select doc_id, n::bigint as n_shingles, min(b) as component_id, doc_id = min(b) as kept from n join r on r.a = doc_id group by doc_id, n""",
}
