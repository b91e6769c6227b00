"""The registered queries of this subpackage and their SQL, where SQL can express them.

Each query takes (spark, folder of the tables), applies its operator with production parameters to
the whole table, and derives digest columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, langid, lines, media, packing, pieces, pii, quality, substring, urls
from millrace.llm._store import owned


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_links(_table(spark, sf_dir, "documents"), n=4, numerator=85, denominator=100)[0]


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(_table(spark, sf_dir, "documents"), owned(spark, "media"))
    return media.features(media.analysed(stored, owned(spark, "tensors")))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(_table(spark, sf_dir, "documents"), window=35)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_lines=2)  # as in its SQL
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return out.select("doc_id", F.col("_l_lines").alias("n_lines"), F.col("_l_removed").alias("n_removed"), digest.alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=1024, end_id=0).drop("ids")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard, op2_media, op3_substrings, op4_urls, op5_lines, op6_quality, op7_pii, op8_pieces, op9_langid, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op4_urls": urls.ORACLE_SQL, "op5_lines": lines.ORACLE_SQL}
