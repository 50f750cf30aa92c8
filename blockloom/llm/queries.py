"""Queries opN_<name> of the operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.oracles import ORACLES  # noqa: F401  the entry reads it here


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.pages import extract

    return extract(_table(spark, sf_dir, "pages"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.vectors import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from blockloom.llm.pieces import digest

    return digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.lm import score

    return score(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.common import held_out
    from blockloom.llm.quality import fit, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from blockloom.llm.records import encode_and_store, read

    rows = read(encode_and_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.warc import derivatives, digest, responses

    return digest(derivatives(responses(_table(spark, sf_dir, "pages"))))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.media import digest, text_media

    return digest(text_media(_table(spark, sf_dir, "documents")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.jaccard import join

    return join(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_quality, op3_token_records, op4_html_text, op5_near_vectors, op6_sentencepiece, op7_mixing, op8_warc_derivatives, op9_media, op10_jaccard_join)}
