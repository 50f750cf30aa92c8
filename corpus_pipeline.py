"""A corpus pipeline: quality, near copies, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import jaccard, mixing, pieces, quality
from blockloom.llm.common import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that score less are rejected.
ACCEPT = 0.5
#: No SQL expresses a discriminant analysis.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on labelled documents of its input and drops what the classifier rejects."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model).where(F.col("score") >= ACCEPT).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, the one of least id, of each group linked at Jaccard 0.8 on five words."""
    return jaccard.keep_first(docs.select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by their share in the mix.

    A document of which the mix takes x times its words comes floor(x + u) times, u being a
    number from its id's hash: a whole document where the mix cuts one, right on average (from its
    text's without an id). Rows of one id or none count by themselves.
    """
    docs = stage(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    shares = mixing.mix(docs, row="_row").where("taken > 0").select("_row", (F.col("taken") / F.col("size")).alias("x"))
    drawn = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit("mix"), "doc_id")), F.xxhash64(F.lit("mix"), "text"))
    u = F.pmod(drawn, F.lit(1 << 20)) / F.lit(float(1 << 20))
    kept = docs.join(shares, "_row").withColumn("times", F.floor(F.col("x") + u).cast("int")).where("times > 0")
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each document and checks that its ids decode to it."""
    return pieces.digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality classifier", quality_filter), ("n-gram Jaccard join", near_copies), ("mixing sources", source_mix), ("SentencePiece", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
