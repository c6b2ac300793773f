"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

1. language: documents without a language (null texts, texts without a letter) go; missing labels are filled in.
2. lines: lines that ten documents or more share go, wherever they stand.
3. near_copies: of each group of near duplicates the document of the smallest doc_id stays.
4. mix: documents are repeated or left out so that sources come near their target weights.
5. pieces: the last stage encodes the texts; ``pieces`` holds the ids of the best segmentation.

All stages but the last return the columns of documents. Null, empty, repeated rows and empty tables are
treated as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackflow.llm import language, line_dedup, mixing, near_dedup, pieces, queries
from trackflow.operators.tables import working_dir

MIN_DOCS = 10
N_BEST = 4


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A text that changes gets its new n_chars, where the table has that column."""
    cut = line_dedup.drop_common_lines(docs, MIN_DOCS)
    left = cut.select(*[F.col(f"`{c}`") for c in docs.columns if c in cut.columns])
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in left.columns else left


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_pieces, pieces, best_score): one row per document of the mix, repeats included."""
    found = pieces.encoded(docs, pieces.read_model(queries.PIECES), N_BEST, keep=["doc_id", "source"])
    return found.select(
        "row.doc_id", "row.source", F.size("pieces").cast("long").alias("n_pieces"), "pieces", F.col("scores")[0].alias("best_score")
    )


STAGES = [
    ("language", keep_known_language),
    ("lines", drop_common_lines),
    ("near_copies", keep_one_copy),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

# Languages are learned and texts are segmented by models that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result lies in the session's shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{working_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
