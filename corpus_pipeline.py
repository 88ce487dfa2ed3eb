"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before it kept. All
but the last return the columns of documents; the last returns packed pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import word_count
from threadlens.llm.labelled import id_remainder
from threadlens.llm.line_dedup import dedup_lines
from threadlens.llm.mixing import mix_documents
from threadlens.llm.near_dedup import near_duplicates
from threadlens.llm.packing import pack_pieces, token_pieces
from threadlens.llm.quality import fit_quality, quality_score
from threadlens.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more. It learns from the labels whose
    id's crc32 is not divisible by 5, so that the rest can measure it."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels.where(id_remainder("doc_id", 5) != 0))
    return docs.where(quality_score(model, "text") >= 0.3).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in one of them. A document stays even
    if all its lines go."""
    found = dedup_lines(docs.select(*COLUMNS), min_chars=20, min_docs=3, out="kept_text")
    return found.withColumn("text", F.col("kept_text")).withColumn(
        "n_chars", F.char_length("kept_text").cast("long")
    ).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    found = near_duplicates(docs, words=5, percent=80)
    copies = found.where(~F.col("kept")).select(F.col("doc_id").alias("copy")).distinct()
    return docs.select(*COLUMNS).join(copies, F.col("doc_id") == F.col("copy"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 5, 2, 1 in turn and no
    document is taken more than three times."""
    sized = docs.select(*COLUMNS, word_count("text").alias("size"))
    return mix_documents(sized, "size", weights=(5, 2, 1), max_repeat=3).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 2048 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_pieces(token_pieces(docs, path, capacity=2048))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None  # a trained model and shingle hashes: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
