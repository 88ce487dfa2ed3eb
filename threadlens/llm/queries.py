"""The registered queries of this subpackage: each applies one operator, with the
parameters its contract names, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import sql
from threadlens.llm.common import word_count
from threadlens.llm.divergence import source_divergence
from threadlens.llm.hard_negatives import mine_hard_negatives, whole_vectors
from threadlens.llm.labelled import id_remainder
from threadlens.llm.licenses import scan_licenses
from threadlens.llm.line_dedup import dedup_lines
from threadlens.llm.mixing import mix_sources
from threadlens.llm.near_dedup import near_duplicates
from threadlens.llm.packing import pack_pieces, token_pieces
from threadlens.llm.quality import fit_quality, quality_score
from threadlens.llm.token_counts import count_tokens
from threadlens.llm.toxicity import fit_toxicity, toxicity_score
from threadlens.llm.url_filter import filter_urls, parse_rules
from threadlens.llm.vector_dedup import near_vectors
from threadlens.llm.vector_search import search_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return found.select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return search_vectors(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("sentences").cast("long").alias("n_sentences"),
        F.array_join(F.transform("sentences", lambda s: s["id"]), ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        F.array_join("unmatched", ",").alias("unmatched"),
        F.array_join("tagged", ",").alias("tagged"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = id_remainder("doc_id", 5) == 0
    model = fit_quality(docs, labels.where(~held_out))
    return _scored(docs, held_out, quality_score(model, "text"))


def _scored(docs: DataFrame, held_out, score) -> DataFrame:
    found = docs.select("doc_id", held_out.alias("held_out"), score.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_pieces(token_pieces(_table(spark, sf_dir, "documents"), path, capacity=2048))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = id_remainder("doc_id", 4) == 2
    model = fit_toxicity(docs, labels.where(~held_out))
    return _scored(docs, held_out, toxicity_score(model, "text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sizes = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source",
        word_count("text").alias("size"),
    )
    found = mix_sources(sizes, weights=(5, 2, 1), max_repeat=3)
    return found.select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = count_tokens(_table(spark, sf_dir, "documents"), path)
    return found.withColumn("over_limit", F.col("n_tokens") > 512)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"), min_docs=10, top_terms=10)


URL_RULES = (
    "allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/",
    "block com/de/",
)


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, parse_rules(spark, URL_RULES)).drop("url")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", moved)
    rows = whole_vectors(vectors, scale=256)
    return mine_hard_negatives(
        rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_vector_search": op2_vector_search,
    "op3_license_scan": op3_license_scan,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_source_divergence": op11_source_divergence,
    "op12_url_filters": op12_url_filters,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": sql.LINE_DEDUP,
    "op3_license_scan": sql.license_scan(),
    "op6_minhash_dedup": sql.NEAR_DUPLICATES,
    "op8_mixing": sql.MIXING,
    "op9_vector_dedup": sql.VECTOR_DEDUP,
    "op11_source_divergence": sql.SOURCE_DIVERGENCE,
    "op12_url_filters": sql.URL_FILTERS,
    "op13_hard_negatives": sql.HARD_NEGATIVES,
}
