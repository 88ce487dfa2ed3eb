"""Training rows: a bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


def sampled_labels(labels: DataFrame, label: str, rows: int, by_class: bool) -> DataFrame:
    """(label_id, label): about ``rows`` labelled ids, never more than twice as many;
    ``by_class`` asks for half as many of each class. Chosen by a hash of the id, so a
    rerun takes the same; null ids and labels other than 0 and 1 are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(
        F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label")
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    want = {k: (rows / 2 / n if by_class else rows / total) for k, n in counts.items()}
    share = F.lit(0.0)
    for k, v in want.items():
        share = F.when(F.col("label") == k, F.lit(min(1.0, v))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit("sample"), "label_id"), F.lit(1_000_000))
    return known.where(place < share * 1_000_000).limit(2 * rows)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, by_class: bool):
    """(text, label) of the sampled documents, wherever they are: limit what is made of
    them, as documents may repeat an id. The sampled ids are broadcast: their number is
    bounded by ``rows``, whatever the size of the data."""
    ids = F.broadcast(sampled_labels(labels, label, rows, by_class))
    texts = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("text"))
    return texts.join(ids, F.col("__id") == F.col("label_id")).select("text", "label")
