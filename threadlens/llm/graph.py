"""Union-find over link tables: groups of linked ids, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every id in ``links`` (columns a, b): the smallest id that
    links reach from it. Links of an id with itself and null ids are ignored.

    Each round hooks every larger neighbour of an id to the smallest id around it, then
    every smaller one likewise (large star, small star), so that paths shorten by half or
    better; it ends when all ids point straight at the smallest. An id with very many
    links is one row of the minima and many of the links, which adaptive execution can
    split: both sides of these joins are read from storage."""
    up, low = F.greatest("a", "b"), F.least("a", "b")
    edges = cut_lineage(
        links.where(F.col("a") != F.col("b")).select(up.alias("v"), low.alias("u")).distinct()
    )
    while not _stars(edges):
        edges = _small_star(_large_star(edges))
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every id points at one id, which points at none."""
    if edges.count() != edges.select("v").distinct().count():
        return False
    heads = edges.select(F.col("u").alias("head")).distinct()
    return heads.join(edges, F.col("head") == F.col("v"), "left_semi").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionAll(
        edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    )
    least = cut_lineage(
        both.groupBy("x").agg(F.min("y").alias("m"))
        .select(F.col("x").alias("k"), F.least("x", "m").alias("m"))
    )
    larger = both.where(F.col("y") > F.col("x"))
    joined = larger.join(least, F.col("x") == F.col("k"))
    return cut_lineage(joined.select(F.col("y").alias("v"), F.col("m").alias("u")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = cut_lineage(
        edges.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("k"), "m")
    )
    joined = edges.join(least, F.col("v") == F.col("k"))
    ends = joined.select(F.explode(F.array("v", "u")).alias("v"), F.col("m").alias("u"))
    return cut_lineage(ends.where(F.col("v") != F.col("u")).distinct())
