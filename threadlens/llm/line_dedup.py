"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A run is a table of (key, docs, last): a line key's 128-bit hash, in how many documents
of the run's batches it was found, and the largest document id among them, sorted by
key. A batch is merge-anti-joined with the runs: an entry that some run already settles
(found often enough, and in a larger document) is not stored again, the rest become a
new run of level 0. Once a level holds ``fanout`` runs they are merged into one run of
the next level, so a key is rewritten once per level.

Only hashes are shuffled to find the repeated lines; texts move once, to meet the
positions of their dropped lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import BLANKS, ascii_lower, packed_row, unpacked
from threadlens.session import cut_lineage, run_dir

RUN = "key binary, docs long, last long"


def line_key(line: Column) -> Column:
    """A line stripped of ASCII blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs in the shared folder."""

    def __init__(self, spark, min_docs: int = 3, fanout: int = 3):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.folder = run_dir(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(path)

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.folder}/level{level}-{self.written}"
        self.written += 1
        run.repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def runs(self) -> DataFrame:
        """All entries of all runs; a key may occur once per run."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], RUN)
        return reduce(DataFrame.unionAll, map(self._read, paths))

    def add(self, keys: DataFrame) -> None:
        """Take in a batch of (key, doc_id), a key once per document."""
        own = keys.groupBy("key").agg(
            F.count("*").alias("docs"), F.max("doc_id").alias("last")
        )
        if any(self.levels):
            settled = (
                self.runs().where(F.col("docs") >= self.min_docs)
                .select(F.col("key").alias("k"), F.col("last").alias("l"))
            )
            same = (F.col("key") == F.col("k")) & (F.col("l") >= F.col("last"))
            own = own.join(settled, same, "left_anti")
        self._write(own, 0)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            paths = self.levels[level]
            if len(paths) >= self.fanout:
                self.levels[level] = []
                self._write(merged(reduce(DataFrame.unionAll, map(self._read, paths))), level + 1)
            level += 1

    def frequent(self) -> DataFrame:
        """(key, last) of the keys found in ``min_docs`` documents or more."""
        often = F.col("docs") >= self.min_docs
        return merged(self.runs()).where(often).select("key", "last")


def merged(entries: DataFrame) -> DataFrame:
    return entries.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))


def dedup_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20,
    min_docs: int = 3, batches: int = 4, fanout: int = 3, out: str = "kept_text",
) -> DataFrame:
    """``docs`` with ``out`` (the kept lines joined by newlines), ``n_lines`` and
    ``n_dropped``; columns of these names are replaced.

    A line whose key has ``min_chars`` code points or more and occurs in ``min_docs``
    documents or more is dropped everywhere but in the document of the largest id that
    holds it, where all its occurrences stay.

    A null or empty text is one empty line. A row is a document: rows that repeat an id
    count as several documents, and all rows of the largest id keep the line. A null id
    is smaller than any other; a key held by null ids only keeps all its lines.
    Documents go to batches by a hash of their id."""
    kept_columns = [c for c in docs.columns if c not in (out, "n_lines", "n_dropped")]
    keys = F.transform(text_lines(F.col("__text")), line_key)
    hashed = F.transform(
        keys, lambda k: F.when(F.char_length(k) >= min_chars, F.unhex(F.md5(k)))
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    ident = F.md5(F.coalesce("__text", F.lit("")))
    lines = cut_lineage(
        rows.select("doc_id", ident.alias("ident"), hashed.alias("keys"))
        .where(F.exists("keys", lambda k: k.isNotNull()))
    )
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for b in range(batches):
        mine = lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b)
        key = F.explode(F.array_distinct(F.array_compact("keys"))).alias("key")
        runs.add(mine.select("doc_id", key))
    frequent = cut_lineage(runs.frequent()).select(F.col("key").alias("fkey"), "last")
    # A very frequent key fills a join partition; both sides come straight from
    # storage, so adaptive execution can split it.
    places = lines.select(
        "doc_id", "ident", F.posexplode("keys").alias("pos", "key")
    ).where(F.col("key").isNotNull())
    dropped = (
        places.join(frequent, F.col("key") == F.col("fkey"))
        .where(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy("doc_id", "ident")
        .agg(F.collect_set("pos").alias("__drops"))
        .select(F.col("doc_id").alias("__id"), F.col("ident").alias("__ident"), "__drops")
    )
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(packed_row(kept_columns), F.col(doc_id).alias("__doc"), whole.alias("__text"))
    same = F.col("__doc").eqNullSafe(F.col("__id")) & (F.md5("__text") == F.col("__ident"))
    none = F.array().cast("array<int>")
    return (
        found.join(dropped, same, "left")
        .withColumn("__lines", text_lines(F.col("__text")))
        .withColumn("__drops", F.coalesce("__drops", none))
        .select(
            "row", _kept_text().alias("__kept"), F.size("__lines").cast("long").alias("__all"),
            F.size("__drops").cast("long").alias("__gone"),
        )
        .select(
            *unpacked(kept_columns), F.col("__kept").alias(out), F.col("__all").alias("n_lines"),
            F.col("__gone").alias("n_dropped"),
        )
    )


def _kept_text() -> Column:
    """Lines whose position is not dropped. ``array_except`` hashes, so a document with
    many lines costs time in proportion to them."""
    places = F.sequence(F.lit(0), F.size("__lines") - 1)
    kept = F.array_except(places, F.col("__drops"))
    some = F.transform(kept, lambda p: F.get(F.col("__lines"), p))
    return F.when(F.size("__drops") == 0, F.array_join("__lines", "\n")).otherwise(
        F.array_join(some, "\n")
    )
