"""CSV files with quoted line breaks, read by as many tasks as they have byte ranges.

A line break ends a record only outside quotes, and whether a byte range starts inside
quotes depends on all bytes before it. So the ranges are read as lines, and

1. every range counts its quotes: one row per range;
2. a range starts inside quotes if the ranges before it in its file hold an odd number;
3. knowing that, every range puts its lines together to records on its own. What lies
   before its first record end and after its last one are fragments, at most two per
   range, and only those are shuffled and joined to the records that cross ranges.

As in RFC 4180, a field that holds a quote is quoted and its quotes are doubled. A record
whose quotes never close runs to the end of its file."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.operators.sizing import BROADCAST_ROWS, broadcast_bounded
from threadlens.session import cut_lineage

_OUT = "file string, start long, kind string, first boolean, part string"


class _Range:
    """The lines of one byte range, put together to records as they come."""

    def __init__(self, file: str, start: int, inside: bool):
        self.file, self.start = file, start
        self.began_inside = self.inside = inside
        self.closed = not inside  # whether the lines from here on are records of its own
        self.open: list[str] = []  # the lines of the record that has not ended yet
        self.first = start == 0  # whether the file's first record is still to come

    def add(self, lines: pa.Array) -> Iterator[tuple[str, pa.Array]]:
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        after = (np.cumsum(quotes) + self.inside) % 2 == 1
        self.inside = bool(after[-1])
        if self.closed and not self.open and not after.any():
            yield "record", lines  # every line is a record
            return
        texts = lines.to_pylist()
        records, first = [], 0
        for end in np.flatnonzero(~after).tolist():
            record = "\n".join([*self.open, *texts[first : end + 1]])
            self.open, first = [], end + 1
            if self.closed:
                records.append(record)
            else:
                yield "head", pa.array([record], pa.string())
            self.closed = True
        self.open += texts[first:]
        if records:
            yield "record", pa.array(records, pa.string())

    def rest(self) -> Iterator[tuple[str, pa.Array]]:
        if self.open:
            yield "tail" if self.closed else "middle", pa.array(["\n".join(self.open)], pa.string())


def _assemble(kinds: Sequence[str]):
    """The records, or the fragments, of the ranges that a task reads one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: _Range | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, starts = batch.column("file"), batch.column("start").to_numpy()
            code = names.dictionary_encode().indices.to_numpy()
            new = np.flatnonzero((np.diff(starts) != 0) | (np.diff(code) != 0)) + 1
            for low, high in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                key = (names[low].as_py(), int(starts[low]))
                if here is None or (here.file, here.start) != key:
                    if here is not None:
                        yield from rows(here, here.rest())
                    here = _Range(*key, batch.column("inside")[low].as_py())
                yield from rows(here, here.add(batch.column("value").slice(low, high - low)))
        if here is not None:
            yield from rows(here, here.rest())

    def rows(found: _Range, parts) -> Iterator[pa.RecordBatch]:
        for kind, texts in parts:
            n, first = len(texts), np.zeros(len(texts), bool)
            if found.first:  # blank lines come before no header
                said = np.flatnonzero(pc.utf8_length(pc.utf8_trim_whitespace(texts)).to_numpy(zero_copy_only=False))
                if len(said):
                    first[said[0]], found.first = True, False
            if kind in kinds:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([found.file] * n, pa.string()), pa.array([found.start] * n, pa.int64()),
                     pa.array([kind] * n, pa.string()), pa.array(first), texts],
                    ["file", "start", "kind", "first", "part"],
                )

    return run


def csv_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(first, record): every record of the files as text without its line end; ``first``
    marks the first one of each file. Empty records are left out.

    Quotes are counted and the records across ranges put together when this is called;
    the other records are read when the result is used. Both readings must cut the files
    alike: where the number of cores changes in between, the later one fails unless
    ``spark.sql.files.minPartitionNum`` fixes it."""
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    ranges = cut_lineage(
        counted.select(
            F.col("file").alias("f"), F.col("start").alias("s"),
            (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"),
        )
    )
    marked = _marked(lines, ranges, ranges.count())
    fragments = cut_lineage(marked.mapInArrow(_assemble(("head", "middle", "tail")), _OUT))
    joined = cut_lineage(_joined(fragments))
    whole = marked.mapInArrow(_assemble(("record",)), _OUT).select("first", "part")
    record = F.regexp_replace("part", r"\r$", "")
    record = F.when(F.col("first"), F.regexp_replace(record, "^\ufeff", "")).otherwise(record)
    return whole.unionByName(joined).select("first", record.alias("record")).where("record <> ''")


def _marked(lines: DataFrame, ranges: DataFrame, count: int) -> DataFrame:
    """The lines in file order, with ``inside``: whether their range starts inside quotes.
    The table of ranges has a row per byte range and is broadcast up to a fixed number of
    rows, which keeps the order; beyond it the lines are sorted again."""
    here = (F.col("file") == F.col("f")) & (F.col("start") == F.col("s"))
    known = F.coalesce("inside", F.raise_error(F.lit("the files were cut differently before")))
    columns = ["value", "file", "start", known.alias("inside")]
    if count <= BROADCAST_ROWS:
        return lines.join(broadcast_bounded(ranges, BROADCAST_ROWS), here, "left").select(*columns)
    numbered = lines.withColumn("number", F.monotonically_increasing_id())
    dealt = numbered.join(ranges, here, "left").select(*columns, "number")
    return dealt.repartition("file", "start").sortWithinPartitions("file", "start", "number").drop("number")


def _joined(fragments: DataFrame) -> DataFrame:
    """(first, part) of the records across ranges: a tail, any middles and a head. They are
    numbered by file without their texts, two narrow rows per range at most."""
    upto = W.partitionBy("file").orderBy("start", F.col("kind") == "tail")
    number = F.sum((F.col("kind") == "tail").cast("int")).over(upto)
    numbered = fragments.select("file", "start", "kind").withColumn("number", number)
    last = F.max("number").over(W.partitionBy("file"))
    numbered = numbered.withColumn("last", F.col("number") == last)
    texts = fragments.toDF("f", "s", "k", "first", "part")
    same = (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")) & (F.col("kind") == F.col("k"))
    ends = F.count_if(F.col("kind") == "head")
    sound = (F.col("number") > 0) & ((F.col("ends") == 1) | F.col("last"))
    parts = F.transform(F.sort_array("parts"), lambda p: p["part"])
    return (
        numbered.join(texts, same).groupBy("file", "number")
        .agg(
            F.bool_or("first").alias("first"), F.bool_or("last").alias("last"), ends.alias("ends"),
            F.collect_list(F.struct("start", (F.col("kind") == "tail").alias("tail"), "part")).alias("parts"),
        )
        .select(
            "first",
            F.when(sound, F.array_join(parts, "\n"))
            .otherwise(F.raise_error(F.lit("the files were cut differently before"))).alias("part"),
        )
    )


def read_records(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns`` as strings from files with a header of just these names."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    rows = csv_records(spark, path).withColumn("cells", F.from_csv("record", F.lit(schema), options))
    named = F.lit(True)
    for c in columns:
        named = named & F.col("cells")[c].eqNullSafe(F.lit(c))
    wrong = F.concat(F.lit("the header is not " + ",".join(columns) + " but "), F.col("record"))
    data = F.when(~F.col("first"), F.lit(True)).when(named, F.lit(False)).otherwise(
        F.raise_error(wrong).cast("boolean")
    )
    return rows.where(data).select(*(F.col("cells")[c].alias(c) for c in columns))
