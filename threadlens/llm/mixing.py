"""Mix sources to target weights by weighted fair queueing.

Every shuffled document gets a virtual finish time: the tokens that its source has taken
up to and including it, divided by the source's target. A document that would carry its
source past the target is passed over and the ones behind it go on, so a long document
costs its source no more than itself. All documents are range-sorted by finish time and
the mix takes them until the total budget is used, so at any cut the sources stand at the
same share of their targets. A source whose target exceeds its size is queued again, up
to ``max_repeat`` times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.llm.common import packed_row, running_total, unpacked
from threadlens.session import cut_lineage


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3
) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code-point order, null last, take the weights in turn and share the total
    size by them. A target stops at ``max_repeat`` times its source's size; the excess is
    shared again by weight until no target is above. Sources without words get 0."""
    sources = cut_lineage(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("__last", F.col("source").isNull())
        .withColumn("__one", F.lit(1))
    )
    ranked = running_total(sources, ["__last", "source"], "__one", "__rank")
    turn = (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int")
    ranked = cut_lineage(
        ranked.withColumn(
            "weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn)
        ).select("source", "source_size", "weight")
    )
    most = F.lit(float(max_repeat)) * F.col("source_size")
    level, capped = 0.0, -1  # tokens per unit of weight; sources at their most
    while True:
        full = F.col("weight") * level >= most
        n, taken, total, rest = ranked.agg(
            F.sum(full.cast("long")), F.sum(F.when(full, most).otherwise(0.0)),
            F.sum("source_size"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
        ).first()
        if n is None or n == capped or not rest:
            break
        capped, level = n, (total - taken) / rest
    return ranked.withColumn("target", F.least(most, F.col("weight") * level)).drop("weight")


FRONT = 1_000  # documents per source that one step behind the first stop looks at


def mix_sources(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3,
    seed: int = 17,
) -> DataFrame:
    """``sizes`` (row: unique long, doc_id, source, size) with source_size, target and
    ``copies``: how often the mix takes the row, 0 to ``max_repeat``.

    A source is taken as often as its target holds it; the rest of the target goes to its
    documents in shuffled order, those that do not fit any more passed over. So a source
    stays below its target, by less than the smallest document it has left.

    The shuffle is the MD5 of ``seed`` and doc_id, so reruns agree; equal hashes are
    ordered by doc_id, size and row. Sizes must not be negative; a null size counts 0.
    A row of size 0 is taken as often as its whole source, once at least."""
    sizes = cut_lineage(
        sizes.select("row", "doc_id", "source", F.coalesce("size", F.lit(0)).alias("size"))
        .withColumn("__hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id"))))
    )
    targets = cut_lineage(
        source_targets(sizes, weights, max_repeat).select(
            F.col("source").alias("__s"), "source_size", "target",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
            .otherwise(0).cast("int").alias("__whole"),
        ).withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size"))
    )
    # The budget is what the targets add up to: all words of all sources.
    budget = sizes.agg(F.sum("size")).scalar()
    order = ["__hash", "doc_id", "size", "row"]
    queued = cut_lineage(
        running_total(sizes.where(F.col("size") > 0), order, "size", "__sum", by=["source"])
        .join(targets, F.col("source").eqNullSafe(F.col("__s")))
    )
    fitting = _fitting(queued, order)
    times = F.explode(F.sequence(F.lit(0), F.col("__whole") - 1)).alias("__turn")
    columns = ["row", "size", "__hash", "__turn", "__finish"]
    finish = (F.col("__turn") * F.col("source_size") + F.col("__sum")) / F.col("target")
    whole = queued.where(F.col("__whole") > 0).select("*", times)
    offered = whole.withColumn("__finish", finish).select(*columns).unionByName(
        fitting.withColumn("__turn", F.col("__whole")).withColumn("__finish", finish).select(*columns)
    )
    taken = (
        running_total(offered, ["__finish", "__hash", "row", "__turn"], "size", "__total")
        .where(F.col("__total") <= F.coalesce(budget, F.lit(0)))
        .groupBy("row").agg(F.count("*").cast("int").alias("copies"))
        .withColumnRenamed("row", "__row")
    )
    empty = F.when(F.col("size") == 0, F.greatest("__whole", F.lit(1))).otherwise(0)
    return (
        sizes.join(taken, F.col("row") == F.col("__row"), "left")
        .join(targets, F.col("source").eqNullSafe(F.col("__s")), "left")
        .select(
            "row", "doc_id", "source", "size", "source_size", "target",
            F.coalesce("copies", empty).alias("copies"),
        )
    )


def _fitting(queued: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows that take what whole turns leave of their source's target (``__rest``),
    with ``__sum`` as what is taken up to and including them.

    In queue order a row is taken if it still fits. Up to the first that does not, that
    is a running total over all rows. Behind it only rows that fit what is left count, so
    each further step takes a run of those and stops at one that is too long for good;
    it looks at the first ``FRONT`` of each source."""
    first = F.col("__sum") <= F.col("__rest")
    taken = queued.where(first)
    rows = queued.select("row", "size", "source", "__sum", "__whole", "__rest", "source_size",
                         "target", *order[:2])
    used = rows.where(F.col("__sum") <= F.col("__rest")).groupBy(F.col("source").alias("us")).agg(
        F.max("__sum").alias("used")
    )
    left = cut_lineage(
        rows.where(~first).join(used, F.col("source").eqNullSafe(F.col("us")), "left")
        .withColumn("used", F.coalesce("used", F.lit(0))).drop("us", "__sum")
        .where(F.col("used") + F.col("size") <= F.col("__rest"))
    )
    columns = ["row", "size", "__hash", "source_size", "target", "__whole", "__sum"]
    taken = taken.select(*columns)
    by = W.partitionBy("source").orderBy(*order)
    upto = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    while not left.isEmpty():
        front = left.withColumn("place", F.row_number().over(by)).where(F.col("place") <= FRONT)
        run = cut_lineage(
            front.withColumn("__sum", F.col("used") + F.sum("size").over(upto))
            .where(F.col("__sum") <= F.col("__rest")).drop("used", "place")
        )
        taken = taken.unionByName(run.select(*columns))
        last = run.groupBy(F.col("source").alias("ls")).agg(
            F.max("__sum").alias("now"), F.max(F.struct(*order)).alias("last")
        )
        left = cut_lineage(
            left.join(last, F.col("source").eqNullSafe(F.col("ls")))
            .where((F.struct(*order) > F.col("last")) & (F.col("now") + F.col("size") <= F.col("__rest")))
            .withColumn("used", F.col("now")).drop("now", "last", "ls")
        )
    return taken


def mix_documents(docs: DataFrame, size: str, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the same columns.
    ``size`` names a column of ``docs``; ``source`` and ``doc_id`` must be there too."""
    rows = cut_lineage(
        docs.select(
            packed_row(docs.columns), "doc_id", "source", F.col(size).alias("size"),
            F.monotonically_increasing_id().alias("number"),
        )
    )
    sizes = rows.select(F.col("number").alias("row"), "doc_id", "source", "size")
    copies = mix_sources(sizes, **options).where(F.col("copies") > 0).select(
        F.col("row").alias("taken"), F.sequence(F.lit(1), F.col("copies")).alias("turns")
    )
    return (
        rows.join(copies, F.col("number") == F.col("taken"))
        .select("row", F.explode("turns").alias("turn"))
        .select(*unpacked(docs.columns))
    )
