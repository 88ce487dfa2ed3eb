"""Near-duplicate documents: SuperMinHash, banding, exact verification, union-find.

Texts with the same shingle set are one class from the start. Classes that share all
registers of a band meet in a bucket; each candidate pair is confirmed on the full sets.
With 40 bands of 6 registers a pair of similarity 0.8 misses all bands with a chance of
5e-6, more similar ones with less; a pair of similarity 0.3 meets with a chance of 3 %.

A bucket is not expanded into its pairs. Its smallest class is compared with the others,
and confirmed links are grouped. Buckets that still hold more than one group form cells,
one per largest group of a bucket. In a cell every class is described by what it differs
in from one class of that group, the reference. Two classes are similar enough exactly if
their differences share a certain number of shingles, which follows from the sizes alone,
so a prefix of each difference, rarest shingles first, is enough to find all pairs that
can be linked (prefix and position filter). What near copies have in common is in no
difference: a large group of near copies costs its differences, and a class that can be
linked with nothing makes no pairs. No link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.llm.graph import components
from threadlens.llm.superminhash import band_keys, shingle_set, signatures
from threadlens.session import cut_lineage, scratch

BANDS, ROWS = 40, 6
SLICE_SHINGLES = 60_000  # shingles whose signatures a task computes at a time


def _sketches(words: int, bands: int, rows: int):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, sets, size = [], [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids.append(doc_id)
                sets.append(shingle_set(text, words))
                size += len(sets[-1])
                if size >= SLICE_SHINGLES:
                    yield frame(ids, sets)
                    ids, sets, size = [], [], 0
            if ids:
                yield frame(ids, sets)

    def frame(ids: list, sets: list[np.ndarray]) -> pd.DataFrame:
        keys = band_keys(signatures(sets, bands * rows), rows).view(np.int64)
        return pd.DataFrame(
            {
                "doc_id": pd.array(ids, dtype="Int64"),
                "n_shingles": [len(s) for s in sets],
                "set_hash": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "keys": [k if len(s) else [] for k, s in zip(keys, sets)],
            }
        )

    return sketch


def _full_sets(words: int):
    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                sets = [shingle_set(t, words).view(np.int64) for t in part["text"]]
                yield pd.DataFrame(
                    {"doc_id": part["doc_id"], "n": list(map(len, sets)), "set": sets}
                )

    return full


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as (a, b)."""
    one = sets.select(F.col("doc_id").alias("ida"), F.col("n").alias("na"), F.col("set").alias("sa"))
    two = sets.select(F.col("doc_id").alias("idb"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    # Sizes first: the smaller set bounds the intersection, the larger the union.
    sized = (
        pairs.join(one.drop("sa"), F.col("a") == F.col("ida"))
        .join(two.drop("sb"), F.col("b") == F.col("idb"))
        .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        .select("a", "b")
    )
    sized = cut_lineage(sized)
    both = sized.join(one, F.col("a") == F.col("ida")).join(two, F.col("b") == F.col("idb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.col("na") + F.col("nb") - F.col("shared")
    linked = both.withColumn("shared", shared).where(F.col("shared") * 100 >= union * percent)
    return cut_lineage(linked.select("a", "b"))


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5,
    percent: int = 80, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of ``words``-word shingles have a Jaccard
    similarity of ``percent`` / 100 or more; ``component_id`` is the smallest id that
    links reach, and ``kept`` marks the document of that id.

    A null, empty or blank text has no shingles and links with nothing. Rows that repeat
    an id are one document with the links of all its texts. Rows with a null id link with
    nothing; their component_id is null and they are kept. Ids must be integers."""
    if bands * rows > 256:
        raise ValueError("a signature has at most 256 registers")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with scratch(docs.sparkSession):
        sketches = cut_lineage(
            source.mapInPandas(
                _sketches(words, bands, rows),
                "doc_id long, n_shingles long, set_hash binary, keys array<long>",
            )
        )
        real = sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        classes = cut_lineage(
            real.groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
            .select(F.col("set_hash").alias("hash"), "rep")
        )
        found = _groups(source, real, classes, words, percent)
        return cut_lineage(_grouped(sketches, classes, found), outer=True)


def _groups(source, real, classes, words: int, percent: int) -> DataFrame:
    """(node, component) of the classes that share a bucket with another one."""
    # A document of the class's smallest id may repeat; it is the same class.
    reps = real.join(
        classes, (F.col("doc_id") == F.col("rep")) & (F.col("set_hash") == F.col("hash")),
        "left_semi",
    )
    entries = reps.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key")).distinct()
    counted = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("first"))
    shared = cut_lineage(
        counted.where(F.col("n") > 1).select(F.col("key").alias("bucket"), "first")
    )
    buckets = cut_lineage(entries.join(shared, F.col("key") == F.col("bucket")).drop("bucket"))
    wanted = buckets.select("rep").distinct()
    sets = cut_lineage(
        source.join(wanted, F.col("doc_id") == F.col("rep"), "left_semi")
        .mapInPandas(_full_sets(words), "doc_id long, n long, set array<long>")
    )
    with scratch(source.sparkSession):
        pairs = cut_lineage(
            buckets.where(F.col("rep") != F.col("first"))
            .select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
        )
        links = _confirmed(pairs, sets, percent).unionByName(_same_id(real, classes))
        known = components(links).withColumnRenamed("node", "n")
        everyone = buckets.select(F.col("rep").alias("node")).union(links.select("a"))
        everyone = everyone.union(links.select("b")).distinct()
        groups = cut_lineage(
            everyone.join(known, F.col("node") == F.col("n"), "left")
            .select("node", F.coalesce("component", "node").alias("component")),
            outer=True,
        )
    with scratch(source.sparkSession):
        links = _remaining(buckets, groups, sets, percent)
        return _merged(groups, links)


def _same_id(real: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of an id whose rows have different texts."""
    code = F.xxhash64("set_hash")
    several = (
        real.groupBy("doc_id").agg(F.min(code).alias("low"), F.max(code).alias("high"))
        .where(F.col("low") != F.col("high")).select(F.col("doc_id").alias("id"))
    )
    rows = real.select("doc_id", "set_hash").join(several, F.col("doc_id") == F.col("id"), "left_semi")
    return cut_lineage(
        rows.join(classes, F.col("set_hash") == F.col("hash"))
        .where(F.col("doc_id") != F.col("rep"))
        .select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    )


def _cells(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """(cell, rep, group) of the buckets with several groups; a cell is named by the
    largest group of a bucket. The pair of a bucket of two has been compared before."""
    grouped = buckets.join(groups, F.col("rep") == F.col("node")).select(
        "key", "rep", F.col("component").alias("group")
    )
    counts = grouped.groupBy("key", "group").agg(F.count("*").alias("n"))
    several = (
        counts.groupBy("key").agg(
            F.max(F.struct("n", "group")).alias("most"), F.count("*").alias("groups"),
            F.sum("n").alias("size"),
        )
        .where((F.col("groups") > 1) & (F.col("size") > 2))
        .select(F.col("key").alias("open"), F.col("most.group").alias("cell"))
    )
    return grouped.join(several, F.col("key") == F.col("open")).select("cell", "rep", "group").distinct()


def _differences(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(entry, cell, first, rep, group, d, weight, wide, shingles): each class of a cell by
    the ``d`` shingles in which it differs from the reference, the ``first`` class of the
    cell's group.

    Sets of n and m shingles that differ in x of them are linked if
    (100 + percent) x <= (100 - percent) (n + m). With their differences from the reference
    that is: they share at least (weight + other weight) / (2 (100 + percent)) shingles,
    where ``weight`` is (100 + percent) d - (100 - percent) n. The reference has the least
    weight of all, -``wide``."""
    first = cells.where(F.col("group") == F.col("cell")).groupBy(F.col("cell").alias("of")).agg(
        F.min("rep").alias("first")
    )
    reference = (
        first.join(sets, F.col("first") == F.col("doc_id")).groupBy("of", "first")
        .agg(F.min(F.struct("n", "set")).alias("ref"))  # an id may have several sets
        .select("of", "first", F.col("ref.n").alias("ref_n"), F.col("ref.set").alias("ref_set"))
    )
    described = cells.join(sets, F.col("rep") == F.col("doc_id")).join(
        reference, F.col("cell") == F.col("of")
    )
    differs = F.concat(F.array_except("set", "ref_set"), F.array_except("ref_set", "set"))
    return described.select(
        F.monotonically_increasing_id().alias("entry"), "cell", "first", "rep", "group", "n",
        "ref_n", differs.alias("shingles"),
    ).withColumn("d", F.size("shingles").cast("long")).select(
        "entry", "cell", "first", "rep", "group", "d", "shingles",
        ((100 + percent) * F.col("d") - (100 - percent) * F.col("n")).alias("weight"),
        ((100 - percent) * F.col("ref_n")).alias("wide"),
    )


def _remaining(buckets: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) between classes of different groups in the buckets that hold
    several, all that can join groups."""
    cells = cut_lineage(_cells(buckets, groups))
    spread = cut_lineage(_differences(cells, sets, percent))
    outside = F.col("group") != F.col("cell")
    # A weight up to ``wide`` is a link with the reference; the other classes outside the
    # cell's group must share a shingle of their difference with whatever they link with.
    sure = spread.where(outside & (F.col("weight") <= F.col("wide"))).select(
        F.col("first").alias("a"), F.col("rep").alias("b")
    )
    asks = outside & (F.col("weight") > F.col("wide"))
    least = spread.groupBy(F.col("cell").alias("of")).agg(
        F.min("weight").alias("least"), F.min(F.when(asks, F.col("weight"))).alias("least_asked")
    )
    double = 2 * (100 + percent)
    # As many of an entry's shingles, rarest first, as must hold one that it shares with
    # any entry it can be linked with: as a question, and as an answer to one.
    needed = lambda other: F.greatest(
        F.ceil((F.col("weight") + F.col(other)) / double), F.lit(1)
    )
    sized = (
        spread.join(least, F.col("cell") == F.col("of"))
        .where(F.col("least_asked").isNotNull())
        .withColumn("asked", F.when(asks, F.col("d") - needed("least") + 1).otherwise(F.lit(0)))
        .withColumn("given", F.col("d") - needed("least_asked") + 1)
        .where((F.col("asked") > 0) | (F.col("given") > 0))
        .drop("of", "first", "least", "least_asked", "wide")
    )
    sized = cut_lineage(sized)
    met = _sharing(sized, double)
    pairs = met.select(F.least("rep", "orep").alias("a"), F.greatest("rep", "orep").alias("b"))
    return cut_lineage(_confirmed(cut_lineage(pairs.distinct()), sets, percent).unionByName(sure))


def _sharing(sized: DataFrame, double: int) -> DataFrame:
    """Pairs of entries of a cell and of different groups that share a shingle at places
    which leave room for as many as they need."""
    tokens = sized.select("cell", "entry", F.explode("shingles").alias("shingle"))
    often = (
        tokens.groupBy(F.col("cell").alias("of"), F.col("shingle").alias("s"))
        .agg(F.count("*").alias("times")).where(F.col("times") > 1)
    )
    common = tokens.join(often, (F.col("cell") == F.col("of")) & (F.col("shingle") == F.col("s")))
    # Shingles that no other entry has come first; an entry has as many as it lacks here.
    own = W.partitionBy("entry")
    placed = common.select(
        F.col("entry").alias("e"), "shingle",
        (F.row_number().over(own.orderBy("times", "shingle")) - F.count("*").over(own)).alias("place"),
    )
    rows = (
        sized.drop("shingles").join(placed, F.col("entry") == F.col("e"))
        .withColumn("left", -F.col("place")).withColumn("place", F.col("d") + F.col("place"))
        .where(F.col("place") <= F.greatest("asked", "given"))
    )
    rows = cut_lineage(rows.drop("e"))
    answers = rows.where(F.col("place") <= F.col("given")).select(
        F.col("cell").alias("ocell"), F.col("shingle").alias("oshingle"), F.col("rep").alias("orep"),
        F.col("group").alias("ogroup"), F.col("weight").alias("oweight"), F.col("left").alias("oleft"),
    )
    room = 1 + F.least("left", "oleft")
    return rows.where(F.col("place") <= F.col("asked")).join(
        answers,
        (F.col("cell") == F.col("ocell")) & (F.col("shingle") == F.col("oshingle"))
        & (F.col("group") != F.col("ogroup"))
        & (double * room >= F.col("weight") + F.col("oweight")),
    )


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Groups after new links: the links join whole groups, so only groups are searched."""
    one = groups.select(F.col("node").alias("x"), F.col("component").alias("ga"))
    two = groups.select(F.col("node").alias("y"), F.col("component").alias("gb"))
    between = links.join(one, F.col("a") == F.col("x")).join(two, F.col("b") == F.col("y"))
    joined = components(between.select(F.col("ga").alias("a"), F.col("gb").alias("b")))
    joined = joined.select(F.col("node").alias("old"), F.col("component").alias("new"))
    return cut_lineage(
        groups.join(joined, F.col("component") == F.col("old"), "left")
        .select("node", F.coalesce("new", "component").alias("component")),
        outer=True,
    )


def _grouped(sketches, classes, found) -> DataFrame:
    """Bring the groups back to the documents."""
    classes = cut_lineage(
        classes.join(found, F.col("rep") == F.col("node"), "left")
        .select("hash", F.coalesce("component", "rep").alias("group"))
    )
    out = sketches.join(
        classes, (F.col("set_hash") == F.col("hash")) & (F.col("n_shingles") > 0), "left"
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return (
        out.withColumn("component_id", component)
        .withColumn("kept", kept)
        .select("doc_id", "n_shingles", "component_id", "kept")
    )
