"""Splits, top-n picks and stratified samples.

"Random" picks follow md5(seed:key), so they repeat on any cluster. A sample is
drawn in two steps. First one pass ranks narrow (ids, rank keys) rows in all
buckets at once; ``row_number() <= n`` is applied before the shuffle too (group
limit), so a bucket holding most of the data sends n rows per task. Then the few
chosen ids fetch their full rows through a broadcast semi join of bounded size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx
from threadlens.functions import text as tx
from threadlens.operators.dedup import concat_parts, dedup_text
from threadlens.operators.goldset import with_seq_id
from threadlens.operators.labelling import sampling_reason
from threadlens.operators.sizing import broadcast_bounded

SALTS = 64
SEED = 42
PAIR_IDS = ["customer_tweet_id", "brand_tweet_id"]
_UNIT = float(16**8)


# -- grouped train / validation split ----------------------------------------


def _position(key: str, seed: int) -> Column:
    """The first 32 bits of the seeded hash, as a number."""
    return F.conv(F.substring(tx.seeded_hash(seed, key), 1, 8), 16, 10).cast("bigint")


def group_split(df: DataFrame, key: str, fraction: float = 0.15, seed: int = SEED) -> DataFrame:
    """Add ``split``; all rows of a group fall on one side. No shuffle: the side
    depends on the hash of the group key alone, so the share is approximate."""
    cut = int(fraction * _UNIT)
    return df.withColumn(
        "split",
        F.when(_position(key, seed) < cut, F.lit("validation")).otherwise(F.lit("train")),
    )


def group_split_exact(
    df: DataFrame, key: str, fraction: float = 0.15, seed: int = SEED, bins: int = 4096
) -> DataFrame:
    """Like ``group_split`` but exactly ceil(fraction x groups) groups validate: those
    with the smallest hashes.

    Only the hash of the last such group is looked up; the rows themselves compare
    their own hash with it and are not shuffled. A histogram over ``bins`` hash ranges
    gives the rank at which each range starts, so nothing is sorted globally."""
    groups = df.where(F.col(key).isNotNull()).select(key).distinct().select(
        tx.seeded_hash(seed, key).alias("__h"),
        F.floor(_position(key, seed) / F.lit(_UNIT / bins)).cast("int").alias("__bin"),
    )
    sizes = groups.groupBy("__bin").agg(F.count("*").alias("__n"))
    wanted = sizes.agg(F.ceil(F.sum("__n") * F.lit(fraction))).scalar()
    before = W.orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)  # at most `bins` rows
    starts = sizes.select(
        "__bin", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    crossing = starts.where(
        (F.col("__start") < wanted) & (F.col("__start") + F.col("__n") >= wanted)
    )
    inside = W.partitionBy("__bin").orderBy("__h")
    last = (
        groups.join(broadcast_bounded(crossing, 1), "__bin")
        .withColumn("__rank", F.col("__start") + F.row_number().over(inside))
        .where(F.col("__rank") == wanted)
        .select("__h")
        .scalar()
    )
    validates = tx.seeded_hash(seed, key) <= last
    return df.withColumn(
        "split", F.when(validates, F.lit("validation")).otherwise(F.lit("train"))
    )


# -- picks -------------------------------------------------------------------


def top_per_group(
    df: DataFrame, group: str, order: Sequence[Column | str], n: int, rank: str = "rank"
) -> DataFrame:
    w = W.partitionBy(group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def examples_per_label(
    df: DataFrame, label: str = "candidate_intent", n: int = 10,
    order: Sequence[str] = ("customer_created_at", *PAIR_IDS),
) -> DataFrame:
    return top_per_group(df, label, order, n, "example_rank")


def capped_examples(df: DataFrame, flag: str, n: int = 500,
                    order: Sequence[str] = PAIR_IDS) -> DataFrame:
    return df.where(flag).orderBy(*order).limit(n)


def sample_n(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    return df.orderBy(tx.seeded_hash(seed, key), key).limit(n)


def _random_key(seed: int = SEED) -> Column:
    return tx.seeded_hash(seed, *PAIR_IDS)


# -- v1 extracts and review pool ---------------------------------------------


def bucket_candidates_v1(labelled: DataFrame, n: int = 60) -> DataFrame:
    """The n best rows per intent for review: ambiguity, bars in the signal list
    and number of turns."""
    bars = F.greatest(F.size("signals") - 1, F.lit(0))
    priority = F.col("ambiguity_score") + bars + F.col("context_turn_count")
    ranked = labelled.withColumn("review_priority", priority)
    return top_per_group(
        ranked, "candidate_intent", [F.desc("review_priority"), *PAIR_IDS], n, "review_rank"
    )


def ambiguous_extract_v1(labelled: DataFrame, n: int = 100) -> DataFrame:
    return (
        labelled.where(F.col("ambiguity_score") >= 2)
        .orderBy(F.desc("ambiguity_score"), F.desc("context_turn_count"), *PAIR_IDS)
        .limit(n)
    )


def escalation_extract_v1(labelled: DataFrame, n: int = 100) -> DataFrame:
    return (
        labelled.where(F.size("signals") > 0)
        .orderBy(F.desc(F.size("signals")), *PAIR_IDS)
        .limit(n)
    )


def _ranked_buckets(df: DataFrame, buckets: Column, limits: Mapping[str, int]) -> DataFrame:
    """Rank (ids, bucket, keys) rows inside every bucket in one pass.

    ``buckets`` is an array of struct(slice, bucket, k1, k2, k3), null entries for
    buckets the row is not in. ``slice`` picks the limit. Returns rank and ids."""
    narrow = df.select(*PAIR_IDS, F.explode(F.array_compact(buckets)).alias("b")).select(
        *PAIR_IDS, "b.*"
    )
    order = ["k1", "k2", "k3", *PAIR_IDS]
    w = W.partitionBy("slice", "bucket").orderBy(*order)
    most = max(limits.values())
    limit_of = F.coalesce(*[F.when(F.col("slice") == s, F.lit(n)) for s, n in limits.items()])
    # A bucket may hold all rows. Up to Spark's threshold a limit cuts every task's rows
    # before the shuffle; beyond it the bucket's salted parts are limited first, so that
    # the final ranking sees at most SALTS x limit rows of it.
    if most > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        parts = W.partitionBy("slice", "bucket", "salt").orderBy(*order)
        narrow = (
            narrow.withColumn("salt", F.pmod(F.xxhash64(*PAIR_IDS), F.lit(SALTS)))
            .withColumn("place", F.row_number().over(parts)).where(F.col("place") <= most)
        )
    return (
        narrow.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
        .where(F.col("rank") <= limit_of)
        .select(*PAIR_IDS, "slice", "bucket", "rank")
    )


def _entry(slice_: str, bucket: Column | str, k1=0, k2=0, k3="") -> Column:
    def num(v):
        return v.cast("double") if isinstance(v, Column) else F.lit(float(v))

    return F.struct(
        F.lit(slice_).alias("slice"),
        (bucket if isinstance(bucket, Column) else F.lit(bucket)).alias("bucket"),
        num(k1).alias("k1"),
        num(k2).alias("k2"),
        (k3 if isinstance(k3, Column) else F.lit(k3)).alias("k3"),
    )


def _hard_then_random(ranked: DataFrame, total: Column, hard: Column) -> DataFrame:
    """Per bucket the ``hard`` best rows, then random rows up to ``total``.

    ``ranked`` holds the slices 'hard' and 'random', each at least ``total`` deep:
    of the first ``total`` random rows at most ``hard`` are already taken, so the
    rest always suffices. A bucket smaller than ``total`` comes whole."""
    ids = [*PAIR_IDS, "bucket"]
    picked_hard = ranked.where((F.col("slice") == "hard") & (F.col("rank") <= hard)).select(
        *ids, F.lit(0).alias("part"), F.col("rank").alias("place")
    )
    rest = ranked.where(F.col("slice") == "random").join(
        picked_hard.select(*ids), ids, "left_anti"
    )
    w = W.partitionBy("bucket").orderBy("rank")
    picked_random = (
        rest.withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= total - hard)
        .select(*ids, F.lit(1).alias("part"), "place")
    )
    return picked_hard.unionByName(picked_random)


def review_pool_v1(
    labelled: DataFrame, n: int = 60, seed: int = SEED, compat: bool = False
) -> DataFrame:
    """Stratified review pool: per intent n rows (half hardest, half random), plus
    the n most ambiguous and the n with most escalation signals, each pair once, in
    shuffled order (``pool_order``).

    Escalation strength counts signals; ``compat=True`` measures the length of the
    joined signal text instead."""
    strength = F.length("escalation_signals") if compat else F.size("signals")
    hardness = F.col("context_turn_count") * 2 + F.col("ambiguity_score") + strength
    intent = F.col("candidate_intent")
    buckets = F.array(
        _entry("hard", intent, -hardness),
        _entry("random", intent, k3=_random_key(seed)),
        F.when(
            F.col("ambiguity_score") >= 2,
            _entry("ambiguous", "", -F.col("ambiguity_score"), -F.col("context_turn_count")),
        ),
        F.when(F.size("signals") > 0, _entry("escalation", "", -strength)),
    )
    depth = {"hard": n, "random": n, "ambiguous": n, "escalation": n}
    ranked = _ranked_buckets(labelled, buckets, depth)
    extra = ranked.where(F.col("slice").isin("ambiguous", "escalation"))
    # Half the bucket is hard; a bucket below n rows is taken whole either way.
    chosen = concat_parts(
        _hard_then_random(ranked, F.lit(n), F.lit(n // 2)).select(*PAIR_IDS),
        extra.select(*PAIR_IDS),
    ).distinct()
    bound = n * (len(lx.V1_INTENTS) + 2)
    pool = labelled.join(broadcast_bounded(chosen, bound), PAIR_IDS, "left_semi")
    order = W.orderBy(tx.seeded_hash(seed + 1, *PAIR_IDS), *PAIR_IDS)  # `bound` rows at most
    return pool.withColumn("pool_order", F.row_number().over(order))


# -- v2 extracts, golden set and backup pool ---------------------------------


def distinct_messages_v2(
    labelled: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per cleaned message, the earliest; empty messages dropped. ``columns`` names
    those to keep."""
    return dedup_text(
        labelled, tx.clean_sampling("current_customer_message"),
        ["customer_created_at", *PAIR_IDS], name="clean_current", columns=columns,
    )


def extracts_v2(distinct: DataFrame) -> DataFrame:
    """Long form of the candidate extracts: a row per (extract, message).

    Every intent, plus ambiguous, escalation and unknown_or_ambiguous. Write it with
    ``partitionBy('extract')``; ``sort_1``/``sort_2`` give the order inside one."""
    intents = F.when(
        F.col("candidate_intent").isin(list(lx.V2_INTENTS)),
        F.struct(
            F.col("candidate_intent").alias("extract"),
            F.col("candidate_score").alias("sort_1"),
            F.col("ambiguity_score").alias("sort_2"),
        ),
    )

    def extract(flag: Column, name: str) -> Column:
        return F.when(
            flag,
            F.struct(
                F.lit(name).alias("extract"), F.col("ambiguity_score").alias("sort_1"),
                F.lit(0).alias("sort_2"),
            ),
        )

    entries = F.array_compact(
        F.array(
            intents,
            extract(F.col("ambiguity_candidate"), "ambiguous"),
            extract(F.col("escalation_candidate"), "escalation"),
            extract(F.col("candidate_intent").isin("unknown", "ambiguous"), "unknown_or_ambiguous"),
        )
    )
    return distinct.withColumn("__e", F.explode(entries)).select(*distinct.columns, "__e.*")


def _hard_quota(quota: int) -> int:
    return max(1, round(quota * 0.40))


def _quota_of(values: Mapping[str, int]) -> Column:
    return F.coalesce(*[F.when(F.col("bucket") == k, F.lit(v)) for k, v in values.items()])


def quota_sample_v2(
    distinct: DataFrame, quotas: Mapping[str, int] = lx.V2_QUOTAS, seed: int = SEED,
    size: int = 200, ambiguous: int = 15, escalation: int = 15,
) -> DataFrame:
    """Ids of the golden sample, with ``part`` and ``place`` giving its order.

    Per intent its quota from unambiguous, non-escalating rows: 40% by hard score,
    the rest random; then the top ambiguous and the top escalating rows; then the
    best remaining rows until ``size`` is reached."""
    plain = ~F.col("ambiguity_candidate") & ~F.col("escalation_candidate")
    heavy = (F.col("context_turn_count") >= 2).cast("int")
    in_pool = plain & F.col("candidate_intent").isin(list(quotas))
    intent = F.col("candidate_intent")
    backfill = (
        F.col("context_turn_count") + F.col("ambiguity_score")
        + F.col("escalation_candidate").cast("int")
    )
    buckets = F.array(
        F.when(in_pool, _entry("hard", intent, -(F.col("ambiguity_score") + heavy))),
        F.when(in_pool, _entry("random", intent, k3=_random_key(seed))),
        F.when(
            F.col("ambiguity_candidate"),
            _entry("ambiguous", "", -F.col("ambiguity_score"), -F.col("context_turn_count")),
        ),
        F.when(
            F.col("escalation_candidate") & ~F.col("ambiguity_candidate"),
            _entry("escalation", "", -F.size("escalation_flags"), -F.col("ambiguity_score")),
        ),
        _entry("backfill", "", -backfill),
    )
    depth = {
        "hard": max(quotas.values()), "random": max(quotas.values()),
        "ambiguous": ambiguous, "escalation": escalation, "backfill": 2 * size,
    }
    ranked = _ranked_buckets(distinct, buckets, depth)
    hard = {k: _hard_quota(v) for k, v in quotas.items()}
    balanced = _hard_then_random(ranked, _quota_of(quotas), _quota_of(hard))
    bucket_no = _quota_of({k: i for i, k in enumerate(quotas)})
    balanced = balanced.select(
        *PAIR_IDS, (bucket_no * 2 + F.col("part")).alias("part"), "place"
    )
    last = 2 * len(quotas)
    slices = ranked.where(F.col("slice").isin("ambiguous", "escalation")).select(
        *PAIR_IDS,
        F.when(F.col("slice") == "ambiguous", last).otherwise(last + 1).alias("part"),
        F.col("rank").alias("place"),
    )
    chosen = balanced.unionByName(slices)
    # Of the first 2 x size backfill rows at most `size` are chosen already.
    spare = ranked.where(F.col("slice") == "backfill").join(
        chosen.select("customer_tweet_id"), "customer_tweet_id", "left_anti"
    )
    filled = chosen.unionByName(
        spare.select(*PAIR_IDS, F.lit(last + 2).alias("part"), F.col("rank").alias("place"))
    )
    return filled.orderBy("part", "place").limit(size)


def golden_sample_v2(
    distinct: DataFrame, prefix: str = "GS", quotas: Mapping[str, int] = lx.V2_QUOTAS,
    seed: int = SEED, size: int = 200, ambiguous: int = 15, escalation: int = 15,
) -> DataFrame:
    """The golden sample with ``sampling_reason`` and sequential ``golden_id``."""
    ids = quota_sample_v2(distinct, quotas, seed, size, ambiguous, escalation)
    rows = distinct.join(broadcast_bounded(ids, size), PAIR_IDS)
    numbered = with_seq_id(rows, "golden_id", prefix, ["part", "place"])
    return numbered.withColumn("sampling_reason", sampling_reason()).drop("part", "place")


def backup_pool_v2(
    distinct: DataFrame, golden: DataFrame, prefix: str = "BK", seed: int = SEED,
    size: int = 600, hard: int = 300, golden_rows: int = 200,
) -> DataFrame:
    """Rows outside the golden sample: the ``hard`` highest priorities, then random
    rows up to ``size``, with sequential ``backup_id``."""
    left = distinct.join(
        broadcast_bounded(golden.select("customer_tweet_id"), golden_rows),
        "customer_tweet_id", "left_anti",
    )
    priority = (
        F.col("ambiguity_score") + F.col("escalation_candidate").cast("int") * 2
        + (F.col("context_turn_count") >= 2).cast("int")
    )
    buckets = F.array(
        _entry("hard", "", -priority), _entry("random", "", k3=_random_key(seed))
    )
    ranked = _ranked_buckets(left, buckets, {"hard": size, "random": size})
    ids = _hard_then_random(ranked, F.lit(size), F.lit(hard)).select(*PAIR_IDS, "part", "place")
    rows = left.join(broadcast_bounded(ids, size), PAIR_IDS)
    return with_seq_id(rows, "backup_id", prefix, ["part", "place"]).drop("part", "place")
