"""Session settings and the checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Adaptive execution re-plans joins from run-time sizes and splits skewed join
# partitions; the rest keeps time zones and arithmetic predictable.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "threadlens", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. A session on one
    machine (tests) gets a temporary folder; a cluster must name one that all see."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="threadlens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_open = threading.local()  # the scratch folders of the running thread


def run_dir(spark: SparkSession, purpose: str, outer: bool = False) -> str:
    """A fresh path below the shared folder, or below the thread's scratch folder;
    ``outer`` asks for one that outlives the innermost scratch folder."""
    bases = [f"{shared_dir(spark)}/threadlens", *getattr(_open, "folders", [])]
    base = bases[-2] if outer and len(bases) > 1 else bases[-1]
    return f"{base}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that ``cut_lineage`` writes inside the block are deleted at its end.

    Nothing that is read later may depend on them: write the result within the block, by
    ``cut_lineage(result, outer=True)`` for instance."""
    path = run_dir(spark, "scratch")
    _open.folders = [*getattr(_open, "folders", []), path]
    try:
        yield path
    finally:
        _open.folders = _open.folders[:-1]
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df, outer: bool = False, **options):
    """Materialise ``df`` as a table in the shared folder and read it back.

    Used where a result feeds several jobs (iterative model fits, two-pass
    sampling). Unlike executor-local blocks the files survive lost executors. With
    ``outer`` the table outlives the innermost ``scratch`` block; ``options`` are the
    writer's."""
    path = run_dir(df.sparkSession, "table", outer)
    store(df, path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def store(df, path: str, mode: str = "error", **options) -> None:
    """Write ``df`` and drop the shuffles it took, which else stay on the executors' disks
    until the driver happens to collect its garbage."""
    with settings(df.sparkSession, _DROP_SHUFFLES):
        df.write.options(**options).mode(mode).parquet(path)


def collected(df):
    """All rows as an Arrow table, without the shuffles they took."""
    with settings(df.sparkSession, _DROP_SHUFFLES):
        return df.toArrow()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings within the block; a stream keeps those it was started with."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
