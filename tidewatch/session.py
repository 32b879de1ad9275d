"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

# Whether the shuffle files of a query go when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Paths that the steps of a `settled` block have written on shared storage.
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    # rows that a Python task holds at a time: whole texts, so its memory does not grow with the table
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator assumes."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, as named in `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    configured = tempfile.mkdtemp(prefix="tidewatch-")
    spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Queries planned in this block remove their shuffle files when they end: their result is on shared storage by then."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


def _note(path: str) -> None:
    if (written := _written.get()) is not None:
        written.append(path)


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def durable(df: DataFrame) -> DataFrame:
    """Materialise on shared storage and cut the lineage; survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    with _tidy(df.sparkSession):
        kept = df.select("*").checkpoint(eager=True)
    if _written.get() is not None:
        _note(kept._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return kept


def stored(df: DataFrame) -> DataFrame:
    """As durable, in compressed columns: a reader takes those it names only, and a join knows the size."""
    path = scratch_path(df.sparkSession, "stored")
    _note(path)
    with _tidy(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(kept: DataFrame) -> None:
    """Delete a table of `stored` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in kept.inputFiles()}:
        _delete(kept.sparkSession, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """`make()` as a stored table; what its steps kept on shared storage on the way is deleted."""
    token = _written.set([])
    try:
        made = make()
        steps = list(_written.get())
        kept = stored(made)
        result = [p for p in _written.get() if p not in steps]
    finally:
        written = _written.get()
        _written.reset(token)
    for path in result:
        _note(path)
    for path in written:
        if path not in result:
            _delete(spark, path)
    return kept


def spread(df: DataFrame) -> DataFrame:
    """A table as it is, or dealt over all cores if it has fewer input splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
