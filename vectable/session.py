"""Small helpers around the Spark session: lineage cuts, size checks, spreading."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest block of rows that may be collected and shipped to every task.
BROADCAST_BYTES = 64 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024
DEFAULT_BATCH = "67108864b"  # fixed value: the session's default
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
KNOWN_BYTES = 1 << 50  # estimates beyond are those of tables of unknown size


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    For sessions started without it on the workers' path.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    bound_batches(spark)
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="vectable-package-")) / "vectable.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` to the Python workers, where the session leaves that at its default.

    Each task holds a batch outside the heap, and twice while it grows.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) in (DEFAULT_BATCH, DEFAULT_BATCH.removesuffix("b")):
        spark.conf.set(setting, str(BATCH_BYTES))


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, as named by ``spark.checkpoint.dir``.

    A temporary folder is used only in local mode, where driver and executors
    are one process; a cluster without the setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="vectable-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``: later stages survive the loss of executors."""
    root = checkpoint_root(df.sparkSession)
    df.sparkSession.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def swept(df: DataFrame) -> DataFrame:
    """``cut`` for the rounds of a loop: the shuffle files of a round are removed at its end.

    They would else stay until the driver's garbage is collected, and the disk would fill with the number of rounds.
    """
    conf = df.sparkSession.conf
    before = conf.get(SWEEP, None)
    conf.set(SWEEP, "true")
    try:
        return cut(df.select("*"))  # a new DataFrame takes the setting; the shuffles of ``df`` itself are its own
    finally:
        conf.unset(SWEEP) if before is None else conf.set(SWEEP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: columnar, with its real size known."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate of a DataFrame; runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def file_count(df: DataFrame, target: int = 256 * 1024 * 1024) -> int:
    """How many files of about ``target`` bytes to write, at least one per core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-estimated_bytes(df) // target))


def spread(df: DataFrame, *, floor: int = 128 * 1024 * 1024) -> DataFrame:
    """Use every core for CPU-heavy work on an input that fits a few splits.

    Only inputs estimated below ``floor`` bytes are shuffled; a large scan
    already has enough splits and is left as it is.
    """
    if estimated_bytes(df) >= floor:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def width(df: DataFrame, each: int | None = None) -> int:
    """The session's shuffle width; with ``each``, more where partitions would hold more than so many estimated bytes."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = 0 if each is None else estimated_bytes(df)
    return max(own, -(-held // each)) if 0 < held < KNOWN_BYTES else own


def by_key(df: DataFrame, *cols: str, each: int | None = None) -> DataFrame:
    """Hash-partition at the session's full shuffle width, or as wide as ``width`` says of ``each``.

    For rows that multiply or are scored after the shuffle: adaptive execution
    would merge the partitions by their bytes and leave few tasks with the work.
    """
    return df.repartition(width(df, each), *cols)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_checked(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast only when its row count is within ``max_rows``.

    Beyond the bound the DataFrame is returned unchanged, so that the join is a
    shuffle join and adaptive execution splits its hot keys.
    """
    return F.broadcast(df) if small_enough(df, max_rows) else df
