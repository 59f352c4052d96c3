"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results rather than speed.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Of a member that a JSON object repeats, the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

#: Bound on what Spark hands to Python at once: rows of long texts are large.
BATCH_CONF = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: Whether the shuffles of a job are deleted once it has ended, rather than when the driver next collects garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of a shuffle partition that a task sorts; some 200 MB at 500 bytes a row.
PART_ROWS = 400_000


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to an existing session."""
    for key, value in {**REQUIRED_CONF, **BATCH_CONF}.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, scratch: str | None = None) -> SparkSession:
    """A local session for tests and benchmarks.

    ``scratch`` is its folder for intermediate tables; without it, and where
    the machine's settings name none, the session makes a folder of its own.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gridpress")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    if scratch:
        builder = builder.config(CHECKPOINT_CONF, scratch)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get(CHECKPOINT_CONF, None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridpress-"))
    return configure(spark)


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``, or the application with
    ``SparkContext.setCheckpointDir``.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    return root.rstrip("/")


def clear_scratch(spark: SparkSession) -> None:
    """Delete every staged table; frames that still read one fail from then on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/gridpress")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts lineage so that several consumers read one columnar copy, and the
    copy outlives any lost executor. The shuffles that made it go once it is
    written.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/gridpress/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP_CONF)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def sorted_side(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled and merged, never sent whole through the driver.

    For frames with a record per page or line. Spark takes a staged table for as
    small as its files, and a few MB of those can hold GBs of repeating rows.
    """
    return df.hint("merge")


def parts_of(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions for ``rows`` rows, ``PART_ROWS`` in each, however many there are.

    Adaptive execution merges partitions by their compressed bytes; rows that
    repeat are many times larger once they are sorted, so sorts of merged
    partitions spill. The session's number is the least.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def discard(*frames: DataFrame) -> None:
    """Delete tables that :func:`stage` wrote and that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        for folder in {file.rpartition("/")[0] for file in frame.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
