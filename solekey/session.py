"""Session settings and durable storage for intermediate frames."""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Checkpoint files go when nothing refers to their frame any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# Cells (row x combination) one shuffle partition should receive at most. A cell
# is a handful of 8-byte keys, so this is on the order of 100 MB per partition.
CELLS_PER_PARTITION = 2_000_000

# Shuffle partitions of one job at most; beyond them partitions grow and spill.
MOST_PARTITIONS = 100_000

PARTITION_SETTINGS = (
    "spark.sql.shuffle.partitions",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
)

# Cells that a job may put on disk at once, if the table has no more rows than that.
CELLS_ON_DISK = 8_000_000

# Rows of a file that one task reads in a search at most, if its row groups are no larger.
ROWS_READ = 1_000_000
READ_TRIES = 5

# Shuffle files of a job go when it ends, not when the driver's memory is next cleaned up.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
READ_BYTES = "spark.sql.files.maxPartitionBytes"

# Below this a table has too few rows per core for its own splits to be of use.
ROWS_PER_CORE = 100_000

# Partitions that a shuffle writes straight to files (spark.shuffle.sort.bypassMergeThreshold).
FILES_OF_A_TASK = 200


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings the library is tuned for to a session builder."""
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="solekey-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write the frame once; later reads survive executor loss and see the same rows."""
    checkpoint_dir(df.sparkSession)
    return _written(df, getattr(_local, "scopes", None))


def _written(df: DataFrame, scopes: list[list[str]] | None) -> DataFrame:
    written = df.checkpoint(eager=True)
    if scopes:
        file = written._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            scopes[-1].append(file.get())
    return written


def discard(df: DataFrame) -> None:
    """Delete what durable() wrote for a frame; nothing may read it later."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        delete(df.sparkSession, file.get())


def filled(df: DataFrame) -> DataFrame:
    """Fill a frame that is to be kept, and delete the shuffle files behind it; Spark makes them anew if it loses a part."""
    df.count()
    relation = df._jdf.queryExecution().withCachedData()
    if relation.getClass().getSimpleName() == "InMemoryRelation":
        plan = relation.cacheBuilder().cachedPlan()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            for number in plan.context().shuffleIds().keySet().toArray():
                df.sparkSession._jsc.sc().shuffleDriverComponents().removeShuffle(number, False)
    return df


_local = threading.local()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What durable() writes inside is deleted at the end, also after an error; nothing may read it later.

    Gives a function that writes a frame for use after the end.
    """
    scopes = _local.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield lambda df: _written(df, scopes[:-1])
    finally:
        for path in scopes.pop():
            delete(spark, path)


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for jobs inside; they are as before afterwards."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def tidy(spark: SparkSession):
    """Each job inside deletes its shuffle files when it ends."""
    return _set(spark, {SHUFFLE_CLEANUP: "true"})


@contextmanager
def fine_reads(df: DataFrame) -> Iterator[None]:
    """Files that the frame reads are read inside in parts of about ROWS_READ rows, as far as their row groups allow."""
    spark = df.sparkSession
    n_rows, largest = rows_and_largest(df)
    size = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    with ExitStack() as stack:
        for _ in range(READ_TRIES):
            if is_small(spark, n_rows) or largest <= ROWS_READ:
                break
            size = max(1, size * ROWS_READ // largest)
            stack.enter_context(_set(spark, {READ_BYTES: str(size)}))
            largest = rows_and_largest(df)[1]
        yield


def most_cells(n_rows: int) -> int:
    """Cells that a job over a table of so many rows may put on disk at once."""
    return max(CELLS_ON_DISK, n_rows)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop = file_system(spark, path)
    fs.delete(hadoop, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, the same for every session; else this session's own."""
    return spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get(PARTITION_SETTINGS[1], None) or spark.conf.get(PARTITION_SETTINGS[0]))


def room(spark: SparkSession) -> int:
    """Cells that a job may deal out with the session's own number of shuffle partitions."""
    return shuffle_partitions(spark) * CELLS_PER_PARTITION


@contextmanager
def roomy(spark: SparkSession, n_cells: int) -> Iterator[None]:
    """Jobs that run inside get as many shuffle partitions as so many cells need, if the session has fewer.

    The session's settings are as before afterwards.
    """
    wanted = min(MOST_PARTITIONS, -(-n_cells // CELLS_PER_PARTITION))
    if wanted <= shuffle_partitions(spark):
        yield
        return
    before = {key: spark.conf.get(key, None) for key in PARTITION_SETTINGS}
    try:
        for key in PARTITION_SETTINGS:
            if key == PARTITION_SETTINGS[0] or before[key] is not None:
                spark.conf.set(key, str(wanted))
        yield
    finally:
        for key, value in before.items():
            if value is not None:
                spark.conf.set(key, value)


def spread(df: DataFrame, n_rows: int) -> DataFrame:
    """Give a narrow frame with few rows per core one partition per core.

    Small files are read by fewer tasks than there are cores; larger tables are
    returned as they are, so they are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if is_small(df.sparkSession, n_rows) else df


def rows_and_largest(df: DataFrame) -> tuple[int, int]:
    """The rows of a frame, and of the largest of its partitions as they are read."""
    sizes = df.select(F.spark_partition_id().alias("part")).groupBy("part").count()
    row = sizes.agg(F.sum("count").alias("rows"), F.max("count").alias("largest")).first()
    return row["rows"] or 0, row["largest"] or 0


def is_uneven(spark: SparkSession, n_rows: int, largest: int) -> bool:
    """One task has over twice its share of a table that is not small; files of few row groups are read so."""
    cores = spark.sparkContext.defaultParallelism
    return not is_small(spark, n_rows) and largest * cores > 2 * n_rows


def even_parts(spark: SparkSession, n_rows: int) -> int:
    """Partitions for a table that is dealt out and kept.

    While they are no more than FILES_OF_A_TASK, a task writes its rows for them without holding them.
    """
    cores, wanted = spark.sparkContext.defaultParallelism, -(-n_rows // ROWS_PER_CORE)
    return min(MOST_PARTITIONS, max(cores, min(wanted, FILES_OF_A_TASK), -(-n_rows // CELLS_PER_PARTITION)))


def is_small(spark: SparkSession, n_rows: int) -> bool:
    return n_rows < spark.sparkContext.defaultParallelism * ROWS_PER_CORE
