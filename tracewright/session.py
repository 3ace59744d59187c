"""Session set-up and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHUNK_KEY = "spark.tracewright.chunkTurns"
CHUNK_DEFAULT = 8192
#: Spark removes the shuffle files of a query when it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_FOLDERS: dict[str, str] = {}


def get_spark(cores: str | int = "*", partitions: int = 8, app: str = "tracewright") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.codegen.cache.maxEntries", "1000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def chunk_turns(spark: SparkSession) -> int:
    """Number of consecutive turns of one group that a single task may hold."""
    return int(spark.conf.get(CHUNK_KEY, str(CHUNK_DEFAULT)))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting gets a fresh folder, the same one for
    as long as it runs; a cluster without it is refused, because a machine-local
    folder would be lost with the machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _LOCAL_FOLDERS[app]


def written(df: DataFrame, name: str, schema: StructType | None = None, by: list[str] | None = None, rows_a_file: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage without tying the data to any executor, and keeps column
    pruning and filter push-down for the readers. ``schema`` gives the types to
    read with, where they are stored as others (vectors); ``by`` names columns
    that part the table into folders; ``rows_a_file`` bounds what is read at
    once where rows are large. The shuffle files of
    the write are of no more use once the table is there, so Spark is told to
    remove them with it instead of when the driver's memory happens to be cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"
    before = spark.conf.get(_CLEAN_UP, None)
    if before is not None:
        spark.conf.set(_CLEAN_UP, "true")
    try:
        out = df.write.partitionBy(*by) if by else df.write
        (out.option("maxRecordsPerFile", rows_a_file) if rows_a_file else out).mode("overwrite").parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(schema or df.schema).parquet(path)
    out.written_to = path
    return out


def shared(df: DataFrame, name: str) -> DataFrame:
    """A written table of the run log, for many readers: joins on it are shuffled, never broadcast.

    Spark takes a Parquet file's size for the size of its rows. Keys and turns are stored in a bit or two each, so a
    table of millions of rows counts as small enough to be collected by the driver, once for every join.
    """
    return written(df, name).hint("merge")


def released(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made, once all that was read from them is written elsewhere."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
