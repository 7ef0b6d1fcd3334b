"""Session helpers: a local session for tests and bench, and tables that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting for the bytes of a batch of rows for a Python worker, and what texts are given to them by.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def local_session(
    cpus: int | str = "*", app: str = "sheaf", config: dict[str, str] | None = None
) -> SparkSession:
    """A local session; on a cluster the caller brings their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in (config or {}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back
    to a temporary folder, removed at exit, because there every task runs on this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if spark.sparkContext.getCheckpointDir() is None:
        folder = tempfile.mkdtemp(prefix="sheaf-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def _tables_root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/sheaf/{spark.sparkContext.applicationId}"


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{_tables_root(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no DataFrame over them is needed."""
    _delete(spark, _tables_root(spark))


def discard(table: DataFrame) -> None:
    """Delete one table that ``written`` returned, once a later one stands in its place."""
    _delete(table.sparkSession, table.__dict__.pop("_written_to"))


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Meanwhile a batch of rows that goes to a Python worker has ``BATCH_BYTES`` and one row at most."""
    before = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts lineage and pins values that depend on the physical layout (partition ids), and
    survives the loss of any executor.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table
