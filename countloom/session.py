"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "countloom", cores: str = "8") -> SparkSession:
    """A small local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names, deleted when the file system closes."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="countloom-files-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{uuid.uuid4().hex}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path.getParent())
    return path.toString()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A
    temporary folder is used only on a local master where none is named.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="countloom-ckpt-"))
        else:
            raise ValueError("Set spark.checkpoint.dir to a shared folder before running iterative operators")
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the scratch folder and read it back, so that its values are computed once.

    Sums of floating-point numbers depend on the order in which shuffled blocks arrive. A table that is joined with
    something made from its own values must therefore not be computed twice.
    """
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str, rows_per_task: int = 500_000) -> DataFrame:
    """Shuffle by ``keys`` to as many tasks as ``rows`` ask for, so that a task's memory does not grow with the table.

    A shuffle that Spark adds itself has spark.sql.shuffle.partitions tasks at most, whatever the size.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // rows_per_task)), *keys)
