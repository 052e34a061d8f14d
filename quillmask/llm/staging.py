"""Reading the input tables and cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quillmask.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark's reader touches the path."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where none is named, a local session gets a
    temporary one; on a cluster that is an error, since executors do not see each other's disks."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = getattr(spark.sparkContext, "_quillmask_folder", None) or tempfile.mkdtemp(prefix="quillmask-")
        spark.sparkContext._quillmask_folder = named
    return named.rstrip("/")


def stage(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` once to the shared folder and read it back.

    Lost executors cannot take the rows with them, and later actions do not recompute them.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/quillmask/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*frames: DataFrame | None) -> None:
    """Delete what ``stage`` wrote for these frames. For tables that nothing reads any more: all that
    came of them has been staged itself, so not even a lost executor asks for them again."""
    for frame in frames:
        path = getattr(frame, "_staged_at", None)
        if path:
            where = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with as many underscores as it takes to be none of the columns."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
