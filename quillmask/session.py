"""Session helpers: local sessions for tests and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests, the command line and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillmask")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which the driver and all executors see. Where none is
    named, a local session gets a temporary one; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = getattr(spark.sparkContext, "_quillmask_folder", None) or tempfile.mkdtemp(prefix="quillmask-")
        spark.sparkContext._quillmask_folder = named
    return named.rstrip("/")


def stage(frame: DataFrame, name: str, most: int = 0) -> DataFrame:
    """``frame`` written to the shared folder, below the application's id, and read back: for what is read
    more than once, so that it is made once. Lost executors cannot take it with them. Files hold at most ``most``
    rows, if it is given."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/quillmask/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    (frame.write.option("maxRecordsPerFile", most) if most else frame.write).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make ``quillmask`` importable in Python workers.

    Nothing is sent when the workers inherit a PYTHONPATH or a working folder that holds it;
    otherwise the package's sources go out once per application as a zip.
    """
    on_path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT) in map(os.path.realpath, filter(None, on_path)) or Path.cwd().resolve() == ROOT:
        return
    context = spark.sparkContext
    if getattr(context, "_quillmask_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="quillmask-")) / "quillmask.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in (ROOT / "quillmask").rglob("*.py"):
            out.write(source, source.relative_to(ROOT))
    context.addPyFile(str(target))
    context._quillmask_shipped = True
