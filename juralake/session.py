"""Sessions and the few pieces of session state that operators rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch.
BATCH_ROWS = 2000


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "juralake") -> SparkSession:
    """A local session for tests and bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("JURALAKE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent on a local master (tests on one machine) a temporary folder is made and set; on a cluster,
    whose executors would each write to a disk of their own, it must be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="juralake-")
        atexit.register(shutil.rmtree, named.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _place(spark: SparkSession, path: str):
    """The file system of ``path`` and the path in it."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(sc._jsc.hadoopConfiguration()), place


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts the lineage without executor-local state: a lost executor costs nothing but the tasks it was running. The files go
    when ``discard`` is told so, else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._juralake_stage = path
    return out


def discard(stage: DataFrame) -> None:
    """Delete the files of what ``materialise`` gave, once nothing that is still to run reads them."""
    files, place = _place(stage.sparkSession, stage._juralake_stage)
    files.delete(place, True)


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application; Spark's file server carries it to them.

    Arrow batches are held to BATCH_ROWS rows, as a batch of whole texts must fit into a worker.
    """
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if not getattr(sc, "_juralake_shipped", False):
        root = Path(__file__).resolve().parent
        tmp = tempfile.mkdtemp(prefix="juralake-")  # the driver serves the file from here until it ends
        atexit.register(shutil.rmtree, tmp, ignore_errors=True)
        path = f"{tmp}/juralake.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        sc.addPyFile(path)
        sc._juralake_shipped = True
    return spark
