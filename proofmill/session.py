"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", app: str = "proofmill", **extra: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE on)."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may do without that setting (tests, a laptop): a temporary folder is made and recorded in the
    session. On a cluster a machine's own folder would not be shared, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="proofmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's own folder below the shared one, which is deleted when the application ends."""
    context = spark.sparkContext
    folder = f"{shared_dir(spark)}/proofmill/{context.applicationId}"
    if getattr(context, "_proofmill_folder", None) != folder:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        context._proofmill_folder = folder
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once per context, so that Python workers find it on any machine."""
    context = spark.sparkContext
    if not getattr(context, "_proofmill_shipped", False):
        root = os.path.dirname(os.path.abspath(__file__))
        # executors fetch the file from the driver when they first need it, so it stays until the driver ends
        folder = tempfile.mkdtemp(prefix="proofmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shutil.copytree(root, f"{folder}/tree/proofmill", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/proofmill", "zip", f"{folder}/tree"))
        context._proofmill_shipped = True
    return spark
