"""Session settings and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tallyglass", master: str | None = None, ship: bool = True, **conf: str) -> SparkSession:
    """Session with AQE, UTC and Arrow on; `master` only for local use.

    With `ship`, executors get this package from the driver; without, it must be
    installed on them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if ship:
        ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors; the driver need not start in its folder."""
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tallyglass-ship-"), "tallyglass-modules.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)


def shared_folder(spark: SparkSession) -> str:
    """Checkpoint folder every executor can read.

    The cluster names it in `spark.checkpoint.dir`.  A machine-local folder is
    made only in local mode, where driver and executors are the same machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark._jsc.sc().getCheckpointDir()
    if named:
        if current.isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not current.isEmpty():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tallyglass-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
