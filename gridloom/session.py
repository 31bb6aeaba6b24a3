"""Sessions, and shipping this package to executors that do not have it installed."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests, the bench and the command line."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("gridloom")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "6g").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset and everything runs in one process, a temporary one is set here; on a cluster that is a RuntimeError,
    as executors would not see each other's files.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-shared-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found if ":" in found.split("/")[0] else f"file://{found}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> SparkSession:
    """Hand this package to Spark's file server, once an application, so Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        with tempfile.TemporaryDirectory() as folder:
            root = Path(folder) / "tree"
            shutil.copytree(here, root / here.name, ignore=shutil.ignore_patterns("__pycache__"))
            # The file server reads it as long as the application runs.
            out = os.path.join(tempfile.mkdtemp(prefix="gridloom-code-"), f"{here.name}_src")
            spark.sparkContext.addPyFile(shutil.make_archive(out, "zip", root))
        _shipped.add(app)
    return spark
