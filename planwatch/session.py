"""Sessions: the settings the engine counts on, the package on the executors, and tables in the folder that all share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "planwatch", **conf: str) -> SparkSession:
    """A session with ANSI arithmetic, adaptive plans and UTC; ``conf`` adds to it or overrides it."""
    settings = {"spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"} | conf
    return ship(SparkSession.builder.appName(app).config(map=settings).getOrCreate())


def own_folder() -> str:
    """A folder of the driver for what Spark serves to executors; it goes when the driver's process ends."""
    path = tempfile.mkdtemp(prefix="planwatch-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ship(spark: SparkSession) -> SparkSession:
    """Gives executors this package, once for each application, so that Python functions need no installation there."""
    sc = spark.sparkContext
    if not getattr(sc, "_planwatch_shipped", False):
        here, own = os.path.dirname(os.path.abspath(__file__)), own_folder()
        shutil.copytree(here, os.path.join(own, "src", "planwatch"), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(os.path.join(own, "planwatch"), "zip", os.path.join(own, "src")))
        sc._planwatch_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset and all run in one process, as in
    tests, one of our own; on a cluster that is an error, as no machine's own folder can be seen by the others."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc = spark.sparkContext
        sc._planwatch_folder = root = getattr(sc, "_planwatch_folder", None) or own_folder()
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder.

    It cuts lineage, survives lost executors, and computes once what several branches read. The folder is the
    cluster's scratch space, whose retention removes the tables.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
