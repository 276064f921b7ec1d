"""Tables in the folder that driver and executors share, used to cut lineage and to be read twice."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_shipped: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a single-process ``local`` session without that setting gets a
    temporary folder; a cluster without it is refused, because a machine-local
    folder is invisible to the other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="nimbora-")
    return _LOCAL_ROOTS[app]


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is run inside leaves no shuffle files once it has ended; the setting is as before afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Named tables of one operator run.

    A table survives the loss of executors, since it lies in shared storage. The
    returned frames read it lazily, so the last tables stay until the caller
    drops them or clears the shared folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.dir = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, name: str, frame: DataFrame, key: str = "", files: int = 0) -> DataFrame:
        """``key`` buckets the table by that column into ``files``: what groups by it then needs no exchange."""
        path = f"{self.dir}/{name}"
        if key:
            table = f"{name}_{uuid.uuid4().hex}"
            frame.write.bucketBy(files, key).option("compression", "zstd").option("path", path).saveAsTable(table)
            return self.spark.table(table)
        frame.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    handle, path = tempfile.mkstemp(prefix="nimbora-", suffix=".zip")  # the driver serves it to the executors
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
