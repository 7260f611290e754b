"""Session defaults, the shared folder and file operations on it."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "signalframe", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a session in local mode without the setting, as in tests, gets a folder of
    its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


class Files:
    """Rename, remove and list on whatever store a path names, as Spark itself reaches it."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def folders(self, path: str) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._path(path)) if f.isDirectory()]

    def names(self, path: str) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._path(path))]

    def move(self, source: str, target: str) -> None:
        """``source`` takes the place of ``target``."""
        self.remove(target)
        self._fs.mkdirs(self._path(target).getParent())
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot move {source} to {target}")
