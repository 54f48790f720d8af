"""Tables that a plan writes on its way, in the folder that driver and executors share, and messages about its progress."""

from __future__ import annotations

import logging
import tempfile
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class Notifiee(Protocol):
    """Who is told how a plan goes."""

    def progress(self, text: str) -> None: ...
    def status(self, text: str) -> None: ...
    def error(self, text: str) -> None: ...


class Log:
    """Messages to the log, with its time stamps."""

    def __init__(self) -> None:
        self.log = logging.getLogger("grovemill")

    def progress(self, text: str) -> None:
        self.log.info("progress: %s", text)

    def status(self, text: str) -> None:
        self.log.info("status: %s", text)

    def error(self, text: str) -> None:
        self.log.error(text)


class Stash:
    """Parquet tables below spark.checkpoint.dir: they cut lineage, outlive lost executors, and are removed by name. If the
    folder is not set, a local master gets a temporary one; on a cluster that is an error."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        root = root or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="grovemill-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.folder, self.count = spark, f"{root.rstrip('/')}/state-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count:06d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, number: int | None = None) -> None:
        """One table, or all."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder if number is None else f"{self.folder}/{number:06d}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
