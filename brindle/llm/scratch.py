"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of its own only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BROADCAST_ROWS = 2_000_000  # ids of 8 bytes
BROADCAST_PAIRS = 500_000  # of ids
FILE_ROWS = 50_000


def to_all(ids: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """ids (one long column, so many rows) for a join: sent to all tasks if few, else as they are, for Spark to shuffle."""
    return F.broadcast(ids) if rows <= most else ids


class Scratch:
    """Tables written under a folder of this object's own; each cuts the lineage of what follows."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/brindle-{name}-{uuid.uuid4().hex[:12]}"
        self.made = 0
        self.live: list[str] = []

    def write(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """df as a table.  rows: at most so many of a narrow table, which go to files of FILE_ROWS, though to no fewer than there are cores."""
        if rows is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._brindle_path = path
        self.live.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        self._delete([t._brindle_path for t in tables])

    def drop_others(self, *kept: DataFrame) -> None:
        """Delete all tables but these."""
        keep = {t._brindle_path for t in kept}
        self._delete([p for p in self.live if p not in keep])

    def _delete(self, paths: list[str]) -> None:
        for name in paths:
            self.live.remove(name)
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
