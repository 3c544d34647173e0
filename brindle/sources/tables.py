"""Collections, requests, snapshots and responses at rest."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import COLLECTIONS, COMMANDS


def read_collection(spark: SparkSession, name: str, path: str, format: str = "parquet") -> DataFrame:
    """A collection under its declared schema; nothing is inferred."""
    return spark.read.schema(COLLECTIONS[name]).format(format).load(path)


def read_requests(spark: SparkSession, path: str, action: str, origin: bool = False) -> DataFrame:
    """JSON request bodies as command columns; a line that is no JSON keeps its text in _corrupt_record. With `origin`, the file and where in it the block begins that was read (_file, _block)."""
    schema = T.StructType([*COMMANDS[action].fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")) if origin else rows


def parse_requests(rows: DataFrame, action: str, body: str = "body") -> DataFrame:
    """rows with a JSON body column as command columns."""
    return rows.withColumn("_cmd", F.from_json(body, COMMANDS[action])).select(*(c for c in rows.columns if c != body), "_cmd.*")


def _version_path(spark: SparkSession, path: str, version: int):
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={version}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def has_version(spark: SparkSession, path: str, version: int) -> bool:
    store, p = _version_path(spark, path, version)
    return store.exists(p)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a snapshot."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    names = [s.getPath().getName() for s in store.listStatus(root)]
    found = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
    return [v for v in found if has_version(spark, path, v)]


def write_snapshot(df: DataFrame, path: str, version: int, partition_by: list[str] | None = None) -> None:
    """Persist a state as a version of its own; a version that failed half-way is written over."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/v={version}")


def drop_versions(spark: SparkSession, path: str, keep: int) -> None:
    """Delete all but the latest `keep` complete versions."""
    for v in versions(spark, path)[: -keep or None]:
        store, done = _version_path(spark, path, v)
        store.delete(done.getParent(), True)


def version_of(spark: SparkSession, path: str, batch: str) -> int:
    """The version that a batch has in a state folder: one of its own, noted before anything is written under it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_batches")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    noted = dict(s.getPath().getName().rsplit("=", 1) for s in store.listStatus(root)) if store.exists(root) else {}
    if batch not in noted:
        known = [*versions(spark, path), *(int(v) for v in noted.values())]
        noted[batch] = str(max(known, default=0) + 1)
        store.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(root, f"{batch}={noted[batch]}"))
    return int(noted[batch])


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="brindle-")


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The given or the latest complete version; an empty state if there is none."""
    found = versions(spark, path)
    version = version if version is not None else max(found, default=None)
    return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{path}/v={version}")


def to_responses(df: DataFrame, key: str = "request_id") -> DataFrame:
    """key and the other columns as JSON, without fields that are null."""
    body = F.to_json(F.struct(*(c for c in df.columns if c != key)), {"ignoreNullFields": "true"})
    return df.select(key, body.alias("body"))


def write_responses(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)
