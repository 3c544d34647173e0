"""Collections laid out by the hash of a key.

`KeyedFolders` writes folders `bucket=K`: a read of one key opens one folder, and a read for a
batch of keys those of its keys, which a scalar subquery finds when the read begins (an
array of at most `n` numbers, however many keys there are).  A bucket may have any number
of files, so a key with a third of all rows is written by many tasks.

`write_bucketed` and `read_bucketed` are Spark's bucketed tables for keys that are unique: a
join by the key moves the other side alone.  The files are those of a table whose name
follows from the path, and any session can read them again with the same key and number.

Defined results: rows with a null key are kept, in one bucket; no key finds them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


def bucket_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


class KeyedFolders:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, n: int = 256):
        self.spark, self.path, self.schema, self.key, self.n = spark, path.rstrip("/"), schema, key, n

    def write(self, rows: DataFrame) -> None:
        """Over what is there. Buckets are gathered before they are written; AQE cuts large ones."""
        rows = rows.select(*self.schema.names, bucket_of(F.col(self.key), self.n).alias(BUCKET))
        rows.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(self.path)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)

    def all(self) -> DataFrame:
        return self._rows().select(self.schema.names)

    def of(self, value: str) -> DataFrame:
        """The rows of one key; its bucket is a constant of the plan."""
        return self._rows().where((F.col(BUCKET) == bucket_of(F.lit(value), self.n)) & (F.col(self.key) == value)).select(self.schema.names)

    def near(self, keys: DataFrame) -> DataFrame:
        """All rows of the buckets of `keys` (a frame with the key's column); those of other keys are among them."""
        wanted = keys.agg(F.collect_set(bucket_of(F.col(self.key), self.n)).alias("buckets"))
        return self._rows().where(F.array_contains(wanted.scalar(), F.col(BUCKET))).select(self.schema.names)


def _table(path: str) -> str:
    return f"brindle_{hashlib.md5(path.encode()).hexdigest()}"


def write_bucketed(rows: DataFrame, path: str, key: str, n: int) -> None:
    """Over what is there, with one sorted file a bucket."""
    spark, path = rows.sparkSession, path.rstrip("/")
    spark.sql(f"drop table if exists {_table(path)}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    rows.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(_table(path))


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType, key: str, n: int) -> DataFrame:
    path = path.rstrip("/")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"create table if not exists {_table(path)} ({columns}) using parquet clustered by (`{key}`) sorted by (`{key}`) into {n} buckets location '{place}'")
    return spark.table(_table(path)).select(schema.names)
