"""Which values of a column are stored: Bloom filters in blocks, and the values to confirm by.

A version holds the distinct values of one addition in folders by their hash, and a Bloom
filter of them in blocks of 512 bits, a row each: a value sets eight bits in one block.  At
32 values a block that is 16 bits a value, and about 2 values in 1,000 that aren't stored
pass.  A batch meets the filter by the number of the block, and only what passes meets the
values, of which those buckets alone are read that it needs; so what is answered is exact.

Blocks are as many as the values ask for, so no filter is sent around whole, and the sums of bits
are made up before they are shuffled.  A version counts once its filter is complete, and can be
written again.  Values that were deleted since may stay: `known` is about the values added,
and `compact` makes one version of what is still stored.

Defined results: null is never known and never added; repeated values count once; without
a version nothing is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .layout import KeyedFolders

WORDS, PER_BLOCK = 8, 32


def _bits(value: Column) -> list[Column]:
    """Of each of a block's words the bit that the value sets: six bits of a hash tell which."""
    h = F.xxhash64(value, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def _block(value: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(value, F.lit("block")), blocks)


class KnownValues:
    def __init__(self, spark: SparkSession, path: str, column: str, buckets: int = 256):
        self.spark, self.path, self.column, self.buckets = spark, path.rstrip("/"), column, buckets

    def _values(self, version: int) -> KeyedFolders:
        return KeyedFolders(self.spark, f"{self.path}/values-{version}", T.StructType([T.StructField(self.column, T.StringType())]), self.column, self.buckets)

    def _names(self, folder: str) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in store.listStatus(root)] if store.exists(root) else []

    def _delete(self, name: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def versions(self) -> dict[int, int]:
        """Complete versions and how many blocks each has."""
        found = {}
        for name in self._names(self.path):
            if name.startswith("filter-") and "_SUCCESS" in self._names(f"{self.path}/{name}"):
                _, version, blocks = name.split("-")
                found[int(version)] = int(blocks)
        return found

    def add(self, rows: DataFrame, version: int) -> None:
        """The values of a frame, as a version of its own."""
        for name in self._names(self.path):
            if name.startswith(f"filter-{version}-"):
                self._delete(name)
        store = self._values(version)
        store.write(rows.select(self.column).where(F.col(self.column).isNotNull()).distinct())
        values = store.all()
        blocks = max(1, -(-values.count() // PER_BLOCK))
        value = F.col(self.column)
        marked = values.select(_block(value, F.lit(blocks)).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(value))))
        summed = marked.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))
        summed.write.mode("overwrite").parquet(f"{self.path}/filter-{version}-{blocks}")

    def passing(self, rows: DataFrame) -> DataFrame:
        """The distinct values of a frame that a filter lets pass, with the version: all that are stored, and a few others."""
        values = rows.select(self.column).where(F.col(self.column).isNotNull()).distinct()
        value, found = F.col(self.column), None
        for version, blocks in sorted(self.versions().items()):
            kept = self.spark.read.parquet(f"{self.path}/filter-{version}-{blocks}")
            asked = values.select(self.column, _block(value, F.lit(blocks)).alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(_bits(value))))
            hit = asked.join(kept, "block").where(" and ".join(f"w{i} & b{i} = b{i}" for i in range(WORDS))).select(self.column, F.lit(version).alias("version"))
            found = hit if found is None else found.unionByName(hit)
        return values.where("false").select(self.column, F.lit(0).alias("version")) if found is None else found

    def known(self, rows: DataFrame) -> DataFrame:
        """The distinct values of a frame that are stored."""
        passing, found = self.passing(rows), None
        for version in sorted(self.versions()):
            mine = passing.where(F.col("version") == version).select(self.column)
            hit = mine.join(self._values(version).near(mine), self.column, "left_semi")
            found = hit if found is None else found.union(hit)
        return (passing.select(self.column) if found is None else found).distinct()

    def compact(self, stored: DataFrame) -> None:
        """One version of the values of a frame (what is stored now) in place of all; readers of the old ones must be done."""
        old = sorted(self.versions())
        self.add(stored, max(old, default=0) + 1)
        for v in old:
            for name in self._names(self.path):
                if name == f"values-{v}" or name.startswith(f"filter-{v}-"):
                    self._delete(name)
