"""Token counts by source, language and tokenizer version, kept up by deltas.

A batch of changes is signed: an insert adds a document and its tokens, a delete takes
them away, a revision replaces a count by another.  Each batch is summed (map-side
first, so a source that holds a third of all rows is no bottleneck) and committed under
its id: its sums go to a folder of their own, and are in force once the marker file that
Spark's committer writes last is there.  A batch whose id is in force is not applied
again; a half-written one is overwritten.  Totals are the sum of all batches in force;
`compact` folds batches into one base of a new rollup, and keeps the ids of what it folded.

Defined results: null source, language or tokenizer are groups of their own; a null
count counts as 0; groups whose documents and tokens come to 0 are left out; batches
may come in any order, as sums commute; an id can't be `base` nor
name a hidden file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
BASE = "base"  # the id of what compaction folds
_SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def insert(rows: DataFrame, tokens: Column) -> DataFrame:
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("tokens"))


def delete(rows: DataFrame, tokens: Column) -> DataFrame:
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.coalesce(tokens.cast("long"), F.lit(0))).alias("tokens"))


def revise(rows: DataFrame, old: Column, new: Column) -> DataFrame:
    return rows.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.coalesce(new.cast("long"), F.lit(0)) - F.coalesce(old.cast("long"), F.lit(0))).alias("tokens"))


class Rollup:
    """Totals in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def committed(self, batch: str) -> bool:
        store, path = self._path(f"{batch}/_SUCCESS")
        return store.exists(path)

    def batches(self) -> list[str]:
        store, path = self._path("")
        if not store.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in store.listStatus(path))
        return [x for x in names if self.committed(x)]

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of signed changes; False if it was committed before."""
        if not batch or batch == BASE or batch[0] in "._" or "/" in batch:
            raise ValueError(f"{batch!r} can't be the id of a batch")
        return self._commit(batch, changes)

    def _commit(self, batch: str, changes: DataFrame) -> bool:
        if self.committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/{batch}")
        return True

    def _sums(self, batches: list[str]) -> DataFrame:
        return self.spark.read.schema(_SUMS).parquet(*(f"{self.folder}/{x}" for x in batches))

    def totals(self) -> DataFrame:
        found = self.batches()
        if not found:
            return self.spark.createDataFrame([], _SUMS)
        return self._sums(found).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self, folder: str, batches: list[str]) -> Rollup:
        """A new rollup in a folder without batches: these batches and the base of an earlier compaction are folded into a new base, other batches stay as they are.

        Folded ids stay as empty batches, so that none is applied again."""
        out, have = Rollup(self.spark, folder), self.batches()
        if out.batches():
            raise ValueError(f"{folder} holds batches")
        if missing := sorted(set(batches) - set(have)):
            raise ValueError(f"not committed: {', '.join(missing)}")
        folded = [x for x in dict.fromkeys(batches) if x != BASE]
        groups = [(x, [x]) for x in have if x != BASE and x not in folded]
        if whole := [x for x in have if x == BASE] + folded:
            groups.append((BASE, whole))
        for name, group in groups:
            out._commit(name, self._sums(group).withColumnsRenamed({"n_docs": "docs", "n_tokens": "tokens"}))
        for name in folded:
            out._commit(name, self.spark.createDataFrame([], _SUMS).withColumnsRenamed({"n_docs": "docs", "n_tokens": "tokens"}))
        return out
