"""A collection's state as a base and the changes since: what a batch writes follows the batch, not the state.

In the state's folder `v=N` is the whole state of version N and `d=N` the rows that version
N changed, each with its key, all columns, and whether it was deleted; either counts once it
is complete.  A read takes the latest base and, of the later changes, the last one of each
key: one anti join on the changed keys, without a shuffle of the base where Spark finds
those small enough to send around.  Compaction writes the state as a base of its version once the
changes have grown to a share of the base, so that all writing together stays in
proportion to the changes; what is older can go then.  With `buckets` a base and its changes
are bucketed tables: changes meet the base, and each other, where they lie, and joins of the
state by its key (commands by id) move the other side alone, however large that is; what
such a join gives is written as changes without another shuffle.  A log keeps its number of buckets.

Defined results: rows of the base with a null key stay; a change of a key that isn't there
adds it; a delete of such a key does nothing; of several rows of a key in one batch any one
counts, so a batch should have one each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .layout import read_bucketed, write_bucketed

DELETED = "_deleted"


_IN_PLACE = 4  # versions of changes that are read by joins of each with those after it


class StateLog:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "_id", buckets: int | None = None):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _at(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _complete(self, kind: str) -> list[int]:
        store, root = self._at()
        if not store.exists(root):
            return []
        names = [s.getPath().getName() for s in store.listStatus(root)]
        found = sorted(int(n[2:]) for n in names if n.startswith(f"{kind}=") and n[2:].isdigit())
        return [v for v in found if self._exists(f"{kind}={v}/_SUCCESS")]

    def _exists(self, name: str) -> bool:
        store, p = self._at(name)
        return store.exists(p)

    def bases(self) -> list[int]:
        return self._complete("v")

    def changes(self) -> list[int]:
        return self._complete("d")

    def versions(self) -> list[int]:
        return sorted({*self.bases(), *self.changes()})

    def has(self, version: int) -> bool:
        return self._exists(f"d={version}/_SUCCESS") or self._exists(f"v={version}/_SUCCESS")

    def bytes_of(self, name: str) -> int:
        """Bytes of v=N or d=N; 0 if it isn't there."""
        store, p = self._at(name)
        return store.getContentSummary(p).getLength() if store.exists(p) else 0

    def write_base(self, state: DataFrame, version: int) -> None:
        rows, path = state.select(self.schema.names), f"{self.path}/v={version}"
        if self.buckets:
            write_bucketed(rows, path, self.key, self.buckets)
        else:
            rows.write.mode("overwrite").parquet(path)

    def _base(self, version: int) -> DataFrame:
        path = f"{self.path}/v={version}"
        return read_bucketed(self.spark, path, self.schema, self.key, self.buckets) if self.buckets else self.spark.read.schema(self.schema).parquet(path)

    def write_changes(self, changed: DataFrame, version: int) -> None:
        """changed: the rows after the change, for deletes too; with a column _deleted, if there are any."""
        deleted = F.coalesce(F.col(DELETED), F.lit(False)) if DELETED in changed.columns else F.lit(False)
        rows, path = changed.select(*self.schema.names, deleted.alias(DELETED)), f"{self.path}/d={version}"
        if self.buckets:
            write_bucketed(rows, path, self.key, self.buckets)
        else:
            rows.write.mode("overwrite").parquet(path)

    def _changes(self, versions: list[int]) -> DataFrame:
        """The rows of these changes, with their version `d`."""
        schema = T.StructType([*self.schema, T.StructField(DELETED, T.BooleanType())])
        if self.buckets:
            each = (read_bucketed(self.spark, f"{self.path}/d={v}", schema, self.key, self.buckets).withColumn("d", F.lit(v).cast("long")) for v in versions)
            return reduce(DataFrame.union, each)
        schema = schema.add("d", T.LongType())
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*(f"{self.path}/d={v}" for v in versions))

    def read(self, version: int | None = None) -> DataFrame:
        """The state of a version, or the latest one; empty if there is none."""
        upto = [v for v in self.bases() if version is None or v <= version]
        base = max(upto, default=None)
        later = [v for v in self.changes() if (base is None or v > base) and (version is None or v <= version)]
        state = self.spark.createDataFrame([], self.schema) if base is None else self._base(base)
        if not later:
            return state
        if self.buckets and len(later) <= _IN_PLACE:
            return self._read_in_place(state, later)
        rows = self._changes(later)
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != self.key)), "d").alias("last")).select(self.key, "last.*")
        return state.join(last.select(self.key), self.key, "left_anti").select(self.schema.names).unionByName(last.where(~F.col(DELETED)).select(self.schema.names))

    def _read_in_place(self, base: DataFrame, later: list[int]) -> DataFrame:
        """Base and changes without any shuffle: of each, what no later change has, by joins of bucketed tables with one another."""
        one = lambda rows: rows.groupBy(self.key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != self.key)), "d").alias("last")).select(self.key, "last.*")
        changes = [one(self._changes([v])) for v in later]
        keys = [self._changes([v]).select(self.key) for v in later]
        found = base
        for k in keys:
            found = found.join(k, self.key, "left_anti")
        found = found.select(self.schema.names)
        for i, rows in enumerate(changes):
            for k in keys[i + 1 :]:
                nulls = k.where(F.col(self.key).isNull()).agg(F.count("*")).scalar()  # a null key meets none in a join
                rows = rows.join(k, self.key, "left_anti").where(F.col(self.key).isNotNull() | (nulls == 0))
            found = found.union(rows.where(~F.col(DELETED)).select(self.schema.names))
        return found

    def compact(self, share: float = 0.5) -> bool:
        """Write the latest version as a base, if the changes since the last one have at least that share of its bytes."""
        base = max(self.bases(), default=None)
        later = [v for v in self.changes() if base is None or v > base]
        size = sum(self.bytes_of(f"d={v}") for v in later)
        if not later or size < share * (self.bytes_of(f"v={base}") if base is not None else 0):
            return False
        self.write_base(self.read(later[-1]), later[-1])
        return True

    def drop_old(self, keep: int = 1) -> None:
        """Delete what no version of the latest `keep` needs."""
        kept = self.versions()[-max(keep, 1) :]
        base = max((v for v in self.bases() if kept and v <= kept[0]), default=None)
        if base is None:
            return
        for kind, found in (("v", self.bases()), ("d", self.changes())):
            for v in found:
                if v < base or (kind == "d" and v == base):
                    store, p = self._at(f"{kind}={v}")
                    store.delete(p, True)

    def version_of(self, stream: str, batch: int) -> int:
        """The version of a stream's batch, noted before anything is written under it; notes of the stream's earlier batches, which are complete, go."""
        store, root = self._at("_batches")
        noted = {}
        for s in store.listStatus(root) if store.exists(root) else []:
            name, version = s.getPath().getName().rsplit("=", 1)
            noted[name] = int(version)
        own = f"{stream}-{batch}"
        if own not in noted:
            noted[own] = max([*self.versions(), *noted.values()], default=0) + 1
            store.mkdirs(self._at(f"_batches/{own}={noted[own]}")[1])
        for name, version in noted.items():
            if name.rsplit("-", 1)[0] == stream and int(name.rsplit("-", 1)[1]) < batch:
                store.delete(self._at(f"_batches/{name}={version}")[1], True)
        return noted[own]
