"""Request streams: the batch jobs per micro-batch, and authorisation as a stream join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import ACCESS_MINUTES
from ..operators.outcomes import UNAUTHORIZED
from ..sources.statelog import StateLog
from ..sources.tables import drop_versions, has_version, read_snapshot, version_of, versions, write_snapshot

Apply = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def run_stream(source: DataFrame, apply: Apply, state_path: str, state_schema: T.StructType, outcomes_path: str, checkpoint: str, available_now: bool = True, keep: int | None = None) -> StreamingQuery:
    """Run each micro-batch of commands through apply(state, commands) -> (new state, outcomes).

    A batch is known by its stream (which the checkpoint names) and number; it has a snapshot
    version of its own, noted before it is written, and its outcomes are written beside it.  A
    replayed batch whose snapshot is complete is skipped and one that is not is written anew on
    the version before, so each batch counts once; a stream with a new checkpoint goes on from
    the state that is there.  With `keep`, so many of the latest versions stay."""

    def step(cmd: DataFrame, batch_id: int) -> None:
        spark = cmd.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
        version = version_of(spark, state_path, f"{stream}-{batch_id}")
        if has_version(spark, state_path, version):
            return
        before = max((v for v in versions(spark, state_path) if v < version), default=None)
        state, out = apply(spark.createDataFrame([], state_schema) if before is None else read_snapshot(spark, state_path, state_schema, before), cmd)
        write_snapshot(out, outcomes_path, version)
        write_snapshot(state, state_path, version)
        if keep:
            drop_versions(spark, state_path, max(keep, 1))

    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_changes(source: DataFrame, apply: Apply, log: StateLog, outcomes_path: str, checkpoint: str, available_now: bool = True, share: float = 0.5, keep: int | None = None) -> StreamingQuery:
    """As run_stream, with apply(state, commands) -> (changed rows, outcomes): each batch writes what it changes, and the state is written whole only once the changes have a `share` of its bytes.

    With `keep`, what no version of the latest `keep` needs is deleted."""

    def step(cmd: DataFrame, batch_id: int) -> None:
        spark = cmd.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
        own = StateLog(spark, log.path, log.schema, log.key)
        version = own.version_of(stream, batch_id)
        if own.has(version):
            return
        changed, out = apply(own.read(version - 1), cmd)
        write_snapshot(out, outcomes_path, version)
        own.write_changes(changed, version)
        own.compact(share)
        if keep:
            own.drop_old(keep)

    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def authorize_stream(requests: DataFrame, logins: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Requests (request_id, ts, user_id) that a login (ts, user_id) less than 180 minutes before authorises; each once. Rows later than the delay are dropped."""
    left = requests.withWatermark("ts", delay)
    right = logins.select(F.col("user_id").alias("login_user"), F.col("ts").alias("login_ts")).withWatermark("login_ts", delay)
    within = (F.col("user_id") == F.col("login_user")) & (F.col("ts") >= F.col("login_ts")) & (F.col("ts") < F.col("login_ts") + F.expr(f"interval {ACCESS_MINUTES} minutes"))
    joined = left.join(right, within).select("request_id", "ts", "user_id")
    return joined.dropDuplicatesWithinWatermark(["request_id"])


_SPAN = ACCESS_MINUTES * 60 * 1_000_000


_ROW = ["user", "us", "request_id", "is_login"]


def _answers(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What requests of one share of the users get in one span, once the watermark has passed them; the state is each user's latest login before that and the rows after it."""
    passed = state.getCurrentWatermarkMs() * 1000
    rows = [pd.DataFrame(dict(zip(_ROW, state.get)))] if state.exists else []
    rows += [f[_ROW] for f in frames if len(f)]
    rows = pd.concat(rows) if rows else pd.DataFrame(columns=_ROW)
    if len(rows) and rows["us"].min() > passed:  # nothing to answer yet
        state.update(tuple(rows[c].tolist() for c in _ROW))
        state.setTimeoutTimestamp(max(int(rows["us"].min()) // 1000, passed // 1000 + 1))
        return
    rows = rows.astype({"user": object, "us": "int64", "request_id": object, "is_login": bool}).sort_values(["us", "request_id"], na_position="first", kind="stable", ignore_index=True)
    known = rows["us"].where(rows["is_login"]).astype("Int64").groupby(rows["user"], dropna=False).ffill()
    past = rows["us"] <= passed
    asked = past & ~rows["is_login"]
    done = rows.loc[asked, ["request_id", "us", "user"]].assign(login_us=known[asked].where(rows.loc[asked, "us"] - known[asked] < _SPAN))
    waiting = rows[~past]
    end = (int(key[1]) + 1) * _SPAN
    if len(waiting) or passed < end:
        kept = pd.concat([rows[past & rows["is_login"]].drop_duplicates("user", keep="last"), waiting])
        state.update(tuple(kept[c].tolist() for c in _ROW))
        state.setTimeoutTimestamp(max((int(waiting["us"].iloc[0]) if len(waiting) else end) // 1000, passed // 1000 + 1))
    elif state.exists:
        state.remove()
    yield done


def authorize_stream_asof(requests: DataFrame, logins: DataFrame, delay: str = "10 minutes", shares: int = 8) -> DataFrame:
    """Requests (request_id, ts, user_id) as authorize_asof answers them, refused ones (401) too, once the watermark has passed them.

    Time is cut into spans as there: a user's requests of one span meet the logins of that and
    the span before.  Users are dealt into `shares`, and a share's state in a span is a login of
    each user and what the delay holds back; it goes with its span.  So many tasks can work on one
    span at most, and a checkpoint's number of shares must stay.  Rows later than the delay are
    dropped; rows without a time never get an answer; a null user is a user."""
    kind = dict(requests.dtypes)["user_id"]
    row = lambda of, is_login: of.select("request_id", "ts", F.col("user_id").cast("string").alias("user"), F.lit(is_login).alias("is_login"))
    if "request_id" not in logins.columns:
        logins = logins.withColumn("request_id", F.lit(""))
    both = row(requests, False).unionByName(row(logins, True)).where("ts is not null").withWatermark("ts", delay)
    span = F.floor(F.unix_micros("ts") / F.lit(_SPAN)).cast("long")
    both = both.select("ts", F.pmod(F.xxhash64("user"), F.lit(shares)).alias("share"), "user", "request_id", "is_login", F.unix_micros("ts").alias("us"), F.explode(F.when(F.col("is_login"), F.array(span, span + 1)).otherwise(F.array(span))).alias("span"))
    out = "request_id string, us long, user string, login_us long"
    kept = "user array<string>, us array<long>, request_id array<string>, is_login array<boolean>"
    found = both.groupBy("share", "span").applyInPandasWithState(_answers, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
    status, message = UNAUTHORIZED
    ok = F.col("login_us").isNotNull()
    return found.select(
        "request_id",
        F.timestamp_micros("us").alias("ts"),
        F.col("user").cast(kind).alias("user_id"),
        F.timestamp_micros("login_us").alias("login_ts"),
        F.when(ok, 200).otherwise(status).alias("status"),
        F.when(~ok, message).alias("message"),
    )
