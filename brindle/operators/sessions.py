"""Tokens: issue, storage, authorisation of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ACCESS_MINUTES, access_expiry, bearer_token, order, present, refresh_expiry, sure
from .outcomes import UNAUTHORIZED, Cause, judged, outcomes
from .users import Changed


def with_bearer(requests: DataFrame) -> DataFrame:
    """requests with access_token, from their authorization header."""
    return requests.withColumn("access_token", bearer_token(F.col("authorization")))


def issue_tokens(events: DataFrame) -> DataFrame:
    """events (ts) with iat, in whole seconds, and the expiry of the access and the refresh token."""
    events = events.withColumn("iat", F.date_trunc("second", "ts").cast(dict(events.dtypes)["ts"]))
    return events.withColumns({"access_exp": access_expiry(F.col("iat")), "refresh_exp": refresh_expiry(F.col("iat"))})


def _status(rows: DataFrame, ok) -> DataFrame:
    status, message = UNAUTHORIZED
    return rows.withColumns({"status": F.when(ok, 200).otherwise(status), "message": F.when(~ok, message)})


def authorize(requests: DataFrame, issued: DataFrame) -> DataFrame:
    """requests (access_token, ts) with user_id and status. issued: access_token, user_id, iat. Valid from iat on, for 180 minutes; logging out does not revoke."""
    tokens = issued.where("access_token is not null").groupBy("access_token").agg(F.max_by(F.struct("user_id", "iat"), F.struct("iat", "user_id")).alias("t"))
    rows = requests.drop("user_id").join(tokens, "access_token", "left")
    ok = sure((F.col("ts") >= F.col("t.iat")) & (F.col("ts") < access_expiry(F.col("t.iat"))))
    return _status(rows, ok).withColumn("user_id", F.when(ok, F.col("t.user_id"))).drop("t")


def authorize_asof(requests: DataFrame, logins: DataFrame) -> DataFrame:
    """requests (request_id, ts, user_id) with login_ts and status: authorised by the user's latest login, if that is less than 180 minutes before (else login_ts is null).

    Time is cut into spans of 180 minutes and a login counts in its own and the next one, so one
    window per user and span sees all that matters: nothing multiplies as in a range join, and a
    user with very many rows is spread over as many tasks as there are spans."""
    span = (F.unix_seconds(F.col("ts").cast("timestamp")) / (ACCESS_MINUTES * 60)).cast("long")
    kind = dict(logins.dtypes)["ts"]
    asked = requests.withColumns({"login_ts": F.lit(None).cast(kind), "span": span})
    known = logins.select("request_id", "ts", "user_id", F.col("ts").alias("login_ts"), F.explode(F.array(span, span + 1)).alias("span"))
    both = asked.unionByName(known, allowMissingColumns=True).withColumn("is_login", F.col("login_ts").isNotNull())
    before = Window.partitionBy("user_id", "span").orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = both.withColumn("login_ts", F.last("login_ts", ignorenulls=True).over(before)).where("not is_login").drop("is_login", "span")
    ok = sure(F.col("ts") < F.col("login_ts") + F.expr(f"interval {ACCESS_MINUTES} minutes"))
    return _status(rows, ok).withColumn("login_ts", F.when(ok, F.col("login_ts")))


def save_tokens(tokens: DataFrame, cmd: DataFrame) -> DataFrame:
    """Keep one refresh token a user: the last one of cmd (userId, refreshToken, ts, request_id), else the stored one."""
    last = cmd.where("userId is not null").groupBy("userId").agg(F.max_by(F.struct("refreshToken", F.col("ts").alias("issued_at")), order()).alias("new"))
    kept = tokens.groupBy("userId").agg(F.max_by(F.struct("refreshToken", "issued_at"), F.struct("issued_at", "refreshToken")).alias("old"))
    both = kept.join(last, "userId", "full").withColumn("t", F.coalesce("new", "old"))
    return both.select("userId", "t.refreshToken", "t.issued_at")


def logout(tokens: DataFrame, cmd: DataFrame) -> Changed:
    """Delete stored tokens by value; the first logout of a token succeeds, the others fail."""
    stored = tokens.where("refreshToken is not null").select("refreshToken").distinct().withColumn("stored", F.lit(True))
    firsts = cmd.groupBy("refreshToken").agg(F.min(order()).alias("first"))
    rows = cmd.join(stored, "refreshToken", "left").join(firsts, "refreshToken", "left")
    rows = judged(
        rows,
        "logout",
        [
            Cause(~present(F.col("refreshToken")), 400, "Refresh token is required"),
            Cause(F.col("stored").isNull() | (F.col("first") < order()), 400, "Token not found"),
        ],
        done_message="Logout successful",
    )
    left = tokens.join(cmd.where("refreshToken <> ''").select("refreshToken").distinct(), "refreshToken", "left_anti").select(tokens.columns)
    return Changed(left, outcomes(rows, "logout"))


def find_tokens(tokens: DataFrame, cmd: DataFrame) -> DataFrame:
    """Stored tokens that cmd asks for."""
    return tokens.join(cmd.select("refreshToken").distinct(), "refreshToken", "left_semi").select(tokens.columns)


def refresh_valid(cmd: DataFrame, issued: DataFrame) -> DataFrame:
    """cmd (refreshToken, ts) with userId and valid: known and within 30 days of issue."""
    tokens = issued.where("refreshToken is not null").groupBy("refreshToken").agg(F.max_by(F.struct("userId", "issued_at"), F.struct("issued_at", "userId")).alias("t"))
    ok = sure((F.col("ts") >= F.col("t.issued_at")) & (F.col("ts") < refresh_expiry(F.col("t.issued_at"))))
    return cmd.join(tokens, "refreshToken", "left").withColumns({"valid": ok, "userId": F.when(ok, F.col("t.userId"))}).drop("t")


def replay_sessions(tokens: DataFrame, events: DataFrame, as_of=None) -> DataFrame:
    """The token table after logins and logouts (request_id, ts, user_id, action, refreshToken) in order; with as_of (a column), without tokens older than 30 days.

    Only a user's last login can survive, and only a later logout of the same token ends it."""
    last = events.where("action = 'login' and user_id is not null").groupBy(F.col("user_id").alias("userId")).agg(F.max_by(F.struct("refreshToken", "ts", "request_id"), order()).alias("new"))
    both = tokens.join(last, "userId", "full")
    now = both.select("userId", F.coalesce("new.refreshToken", "refreshToken").alias("refreshToken"), F.coalesce("new.ts", "issued_at").alias("issued_at"), F.col("new.ts").alias("ts"), F.col("new.request_id").alias("request_id"))
    ends = events.where("action = 'logout' and refreshToken is not null").groupBy("refreshToken").agg(F.max(order()).alias("end"))
    open_ = now.join(ends, "refreshToken", "left").where(F.col("end").isNull() | sure(order() > F.col("end")))
    if as_of is not None:
        open_ = open_.where(F.col("issued_at").isNull() | (refresh_expiry(F.col("issued_at")) > as_of))
    return open_.select("userId", "refreshToken", "issued_at")
