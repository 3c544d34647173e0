"""Users: registration, login, change of e-mail, what is shown of them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import new_id, order, present, sure
from .outcomes import Cause, judged, outcomes
from .rules import has_required, validate


class Registered(NamedTuple):
    users: DataFrame
    tokens: DataFrame
    outcomes: DataFrame
    inserted: DataFrame


class LoggedIn(NamedTuple):
    tokens: DataFrame
    outcomes: DataFrame


class Changed(NamedTuple):
    state: DataFrame
    outcomes: DataFrame


def _token(cmd: DataFrame):
    """The issued token is an input; without one, a name derived from the request stands for it."""
    return F.col("refreshToken") if "refreshToken" in cmd.columns else F.concat(F.lit("rt-"), F.col("request_id"))


def register(users: DataFrame, cmd: DataFrame, enforce: bool = True, known: DataFrame | None = None) -> Registered:
    """Insert users with new e-mails. Of commands with the same e-mail the first acceptable one wins.

    With `known`, a frame of e-mails, those of the commands that users have are taken from there (sources/known.py
    finds them without reading all users); it must have each of them.

    The winner of each e-mail is found by an aggregate (summed up before it is shuffled, so an
    e-mail that bots send is no bottleneck) and joined back."""
    cmd = validate(cmd, "register", enforce).withColumn("complete", has_required("users"))
    known = (users if known is None else known).select("email").where("email is not null").distinct().withColumn("exists", F.lit(True))
    cmd = cmd.join(known, "email", "left")
    winners = cmd.where("rejected is null and exists is null and complete").groupBy("email").agg(F.min(order()).alias("winner"))
    cmd = cmd.join(winners, "email", "left")
    earlier = sure(F.col("winner") < order())
    rows = judged(
        cmd,
        "register",
        [
            Cause(F.col("rejected").isNotNull(), 400, F.col("rejected"), edge=True),
            Cause(sure(F.col("exists")) | earlier, 400, "User with this email already exists."),
            Cause(~F.col("complete"), 500, "User validation failed"),
        ],
    )
    new = rows.where("cause_status is null").withColumn("_id", new_id(F.col("request_id")))
    inserted = new.select("_id", "username", "email", "password", F.lit(None).cast("string").alias("token"), F.array().cast("array<string>").alias("projects"))
    tokens = new.select("request_id", "ts", F.col("_id").alias("userId"), _token(cmd).alias("refreshToken"))
    return Registered(users.unionByName(inserted, allowMissingColumns=True), tokens, outcomes(rows, "register", new_id(F.col("request_id"))), inserted)


def resolve_logins(users: DataFrame, cmd: DataFrame, enforce: bool = True) -> LoggedIn:
    """Judge logins by the user with the least _id of the e-mail. Whether a password fits is an input, password_ok."""
    one = users.where("email is not null").groupBy("email").agg(F.min(F.struct("_id", F.coalesce(F.col("password") != "", F.lit(False)).alias("has_password"))).alias("user"))
    rows = validate(cmd, "login", enforce).join(one, "email", "left")
    rows = judged(
        rows,
        "login",
        [
            Cause(F.col("rejected").isNotNull(), 400, F.col("rejected"), edge=True),
            Cause(F.col("user").isNull(), 400, F.concat(F.lit("Can't find user with email "), F.coalesce("email", F.lit("undefined")))),
            Cause(~F.col("user.has_password"), 400, "User password is not set"),
            Cause(~sure(F.col("password_ok")), 400, "Invalid password"),
        ],
    )
    tokens = rows.where("cause_status is null").select("request_id", "ts", F.col("user._id").alias("userId"), _token(cmd).alias("refreshToken"))
    return LoggedIn(tokens, outcomes(rows, "login", F.col("user._id")))


def update_email(users: DataFrame, tokens: DataFrame, cmd: DataFrame, enforce: bool = True) -> Changed:
    """Set the e-mail of the user that a refresh token belongs to; the last command of a user wins. New e-mails need not be unique."""
    owner = tokens.where("refreshToken is not null").groupBy("refreshToken").agg(F.min("userId").alias("userId"))
    known = users.select(F.col("_id").alias("userId"), F.lit(True).alias("found"))
    rows = validate(cmd, "update_email", enforce).join(owner, "refreshToken", "left").join(known, "userId", "left")
    rows = judged(
        rows,
        "update_email",
        [
            Cause(F.col("rejected").isNotNull(), 400, F.col("rejected"), edge=True),
            Cause(~present(F.col("refreshToken")), 401, "User is not authorized", edge=True),
            Cause(F.col("found").isNull(), 404, "User not found"),
        ],
    )
    last = rows.where("cause_status is null").groupBy(F.col("userId").alias("_id")).agg(F.max_by("newEmail", order()).alias("newEmail"))
    state = users.join(last, "_id", "left").withColumn("email", F.coalesce("newEmail", "email")).select(users.columns)
    return Changed(state, outcomes(rows, "update_email", F.col("userId")))


def user_projects(projects: DataFrame) -> DataFrame:
    """user and the sorted ids of the projects that it owns."""
    return projects.where("user is not null").groupBy("user").agg(F.array_sort(F.collect_list("_id")).alias("projects"))


def user_dto(users: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """id, email and projects; with projects given, those owned, else the stored ones."""
    if projects is None:
        return users.select(F.col("_id").alias("id"), "email", "projects")
    owned = user_projects(projects).withColumnRenamed("user", "_id")
    return users.drop("projects").join(owned, "_id", "left").select(F.col("_id").alias("id"), "email", F.coalesce("projects", F.array().cast("array<string>")).alias("projects"))
