"""What a client gets for each command."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses and their messages.
UNAUTHORIZED = (401, "User is not authorized")
FORBIDDEN = (403, "User is not admin")
NO_PROJECT = (404, "No project was found by requested id")
INTERNAL = (500, "Internal server error")
OTHER = (500, "Server error")

#: The message that covers a failure within an action; True if the inner message follows it.
COVERS: dict[str, tuple[str, bool]] = {
    "register": ("Registration failed", False),
    "login": ("Login failed", False),
    "update_email": ("Email update failed", False),
    "logout": ("Logout failed", False),
    "project_create": ("Error creating project", False),
    "project_get": ("Error fetching project", False),
    "project_update": ("Error updating project: ", True),
    "project_delete": ("Error deleting project", False),
    "tasks_get": ("Error retrieving tasks", False),
    "task_create": ("Error creating task", False),
    "task_update": ("Error updating task: ", True),
    "task_delete": ("Error deleting task: ", True),
    "comment_create": ("Error creating comment", False),
    "comment_delete": ("Error deleting comment", False),
}

#: Actions whose own 400s reach the client as they are.
KEEPS = ("register",)


def error_outcome(status: Column, message: Column) -> tuple[Column, Column]:
    """The status and message that a client gets for an error: a known kind keeps its status and its message (or has its kind's own); any other is a server error."""
    known = None
    for code, own in (UNAUTHORIZED, FORBIDDEN, NO_PROJECT, INTERNAL):
        said = F.coalesce(message, F.lit(own))
        known = F.when(status == code, said) if known is None else known.when(status == code, said)
    is_known = F.coalesce(status.isin(400, UNAUTHORIZED[0], FORBIDDEN[0], NO_PROJECT[0], INTERNAL[0]), F.lit(False))
    return F.when(is_known, status).otherwise(OTHER[0]), F.when(is_known, known.when(status == 400, message)).otherwise(OTHER[1])


def judge_bodies(rows: DataFrame, broken: str = "_corrupt_record") -> DataFrame:
    """Request bodies with cause_status, status and message: a broken one fails before any action, as an error of no known kind; of others all three are null.

    Whoever applies the commands takes those without a cause_status, and whoever answers the rest, of one pass over the bodies."""
    bad = F.col(broken).isNotNull()
    status, message = error_outcome(F.lit(None).cast("int"), F.lit(None).cast("string"))
    return rows.withColumns({"cause_status": F.when(bad, OTHER[0]), "status": F.when(bad, status), "message": F.when(bad, message)})


@dataclass(frozen=True)
class Cause:
    """When a command fails, with which inner status and message. `edge`: before the action itself, so that it reaches the client as it is."""

    when: Column
    status: int
    message: Column | str
    edge: bool = False


def judged(cmd: DataFrame, action: str, causes: list[Cause], done: int = 200, done_message: Column | str | None = None) -> DataFrame:
    """cmd with cause_status, status and message; the first cause that holds counts."""
    cover, with_inner = COVERS[action]
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    kind = "struct<cause_status:int,status:int,message:string>"
    fields = lambda a, b, m: F.struct(F.lit(a).cast("int").alias("cause_status"), F.lit(b).cast("int").alias("status"), as_column(m).alias("message"))
    found = None
    for c in causes:
        keeps = c.edge or (action in KEEPS and c.status != 500)
        message = c.message if keeps else F.concat(F.lit(cover), as_column(c.message)) if with_inner else cover
        value = fields(c.status, c.status if keeps else 500, message)
        found = F.when(c.when, value) if found is None else found.when(c.when, value)
    good = fields(None, done, done_message)
    verdict = (good if found is None else found.otherwise(good)).cast(kind)
    return cmd.withColumn("_verdict", verdict).select(*cmd.columns, "_verdict.*")


def outcomes(judged_rows: DataFrame, action: str | Column, id: Column | None = None, *more: Column) -> DataFrame:
    """One row per command: request_id, action, cause_status, status, message, errors and id (and more columns)."""
    failed = F.col("cause_status").isNotNull()
    errors = F.col("violations") if "violations" in judged_rows.columns else F.array().cast("array<struct<field:string,message:string>>")
    return judged_rows.select(
        "request_id",
        (F.lit(action) if isinstance(action, str) else action).alias("action"),
        "cause_status",
        "status",
        "message",
        errors.alias("errors"),
        F.when(~failed, id if id is not None else F.lit(None).cast("string")).alias("id"),
        *more,
    )
