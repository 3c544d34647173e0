"""Row-local checks, defaults and casts. None of them shuffles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_email, is_id, length_within, present, sure
from ..schemas import COLLECTIONS, DEFAULTS, REQUIRED

Check = Callable[[Column, str], Column]
_EMAIL: Check = lambda c, _: is_email(c)
_ID: Check = is_id
_THERE: Check = lambda c, _: present(c)
_NOT_EMPTY_IF_THERE: Check = lambda c, _: c.isNull() | sure(c != "")

#: Fixed values: (field, message, check, whether a violation rejects).
RULES: dict[str, list[tuple[str, str, Check, bool]]] = {
    "register": [("email", "Invalid email", _EMAIL, True), ("password", "Password must be between 6 and 24 characters", lambda c, _: length_within(c, 6, 24), True)],
    "login": [("email", "Invalid email", _EMAIL, True), ("password", "Password is required", _THERE, True)],
    "update_email": [("newEmail", "Invalid email", _EMAIL, True)],
    "project_create": [("projectTitle", "Project name is required", _THERE, True)],
    "project_update": [("projectId", "Invalid project ID", _ID, False), ("newTitle", "Project name cannot be empty", _NOT_EMPTY_IF_THERE, False)],
    "project_delete": [("id", "Invalid project ID", _ID, True)],
    "tasks_get": [("projectId", "Invalid project ID", _ID, True)],
    "task_update": [("taskId", "Invalid task ID", _ID, True), ("status", "Task status is required", _THERE, False)],
    "task_create": [("projectId", "Invalid project ID", _ID, True), ("title", "Task title is required", _THERE, True)],
    "task_delete": [("taskId", "Invalid task ID", _ID, True)],
    "comment_create": [("taskId", "Invalid task ID", _ID, True), ("text", "Comment content is required", _THERE, True)],
    "comment_delete": [("id", "Invalid comment ID", _ID, True)],
}


def _violation(field: str, message: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))


def validate(cmd: DataFrame, action: str, enforce: bool = True, id_format: str = "object_id") -> DataFrame:
    """cmd with `violations` (all of them, in order) and `rejected` (the message of the first one that rejects; null if none does). Rules on columns that cmd lacks are left out."""
    bad, reject = [], []
    for field, message, check, enforced in RULES.get(action, []):
        if field in cmd.columns:
            fails = ~check(F.col(field), id_format)
            bad.append(F.when(fails, _violation(field, message)))
            if enforced and enforce:
                reject.append(F.when(fails, F.lit(message)))
    violations = F.filter(F.array(*bad), lambda x: x.isNotNull()) if bad else F.array().cast("array<struct<field:string,message:string>>")
    return cmd.withColumns({"violations": violations, "rejected": F.coalesce(*reject) if reject else F.lit(None).cast("string")})


def has_required(model: str) -> Column:
    """Whether required strings are non-empty and required references non-null."""
    return reduce(lambda a, b: a & b, (present(F.col(c)) for c in REQUIRED[model]))


def require_fields(df: DataFrame, model: str) -> DataFrame:
    return df.where(has_required(model))


def apply_defaults(df: DataFrame, model: str, as_of: Column) -> DataFrame:
    known = set(df.columns)
    return df.withColumns({c: F.coalesce(F.col(c), as_of) if c in known else as_of for c in DEFAULTS.get(model, ())})


def as_time(c: Column, kind: str) -> Column:
    """A column as a timestamp; strings that are none give null."""
    return F.try_to_timestamp(c) if kind == "string" else c


def conform(df: DataFrame, model: str) -> DataFrame:
    """The declared fields alone, cast, with `castable`: false where a value is lost by the cast. Timestamps keep their kind (with or without a zone)."""
    kinds = dict(df.dtypes)
    columns, lost = [], []
    for f in COLLECTIONS[model].fields:
        if f.name not in kinds:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            value = as_time(c, kinds[f.name])
        else:
            value = c.cast(f.dataType)
        columns.append(value.alias(f.name))
        lost.append(c.isNotNull() & value.isNull())
    keep = reduce(lambda a, b: a | b, lost) if lost else F.lit(False)
    return df.select(*columns, (~keep).alias("castable"))
