"""Declared schemas of collections and commands."""

from __future__ import annotations

from pyspark.sql import types as T

S, TS, B = T.StringType(), T.TimestampType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


COLLECTIONS: dict[str, T.StructType] = {
    "users": _struct(_id=S, username=S, email=S, password=S, token=S, projects=T.ArrayType(S)),
    "projects": _struct(_id=S, projectTitle=S, description=S, user=S, createdAt=TS, updatedAt=TS),
    "tasks": _struct(_id=S, title=S, description=S, projectId=S, deadline=TS, createdAt=TS),
    "comments": _struct(_id=S, text=S, createdAt=TS, projectId=S, taskId=S, userId=S),
    "tokens": _struct(userId=S, refreshToken=S, issued_at=TS),
}

#: Fields that must be there: strings non-empty, references non-null.
REQUIRED: dict[str, tuple[str, ...]] = {
    "users": ("username", "email", "password"),
    "projects": ("projectTitle", "description", "user"),
    "tasks": ("title", "description"),
    "comments": ("text",),
    "tokens": ("userId", "refreshToken"),
}

#: Timestamps that default to the time of the job.
DEFAULTS: dict[str, tuple[str, ...]] = {"projects": ("createdAt", "updatedAt"), "tasks": ("createdAt",), "comments": ("createdAt",)}

_COMMON = {"request_id": S, "ts": TS, "user_id": S}
COMMANDS: dict[str, T.StructType] = {
    k: _struct(**_COMMON, **v)
    for k, v in {
        "register": {"email": S, "password": S, "username": S},
        "login": {"email": S, "password": S, "password_ok": B},
        "logout": {"refreshToken": S},
        "update_email": {"refreshToken": S, "newEmail": S},
        "project_create": {"projectTitle": S, "description": S},
        "project_get": {"id": S},
        "project_delete": {"id": S},
        "project_update": {"projectTitle": S, "newTitle": S, "newDescription": S, "newCreatedAt": S},
        "tasks_get": {"projectId": S, "val": S, "searchType": S},
        "task_create": {"projectId": S, "projectData": _struct(title=S, description=S, deadline=S)},
        "task_update": {"taskId": S, "updatedData": T.MapType(S, S)},
        "task_delete": {"projectId": S, "taskId": S},
        "comment_create": {"taskId": S, "text": S},
        "comment_delete": {"id": S},
    }.items()
}
