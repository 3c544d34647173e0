"""Comments: creation and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import new_id
from .keyed import delete_by_id
from .outcomes import Cause, judged, outcomes
from .rules import has_required, validate
from .users import Changed


def create_comments(comments: DataFrame, cmd: DataFrame, as_of: Column, enforce: bool = True, id_format: str = "object_id") -> Changed:
    """Insert comments (taskId, text) of their principal; whether task and user exist is not looked at."""
    rows = judged(
        validate(cmd, "comment_create", enforce, id_format).withColumn("complete", has_required("comments")),
        "comment_create",
        [Cause(F.col("rejected").isNotNull(), 400, F.col("rejected"), edge=True), Cause(~F.col("complete"), 500, "Comment validation failed")],
    )
    new = rows.where("cause_status is null").select(new_id(F.col("request_id")).alias("_id"), "text", as_of.alias("createdAt"), F.lit(None).cast("string").alias("projectId"), "taskId", F.col("user_id").alias("userId"))
    return Changed(comments.unionByName(new), outcomes(rows, "comment_create", new_id(F.col("request_id"))))


def delete_comments(comments: DataFrame, cmd: DataFrame, enforce: bool = True, id_format: str = "object_id") -> Changed:
    return delete_by_id(comments, cmd, "comment_delete", "id", 404, "No comment was found by requested id", enforce, id_format)
