"""Deletion by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import order
from .outcomes import Cause, judged, outcomes
from .rules import validate
from .users import Changed


def delete_by_id(rows: DataFrame, cmd: DataFrame, action: str, key: str, status: int, missing: str, enforce: bool = True, id_format: str = "object_id") -> Changed:
    """Delete rows whose _id a command names; of commands with the same id the first succeeds."""
    cmd = validate(cmd, action, enforce, id_format)
    wanted = cmd.where(F.col("rejected").isNull() & F.col(key).isNotNull())
    firsts = wanted.groupBy(F.col(key).alias("_id")).agg(F.min(order()).alias("first"))
    there = rows.select("_id").join(firsts, "_id").select(F.col("_id").alias(key), "first")
    found = judged(
        cmd.join(there, key, "left"),
        action,
        [
            Cause(F.col("rejected").isNotNull(), 400, F.col("rejected"), edge=True),
            Cause(F.col("first").isNull() | (F.col("first") < order()), status, missing),
        ],
    )
    return Changed(rows.join(firsts.select("_id"), "_id", "left_anti").select(rows.columns), outcomes(found, action, F.col(key)))
