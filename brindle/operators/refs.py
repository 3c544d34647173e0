"""References between collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_refs(comments: DataFrame, users: DataFrame, tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """comments with username, task_title and project_title of what they refer to.

    Null references get keys of their own that match nothing, so that they don't all go to one task."""
    rows = comments
    for key, of, value, name in (("userId", users, "username", "username"), ("taskId", tasks, "title", "task_title"), ("projectId", projects, "projectTitle", "project_title")):
        found = of.select(F.col("_id").alias("_key"), F.col(value).alias(name))
        rows = rows.withColumn("_key", F.coalesce(key, F.concat(F.lit("none "), "_id"))).join(found, "_key", "left").drop("_key")
    return rows.select(*comments.columns, "username", "task_title", "project_title")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is gone; those without a reference are none."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col("_id").alias(key)), key, "left_anti").select(children.columns)


def explode_refs(rows: DataFrame, field: str) -> DataFrame:
    """A row for each reference in an array: _id, pos (from 0) and ref; nulls in it, null arrays and empty ones refer to nothing."""
    return rows.select("_id", F.posexplode(field).alias("pos", "ref")).where("ref is not null")


def dead_refs(rows: DataFrame, field: str, of: DataFrame) -> DataFrame:
    """The references (_id, pos, ref) in an array that `of` doesn't have."""
    return explode_refs(rows, field).join(of.select(F.col("_id").alias("ref")), "ref", "left_anti").select("_id", "pos", "ref")


def drop_dead_refs(rows: DataFrame, field: str, of: DataFrame) -> DataFrame:
    """rows without the references that `of` doesn't have; the others keep their order, repeats and nulls included, and null arrays stay null.

    Only positions of dead references are gathered, so rows without any take one join; null ids are told apart by no key and lose no reference."""
    dead = dead_refs(rows, field, of).groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.lit(True)))).alias("_dead"))
    alive = F.filter(field, lambda _, i: ~F.map_contains_key("_dead", i))
    kept = rows.join(dead.where("_id is not null"), "_id", "left").withColumn(field, F.when(F.col("_dead").isNull(), F.col(field)).otherwise(alive))
    return kept.select(rows.columns)


def populate(rows: DataFrame, field: str, of: DataFrame, *values: str) -> DataFrame:
    """rows with the array of references as an array of struct<_id, values> of what they refer to, in order, without those that `of` doesn't have; null arrays are empty ones."""
    of = of.select(F.col("_id").alias("ref"), F.struct(F.col("_id"), *values).alias("doc"))
    found = explode_refs(rows, field).join(of, "ref").groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc"))), lambda x: x["doc"]).alias("_docs"))
    empty = F.array().cast(found.schema["_docs"].dataType)
    return rows.join(found, "_id", "left").withColumn(field, F.coalesce("_docs", empty)).select(rows.columns)
