"""Tasks: search, creation, ordered patches and deletions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import BOUNDED_TITLE, matches, title_matches, ways
from ..functions.scalars import new_id, order, present, sure
from ..functions.segments import cuts, for_each_segment, running_last, with_segments
from ..schemas import COLLECTIONS
from .outcomes import Cause, judged, outcomes
from .rules import apply_defaults, as_time, has_required, validate
from .users import Changed

FIELDS = ("title", "description", "projectId", "deadline", "createdAt")


def tasks_by_project(tasks: DataFrame, project: str | DataFrame) -> DataFrame:
    """All tasks of a project, or of each command's project (with its request_id)."""
    if isinstance(project, DataFrame):
        return project.select("request_id", "projectId").join(tasks, "projectId").select("request_id", *tasks.columns)
    return tasks.where(F.col("projectId") == project)


def search_tasks(tasks: DataFrame, project: str, val: str = "", search_type: str = "") -> DataFrame:
    """The tasks of a project; with search_type `title`, those whose title matches val."""
    found = tasks_by_project(tasks, project)
    return found.where(title_matches(F.col("title"), val)) if search_type == "title" else found


def search_tasks_batch(tasks: DataFrame, cmd: DataFrame, enforce: bool = True, id_format: str = "object_id") -> tuple[DataFrame, DataFrame]:
    """The tasks that each command finds (with its request_id), and the outcomes.

    Patterns take the ways of functions/patterns.py, so that none ends a job or its time; a
    refused one fails its own command alone, and so does one that needs backtracking where
    the project has a title longer than that way takes."""
    cmd = validate(cmd.withColumns({"val": F.coalesce("val", F.lit("")), "searchType": F.coalesce("searchType", F.lit(""))}), "tasks_get", enforce, id_format)
    by_title = F.col("searchType") == "title"
    cmd = cmd.withColumn("_way", ways(F.when(by_title, F.col("val")).otherwise(""))).withColumns({"way": F.col("_way.way"), "form": F.col("_way.form")}).drop("_way")
    bounded = cmd.where("way = 'bounded'").select("request_id", "projectId")
    costly = bounded.join(tasks.where(F.length("title") > BOUNDED_TITLE).select("projectId").distinct(), "projectId").select("request_id", F.lit(True).alias("costly"))
    rows = judged(
        cmd.join(costly, "request_id", "left"),
        "tasks_get",
        [
            Cause(F.col("rejected").isNotNull(), 400, F.col("rejected"), edge=True),
            Cause(F.col("way").isNull(), 500, "Invalid regular expression"),
            Cause(sure(F.col("costly")), 500, "Regular expression is too costly"),
        ],
    )
    asked = rows.where("cause_status is null").select("request_id", "projectId", "searchType", "way", "form")
    found = asked.join(tasks, "projectId").where(~by_title | sure(matches(F.col("title"), F.col("way"), F.col("form"))))
    return found.select("request_id", *tasks.columns), outcomes(rows, "tasks_get", F.col("projectId"))


def create_tasks(tasks: DataFrame, cmd: DataFrame, as_of: Column, enforce: bool = True, id_format: str = "object_id") -> Changed:
    """Insert tasks (projectId, projectData); whether the project exists is not looked at."""
    data = cmd.select("*", "projectData.*")
    kinds = dict(data.dtypes)
    due = as_time(F.col("deadline"), kinds["deadline"])
    rows = validate(data, "task_create", enforce, id_format).withColumns({"_due": due, "complete": has_required("tasks")})
    rows = judged(
        rows,
        "task_create",
        [
            Cause(F.col("rejected").isNotNull(), 400, F.col("rejected"), edge=True),
            Cause(~F.col("complete"), 500, "Task validation failed"),
            Cause(present(F.col("deadline").cast("string")) & F.col("_due").isNull(), 500, "Invalid date"),
        ],
    )
    new = rows.where("cause_status is null").select(new_id(F.col("request_id")).alias("_id"), "title", "description", "projectId", F.col("_due").alias("deadline"))
    return Changed(tasks.unionByName(apply_defaults(new, "tasks", as_of)), outcomes(rows, "task_create", new_id(F.col("request_id"))))


def _value(tasks: DataFrame, field: str) -> Column:
    raw = F.col("updatedData").getItem(field)
    kind = dict(tasks.dtypes)[field]
    return F.try_to_timestamp(raw).cast(kind) if kind.startswith("timestamp") else raw.cast(kind)


def _folded(tasks: DataFrame, cmd: DataFrame, has: dict[str, Column]) -> DataFrame:
    """Of each task with commands that count: the last value of each field with its order (null: none), and the first delete.

    Patches and deletes meet in one aggregate, which is summed up before it is shuffled and then meets the tasks as it lies."""
    said = {f"_{f}": F.when(F.col("_counts") & has[f], F.struct("ts", "request_id", _value(tasks, f).alias("v"))) for f in FIELDS}
    gone = F.when(F.col("kind") == "task_delete", order())
    some = cmd.where("taskId is not null and (_counts or (kind = 'task_delete' and rejected is null))")
    return some.groupBy(F.col("taskId").alias("_id")).agg(*(F.max(v).alias(k) for k, v in said.items()), F.min(gone).alias("_end"))


def _patched(field: str) -> Column:
    return F.when(F.col("_end").isNull() & F.col(f"_{field}").isNotNull(), F.col(f"_{field}.v")).otherwise(F.col(field)).alias(field)


def _changed(tasks: DataFrame, patches: DataFrame, deletes: DataFrame | None, enforce: bool, id_format: str) -> tuple[DataFrame, DataFrame]:
    """What the commands that count make of each task (see _folded), and the judged commands with the task after each patch (before each delete)."""
    same, at = ["request_id", "ts", "taskId"], ["ts", "request_id"]
    cmd = patches.select(*same, "updatedData", F.lit("task_update").alias("kind"))
    if deletes is not None:
        cmd = cmd.unionByName(deletes.select(*same, F.lit("task_delete").alias("kind")), allowMissingColumns=True)
    cmd = validate(cmd, "task_delete", enforce, id_format)  # both kinds have the same rule that rejects
    has = {f: F.coalesce(F.map_contains_key("updatedData", F.lit(f)), F.lit(False)) for f in FIELDS}
    times = [f for f in FIELDS if dict(tasks.dtypes)[f].startswith("timestamp")]
    bad = reduce(lambda a, b: a | b, (sure(F.col("updatedData").getItem(f).isNotNull() & _value(tasks, f).isNull()) for f in times))
    cmd = cmd.withColumn("bad_date", bad)
    # a patch that is valid counts for its task whether or not that is there: without it nothing asks for the values
    cmd = cmd.withColumn("_counts", F.col("rejected").isNull() & (F.col("kind") == "task_update") & ~F.col("bad_date"))
    values = [f"_{f}" for f in FIELDS]
    folded = _folded(tasks, cmd, has)
    cmd = cmd.withColumns({f"_{f}": F.when(F.col("_counts") & has[f], F.struct(_value(tasks, f).alias("v"))) for f in FIELDS}).drop("updatedData", "_counts")
    ends = cmd.where("kind = 'task_delete' and rejected is null").groupBy("taskId").agg(F.min(order()).alias("end"))
    # the commands meet all else by (taskId, seg), in one exchange of theirs
    found = cuts(cmd, "taskId", at)
    cmd = running_last(with_segments(cmd, "taskId", at, found), "taskId", at, values, found)
    old = tasks.select(F.col("_id").alias("taskId"), F.struct(*(F.col(f) for f in FIELDS)).alias("old"))
    cmd = cmd.join(for_each_segment(old, "taskId", found), ["taskId", "seg"], "left")
    cmd = cmd.join(for_each_segment(ends, "taskId", found), ["taskId", "seg"], "left") if deletes is not None else cmd.withColumn("end", F.lit(None).cast(ends.schema["end"].dataType))
    cmd = cmd.withColumn("live", F.col("rejected").isNull() & F.col("old").isNotNull() & (F.col("end").isNull() | (order() <= F.col("end"))))
    causes = [
        Cause(F.col("rejected").isNotNull(), 400, F.col("rejected"), edge=True),
        Cause(~F.col("live"), 400, "Task not found"),
        Cause(F.col("bad_date"), 500, "Invalid date"),
    ]
    rows = judged(cmd, "task_update", causes).withColumn("_said", F.col("message")).drop("cause_status", "status", "message")
    rows = judged(rows, "task_delete", causes).withColumn("message", F.when(F.col("kind") == "task_update", F.col("_said")).otherwise(F.col("message")))  # the statuses are the same
    now = lambda f: F.when(F.col("cause_status").isNull(), F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v")).otherwise(F.col(f"old.{f}"))).alias(f)
    return folded, outcomes(rows, F.col("kind"), F.col("taskId"), *(now(f) for f in FIELDS))


def _state(tasks: DataFrame, folded: DataFrame) -> DataFrame:
    return tasks.join(folded, "_id", "left").where("_end is null").select("_id", *map(_patched, FIELDS))


def change_tasks(tasks: DataFrame, patches: DataFrame, deletes: DataFrame | None = None, enforce: bool = True, id_format: str = "object_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Patches (taskId, updatedData) and deletes (taskId) in order: what comes after the first delete of an id finds nothing.

    Returns the new state, the outcomes of both kinds, and the row after each patch (before each delete).
    Patches fold by a last value per field, where an explicit null is a value."""
    folded, rows = _changed(tasks, patches, deletes, enforce, id_format)
    return _state(tasks, folded), rows.drop(*FIELDS), rows.where("cause_status is null").select("request_id", F.col("id").alias("_id"), *FIELDS)


def task_changes(tasks: DataFrame, patches: DataFrame, deletes: DataFrame | None = None, enforce: bool = True, id_format: str = "object_id") -> tuple[DataFrame, DataFrame]:
    """The tasks that change_tasks changes, as they are then, with `_deleted` for those that go; and the outcomes.

    Tasks meet the commands of all kinds in one join, by their ids."""
    folded, rows = _changed(tasks, patches, deletes, enforce, id_format)
    changed = tasks.join(folded, "_id").select("_id", *map(_patched, FIELDS), F.col("_end").isNotNull().alias("_deleted"))
    return changed, rows.drop(*FIELDS)


def patch_tasks(tasks: DataFrame, cmd: DataFrame, enforce: bool = True, id_format: str = "object_id") -> Changed:
    """Partial updates by id: keys that are there are set (a null too), unknown ones dropped. Outcomes have the task after the patch."""
    folded, rows = _changed(tasks, cmd, None, enforce, id_format)
    return Changed(_state(tasks, folded), rows)


def delete_tasks(tasks: DataFrame, cmd: DataFrame, enforce: bool = True, id_format: str = "object_id") -> Changed:
    """Delete by taskId; the first command of an id gets the deleted row."""
    from .keyed import delete_by_id

    gone = delete_by_id(tasks, cmd, "task_delete", "taskId", 400, "Task not found", enforce, id_format)
    rows = tasks.select(F.col("_id").alias("id"), *FIELDS)
    return Changed(gone.state, gone.outcomes.join(rows, "id", "left"))


assert tuple(f.name for f in COLLECTIONS["tasks"].fields) == ("_id", *FIELDS)
