"""Projects: creation, lookup, first-match updates, deletion."""

from __future__ import annotations

from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.components import connected
from ..functions.scalars import new_id, or_else, order, present, sure
from .keyed import delete_by_id
from .outcomes import Cause, judged, outcomes
from .rules import as_time, has_required, validate
from .users import Changed


def project_dto(projects: DataFrame) -> DataFrame:
    return projects.select("_id", F.col("projectTitle").alias("title"), "description")


def create_projects(projects: DataFrame, cmd: DataFrame, as_of: Column, enforce: bool = True) -> Changed:
    """Insert projects that their principal (user_id) owns."""
    rows = validate(cmd, "project_create", enforce).withColumn("user", F.col("user_id")).withColumn("complete", has_required("projects"))
    rows = judged(
        rows,
        "project_create",
        [
            Cause(F.col("rejected").isNotNull(), 400, F.col("rejected"), edge=True),
            Cause(~present(F.col("projectTitle")), 400, "Project title is required", edge=True),
            Cause(~F.col("complete"), 500, "Project validation failed"),
        ],
        done=201,
    )
    new = rows.where("cause_status is null").select(new_id(F.col("request_id")).alias("_id"), "projectTitle", "description", "user", as_of.alias("createdAt"), as_of.alias("updatedAt"))
    return Changed(projects.unionByName(new), outcomes(rows, "project_create", new_id(F.col("request_id"))))


def get_projects(projects: DataFrame, cmd: DataFrame) -> DataFrame:
    """Outcomes of lookups by id, with the project's title and description."""
    found = projects.select(F.col("_id").alias("id"), "projectTitle", "description", F.lit(True).alias("found"))
    rows = judged(
        cmd.join(found, "id", "left"),
        "project_get",
        [Cause(~present(F.col("id")), 400, "ID is required", edge=True), Cause(F.col("found").isNull(), 400, "Project not found")],
    )
    extra = rows.select("request_id", F.col("projectTitle").alias("title"), "description")
    return outcomes(rows, "project_get", F.col("id")).join(extra, "request_id")


def delete_projects(projects: DataFrame, cmd: DataFrame, enforce: bool = True, id_format: str = "object_id") -> Changed:
    return delete_by_id(projects, cmd, "project_delete", "id", 404, "No project was found by requested id", enforce, id_format)


def _ordered(cmd: DataFrame) -> DataFrame:
    kinds = dict(cmd.dtypes)
    at = as_time(F.col("newCreatedAt"), kinds["newCreatedAt"])
    text = F.col("newCreatedAt").cast("string")
    return cmd.withColumns({"_at": at, "_bad": present(text) & at.isNull()})


def split_by_interaction(cmd: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commands of users none of whose commands can see another's effect, and the rest."""
    several = cmd.groupBy("user_id", "projectTitle").agg(F.count("*").alias("n")).where("n > 1").select("user_id")
    titles = cmd.select("user_id", "projectTitle", "request_id")
    renamed = cmd.where("newTitle <> ''").select("user_id", F.col("newTitle").alias("projectTitle"), F.col("request_id").alias("by"))
    chained = renamed.join(titles, ["user_id", "projectTitle"]).where("by <> request_id").select("user_id")
    slow = several.union(chained).distinct()
    return cmd.join(slow, "user_id", "left_anti"), cmd.join(slow, "user_id", "left_semi")


def _update_apart(projects: DataFrame, cmd: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """For commands that cannot see each other: patches by _id, and the project of each command."""
    firsts = projects.groupBy(F.col("user").alias("user_id"), "projectTitle").agg(F.min("_id").alias("_id"))
    hits = cmd.join(firsts, ["user_id", "projectTitle"], "left")
    patches = hits.where("_id is not null and not _bad and projectTitle <> ''").select("_id", "newTitle", "newDescription", "_at", as_of.alias("_now"))
    return patches, hits.select("request_id", "_id")


class _User:
    """A user's projects, by title; commands come in order."""

    def __init__(self):
        self.ids: dict[str, list[str]] = {}  # heaps
        self.state: dict[str, dict] = {}
        self.changed: set[str] = set()

    def add(self, _id: str, title: str, description: str, at) -> None:
        self.state[_id] = {"projectTitle": title, "description": description, "createdAt": at}
        heappush(self.ids.setdefault(title, []), _id)

    def update(self, title: str, new_title: str, description: str, at, bad: bool) -> str | None:
        """The project that the command finds: the least id of the title."""
        found = self.ids.get(title) if title else None
        if not found:
            return None
        _id = found[0]
        if not bad:
            p = self.state[_id]
            if new_title and new_title != title:
                heappush(self.ids.setdefault(new_title, []), heappop(found))
                p["projectTitle"] = new_title
            p["description"] = description or p["description"]
            p["createdAt"] = p["createdAt"] if at is None else at
            self.changed.add(_id)
        return _id


def _replay(fields: list[str], kind: pa.DataType):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string()] * (len(fields) - 1) + [kind]
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=fields)

    def run(batches):
        name, user, rows = None, _User(), []
        for b in batches:
            for owner, key, title, new_title, description, at, bad in zip(*(b.column(c).to_pylist() for c in ("user", "key", "title", "new_title", "text", "at", "bad")), strict=True):
                if owner != name:
                    rows += [(None, k, p["projectTitle"], p["description"], p["createdAt"]) for k in user.changed for p in [user.state[k]]]
                    name, user = owner, _User()
                if bad is None:
                    user.add(key, title, description, at)
                else:
                    rows.append((key, user.update(title, new_title, description, at, bad), None, None, None))
            if rows:
                yield batch(rows)
                rows = []
        rows = [(None, k, p["projectTitle"], p["description"], p["createdAt"]) for k in user.changed for p in [user.state[k]]]
        if rows:
            yield batch(rows)

    return run


def title_parts(cmd: DataFrame, folder: str) -> DataFrame:
    """(user_id, projectTitle, part) of the titles that commands look for: titles of a user have the same part if a chain of renames leads from one to the other.

    A rename to a title that no command of the user looks for binds nothing. Nodes are
    64-bit hashes, of which equal ones would only bind parts that could be apart. The
    components' tables are written to the folder, one that the cluster shares."""
    node = lambda title: F.xxhash64("user_id", title)
    asked = cmd.where("user_id is not null and projectTitle <> ''").select("user_id", "projectTitle").distinct().withColumn("node", node("projectTitle"))
    renames = cmd.where("user_id is not null and projectTitle <> '' and newTitle <> ''").select("user_id", "projectTitle", "newTitle").distinct()
    edges = renames.join(asked.select("user_id", F.col("projectTitle").alias("newTitle")), ["user_id", "newTitle"], "left_semi").select(node("projectTitle").alias("a"), node("newTitle").alias("b"))
    return asked.join(connected(edges, folder), "node", "left").select("user_id", "projectTitle", F.coalesce("component", "node").alias("part"))


def _replayed(projects: DataFrame, cmd: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Rows with request_id and _id of what each command found, and, without request_id, projects after them, of the users whose commands interact.

    Projects and then commands of each user (with parts: of each part of a user's titles) in order stream through a task; it holds the projects of titles that occur in commands."""
    at = dict(projects.dtypes)["createdAt"]
    none = F.lit(None)
    if parts is None:
        parts = cmd.select("user_id", "projectTitle").distinct().withColumn("part", F.lit(0))
        cmd = cmd.withColumn("part", F.lit(0))
    else:  # a command without a title finds nothing, wherever it is
        cmd = cmd.join(parts, ["user_id", "projectTitle"], "left").withColumn("part", F.coalesce("part", F.xxhash64("request_id")))
    owner = F.concat_ws(":", "part", "user").alias("user")
    mine = projects.join(parts.withColumnRenamed("user_id", "user"), ["user", "projectTitle"]).select(owner, F.col("_id").alias("key"), none.cast(dict(cmd.dtypes)["ts"]).alias("ts"), F.col("projectTitle").alias("title"), none.cast("string").alias("new_title"), F.col("description").alias("text"), F.col("createdAt").alias("at"), none.cast("boolean").alias("bad"))
    theirs = cmd.withColumnRenamed("user_id", "user").select(owner, F.col("request_id").alias("key"), "ts", F.col("projectTitle").alias("title"), F.col("newTitle").alias("new_title"), F.col("newDescription").alias("text"), F.col("_at").cast(at).alias("at"), F.coalesce("_bad", F.lit(False)).alias("bad"))
    rows = mine.union(theirs).withColumn("order", F.col("bad").isNotNull()).repartition("user").sortWithinPartitions("user", "order", "ts", "key").drop("order")
    out = T.StructType([T.StructField(c, T.StringType()) for c in ("request_id", "_id", "projectTitle", "description")] + [projects.schema["createdAt"]])
    return rows.mapInArrow(_replay(out.names, pa.timestamp("us", tz="UTC" if at == "timestamp" else None)), out)


def update_projects(projects: DataFrame, cmd: DataFrame, as_of: Column, parts: DataFrame | None = None) -> Changed:
    """Patch the first project (least _id) of (user, projectTitle). Users whose commands interact are replayed in order, those titles of theirs that occur in commands; all others take one aggregate and two joins.

    With the parts of titles (title_parts), each part of a user is replayed by itself, so that a user with very many commands spreads over tasks."""
    cmd = _ordered(cmd)
    apart, chained = split_by_interaction(cmd)
    patches, hits = _update_apart(projects, apart, as_of)
    replay = _replayed(projects, chained, parts)
    hits = hits.union(replay.where("request_id is not null").select("request_id", "_id"))
    after = replay.where("request_id is null").select("_id", *(F.col(c).alias(f"r_{c}") for c in ("projectTitle", "description", "createdAt")), as_of.alias("r_updatedAt"), F.lit(True).alias("replayed"))
    rows = projects.join(patches, "_id", "left").join(after, "_id", "left")
    pick = lambda c, fast: F.when(F.col("replayed"), F.col(f"r_{c}")).otherwise(fast).alias(c)
    state = rows.select(
        "_id",
        pick("projectTitle", or_else(F.col("newTitle"), F.col("projectTitle"))),
        pick("description", or_else(F.col("newDescription"), F.col("description"))),
        "user",
        pick("createdAt", F.coalesce("_at", "createdAt")),
        pick("updatedAt", F.coalesce("_now", "updatedAt")),
    )
    judged_rows = judged(
        cmd.join(hits, "request_id", "left"),
        "project_update",
        [
            Cause(~present(F.col("projectTitle")), 400, "Project title is required", edge=True),
            Cause(F.col("_id").isNull(), 400, "Project not found"),
            Cause(sure(F.col("_bad")), 500, "Invalid date"),
        ],
    )
    return Changed(state, outcomes(judged_rows, "project_update", F.col("_id")))


__all__ = ["create_projects", "delete_projects", "get_projects", "order", "project_dto", "title_parts", "update_projects"]
