"""Registered queries: each applies one job to frames made from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comments, outcomes, projects, refs, rules, sessions, tasks, users
from ..sources.tables import read_collection, read_requests, shared_folder, to_responses
from .adapters import Workspace

AS_OF = "2024-02-10 00:00:00"


def _now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/brindle-{uuid.uuid4().hex[:12]}"


def _buckets(spark: SparkSession) -> int:
    """As many as a shuffle has partitions, so that a bucket is no larger than those; 16 at least."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _short(found: DataFrame, *more: str) -> DataFrame:
    return found.select("request_id", "cause_status", "status", "message", "id", *more)


def task_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tasks whose title matches, of any project."""
    t = Workspace(spark, sf_dir).tasks()
    return t.where(tasks.title_matches(F.col("title"), "RED|w.dg")).select("_id", "title", "projectId", "deadline")


def task_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return tasks.search_tasks_batch(w.long_tasks(), w.cmd_tasks_get())[0].select("request_id", "_id", F.when(F.length("title") > 1000, F.md5(F.col("title").cast("binary"))).otherwise(F.col("title")).alias("title"))


def task_search_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return _short(tasks.search_tasks_batch(w.long_tasks(), w.cmd_tasks_get())[1])


def tasks_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return tasks.tasks_by_project(w.tasks(), w.cmd_project_delete().select("request_id", F.col("id").alias("projectId"))).select("request_id", "_id", "projectId")


def project_dto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.project_dto(Workspace(spark, sf_dir).projects())


def validate_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rules.validate(Workspace(spark, sf_dir).cmd_register(), "register")
    return v.select("request_id", F.concat_ws(";", F.transform("violations", lambda x: F.concat(x["field"], F.lit("="), x["message"]))).alias("violations"), "rejected")


def validate_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Workspace(spark, sf_dir).cmd_task_create().select("*", "projectData.*")
    v = rules.validate(c, "task_create").withColumn("complete", rules.has_required("tasks"))
    return v.select("request_id", F.size("violations").cast("long").alias("n_violations"), "rejected", "complete")


def conform_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared fields, defaults and date casts of task bodies."""
    c = Workspace(spark, sf_dir).cmd_task_create().select(F.col("request_id").alias("_id"), "projectId", "projectData.*", F.lit("dropped").alias("status"))
    t = rules.apply_defaults(rules.conform(c, "tasks"), "tasks", _now())
    return t.select("_id", "title", "description", "projectId", F.col("deadline").cast("timestamp_ntz").alias("deadline"), F.col("createdAt").cast("timestamp_ntz").alias("createdAt"), "castable")


def register_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return _short(users.register(w.users_before(), w.cmd_register()).outcomes)


def register_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return users.register(w.users_before(), w.cmd_register()).users.select("_id", "username", "email", "password")


def register_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens that registrations issue, with their expiry."""
    w = Workspace(spark, sf_dir)
    t = sessions.issue_tokens(users.register(w.users_before(), w.cmd_register()).tokens)
    return t.select("userId", "refreshToken", "iat", "access_exp", "refresh_exp")


def login_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return _short(users.resolve_logins(w.users(), w.cmd_login()).outcomes)


def user_dto_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return users.user_dto(w.users(), w.projects()).select("id", "email", F.concat_ws(",", "projects").alias("projects"))


def update_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return users.update_email(w.users(), w.tokens(), w.cmd_update_email()).state.select("_id", "email")


def update_email_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return _short(users.update_email(w.users(), w.tokens(), w.cmd_update_email()).outcomes)


def authorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return sessions.authorize(sessions.with_bearer(w.bearer_requests()), w.issued()).select("request_id", "user_id", "status", "message")


def authorize_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return sessions.authorize_asof(w.requests(), w.logins()).select("request_id", "user_id", "login_ts", "status")


def token_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens stored for customers, overwritten by those of logins."""
    w = Workspace(spark, sf_dir)
    return sessions.save_tokens(w.stored_tokens(), w.token_saves())


def logout_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return _short(sessions.logout(w.tokens(), w.cmd_logout()).outcomes)


def logout_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return sessions.logout(w.tokens(), w.cmd_logout()).state


def find_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return sessions.find_tokens(w.tokens(), w.cmd_logout())


def refresh_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return sessions.refresh_valid(w.cmd_logout().drop("user_id"), w.tokens()).select("request_id", "refreshToken", "userId", "valid")


def session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return sessions.replay_sessions(w.stored_tokens(), w.session_events())


def session_replay_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, as of the middle of the events' time, without tokens older than 30 days."""
    w = Workspace(spark, sf_dir)
    return sessions.replay_sessions(w.stored_tokens(), w.session_events(), as_of=_now())


def project_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return projects.create_projects(w.projects(), w.cmd_project_create(), _now()).state


def project_create_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return _short(projects.create_projects(w.projects(), w.cmd_project_create(), _now()).outcomes)


def project_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return _short(projects.get_projects(w.projects(), w.cmd_project_delete()), "title", "description")


def project_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return projects.update_projects(w.projects(), w.cmd_project_update(), _now()).state


def project_update_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return _short(projects.update_projects(w.projects(), w.cmd_project_update(), _now()).outcomes)


def project_rename_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return projects.update_projects(w.projects(), w.cmd_rename_chain(), _now()).state


def project_rename_chain_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return _short(projects.update_projects(w.projects(), w.cmd_rename_chain(), _now()).outcomes)


def project_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return projects.delete_projects(w.projects(), w.cmd_project_delete()).state


def project_delete_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return _short(projects.delete_projects(w.projects(), w.cmd_project_delete()).outcomes)


def task_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    new = tasks.create_tasks(w.tasks(), w.cmd_task_create(), _now()).state
    return new.select("_id", "title", "description", "projectId", F.col("deadline").cast("timestamp_ntz").alias("deadline"), "createdAt")


def task_create_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return _short(tasks.create_tasks(w.tasks(), w.cmd_task_create(), _now()).outcomes)


def task_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return tasks.patch_tasks(w.tasks(), w.cmd_task_update()).state.select("_id", "title", "description", "projectId", "deadline", "createdAt")


def task_patch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return _short(tasks.patch_tasks(w.tasks(), w.cmd_task_update()).outcomes, "title", "description", "deadline")


def task_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return _short(tasks.delete_tasks(w.tasks(), w.cmd_task_delete()).outcomes, "title", "projectId")


def task_patch_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches and deletes of the same tasks in one batch."""
    w = Workspace(spark, sf_dir)
    return tasks.change_tasks(w.tasks(), w.cmd_task_update(), w.cmd_task_delete())[0].select("_id", "title", "description", "deadline")


def comment_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return comments.create_comments(w.comments(), w.cmd_comment_create(), _now()).state


def comment_create_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return _short(comments.create_comments(w.comments(), w.cmd_comment_create(), _now()).outcomes)


def comment_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return _short(comments.delete_comments(w.comments(), w.cmd_comment_delete()).outcomes)


def comment_delete_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return comments.delete_comments(w.comments(), w.cmd_comment_delete()).state


def error_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clients get for errors of known and of other kinds."""
    rows = Workspace(spark, sf_dir).errors()
    status, message = outcomes.error_outcome(F.col("status"), F.col("message"))
    return rows.select("request_id", status.alias("status"), message.alias("message"))


def _bodies(spark: SparkSession, sf_dir: str) -> str:
    """A folder with bodies of registrations as lines of JSON, some of them cut off."""
    folder = _new_folder(spark)
    body = F.to_json(F.struct("request_id", F.col("email"), F.col("password"), F.col("username"), F.lit("dropped").alias("other")))
    cut = F.col("request_id").cast("long") % 11 == 0
    Workspace(spark, sf_dir).cmd_register().select(F.when(cut, F.substring(body, 1, 20)).otherwise(body).alias("value")).write.text(f"{folder}/bodies")
    return f"{folder}/bodies"


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of registrations, written as lines of JSON, some of them cut off, and parsed again under the declared schema."""
    rows = read_requests(spark, _bodies(spark, sf_dir), "register")
    return rows.select("request_id", "email", "username", "password", F.col("_corrupt_record").alias("broken"))


def request_body_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the senders of those bodies get before any action; that of commands is null until they are applied."""
    rows = outcomes.judge_bodies(read_requests(spark, _bodies(spark, sf_dir), "register", origin=True))
    return rows.select("request_id", F.col("_corrupt_record").alias("broken"), "cause_status", "status", "message", (F.col("_file").isNotNull() & F.col("_block").isNotNull()).alias("located"))


def read_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection at rest, read under its declared schema."""
    folder = _new_folder(spark)
    Workspace(spark, sf_dir).users().drop("token").write.parquet(f"{folder}/users")
    return read_collection(spark, "users", f"{folder}/users").select("_id", "username", "email", "password", "token", F.size("projects").cast("long").alias("n_projects"))


def resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    return refs.resolve_refs(w.comments(), w.users(), w.tasks(), w.projects()).select("_id", "userId", "username", "task_title", "project_title")


def dead_project_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of users to projects that are gone after deletes."""
    w = Workspace(spark, sf_dir)
    left = projects.delete_projects(w.projects(), w.cmd_project_delete()).state
    return refs.dead_refs(w.members(), "projects", left).select("_id", F.col("pos").cast("long").alias("pos"), "ref")


def clean_project_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users without those references; nulls stay."""
    w = Workspace(spark, sf_dir)
    left = projects.delete_projects(w.projects(), w.cmd_project_delete()).state
    kept = refs.drop_dead_refs(w.members(), "projects", left)
    return kept.select("_id", "email", F.concat_ws(",", F.transform("projects", lambda x: F.coalesce(x, F.lit("-")))).alias("projects"))


def populate_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users with the titles of the projects that are left, in order."""
    w = Workspace(spark, sf_dir)
    left = projects.delete_projects(w.projects(), w.cmd_project_delete()).state
    return refs.populate(w.members(), "projects", left, "projectTitle").select("_id", F.concat_ws(",", F.transform("projects", lambda p: p["projectTitle"])).alias("titles"))


def orphan_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Workspace(spark, sf_dir)
    left = projects.delete_projects(w.projects(), w.cmd_project_delete()).state
    return refs.orphans(w.tasks(), left, "projectId").select("_id", "projectId")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies of the answers to project lookups."""
    w = Workspace(spark, sf_dir)
    r = projects.get_projects(w.projects(), w.cmd_project_delete())
    return to_responses(r.select("request_id", "status", "message", F.col("title").alias("projectTitle")))


def authorize_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The authorised requests as the stream job finds them, from the events read as a stream."""
    from ..functions.scalars import ACCESS_MINUTES
    from ..streaming.jobs import authorize_stream as job

    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(_stream_folder(sf_dir))
    at = F.col("ts").cast("timestamp")
    requests = events.where(F.col("event_type").isin("view", "purchase")).select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("request_id"), at.alias("ts"), "user_id")
    logins = events.where("event_type = 'click'").select("user_id", at.alias("ts"))
    folder = _new_folder(spark)
    passes = job(requests, logins, delay=f"{ACCESS_MINUTES} minutes")
    passes.writeStream.format("parquet").option("path", f"{folder}/passes").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(passes.schema).parquet(f"{folder}/passes").select("request_id", F.lpad(F.col("user_id").cast("string"), 24, "0").alias("user_id"))


def authorize_stream_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all requests that the watermark passes, refusals included, from the events read as a stream."""
    from ..functions.scalars import ACCESS_MINUTES
    from ..streaming.jobs import authorize_stream_asof as job

    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(_stream_folder(sf_dir))
    row = lambda *kinds: events.where(F.col("event_type").isin(*kinds)).select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.lpad(F.col("user_id").cast("string"), 24, "0").alias("user_id"))
    folder = _new_folder(spark)
    found = job(row("view", "purchase"), row("click"), delay=f"{ACCESS_MINUTES} minutes")
    found.writeStream.format("parquet").option("path", f"{folder}/answers").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    zone = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return spark.read.schema(found.schema).parquet(f"{folder}/answers").select("request_id", "user_id", zone("login_ts"), "status")


def register_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users after the registrations have come in as a stream, through the job of register_users; each batch writes the users that it adds."""
    from ..sources.statelog import StateLog
    from ..streaming.jobs import run_changes

    w = Workspace(spark, sf_dir)
    before = w.users_before()
    folder = _new_folder(spark)
    log = StateLog(spark, f"{folder}/state", before.schema)
    log.write_base(before, 0)
    events = spark.readStream.schema(w.table("events").schema).parquet(_stream_folder(sf_dir))

    def apply(state: DataFrame, cmd: DataFrame) -> tuple[DataFrame, DataFrame]:
        done = users.register(state, cmd)
        return done.inserted, done.outcomes

    run_changes(Workspace.registrations(events), apply, log, f"{folder}/outcomes", f"{folder}/checkpoint").awaitTermination()
    return log.read().select("_id", "username", "email", "password")


def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks after patches and deletes that were written as changes of two batches, first patches and the rest, and compacted."""
    from ..sources.statelog import StateLog

    w = Workspace(spark, sf_dir)
    before = w.tasks()
    log = StateLog(spark, f"{_new_folder(spark)}/tasks", before.schema, buckets=_buckets(spark))
    log.write_base(before, 0)
    first = F.col("request_id").endswith("-1")
    patches, deletes = w.cmd_task_update(), w.cmd_task_delete()
    log.write_changes(tasks.task_changes(log.read(), patches.where(first))[0], 1)
    log.write_changes(tasks.task_changes(log.read(), patches.where(~first), deletes)[0], 2)
    log.compact()
    return log.read().select("_id", "title", "description", "deadline")


def task_search_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches over tasks that are laid out by their project: buckets without a command are not read."""
    from ..sources.layout import KeyedFolders

    w = Workspace(spark, sf_dir)
    before, cmd = w.long_tasks(), w.cmd_tasks_get()
    laid = KeyedFolders(spark, f"{_new_folder(spark)}/tasks", before.schema, "projectId", 64)
    laid.write(before)
    found = tasks.search_tasks_batch(laid.near(cmd), cmd)[0]
    return found.select("request_id", "_id", F.when(F.length("title") > 1000, F.md5(F.col("title").cast("binary"))).otherwise(F.col("title")).alias("title"))


def register_known_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations in two batches; which e-mails users have is told by Bloom filters, to which the first batch adds."""
    from ..sources.known import KnownValues

    w = Workspace(spark, sf_dir)
    before, cmd = w.users_before(), w.cmd_register()
    known = KnownValues(spark, f"{_new_folder(spark)}/emails", "email", 64)
    known.add(before, 1)
    half = cmd.agg(F.percentile_approx(F.col("ts").cast("timestamp"), 0.5).cast("timestamp_ntz").alias("half")).scalar()
    early = F.coalesce(F.col("ts") < half, F.lit(True))
    first = users.register(before, cmd.where(early), known=known.known(cmd.where(early)))
    known.add(first.inserted, 2)
    second = users.register(before, cmd.where(~early), known=known.known(cmd.where(~early)))
    return _short(first.outcomes.union(second.outcomes))


def _chained(spark: SparkSession, sf_dir: str):
    w = Workspace(spark, sf_dir)
    cmd = w.cmd_rename_chain()
    return projects.update_projects(w.projects(), cmd, _now(), projects.title_parts(cmd, f"{_new_folder(spark)}/titles"))


def project_rename_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job of project_rename_chain, by parts of each user's titles."""
    return _chained(spark, sf_dir).state


def project_rename_parts_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(_chained(spark, sf_dir).outcomes)


def task_patch_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job of task_patch_delete over tasks in a bucketed base: commands come to the tasks, and the changes to the base."""
    from ..sources.statelog import StateLog

    w = Workspace(spark, sf_dir)
    before = w.tasks()
    log = StateLog(spark, f"{_new_folder(spark)}/tasks", before.schema, buckets=_buckets(spark))
    log.write_base(before, 0)
    log.write_changes(tasks.task_changes(log.read(), w.cmd_task_update(), w.cmd_task_delete())[0], 1)
    return log.read().select("_id", "title", "description", "deadline")


def _stream_folder(sf_dir: str) -> str:
    """A stream reads folders; a glob takes a table that is a single file, too."""
    return f"{sf_dir}/events.parque[t]"


QUERIES = {
    f.__name__: f
    for f in (
        task_search, task_search_batch, task_search_outcomes, tasks_by_project, project_dto, validate_register, validate_tasks, conform_tasks,
        register_outcomes, register_users, register_tokens, login_outcomes, user_dto_projects, update_email, update_email_outcomes,
        authorize, authorize_asof, token_upsert, logout_outcomes, logout_tokens, find_tokens, refresh_valid, session_replay, session_replay_expired,
        project_create, project_create_outcomes, project_get, project_update, project_update_outcomes, project_rename_chain, project_rename_chain_outcomes, project_delete, project_delete_outcomes,
        task_create, task_create_outcomes, task_patch, task_patch_outcomes, task_delete, task_patch_delete,
        comment_create, comment_create_outcomes, comment_delete, comment_delete_state, resolve_refs, orphan_tasks, dead_project_refs, clean_project_refs, populate_projects,
        responses, error_outcomes, request_bodies, request_body_outcomes, read_users, authorize_stream, authorize_stream_asof, register_stream, task_log,
        task_search_pruned, register_known_outcomes, project_rename_parts, project_rename_parts_outcomes, task_patch_bucketed,
    )
}
