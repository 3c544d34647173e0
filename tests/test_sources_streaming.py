"""Files, snapshots and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from brindle.operators.users import register
from brindle.schemas import COLLECTIONS, COMMANDS
from brindle.sources import tables
from brindle.sources.statelog import StateLog
from brindle.streaming.jobs import authorize_stream, run_changes, run_stream


def test_requests_and_collections(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"request_id":"1","taskId":"t","updatedData":{"title":null,"x":"y"}}\nnot json\n')
    rows = tables.read_requests(spark, str(tmp_path / "r.json"), "task_update").cache()
    assert rows.where("_corrupt_record is not null").count() == 1
    assert rows.where("request_id = '1'").first().updatedData == {"title": None, "x": "y"}
    body = spark.createDataFrame([("k", '{"email":"a@b.co","extra":1}')], "k string, body string")
    parsed = tables.parse_requests(body, "register").first()
    assert parsed.email == "a@b.co" and parsed.password is None and set(COMMANDS["register"].names) <= set(parsed.asDict())
    users = spark.createDataFrame([("1", "n", "e", "p", None, ["x"])], COLLECTIONS["users"])
    tables.append_rows(users, str(tmp_path / "users"))
    tables.append_rows(users, str(tmp_path / "users"))
    assert tables.read_collection(spark, "users", str(tmp_path / "users")).count() == 2


def test_snapshots(spark, tmp_path):
    path, schema = str(tmp_path / "s"), COLLECTIONS["tokens"]
    assert tables.read_snapshot(spark, path, schema).count() == 0
    for v in (1, 2):
        tables.write_snapshot(spark.createDataFrame([(f"u{i}", "t", None) for i in range(v)], schema), path, v)
    (tmp_path / "s" / "v=3").mkdir()
    assert tables.versions(spark, path) == [1, 2]
    assert tables.read_snapshot(spark, path, schema).count() == 2 and tables.read_snapshot(spark, path, schema, 1).count() == 1


def test_responses(spark, tmp_path):
    df = spark.createDataFrame([("1", 200, None), ("2", 500, "no")], "request_id string, status int, message string")
    assert {r.request_id: r.body for r in tables.to_responses(df).collect()} == {"1": '{"status":200}', "2": '{"status":500,"message":"no"}'}
    tables.write_responses(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    schema = "request_id string, ts timestamp, email string, username string, password string"
    rows = [(f"{i:02d}", dt.datetime(2024, 1, 1, 0, i), f"e{i % 7}@x.io", "u", "secret1") for i in range(20)]
    for k in range(3):
        spark.createDataFrame(rows[k * 7 : k * 7 + 7], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def apply(state, cmd):
        done = register(state, cmd)
        return done.users, done.outcomes

    for _ in range(2):  # the second run finds nothing new
        run_stream(source, apply, str(tmp_path / "state"), COLLECTIONS["users"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert len(tables.versions(spark, str(tmp_path / "state"))) == 3
    state = tables.read_snapshot(spark, str(tmp_path / "state"), COLLECTIONS["users"])
    assert {r.email for r in state.collect()} == {f"e{i}@x.io" for i in range(7)} and state.count() == 7
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 20 and out.where("status = 200").count() == 7


def test_authorize_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    spark.createDataFrame([("1", at(10), "u"), ("2", at(179), "u"), ("3", at(180), "u"), ("4", at(10), "v")], "request_id string, ts timestamp, user_id string").write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([(at(0), "u"), (at(5), "u"), (at(-300), "v")], "ts timestamp, user_id string").where(F.col("ts") != at(5)).write.parquet(str(tmp_path / "l"))
    r = spark.readStream.schema("request_id string, ts timestamp, user_id string").parquet(str(tmp_path / "r"))
    login = spark.readStream.schema("ts timestamp, user_id string").parquet(str(tmp_path / "l"))
    q = authorize_stream(r, login, "1 day").writeStream.format("memory").queryName("passes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {x.request_id for x in spark.table("passes").collect()} == {"1", "2"}


def test_a_new_checkpoint_goes_on_from_the_state(spark, tmp_path):
    schema = "request_id string, ts timestamp, email string, username string, password string"

    def apply(state, cmd):
        done = register(state, cmd)
        return done.users, done.outcomes

    for k in range(2):
        rows = [(f"{k}{i}", dt.datetime(2024, 1, 1, k, i), f"e{k}{i}@x.io", "u", "secret1") for i in range(3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{k}"))
        run_stream(source, apply, str(tmp_path / "state"), COLLECTIONS["users"], str(tmp_path / "out"), str(tmp_path / f"check{k}"), keep=1).awaitTermination()
    assert tables.read_snapshot(spark, str(tmp_path / "state"), COLLECTIONS["users"]).count() == 6
    assert tables.versions(spark, str(tmp_path / "state")) == [2] and spark.read.parquet(str(tmp_path / "out")).count() == 6
    # a batch that was noted, but whose snapshot is not complete, is written anew under its version
    assert tables.version_of(spark, str(tmp_path / "state"), "s-7") == 3 == tables.version_of(spark, str(tmp_path / "state"), "s-7")


TOKENS = COLLECTIONS["tokens"]


def state_of(log, version=None):
    return {(r.userId, r.refreshToken) for r in log.read(version).collect()}


def test_state_log(spark, tmp_path):
    """Changes, deletes, versions read back, compaction and pruning; null keys and keys that aren't there."""
    log = StateLog(spark, str(tmp_path / "log"), TOKENS, "userId")
    rows = lambda *r: spark.createDataFrame([(u, t, None, d) for u, t, d in r], "userId string, refreshToken string, issued_at timestamp_ntz, _deleted boolean")
    assert state_of(log) == set() and not log.compact()
    log.write_changes(rows(("a", "0", None)).drop("_deleted"), 1)
    assert state_of(log) == {("a", "0")}
    log.write_base(rows(("a", "1", None), ("b", "1", None), ("c", "1", None), (None, "1", None)), 2)
    log.write_changes(rows(("a", "2", False), ("b", "1", True), ("z", "9", True)), 3)
    log.write_changes(rows(("a", "3", None), ("b", "4", False), ("d", "4", False), ("c", "1", True)), 4)
    (tmp_path / "log" / "d=5").mkdir()  # a batch that failed half-way
    expected = {2: {("a", "1"), ("b", "1"), ("c", "1"), (None, "1")}, 3: {("a", "2"), ("c", "1"), (None, "1")}, 4: {("a", "3"), ("b", "4"), ("d", "4"), (None, "1")}}
    assert {v: state_of(log, v) for v in expected} == expected and state_of(log) == expected[4] and log.versions() == [1, 2, 3, 4]
    assert not log.compact(share=1000) and log.compact(share=0) and log.bases() == [2, 4] and state_of(log) == expected[4] and state_of(log, 3) == expected[3]
    log.drop_old(2)  # version 3 needs base 2
    assert state_of(log, 3) == expected[3] and log.changes() == [3, 4]
    log.drop_old(1)
    assert log.bases() == [4] and log.changes() == [] and state_of(log) == expected[4]


def test_batches_write_what_they_change(spark, tmp_path, monkeypatch):
    schema = "request_id string, ts timestamp, email string, username string, password string"
    log = StateLog(spark, str(tmp_path / "state"), COLLECTIONS["users"])
    log.write_base(spark.range(20_000).selectExpr("cast(id as string) as _id", "concat('n', id) as username", "concat('old', id, '@x.io') as email", "sha2(cast(id as string), 256) as password", "cast(null as string) as token", "cast(array() as array<string>) as projects"), 0)
    rows = [(f"{i:02d}", dt.datetime(2024, 1, 1, 0, i), f"e{i % 7}@x.io" if i % 5 else "old3@x.io", "u", "secret1") for i in range(20)]
    for k in range(3):
        spark.createDataFrame(rows[k * 7 : k * 7 + 7], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    calls = []

    def apply(state, cmd):
        done = register(state, cmd)
        calls.append(1)
        if len(calls) == 2 and "failed" not in calls:  # the second batch fails once, after its number is noted
            calls.append("failed")
            raise ValueError("lost")
        return done.inserted, done.outcomes

    for _ in range(3):
        try:
            run_changes(source, apply, log, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        except Exception:
            assert "failed" in calls
    assert log.bases() == [0] and log.changes() == [1, 2, 3]
    assert sum(log.bytes_of(f"d={v}") for v in (1, 2, 3)) < log.bytes_of("v=0") / 20
    added = {r.email for r in log.read().where("email not like 'old%'").collect()}
    assert added == {f"e{i}@x.io" for i in range(7)} and log.read().count() == 20_007
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 20 and out.where("status = 200").count() == 7
    assert len(list((tmp_path / "state" / "_batches").iterdir())) == 1  # only the last batch's note stays
    assert log.compact(share=0) and log.read().count() == 20_007


def test_authorize_stream_with_refusals(spark, tmp_path):
    """Over several batches, the answers are those of the batch job for all that the watermark passes."""
    import random

    from brindle.operators.sessions import authorize_asof
    from brindle.streaming.jobs import authorize_stream_asof

    rng = random.Random(3)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    schema = "request_id string, ts timestamp, user_id string, login boolean"
    rows = []
    for part in range(5):  # each batch lies within the delay of the one before
        some = [(f"{part}-{i:03d}", at(part * 200 + rng.randint(-50, 250)), rng.choice(["u", "u", "v", None, f"w{i}"]), rng.random() < 0.15) for i in range(60)]
        rows += some
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    rows.append(("end", at(9000), "nobody", True))
    spark.createDataFrame(rows[-1:], schema).write.mode("append").parquet(str(tmp_path / "e"))
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    pick = lambda of, login: of.where(F.col("login") == login).select("request_id", "ts", "user_id")
    q = authorize_stream_asof(pick(e, False), pick(e, True), "400 minutes", shares=3).writeStream.format("memory").queryName("answers").trigger(availableNow=True).start()
    q.awaitTermination()
    whole = spark.createDataFrame(rows, schema)
    wanted = authorize_asof(pick(whole, False), pick(whole, True)).select("request_id", "ts", "user_id", "login_ts", "status", "message").collect()
    got = spark.table("answers").select("request_id", "ts", "user_id", "login_ts", "status", "message").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, wanted), key=repr)
    assert {r.status for r in got} == {200, 401}


def test_broken_bodies_have_outcomes(spark, tmp_path):
    from brindle.operators.outcomes import judge_bodies

    (tmp_path / "a.json").write_text('{"email": "a@x.io"}\n{"email": \n"x"\n')
    rows = judge_bodies(tables.read_requests(spark, str(tmp_path / "a.json"), "register", origin=True)).collect()
    assert sorted(((r.email, r._corrupt_record, r.status, r.message, r.cause_status) for r in rows), key=repr) == sorted([("a@x.io", None, None, None, None), (None, '{"email": ', 500, "Server error", 500), (None, '"x"', 500, "Server error", 500)], key=repr)
    assert all(r._file.endswith("a.json") and r._block == 0 for r in rows)
