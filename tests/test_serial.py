"""A batch equals its commands one after another, and in two halves."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import projects, sessions, tasks, users

T0 = dt.datetime(2024, 1, 1)
NOW = dt.datetime(2024, 3, 3)


def oid(n: int) -> str:
    return f"{n:024x}"


@pytest.mark.parametrize("seed", [1, 2])
def test_register(spark, seed):
    rng = random.Random(seed)
    cmd = [(f"{i:03d}", T0 + dt.timedelta(minutes=rng.randint(0, 20)), f"e{rng.randint(0, 9)}@x.io", rng.choice(["u", "u", None]), rng.choice(["secret", "bad"])) for i in range(60)]
    schema = "request_id string, ts timestamp_ntz, email string, username string, password string"
    known, status = {"e0@x.io"}, {}
    for r, _, email, name, password in sorted(cmd, key=lambda c: (c[1], c[0])):
        if len(password) < 6 or email in known:
            status[r] = 400
        elif not name:
            status[r] = 500
        else:
            known.add(email)
            status[r] = 200
    stored = spark.createDataFrame([(oid(1), "u", "e0@x.io", "pw", None, [])], "_id string, username string, email string, password string, token string, projects array<string>")
    done = users.register(stored, spark.createDataFrame(cmd, schema))
    assert {r.request_id: r.status for r in done.outcomes.collect()} == status
    cut = T0 + dt.timedelta(minutes=10)
    first = users.register(stored, spark.createDataFrame([c for c in cmd if c[1] < cut], schema))
    second = users.register(first.users, spark.createDataFrame([c for c in cmd if c[1] >= cut], schema))
    assert {r._id for r in second.users.collect()} == {r._id for r in done.users.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions(spark, seed):
    rng = random.Random(seed)
    state, events = {"u0": "s0"}, []
    issued = ["s0"]
    for i in range(80):
        if rng.random() < 0.5:
            events.append((f"{i:03d}", T0 + dt.timedelta(minutes=i), f"u{rng.randint(0, 4)}", "login", f"t{i}"))
            issued.append(f"t{i}")
        else:
            events.append((f"{i:03d}", T0 + dt.timedelta(minutes=i), None, "logout", rng.choice(issued)))
    for _, _, user, action, token in events:
        if action == "login":
            state[user] = token
        else:
            state = {u: t for u, t in state.items() if t != token}
    stored = spark.createDataFrame([("u0", "s0", T0)], "userId string, refreshToken string, issued_at timestamp_ntz")
    e = spark.createDataFrame(events, "request_id string, ts timestamp_ntz, user_id string, action string, refreshToken string")
    assert {r.userId: r.refreshToken for r in sessions.replay_sessions(stored, e).collect()} == state


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_project_updates(spark, seed):
    rng = random.Random(seed)
    titles = ["A", "B", "C", "D"]
    rows = [(oid(i), rng.choice(titles), f"d{i}", f"u{rng.randint(0, 2)}", T0, T0) for i in range(20)]
    cmd = [(f"{i:03d}", T0 + dt.timedelta(minutes=rng.randint(0, 9)), f"u{rng.randint(0, 3)}", rng.choice([*titles, ""]), rng.choice([*titles, "", None]), rng.choice(["n", "", None]), None) for i in range(25)]
    state, hits = {r[0]: list(r) for r in rows}, {}
    for r, _, user, title, new, text, _ in sorted(cmd, key=lambda c: (c[1], c[0])):
        hit = next((k for k in sorted(state) if state[k][3] == user and state[k][1] == title), None) if title else None
        hits[r] = 400 if not title else 500 if hit is None else 200
        if hit:
            s = state[hit]
            s[1], s[2], s[5] = new or s[1], text or s[2], NOW
    p = spark.createDataFrame(rows, "_id string, projectTitle string, description string, user string, createdAt timestamp_ntz, updatedAt timestamp_ntz")
    c = spark.createDataFrame(cmd, "request_id string, ts timestamp_ntz, user_id string, projectTitle string, newTitle string, newDescription string, newCreatedAt string")
    done = projects.update_projects(p, c, F.lit(NOW).cast("timestamp_ntz"))
    assert {r.request_id: r.status for r in done.outcomes.collect()} == hits
    assert sorted(map(tuple, done.state.select("_id", "projectTitle", "description", "user", "createdAt", "updatedAt").collect())) == sorted(map(tuple, state.values()))


def test_rename_chain_query(spark, sf):
    from brindle.plans.adapters import Workspace
    from brindle.plans.queries import AS_OF, project_rename_chain

    w = Workspace(spark, sf)
    state = {r._id: r.asDict() for r in w.projects().collect()}
    by_user = {}
    for k in sorted(state):
        by_user.setdefault(state[k]["user"], []).append(k)
    for c in sorted(w.cmd_rename_chain().collect(), key=lambda c: (c.ts, c.request_id)):
        hit = next((k for k in by_user.get(c.user_id, ()) if state[k]["projectTitle"] == c.projectTitle), None)
        if hit:
            state[hit] |= {"projectTitle": c.newTitle or state[hit]["projectTitle"], "description": c.newDescription or state[hit]["description"], "updatedAt": dt.datetime.fromisoformat(AS_OF)}
    got = {r._id: r.asDict() for r in project_rename_chain(spark, sf).collect()}
    assert got == state and any(s["updatedAt"] == dt.datetime.fromisoformat(AS_OF) for s in got.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_task_changes(spark, seed):
    rng = random.Random(seed)
    rows = [(oid(i), f"t{i}", "d", oid(99), T0, T0) for i in range(6)]
    patches, deletes = [], []
    for i in range(40):
        at, key = T0 + dt.timedelta(minutes=rng.randint(0, 9)), oid(rng.randint(0, 7))
        if rng.random() < 0.1:
            deletes.append((f"{i:03d}", at, key))
        else:
            patches.append((f"{i:03d}", at, key, rng.choice([{"title": f"n{i}"}, {"title": None}, {"description": f"x{i}", "junk": "1"}, {"deadline": "no date", "title": "lost"}, {"deadline": "2024-09-09 00:00:00"}])))
    state, status = {r[0]: list(r) for r in rows}, {}
    for c in sorted([*patches, *deletes], key=lambda c: (c[1], c[0])):
        if c[2] not in state:
            status[c[0]] = 400
        elif len(c) == 3:
            del state[c[2]]
            status[c[0]] = None
        elif c[3].get("deadline") == "no date":
            status[c[0]] = 500
        else:
            status[c[0]] = None
            for k, v in c[3].items():
                if k in ("title", "description", "deadline"):
                    state[c[2]][{"title": 1, "description": 2, "deadline": 4}[k]] = dt.datetime.fromisoformat(v) if k == "deadline" else v
    t = spark.createDataFrame(rows, "_id string, title string, description string, projectId string, deadline timestamp_ntz, createdAt timestamp_ntz")
    got, out, _ = tasks.change_tasks(t, spark.createDataFrame(patches, "request_id string, ts timestamp_ntz, taskId string, updatedData map<string,string>"), spark.createDataFrame(deletes, "request_id string, ts timestamp_ntz, taskId string"))
    assert {r.request_id: r.cause_status for r in out.collect()} == status
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, state.values()), key=repr)


def test_hot_task(spark):
    """One task has a third of all patches: its rows are cut into segments, and come out as one after another."""
    from brindle.functions import segments

    rng = random.Random(5)
    rows = [(oid(i), f"t{i}", "d", oid(99), T0, T0) for i in range(300)]
    patches = []
    for i in range(3000):
        key = oid(7) if i % 3 == 0 else oid(rng.randint(0, 320)) if i % 31 else None
        data = rng.choice([{"title": f"n{i}"}, {"title": None}, {"description": f"x{i}"}, {"junk": "1"}, {"junk": "2"}, {"deadline": "no date"}])
        patches.append((f"{i:05d}", T0 + dt.timedelta(minutes=rng.randint(0, 50)), key, data))
    deletes = [("d0", T0 + dt.timedelta(minutes=45), oid(7)), ("d1", T0 + dt.timedelta(minutes=48), oid(7))]
    state, status, shown = {r[0]: list(r) for r in rows}, {}, {}
    for c in sorted([*patches, *deletes], key=lambda c: (c[1], c[0])):
        if c[2] not in state:
            status[c[0]] = 400
        elif len(c) == 3:
            shown[c[0]] = tuple(state.pop(c[2]))
            status[c[0]] = None
        elif "deadline" in c[3]:
            status[c[0]] = 500
        else:
            status[c[0]] = None
            for k, v in c[3].items():
                if k in ("title", "description"):
                    state[c[2]][{"title": 1, "description": 2}[k]] = v
            shown[c[0]] = tuple(state[c[2]])
    t = spark.createDataFrame(rows, "_id string, title string, description string, projectId string, deadline timestamp_ntz, createdAt timestamp_ntz")
    p = spark.createDataFrame(patches, "request_id string, ts timestamp_ntz, taskId string, updatedData map<string,string>")
    got, out, after = tasks.change_tasks(t, p, spark.createDataFrame(deletes, "request_id string, ts timestamp_ntz, taskId string"))
    assert {r.request_id: r.cause_status for r in out.collect()} == status
    assert {r[0]: tuple(r[1:]) for r in after.collect()} == shown
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, state.values()), key=repr)
    at = ["ts", "request_id"]
    cut = segments.with_segments(p, "taskId", at, segments.cuts(p, "taskId", at)).where(F.col("taskId") == oid(7)).groupBy("seg").count().collect()
    assert len(cut) > 50 and max(r["count"] for r in cut) < 40


def test_segments_do_not_change_running_values(spark):
    from pyspark.sql import Window

    from brindle.functions import segments

    rows = spark.range(2000).select((F.col("id") % 2 * (F.col("id") % 7)).cast("string").alias("k"), (F.col("id") * 37 % 101).alias("t"), F.col("id").cast("string").alias("r"), F.when(F.hash("id") % 5 == 0, F.col("id")).alias("v"))
    upto = Window.partitionBy("k").orderBy("t", "r").rowsBetween(Window.unboundedPreceding, 0)
    plainly = {(r.r, r.v) for r in rows.withColumn("v", F.last("v", ignorenulls=True).over(upto)).collect()}
    for samples, every in ((1, 1), (7, 1), (64, 3), (segments.SAMPLES, 1), (segments.SAMPLES, 8)):
        found = segments.cuts(rows, "k", ["t", "r"], samples, every)
        got = segments.running_last(segments.with_segments(rows, "k", ["t", "r"], found), "k", ["t", "r"], ["v"], found)
        assert {(r.r, r.v) for r in got.collect()} == plainly
    none = rows.where("false")
    assert segments.cuts(none, "k", ["t", "r"]).count() == 0
