"""Layouts by key, known values, components, and the jobs over them."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brindle.functions.components import connected
from brindle.operators import projects, tasks, users
from brindle.schemas import COLLECTIONS
from brindle.sources.known import KnownValues
from brindle.sources.layout import BUCKET, KeyedFolders, bucket_of, read_bucketed, write_bucketed
from brindle.sources.statelog import StateLog

T0 = dt.datetime(2024, 1, 1)
NOW = dt.datetime(2024, 3, 3)


def oid(n: int) -> str:
    return f"{n:024x}"


def some_tasks(spark, n=400):
    """A third of them belong to one project, a few to none."""
    rows = [(oid(i), f"t{i}", "d", None if i % 97 == 0 else oid(9) if i % 3 == 0 else oid(1000 + i % 40), T0, T0) for i in range(n)]
    return spark.createDataFrame(rows, COLLECTIONS["tasks"])


def spoil(folder: Path, keep: set[int]) -> int:
    """Make all files but those of some buckets unreadable."""
    spoilt = 0
    for f in folder.glob(f"{BUCKET}=*/*.parquet"):
        if int(f.parent.name.split("=")[1]) not in keep:
            f.write_bytes(b"no parquet")
            spoilt += 1
    for crc in folder.glob(f"{BUCKET}=*/.*.crc"):
        crc.unlink()
    return spoilt


def test_folders_hold_all_rows_and_reads_open_their_buckets_alone(spark, tmp_path):
    t = some_tasks(spark)
    laid = KeyedFolders(spark, str(tmp_path / "t"), t.schema, "projectId", 16)
    laid.write(t)
    assert {r._id for r in laid.all().collect()} == {r._id for r in t.collect()}
    asked = spark.createDataFrame([("r1", oid(9)), ("r2", oid(1001)), ("r3", oid(1001)), ("r4", "none"), ("r5", None)], "request_id string, projectId string")
    buckets = {r[0] for r in asked.select(bucket_of(F.col("projectId"), 16)).collect()}
    near, one = laid.near(asked), laid.of(oid(9))
    assert spoil(tmp_path / "t", buckets) > 0
    want = {(r.request_id, x._id) for r in asked.collect() for x in t.collect() if r.projectId and x.projectId == r.projectId}
    assert {(r.request_id, r._id) for r in tasks.tasks_by_project(near, asked).collect()} == want
    assert {r._id for r in tasks.search_tasks(one, oid(9), "t3", "title").collect()} == {r._id for r in t.where(F.col("projectId") == oid(9)).where("title like 't3%'").collect()}
    assert laid.of("none' or '1'='1").where(F.lit(False)).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        laid.all().collect()


def test_folders_of_nothing(spark, tmp_path):
    t = some_tasks(spark).where("false")
    laid = KeyedFolders(spark, str(tmp_path / "t"), t.schema, "projectId", 4)
    laid.write(t)
    assert laid.all().count() == 0 and laid.of("x").count() == 0 and laid.near(t.select("projectId")).count() == 0


def test_bucketed_state_is_not_shuffled(spark, tmp_path):
    t = some_tasks(spark)
    log = StateLog(spark, str(tmp_path / "it's"), t.schema, buckets=8)
    log.write_base(t, 0)
    patches = spark.createDataFrame([(f"{i:04d}", T0 + dt.timedelta(minutes=i), oid(7 if i % 3 == 0 else i), {"title": f"n{i}"}) for i in range(300)], "request_id string, ts timestamp_ntz, taskId string, updatedData map<string,string>")
    deletes = spark.createDataFrame([("d", T0, oid(3))], "request_id string, ts timestamp_ntz, taskId string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        want = {tuple(r) for r in tasks.change_tasks(t, patches, deletes)[0].collect()}
        touched = log.read().join(patches.select(F.col("taskId").alias("_id")).distinct(), "_id", "left_semi")
        log.write_changes(tasks.task_changes(log.read(), patches, deletes)[0], 1)
        for df in (touched, log.read()):
            lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
            scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
            depth = lines[scan].index("FileScan")
            above, seen = [], depth
            for line in reversed(lines[:scan]):
                at = len(line) - len(line.lstrip(" :+-"))
                if at < seen:
                    seen = at
                    above.append(line)
            assert not any("Exchange" in line for line in above), "\n".join(lines)
        assert {tuple(r) for r in log.read().collect()} == want
        assert log.compact(0.0) and log.bases() == [0, 1]
        assert {tuple(r) for r in log.read().collect()} == want
        log.write_base(t, 1)  # again, over what is there
        assert log.read().count() == t.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_bucketed_table_is_found_by_its_path(spark, tmp_path):
    t = some_tasks(spark)
    path = str(tmp_path / "b")
    write_bucketed(t, path, "_id", 4)
    for name in [x.name for x in spark.catalog.listTables() if x.name.startswith("brindle_")]:
        spark.sql(f"drop table {name}")  # as a new session begins
    assert {tuple(r) for r in read_bucketed(spark, path, t.schema, "_id", 4).collect()} == {tuple(r) for r in t.collect()}


def test_known_values(spark, tmp_path):
    stored = spark.range(20_000).select(F.concat(F.lit("a"), "id", F.lit("@x.io")).alias("email"), F.col("id").alias("junk"))
    stored = stored.union(stored.limit(5)).union(spark.sql("select cast(null as string), 1L"))
    known = KnownValues(spark, str(tmp_path / "k"), "email", 16)
    asked = spark.range(10_000, 60_000).select(F.concat(F.lit("a"), "id", F.lit("@x.io")).alias("email"))
    asked = asked.union(spark.sql("select cast(null as string)")).union(asked.limit(100))
    assert known.known(asked).count() == 0 and known.versions() == {}
    known.add(stored, 1)
    got = known.known(asked)
    assert got.count() == 10_000 and got.where("cast(substring(email, 2, length(email) - 6) as int) < 20000").count() == 10_000
    passing = known.passing(asked).count()
    assert 10_000 <= passing < 10_000 + 0.01 * 40_000
    known.add(asked.where("email like 'a3%'"), 2)
    known.add(asked.where("email like 'a3%'"), 2)  # again
    want = {r.email for r in asked.collect() if r.email and (int(r.email[1:-5]) < 20_000 or r.email.startswith("a3"))}
    assert {r.email for r in known.known(asked).collect()} == want
    known.add(asked.where("false"), 3)
    assert {r.email for r in known.known(asked).collect()} == want
    known.compact(stored)
    assert list(known.versions()) == [4] and known.known(asked).count() == 10_000


def test_known_values_read_buckets_of_what_passes(spark, tmp_path):
    stored = spark.range(2000).select(F.concat(F.lit("a"), "id").alias("email"))
    known = KnownValues(spark, str(tmp_path / "k"), "email", 64)
    known.add(stored, 1)
    asked = spark.createDataFrame([("a7",), ("a7",), ("b7",)], "email string")
    got = known.known(asked)
    buckets = {r[0] for r in known.passing(asked).select(bucket_of(F.col("email"), 64)).collect()}
    assert spoil(tmp_path / "k" / "values-1", buckets) >= 61
    assert [r.email for r in got.collect()] == ["a7"]


def test_register_with_known(spark, tmp_path):
    """One e-mail has a third of all commands."""
    rng = random.Random(3)
    stored = spark.createDataFrame([(oid(i), "u", f"e{i}@x.io", "pw", None, []) for i in range(0, 40, 2)], COLLECTIONS["users"])
    cmd = [(f"{i:04d}", T0 + dt.timedelta(minutes=rng.randint(0, 90)), "hot@x.io" if i % 3 == 0 else f"e{rng.randint(0, 60)}@x.io" if i % 17 else None, rng.choice(["u", "u", None]), rng.choice(["secret", "bad"])) for i in range(600)]
    cmd = spark.createDataFrame(cmd, "request_id string, ts timestamp_ntz, email string, username string, password string")
    known = KnownValues(spark, str(tmp_path / "k"), "email", 8)
    known.add(stored, 1)
    plain, quick = users.register(stored, cmd), users.register(stored, cmd, known=known.known(cmd))
    for a, b in zip(plain, quick, strict=True):
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, tmp_path, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(150)] + [(7, 7), (-(2**63), 2**63 - 1)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = connected(spark.createDataFrame([*edges, (None, 1)], "a long, b long"), str(tmp_path / "c")).collect()
    assert len(got) == len(root) and {r.node: r.component for r in got} == {x: find(x) for x in root}
    assert connected(spark.createDataFrame([], "a long, b long"), str(tmp_path / "n")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_updates_by_parts(spark, tmp_path, seed):
    """One user has a third of all commands, over many titles: as one after another, and in many parts."""
    rng = random.Random(seed)
    rows = [(oid(i), f"T{rng.randint(0, 60)}", f"d{i}", "hot" if i % 3 else f"u{rng.randint(0, 4)}", T0, T0) for i in range(300)]

    def command(i):
        t = rng.randint(0, 60)
        title = rng.choice([f"T{t}", f"T{t}", f"T{t}", "", None])
        return (f"{i:04d}", T0 + dt.timedelta(minutes=rng.randint(0, 30)), "hot" if i % 3 == 0 else rng.choice([*(f"u{k}" for k in range(6)), None]), title, rng.choice([f"T{t // 4 * 4 + rng.randint(0, 3)}", f"N{i}", "", None]), rng.choice(["n", "", None]), rng.choice([None, None, "no date", "2024-02-02 00:00:00"]))

    cmd = [command(i) for i in range(400)]
    state, hits = {r[0]: list(r) for r in rows}, {}
    for r, _, user, title, new, text, at in sorted(cmd, key=lambda c: (c[1], c[0])):
        hit = next((k for k in sorted(state) if user and state[k][3] == user and state[k][1] == title), None) if title else None
        hits[r] = 400 if not title or hit is None else 500 if at == "no date" else None
        if hit and at != "no date":
            s = state[hit]
            s[1], s[2], s[5] = new or s[1], text or s[2], NOW
            s[4] = dt.datetime.fromisoformat(at) if at else s[4]
    p = spark.createDataFrame(rows, "_id string, projectTitle string, description string, user string, createdAt timestamp_ntz, updatedAt timestamp_ntz")
    c = spark.createDataFrame(cmd, "request_id string, ts timestamp_ntz, user_id string, projectTitle string, newTitle string, newDescription string, newCreatedAt string")
    parts = projects.title_parts(c, str(tmp_path / "parts"))
    done = projects.update_projects(p, c, F.lit(NOW).cast("timestamp_ntz"), parts)
    assert {r.request_id: r.cause_status for r in done.outcomes.collect()} == hits
    assert sorted(map(tuple, done.state.select("_id", "projectTitle", "description", "user", "createdAt", "updatedAt").collect())) == sorted(map(tuple, state.values()))
    assert parts.where("user_id = 'hot'").select("part").distinct().count() > 10
