"""Findings of round 3."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from brindle.operators import tasks
from brindle.sources.statelog import StateLog

from test_layouts import T0, oid, some_tasks


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def _patches(spark, rows):
    return spark.createDataFrame(rows, "request_id string, ts timestamp_ntz, taskId string, updatedData map<string,string>")


def test_changes_of_tasks_move_commands_alone(spark, tmp_path):
    """commands of both kinds are shuffled once and meet a bucketed base where it lies; changes are bucketed too."""
    t = some_tasks(spark)
    log = StateLog(spark, str(tmp_path / "t"), t.schema, buckets=4)
    log.write_base(t, 0)
    patches = _patches(spark, [(f"{i:04d}", T0 + dt.timedelta(minutes=i), oid(i % 40), {"title": f"n{i}"}) for i in range(200)])
    deletes = spark.createDataFrame([("d", T0, oid(3)), ("e", T0 + dt.timedelta(days=9), oid(5))], "request_id string, ts timestamp_ntz, taskId string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        changed = tasks.task_changes(log.read(), patches, deletes)[0]
        assert _exchanges(changed) == 1
        log.write_changes(changed, 1)
        first = tasks.change_tasks(t, patches, deletes)[0]
        more = _patches(spark, [("z", T0 + dt.timedelta(days=10), oid(7), {"title": None, "description": "late"})])
        log.write_changes(tasks.task_changes(log.read(), more)[0], 2)
        assert _exchanges(log.read()) == 0
        want = sorted(map(repr, tasks.change_tasks(first, more)[0].collect()))
        assert sorted(map(repr, log.read().collect())) == want
        assert log.compact(0.0) and sorted(map(repr, log.read().collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bucketed_log_reads_as_a_plain_one(spark, tmp_path):
    """Null keys, repeated keys of a base, deletes and returns, over fewer and more versions than are read in place."""
    schema = spark.createDataFrame([], "_id string, x int").schema
    logs = [StateLog(spark, str(tmp_path / f"l{b}"), schema, buckets=b) for b in (None, 3)]
    base = [("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5), ("c", 6)]
    changes = [[("a", 7, False), (None, 8, False)], [("b", 9, True), (None, 10, False)], [("b", 11, False), ("n", 12, True)], [("c", 13, None)], [("a", 14, True)], [("d", 15, False)]]
    for v, rows in enumerate([None, *changes]):
        for log in logs:
            log.write_base(spark.createDataFrame(base, schema), 0) if rows is None else log.write_changes(spark.createDataFrame(rows, "_id string, x int, _deleted boolean"), v)
        plain, bucketed = (sorted(map(repr, log.read().collect())) for log in logs)
        assert plain == bucketed


def test_running_values_carry_no_order(spark):
    """what patches say goes through the windows without the ts and request_id of each field."""
    t = some_tasks(spark)
    out = tasks.patch_tasks(t, _patches(spark, [("1", T0, oid(1), {"title": "n"})])).outcomes
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project" in line and "AS _title" in line]
    assert windows and not any("struct(ts" in line for line in windows)
    assert out.select("title").collect()[0][0] == "n"
    assert out.where(F.col("cause_status").isNotNull()).count() == 0
