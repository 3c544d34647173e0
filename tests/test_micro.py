"""Hand-made rows for each branch of the jobs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brindle.functions.scalars import bearer_token, or_else
from brindle.operators import comments, projects, refs, rules, sessions, tasks, users
from brindle.operators.outcomes import FORBIDDEN, INTERNAL, NO_PROJECT, OTHER, UNAUTHORIZED

T0 = dt.datetime(2024, 1, 1, 10)


def at(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def oid(n: int) -> str:
    return f"{n:024x}"


USERS = "_id string, username string, email string, password string, token string, projects array<string>"
PROJECTS = "_id string, projectTitle string, description string, user string, createdAt timestamp_ntz, updatedAt timestamp_ntz"
TASKS = "_id string, title string, description string, projectId string, deadline timestamp_ntz, createdAt timestamp_ntz"
COMMENTS = "_id string, text string, createdAt timestamp_ntz, projectId string, taskId string, userId string"
TOKENS = "userId string, refreshToken string, issued_at timestamp_ntz"


def by_request(df, *columns):
    return {r.request_id: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_register_rules_at_their_boundaries(spark):
    rows = [(f"p{n}", "a@b.co", "x" * n) for n in (5, 6, 24, 25)] + [("bad", "bad", "x" * 8), ("null", None, "x" * 8), ("nopw", "a@b.co", None)]
    v = rules.validate(spark.createDataFrame(rows, "request_id string, email string, password string"), "register")
    assert {r.request_id for r in v.collect() if r.rejected is None} == {"p6", "p24"}
    both = rules.validate(spark.createDataFrame([("x", "bad", "1")], "request_id string, email string, password string"), "register", enforce=False).first()
    assert [x.field for x in both.violations] == ["email", "password"] and both.rejected is None


def test_id_formats(spark):
    df = spark.createDataFrame([("a", oid(7)), ("b", "123e4567-e89b-12d3-a456-426614174000"), ("c", None)], "request_id string, id string")
    ok = lambda form: {r.request_id for r in rules.validate(df, "project_delete", id_format=form).where("rejected is null").collect()}
    assert ok("object_id") == {"a"} and ok("uuid") == {"b"}


def test_register_is_case_sensitive_and_first_valid_wins(spark):
    stored = spark.createDataFrame([(oid(1), "A", "A@x.io", "pw", None, [])], USERS)
    cmd = spark.createDataFrame(
        [("1", at(0), "a@x.io", "u", "secret1"), ("2", at(1), "n@x.io", "u", "bad"), ("3", at(2), "n@x.io", "u", "secret1"), ("4", at(3), "n@x.io", "u", "secret1"), ("5", at(4), "A@x.io", "u", "secret1"), ("6", at(0), "m@x.io", None, "secret1"), ("7", at(1), "m@x.io", "u", "secret1")],
        "request_id string, ts timestamp_ntz, email string, username string, password string",
    )
    done = users.register(stored, cmd)
    assert by_request(done.outcomes, "cause_status", "status") == {"1": (None, 200), "2": (400, 400), "3": (None, 200), "4": (400, 400), "5": (400, 400), "6": (500, 500), "7": (None, 200)}
    assert by_request(done.outcomes, "message")["6"] == "Registration failed"
    assert done.users.count() == 4 and done.tokens.count() == 3
    assert "password" not in done.outcomes.columns


def test_login_causes(spark):
    stored = spark.createDataFrame([(oid(1), "A", "a@x.io", "pw", None, []), (oid(2), "B", "b@x.io", None, None, [])], USERS)
    cmd = spark.createDataFrame([("1", at(0), "no@x.io", True), ("2", at(0), "b@x.io", True), ("3", at(0), "a@x.io", False), ("4", at(0), "a@x.io", True)], "request_id string, ts timestamp_ntz, email string, password_ok boolean")
    out = users.resolve_logins(stored, cmd)
    assert by_request(out.outcomes, "cause_status", "status", "id") == {"1": (400, 500, None), "2": (400, 500, None), "3": (400, 500, None), "4": (None, 200, oid(1))}
    assert [r.userId for r in out.tokens.collect()] == [oid(1)]


def test_save_tokens_keeps_one_a_user(spark):
    stored = spark.createDataFrame([("u1", "old", at(0)), ("u3", "keep", at(0))], TOKENS)
    cmd = spark.createDataFrame([("1", at(1), "u1", "a"), ("2", at(2), "u1", "b"), ("3", at(1), "u2", "c")], "request_id string, ts timestamp_ntz, userId string, refreshToken string")
    assert {(r.userId, r.refreshToken) for r in sessions.save_tokens(stored, cmd).collect()} == {("u1", "b"), ("u2", "c"), ("u3", "keep")}


def test_replay_sessions(spark):
    none = spark.createDataFrame([("s", "stored", at(-9)), ("old", "aged", at(-60 * 24 * 31))], TOKENS)
    e = spark.createDataFrame(
        [("1", at(1), "u", "login", "t1"), ("2", at(2), "u", "login", "t2"), ("3", at(3), "u", "logout", "t1"), ("4", at(1), "v", "login", "x"), ("5", at(2), "v", "logout", "x"), ("6", at(3), "v", "login", "y"), ("7", at(1), "s", "logout", "stored")],
        "request_id string, ts timestamp_ntz, user_id string, action string, refreshToken string",
    )
    assert {(r.userId, r.refreshToken) for r in sessions.replay_sessions(none, e).collect()} == {("u", "t2"), ("v", "y"), ("old", "aged")}
    young = sessions.replay_sessions(none, e, as_of=F.lit(at(10)).cast("timestamp_ntz"))
    assert {r.userId for r in young.collect()} == {"u", "v"}


def test_logout_outcomes(spark):
    stored = spark.createDataFrame([("u", "t", at(0)), ("w", "k", at(0))], TOKENS)
    cmd = spark.createDataFrame([("1", at(1), "t"), ("2", at(2), "t"), ("3", at(1), None), ("4", at(1), "no")], "request_id string, ts timestamp_ntz, refreshToken string")
    done = sessions.logout(stored, cmd)
    assert by_request(done.outcomes, "cause_status", "message") == {"1": (None, "Logout successful"), "2": (400, "Logout failed"), "3": (400, "Logout failed"), "4": (400, "Logout failed")}
    assert [r.userId for r in done.state.collect()] == ["w"]


def test_authorize_boundaries_and_headers(spark):
    issued = spark.createDataFrame([("tok", "u", at(0))], "access_token string, user_id string, iat timestamp_ntz")
    rows = [("1", at(0), "Bearer tok"), ("2", at(180 - 1 / 60), "Bearer tok"), ("3", at(180), "Bearer tok"), ("4", at(1), "Bearer no"), ("5", at(1), "Bearer"), ("6", at(1), "Bearer "), ("7", at(1), None)]
    out = sessions.authorize(sessions.with_bearer(spark.createDataFrame(rows, "request_id string, ts timestamp_ntz, authorization string")), issued)
    assert by_request(out, "status") == {"1": 200, "2": 200, "3": 401, "4": 401, "5": 401, "6": 401, "7": 401}
    assert spark.range(1).select(bearer_token(F.lit("Bearer x y"))).first()[0] == "x"


def test_authorize_asof(spark):
    logins = spark.createDataFrame([("l1", at(0), "u"), ("l2", at(100), "u"), ("l3", at(400), "v")], "request_id string, ts timestamp_ntz, user_id string")
    rows = [("1", at(-1), "u"), ("2", at(99), "u"), ("3", at(279), "u"), ("4", at(280), "u"), ("5", at(399), "v"), ("6", at(400), "v"), ("m", at(400), "v"), ("8", at(1), "w")]
    out = sessions.authorize_asof(spark.createDataFrame(rows, "request_id string, ts timestamp_ntz, user_id string"), logins)
    assert by_request(out, "status") == {"1": 401, "2": 200, "3": 200, "4": 401, "5": 401, "6": 401, "m": 200, "8": 401}
    assert by_request(out, "login_ts")["3"] == at(100)


def test_refresh_valid(spark):
    issued = spark.createDataFrame([("u", "t", at(0))], TOKENS)
    cmd = spark.createDataFrame([("1", at(60 * 24 * 30 - 1), "t"), ("2", at(60 * 24 * 30), "t"), ("3", at(1), "x")], "request_id string, ts timestamp_ntz, refreshToken string")
    assert by_request(sessions.refresh_valid(cmd, issued), "valid") == {"1": True, "2": False, "3": False}
    assert sessions.find_tokens(issued, cmd).count() == 1


def _projects(spark):
    return spark.createDataFrame([(oid(1), "A", "d1", "u", T0, T0), (oid(2), "A", "d2", "u", T0, T0), (oid(3), "Z", "d3", "u", T0, T0), (oid(4), "A", "d4", "v", T0, T0)], PROJECTS)


UPDATE = "request_id string, ts timestamp_ntz, user_id string, projectTitle string, newTitle string, newDescription string, newCreatedAt string"


def now():
    return F.lit(dt.datetime(2024, 2, 2)).cast("timestamp_ntz")


@pytest.mark.parametrize(
    ("cmd", "titles"),
    [
        ([("1", at(0), "u", "A", "B", None, None)], ["B", "A", "Z", "A"]),
        ([("1", at(0), "u", "A", "", None, None)], ["A", "A", "Z", "A"]),
        ([("1", at(0), "u", "Z", "B", None, None), ("2", at(1), "u", "B", "C", None, None)], ["A", "A", "C", "A"]),
        ([("1", at(0), "u", "A", "X", None, None), ("2", at(1), "u", "A", "Y", None, None)], ["X", "Y", "Z", "A"]),
    ],
)
def test_update_projects(spark, cmd, titles):
    done = projects.update_projects(_projects(spark), spark.createDataFrame(cmd, UPDATE), now())
    state = {r._id: r for r in done.state.collect()}
    assert [state[oid(i)].projectTitle for i in (1, 2, 3, 4)] == titles
    assert all(status == 200 for status in by_request(done.outcomes, "status").values())
    assert sum(r.updatedAt == dt.datetime(2024, 2, 2) for r in state.values()) == (2 if len(cmd) == 2 and titles[1] == "Y" else 1)


def test_update_projects_failures(spark):
    cmd = [("1", at(0), "u", "", "B", None, None), ("2", at(0), "u", "none", "B", None, None), ("3", at(0), "u", "Z", "B", None, "no date"), ("4", at(0), "v", "A", None, "new", "2020-01-01 00:00:00")]
    done = projects.update_projects(_projects(spark), spark.createDataFrame(cmd, UPDATE), now())
    assert by_request(done.outcomes, "cause_status", "status", "message") == {"1": (400, 400, "Project title is required"), "2": (400, 500, "Error updating project: Project not found"), "3": (500, 500, "Error updating project: Invalid date"), "4": (None, 200, None)}
    state = {r._id: r for r in done.state.collect()}
    assert state[oid(3)].projectTitle == "Z" and state[oid(4)].description == "new" and state[oid(4)].createdAt == dt.datetime(2020, 1, 1)


def test_or_else(spark):
    row = spark.createDataFrame([("", "o"), (None, "o"), ("n", "o")], "n string, o string").select(or_else(F.col("n"), F.col("o")).alias("x")).collect()
    assert [r.x for r in row] == ["o", "o", "n"]


def test_deletes(spark):
    p = _projects(spark)
    cmd = spark.createDataFrame([("1", at(0), oid(1)), ("2", at(1), oid(1)), ("3", at(0), oid(9)), ("4", at(0), "no id")], "request_id string, ts timestamp_ntz, id string")
    done = projects.delete_projects(p, cmd)
    assert by_request(done.outcomes, "cause_status", "status") == {"1": (None, 200), "2": (404, 500), "3": (404, 500), "4": (400, 400)}
    assert done.state.count() == 3
    c = spark.createDataFrame([(oid(5), "t", T0, None, None, "u")], COMMENTS)
    assert comments.delete_comments(c, cmd.select("request_id", "ts", F.lit(oid(5)).alias("id"))).state.count() == 0


def test_get_projects(spark):
    cmd = spark.createDataFrame([("1", oid(3)), ("2", oid(9)), ("3", None), ("4", "")], "request_id string, id string")
    assert by_request(projects.get_projects(_projects(spark), cmd), "cause_status", "status", "title") == {"1": (None, 200, "Z"), "2": (400, 500, None), "3": (400, 400, None), "4": (400, 400, None)}


def test_create_projects(spark):
    cmd = spark.createDataFrame([("1", at(0), "u", "T", "d"), ("2", at(0), "u", "", "d"), ("3", at(0), "u", "T", None)], "request_id string, ts timestamp_ntz, user_id string, projectTitle string, description string")
    done = projects.create_projects(_projects(spark), cmd, now())
    assert by_request(done.outcomes, "cause_status", "status") == {"1": (None, 201), "2": (400, 400), "3": (500, 500)}
    new = done.state.where("_id = substr(md5('1'), 1, 24)").first()
    assert new.user == "u" and new.createdAt == dt.datetime(2024, 2, 2)


def _tasks(spark):
    return spark.createDataFrame([(oid(1), "Bring it", "d", oid(90), T0, T0), (oid(2), "Ärger", "d", oid(90), T0, T0), (oid(3), None, "d", oid(90), T0, T0), (oid(4), "ring", "d", oid(91), T0, T0)], TASKS)


def test_search_tasks(spark):
    t = _tasks(spark)
    cmd = spark.createDataFrame(
        [("1", oid(90), "RING", "title"), ("2", oid(90), "", "title"), ("3", oid(90), "(", "title"), ("4", oid(90), "zzz", "other"), ("5", oid(90), "ÄRGER", "title"), ("6", oid(90), "(", None), ("7", oid(90), "a|b)(", "title"), ("8", oid(90), "x++", "title"), *((f"j{k}", oid(90), p, "title") for k, p in enumerate(("{", "x{1", "a{,3}", "\\U0001F600", "[", "\\", "(?i)a")))],
        "request_id string, projectId string, val string, searchType string",
    )
    found, out = tasks.search_tasks_batch(t, cmd)
    got = {}
    for r in found.collect():
        got.setdefault(r.request_id, set()).add(int(r._id, 16))
    assert got == {"1": {1}, "2": {1, 2}, "4": {1, 2, 3}, "5": {2}, "6": {1, 2, 3}}
    assert {k for k, s in by_request(out, "status").items() if s == 500} == {"3", "7", "8", *(f"j{k}" for k in range(7))}
    assert {int(r._id, 16) for r in tasks.search_tasks(t, oid(90), "är", "title").collect()} == {2}
    assert tasks.search_tasks(t, oid(91), "nothing", "").count() == 1


PATCH = "request_id string, ts timestamp_ntz, taskId string, updatedData map<string,string>"


def test_patches_and_deletes(spark):
    patches = spark.createDataFrame(
        [("1", at(0), oid(1), {"title": "new"}), ("2", at(1), oid(1), {"title": None, "status": "open"}), ("3", at(2), oid(1), {"deadline": "no date", "description": "lost"}), ("4", at(0), oid(8), {"title": "x"}), ("5", at(0), oid(2), {"title": "p"}), ("6", at(2), oid(2), {"title": "q"}), ("7", at(0), oid(4), None)],
        PATCH,
    )
    deletes = spark.createDataFrame([("8", at(1), oid(2)), ("9", at(3), oid(2))], "request_id string, ts timestamp_ntz, taskId string")
    state, out, after = tasks.change_tasks(_tasks(spark), patches, deletes)
    assert by_request(out, "cause_status", "status") == {"1": (None, 200), "2": (None, 200), "3": (500, 500), "4": (400, 500), "5": (None, 200), "6": (400, 500), "7": (None, 200), "8": (None, 200), "9": (400, 500)}
    assert by_request(out, "message")["4"] == "Error updating task: Task not found"
    rows = {int(r._id, 16): r for r in state.collect()}
    assert set(rows) == {1, 3, 4} and rows[1].title is None and rows[1].description == "d" and rows[4].title == "ring"
    assert by_request(after, "title") == {"1": "new", "2": None, "5": "p", "7": "ring", "8": "p"}


def test_create_tasks_and_comments(spark):
    cmd = spark.createDataFrame([("1", at(0), oid(1), ("t", "d", "2024-05-05 00:00:00")), ("2", at(0), oid(1), (None, "d", None)), ("3", at(0), oid(1), ("t", None, None)), ("4", at(0), oid(1), ("t", "d", "no date"))], "request_id string, ts timestamp_ntz, projectId string, projectData struct<title:string,description:string,deadline:string>")
    done = tasks.create_tasks(_tasks(spark), cmd, now())
    assert by_request(done.outcomes, "status") == {"1": 200, "2": 400, "3": 500, "4": 500}
    assert done.state.where("createdAt = timestamp_ntz'2024-02-02'").count() == 1
    c = spark.createDataFrame([("1", at(0), "u", oid(1), "hi"), ("2", at(0), "u", "bad", "hi"), ("3", at(0), "u", oid(1), "")], "request_id string, ts timestamp_ntz, user_id string, taskId string, text string")
    made = comments.create_comments(spark.createDataFrame([], COMMENTS), c, now())
    assert by_request(made.outcomes, "status") == {"1": 200, "2": 400, "3": 400} and made.state.first().userId == "u"


def test_update_email(spark):
    u = spark.createDataFrame([(oid(1), "A", "a@x.io", "pw", None, []), (oid(2), "B", "b@x.io", "pw", None, [])], USERS)
    t = spark.createDataFrame([(oid(1), "t1", at(0)), (oid(7), "t7", at(0))], TOKENS)
    cmd = spark.createDataFrame([("1", at(0), "t1", "b@x.io"), ("2", at(1), "t1", "c@x.io"), ("3", at(0), "t7", "c@x.io"), ("4", at(0), None, "c@x.io"), ("5", at(0), "t1", "bad"), ("6", at(0), "no", "c@x.io")], "request_id string, ts timestamp_ntz, refreshToken string, newEmail string")
    done = users.update_email(u, t, cmd)
    assert by_request(done.outcomes, "cause_status", "status") == {"1": (None, 200), "2": (None, 200), "3": (404, 500), "4": (401, 401), "5": (400, 400), "6": (404, 500)}
    assert {r._id: r.email for r in done.state.collect()} == {oid(1): "c@x.io", oid(2): "b@x.io"}


def test_user_projects_orphans_and_refs(spark):
    u = spark.createDataFrame([("u", "A", "a@x.io", "pw", None, []), ("x", "B", "b@x.io", "pw", None, [])], USERS)
    assert {r.id: r.projects for r in users.user_dto(u, _projects(spark)).collect()} == {"u": [oid(1), oid(2), oid(3)], "x": []}
    assert users.user_dto(u).columns == ["id", "email", "projects"]
    t = spark.createDataFrame([("a", "t", "d", None, None, None), ("b", "t", "d", oid(1), None, None), ("c", "t", "d", oid(9), None, None)], TASKS)
    assert [r._id for r in refs.orphans(t, _projects(spark), "projectId").collect()] == ["c"]
    c = spark.createDataFrame([("k", "x", T0, oid(3), "a", "u")], COMMENTS)
    r = refs.resolve_refs(c, u, t, _projects(spark)).first()
    assert (r.username, r.task_title, r.project_title) == ("A", "t", "Z")


def test_conform_and_defaults(spark):
    df = spark.createDataFrame([("1", "t", "no date", "x"), ("2", "t", "2024-01-01 00:00:00", "x"), ("3", "t", None, "x")], "_id string, title string, deadline string, status string")
    rows = {r._id: r for r in rules.apply_defaults(rules.conform(df, "tasks"), "tasks", F.lit(T0)).collect()}
    assert "status" not in rows["1"].asDict() and [rows[k].castable for k in "123"] == [False, True, True] and rows["3"].createdAt is not None
    assert rules.require_fields(spark.createDataFrame([("a", ""), ("b", "d")], "title string, description string"), "tasks").count() == 1


def test_fixed_errors():
    assert [x[0] for x in (UNAUTHORIZED, FORBIDDEN, NO_PROJECT, INTERNAL, OTHER)] == [401, 403, 404, 500, 500]


def test_empty_tables(spark):
    p, t = spark.createDataFrame([], PROJECTS), spark.createDataFrame([], TASKS)
    assert projects.update_projects(p, spark.createDataFrame([], UPDATE), now()).state.count() == 0
    state, out, after = tasks.change_tasks(t, spark.createDataFrame([], PATCH))
    assert state.count() == out.count() == after.count() == 0


def test_patterns_and_their_ways(spark):
    """Word boundaries, named groups and brackets in classes are valid; nested repeats are matched on titles of any length; backtracking is bounded or refused."""
    titles = {1: "a Red hat", 2: "hatred", 3: "ab" * 50_000, 4: "ab" * 50_000 + "C", 5: "x[y", 6: "tel 12-34", 7: "a" * 100_000, 8: "naïve ÉCLAIR", 9: None, 10: "tab\tand\x0bline", 11: "abab"}
    short = {k for k, t in titles.items() if t and len(t) < 100}
    expected = {
        r"\bred\b": {1}, r"red": {1, 2}, "(a|b)*c": {4, 8}, "^(a|b)*c$": {4}, "(?<first>a)b*$": {3, 7, 11}, "[a-z[]\\[": {5}, "[[]": {5}, r"\d+-\d{2}": {6}, "(a+)+$": {7},
        "(x+x+)+y": set(), r"é\u0063lair": {8}, r"\x63lair": {8}, r"\s\v": set(), r"b\sand": {10}, r"d\sline": {10}, r"[\s]line": {10}, "": set(titles) - {9}, "a|x": set(titles) - {6, 9},
    }
    backtracking = {"(?=.*hat)a": {1}, r"(ab)\1": {11}, "(?<!hat)red": {1}, "^(?!.*red).*a": {8, 10, 11}, ".{5000}": set()}
    refused = ["(a+)+(?=b)", r"(a|b)*\1", "a{2000}" + "(?=b)*", "(?=a)" + "x" * 1000, "^*", "a**", "(?i)a", r"\p{L}", "a)(?=b", "(?=a", "[]", "(?=a)[b"]
    rows = [(oid(k), t, "d", oid(90 if k in short or t is None else 91), T0, T0) for k, t in titles.items()]
    asked = [*expected, *backtracking, *refused]
    cmd = spark.createDataFrame([(f"{k}-{p}", oid(p), v, "title") for k, v in enumerate(asked) for p in (90, 91)], "request_id string, projectId string, val string, searchType string")
    found, out = tasks.search_tasks_batch(spark.createDataFrame(rows, TASKS), cmd)
    got = {}
    for r in found.collect():
        got.setdefault(asked[int(r.request_id.split("-")[0])], set()).add(int(r._id, 16))
    status = by_request(out, "status")
    for k, v in enumerate(asked):
        refuses = v in refused
        assert status[f"{k}-90"] == (500 if refuses else 200), v
        assert status[f"{k}-91"] == (500 if refuses or v in backtracking else 200), v
        want = set() if refuses else {x for x in (backtracking | expected)[v] if v in expected or x in short}
        assert got.get(v, set()) == want, v
    assert {int(r._id, 16) for r in tasks.search_tasks(spark.createDataFrame(rows, TASKS), oid(91), "(a|b)*c", "title").collect()} == {4}
    with pytest.raises(ValueError):
        tasks.search_tasks(spark.createDataFrame(rows, TASKS), oid(91), "(a+)+(?=b)", "title")


def test_no_pattern_ends_the_job(spark):
    import random

    rng = random.Random(3)
    patterns = ["".join(rng.choice("ab(){}[]|*+?\\.^$,1-&:<>=!pUQE# ") for _ in range(rng.randint(1, 7))) for _ in range(1500)]
    cmd = spark.createDataFrame([(str(k), oid(90), p, "title") for k, p in enumerate(patterns)], "request_id string, projectId string, val string, searchType string")
    found, out = tasks.search_tasks_batch(_tasks(spark), cmd)
    status = by_request(out, "status")
    assert len(status) == 1500 and set(status.values()) == {200, 500} and found.count() > 0
    assert {r.request_id for r in found.collect()} <= {k for k, s in status.items() if s == 200}


def test_errors_of_other_kinds(spark):
    from brindle.operators.outcomes import error_outcome

    rows = [("1", 400, "said"), ("2", 401, None), ("3", 403, "no"), ("4", 404, None), ("5", 500, None), ("6", 418, "tea"), ("7", None, "what")]
    df = spark.createDataFrame(rows, "request_id string, status int, message string")
    status, message = error_outcome(F.col("status"), F.col("message"))
    assert by_request(df.select("request_id", status.alias("s"), message.alias("m")), "s", "m") == {"1": (400, "said"), "2": (401, "User is not authorized"), "3": (403, "no"), "4": (404, "No project was found by requested id"), "5": (500, "Internal server error"), "6": (500, "Server error"), "7": (500, "Server error")}


def test_array_references(spark):
    rows = [("u", "A", "a@x.io", "pw", None, [oid(3), oid(9), oid(1), None, oid(3)]), ("v", "B", "b@x.io", "pw", None, []), ("w", "C", "c@x.io", "pw", None, None), ("x", "D", "d@x.io", "pw", None, [oid(8), oid(9)]), (None, "E", "e@x.io", "pw", None, [oid(9)])]
    u = spark.createDataFrame(rows, USERS).withColumn("pos", F.lit("extra"))
    p = _projects(spark)
    assert sorted((r._id or "", r.pos, r.ref) for r in refs.dead_refs(u, "projects", p).collect()) == [("", 0, oid(9)), ("u", 1, oid(9)), ("x", 0, oid(8)), ("x", 1, oid(9))]
    kept = refs.drop_dead_refs(u, "projects", p)
    assert kept.columns == u.columns and {r._id: r.projects for r in kept.collect()} == {"u": [oid(3), oid(1), None, oid(3)], "v": [], "w": None, "x": [], None: [oid(9)]}
    titles = {r._id: [d.projectTitle for d in r.projects] for r in refs.populate(u, "projects", p, "projectTitle").collect()}
    by_id = {r._id: r.projectTitle for r in p.collect()}
    assert titles == {"u": [by_id[oid(3)], by_id[oid(1)], by_id[oid(3)]], "v": [], "w": [], "x": [], None: []}
    none = spark.createDataFrame([], PROJECTS)
    assert {r._id: r.projects for r in refs.drop_dead_refs(u, "projects", none).collect()}["u"] == [None] and refs.dead_refs(u.limit(0), "projects", p).count() == 0
