"""DuckDB SQL of the registered queries, over the test tables alone."""

from __future__ import annotations

from .queries import AS_OF

NOW = f"timestamp '{AS_OF}'"

#: Commands on projects, each user's one by one: of round n, the projects (a list in order of ids) after the user's n-th command and what it found.
_ONE_BY_ONE = """
        select user_id, 0 as n, coalesce(ps, []) as ps, cast(null as varchar) as request_id, cast(null as varchar) as hit
        from (select distinct user_id from {cmd}) left join (
          select "user" as user_id, list({{'id': _id, 't': "projectTitle", 'd': description, 'c': "createdAt", 'u': false}} order by _id) as ps from projects group by 1) using (user_id)
        union all
        select r.user_id, r.n + 1, list_transform(r.ps, lambda p, i: case when i = spot then {{
            'id': p.id, 't': coalesce(nullif("newTitle", ''), p.t), 'd': coalesce(nullif("newDescription", ''), p.d), 'c': coalesce("newCreatedAt", p.c), 'u': true}} else p end),
          c.request_id, r.ps[spot].id
        from {name} r join (select *, row_number() over (partition by user_id order by ts, request_id) as n from {cmd}) c on c.user_id = r.user_id and c.n = r.n + 1,
          lateral (select coalesce(list_position(list_transform(r.ps, lambda p: p.t), c.title), 0) as spot)"""

#: Frames as common table expressions, and those that each one stands on.
FRAMES: dict[str, tuple[tuple[str, ...], str]] = {
    "users": ((), """
        select lpad(cast(c_custkey as varchar), 24, '0') as _id, c_name as username, 'user' || c_custkey || '@example.com' as email,
          case when c_acctbal < 0 then null else c_mktsegment end as password from customer"""),
    "users_before": (("users",), "select * replace (case when cast(_id as bigint) % 2 = 1 then 'old.' || email else email end as email) from users"),
    "projects": ((), """
        select lpad(cast(o_orderkey as varchar), 24, '0') as _id, o_orderpriority as "projectTitle", 'status ' || o_orderstatus as description,
          lpad(cast(o_custkey as varchar), 24, '0') as "user", o_orderdate as "createdAt", o_orderdate as "updatedAt" from orders"""),
    "members": (("users", "projects"), """
        select u._id, u.email, case when cast(u._id as bigint) % 5 = 0 and ids is not null then list_concat(ids, [null, ids[1]]) else coalesce(ids, []) end as ids
        from users u left join (select "user", list(_id order by _id) as ids from projects group by 1) p on p."user" = u._id"""),
    "member_refs": (("members",), """select _id, ref, pos, email from (select _id, email, unnest(ids) as ref, generate_subscripts(ids, 1) - 1 as pos from members)"""),
    "left_projects": (("projects", "cmd_project_delete"), "select * from projects where _id not in (select id from cmd_project_delete)"),
    "tasks": ((), """
        select lpad(cast(l_orderkey as varchar), 9, '0') || l_linenumber || lpad(cast(l_partkey as varchar), 8, '0') || substr(md5(l_suppkey || strftime(l_shipdate, '%Y-%m-%d')), 1, 6) as _id,
          p_name as title, p_type as description, lpad(cast(l_orderkey as varchar), 24, '0') as "projectId", l_shipdate as deadline,
          l_shipdate - interval 30 day as "createdAt", l_orderkey as k, l_partkey as part
        from lineitem join part on p_partkey = l_partkey"""),
    "comments": (("tasks",), """
        select lpad(cast(event_id as varchar), 24, '0') as _id, props as text, ts as "createdAt", lpad(cast(event_id as varchar), 24, '0') as "projectId",
          t.id as "taskId", lpad(cast(user_id as varchar), 24, '0') as "userId"
        from events left join (select k, min(_id) as id from tasks group by k) t on t.k = event_id"""),
    "stored_tokens": ((), """
        select lpad(cast(c_custkey as varchar), 24, '0') as "userId", 'st-' || c_custkey as "refreshToken",
          timestamp '2024-01-01 00:00:00' - to_days(cast(c_custkey % 60 as integer)) as issued_at from customer"""),
    "cmd_register": ((), """
        select lpad(cast(event_id as varchar), 12, '0') as request_id, ts, 'user' || user_id || '@example.com' as email, 'User ' || user_id as username,
          case when event_id % 10 = 0 then 'short' else 'password' || (event_id % 1000) end as password from events where event_type = 'signup'"""),
    "registered": (("users_before", "cmd_register"), """
        select c.*, length(password) not between 6 and 24 as bad, exists (select 1 from users_before u where u.email = c.email) as known,
          row_number() over (partition by email, length(password) between 6 and 24 order by ts, request_id) as turn from cmd_register c"""),
    "cmd_login": ((), """
        select lpad(cast(event_id as varchar), 12, '0') as request_id, ts, case when event_id % 5 = 4 then 'nobody' else 'user' end || user_id || '@example.com' as email,
          event_id % 4 <> 0 as password_ok from events where event_type = 'click'"""),
    "session_events": ((), """
        select lpad(cast(event_id as varchar), 12, '0') as request_id, ts, lpad(cast(user_id as varchar), 24, '0') as user_id,
          case event_type when 'click' then 'login' else 'logout' end as action,
          case when event_type = 'click' then tok when event_id % 3 = 0 then first_tok else last_tok end as "refreshToken"
        from (select *, first_value(tok ignore nulls) over u as first_tok, last_value(tok ignore nulls) over u as last_tok
          from (select *, case when event_type = 'click' then 'rt-' || event_id end as tok from events where event_type in ('click', 'error'))
          window u as (partition by user_id order by ts, event_id rows between unbounded preceding and current row))"""),
    "tokens": (("session_events",), """
        select user_id as "userId", "refreshToken", ts as issued_at from session_events where action = 'login'
        qualify row_number() over (partition by user_id order by ts desc, request_id desc) = 1"""),
    "cmd_logout": (("session_events",), "select request_id, ts, user_id, \"refreshToken\" from session_events where action = 'logout'"),
    "logged_out": (("cmd_logout", "tokens"), """
        select c.*, exists (select 1 from tokens t where t."refreshToken" = c."refreshToken") as stored,
          row_number() over (partition by "refreshToken" order by ts, request_id) as turn from cmd_logout c"""),
    "cmd_update_email": (("tokens",), """
        select lpad(cast(event_id as varchar), 12, '0') as request_id, ts,
          case when event_id % 9 = 0 then 'rt-none' when event_id % 11 = 0 then '' else t."refreshToken" end as "refreshToken",
          case when event_id % 7 = 0 then 'bad' else 'new' || event_id || '@example.com' end as "newEmail"
        from events left join tokens t on t."userId" = lpad(cast(user_id as varchar), 24, '0') where event_type = 'purchase'"""),
    "email_updates": (("cmd_update_email", "tokens", "users"), """
        select c.*, t."userId", u._id is not null as found,
          case when "newEmail" = 'bad' then 1 when coalesce(c."refreshToken", '') = '' then 2 when u._id is null then 3 end as cause
        from cmd_update_email c left join tokens t on t."refreshToken" = c."refreshToken" left join users u on u._id = t."userId\""""),
    "requests": ((), """
        select lpad(cast(event_id as varchar), 12, '0') as request_id, ts, lpad(cast(user_id as varchar), 24, '0') as user_id, event_id
        from events where event_type in ('view', 'purchase')"""),
    "logins": ((), "select lpad(cast(event_id as varchar), 12, '0') as request_id, ts, lpad(cast(user_id as varchar), 24, '0') as user_id from events where event_type = 'click'"),
    "cmd_project_create": ((), """
        select lpad(cast(event_id as varchar), 12, '0') as request_id, ts, lpad(cast(user_id as varchar), 24, '0') as user_id,
          case when event_id % 8 = 0 then '' else 'Project ' || event_id end as title, case when event_id % 6 <> 0 then props end as description
        from events where event_type = 'signup'"""),
    "cmd_project_update": ((), """
        select lpad(cast(event_id as varchar), 12, '0') as request_id, ts, lpad(cast(user_id as varchar), 24, '0') as user_id,
          case event_id % 6 when 0 then '1-URGENT' when 1 then '2-HIGH' when 2 then '3-MEDIUM' when 3 then '4-NOT SPECIFIED' when 4 then '5-LOW' else 'no such title' end as title,
          case when event_id % 4 = 0 then '' else 'renamed ' || event_id end as "newTitle", case when event_id % 3 = 0 then null else props end as "newDescription",
          case when event_id % 7 = 0 then ts end as "newCreatedAt" from events where event_type = 'purchase'"""),
    "cmd_rename_chain": ((), """
        select lpad(cast(event_id as varchar), 12, '0') as request_id, ts, lpad(cast(user_id as varchar), 24, '0') as user_id,
          ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][event_id % 5 + 1] as title,
          ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][(event_id + 1 + event_id % 3) % 5 + 1] as "newTitle",
          case when event_id % 3 = 0 then null else props end as "newDescription", cast(null as timestamp) as "newCreatedAt"
        from events where event_type = 'purchase'"""),
    **{name: (("projects", cmd), _ONE_BY_ONE.format(name=name, cmd=cmd)) for name, cmd in (("updated", "cmd_project_update"), ("chained", "cmd_rename_chain"))},
    "cmd_project_delete": ((), """
        select 'a' || o_orderkey as request_id, case when o_orderkey % 3 = 0 then 'f' || lpad(cast(o_orderkey as varchar), 23, '0') else lpad(cast(o_orderkey as varchar), 24, '0') end as id from orders
        union all select 'b' || o_orderkey, case when o_orderkey % 10 = 0 then lpad(cast(o_orderkey as varchar), 24, '0') else 'e' || lpad(cast(o_orderkey as varchar), 23, '0') end from orders"""),
    "cmd_tasks_get": ((), """
        select lpad(cast(o_orderkey as varchar), 12, '0') as request_id, lpad(cast(o_orderkey as varchar), 24, '0') as "projectId",
          case when o_orderkey % 7 = 1 then 'RED|w.dg' when o_orderkey % 5 = 0 then 'bad' when o_orderkey % 11 = 2 then '\\bred\\b' when o_orderkey % 11 = 3 then '(a|b)*c'
            when o_orderkey % 11 = 4 then '([a-z\\[]+) (wid|gad)+get$' when o_orderkey % 11 = 5 then 'look' when o_orderkey % 11 = 6 then '([a-z ]*)*[A-Z]#' else '' end as val,
          o_orderkey % 3 <> 0 as by_title, o_orderkey as k
        from orders"""),
    "long_tasks": (("tasks",), """
        select * replace (case when k % 500 = 3 and substr(_id, 10, 1) = '1' then repeat(title || ' ab', 10000) else title end as title) from tasks"""),
    "cmd_task_create": ((), """
        select lpad(cast(event_id as varchar), 12, '0') as request_id, lpad(cast(event_id as varchar), 24, '0') as "projectId",
          case when event_id % 9 <> 0 then 'Task ' || event_id end as title, case when event_id % 7 <> 0 then props end as description,
          event_id % 5 = 0 as bad_date, case when event_id % 5 <> 0 and event_id % 2 = 0 then timestamp '2024-05-01 10:00:00' end as deadline
        from events where event_type = 'signup'"""),
    "cmd_task_update": (("tasks",), """
        select t._id || '-' || n as request_id, case when k % 11 = 0 then 'f' || substr(t._id, 2) else t._id end as "taskId", n,
          case when (k + n) % 5 = 0 then 'null' when (k + n) % 7 = 0 then 'bad' when (k + n) % 3 = 0 then 'title' else 'both' end as kind
        from tasks t, generate_series(1, k % 3 + 1) s(n)"""),
    "patches": (("cmd_task_update", "tasks"), """
        select c.*, t._id, case when kind = 'title' then 'patched ' || n end as set_title, kind in ('null', 'both') as sets_description,
          case when kind = 'both' then 'patched ' || n end as set_description, case when kind = 'both' then timestamp '2024-06-01 12:00:00' end as set_deadline
        from cmd_task_update c left join tasks t on t._id = c."taskId\""""),
    "folded": (("patches",), """
        select _id, arg_max(set_title, n) filter (where set_title is not null) as title, max(n) filter (where sets_description) as last_description,
          arg_max(coalesce(set_description, ''), n) filter (where sets_description) as description, max(set_deadline) as deadline
        from patches where _id is not null and kind <> 'bad' group by _id"""),
    "cmd_task_delete": (("tasks",), """select _id || '-1x' as request_id, case when part % 15 = 0 then _id else 'e' || substr(_id, 2) end as "taskId" from tasks"""),
    "cmd_comment_create": ((), """
        select lpad(cast(event_id as varchar), 12, '0') as request_id, lpad(cast(user_id as varchar), 24, '0') as user_id,
          case when event_id % 6 = 0 then 'no id' else lpad(cast(event_id as varchar), 24, '0') end as "taskId", case when event_id % 10 = 0 then '' else props end as text
        from events where event_type = 'view'"""),
    "cmd_comment_delete": ((), """
        select 'a' || event_id as request_id, lpad(cast(event_id as varchar), 24, '0') as id, 1 as turn, true as there from events where event_type = 'error'
        union all select 'b' || event_id, case when event_id % 4 = 0 then lpad(cast(event_id as varchar), 24, '0') else 'e' || lpad(cast(event_id as varchar), 23, '0') end, 2, event_id % 4 = 0 from events where event_type = 'error'
        union all select 'c' || event_id, 'f' || lpad(cast(event_id as varchar), 23, '0'), 1, false from events where event_type = 'error'"""),
}


def _with(frames: tuple[str, ...], body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for x in FRAMES[name][0]:
            add(x)
        if name not in order:
            order.append(name)

    for f in frames:
        add(f)
    return "with recursive " + ",\n".join(f"{n} as ({FRAMES[n][1]})" for n in order) + "\n" + body


def _judged(frame: str, causes: list[tuple[str, int, int, str]], id: str, done: int = 200, message: str = "null", more: str = "") -> str:
    """Outcome columns; causes are (condition, cause_status, status, message)."""
    case = lambda k, end: "case " + " ".join(f"when {c[0]} then {c[k]}" for c in causes) + f" else {end} end"
    bad = " or ".join(f"coalesce({c[0]}, false)" for c in causes)
    return f"select request_id, cast({case(1, 'null')} as integer) as cause_status, cast({case(2, done)} as integer) as status, {case(3, message)} as message, case when not ({bad}) then {id} end as id{more} from {frame}"


NEW_ID = "substr(md5(request_id), 1, 24)"
_COALESCE = lambda a, b: f"coalesce(nullif({a}, ''), {b})"
_PROJECT_UPDATE = f"""
select _id, coalesce(x.p.t, "projectTitle") as "projectTitle", coalesce(x.p.d, description) as description, "user", coalesce(x.p.c, "createdAt") as "createdAt",
  case when x.p.u then {NOW} else "updatedAt" end as "updatedAt"
from projects left join (select unnest(ps) as p from (select arg_max(ps, n) as ps from {{}} group by user_id)) x on x.p.id = _id"""
_PATCHED = """t._id, coalesce(f.title, t.title) as title, case when f.last_description is not null then nullif(f.description, '') else t.description end as description"""

ORACLE_SQL: dict[str, str] = {
    "task_search": _with(("tasks",), """select _id, title, "projectId", deadline from tasks where regexp_matches(title, 'RED|w.dg', 'i')"""),
    **{name: _with(("long_tasks", "cmd_tasks_get"), """
        select c.request_id, t._id, case when length(t.title) > 1000 then md5(t.title) else t.title end as title
        from cmd_tasks_get c join long_tasks t using ("projectId")
        where not c.by_title or case c.val when 'bad' then false
          when 'look' then regexp_matches(t.title, 'red', 'i') and regexp_matches(t.title, 'w', 'i') and not exists (select 1 from long_tasks o where o."projectId" = c."projectId" and length(o.title) > 1000)
          else regexp_matches(t.title, c.val, 'i') end""") for name in ("task_search_batch", "task_search_pruned")},
    "task_search_outcomes": _with(("long_tasks", "cmd_tasks_get"), _judged("cmd_tasks_get", [
        ("by_title and (val = 'bad' or val = 'look' and k in (select k from long_tasks where length(title) > 1000))", 500, 500, "'Error retrieving tasks'")], '"projectId"')),
    "tasks_by_project": _with(("tasks", "cmd_project_delete"), """select c.request_id, t._id, t."projectId" from cmd_project_delete c join tasks t on t."projectId" = c.id"""),
    "project_dto": _with(("projects",), 'select _id, "projectTitle" as title, description from projects'),
    "validate_register": _with(("cmd_register",), """
        select request_id, case when length(password) between 6 and 24 then '' else 'password=Password must be between 6 and 24 characters' end as violations,
          case when length(password) between 6 and 24 then null else 'Password must be between 6 and 24 characters' end as rejected from cmd_register"""),
    "validate_tasks": _with(("cmd_task_create",), """
        select request_id, cast(title is null as bigint) as n_violations, case when title is null then 'Task title is required' end as rejected,
          title is not null and description is not null and description <> '' as complete from cmd_task_create"""),
    "conform_tasks": _with(("cmd_task_create",), f"""select request_id as _id, title, description, "projectId", deadline, {NOW} as "createdAt", not bad_date as castable from cmd_task_create"""),
    **{name: _with(("registered",), _judged("registered", [
        ("bad", 400, 400, "'Password must be between 6 and 24 characters'"),
        ("known or turn > 1", 400, 400, "'User with this email already exists.'")], NEW_ID)) for name in ("register_outcomes", "register_known_outcomes")},
    **{name: _with(("registered",), f"""
        select _id, username, email, password from users_before union all
        select {NEW_ID}, username, email, password from registered where not bad and not known and turn = 1""") for name in ("register_users", "register_stream")},
    "register_tokens": _with(("registered",), f"""
        select {NEW_ID} as "userId", 'rt-' || request_id as "refreshToken", date_trunc('second', ts) as iat, date_trunc('second', ts) + interval 180 minute as access_exp,
          date_trunc('second', ts) + interval 30 day as refresh_exp from registered where not bad and not known and turn = 1"""),
    "login_outcomes": _with(("users", "cmd_login"), _judged("(select c.*, u._id, u.password from cmd_login c left join users u using (email))", [
        ("_id is null", 400, 500, "'Login failed'"), ("password is null", 400, 500, "'Login failed'"), ("not password_ok", 400, 500, "'Login failed'")], "_id")),
    "user_dto_projects": _with(("users", "projects"), """
        select u._id as id, u.email, coalesce(p.ids, '') as projects from users u
        left join (select "user", string_agg(_id, ',' order by _id) as ids from projects group by 1) p on p."user" = u._id"""),
    "update_email": _with(("email_updates",), """
        select u._id, coalesce(e.email, u.email) as email from users u left join (
          select "userId", arg_max("newEmail", (ts, request_id)) as email from email_updates where cause is null group by 1) e on e."userId" = u._id"""),
    "update_email_outcomes": _with(("email_updates",), _judged("email_updates", [
        ("cause = 1", 400, 400, "'Invalid email'"), ("cause = 2", 401, 401, "'User is not authorized'"), ("cause = 3", 404, 500, "'Email update failed'")], '"userId"')),
    "authorize": _with(("requests", "logins"), """
        select r.request_id, case when ok then l.user_id end as user_id, cast(case when ok then 200 else 401 end as integer) as status, case when not ok then 'User is not authorized' end as message
        from requests r left join (select user_id, max((ts, request_id))[1] as iat from logins group by 1) l on l.user_id = r.user_id,
        lateral (select coalesce(r.event_id % 13 <> 0 and r.event_id % 17 <> 0 and r.event_id % 19 <> 0 and r.ts >= l.iat and r.ts < l.iat + interval 180 minute, false) as ok)"""),
    "authorize_asof": _with(("requests", "logins"), """
        select request_id, user_id, case when ts < login_ts + interval 180 minute then login_ts end as login_ts, cast(case when ts < login_ts + interval 180 minute then 200 else 401 end as integer) as status from (
          select *, max(login) over (partition by user_id order by ts, request_id rows between unbounded preceding and 1 preceding) as login_ts from (
            select request_id, ts, user_id, cast(null as timestamp) as login from requests union all select request_id, ts, user_id, ts from logins))
        where login is null"""),
    "token_upsert": _with(("tokens", "stored_tokens"), """
        select * from tokens union all select * from stored_tokens where "userId" not in (select "userId" from tokens)"""),
    "logout_outcomes": _with(("logged_out",), _judged("logged_out", [
        ("coalesce(\"refreshToken\", '') = ''", 400, 500, "'Logout failed'"), ("not stored or turn > 1", 400, 500, "'Logout failed'")], "cast(null as varchar)", message="'Logout successful'")),
    "logout_tokens": _with(("cmd_logout", "tokens"), """select * from tokens t where not exists (select 1 from cmd_logout c where c."refreshToken" = t."refreshToken")"""),
    "find_tokens": _with(("cmd_logout", "tokens"), """select * from tokens t where exists (select 1 from cmd_logout c where c."refreshToken" = t."refreshToken")"""),
    "refresh_valid": _with(("cmd_logout", "tokens"), """
        select request_id, "refreshToken", case when ok then "userId" end as "userId", ok as valid from (
          select c.request_id, c."refreshToken", t."userId", coalesce(c.ts >= issued_at and c.ts < issued_at + interval 30 day, false) as ok
          from cmd_logout c left join tokens t using ("refreshToken"))"""),
    **{name: _with(("session_events", "stored_tokens"), f"""
        select * from (
          select user_id as "userId", "refreshToken", ts as issued_at from (
            select *, row_number() over (partition by user_id order by ts desc, request_id desc) as turn from session_events where action = 'login') l
          where turn = 1 and not exists (select 1 from session_events o where o.action = 'logout' and o."refreshToken" = l."refreshToken" and (o.ts, o.request_id) >= (l.ts, l.request_id))
          union all select * from stored_tokens where "userId" not in (select user_id from session_events where action = 'login'))
        {age}""")
       for name, age in (("session_replay", ""), ("session_replay_expired", f"where issued_at + interval 30 day > {NOW}"))},
    "project_create": _with(("projects", "cmd_project_create"), f"""
        select * from projects union all
        select {NEW_ID}, title, description, user_id, {NOW}, {NOW} from cmd_project_create where title <> '' and description <> ''"""),
    "project_create_outcomes": _with(("cmd_project_create",), _judged("cmd_project_create", [
        ("title = ''", 400, 400, "'Project name is required'"), ("description is null", 500, 500, "'Error creating project'")], NEW_ID, done=201)),
    "project_get": _with(("projects", "cmd_project_delete"), _judged(
        """(select c.request_id, c.id as wanted, p._id, p."projectTitle" as title, p.description from cmd_project_delete c left join projects p on p._id = c.id)""",
        [("_id is null", 400, 500, "'Error fetching project'")], "wanted", more=", title, description")),
    **{f"{name}{part}": _with((frame, "projects"), body) for name, frame in (("project_update", "updated"), ("project_rename_chain", "chained"), ("project_rename_parts", "chained")) for part, body in (
        ("", _PROJECT_UPDATE.format(frame)),
        ("_outcomes", _judged(f"(select request_id, hit from {frame} where n > 0)", [("hit is null", 400, 500, "'Error updating project: Project not found'")], "hit")))},
    "project_delete": _with(("projects", "cmd_project_delete"), "select * from projects where _id not in (select id from cmd_project_delete)"),
    "project_delete_outcomes": _with(("projects", "cmd_project_delete"), _judged(
        "(select c.request_id, c.id as wanted, p._id, row_number() over (partition by c.id order by c.request_id) as turn from cmd_project_delete c left join projects p on p._id = c.id)",
        [("_id is null or turn > 1", 404, 500, "'Error deleting project'")], "wanted")),
    "task_create": _with(("tasks", "cmd_task_create"), f"""
        select _id, title, description, "projectId", deadline, "createdAt" from tasks union all
        select {NEW_ID}, title, description, "projectId", deadline, {NOW} from cmd_task_create where title is not null and description <> '' and not bad_date"""),
    "task_create_outcomes": _with(("cmd_task_create",), _judged("cmd_task_create", [
        ("title is null", 400, 400, "'Task title is required'"), ("coalesce(description, '') = ''", 500, 500, "'Error creating task'"), ("bad_date", 500, 500, "'Error creating task'")], NEW_ID)),
    "task_patch": _with(("folded", "tasks"), f"""select {_PATCHED}, t."projectId", coalesce(f.deadline, t.deadline) as deadline, t."createdAt" from tasks t left join folded f on f._id = t._id"""),
    "task_patch_outcomes": _with(("patches", "tasks"), """
        select p.request_id, cast(case when p._id is null then 400 when kind = 'bad' then 500 end as integer) as cause_status,
          cast(case when p._id is null or kind = 'bad' then 500 else 200 end as integer) as status,
          case when p._id is null then 'Error updating task: Task not found' when kind = 'bad' then 'Error updating task: Invalid date' end as message,
          case when ok then "taskId" end as id,
          case when ok then coalesce(last_value(set_title ignore nulls) over w, t.title) end as title,
          case when ok then case when bool_or(sets_description and ok) over w then nullif(last_value(case when sets_description and ok then coalesce(set_description, '') end ignore nulls) over w, '') else t.description end end as description,
          case when ok then coalesce(last_value(set_deadline ignore nulls) over w, t.deadline) end as deadline
        from patches p left join tasks t on t._id = p._id, lateral (select p._id is not null and p.kind <> 'bad' as ok)
        window w as (partition by "taskId" order by n rows between unbounded preceding and current row)"""),
    "task_delete": _with(("cmd_task_delete", "tasks"), _judged(
        """(select c.request_id, t._id, t.title, t."projectId" from cmd_task_delete c left join tasks t on t._id = c."taskId")""",
        [("_id is null", 400, 500, "'Error deleting task: Task not found'")], "_id", more=', title, "projectId"')),
    **{name: _with(("folded", "tasks", "cmd_task_delete"), f"""
        select {_PATCHED}, coalesce(f.deadline, t.deadline) as deadline from tasks t left join folded f on f._id = t._id where t._id not in (select "taskId" from cmd_task_delete)""") for name in ("task_patch_delete", "task_log", "task_patch_bucketed")},
    "comment_create": _with(("comments", "cmd_comment_create"), f"""
        select * from comments union all
        select {NEW_ID}, text, {NOW}, null, "taskId", user_id from cmd_comment_create where "taskId" <> 'no id' and text <> ''"""),
    "comment_create_outcomes": _with(("cmd_comment_create",), _judged("cmd_comment_create", [
        ("\"taskId\" = 'no id'", 400, 400, "'Invalid task ID'"), ("text = ''", 400, 400, "'Comment content is required'")], NEW_ID)),
    "comment_delete": _with(("cmd_comment_delete",), _judged("(select request_id, id as wanted, turn, there from cmd_comment_delete)", [("not there or turn > 1", 404, 500, "'Error deleting comment'")], "wanted")),
    "comment_delete_state": _with(("comments", "cmd_comment_delete"), "select * from comments where _id not in (select id from cmd_comment_delete)"),
    "error_outcomes": """
        select lpad(cast(event_id as varchar), 12, '0') as request_id, cast(case when event_id % 7 > 4 then 500 else [400, 401, 403, 404, 500][event_id % 7 + 1] end as integer) as status,
          case when event_id % 7 > 4 then 'Server error' when event_id % 7 = 0 or event_id % 2 = 0 then props
            else ['', 'User is not authorized', 'User is not admin', 'No project was found by requested id', 'Internal server error'][event_id % 7 + 1] end as message from events""",
    "request_bodies": _with(("cmd_register",), """
        select case when not cut then request_id end as request_id, case when not cut then email end as email, case when not cut then username end as username, case when not cut then password end as password,
          case when cut then substr('{"request_id":"' || request_id || '"', 1, 20) end as broken
        from (select *, cast(request_id as bigint) % 11 = 0 as cut from cmd_register)"""),
    "request_body_outcomes": _with(("cmd_register",), """
        select case when not cut then request_id end as request_id, case when cut then substr('{"request_id":"' || request_id || '"', 1, 20) end as broken,
          cast(case when cut then 500 end as integer) as cause_status, cast(case when cut then 500 end as integer) as status, case when cut then 'Server error' end as message, true as located
        from (select *, cast(request_id as bigint) % 11 = 0 as cut from cmd_register)"""),
    "read_users": _with(("users",), "select _id, username, email, password, cast(null as varchar) as token, cast(0 as bigint) as n_projects from users"),
    "resolve_refs": _with(("comments", "users", "projects", "tasks"), """
        select c._id, c."userId", u.username, t.title as task_title, p."projectTitle" as project_title
        from comments c left join users u on u._id = c."userId" left join projects p on p._id = c."projectId" left join tasks t on t._id = c."taskId\""""),
    "orphan_tasks": _with(("tasks", "cmd_project_delete", "projects"), """
        select _id, "projectId" from tasks where "projectId" not in (select _id from projects where _id not in (select id from cmd_project_delete))"""),
    "dead_project_refs": _with(("member_refs", "left_projects"), "select _id, cast(pos as bigint) as pos, ref from member_refs where ref is not null and ref not in (select _id from left_projects)"),
    "clean_project_refs": _with(("members", "member_refs", "left_projects"), """
        select m._id, m.email, coalesce(r.ids, '') as projects from members m left join (
          select _id, string_agg(coalesce(ref, '-'), ',' order by pos) as ids from member_refs where ref is null or ref in (select _id from left_projects) group by 1) r using (_id)"""),
    "populate_projects": _with(("members", "member_refs", "left_projects"), """
        select m._id, coalesce(r.titles, '') as titles from members m left join (
          select r._id, string_agg(p."projectTitle", ',' order by pos) as titles from member_refs r join left_projects p on p._id = r.ref group by 1) r using (_id)"""),
    "responses": _with(("projects", "cmd_project_delete"), """
        select c.request_id, case when p._id is null then '{"status":500,"message":"Error fetching project"}' else '{"status":200,"projectTitle":"' || p."projectTitle" || '"}' end as body
        from cmd_project_delete c left join projects p on p._id = c.id"""),
    "authorize_stream_asof": _with(("requests", "logins"), """
        select request_id, user_id, case when ts < login_ts + interval 180 minute then login_ts end as login_ts, cast(case when ts < login_ts + interval 180 minute then 200 else 401 end as integer) as status from (
          select *, max(login) over (partition by user_id order by ts, request_id rows between unbounded preceding and 1 preceding) as login_ts from (
            select request_id, ts, user_id, cast(null as timestamp) as login from requests union all select request_id, ts, user_id, ts from logins))
        where login is null and epoch_us(ts) <= (select epoch_ms(max(ts)) * 1000 from (select ts from requests union all select ts from logins)) - 10800000000"""),
    "authorize_stream": _with(("requests", "logins"), """
        select r.request_id, r.user_id from requests r
        where exists (select 1 from logins l where l.user_id = r.user_id and r.ts >= l.ts and r.ts < l.ts + interval 180 minute)"""),
}
