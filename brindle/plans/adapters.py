"""Collections and commands made from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(c: str | Column, n: int = 24) -> Column:
    return F.lpad((F.col(c) if isinstance(c, str) else c).cast("string"), n, "0")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _task_id() -> Column:
    """Of a row of lineitem; supplier and date tell rows of the same number and part apart."""
    more = F.md5(F.concat(F.col("l_suppkey").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd")).cast("binary"))
    return F.concat(padded("l_orderkey", 9), F.col("l_linenumber").cast("string"), padded("l_partkey", 8), F.substring(more, 1, 6))


class Workspace:
    """Frames over one set of tables; each is built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def events(self, *kinds: str) -> DataFrame:
        return self.table("events").where(F.col("event_type").isin(*kinds))

    # collections

    def users(self) -> DataFrame:
        return self.table("customer").select(
            padded("c_custkey").alias("_id"),
            F.col("c_name").alias("username"),
            F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("password"),
            _null("string").alias("token"),
            F.array().cast("array<string>").alias("projects"),
        )

    def users_before(self) -> DataFrame:
        """Users that exist before the batch of registrations; every other one has another e-mail by then."""
        changed = F.col("_id").cast("long") % 2 == 1
        return self.users().withColumn("email", F.when(changed, F.concat(F.lit("old."), F.col("email"))).otherwise(F.col("email")))

    def members(self) -> DataFrame:
        """The users with the ids of their projects; of every fifth one the first is there again, after a null."""
        ids = self.projects().groupBy(F.col("user").alias("_id")).agg(F.sort_array(F.collect_list(F.col("_id"))).alias("ids"))
        again = F.when(F.col("_id").cast("long") % 5 == 0, F.concat("ids", F.array(_null("string")), F.slice("ids", 1, 1))).otherwise(F.col("ids"))
        return self.users().drop("projects").join(ids, "_id", "left").withColumn("projects", F.coalesce(again, F.array().cast("array<string>"))).drop("ids")

    def projects(self) -> DataFrame:
        return self.table("orders").select(
            padded("o_orderkey").alias("_id"),
            F.col("o_orderpriority").alias("projectTitle"),
            F.concat(F.lit("status "), F.col("o_orderstatus")).alias("description"),
            padded("o_custkey").alias("user"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("createdAt"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("updatedAt"),
        )

    def tasks(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
        parts = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
        ship = F.col("l_shipdate").cast("timestamp_ntz")
        return lines.join(parts, "l_partkey").select(
            _task_id().alias("_id"),
            F.col("p_name").alias("title"),
            F.col("p_type").alias("description"),
            padded("l_orderkey").alias("projectId"),
            ship.alias("deadline"),
            (ship - F.expr("interval 30 days")).alias("createdAt"),
        )

    def long_tasks(self) -> DataFrame:
        """The tasks; the first of every 500th order has a title of more than 100,000 characters."""
        long = (F.substring("projectId", -9, 9).cast("long") % 500 == 3) & (F.substring("_id", 10, 1) == "1")
        return self.tasks().withColumn("title", F.when(long, F.repeat(F.concat("title", F.lit(" ab")), F.lit(10_000))).otherwise(F.col("title")))

    def comments(self) -> DataFrame:
        """From events; those whose number is an order's are about its first task."""
        e = self.table("events").select("event_id", "props", "ts", "user_id")
        tasks = self.table("lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.min(_task_id()).alias("taskId"))
        return e.join(tasks, "event_id", "left").select(padded("event_id").alias("_id"), F.col("props").alias("text"), F.col("ts").alias("createdAt"), padded("event_id").alias("projectId"), "taskId", padded("user_id").alias("userId"))

    def stored_tokens(self) -> DataFrame:
        """Tokens of customers from before the events, some of them older than 30 days."""
        issued = F.expr("timestamp_ntz'2024-01-01 00:00:00' - make_interval(0, 0, 0, cast(c_custkey % 60 as int), 0, 0, 0)")
        return self.table("customer").select(padded("c_custkey").alias("userId"), F.concat(F.lit("st-"), F.col("c_custkey").cast("string")).alias("refreshToken"), issued.alias("issued_at"))

    # commands

    @staticmethod
    def _request(event_id: str = "event_id") -> list[Column]:
        return [padded(event_id, 12).alias("request_id"), F.col("ts")]

    def cmd_register(self) -> DataFrame:
        return self.registrations(self.table("events"))

    @classmethod
    def registrations(cls, events: DataFrame) -> DataFrame:
        user = F.col("user_id").cast("string")
        return events.where("event_type = 'signup'").select(
            *cls._request(),
            F.concat(F.lit("user"), user, F.lit("@example.com")).alias("email"),
            F.concat(F.lit("User "), user).alias("username"),
            F.when(F.col("event_id") % 10 == 0, "short").otherwise(F.concat(F.lit("password"), (F.col("event_id") % 1000).cast("string"))).alias("password"),
        )

    def cmd_login(self) -> DataFrame:
        name = F.when(F.col("event_id") % 5 == 4, "nobody").otherwise("user")
        return self.events("click").select(*self._request(), F.concat(name, F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"), (F.col("event_id") % 4 != 0).alias("password_ok"))

    def session_events(self) -> DataFrame:
        """Logins with a new token each; every third logout names the user's first token, the others the latest."""
        e = self.events("click", "error").withColumn("tok", F.when(F.col("event_type") == "click", F.concat(F.lit("rt-"), F.col("event_id").cast("string"))))
        upto = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
        e = e.withColumns({"first_tok": F.first("tok", ignorenulls=True).over(upto), "last_tok": F.last("tok", ignorenulls=True).over(upto)})
        login = F.col("event_type") == "click"
        return e.select(
            *self._request(),
            padded("user_id").alias("user_id"),
            F.when(login, "login").otherwise("logout").alias("action"),
            F.when(login, F.col("tok")).when(F.col("event_id") % 3 == 0, F.col("first_tok")).otherwise(F.col("last_tok")).alias("refreshToken"),
        )

    def token_saves(self) -> DataFrame:
        return self.session_events().where("action = 'login'").select("request_id", "ts", F.col("user_id").alias("userId"), "refreshToken")

    def tokens(self) -> DataFrame:
        """What is stored after all logins: one token a user."""
        from ..operators.sessions import save_tokens

        return save_tokens(self.spark.createDataFrame([], "userId string, refreshToken string, issued_at timestamp_ntz"), self.token_saves())

    def cmd_logout(self) -> DataFrame:
        return self.session_events().where("action = 'logout'").select("request_id", "ts", "user_id", "refreshToken")

    def cmd_update_email(self) -> DataFrame:
        """Requests of purchases: the user's latest token of all logins, or one that nobody has."""
        last = self.tokens().select(F.col("userId").alias("user_id"), "refreshToken")
        e = self.events("purchase").select(*self._request(), "event_id", padded("user_id").alias("user_id"))
        e = e.join(last, "user_id", "left")
        token = F.when(F.col("event_id") % 9 == 0, "rt-none").when(F.col("event_id") % 11 == 0, "").otherwise(F.col("refreshToken"))
        email = F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.concat(F.lit("new"), F.col("event_id").cast("string"), F.lit("@example.com")))
        return e.select("request_id", "ts", "user_id", token.alias("refreshToken"), email.alias("newEmail"))

    def requests(self) -> DataFrame:
        return self.events("view", "purchase").select(*self._request(), padded("user_id").alias("user_id"))

    def logins(self) -> DataFrame:
        return self.events("click").select(*self._request(), padded("user_id").alias("user_id"))

    def bearer_requests(self) -> DataFrame:
        """Requests with an Authorization header: the access token of the user's latest login, or a broken header."""
        logins = self.logins().groupBy("user_id").agg(F.max(F.struct("ts", "request_id")).alias("l"))
        e = self.requests().join(logins, "user_id", "left").withColumn("k", F.col("request_id").cast("long"))
        header = F.when(F.col("k") % 13 == 0, "Bearer").when(F.col("k") % 17 == 0, "Bearer ").when(F.col("k") % 19 == 0, _null("string")).otherwise(F.concat(F.lit("Bearer at-"), F.col("l.request_id")))
        return e.select("request_id", "ts", header.alias("authorization"))

    def issued(self) -> DataFrame:
        return self.logins().select(F.concat(F.lit("at-"), F.col("request_id")).alias("access_token"), "user_id", F.col("ts").alias("iat"))

    def cmd_project_create(self) -> DataFrame:
        """From sign-ups, some without a title or a description."""
        title = F.when(F.col("event_id") % 8 == 0, "").otherwise(F.concat(F.lit("Project "), F.col("event_id").cast("string")))
        return self.events("signup").select(*self._request(), padded("user_id").alias("user_id"), title.alias("projectTitle"), F.when(F.col("event_id") % 6 != 0, F.col("props")).alias("description"))

    def cmd_project_update(self) -> DataFrame:
        """One of each purchase; a title that a user names again is that of the next project, if the first was renamed."""
        k = F.col("event_id")
        titles = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "no such title")))
        return self.events("purchase").select(
            *self._request(),
            padded("user_id").alias("user_id"),
            F.get(titles, (k % 6).cast("int")).alias("projectTitle"),
            F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("renamed "), k.cast("string"))).alias("newTitle"),
            F.when(k % 3 != 0, F.col("props")).alias("newDescription"),
            F.when(k % 7 == 0, F.col("ts")).alias("newCreatedAt"),
        )

    def cmd_rename_chain(self) -> DataFrame:
        """Renames around the titles that each user has, so that a command sees what those before it did."""
        k = F.col("event_id")
        titles = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
        return self.events("purchase").select(
            *self._request(),
            padded("user_id").alias("user_id"),
            F.get(titles, (k % 5).cast("int")).alias("projectTitle"),
            F.get(titles, ((k + 1 + k % 3) % 5).cast("int")).alias("newTitle"),
            F.when(k % 3 != 0, F.col("props")).alias("newDescription"),
            _null("timestamp_ntz").alias("newCreatedAt"),
        )

    def cmd_project_delete(self) -> DataFrame:
        """Two requests an order: ids that exist, some of them twice, and ids that don't."""
        o = self.table("orders").select(F.col("o_orderkey").alias("k"))
        name = lambda x: F.concat(F.lit(x), F.col("k").cast("string")).alias("request_id")
        other = lambda x: F.concat(F.lit(x), padded("k", 23))
        rows = o.select(name("a"), F.when(F.col("k") % 3 == 0, other("f")).otherwise(padded("k")).alias("id"))
        rows = rows.union(o.select(name("b"), F.when(F.col("k") % 10 == 0, padded("k")).otherwise(other("e")).alias("id")))
        return rows.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))

    def cmd_tasks_get(self) -> DataFrame:
        """A search in the project of each order: by title, with a pattern that repeats groups or names them, that needs lookaround, that doesn't compile, or without a search type."""
        k = F.col("k")
        o = self.table("orders").select(F.col("o_orderkey").alias("k"))
        bad = F.get(F.array(*map(F.lit, ("(", "{", "a{,3}", "\\U0001F600"))), (k % 4).cast("int"))
        val = F.when(k % 7 == 1, "RED|w.dg").when(k % 5 == 0, bad)
        for turn, pattern in enumerate((r"\bred\b", "(a|b)*c", "(?<first>[a-z[]+) (wid|gad)+get$", "(?=.*red).*w", "([a-z ]*)*[A-Z]#")):
            val = val.when(k % 11 == turn + 2, pattern)
        val = val.otherwise("")
        return o.select(padded("k", 12).alias("request_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), padded("k").alias("projectId"), val.alias("val"), F.when(k % 3 != 0, "title").alias("searchType"))

    def cmd_task_create(self) -> DataFrame:
        """From events of sign-up, some without a title or with a date that is none."""
        k = F.col("event_id")
        data = F.struct(F.when(k % 9 != 0, F.concat(F.lit("Task "), k.cast("string"))).alias("title"), F.when(k % 7 != 0, F.col("props")).alias("description"), F.when(k % 5 == 0, "no date").when(k % 2 == 0, "2024-05-01 10:00:00").alias("deadline"))
        return self.events("signup").select(*self._request(), padded("user_id").alias("user_id"), padded("event_id").alias("projectId"), data.alias("projectData"))

    def cmd_task_update(self) -> DataFrame:
        """Up to three patches of each task: keys that are there, null, unknown, or no date."""
        t = self.table("lineitem").select(_task_id().alias("taskId"), F.col("l_orderkey").alias("k"))
        t = t.select("*", F.explode(F.sequence(F.lit(1), (F.col("k") % 3 + 1).cast("int"))).alias("n"))
        name = F.concat(F.lit("patched "), F.col("n").cast("string"))
        data = (
            F.when((F.col("k") + F.col("n")) % 5 == 0, F.create_map(F.lit("description"), _null("string")))
            .when((F.col("k") + F.col("n")) % 7 == 0, F.create_map(F.lit("deadline"), F.lit("no date"), F.lit("title"), F.lit("lost")))
            .when((F.col("k") + F.col("n")) % 3 == 0, F.create_map(F.lit("title"), name, F.lit("status"), F.lit("open")))
            .otherwise(F.create_map(F.lit("description"), name, F.lit("deadline"), F.lit("2024-06-01 12:00:00")))
        )
        key = F.when(F.col("k") % 11 == 0, F.concat(F.lit("f"), F.substring("taskId", 2, 23))).otherwise(F.col("taskId"))
        at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        return t.select(F.concat("taskId", F.lit("-"), F.col("n").cast("string")).alias("request_id"), at.alias("ts"), key.alias("taskId"), data.alias("updatedData"))

    def cmd_task_delete(self) -> DataFrame:
        """One of each task, most with an id that is none; some come after the first patch of the same task."""
        t = self.table("lineitem").select(_task_id().alias("task"), F.col("l_partkey").alias("part"))
        at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        key = F.when(F.col("part") % 15 == 0, F.col("task")).otherwise(F.concat(F.lit("e"), F.substring("task", 2, 23)))
        return t.select(F.concat("task", F.lit("-1x")).alias("request_id"), at.alias("ts"), _null("string").alias("projectId"), key.alias("taskId"))

    def cmd_comment_create(self) -> DataFrame:
        k = F.col("event_id")
        return self.events("view").select(*self._request(), padded("user_id").alias("user_id"), F.when(k % 6 == 0, "no id").otherwise(padded("event_id")).alias("taskId"), F.when(k % 10 == 0, "").otherwise(F.col("props")).alias("text"))

    def cmd_comment_delete(self) -> DataFrame:
        """Three of each error: its comment's id, that again or one that is none, and one that is none."""
        e = self.events("error").select(F.col("event_id").alias("k"), "ts")
        name = lambda x: F.concat(F.lit(x), F.col("k").cast("string")).alias("request_id")
        other = lambda x: F.concat(F.lit(x), padded("k", 23))
        once = e.select(name("a"), "ts", padded("k").alias("id"))
        again = e.select(name("b"), "ts", F.when(F.col("k") % 4 == 0, padded("k")).otherwise(other("e")).alias("id"))
        return once.union(again).union(e.select(name("c"), "ts", other("f").alias("id")))

    def errors(self) -> DataFrame:
        """Errors of all events as (status, message): of known kinds with and without a message, and others."""
        k = F.col("event_id")
        status = F.get(F.array(*map(F.lit, (400, 401, 403, 404, 500, 418))), (k % 7).cast("int"))
        return self.table("events").select(padded("event_id", 12).alias("request_id"), status.alias("status"), F.when((k % 7 == 0) | (k % 2 == 0), F.col("props")).alias("message"))
