"""Registered queries over changes of records, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradus.operators import records as C
from gradus.sources.scratch import folder
from gradus.sources.tables import RESULT, table
from gradus.streaming import cases

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


#: Events as requests: the user is the case, the type the wanted status (`view` is none), the id decides the role.
STATUS = {"click": "in_review", "error": "escalated", "purchase": "resolved", "signup": "rejected"}
STATUSES = ["open", "in_review", "resolved", "rejected", "escalated"]
_STATUS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " ELSE event_type END"
_REQUESTS = f"SELECT user_id, event_id, ts, value, {_STATUS} AS status, CASE event_id % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'teacher' ELSE 'student' END AS role FROM events"


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of those who may make them: admins, and teachers for the cases assigned to them (even ones)."""
    return asked(table(spark, d, "events"))


def asked(e: DataFrame) -> DataFrame:
    status = F.col("event_type")
    for name, to in STATUS.items():
        status = F.when(F.col("event_type") == name, to).otherwise(status)
    role = F.get(F.array(F.lit("admin"), F.lit("teacher"), F.lit("student")), (F.col("event_id") % 3).cast("int"))
    made = e.select("user_id", "event_id", F.col("ts").alias("at"), F.col("value").alias("note"), status.alias("status"), role.alias("role"))
    return made.filter(C.may_update(F.col("role"), F.lit(0), F.col("user_id") % 2))


@query(f"""WITH r AS (SELECT * FROM ({_REQUESTS}) WHERE (role = 'admin' OR (role = 'teacher' AND user_id % 2 = 0)) AND status <> 'view')
 SELECT user_id, arg_max(status, event_id) AS status, arg_max(value, event_id) FILTER (status = 'resolved') AS resolution, arg_max(ts, event_id) FILTER (status = 'resolved') AS resolved_at, arg_max(role, event_id) FILTER (status = 'resolved') AS resolved_by,
 arg_max(ts, event_id) FILTER (status = 'escalated') AS escalated_at, count(*) AS changes FROM r GROUP BY 1""")
def case_transitions(spark, d):
    return C.transitions(requests(spark, d), "user_id", "event_id", STATUSES)


@query(SQL["case_transitions"])
def case_stream(spark, d):
    """case_transitions by a stream over the events, whose state is kept by case; what the stream wrote last of each case."""
    place, name = folder(spark, "cases"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, cases.PROVIDER)
    try:
        events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")  # as a pattern, so that one file is a folder of its own
        changed = cases.stream_transitions(asked(events), "user_id", "event_id", STATUSES)
        cases.kept(changed, f"{place}/rows", f"{place}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(name, before)
    return cases.latest_cases(spark, f"{place}/rows", "user_id", changed.schema).drop("closed").withColumn("resolution", F.col("resolution").cast("double"))


@query(f"""WITH r AS (SELECT * FROM ({_REQUESTS}) WHERE (role = 'admin' OR (role = 'teacher' AND user_id % 2 = 0)) AND status <> 'view')
 SELECT user_id, event_id, 'Status changed from ''' || coalesce(lag(status) OVER (PARTITION BY user_id ORDER BY event_id), 'open') || ''' to ''' || status || '''' AS content FROM r""")
def case_messages(spark, d):
    return C.status_messages(requests(spark, d).filter(F.col("status").isin(STATUSES)), "user_id", "event_id")


@query("""SELECT o_orderkey, role, CASE role WHEN 'admin' THEN true WHEN 'student' THEN o_custkey % 7 = o_orderkey % 7 ELSE o_custkey % 7 = o_orderkey % 7 OR o_orderkey % 7 = o_orderkey % 5 END AS may_view,
 CASE role WHEN 'admin' THEN true WHEN 'teacher' THEN o_orderkey % 7 = o_orderkey % 5 ELSE false END AS may_update FROM orders CROSS JOIN (SELECT unnest(['admin', 'teacher', 'student']) AS role)""")
def case_permissions(spark, d):
    """May the user of each case, in each role, see it and change it? Owners and users are dealt by key."""
    o = table(spark, d, "orders").withColumn("role", F.explode(F.array(F.lit("admin"), F.lit("teacher"), F.lit("student"))))
    user, owner, assigned = F.col("o_orderkey") % 7, F.col("o_custkey") % 7, F.col("o_orderkey") % 5
    return o.select("o_orderkey", "role", C.may_view(F.col("role"), user, owner, assigned).alias("may_view"), C.may_update(F.col("role"), user, assigned).alias("may_update"))


@query("""SELECT n_nationkey, s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 5 = n_regionkey WHEN s_suppkey % 3 = 0 THEN s_suppkey % 25 = n_nationkey ELSE false END AS owner FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def community_owners(spark, d):
    """Which teachers own the community of their nation: admins own by region, teachers by nation, others none."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    role = F.when(F.col("s_suppkey") % 2 == 0, "admin").when(F.col("s_suppkey") % 3 == 0, "teacher").otherwise("student")
    user = F.when(role == "admin", F.col("s_suppkey") % 5).otherwise(F.col("s_suppkey") % 25)
    return s.select("n_nationkey", "s_suppkey", C.owns(role, user, F.col("n_regionkey"), F.col("n_nationkey")).alias("owner"))


@query("""SELECT o_orderkey, max(l_shipdate) AS reviewed_at, max(l_shipdate) IS NOT NULL AS reviewed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1""")
def review_flags(spark, d):
    reviews = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return C.reviewed(table(spark, d, "orders").select("o_orderkey"), reviews, "o_orderkey", "l_shipdate").select("o_orderkey", "reviewed_at", "reviewed")


@query("""WITH r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N'), t AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'N')
 SELECT l_suppkey, l_partkey, CASE WHEN (l_suppkey, l_partkey) IN (SELECT l_suppkey, l_partkey FROM t) THEN 'exists' ELSE 'added' END AS outcome FROM r""")
def class_assignments(spark, d):
    li = table(spark, d, "lineitem")
    return C.link_requests(li.filter("l_returnflag = 'N'"), li.filter("l_returnflag <> 'N'"), ["l_suppkey", "l_partkey"])


_BOARDS = "SELECT o_custkey AS c_custkey, count(*) AS evaluations, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1"


def boards(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey"))
    return urgent.agg(F.count("*").alias("evaluations"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))


@query(f"SELECT c_custkey, coalesce(evaluations, 0) AS evaluations, coalesce(open, 0) AS open, evaluations IS NULL AS created FROM customer LEFT JOIN ({_BOARDS}) USING (c_custkey)")
def dashboard_upsert(spark, d):
    return C.got_or_created(table(spark, d, "customer"), boards(spark, d), "c_custkey", ["evaluations", "open"])


@query(f"SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE evaluations END AS evaluations, CASE WHEN c_acctbal < 0 THEN 0 ELSE open END AS open FROM ({_BOARDS}) JOIN customer USING (c_custkey)")
def dashboard_reset(spark, d):
    there = boards(spark, d).join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    return C.reset(there, F.col("c_acctbal") < 0, ["evaluations", "open"]).drop("c_acctbal")


@query("""WITH t AS (SELECT o_orderkey AS id, o_totalprice AS score, o_orderstatus AS grade FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT l_orderkey AS id, coalesce(CASE WHEN l_discount > 0.02 THEN l_extendedprice END, 0) AS score, coalesce(nullif(l_returnflag, 'N'), 'unknown') AS grade FROM lineitem)
 SELECT id, score, grade FROM t UNION ALL SELECT id, min(score), arg_min(grade, (score, grade)) FROM n WHERE id NOT IN (SELECT id FROM t) GROUP BY 1""")
def evaluation_inserts(spark, d):
    there = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("grade"))
    new = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice")).alias("score"), F.nullif("l_returnflag", F.lit("N")).alias("grade"))
    return C.inserted(there, new, "id", {"score": F.lit(0.0), "grade": F.lit("unknown")})


@query("""SELECT doc_id, lang, n_chars FROM documents WHERE coalesce(source, '') <> 'web' QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 20""")
def files_by_type(spark, d):
    """Documents as files: the largest twenty of each language that are not deleted, for which the source web stands."""
    files = table(spark, d, "documents").select("doc_id", "lang", "n_chars", (F.col("source") == "web").alias("deleted"))
    return C.of_type(files, "lang", [F.col("n_chars").desc(), F.col("doc_id")], 20, "deleted").drop("deleted")


@query("SELECT l.doc_id, d.source, d.n_chars, d.doc_id IS NOT NULL AND coalesce(d.source, '') <> 'web' AS found FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def file_lookup(spark, d):
    """Point reads of many ids at once: one join."""
    files = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.lit(True).alias("there"))
    found = F.coalesce("there", F.lit(False)) & (F.coalesce("source", F.lit("")) != "web")
    return table(spark, d, "labels").select("doc_id").join(files, "doc_id", "left").select("doc_id", "source", "n_chars", found.alias("found"))


@query("""SELECT doc_id, coalesce(t.text, substr(d.text, 1, 20)) AS text, t.text IS NOT NULL AS processed FROM documents d LEFT JOIN (SELECT doc_id, max('quality ' || quality) AS text FROM labels GROUP BY 1) t USING (doc_id)""")
def text_write_back(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 20).alias("text"))
    return C.written_back(files, table(spark, d, "labels").select("doc_id", F.concat(F.lit("quality "), "quality").alias("text")), "doc_id")


@query("SELECT event_id FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR")
def expired_files(spark, d):
    """Temporary files (views) of more than 240 hours before the end of the log."""
    return C.expired(table(spark, d, "events").filter("event_type = 'view'").withColumn("at", F.col("ts").cast("timestamp_ntz")), "at", F.lit("2024-01-31").cast("timestamp_ntz"), 240).select("event_id")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN 1 / l_discount END AS inverse, CASE WHEN l_discount > 0 THEN l_discount / l_discount END AS share FROM lineitem""")
def json_safe_scores(spark, d):
    """Scores as they may go into JSON: what came out as infinite or as no number is null."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.pow("l_discount", F.lit(-1.0)).alias("inverse"), (F.pow("l_discount", F.lit(-1.0)) * F.col("l_discount")).alias("share"))
    return C.json_safe(li).select("l_orderkey", "l_linenumber", F.round("inverse", 6).alias("inverse"), F.round("share", 6).alias("share"))


SQL["json_safe_scores"] = SQL["json_safe_scores"].replace("1 / l_discount END", "round(1 / l_discount, 6) END").replace("l_discount / l_discount END", "round(l_discount / l_discount, 6) END")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS final_score, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS grade, CASE WHEN o_orderpriority <> '5-LOW' THEN 1 ELSE 0 END AS matched FROM orders""")
def result_documents(spark, d):
    """Result documents as JSON, of which some lack a score, a grade or their concepts, parsed by the schema of stored results."""
    price, status, low = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority") == "5-LOW"
    concepts = F.when(~low, F.struct(F.array(status).alias("matched"), F.array().cast("array<string>").alias("missing")))
    doc = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("evaluation_id"), F.when(status != "P", price).alias("final_score"), F.when(~low, status).alias("grade"), concepts.alias("concepts")))
    x = table(spark, d, "orders").select(F.from_json(doc, RESULT).alias("r"))
    return x.select(F.col("r.evaluation_id").cast("long").alias("id"), "r.final_score", "r.grade", F.coalesce(F.size("r.concepts.matched"), F.lit(0)).alias("matched"))




@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30")
def chosen_sort_page(spark, d):
    """A page in the order of the balance, as a caller may choose it."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return C.sorted_page(c, "balance", {"name": F.col("c_name"), "balance": F.col("c_acctbal")}, True, "c_custkey", 30)


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0")
def student_memberships(spark, d):
    """Active students with their class and school: inner joins, the small sides broadcast by Spark's own check."""
    active = table(spark, d, "customer").filter("c_acctbal > 0")
    return active.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT s_suppkey, s_suppkey + count(l_orderkey) AS activities FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def activity_counters(spark, d):
    """Counters (the key stands for the old value) after all increments, added up at once."""
    more = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "supplier").select("s_suppkey").join(more, "s_suppkey", "left").select("s_suppkey", (F.col("s_suppkey") + F.coalesce("n", F.lit(0))).alias("activities"))


@query("""WITH m AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT day, event_type, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS change FROM m""")
def metric_snapshots(spark, d):
    """A snapshot of each metric a day, with its change since the one before."""
    m = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return m.withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy("event_type").orderBy("day")))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, min(o_orderdate) AS first_at FROM orders GROUP BY 1")
def first_orders(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"), F.min("o_orderdate").alias("first_at"))
