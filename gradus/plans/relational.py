"""Registered relational queries with their SQL: (name, query, SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradus.operators import relational as R
from gradus.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Stand-ins: customers are students, nations classes, suppliers teachers, parts subjects, orders evaluations and cases, lineitems manual
#: evaluations and responses, events the activity log, conversations messages.
GRADES = ["F", "O", "P", "X"]
EVENTS = ["click", "error", "purchase", "signup", "view", "logout"]
NOW = "2024-01-31 00:00:00"


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def avg0(column: str):
    return F.round(F.coalesce(F.avg(column), F.lit(0.0)), 4)


@query("""SELECT count(*) AS n_orders, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(DISTINCT o_custkey) AS n_students, round(avg(o_totalprice), 4) AS mean_score,
 max(o_totalprice) AS best, min(o_totalprice) AS worst FROM orders""")
def dash_totals(spark, d):
    o = table(spark, d, "orders")
    return o.agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.countDistinct("o_custkey").alias("n_students"), F.round(F.avg("o_totalprice"), 4).alias("mean_score"), F.max("o_totalprice").alias("best"), F.min("o_totalprice").alias("worst"))


@query("""SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(avg(o_totalprice), 0), 4) AS mean, coalesce(max(o_totalprice), 0) AS best, coalesce(min(o_totalprice), 0) AS worst
 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def student_stats(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("best"), F.min("o_totalprice").alias("worst"))
    c = table(spark, d, "customer").select("c_custkey")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).alias(n)
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", zero("n"), F.round(F.coalesce("mean", F.lit(0.0)), 4).alias("mean"), zero("best"), zero("worst"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p,
 count(*) FILTER (o_orderstatus = 'X') AS n_x FROM orders GROUP BY 1""")
def grade_dist_zero(spark, d):
    return R.zero_filled(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", GRADES)


@query("SELECT coalesce(nullif(o_orderstatus, 'P'), 'unknown') AS grade, count(*) AS n FROM orders GROUP BY 1")
def grade_dist_sparse(spark, d):
    return R.sparse_counts(table(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("grade")), "grade")


@query("""SELECT coalesce(c_mktsegment, 'Unknown') AS subject, round(avg(coalesce(o_totalprice, 0)), 4) AS mean, count(*) AS n
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def subject_performance(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"], "left")
    return joined.groupBy(F.coalesce("c_mktsegment", F.lit("Unknown")).alias("subject")).agg(F.round(F.avg(F.coalesce("o_totalprice", F.lit(0.0))), 4).alias("mean"), F.count("*").alias("n"))


@query("""SELECT subject, mean FROM (SELECT coalesce(c_mktsegment, 'Unknown') AS subject, round(avg(coalesce(o_totalprice, 0)), 4) AS mean
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1) ORDER BY mean, subject LIMIT 3""")
def weakest_three(spark, d):
    return subject_performance(spark, d).select("subject", "mean").orderBy("mean", "subject").limit(3)


@query("""SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS place, round(o_totalprice - lag(o_totalprice) OVER w, 4) AS change
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def score_trend(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("place"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 4).alias("change"))


@query("""SELECT s_suppkey, count(l_orderkey) AS n_items, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_subjects, round(avg(l_extendedprice), 4) AS mean
 FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
def teacher_rollup(spark, d):
    """Aggregated by teacher before the join; each distinct count combines within tasks, so a teacher with many rows is no one task's."""
    li = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    sums = li.groupBy("s_suppkey").agg(F.count("l_orderkey").alias("n_items"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))
    kinds = lambda key, name: li.select("s_suppkey", key).distinct().groupBy("s_suppkey").agg(F.count(key).alias(name))
    found = table(spark, d, "supplier").select("s_suppkey").join(sums, "s_suppkey", "left").join(kinds("l_orderkey", "n_orders"), "s_suppkey", "left").join(kinds("l_partkey", "n_subjects"), "s_suppkey", "left")
    return found.fillna(0, ["n_items", "n_orders", "n_subjects"]).select("s_suppkey", "n_items", "n_orders", "n_subjects", "mean")


@query("""SELECT r_name, count(DISTINCT n_nationkey) AS n_classes, count(c_custkey) AS n_students FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def admin_join_counts(spark, d):
    students = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("students"))
    classes = table(spark, d, "nation").join(students, F.col("c_nationkey") == F.col("n_nationkey"))
    return classes.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.countDistinct("n_nationkey").alias("n_classes"), F.sum("students").alias("n_students"))


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
 ORDER BY (o_orderstatus = 'P') DESC, (o_orderpriority = '1-URGENT') DESC, (o_orderpriority = '2-HIGH') DESC, o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""")
def pinned_order_page(spark, d):
    order = [(F.col("o_orderstatus") == "P").desc(), (F.col("o_orderpriority") == "1-URGENT").desc(), (F.col("o_orderpriority") == "2-HIGH").desc(), F.col("o_orderdate").desc(), F.col("o_orderkey")]
    return R.page(table(spark, d, "orders"), order, 3, 20).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE p_type = 'ECONOMY' AND (p_name ILIKE '%RED%' OR p_brand ILIKE '%RED%') ORDER BY p_name, p_partkey LIMIT 25""")
def search_page(spark, d):
    found = R.filtered(table(spark, d, "part"), {"p_type": "ECONOMY", "p_size": None}, search="RED", search_in=["p_name", "p_brand"])
    return R.page(found, [F.col("p_name"), F.col("p_partkey")], 1, 25).select("p_partkey", "p_name", "p_brand")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def unknown_filter_ignored(spark, d):
    domains = {"o_orderstatus": ["F", "O", "P"]}
    return R.filtered(table(spark, d, "orders"), {"o_orderstatus": "no such status", "o_orderpriority": "1-URGENT"}, domains).select("o_orderkey")


@query("""SELECT o_orderkey, 'teacher' AS role, o_custkey AS viewer FROM orders UNION ALL SELECT o_orderkey, 'teacher', o_orderkey % 100 FROM orders WHERE o_custkey <> o_orderkey % 100 AND o_orderkey % 100 IN (SELECT o_custkey FROM orders)
 UNION ALL SELECT o_orderkey, 'student', o_custkey FROM orders UNION ALL SELECT o_orderkey, 'admin', NULL FROM orders WHERE o_orderpriority = '2-HIGH'""")
def role_scoped_list(spark, d):
    """What each user sees in each role: every customer as student and as teacher, who also sees the assigned cases; an admin the urgent page."""
    cases = table(spark, d, "orders").withColumn("assigned", F.col("o_orderkey") % 100)
    users = cases.select(F.col("o_custkey").alias("viewer")).distinct()
    own = cases.select("o_orderkey", F.col("o_custkey").alias("viewer"))
    assigned = cases.filter("assigned <> o_custkey").select("o_orderkey", F.col("assigned").alias("viewer")).join(users, "viewer", "left_semi").select("o_orderkey", "viewer")
    admin = cases.filter("o_orderpriority = '2-HIGH'").filter(R.visible("admin", 0, "o_custkey")).select("o_orderkey", F.lit(None).cast("long").alias("viewer"))
    named = lambda df, role: df.select("o_orderkey", F.lit(role).alias("role"), "viewer")
    return named(own.unionByName(assigned), "teacher").unionByName(named(own, "student")).unionByName(named(admin, "admin"))


@query("""SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'F') AS n_resolved, count(*) FILTER (o_orderstatus = 'P') AS n_escalated,
 count(*) FILTER (o_orderpriority = '1-URGENT') AS n_urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS n_high, count(*) FILTER (o_orderpriority = '5-LOW') AS n_low FROM orders GROUP BY 1""")
def case_stats(spark, d):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    conditions = {"total": F.lit(True), "n_open": status == "O", "n_resolved": status == "F", "n_escalated": status == "P", "n_urgent": priority == "1-URGENT", "n_high": priority == "2-HIGH", "n_low": priority == "5-LOW"}
    return R.counted_where(table(spark, d, "orders"), ["o_custkey"], conditions)


@query("SELECT category, count(*) AS n FROM (SELECT nullif(nullif(o_orderpriority, '5-LOW'), '') AS category FROM orders) WHERE category IS NOT NULL GROUP BY 1")
def category_counts(spark, d):
    category = F.nullif(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit(""))
    return table(spark, d, "orders").select(category.alias("category")).filter("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'AUTOMOBILE' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL) ORDER BY c_custkey LIMIT 50""")
def available_members(spark, d):
    members = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").filter("c_mktsegment = 'AUTOMOBILE'").join(members, "c_custkey", "left_anti").orderBy("c_custkey").limit(50).select("c_custkey", "c_name")


@query("""SELECT s_suppkey, p_partkey, (s_suppkey, p_partkey) IN (SELECT l_suppkey, l_partkey FROM lineitem) AS is_teaching FROM supplier JOIN part ON s_nationkey = p_size % 25""")
def subjects_mark(spark, d):
    """The subjects of each teacher's school, with a mark on those that the teacher teaches."""
    schools = table(spark, d, "supplier").select(F.col("s_nationkey").alias("school"), "s_suppkey")
    subjects = table(spark, d, "part").select((F.col("p_size") % 25).alias("school"), "p_partkey")
    taught = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))
    return R.marked_pairs(subjects, schools, taught, "school", "p_partkey", "s_suppkey", "is_teaching").select("s_suppkey", "p_partkey", "is_teaching")


@query("""SELECT conv_id, turn, role, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS preview FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) = 1""")
def latest_message(spark, d):
    m = R.top_per_group(table(spark, d, "conversations"), ["conv_id"], [F.col("turn").desc(), F.col("role"), F.col("text")])
    return m.select("conv_id", "turn", "role", R.preview(F.col("text")).alias("preview"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def latest_by_aggregate(spark, d):
    m = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return R.latest(m, ["conv_id"], ["turn"]).select("conv_id", "turn", "role")


@query("""WITH c AS (SELECT user_id, max(event_id) AS cursor FROM events WHERE event_type = 'error' GROUP BY 1)
 SELECT user_id, event_id, event_type FROM events JOIN c USING (user_id) WHERE event_id < cursor AND event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 30""")
def cursor_page(spark, d):
    """The page of each user's log before their cursor: the last error."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    cursor = e.filter("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("cursor"))
    before = e.filter("event_type <> 'error'").join(cursor, "user_id").filter("event_id < cursor")
    return R.top_per_group(before, ["user_id"], [F.col("event_id").desc()], 30).select("user_id", "event_id", "event_type")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_counts(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' GROUP BY 1")
def day_summary(spark, d):
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, d, "events").filter((ts >= F.lit("2024-01-15").cast("timestamp_ntz")) & (ts < F.lit("2024-01-16").cast("timestamp_ntz"))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def metric_trailing_days(spark, d):
    since = F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")
    return table(spark, d, "events").filter(F.col("ts").cast("timestamp_ntz") >= since).select("user_id", "event_id", "value")


@query("""WITH b AS (SELECT c_custkey AS row_no, 'mail' || (c_custkey // 2) AS email, 'r' || (c_custkey % 400) AS roll_no, c_nationkey AS class_id FROM customer),
 e AS (SELECT 'mail' || s_suppkey AS email, 'r' || s_suppkey AS roll_no, s_nationkey AS class_id FROM supplier),
 x AS (SELECT b.*, CASE WHEN email IN (SELECT email FROM e) THEN 'exists: email' WHEN EXISTS (SELECT 1 FROM e WHERE e.roll_no = b.roll_no AND e.class_id = b.class_id) THEN 'exists: roll_no,class_id' END AS there FROM b),
 y AS (SELECT x.*, row_number() OVER (PARTITION BY email, there IS NULL ORDER BY row_no) AS r1, row_number() OVER (PARTITION BY roll_no, class_id, there IS NULL ORDER BY row_no) AS r2 FROM x)
 SELECT row_no, coalesce(there, CASE WHEN r1 > 1 THEN 'repeated: email' WHEN r2 > 1 THEN 'repeated: roll_no,class_id' END) AS reason FROM y""")
def bulk_accept_reject(spark, d):
    batch = table(spark, d, "customer").select(F.col("c_custkey").alias("row_no"), F.concat(F.lit("mail"), F.floor(F.col("c_custkey") / 2)).alias("email"), F.concat(F.lit("r"), F.col("c_custkey") % 400).alias("roll_no"), F.col("c_nationkey").alias("class_id"))
    there = table(spark, d, "supplier").select(F.concat(F.lit("mail"), "s_suppkey").alias("email"), F.concat(F.lit("r"), "s_suppkey").alias("roll_no"), F.col("s_nationkey").alias("class_id"))
    return R.accepted(batch, there, [["email"], ["roll_no", "class_id"]], ["row_no"]).select("row_no", "reason")


@query("""SELECT 'ai' AS kind, o_orderkey AS id, o_custkey AS student, o_totalprice AS score, o_orderdate AS at FROM orders
 UNION ALL SELECT 'manual', l_orderkey, o_custkey, l_extendedprice, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def evaluations_union(spark, d):
    o = table(spark, d, "orders")
    ai = o.select(F.lit("ai").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("student"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("at"))
    manual = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.lit("manual").alias("kind"), F.col("l_orderkey").alias("id"), F.col("o_custkey").alias("student"), F.col("l_extendedprice").alias("score"), F.col("l_shipdate").alias("at"))
    return ai.unionByName(manual)


@query("""SELECT conv_id, number, model, student FROM (SELECT conv_id, turn // 2 AS number, arg_max(length(text), turn) AS model FROM conversations WHERE role = 'user' GROUP BY ALL)
 FULL JOIN (SELECT conv_id, turn // 2 AS number, arg_max(length(text), turn) AS student FROM conversations WHERE role = 'assistant' GROUP BY ALL) USING (conv_id, number)""")
def full_align(spark, d):
    m = table(spark, d, "conversations").select("conv_id", F.expr("turn div 2").alias("number"), "turn", "role", F.char_length("text").alias("chars"))
    return R.full_aligned(m.filter("role = 'user'"), m.filter("role = 'assistant'"), ["conv_id", "number"], "chars", ("model", "student"), "turn")


@query("""WITH w AS (SELECT DISTINCT user_id AS id FROM events UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'), m AS (SELECT c_custkey AS id, c_acctbal > 0 AS active FROM customer WHERE c_mktsegment = 'MACHINERY'), k AS (SELECT c_custkey AS id FROM customer)
 SELECT w.id, CASE WHEN k.id IS NULL THEN 'not_found' WHEN m.id IS NULL THEN 'added' WHEN m.active THEN 'already' ELSE 'reactivated' END AS outcome FROM w LEFT JOIN k ON k.id = w.id LEFT JOIN m ON m.id = w.id""")
def member_upsert(spark, d):
    c = table(spark, d, "customer")
    known = c.select(F.col("c_custkey").alias("id"), F.lit(True).alias("known"))
    members = c.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("active"))
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    wanted = table(spark, d, "events").select(F.col("user_id").alias("id")).unionByName(urgent).distinct()
    outcome = F.when(F.col("known").isNull(), "not_found").when(F.col("active").isNull(), "added").when(F.col("active"), "already").otherwise("reactivated")
    return wanted.join(known, "id", "left").join(members, "id", "left").select("id", outcome.alias("outcome"))


@query("""SELECT event_id, coalesce(r_name, s_name, c_name, 'Unknown') AS sender FROM events LEFT JOIN region ON r_regionkey = user_id AND event_type = 'view' LEFT JOIN supplier ON s_suppkey = user_id AND event_type = 'click'
 LEFT JOIN customer ON c_custkey = user_id AND event_type = 'purchase'""")
def sender_lookup(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    for name, key, label, kind in (("region", "r_regionkey", "r_name", "view"), ("supplier", "s_suppkey", "s_name", "click"), ("customer", "c_custkey", "c_name", "purchase")):
        e = e.join(table(spark, d, name).select(key, label), (F.col(key) == F.col("user_id")) & (F.col("event_type") == kind), "left")
    return e.select("event_id", F.coalesce("r_name", "s_name", "c_name", F.lit("Unknown")).alias("sender"))


@query("""SELECT source, count(*) AS files, sum(n_chars) AS total, round(sum(n_chars) / 1048576.0, 4) AS mb, count(*) FILTER (lang = 'de') AS n_de, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (lang = 'hi') AS n_hi FROM documents GROUP BY 1""")
def storage_stats(spark, d):
    docs = table(spark, d, "documents").select("source", "lang", "n_chars")
    counts = [F.count_if(F.col("lang") == x).alias(f"n_{x}") for x in ("de", "en", "hi")]
    return docs.groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("total"), F.round(F.sum("n_chars") / 1048576.0, 4).alias("mb"), *counts)


@query("""SELECT l_orderkey, round(sum(l_quantity * (1 - l_discount)), 4) AS obtained, sum(l_quantity) AS marks, count(*) FILTER (l_returnflag = 'R') AS answered, count(*) FILTER (l_returnflag <> 'R') AS unanswered,
 round(100 * sum(l_quantity * (1 - l_discount)) / greatest(sum(l_quantity), 1), 4) AS percent FROM lineitem GROUP BY 1""")
def marks_total(spark, d):
    got = F.sum(F.col("l_quantity") * (1 - F.col("l_discount")))
    back = F.col("l_returnflag") == "R"
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(got, 4).alias("obtained"), F.sum("l_quantity").alias("marks"), F.count_if(back).alias("answered"), F.count_if(~back).alias("unanswered"), F.round(100 * got / F.greatest(F.sum("l_quantity"), F.lit(1.0)), 4).alias("percent"))


@query("SELECT conv_id, list_sort(list_distinct(list(substr(text, 1, 80)))) AS suggestions FROM conversations WHERE role <> 'user' GROUP BY 1")
def distinct_suggestions(spark, d):
    return table(spark, d, "conversations").filter("role <> 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_set(F.substring("text", 1, 80))).alias("suggestions"))


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') AS responses FROM orders")
def response_counts(spark, d):
    child = table(spark, d, "lineitem").filter("l_linestatus = 'O'")
    return R.with_child_count(table(spark, d, "orders").select("o_orderkey"), child, "o_orderkey", "l_orderkey", "responses")


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END, 0) AS score FROM orders WHERE coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END, 0) BETWEEN 0 AND 250000 AND lower(o_orderstatus) = 'f'
 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def score_range_list(spark, d):
    o = table(spark, d, "orders").withColumn("score", F.coalesce(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")), F.lit(0.0)))
    found = o.filter(F.col("score").between(0, 250000) & (F.lower("o_orderstatus") == "f"))
    return found.orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(50).select("o_orderkey", "score")


@query("""SELECT c_custkey, coalesce(n, 0) AS evaluations, coalesce(total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def dashboards(spark, d):
    counted = table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("evaluations"), F.round(F.sum("o_totalprice"), 4).alias("total"))
    return table(spark, d, "customer").select("c_custkey").join(counted, "c_custkey", "left").fillna(0, ["evaluations", "total"])


@query("SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS version, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def state_latest(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("version"), F.col("event_type").alias("status"), "value")
    return R.latest(e, ["user_id"], ["version"])


@query("""SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 END DESC, o_orderkey LIMIT 40""")
def grade_rank_sort(spark, d):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2)
    return table(spark, d, "orders").orderBy(rank.desc(), "o_orderkey").limit(40).select("o_orderkey", "o_orderstatus")


@query("""WITH s AS (SELECT event_id, epoch(TIMESTAMP '2024-01-31' - date_trunc('second', ts)) AS sec FROM events)
 SELECT event_id, CASE WHEN sec >= 86400 THEN CAST(floor(sec / 86400) AS BIGINT) || ' day' || CASE WHEN floor(sec / 86400) = 1 THEN '' ELSE 's' END || ' ago'
 WHEN sec >= 3600 THEN CAST(floor(sec / 3600) AS BIGINT) || ' hour' || CASE WHEN floor(sec / 3600) = 1 THEN '' ELSE 's' END || ' ago'
 WHEN sec >= 60 THEN CAST(floor(sec / 60) AS BIGINT) || ' minute' || CASE WHEN floor(sec / 60) = 1 THEN '' ELSE 's' END || ' ago' ELSE 'Just now' END AS label FROM s""")
def relative_time(spark, d):
    return table(spark, d, "events").select("event_id", R.ago(F.col("ts").cast("timestamp"), F.lit(NOW).cast("timestamp")).alias("label"))


@query("SELECT l_orderkey, round(coalesce(sum(l_quantity * l_discount) / nullif(sum(l_quantity), 0), 0), 9) AS mean FROM lineitem GROUP BY 1")
def weighted_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(R.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 9).alias("mean"))


@query("""SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""")
def favourite_event(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return R.top_per_group(counts, ["user_id"], [F.col("n").desc(), F.col("event_type")])


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) > 50) AS big FROM events GROUP BY 1")
def json_props(spark, d):
    k = F.variant_get(F.parse_json("props"), "$.k", "long")
    return table(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.sum("k").alias("k"), F.count_if(F.col("k") > 50).alias("big"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS weight FROM lineitem")
def normalised_weights(spark, d):
    w = Window.partitionBy("l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_quantity") / F.sum("l_quantity").over(w), 6).alias("weight"))


@query("""SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS students, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS teachers,
 (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS evaluations FROM nation""")
def entity_counts(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "orders").select("o_custkey")
    out = table(spark, d, "nation").select("n_nationkey")
    out = R.with_child_count(out, c, "n_nationkey", "c_nationkey", "students")
    out = R.with_child_count(out, table(spark, d, "supplier"), "n_nationkey", "s_nationkey", "teachers")
    return R.with_child_count(out, o.join(c, F.col("o_custkey") == F.col("c_custkey")), "n_nationkey", "c_nationkey", "evaluations")


@query("""WITH x AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), y AS (SELECT user_id, day, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS step FROM x)
 SELECT user_id, count(*) AS days, count(*) FILTER (step = 1) AS consecutive, count(*) FILTER (step IS NULL OR step > 1) AS islands FROM y GROUP BY 1""")
def activity_islands(spark, d):
    days = table(spark, d, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day")).distinct()
    steps = days.withColumn("step", R.running_pairs(days, ["user_id"], "day"))
    return steps.groupBy("user_id").agg(F.count("*").alias("days"), F.count_if(F.col("step") == 1).alias("consecutive"), F.count_if(F.col("step").isNull() | (F.col("step") > 1)).alias("islands"))


@query("""WITH x AS (SELECT conv_id, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations), y AS (SELECT conv_id, count(step) AS steps, count(*) FILTER (step = 1) AS ones, min(step) AS low FROM x GROUP BY 1)
 SELECT conv_id, CASE WHEN steps = 0 THEN 0.2 WHEN ones = steps THEN 0.95 WHEN low > 0 THEN 0.6 + 0.3 * ones / steps ELSE 0.5 END AS confidence FROM y""")
def sequence_confidence(spark, d):
    m = table(spark, d, "conversations").select("conv_id", "turn")
    steps = m.withColumn("step", R.running_pairs(m, ["conv_id"], "turn"))
    y = steps.groupBy("conv_id").agg(F.count("step").alias("steps"), F.count_if(F.col("step") == 1).alias("ones"), F.min("step").alias("low"))
    confidence = F.when(F.col("steps") == 0, 0.2).when(F.col("ones") == F.col("steps"), 0.95).when(F.col("low") > 0, 0.6 + 0.3 * F.col("ones") / F.col("steps")).otherwise(0.5)
    return y.select("conv_id", confidence.alias("confidence"))


@query("""SELECT DISTINCT n_nationkey, n_name FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'MACHINERY' WHERE n_regionkey = 2 OR (c_custkey IS NOT NULL AND c_acctbal > 9800)""")
def my_communities(spark, d):
    member = table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY' AND c_acctbal > 9800").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("member", F.lit(True))
    return table(spark, d, "nation").join(member, "n_nationkey", "left").filter((F.col("n_regionkey") == 2) | F.col("member")).select("n_nationkey", "n_name")


@query("SELECT event_type, count(*) AS n, ceil(count(*) / 20.0)::BIGINT AS pages FROM events GROUP BY 1")
def page_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("pages", R.page_count(F.col("n"), 20))


@query("""SELECT l_orderkey, round(stddev_pop(l_discount), 6) AS spread, round(greatest(0, 1 - stddev_pop(l_discount) / 0.25), 6) AS stability, round(max(abs(l_discount - m)), 6) AS deviation FROM (SELECT *, avg(l_discount) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY 1""")
def score_stability(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_discount")
    mean = F.avg("l_discount").over(Window.partitionBy("l_orderkey"))
    spread = F.stddev_pop("l_discount")
    return li.withColumn("m", mean).groupBy("l_orderkey").agg(F.round(spread, 6).alias("spread"), F.round(F.greatest(F.lit(0.0), 1 - spread / 0.25), 6).alias("stability"), F.round(F.max(F.abs(F.col("l_discount") - F.col("m"))), 6).alias("deviation"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber AS i, l_partkey AS s FROM lineitem), c AS (SELECT a.l_orderkey, sum(sign(b.s - a.s)) AS s, count(*) AS pairs FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.i < b.i GROUP BY 1),
 k AS (SELECT DISTINCT l_orderkey FROM p) SELECT k.l_orderkey, round(coalesce((s / pairs + 1) / 2, 1), 6) AS order_score FROM k LEFT JOIN c USING (l_orderkey)""")
def kendall_order(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("s"))).alias("xs"))
    signs = F.aggregate("xs", F.lit(0.0), lambda acc, a: acc + F.aggregate("xs", F.lit(0.0), lambda q, b: q + F.when(a["i"] < b["i"], F.signum((b["s"] - a["s"]).cast("double"))).otherwise(0.0)))
    pairs = F.aggregate("xs", F.lit(0.0), lambda acc, a: acc + F.aggregate("xs", F.lit(0.0), lambda q, b: q + F.when(a["i"] < b["i"], 1.0).otherwise(0.0)))
    return p.select("l_orderkey", F.round(F.coalesce((F.try_divide(signs, pairs) + 1) / 2, F.lit(1.0)), 6).alias("order_score"))
