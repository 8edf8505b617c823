"""Calendar indicators, tasks, histograms and star-schema queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators.lexical import top_k
from corpusmill.plans.registry import query
from corpusmill.sources.tables import table


@query("""SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def period_kpis(spark: SparkSession, d: str) -> DataFrame:
    week = F.date_trunc("week", "ts").cast("date")
    return table(spark, d, "events").groupBy(week.alias("week"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT event_type, least(7, greatest(0, floor(epoch(ts - TIMESTAMP '2024-01-01') / (30 * 86400 / 8.0))))::INT AS bin, count(*) AS n FROM events GROUP BY ALL""")
def period_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Eight bins of a 30-day period, ends clamped."""
    since = F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    bin_ = F.least(F.lit(7), F.greatest(F.lit(0), F.floor(since / (30 * 86400 / 8.0)))).cast("int")
    return table(spark, d, "events").groupBy("event_type", bin_.alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT unnest(generate_series(DATE '1996-03-01', DATE '1996-03-14', INTERVAL 1 DAY))::DATE AS day)
SELECT day, coalesce(sum(l_quantity), 0) AS load, count(l_orderkey) AS tasks FROM s LEFT JOIN lineitem ON l_shipdate::DATE = day GROUP BY day""")
def daily_load_spine(spark: SparkSession, d: str) -> DataFrame:
    """Every day of two weeks, with or without load."""
    first, last = F.lit("1996-03-01").cast("date"), F.lit("1996-03-14").cast("date")
    spine = spark.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    due = table(spark, d, "lineitem").where("l_shipdate >= '1996-03-01' AND l_shipdate < '1996-03-15'")
    load = due.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return spine.join(load, "day", "left").select("day", F.coalesce("q", F.lit(0.0)).alias("load"), F.coalesce("n", F.lit(0)).cast("long").alias("tasks"))


@query("""SELECT (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS important, (o_orderdate < TIMESTAMP '1996-01-01') AS urgent, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL""")
def task_quadrants(spark: SparkSession, d: str) -> DataFrame:
    important = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    urgent = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return table(spark, d, "orders").where("o_orderstatus <> 'F'").groupBy(important.alias("important"), urgent.alias("urgent")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT o_orderpriority, count(*) AS tasks, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1996-06-01') AS overdue,
round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS rate FROM orders GROUP BY 1""")
def completion_rate(spark: SparkSession, d: str) -> DataFrame:
    done = F.count_if(F.col("o_orderstatus") == "F")
    late = (F.col("o_orderstatus") != "F") & (F.col("o_orderdate") < F.lit("1996-06-01").cast("timestamp_ntz"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("tasks"), done.alias("done"), F.count_if(late).alias("overdue"), F.round(done / F.count("*"), 4).alias("rate"))


@query("""WITH r AS (SELECT o_custkey, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN date_diff('day', a, b) <= 31 THEN 'day' WHEN date_diff('day', a, b) <= 180 THEN 'week' ELSE 'month' END AS granularity, n FROM r""")
def timeline_granularity(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"), F.count("*").alias("n"))
    days = F.datediff("b", "a")
    return r.select("o_custkey", F.when(days <= 31, "day").when(days <= 180, "week").otherwise("month").alias("granularity"), "n")


@query("""WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 3 AS f, (o_orderkey % 7)::INT AS wd, (o_orderkey % 28 + 1)::INT AS md FROM orders),
c AS (SELECT o_orderkey, d + k::INT AS day FROM t, generate_series(1, 40) s(k) WHERE f = 0 OR (f = 1 AND isodow(d + k::INT) - 1 = wd) OR (f = 2 AND day(d + k::INT) = md))
SELECT o_orderkey, min(day) AS next_due FROM c GROUP BY 1""")
def recurrence_next_due(spark: SparkSession, d: str) -> DataFrame:
    """The next day after the last that a daily, weekly or monthly rule meets."""
    t = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), (F.col("o_orderkey") % 3).alias("f"), (F.col("o_orderkey") % 7).alias("wd"), (F.col("o_orderkey") % 28 + 1).alias("md"))
    meets = lambda day: (F.col("f") == 0) | ((F.col("f") == 1) & (F.weekday(day) == F.col("wd"))) | ((F.col("f") == 2) & (F.dayofmonth(day) == F.col("md")))
    due = F.array_min(F.filter(F.sequence(F.date_add("d", 1), F.date_add("d", 40)), meets))
    return t.select("o_orderkey", due.alias("next_due")).where("next_due IS NOT NULL").groupBy("o_orderkey").agg(F.min("next_due").alias("next_due"))



@query("""SELECT lang, source, count(*) AS n, grouping_id(lang, source)::BIGINT AS level FROM documents GROUP BY CUBE (lang, source)""")
def cube_lang_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("""SELECT tag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderstatus = 'F' THEN 'done' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END, CASE WHEN o_orderkey % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS tag FROM orders) GROUP BY tag""")
def overlapping_groups(spark: SparkSession, d: str) -> DataFrame:
    """Four groups that overlap: an order counts in each it fits."""
    tags = F.array_compact(F.array(
        F.when(F.col("o_totalprice") > 200000, "large"), F.when(F.col("o_orderstatus") == "F", "done"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "urgent"), F.when(F.col("o_orderkey") % 2 == 0, "even"),
    ))
    return table(spark, d, "orders").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("""SELECT ts::DATE AS day, count(*) AS n, sum(count(*)) OVER (ORDER BY ts::DATE ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS n7 FROM events GROUP BY 1""")
def sliding_week(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts and the sum of the last seven rows; the window holds one row a day."""
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return daily.withColumn("n7", F.sum("n").over(Window.orderBy("day").rowsBetween(-6, 0)))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, session""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events with gaps of at most six hours."""
    w = Window.partitionBy("user_id").orderBy("ts")
    gap = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 6 HOURS"), 0).otherwise(1)
    s = table(spark, d, "events").select("user_id", "ts", gap.alias("new")).withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n")).drop("session")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def star_pricing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT r_name, n_name, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def star_region_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Totals by nation, region and overall; the small tables broadcast by size."""
    customers = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, d, "orders").join(customers.select("c_custkey", "r_name", "n_name"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.rollup("r_name", "n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def star_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return table(spark, d, "customer").select("c_custkey").join(orders.where("o_totalprice > 250000"), "c_custkey", "left_semi").join(orders.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti")


@query("""SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 3""")
def star_top_orders(spark: SparkSession, d: str) -> DataFrame:
    return top_k(table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"), "o_totalprice"), 3, ["o_custkey"], F.desc("o_totalprice"), "o_orderkey").drop("o_totalprice")


@query("""SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1""")
def star_set_operations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"))
    return c.intersect(s).subtract(table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("key")))
