"""Relational, window and stream-window forms beyond the ledger's own operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.tables import table
from tidemark.streaming import late

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _money(c: str):
    """Exact sums: cents as decimals, so that any order of adding gives the same."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def _sales(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)


_SALES = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_SUM = "sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total, count(*) AS orders"


@query(f"SELECT n_name, c_mktsegment, {_SUM} {_SALES} GROUP BY ROLLUP (n_name, c_mktsegment)")
def rollup_sales(spark, d):
    return _sales(spark, d).rollup("n_name", "c_mktsegment").agg(_money("o_totalprice").alias("total"), F.count("*").alias("orders"))


@query(f"SELECT c_mktsegment, o_orderstatus, {_SUM} {_SALES} GROUP BY CUBE (c_mktsegment, o_orderstatus)")
def cube_sales(spark, d):
    return _sales(spark, d).cube("c_mktsegment", "o_orderstatus").agg(_money("o_totalprice").alias("total"), F.count("*").alias("orders"))


@query(f"SELECT n_name, o_orderpriority, {_SUM} {_SALES} GROUP BY GROUPING SETS ((n_name), (o_orderpriority), ())")
def grouping_sets_sales(spark, d):
    n, p = F.col("n_name"), F.col("o_orderpriority")
    return _sales(spark, d).groupingSets([[n], [p], []], n, p).agg(_money("o_totalprice").alias("total"), F.count("*").alias("orders"))


@query(f"SELECT n_name, count(*) AS orders {_SALES} GROUP BY 1 HAVING count(*) > (SELECT count(*) / 25.0 FROM orders)")
def having_above_mean(spark, d):
    g = _sales(spark, d).groupBy("n_name").agg(F.count("*").alias("orders"))
    return g.filter(F.col("orders") > table(spark, d, "orders").agg(F.count("*") / 25.0).scalar())


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def intersect_customers(spark, d):
    return table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey").intersect(table(spark, d, "orders").filter("o_totalprice > 200000").select("o_custkey"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def except_customers(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").filter("o_totalprice > 300000").select("o_custkey"))


@query("SELECT DISTINCT entity_id AS id FROM entities UNION SELECT subject_id FROM assertions")
def union_touched(spark, d):
    return table(spark, d, "entities").select(F.col("entity_id").alias("id")).union(table(spark, d, "assertions").select("subject_id")).distinct()


@query("SELECT c_custkey, o_orderkey FROM customer FULL OUTER JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey")
def full_outer_orders(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "full_outer").select("c_custkey", "o_orderkey")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18, 2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE AS sum_price, count(*) AS lines, max(l_discount) AS max_discount
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(_money("l_quantity").alias("sum_qty"), _money("l_extendedprice").alias("sum_price"), F.count("*").alias("lines"), F.max("l_discount").alias("max_discount"))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def pivot_status(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return p.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("""SELECT event_id, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, ntile(4) OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS quarter, first_value(event_id) OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS first_id
 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value DESC)""")
def rank_functions(spark, d):
    w, t = Window.partitionBy("event_type").orderBy(F.desc("value")), Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").select("event_id", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense_rank"), F.ntile(4).over(t).cast("long").alias("quarter"), F.first("event_id").over(t).alias("first_id"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS last_hour, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def range_frames(spark, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-3_600_000_000, 0)
    return table(spark, d, "events").select("event_id", F.count("*").over(w).alias("last_hour"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("previous"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    return late.tumbling(table(spark, d, "events"), "ts", "1 hour", "1 day", "event_type").drop("window_end")


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS window_start, event_type, count(*) AS events FROM events, (SELECT unnest(range(4)) AS k) GROUP BY 1, 2")
def sliding_counts(spark, d):
    return late.sliding(table(spark, d, "events"), "ts", "1 hour", "15 minutes", "event_type")


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
 SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM s GROUP BY user_id, k""")
def session_counts(spark, d):
    return late.sessions(table(spark, d, "events"), "ts", "30 minutes", "user_id")


@query()
def approx_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.hll_sketch_estimate(F.hll_sketch_agg("l_suppkey")).alias("suppliers"), F.percentile_approx("l_extendedprice", [0.5, 0.9], 10_000).alias("price"))


@query("SELECT l_returnflag, quantile_cont(l_quantity, 0.5)::DOUBLE AS median, quantile_cont(l_quantity, 0.9)::DOUBLE AS p90 FROM lineitem GROUP BY 1")
def exact_percentiles(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.5).alias("median"), F.percentile("l_quantity", 0.9).alias("p90"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT s_suppkey, s_name, p_name FROM supplier JOIN (SELECT l_suppkey, arg_max(l_partkey, (n, -l_partkey)) AS pk FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1) ON s_suppkey = l_suppkey JOIN part ON p_partkey = pk")
def top_part_per_supplier(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    best = n.groupBy("l_suppkey").agg(F.max_by("l_partkey", F.struct("n", -F.col("l_partkey"))).alias("p_partkey"))
    return table(spark, d, "supplier").join(best, F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, d, "part"), "p_partkey").select("s_suppkey", "s_name", "p_name")
