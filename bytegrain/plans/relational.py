"""The relational checklist: joins, sets, sorting, dates, maps and JSON over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.joins import asof_join, range_join
from .catalog import query, table


@query("""select e.event_id, (select max(s.event_id) from events s where s.user_id = e.user_id and s.event_type = 'signup' and s.event_id < e.event_id) as signup_id from events e where e.event_type = 'purchase'""")
def join_as_of(spark, sf_dir):
    """As-of: each purchase with the user's latest signup before it."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    signups = events.filter("event_type = 'signup'").select("user_id", "event_id", F.col("event_id").alias("signup_id"))
    return asof_join(events.filter("event_type = 'purchase'").select("user_id", "event_id"), signups, "user_id", "event_id", ["signup_id"], 1 << 16).select("event_id", "signup_id")


@query("select o_orderkey, s_suppkey from orders, supplier where o_orderkey >= s_suppkey * 10 and o_orderkey < s_suppkey * 10 + 25")
def join_range(spark, sf_dir):
    """Range: orders whose key lies in a supplier's interval."""
    intervals = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 10).alias("low"), (F.col("s_suppkey") * 10 + 25).alias("high"))
    return range_join(table(spark, sf_dir, "orders").select("o_orderkey"), intervals, "o_orderkey", "low", "high", 25).select("o_orderkey", "s_suppkey")


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)")
def join_semi(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)")
def join_anti(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("select coalesce(a.k, b.k)::bigint as k, a.n as customers, b.n as suppliers from (select c_nationkey as k, count(*)::bigint as n from customer where c_nationkey < 15 group by 1) a full join (select s_nationkey as k, count(*)::bigint as n from supplier where s_nationkey > 5 group by 1) b on a.k = b.k")
def join_outer(spark, sf_dir):
    a = table(spark, sf_dir, "customer").filter("c_nationkey < 15").groupBy(F.col("c_nationkey").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, sf_dir, "supplier").filter("s_nationkey > 5").groupBy(F.col("s_nationkey").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full").select("k", "customers", "suppliers")


@query("select c_custkey, c_nationkey::bigint as nation, rank from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rank from customer) where rank <= 3")
def top_of_group(spark, sf_dir):
    """Top-k, which is the feature: the three largest balances of each nation; Spark keeps three rows of each group before it shuffles."""
    ranked = table(spark, sf_dir, "customer").withColumn("rank", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).cast("bigint"))
    return ranked.filter("rank <= 3").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("nation"), "rank")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def top_of_all(spark, sf_dir):
    """Sort and limit, which is the feature: the ten dearest orders."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("select 'both' as part, k::bigint as k from (select c_nationkey as k from customer where c_nationkey < 15 intersect select s_nationkey from supplier) union all select 'first', k::bigint from (select c_nationkey as k from customer intersect select n_nationkey from nation except select s_nationkey from supplier where s_nationkey > 3) union all select 'once', k::bigint from (select distinct s_nationkey as k from supplier)")
def set_operations(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("k"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("k"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"))
    parts = {"both": customers.filter("k < 15").intersect(suppliers), "first": customers.intersect(nations).subtract(suppliers.filter("k > 3")), "once": suppliers.distinct()}
    out = None
    for name, frame in parts.items():
        frame = frame.select(F.lit(name).alias("part"), "k")
        out = frame if out is None else out.unionAll(frame)
    return out


@query("select o_orderkey, year(o_orderdate)::bigint as y, quarter(o_orderdate)::bigint as q, dayofyear(o_orderdate)::bigint as d, strftime(o_orderdate + interval 40 day, '%Y-%m-%d') as due, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month, datediff('day', date '1992-01-01', o_orderdate::date)::bigint as days from orders")
def dates(spark, sf_dir):
    day = F.to_date("o_orderdate")
    parts = {"y": F.year(day), "q": F.quarter(day), "d": F.dayofyear(day), "days": F.date_diff(day, F.lit("1992-01-01").cast("date"))}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(c.cast("bigint").alias(k) for k, c in parts.items()), F.date_format(F.date_add(day, 40), "yyyy-MM-dd").alias("due"), F.date_format(F.trunc(day, "month"), "yyyy-MM-dd").alias("month"))


@query("select user_id::bigint as user_id, list_sort(list(event_type)) as kinds, sum(n)::bigint as total, max(case when event_type = 'click' then n end)::bigint as clicks from (select user_id, event_type, count(*) as n from events group by all) group by user_id")
def maps(spark, sf_dir):
    """A map of counts by type for each user, and what it holds."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    made = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return made.select(F.col("user_id").cast("bigint").alias("user_id"), F.array_sort(F.map_keys("m")).alias("kinds"), F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.try_element_at("m", F.lit("click")).alias("clicks"))


@query("""select event_id, json_extract(props, '$.k')::bigint as k, '{"k":' || json_extract(props, '$.k')::bigint || ',"type":"' || event_type || '"}' as made from events""")
def json_in_and_out(spark, sf_dir):
    k = F.from_json("props", "struct<k:bigint>")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("made"))


@query("select o_orderstatus as status, year(o_orderdate)::bigint as y, count(*)::bigint as n, count(distinct o_custkey)::bigint as customers from orders group by rollup (o_orderstatus, year(o_orderdate))")
def rollup_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").cast("bigint").alias("y"), "o_custkey")
    return orders.rollup("status", "y").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("select p_brand, p_type, count(*)::bigint as n, grouping(p_brand)::bigint as g from part group by cube (p_brand, p_type)")
def cube_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").cube("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.grouping("p_brand").cast("bigint").alias("g"))
