"""Plain Spark over the star schema: one transform per kind of relational work.

There is no wrapper round joins or aggregates. What the transforms show is how to
write them so that a key with very many rows does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assetlake.operators.frames import group_quantiles, range_totals
from assetlake.operators.intervals import interval_join
from assetlake.operators.ordered import as_of_join, number_rows, rank_rows, sessions, with_frames
from assetlake.queries import query
from assetlake.session import stored, with_conf, work_path
from assetlake.sources.bucketed import bucket_count, write_bucketed
from assetlake.tables import register_views, table

MONEY = "decimal(18,2)"


@query("rel_agg", """
    select l_returnflag, l_linestatus, sum(cast(l_extendedprice as decimal(18,2))) as total, count(*) as n,
        count(distinct l_suppkey) as supps from lineitem group by 1, 2
""")
def rel_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Few groups and many rows: first per supplier, then per group. The distinct count becomes a plain count.
    lines = table(spark, sf_dir, "lineitem")
    per_supplier = lines.groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(
        F.sum(F.col("l_extendedprice").cast(MONEY)).alias("total"), F.count("*").alias("n")
    )
    return per_supplier.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("total").cast("decimal(38,2)").alias("total"), F.sum("n").alias("n"), F.count("l_suppkey").alias("supps")
    )


@query("rel_approx_distinct", """
    select l_returnflag, count(distinct l_partkey) as parts, true as within_5pct from lineitem group by 1
""")
def rel_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    # The sketch is checked against the exact count, so both are computed: one sketch per task and flag, and the pairs.
    about = lines.groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("about"))
    exact = lines.select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(F.count("l_partkey").alias("parts"))
    both = exact.join(about.withColumnRenamed("l_returnflag", "_flag"), F.col("l_returnflag").eqNullSafe(F.col("_flag")))
    close = F.abs(F.col("about") - F.col("parts")) <= 0.05 * F.col("parts")
    return both.select("l_returnflag", "parts", close.alias("within_5pct"))


@query("rel_cube", """
    select o_orderstatus, o_orderpriority, count(*) as n, grouping(o_orderstatus) as g
    from orders group by cube(o_orderstatus, o_orderpriority)
""")
def rel_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    cubed = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority")
    return cubed.agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("bigint").alias("g"))


@query("rel_rollup", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup(o_orderstatus, o_orderpriority)")
def rel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("rel_grouping_sets", """
    select o_orderstatus, year(o_orderdate) as y, count(*) as n from orders
    group by grouping sets ((o_orderstatus), (year(o_orderdate)), ())
""")
def rel_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.year("o_orderdate").cast("bigint").alias("y"))
    sets = [[F.col("o_orderstatus")], [F.col("y")], []]
    return rows.groupingSets(sets, "o_orderstatus", "y").agg(F.count("*").alias("n"))


@query("rel_pivot", """
    select o_orderstatus, count(*) filter (where o_orderpriority = '1-URGENT') as urgent,
        count(*) filter (where o_orderpriority = '5-LOW') as low from orders group by 1
""")
def rel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivoted = table(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"])
    counted = pivoted.agg(F.count(F.lit(1)))
    return counted.select(
        "o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low")
    )


@query("rel_window", """
    select o_orderkey, rank() over (partition by o_custkey order by o_orderdate) as rk,
        lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as prev,
        sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey order by o_orderdate, o_orderkey
            rows between 2 preceding and current row) as mov from orders
""")
def rel_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")

    def looking_back(group: list[str], order: list[str]) -> dict:
        w = Window.partitionBy(*group).orderBy(*order)
        moving = F.sum(F.col("o_totalprice").cast(MONEY)).over(w.rowsBetween(-2, 0))
        return {"prev": F.lag("o_orderkey").over(w), "mov": moving.cast("decimal(38,2)")}

    ranked = rank_rows(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"])
    framed = with_frames(ranked, ["o_custkey"], ["o_orderdate", "o_orderkey"], 2, looking_back)
    return framed.select("o_orderkey", "rk", "prev", "mov")


@query("rel_topk", """
    select c_custkey, n from (select o_custkey as c_custkey, count(*) as n from orders group by 1) t
    order by n desc, c_custkey limit 10
""")
def rel_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "c_custkey").limit(10)


@query("rel_topk_group", """
    select o_orderstatus, o_orderkey, rn from (select o_orderstatus, o_orderkey,
        row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as rn from orders) where rn <= 5
""")
def rel_topk_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The rank limit is applied in every task before the shuffle, so three groups are no bottleneck.
    best = Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(best)).filter("rn <= 5")
    return ranked.select("o_orderstatus", "o_orderkey", F.col("rn").cast("bigint").alias("rn"))


_BUYERS = "select o_custkey as k from orders where o_orderpriority = '1-URGENT'"
_RICH = "select c_custkey as k from customer where c_acctbal > 0"


@query("rel_setops", " union all ".join(
    f"select '{label}' as op, k from ({_BUYERS} {op} {_RICH})"
    for label, op in [("union", "union"), ("intersect", "intersect"), ("except", "except"),
                      ("union all", "union all"), ("intersect all", "intersect all"), ("except all", "except all")]
))
def rel_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    b = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    results = {
        "union": a.unionByName(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b),
        "union all": a.unionByName(b), "intersect all": a.intersectAll(b), "except all": a.exceptAll(b),
    }
    parts = [df.select(F.lit(op).alias("op"), "k") for op, df in results.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("rel_semi_anti", """
    select 'large' as kind, o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 49)
    union all
    select 'empty', o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)
""")
def rel_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One pass over the lines: an order with very many lines counts once in the join,
    # and the join reuses the partitioning of the grouping.
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    used = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.coalesce(F.bool_or(F.col("l_quantity") > 49), F.lit(False)).alias("large"))
    found = orders.join(used, "o_orderkey", "left")  # an unknown quantity is not large, but it is a line
    kind = F.when(F.col("large"), "large").when(F.col("large").isNull(), "empty")
    return found.select(kind.alias("kind"), "o_orderkey").where("kind is not null")


@query("rel_asof", """
    select e.event_id, v.event_id as view_id, v.value as view_value from events e
    asof left join (select * from events where event_type = 'view') v on e.user_id = v.user_id and e.ts >= v.ts
""")
def rel_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the last view of its user up to that moment."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    views = events.filter("event_type = 'view'").select(
        "user_id", F.col("ts").alias("at"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value")
    )
    left = events.select("event_id", "user_id", "ts")
    joined = as_of_join(left, views, ["user_id"], "ts", "at", ["view_id"], ["view_id", "view_value"])
    return joined.select("event_id", "view_id", "view_value")


@query("rel_interval_join", """
    select o_orderkey, o_totalprice, l_linenumber, l_shipdate, l_quantity from orders join lineitem on l_orderkey = o_orderkey
    and l_shipdate < o_orderdate + interval '900' day and o_orderdate < l_shipdate + to_days(l_quantity::int)
""")
def rel_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, open for 900 days, with their lines under way, a day for each piece, at a time when the order is open."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), "o_orderkey", "o_totalprice", "o_orderdate", (F.col("o_orderdate") + F.expr("interval 900 days")).alias("closed")
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), "l_linenumber", "l_shipdate", "l_quantity",
        (F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int"))).alias("received"),
    )
    pairs = interval_join(orders, lines, ("o_orderdate", "closed"), ("l_shipdate", "received"), ["k"])
    return pairs.select("o_orderkey", "o_totalprice", "l_linenumber", "l_shipdate", "l_quantity")


@query("rel_range_join", """
    select b.band, count(*) as n from part p
    join (select 0 as band, 0 as lo, 10 as hi union all select 1, 10, 25 union all select 2, 25, 1000) b
    on p.p_size >= b.lo and p.p_size < b.hi group by b.band
""")
def rel_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Three bands by definition, so the broadcast cannot grow with the data.
    bands = spark.createDataFrame([(0, 0, 10), (1, 10, 25), (2, 25, 1000)], "band int, lo int, hi int")
    parts = table(spark, sf_dir, "part").select("p_size")
    joined = parts.join(F.broadcast(bands), (F.col("p_size") >= F.col("lo")) & (F.col("p_size") < F.col("hi")))
    return joined.groupBy("band").agg(F.count("*").alias("n"))


@query("rel_join_kinds", """
    select coalesce(c.c_custkey, o.o_custkey) as k, count(o.o_orderkey) as n, count(c.c_custkey) as m
    from (select * from customer where c_mktsegment = 'BUILDING') c
    full outer join (select * from orders where o_orderpriority = '1-URGENT') o on c.c_custkey = o.o_custkey group by 1
""")
def rel_join_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders are counted per customer before the join; a full outer join cannot split a hot key.
    customers = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    per_customer = orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    both = customers.join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "full_outer")
    n = F.coalesce("n", F.lit(0))
    return both.select(
        F.coalesce("c_custkey", "o_custkey").alias("k"), n.alias("n"),
        F.when(F.col("c_custkey").isNotNull(), F.greatest(n, F.lit(1))).otherwise(0).cast("bigint").alias("m"),
    )


@query("rel_join_rows", """
    select l_orderkey, l_linenumber, l_quantity, o_orderstatus, c_mktsegment from lineitem
    left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey
""")
def rel_join_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Customers go to the orders first, so the lines are shuffled once; AQE splits a hot order.
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    known = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    joined = lines.join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", "l_quantity", "o_orderstatus", "c_mktsegment")


@query("rel_broadcast", """
    select r.r_name, n.n_name, count(*) as n, sum(cast(c.c_acctbal as decimal(18,2))) as bal from customer c
    join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by 1, 2
""")
def rel_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation and region have 25 and 5 rows at every scale. Customers are summed up per nation before the join.
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast(MONEY)).cast("decimal(38,2)").alias("bal")
    )
    places = table(spark, sf_dir, "nation").join(
        F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    joined = customers.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("r_name", "n_name", "n", "bal")


@query("rel_recursive", """
    with recursive r as (
        select conv_id, turn, length(text) as chars from conversations where turn = 0
        union all select c.conv_id, c.turn, r.chars + length(c.text) from r
        join conversations c on c.conv_id = r.conv_id and c.turn = r.turn + 1)
    select conv_id, turn, chars from r
""")
def rel_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters said up to each turn, walked turn by turn."""
    return conversation_sizes(spark, table(spark, sf_dir, "conversations"))


def conversation_sizes(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    conversations.createOrReplaceTempView("conversations")
    levels = (conversations.agg(F.max("turn")).first()[0] or 0) + 2
    with with_conf(spark, {"spark.sql.cteRecursionRowLimit": "-1"}):  # evaluated inside, as the limit is read then
        return stored(_walked(spark, levels), "turns")


def _walked(spark: SparkSession, levels: int) -> DataFrame:
    return spark.sql(f"""
        with recursive turns as (select conv_id, turn, cast(length(text) as bigint) as size from conversations),
        r(conv_id, turn, chars) max recursion level {levels} as (
            select conv_id, turn, size from turns where turn = 0
            union all select t.conv_id, t.turn, r.chars + t.size from r
            join turns t on t.conv_id = r.conv_id and t.turn = r.turn + 1)
        select conv_id, turn, chars from r
    """)


@query("rel_subquery", """
    select o_orderkey from orders o where o_totalprice > (select avg(o2.o_totalprice) from orders o2 where o2.o_custkey = o.o_custkey)
        and o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')
""")
def rel_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ("orders", "customer"))
    return spark.sql("""
        select o_orderkey from orders o
        where o_totalprice > (select avg(o2.o_totalprice) from orders o2 where o2.o_custkey = o.o_custkey)
            and o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')
    """)


@query("rel_sliding", """
    select slot, count(*) as n from (select unnest([time_bucket(interval '1 hour', ts, timestamp '1970-01-01'),
        time_bucket(interval '1 hour', ts, timestamp '1970-01-01') - interval '1 hour']) as slot from events) t group by 1
""")
def rel_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Counted per hour first; only the counts are copied into the windows they belong to.
    hours = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("hour")).agg(F.count("*").alias("n"))
    hours = hours.select(F.col("hour.start").alias("hour"), "n")
    slots = hours.groupBy(F.window("hour", "2 hours", "1 hour").alias("slot")).agg(F.sum("n").alias("n"))
    return slots.select(F.col("slot.start").alias("slot"), "n")


@query("rel_session", """
    select user_id, cast(sid as bigint) as sid, count(*) as n from (select *, sum(b) over (partition by user_id order by ts, event_id) sid from (
        select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30' minute
            then 0 else 1 end b from events)) group by 1, 2
""")
def rel_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "30 minutes")
    return found.select("user_id", F.col("sid").cast("bigint").alias("sid"), "n")


@query("large_group_numbers", """
    select event_id, row_number() over (partition by event_type order by ts, event_id) as seq from events
""")
def large_group_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return number_rows(events, ["event_type"], ["ts", "event_id"], "seq").select("event_id", "seq")


@query("large_group_ranks", """
    select event_id, rank() over (partition by event_type order by cast(ts as date)) as rk from events
""")
def large_group_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five groups hold all events, and all events of a day tie."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.to_date("ts").alias("day"))
    return rank_rows(events, ["event_type"], "day", ["event_id"]).select("event_id", "rk")


@query("large_group_frames", """
    select event_id, lag(event_id) over w as prev, sum(cast(value as decimal(18,2))) over (
        partition by event_type order by ts, event_id rows between 2 preceding and current row) as mov
    from events window w as (partition by event_type order by ts, event_id)
""")
def large_group_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    def looking_back(group: list[str], order: list[str]) -> dict:
        w = Window.partitionBy(*group).orderBy(*order)
        moving = F.sum(F.col("value").cast(MONEY)).over(w.rowsBetween(-2, 0))
        return {"prev": F.lag("event_id").over(w), "mov": moving.cast("decimal(38,2)")}

    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    framed = with_frames(events, ["event_type"], ["ts", "event_id"], 2, looking_back)
    return framed.select("event_id", "prev", "mov")


@query("large_group_range_frames", """
    select event_id, count(*) over w as n, min(value) over w as least, sum(cast(value as decimal(18,2))) over w as total from (
        select *, event_type in ('click', 'view', 'purchase') as grp, datediff('second', timestamp '2024-01-01', date_trunc('second', ts)) as sec from events)
    window w as (partition by grp order by sec range between 7200 preceding and current row)
""")
def large_group_range_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two hours of more than half of all events at once: a frame by time and not by rows."""
    at = F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    grp = F.col("event_type").isin("click", "view", "purchase")
    events = table(spark, sf_dir, "events").select("event_id", "value", grp.alias("grp"), at.alias("at"))
    totals = {"n": ("count", F.lit(1)), "least": ("min", F.col("value")), "total": ("sum", F.col("value").cast(MONEY))}
    framed = range_totals(events, ["grp"], "at", 7_200, totals)
    return framed.select("event_id", "n", "least", F.col("total").cast("decimal(38,2)").alias("total"))


_QUANTILES = (0.01, 0.25, 0.5, 0.9, 0.99)


@query("large_group_quantiles", " union all ".join(f"""
    select half, {f}::double as fraction, quantile_disc(cents, {f}) as cents from (
        select l_suppkey % 2 = 0 as half, cast(round(l_extendedprice * 100) as bigint) as cents from lineitem) group by half""" for f in _QUANTILES))
def large_group_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of two groups that hold half of all lines each."""
    lines = table(spark, sf_dir, "lineitem")
    cents = lines.select((F.col("l_suppkey") % 2 == 0).alias("half"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    return group_quantiles(cents, ["half"], "cents", _QUANTILES)


@query("rel_bucket_join", """
    select o_orderkey, o_orderstatus, count(*) as n, sum(cast(l_extendedprice as decimal(18,2))) as total
    from orders join lineitem on o_orderkey = l_orderkey group by 1, 2
""")
def rel_bucket_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables are stored by order; join and sums then need no shuffle."""
    path = work_path(spark, "bucketed")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    buckets = bucket_count(orders, lines)
    stored_orders = write_bucketed(orders, f"{path}/orders", "o_orderkey", buckets)
    stored_lines = write_bucketed(lines, f"{path}/lines", "l_orderkey", buckets)
    joined = stored_orders.hint("merge").join(stored_lines, F.col("o_orderkey") == F.col("l_orderkey"))
    total = F.sum(F.col("l_extendedprice").cast(MONEY)).cast("decimal(38,2)").alias("total")
    return joined.groupBy("o_orderkey", "o_orderstatus").agg(F.count("*").alias("n"), total)


@query("large_group_sessions", """
    select event_type, cast(sid as bigint) as sid, min(ts) as first_at, max(ts) as last_at, count(*) as n from (
        select *, sum(b) over (partition by event_type order by ts, event_id) sid from (
            select *, case when ts - lag(ts) over (partition by event_type order by ts, event_id) < interval '20' minute
                then 0 else 1 end b from events)) group by 1, 2
""")
def large_group_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(table(spark, sf_dir, "events"), ["event_type"], "ts", "20 minutes")
    return found.select(
        "event_type", F.col("sid").cast("bigint").alias("sid"), F.col("start").alias("first_at"), F.col("end").alias("last_at"), "n"
    )


@query("large_group_asof", """
    select e.event_id, v.event_id as earlier from (select *, 1 as k from events where event_type = 'purchase') e
    asof left join (select *, 1 as k from events where event_type = 'view') v on e.k = v.k and e.ts >= v.ts
""")
def large_group_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the last view of anybody: one key for all rows."""
    events = table(spark, sf_dir, "events").select(F.lit(1).alias("k"), "event_id", "event_type", "ts")
    bought = events.filter("event_type = 'purchase'").drop("event_type")
    seen = events.filter("event_type = 'view'").select("k", F.col("ts").alias("at"), F.col("event_id").alias("earlier"))
    joined = as_of_join(bought, seen, ["k"], "ts", "at", ["earlier"], ["earlier"])
    return joined.select("event_id", "earlier")


@query("rel_scalar_string", """
    select doc_id, upper(lang) as lang, length(text) as chars, n_chars, substr(text, 1, 10) as head,
        replace(source, '_', '-') as src, concat_ws('/', lang, source) as path,
        lpad(cast(doc_id as varchar), 8, '0') as padded from documents
""")
def rel_scalar_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.upper("lang").alias("lang"), F.length("text").cast("bigint").alias("chars"), "n_chars",
        F.substring("text", 1, 10).alias("head"), F.replace("source", F.lit("_"), F.lit("-")).alias("src"),
        F.concat_ws("/", "lang", "source").alias("path"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("padded"),
    )


@query("rel_scalar_date", """
    select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as m, year(o_orderdate) as y,
        date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as d, cast(o_orderdate as date) + 30 as due from orders
""")
def rel_scalar_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.trunc(day, "month").alias("m"), F.year("o_orderdate").cast("bigint").alias("y"),
        F.datediff(day, F.lit("1992-01-01").cast("date")).cast("bigint").alias("d"), F.date_add(day, 30).alias("due"),
    )


@query("rel_scalar_array", """
    select vec_id, len(embedding) as n, embedding[1] as first, list_max(embedding) as mx,
        len(list_filter(embedding, lambda x: x > 0)) as pos from embeddings
""")
def rel_scalar_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size("embedding").cast("bigint").alias("n"), F.element_at("embedding", 1).alias("first"),
        F.array_max("embedding").alias("mx"), F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("pos"),
    )


@query("rel_scalar_map", """
    select c_custkey, map_from_entries([('segment', c_mktsegment), ('name', c_name)])['segment'] as segment,
        round(c_acctbal, 0) as rounded, abs(c_acctbal) as size, floor(c_acctbal / 1000)::bigint as thousands from customer
""")
def rel_scalar_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", facts["segment"].alias("segment"), F.round("c_acctbal", 0).alias("rounded"),
        F.abs("c_acctbal").alias("size"), F.floor(F.col("c_acctbal") / 1000).alias("thousands"),
    )
