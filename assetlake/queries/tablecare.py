"""Table care: compaction, constraints, statistics, layout, impact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.operators import care
from assetlake.operators.frames import group_quantiles
from assetlake.operators.graph import impact as downstream
from assetlake.operators.packing import compact_small as pack_small
from assetlake.plans import sketches as sk
from assetlake.queries import query
from assetlake.session import work_path
from assetlake.tables import table

_ORDERS_SQL = "select o_orderkey, o_custkey, o_totalprice, o_orderdate from orders"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


@query("compact", "select l_orderkey, l_linenumber, l_suppkey, l_extendedprice from lineitem")
def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines scattered over many small files, then rewritten as few."""
    scattered, dense = work_path(spark, "scattered"), work_path(spark, "dense")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    lines.repartition("l_orderkey").write.parquet(scattered)
    return spark.read.schema(lines.schema).parquet(care.compact(spark, scattered, dense))


@query("compact_small", "select l_orderkey, l_linenumber, l_extendedprice, l_returnflag from lineitem")
def compact_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of one large file and many small ones a folder; the small ones are packed in place."""
    path = work_path(spark, "mixed")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    early = F.col("l_orderkey") % 4 != 0
    lines.filter(early).hint("rebalance", "l_returnflag").write.partitionBy("l_returnflag").parquet(path)
    lines.filter(~early).repartition(16, "l_orderkey").write.mode("append").partitionBy("l_returnflag").parquet(path)
    pack_small(spark, path, ("l_returnflag",), target_bytes=8 << 20, small_bytes=1 << 20)
    return spark.read.schema(lines.schema).parquet(path)


@query("run_sketches", """
    select 'o_custkey' as column, count(distinct o_custkey) as keys, quantile_disc(o_custkey, 0.5) as median, true as rank_within, true as keys_within,
        true as common_within from orders
    union all select 'cents', count(distinct cents), quantile_disc(cents, 0.5), true, true, true
    from (select cast(round(o_totalprice * 100) as bigint) as cents from orders)
""")
def run_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches per year and status are logged with a run and merged; exact values beside them show that they hold."""
    root, columns = work_path(spark, "lake"), ["o_custkey", "cents"]
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), F.concat_ws("/", F.year("o_orderdate"), "o_orderstatus").alias("part")
    )
    sk.log_sketches(spark, root, "run-1", "orders", sk.partition_sketches(orders, "part", columns))
    logged = sk.read_sketches(spark, root, "orders")
    whole, done = sk.merged(logged), F.col("part").endswith("/F")
    median = sk.quantiles(whole, [0.5]).select("column", F.col("value").alias("about"))
    common = sk.overlap(sk.merged(logged.filter(done)), sk.merged(logged.filter(~done))).select("column", "all_keys", "common_keys")
    values = orders.select(done.alias("done"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])))
    per_value = values.groupBy("column", "value").agg(F.count("*").alias("n"), F.max("done").alias("f"), F.min("done").alias("all_f"))
    exact = group_quantiles(values, ["column"], "value", [0.5]).select("column", F.col("value").alias("median"))
    counts = per_value.join(median, "column").groupBy("column").agg(
        F.count("*").alias("keys"), F.count_if(F.col("f") & ~F.col("all_f")).alias("common"), F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value") < F.col("about"), F.col("n")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("value") <= F.col("about"), F.col("n")).otherwise(0)).alias("upto"),
    )
    seen = counts.join(exact, "column").join(common, "column")
    # The rank of the estimate is a stretch where values repeat; one half must be within the bound of it.
    rank = (F.col("below") <= (0.5 + sk.RANK_ERROR) * F.col("rows")) & (F.col("upto") >= (0.5 - sk.RANK_ERROR) * F.col("rows"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= sk.COUNT_ERROR * F.col("keys")
    return seen.select("column", "keys", "median", rank.alias("rank_within"), near("all_keys", "keys").alias("keys_within"), near("common_keys", "common").alias("common_within"))


@query("layout_sort", _ORDERS_SQL)
def layout_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "sorted")
    orders = _orders(spark, sf_dir)
    care.layout_sort(orders, ["o_orderdate", "o_custkey"]).write.parquet(path)
    return spark.read.schema(orders.schema).parquet(path)


@query("layout_zorder", _ORDERS_SQL)
def layout_zorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "zorder")
    orders = _orders(spark, sf_dir)
    care.layout_zorder(orders, ["o_orderdate", "o_custkey"]).write.parquet(path)
    return spark.read.schema(orders.schema).parquet(path)


@query("bloom_filters", _ORDERS_SQL)
def bloom_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "bloom")
    orders = _orders(spark, sf_dir)
    orders.write.options(**care.bloom_filter_options(["o_custkey"])).parquet(path)
    return spark.read.schema(orders.schema).parquet(path)


@query("constraint_check", """
    select 'known type' as rule, count(*) filter (where event_type in ('click', 'view')) as ok,
        count(*) filter (where not event_type in ('click', 'view')) as bad from events
    union all select 'has user', count(*) filter (where user_id is not null), count(*) filter (where user_id is null) from events
    union all select 'value range', count(*) filter (where value between 0 and 20), count(*) filter (where not value between 0 and 20) from events
""")
def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return care.constraint_counts(table(spark, sf_dir, "events"), {
        "known type": care.allowed("event_type", ["click", "view"]),
        "has user": care.not_null("user_id"),
        "value range": care.between("value", 0, 20),
    })


@query("constraint_quarantine", """
    select event_id, concat_ws(', ', case when event_type not in ('click', 'view') then 'known type' end,
        case when not value between 0 and 20 then 'value range' end) as broken
    from events where event_type not in ('click', 'view') or not value between 0 and 20
""")
def constraint_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = care.constraint_split(table(spark, sf_dir, "events"), {
        "known type": care.allowed("event_type", ["click", "view"]), "value range": care.between("value", 0, 20),
    })
    return bad.select("event_id", F.concat_ws(", ", "broken").alias("broken"))


@query("file_stats", """
    select o_orderstatus as part, count(*) as n, min(o_orderkey) as o_orderkey_lo, max(o_orderkey) as o_orderkey_hi,
        count(*) filter (where o_orderkey is null) as o_orderkey_nulls, min(o_totalprice) as o_totalprice_lo,
        max(o_totalprice) as o_totalprice_hi, count(*) filter (where o_totalprice is null) as o_totalprice_nulls
    from orders group by 1
""")
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return care.column_stats(table(spark, sf_dir, "orders"), "o_orderstatus", ["o_orderkey", "o_totalprice"])


EDGES_SQL = """
    select 'region/' || n_regionkey as src, 'nation/' || n_nationkey as dst from nation
    union all select 'nation/' || c_nationkey, 'customer/' || c_custkey from customer
    union all select 'nation/' || s_nationkey, 'supplier/' || s_suppkey from supplier
    union all select 'customer/' || o_custkey, 'order/' || o_orderkey from orders
    union all select 'supplier/' || l_suppkey, 'order/' || l_orderkey from lineitem
"""


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as edges: region, nation, customer or supplier, order."""
    links = [
        ("nation", "region", "n_regionkey", "nation", "n_nationkey"),
        ("customer", "nation", "c_nationkey", "customer", "c_custkey"),
        ("supplier", "nation", "s_nationkey", "supplier", "s_suppkey"),
        ("orders", "customer", "o_custkey", "order", "o_orderkey"),
        ("lineitem", "supplier", "l_suppkey", "order", "l_orderkey"),
    ]
    edges = [
        table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{src}/"), F.col(src_key)).alias("src"), F.concat(F.lit(f"{dst}/"), F.col(dst_key)).alias("dst")
        )
        for name, src, src_key, dst, dst_key in links
    ]
    return reduce(DataFrame.unionByName, edges)


@query("impact", f"""
    with recursive e as ({EDGES_SQL}), r(node, depth) as (
        select dst, 1 from e where src in (select 'region/' || r_regionkey from region where r_name = 'ASIA')
        union select e.dst, r.depth + 1 from r join e on r.node = e.src)
    select node, cast(min(depth) as bigint) as depth from r group by node
""")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "region").filter("r_name = 'ASIA'").select(
        F.concat(F.lit("region/"), F.col("r_regionkey")).alias("node")
    )
    return downstream(lineage_edges(spark, sf_dir), roots)
