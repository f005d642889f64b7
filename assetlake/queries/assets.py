"""Assets over the star schema: composed, materialized, partitioned, backfilled."""

from __future__ import annotations

import pyspark.pandas as ps
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlake.plans.assets import RUN_LOG, Namespace, SourceAsset, TableAsset, backfill, materialize, source
from assetlake.plans.deltas import Rollup, materialize_delta, rollup_table, row_changes
from assetlake.plans.jobs import every, job
from assetlake.plans.runlog import read_runs
from assetlake.queries import query
from assetlake.session import stored, work_path
from assetlake.sources.files import manifest
from assetlake.sources.formats import read_table, write_table
from assetlake.tables import register_views, table


def _source(sf_dir: str, name: str) -> SourceAsset:
    return source(name, load=lambda spark: table(spark, sf_dir, name))


MONEY = T.DecimalType(38, 2)


def revenue_graph(sf_dir: str) -> dict[str, TableAsset]:
    """lineitem -> order revenue -> revenue per nation and year -> share of the year."""
    sales = Namespace("sales")
    money = T.StructType.fromDDL("o_orderkey long, amount decimal(38,2)")
    yearly = T.StructType.fromDDL("n_name string, revenue decimal(38,2), orders long, year long")
    best = T.StructType.fromDDL("year long, n_name string, revenue decimal(38,2)")

    @sales.mart.table(input=_source(sf_dir, "lineitem"), output=money)
    def order_revenue(lineitem: DataFrame) -> DataFrame:
        amount = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast(MONEY)
        return lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(amount.alias("amount"))

    @sales.mart.table(
        input=[order_revenue, _source(sf_dir, "orders"), _source(sf_dir, "customer"), _source(sf_dir, "nation")],
        output=yearly, partition_by=["year"],
    )
    def nation_year(revenue: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
        joined = (
            revenue.join(orders, "o_orderkey")
            .join(customer, orders["o_custkey"] == customer["c_custkey"])
            .join(nation, customer["c_nationkey"] == nation["n_nationkey"])
        )
        year = F.year("o_orderdate").cast("bigint").alias("year")
        return joined.groupBy("n_name", year).agg(F.sum("amount").cast(MONEY).alias("revenue"), F.count("*").alias("orders"))

    @sales.mart.table(input=nation_year, output=best)
    def best_nation(yearly: DataFrame) -> DataFrame:
        top = yearly.groupBy("year").agg(F.max_by(F.struct("n_name", "revenue"), F.struct("revenue", "n_name")).alias("top"))
        return top.select("year", "top.*")

    return {"order_revenue": order_revenue, "nation_year": nation_year, "best_nation": best_nation}


NATION_YEAR_SQL = """
    select n_name, year(o_orderdate) as year, sum(cast(l_extendedprice as decimal(18,2))) as revenue,
        count(distinct o_orderkey) as orders
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey group by 1, 2
"""


@query("asset_from_source", "select l_orderkey as o_orderkey, sum(cast(l_extendedprice as decimal(18,2))) as amount from lineitem group by 1")
def asset_from_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revenue_graph(sf_dir)["order_revenue"].frame(spark)


@query("asset_table", NATION_YEAR_SQL)
def asset_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain as one lazy plan, nothing written."""
    return revenue_graph(sf_dir)["nation_year"].frame(spark)


@query("asset_pandas", "select c_mktsegment, count(*) as n, max(c_acctbal) as top from customer group by 1")
def asset_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transform in the pandas API on Spark; it runs as the same distributed plan."""

    @_source(sf_dir, "customer").table()
    def segments(customer: ps.DataFrame) -> ps.DataFrame:
        grouped = customer.groupby("c_mktsegment", as_index=False).agg(n=("c_custkey", "count"), top=("c_acctbal", "max"))
        return grouped

    return segments.frame(spark)


@query("materialize", f"""
    select year, n_name, revenue from (
        select *, row_number() over (partition by year order by revenue desc, n_name desc) as rn from ({NATION_YEAR_SQL}))
    where rn = 1
""")
def materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_path(spark, "assets")
    best = revenue_graph(sf_dir)["best_nation"]
    materialize(spark, root, [best], branch="dev")
    return best.read(spark, root, "dev")


@query("asset_sql", f"select year, sum(revenue) as revenue, count(*) as nations from ({NATION_YEAR_SQL}) group by year")
def asset_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL text over a materialized asset, under its view name."""
    materialize(spark, work_path(spark, "assets"), [revenue_graph(sf_dir)["nation_year"]])
    return spark.sql("""
        select year, cast(sum(revenue) as decimal(38,2)) as revenue, count(*) as nations
        from sales__mart__nation_year group by year
    """)


@query("run_log", f"""
    select 'sales.mart.order_revenue' as asset, 'main' as branch, count(distinct l_orderkey) as rows from lineitem
    union all select 'sales.mart.nation_year', 'main', count(*) from ({NATION_YEAR_SQL})
""")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run says it has written, counted while it wrote."""
    root = work_path(spark, "assets")
    materialize(spark, root, [revenue_graph(sf_dir)["nation_year"]])
    return read_runs(spark, f"{root}/{RUN_LOG}").select("asset", "branch", "rows")


@query("backfill", NATION_YEAR_SQL)
def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years recomputed in place; the table then equals a full run."""
    root = work_path(spark, "assets")
    yearly = revenue_graph(sf_dir)["nation_year"]
    materialize(spark, root, [yearly])
    backfill(spark, root, yearly, [{"year": 1996}, {"year": 1997}])
    return yearly.read(spark, root)


LINES = Rollup(
    by={"l_suppkey": "l_suppkey", "year": "year(l_shipdate)"}, sums={"amount": "cast(l_extendedprice as decimal(18,2))"},
    counts={"taxed": "nullif(l_tax, 0)"}, mins={"first_shipped": "l_shipdate", "least": "l_quantity"}, maxs={"last_shipped": "l_shipdate"},
    where="l_discount < 0.09",
)


@query("materialize_delta", """
    select l_suppkey, year(l_shipdate)::int as year, count(*) as rows, sum(cast(l_extendedprice as decimal(18,2))) as amount,
        count(l_extendedprice) as amount_values, count(nullif(l_tax, 0)) as taxed, min(l_shipdate) as first_shipped,
        min(l_quantity) as least, max(l_shipdate) as last_shipped from lineitem where l_discount < 0.09 group by 1, 2
""")
def materialized_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregated asset over lines of an earlier state, brought to the given state by what changed."""
    after = table(spark, sf_dir, "lineitem")
    kind, moved = F.col("l_orderkey") % 40, F.col("l_shipdate") - F.expr("interval 400 days")
    before = after.filter(kind != 3).withColumns({  # 3: new lines; 7: changed lines; 11: lines with a copy that is gone
        "l_quantity": F.when(kind == 7, F.lit(0.5)).otherwise(F.col("l_quantity")),
        "l_shipdate": F.when(kind == 7, moved).otherwise(F.col("l_shipdate")),
    }).unionByName(after.filter(kind == 11).withColumn("l_shipdate", F.col("l_shipdate") + F.expr("interval 900 days")))
    root, now = work_path(spark, "lake"), {"lines": stored(before, "before")}
    output = "l_suppkey long, year int, rows long, amount decimal(28,2), amount_values long, taxed long, first_shipped timestamp_ntz, least double, last_shipped timestamp_ntz"
    asset = rollup_table("sales.lines", source("lineitem", load=lambda s: now["lines"]), LINES, ["year"], output)
    materialize(spark, root, [asset])
    changes = row_changes(now["lines"], after)
    now["lines"] = after
    materialize_delta(spark, root, asset, changes)
    money = F.col("amount").cast(MONEY)
    return asset.read(spark, root).withColumn("amount", money)


@query("partitioned_write", """
    select o_orderkey, o_totalprice, year(o_orderdate) as y, o_orderstatus as s from orders
""")
def partitioned_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", F.year("o_orderdate").cast("bigint").alias("y"), F.col("o_orderstatus").alias("s")
    )
    path = write_table(rows, work_path(spark, "partitioned"), partition_by=["y", "s"])
    return read_table(spark, path, rows.schema)


@query("manifest", "select o_orderstatus as part, count(*) as n from orders group by 1")
def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per partition of a source, from its per-file manifest."""
    path = write_table(table(spark, sf_dir, "orders"), work_path(spark, "source"), partition_by=["o_orderstatus"])
    files = manifest(spark, path)
    part = F.regexp_extract("file_path", "o_orderstatus=([^/]*)/", 1).alias("part")
    return files.groupBy(part).agg(F.sum("n").alias("n"))


@query("sql_text", """
    select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by n_name
""")
def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL text over registered tables."""
    register_views(spark, sf_dir, ("customer", "nation"))
    return spark.sql("select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by n_name")


@query("materialize_branch", f"select year, count(*) as nations, sum(revenue) as revenue from ({NATION_YEAR_SQL}) group by year")
def materialize_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more table on a branch; its input was written on the default branch only."""
    root = work_path(spark, "lake")
    nation_year = revenue_graph(sf_dir)["nation_year"]
    materialize(spark, root, [nation_year])
    rows = T.StructType.fromDDL("year long, nations long, revenue decimal(38,2)")

    @Namespace("trial").table(input=nation_year, output=rows)
    def per_year(yearly: DataFrame) -> DataFrame:
        return yearly.groupBy("year").agg(F.count("*").alias("nations"), F.sum("revenue").cast(MONEY).alias("revenue"))

    materialize(spark, root, [per_year], branch="trial", upstream=False)
    return per_year.read(spark, root, "trial")


@query("backfill_rejects", """
    select o_orderstatus = 'F' or o_orderstatus = 'O' as kept, count(*) as n from orders
    where o_orderstatus in ('F', 'O') or o_orderstatus = 'P' group by 1
""")
def backfill_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition values that are no numbers are rejected, whatever slots are filled: no row gets lost."""
    root = work_path(spark, "lake")
    rows = T.StructType.fromDDL("o_orderkey long, slot int")
    status = F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "2").otherwise(F.col("o_orderstatus"))

    @Namespace("care").table(input=_source(sf_dir, "orders"), output=rows, partition_by=["slot"])
    def by_slot(orders: DataFrame) -> DataFrame:
        return orders.select("o_orderkey", status.alias("slot"))

    backfill(spark, root, by_slot, [{"slot": 1}, {"slot": 2}], run_id="run")
    good = by_slot.read(spark, root).select(F.lit(True).alias("kept"))
    bad = spark.read.parquet(f"{by_slot.path(root)}__rejected").select(F.lit(False).alias("kept"))
    return good.unionByName(bad).groupBy("kept").agg(F.count("*").alias("n"))


@job("daily_event_counts")
def _daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _daily_counts.period.window("ts")
    return table(spark, sf_dir, "events").groupBy(days.alias("day")).agg(F.count("*").alias("n"))


every(1, "day")(_daily_counts)


@query("job_daily", "select cast(cast(ts as date) as timestamp) as day, count(*) as n from events group by 1")
def job_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered job whose slots are those of its schedule."""
    return _daily_counts(spark, sf_dir).select(F.col("day.start").alias("day"), "n")
