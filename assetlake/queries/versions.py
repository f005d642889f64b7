"""Versions of keyed tables: as-of reads, diffs, merges, branches.

Orders serve as the change log of their customers: the newest order up to a day is
a customer's state, and status P removes the customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assetlake.operators import versions as ops
from assetlake.operators.graph import ancestors
from assetlake.operators.ordered import with_frames
from assetlake.operators.ranged import ranged_diff, write_ranged
from assetlake.operators.refs import ref_states
from assetlake.queries import query
from assetlake.queries.objects import EARLY, EARLY_SQL, LATE, LATE_SQL, STATE_SQL, moment, order_state
from assetlake.session import work_path
from assetlake.tables import table

_DAY_ONE = f"o_orderdate <= timestamp '{EARLY}'"
_DAY_TWO = f"o_orderdate <= timestamp '{LATE}'"
_URGENT = "o_orderpriority in ('1-URGENT', '2-HIGH')"
OURS_SQL = STATE_SQL.format(where=f"{_DAY_ONE} or ({_DAY_TWO} and {_URGENT})")
THEIRS_SQL = STATE_SQL.format(where=f"{_DAY_ONE} or ({_DAY_TWO} and not {_URGENT})")


def _states(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """State on day one, on day two, and on day two as seen by two branches that got different orders."""
    orders = table(spark, sf_dir, "orders")
    early, late = F.col("o_orderdate") <= moment(EARLY), F.col("o_orderdate") <= moment(LATE)
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    conditions = {"base": early, "late": late, "ours": early | (late & urgent), "theirs": early | (late & ~urgent)}
    return {n: order_state(orders, c).select("key", "o_orderkey", "o_totalprice") for n, c in conditions.items()}


@query("as_of", """
    select key, event_type, value from (select user_id as key, event_type, value,
        row_number() over (partition by user_id order by ts desc, event_id desc) as rn
        from events where ts <= timestamp '2024-01-15 00:00:00') t where rn = 1
""")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_type", "value", "ts", "event_id")
    state = ops.as_of(log, "key", "ts", moment("2024-01-15 00:00:00"), ["event_id"])
    return state.select("key", "event_type", "value")


@query("as_of_tomb", """
    select key, value from (select user_id as key, event_type, value,
        row_number() over (partition by user_id order by ts desc, event_id desc) rn from events)
    where rn = 1 and event_type <> 'error'
""")
def as_of_tomb(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_type", "value", "ts", "event_id")
    return ops.as_of(log, "key", "ts", tie=["event_id"], tombstone=F.col("event_type") == "error").select("key", "value")


_DIFF_SQL = f"""
    select coalesce(a.key, b.key) as key,
        case when a.key is null then 'added' when b.key is null then 'removed' else 'changed' end as change
    from {EARLY_SQL} a full outer join {LATE_SQL} b on a.key = b.key
    where a.key is null or b.key is null or a.o_orderkey is distinct from b.o_orderkey or a.o_totalprice is distinct from b.o_totalprice
"""


@query("table_diff", _DIFF_SQL)
def table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _states(spark, sf_dir)
    return ops.table_diff(states["base"], states["late"], "key")


@query("table_diff_digest", _DIFF_SQL)
def table_diff_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _states(spark, sf_dir)
    return ops.table_diff(states["base"], states["late"], "key", compare="digest")


@query("table_diff_ranges", _DIFF_SQL)
def table_diff_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both states written by key ranges with digests; the later one takes over the bounds of the earlier one."""
    states, path = _states(spark, sf_dir), work_path(spark, "ranged")
    write_ranged(states["base"], f"{path}/base", "key")
    write_ranged(states["late"], f"{path}/late", "key", like=f"{path}/base")
    return ranged_diff(spark, f"{path}/base", f"{path}/late", "key")


@query("branch_merge", f"""
    select key, conflict, case when not conflict then v end as v from (
        select coalesce(b.key, o.key, t.key) as key,
            (o.o_orderkey is distinct from b.o_orderkey and t.o_orderkey is distinct from b.o_orderkey
             and o.o_orderkey is distinct from t.o_orderkey) as conflict,
            case when o.o_orderkey is not distinct from b.o_orderkey then t.o_orderkey else o.o_orderkey end as v
        from {EARLY_SQL} b full outer join {OURS_SQL} o on b.key = o.key
        full outer join {THEIRS_SQL} t on coalesce(b.key, o.key) = t.key)
""")
def branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key of any version; ``v`` is null for a removed row and for a conflict."""
    states = _states(spark, sf_dir)
    rows = ops.branch_merge(states["base"], states["ours"], states["theirs"], "key")
    return rows.select("key", "conflict", F.col("merged.o_orderkey").alias("v"))


@query("table_merge", f"""
    select coalesce(t.key, s.key) as key, case when s.key is not null then s.v else t.v end as v
    from (select o_custkey as key, o_orderkey as v, o_orderstatus from (
            select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn
            from orders where {_DAY_ONE}) where rn = 1) t
    full outer join (select o_custkey as key, o_orderkey as v from (
            select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn
            from orders where not ({_DAY_ONE}) and {_DAY_TWO}) where rn = 1) s on t.key = s.key
    where s.key is not null or t.o_orderstatus <> 'P'
""")
def table_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of half a year merged into the state before; untouched rows with status P are deleted."""
    log = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("v"), "o_orderstatus", "o_orderdate"
    )
    target = ops.as_of(log, "key", "o_orderdate", moment(EARLY), ["v"]).drop("o_orderdate")
    source = ops.as_of(log.filter(F.col("o_orderdate") > moment(EARLY)), "key", "o_orderdate", moment(LATE), ["v"]).drop("o_orderdate")
    return ops.table_merge(target, source, "key", delete=F.col("o_orderstatus") == "P").select("key", "v")


@query("delete_where", "select c_custkey, c_acctbal from customer where not coalesce(c_acctbal < 0, false)")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return ops.delete_where(customers, F.col("c_acctbal") < 0)


@query("update_where", """
    select c_custkey, case when c_mktsegment = 'BUILDING' then 0 else c_acctbal end as c_acctbal, c_mktsegment from customer
""")
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return ops.update_where(customers, F.col("c_mktsegment") == "BUILDING", c_acctbal=F.lit(0))


@query("commit_append", "select o_orderkey, o_custkey from orders")
def commit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits on a branch: the open orders, then the others."""
    orders = table(spark, sf_dir, "orders")
    open_one = F.col("o_orderstatus") == "O"
    changes = orders.select(F.when(open_one, "first").otherwise("second").alias("commit_id"), "o_orderkey", "o_custkey")
    commits = spark.createDataFrame([("first", None), ("second", "first")], "commit_id string, parent string")
    refs = spark.createDataFrame([("main", "second")], "ref string, commit_id string")
    return ref_states(changes, commits, refs, "o_orderkey").drop("ref")


@query("branch_tag_rollback", """
    select 'main' as ref, c_custkey as key, c_acctbal as v from customer
    union all select 'dev', c_custkey, c_acctbal + 1 from customer where c_acctbal >= 0
    union all select 'release', c_custkey, c_acctbal + 1 from customer
""")
def branch_tag_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """main is changed, tagged, branched off and rolled back; the branch goes on and removes accounts in debt."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v"))
    wrote = lambda rows, commit, gone: rows.withColumns({"commit_id": F.lit(commit), "gone": F.lit(gone)})
    changes = wrote(base, "first", False).unionByName(wrote(base.withColumn("v", F.col("v") + 1), "second", False))
    changes = changes.unionByName(wrote(base.filter("v < 0"), "third", True))
    commits = spark.createDataFrame([("first", None), ("second", "first"), ("third", "second")], "commit_id string, parent string")
    refs = spark.createDataFrame([("main", "first"), ("release", "second"), ("dev", "third")], "ref string, commit_id string")
    return ref_states(changes, commits, refs, "key", F.col("gone")).select("ref", "key", "v")


@query("commit_log", """
    select o_custkey as ref, o_orderkey as commit_id,
        row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) - 1 as distance from orders
""")
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order points to the one before it; each customer's newest order is a ref."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("commit_id"))

    def parent(group: list[str], order: list[str]) -> dict:
        return {"parent": F.lag("commit_id").over(Window.partitionBy(*group).orderBy(*order))}

    commits = with_frames(orders, ["o_custkey"], ["o_orderdate", "commit_id"], 1, parent)
    heads = ops.latest(orders, "o_custkey", [F.desc("o_orderdate"), F.desc("commit_id")])
    return ancestors(commits, heads.select(F.col("o_custkey").alias("ref"), "commit_id"))
