"""Ordered work inside groups, also where one group holds a large share of all rows.

A window puts a whole group into one task. Here the rows are dealt by ranges of (group, order): Spark samples
the bounds, takes any type that can be ordered, and cuts a large group into as many ranges as it needs. Work is
done inside each range, one small summary per range and group is carried over to the next one, and no
group is ever in one task, whatever its size. There is one way for all groups and no threshold.

The number of ranges follows the bytes that the plan reads (``RANGE_BYTES`` of them a range), and is at least the
session's number of shuffle partitions; ``parts`` overrides it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assetlake.session import stored

_PART, _KEY = "_part", "_group"
#: Bytes of input, as they lie in files, for one range. A task then sorts a few hundred MB at most.
RANGE_BYTES = 64 << 20
#: Sources that know no size of theirs claim more than this.
_UNKNOWN_BYTES = 1 << 50


def range_count(df: DataFrame) -> int:
    """How many ranges the rows of ``df`` are dealt to: by the size of what is read, which the optimizer knows."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = sum(n for n in sizes if n < _UNKNOWN_BYTES)
    return max(least, -(-known // RANGE_BYTES), 1)


def _dealt(df: DataFrame, group: Sequence[str], order: Sequence[str], parts: int | None) -> DataFrame:
    """``df`` dealt by ranges, with the range's number and the group as one value (nulls in it are equal).

    Sampled bounds differ from one evaluation to the next, so the rows are stored before two branches use them.
    """
    parts = parts or range_count(df)
    rows = df.repartitionByRange(parts, *group, *order).withColumn(_PART, F.spark_partition_id())
    return stored(rows, "ranges").withColumn(_KEY, F.struct(*group))


def _inside(order: Sequence[str | Column]) -> Window:
    return Window.partitionBy(_PART, _KEY).orderBy(*order)


def _earlier() -> Window:
    return Window.partitionBy(_KEY).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)


def _numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], parts: int | None) -> DataFrame:
    """The dealt rows with ``_local`` (their number in range and group) and ``_before`` (the group's rows in earlier ranges)."""
    rows = _dealt(df, group, order, parts)
    sizes = rows.groupBy(_PART, _KEY).agg(F.count("*").alias("_n"))
    offsets = sizes.select(_PART, _KEY, F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)).alias("_before"))
    return rows.withColumn("_local", F.row_number().over(_inside(order))).join(offsets, [_PART, _KEY])


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "seq", parts: int | None = None) -> DataFrame:
    """Position of each row in its group, from 1, by ``order`` (which must be unique in a group)."""
    position = (F.col("_before") + F.col("_local")).cast("bigint")
    return _numbered(df, group, order, parts).select(*df.columns, position.alias(out))


def with_frames(df: DataFrame, group: Sequence[str], order: Sequence[str], preceding: int,
                columns: Callable[[Sequence[str], Sequence[str]], dict[str, Column]], parts: int | None = None) -> DataFrame:
    """Window columns that look back at most ``preceding`` rows.

    ``columns(group, order)`` returns the window expressions over the grouping it is given. Each range also gets the
    ``preceding`` rows of its group that lie before it, from as many ranges as hold them; they are dropped afterwards.
    """
    rows = _dealt(df, group, order, parts)
    sizes = rows.groupBy(_PART, _KEY).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(_KEY).orderBy(_PART))
    places = sizes.withColumn("_upto", upto)
    # A later range has a row of the group at least, so no more than ``preceding`` of them can look back to this one.
    later = F.collect_list(F.struct(F.col(_PART).alias("part"), (F.col("_upto") - F.col("_n")).alias("before"))).over(
        Window.partitionBy(_KEY).orderBy(_PART).rowsBetween(1, max(preceding, 1))
    )
    near = places.select(_PART, _KEY, "_upto", later.alias("_later"))
    local = rows.withColumn("_local", F.row_number().over(_inside(order))).join(near.join(sizes, [_PART, _KEY]), [_PART, _KEY])
    behind = F.col("_n") - F.col("_local")  # rows of the range after this one
    reached = F.filter("_later", lambda e: behind + e["before"] - F.col("_upto") < preceding)
    ahead = F.when(behind < preceding, F.transform(reached, lambda e: e["part"])).otherwise(F.array().cast("array<int>"))
    spread = local.withColumn("_copy", F.explode(F.concat(F.array(_PART), ahead))).drop("_local", "_n", "_upto", "_later")
    out = spread.withColumns(columns([_KEY, "_copy"], list(order)))
    return out.filter(F.col("_copy") == F.col(_PART)).drop("_copy", _PART, _KEY)


def rank_rows(df: DataFrame, group: Sequence[str], order: str, tie: Sequence[str], out: str = "rk", parts: int | None = None) -> DataFrame:
    """``rank()`` by ``order``; ``tie`` makes the row order unique while dealing, so equal values may be in many ranges."""
    rows = _dealt(df, group, [order, *tie], parts)
    local = rows.withColumn("_row", F.row_number().over(_inside([order, *tie]))).withColumn("_rank", F.rank().over(_inside([order])))
    edges = local.groupBy(_PART, _KEY).agg(
        F.count("*").alias("_n"), F.min_by(F.struct(order), "_row").alias("_first"), F.max_by(F.struct(order), "_row").alias("_last"),
        F.max("_rank").alias("_last_rank"),
    )
    in_order = Window.partitionBy(_KEY).orderBy(_PART)
    edges = edges.withColumn("_before", F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)))
    continued = F.coalesce(F.col("_first") == F.lag("_last").over(in_order), F.lit(False))
    # The rank of a range's last value; unknown here if the value fills the range and began before it.
    own = F.when((F.col("_last_rank") > 1) | ~continued, F.col("_before") + F.col("_last_rank"))
    edges = edges.withColumn("_own", own).withColumn("_continued", continued)
    edges = edges.select(
        _PART, _KEY, "_before", "_first", F.when(F.col("_continued"), F.last("_own", ignorenulls=True).over(_earlier())).alias("_carried")
    )
    ranked = local.join(edges, [_PART, _KEY])
    same = F.col("_carried").isNotNull() & (F.struct(order) == F.col("_first"))
    rank = F.when(same, F.col("_carried")).otherwise(F.col("_before") + F.col("_rank"))
    return ranked.select(*df.columns, rank.cast("bigint").alias(out))


def as_of_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_at: str, right_at: str,
               right_order: Sequence[str] = (), values: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    Both sides are put in one ordered stream per key, and the last right row is
    carried forward: no pair of rows is ever formed, so a key with many rows on
    both sides costs their sum and not their product. Left rows without a match
    keep nulls. ``right_order`` breaks ties between right rows of the same time.
    """
    tie = list(right_order)
    right = right.dropna(subset=[*on, right_at])  # null equals nothing
    payload = F.struct(F.col(right_at).alias("_at"), *tie, *[v for v in values if v not in tie])
    kept = left.columns
    left_rows = left.select(*on, F.col(left_at).alias("_at"), F.lit(1).alias("_side"),
                            *[F.lit(None).cast(right.schema[c].dataType).alias(f"_o_{c}") for c in tie],
                            F.struct(*kept).alias("_left"))
    right_rows = right.select(*on, F.col(right_at).alias("_at"), F.lit(0).alias("_side"),
                              *[F.col(c).alias(f"_o_{c}") for c in tie], payload.alias("_right"))
    order = ["_at", "_side", *[f"_o_{c}" for c in tie]]
    rows = _dealt(left_rows.unionByName(right_rows, allowMissingColumns=True), on, order, parts)
    so_far = _inside(order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.select(_PART, _KEY, "_left", F.last("_right", ignorenulls=True).over(so_far).alias("_found"))
    last = rows.filter("_right is not null").groupBy(_PART, _KEY).agg(F.max_by("_right", F.struct(*order)).alias("_last"))
    # Ranges that have only left rows of a key carry on what came before them.
    ranges = rows.select(_PART, _KEY).distinct().join(last, [_PART, _KEY], "left")
    carried = ranges.select(_PART, _KEY, F.last("_last", ignorenulls=True).over(_earlier()).alias("_carried"))
    joined = found.filter("_left is not null").join(carried, [_PART, _KEY])
    best = joined.select("_left", F.coalesce("_found", "_carried").alias("_found"))
    return best.select("_left.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def sessions(df: DataFrame, group: Sequence[str], ts: str, gap: str, parts: int | None = None) -> DataFrame:
    """Rows of a group with less than ``gap`` between neighbours: number, start, end and size."""
    rows = _dealt(df.select(*group, ts), group, [ts], parts)
    ordered = _inside([ts])
    previous = F.lag(ts).over(ordered)
    joins = previous.isNotNull() & (F.col(ts) < previous + F.expr(f"interval {gap}"))
    flagged = rows.withColumn("_new", F.when(joins, 0).otherwise(1))
    numbered = flagged.withColumn("_local", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(_PART, _KEY, "_local").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
    # Only the run at a range's border can grow together with the range before.
    # How many runs came before, less those that did, is one number per range and group.
    edges = runs.groupBy(_PART, _KEY).agg(
        F.max("_local").alias("_runs"), F.min("start").alias("_first"), F.max("end").alias("_last")
    )
    last = F.max("_last").over(_earlier())
    edges = edges.withColumn("_grown", F.when(F.col("_first") < last + F.expr(f"interval {gap}"), 1).otherwise(0))
    shift = F.coalesce(F.sum(F.col("_runs") - F.col("_grown")).over(_earlier()), F.lit(0)) - F.col("_grown")
    moved = runs.join(edges.select(_PART, _KEY, shift.alias("_shift")), [_PART, _KEY])
    moved = moved.withColumn("sid", F.col("_local") + F.col("_shift"))
    whole = moved.groupBy(_KEY, "sid").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return whole.select(f"{_KEY}.*", "sid", "start", "end", "n")
