"""Frames by value and exact quantiles of groups that may hold most of the rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from assetlake.operators.ordered import _KEY, _PART, _dealt, _earlier
from assetlake.session import stored

#: Parts that a range of values is cut into in each round of the search for quantiles.
BUCKETS = 1_024


def with_range_frames(df: DataFrame, group: Sequence[str], order: str, preceding: float,
                      columns: Callable[[Sequence[str]], dict[str, Column]], tie: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Window columns over the rows of the group whose ``order`` lies at most ``preceding`` before a row's own, or is equal.

    ``columns(group)`` returns window expressions that are partitioned by the grouping it gets, ordered by ``order`` and
    ``rangeBetween(-preceding, 0)``. ``order`` is a number; a row without one has no place, its columns are null.

    Rows are dealt by sampled ranges of (group, order). Each range also gets a halo: the rows of earlier ranges that are at
    most ``preceding`` below its first value, and of later ones those that tie with its last; they are dropped
    afterwards. A row is copied to as many ranges as ``preceding`` spans, so the cost follows the width of the
    frame and not the size of the group. ``tie`` spreads rows of one value over several ranges.
    """
    rows = _dealt(df.filter(F.col(order).isNotNull()), group, [order, *tie], parts)
    value = F.col(order).cast("bigint") if isinstance(df.schema[order].dataType, T.IntegralType) else F.col(order)
    edges = rows.groupBy(_PART, _KEY).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    part = F.col(_PART)
    # The last range that begins within reach of a range's last value, and the first one that ends at its first value:
    # running extremes over the borders of a group, two rows a range.
    forth = edges.select(_KEY, F.inline(F.array(
        F.struct(F.col("_low").alias("v"), F.lit(0).alias("probe"), part.alias("at")),
        F.struct((F.col("_high") + preceding).alias("v"), F.lit(1).alias("probe"), part.alias("at")),
    )))
    back = edges.select(_KEY, F.inline(F.array(
        F.struct(F.col("_high").alias("v"), F.lit(0).alias("probe"), part.alias("at")),
        F.struct(F.col("_low").alias("v"), F.lit(1).alias("probe"), part.alias("at")),
    )))
    border = F.when(F.col("probe") == 0, F.col("at"))
    ahead = F.max(border).over(Window.partitionBy(_KEY).orderBy("v", "probe").rowsBetween(Window.unboundedPreceding, 0))
    behind = F.min(border).over(Window.partitionBy(_KEY).orderBy(F.desc("v"), "probe").rowsBetween(Window.unboundedPreceding, 0))
    last = forth.withColumn("_last", ahead).filter("probe = 1").select(F.col("at").alias(_PART), _KEY, "_last")
    first = back.withColumn("_first", behind).filter("probe = 1").select(F.col("at").alias(_PART), _KEY, "_first")
    in_turn = Window.partitionBy(_KEY).orderBy(_PART)
    near = edges.withColumn("_next", F.lead("_low").over(in_turn)).join(last, [_PART, _KEY]).join(first, [_PART, _KEY])
    joined = rows.join(near, [_PART, _KEY])
    # Ranges that lie between two of a group hold nothing but that group, so numbers can be counted through.
    upto = F.when(value + preceding >= F.col("_next"), F.col("_last")).otherwise(part)
    since = F.when(value == F.col("_low"), F.least(F.col("_first"), part)).otherwise(part)
    copies = F.sequence(since, F.greatest(upto, part))
    spread = joined.withColumn("_copy", F.explode(copies))
    out = spread.withColumns(columns([_KEY, "_copy"]))
    placed = out.filter(F.col("_copy") == F.col(_PART)).select(*df.columns, *[c for c in out.columns if c not in spread.columns])
    return placed.unionByName(df.filter(F.col(order).isNull()), allowMissingColumns=True)


#: What a frame can be put together from parts for: how rows are taken together, and how parts are.
_TOTALS = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def range_totals(df: DataFrame, group: Sequence[str], order: str, preceding: int, totals: Mapping[str, tuple[str, Column]],
                 parts: int | None = None) -> DataFrame:
    """Counts, sums, least and greatest values over the frames of ``with_range_frames``, for a whole number ``order``.

    ``totals`` names the columns: ``{"n": ("count", F.lit(1)), ...}``; a row without a place gets nulls. ``with_range_frames``
    takes any window function, but Spark then reads every frame anew; here the cost does not follow the width of the frame.

    The values of a group are cut into blocks of ``preceding``. A frame begins in the block before its row's: it is the end of
    that block, from where the frame begins, and the beginning of its own block, up to the row. Both are running totals, one
    from each side, over rows that are dealt by sampled ranges; what the other ranges of a block hold is carried over. Rows
    of one value are taken together first.
    """
    if not isinstance(df.schema[order].dataType, T.IntegralType) or int(preceding) != preceding or preceding < 0:
        raise TypeError("range totals need an order and a width in whole numbers")
    names = {name: f"_t{i}" for i, name in enumerate(totals)}
    of_rows = [_TOTALS[kind][0](column).alias(names[name]) for name, (kind, column) in totals.items()]
    of_parts = {names[name]: _TOTALS[kind][1] for name, (kind, _) in totals.items()}
    placed = df.filter(F.col(order).isNotNull()).withColumns({"_of": F.struct(*group), "_v": F.col(order).cast("bigint")})
    frames = placed.groupBy("_of", "_v").agg(*of_rows)
    if preceding:
        frames = _joined_blocks(frames, F.lit(int(preceding)).cast("bigint"), of_parts, parts)
    found = placed.join(frames, ["_of", "_v"]).select(*df.columns, *[F.col(t).alias(name) for name, t in names.items()])
    return found.unionByName(df.filter(F.col(order).isNull()), allowMissingColumns=True)


def _joined_blocks(values: DataFrame, width: Column, totals: Mapping[str, Callable], parts: int | None) -> DataFrame:
    """``_of``, ``_v`` and the totals of each value's frame, from one row of totals a value."""
    v = F.col("_v")
    block = v - F.pmod(v, width)
    # Each value in its own block, and, without totals, where its frame begins: before what has that very value.
    ends = F.struct(block.alias("_block"), v.alias("_at"), F.lit(1).alias("_side"))
    begins = F.struct((block - width).alias("_block"), (v - width).alias("_at"), F.lit(0).alias("_side"))
    places = values.select("*", F.inline(F.array(begins, ends)))
    own = F.col("_side") == 1
    rows = _dealt(places.withColumns({t: F.when(own, F.col(t)) for t in totals}), ["_of", "_block"], ["_at", "_side"], parts)
    inside = Window.partitionBy(_PART, _KEY)
    upto = inside.orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    since = inside.orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    running = {t: F.when(own, total(t).over(upto)).otherwise(total(t).over(since)) for t, total in totals.items()}
    local = rows.select("_of", "_v", _PART, _KEY, "_side", F.struct(*[c.alias(t) for t, c in running.items()]).alias("_here"))
    whole = rows.groupBy(_PART, _KEY).agg(*[total(t).alias(t) for t, total in totals.items()])
    later = Window.partitionBy(_KEY).orderBy(F.desc(_PART)).rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(_PART, _KEY, *[
        F.struct(*[total(t).over(w).alias(t) for t, total in totals.items()]).alias(name)
        for name, w in (("_before", _earlier()), ("_after", later))
    ])
    elsewhere = F.when(own, F.col("_before")).otherwise(F.col("_after"))
    both = local.join(carried, [_PART, _KEY]).select("_of", "_v", "_here", elsewhere.alias("_there"))
    pieces = both.select("_of", "_v", "_here.*").unionByName(both.select("_of", "_v", "_there.*"))
    return pieces.groupBy("_of", "_v").agg(*[total(t).alias(t) for t, total in totals.items()])


def _ordinal(value: Column, kind: str) -> Column:
    """A whole number that rises with ``value``, exactly; equal for equal values."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return value.cast("bigint")
    if kind == "date":
        return F.unix_date(value).cast("bigint")
    if kind == "timestamp":
        return F.unix_micros(value)
    if kind == "timestamp_ntz":
        return F.unix_micros(F.to_utc_timestamp(value.cast("timestamp"), F.current_timezone()))
    raise TypeError(f"no exact quantiles of type {kind}; scale decimals to whole numbers")


def group_quantiles(df: DataFrame, group: Sequence[str], column: str, fractions: Sequence[float]) -> DataFrame:
    """``percentile_disc`` of a group for each fraction: the smallest value that at least that share of the rows does not exceed.

    The k-th value is sought by histograms: every round cuts the values that are still possible into ``BUCKETS`` parts, counts
    them in each task and keeps the part that holds the k-th row, down to one value. Rows are read once a round, about four
    times in all, and never shuffled or gathered; a group of any size and a value of any frequency are one count.
    Nulls are left out; a group of nulls only has no row. Dates, times and whole numbers are exact.
    """
    keys, kind = list(group), df.schema[column].dataType.simpleString()
    rows = stored(df.select(F.struct(*keys).alias(_KEY), _ordinal(F.col(column), kind).alias("_v")).dropna(subset=["_v"]), "values")
    sizes = rows.groupBy(_KEY).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    wanted = F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction")
    targets = sizes.select(_KEY, wanted, "n", "lo", "hi").withColumn("k", F.greatest(F.ceil(F.col("fraction").cast("decimal(20,10)") * F.col("n")), F.lit(1)).cast("bigint"))
    targets = stored(targets.select(_KEY, "fraction", "k", "lo", "hi"), "targets")
    done = [targets.filter("lo = hi")]
    open_ones = targets.filter("lo < hi")
    while open_ones.limit(1).count():
        # In decimals: the whole range of 64 bits has no width in 64 bits.
        width = (F.col("hi").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)") + 1)
        part = F.floor((F.col("_v").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)")) * BUCKETS / width).cast("int")
        inside = rows.join(open_ones, _KEY).filter((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
        counted = inside.groupBy(_KEY, "fraction", "k", part.alias("part")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(_KEY, "fraction").orderBy("part"))  # at most BUCKETS rows
        found = counted.withColumn("upto", upto).filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
        # Below the part that was kept nothing is counted again.
        targets = stored(found.select(_KEY, "fraction", (F.col("k") - F.col("upto") + F.col("n")).alias("k"), "lo", "hi"), "targets")
        done.append(targets.filter("lo = hi"))
        open_ones = targets.filter("lo < hi")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    value = {
        "date": F.date_from_unix_date(F.col("lo").cast("int")), "timestamp": F.timestamp_micros("lo"),
        "timestamp_ntz": F.from_utc_timestamp(F.timestamp_micros("lo"), F.current_timezone()).cast("timestamp_ntz"),
    }.get(kind, F.col("lo").cast(kind))
    return result.select(f"{_KEY}.*", "fraction", value.alias(column))
