"""Joins of intervals that overlap, by a plane sweep over all their ends.

Two intervals [a, b) overlap if and only if one of them starts inside the other. All starts and ends of both sides are
put in one order and dealt by sampled ranges; inside a range the starts of each side are counted as they pass, and the
counts of the ranges before are carried over, as are thereby the intervals that are open at a border. So every interval
learns two numbers: how many starts of the other side came before its own start and before its end. What lies between
is its set of partners, as places in the order of the other side's starts. These places are joined by equality, in
blocks of ``BLOCK``: no pair is tested that is not next to a match, and a start or a stretch of time that
holds very many intervals is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assetlake.operators.ordered import _KEY, _PART, _dealt, _earlier, _inside
from assetlake.session import stored

BLOCK = 32


def _events(side: DataFrame, on: Sequence[str], left: bool) -> DataFrame:
    """Two rows an interval. Of equal times ends come first, then the left starts, then the right ones."""
    rank = 1 if left else 2
    ends = F.array(F.struct(F.col("_from").alias("_at"), F.lit(rank).alias("_kind")), F.struct(F.col("_to").alias("_at"), F.lit(0).alias("_kind")))
    return side.select(*on, F.lit(left).alias("_left"), "_id", F.inline(ends))


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str],
                  on: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """All pairs of a left and a right row whose spans [start, end) overlap and whose ``on`` columns are equal.

    Both sides have the ``on`` columns, and no other column in common. Nulls in a span or a key, and spans that end
    before they begin or at once, match nothing. Both inputs and the sweep are written to the shared folder.
    """
    keys = list(on) or ["_all"]
    clash = sorted((set(left.columns) & set(right.columns)) - set(on))
    if clash:
        raise ValueError(f"both sides have the columns {', '.join(clash)}")

    def prepared(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        rows = df.dropna(subset=[*on, *span]).filter(F.col(span[0]) < F.col(span[1]))
        if not on:
            rows = rows.withColumn("_all", F.lit(0))
        # Stored, as the number of a row must be the same wherever it is used.
        named = rows.select("*", F.col(span[0]).alias("_from"), F.col(span[1]).alias("_to"), F.monotonically_increasing_id().alias("_id"))
        return stored(named, name)

    sides = {True: prepared(left, left_span, "left"), False: prepared(right, right_span, "right")}
    events = _events(sides[True], keys, True).unionByName(_events(sides[False], keys, False))
    order = ["_at", "_kind", "_left", "_id"]
    rows = _dealt(events, keys, order, parts)
    starts = {side: F.when(F.col("_kind") == kind, 1).otherwise(0) for side, kind in (("_l", 1), ("_r", 2))}
    so_far = _inside(order).rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.withColumns({side: F.sum(one).over(so_far) for side, one in starts.items()})
    totals = rows.groupBy(_PART, _KEY).agg(*[F.sum(one).alias(f"{side}_all") for side, one in starts.items()])
    before = totals.select(_PART, _KEY, *[F.coalesce(F.sum(f"{side}_all").over(_earlier()), F.lit(0)).alias(f"{side}_before") for side in starts])
    placed = swept.join(before, [_PART, _KEY]).withColumns({side: F.col(side) + F.col(f"{side}_before") for side in starts})
    own, other = F.when(F.col("_left"), F.col("_l")).otherwise(F.col("_r")), F.when(F.col("_left"), F.col("_r")).otherwise(F.col("_l"))
    start = F.col("_kind") > 0
    found = placed.groupBy("_left", "_id").agg(
        F.max(F.when(start, own - 1)).alias("_place"), F.max(F.when(start, other)).alias("_low"), F.max(F.when(~start, other)).alias("_high")
    )
    ranked = {
        is_left: stored(df.join(found.filter(F.col("_left") == is_left).drop("_left"), "_id").drop("_id", "_from", "_to"), "placed")
        for is_left, df in sides.items()
    }
    columns = [*on, *[c for c in left.columns if c not in on], *[c for c in right.columns if c not in on]]
    return _visits(ranked[True], ranked[False], keys).select(*columns).unionByName(_visits(ranked[False], ranked[True], keys).select(*columns))


def _visits(spans: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each span with the rows of the other side whose start lies among its places."""
    blocks = F.sequence(F.floor(F.col("_low") / BLOCK), F.floor((F.col("_high") - 1) / BLOCK))
    visiting = spans.filter("_low < _high").drop("_place").withColumn("_block", F.explode(blocks))
    visited = points.drop("_low", "_high").withColumn("_block", F.floor(F.col("_place") / BLOCK))
    pairs = visiting.join(visited, [*keys, "_block"])
    return pairs.filter((F.col("_place") >= F.col("_low")) & (F.col("_place") < F.col("_high")))
