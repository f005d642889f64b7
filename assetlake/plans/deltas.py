"""Aggregated assets that follow the changes of their input instead of being computed again.

A ``Rollup`` is filter, projection and group-by. Its table holds the measures and what is needed to adjust them: the
rows of each group and, for each sum, how many values went into it. Changes are rows with a weight (+1 appeared,
-1 vanished, any multiple); they go through the same filter and projection and are added up per group, so the work
follows the changes and not the table. Sums and counts are adjusted. A smallest or largest value is adjusted, too,
unless the group lost a value as extreme as the one it has; only such groups are computed again, from rows that are
read by the groups' keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlake.functions.paths import join_path
from assetlake.plans.assets import DEFAULT_BRANCH, RUN_LOG, AssetNode, TableAsset, empty_partition, read_branch
from assetlake.plans.runlog import append_run, schema_hash
from assetlake.session import is_missing_path, stored
from assetlake.sources.formats import write_table

WEIGHT = "_weight"
#: Up to so many groups are looked up by value, which the scan can use to skip files; more are joined.
_LISTED = 1_000


def row_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of which the two states hold different numbers, with the difference as ``_weight``.

    Repeated rows count. Both states go through one shuffle; a row that is in both cancels out.
    """
    odd = set(before.columns) ^ set(after.columns)
    if odd:
        raise ValueError(f"the two states differ in the columns {sorted(odd)}")
    columns = before.columns
    both = before.withColumn(WEIGHT, F.lit(-1).cast("bigint")).unionByName(after.withColumn(WEIGHT, F.lit(1).cast("bigint")))
    return both.groupBy(*columns).agg(F.sum(WEIGHT).alias(WEIGHT)).filter(F.col(WEIGHT) != 0)


@dataclass(frozen=True)
class Rollup:
    """Filter, projection and group-by. Expressions are SQL text over the input's columns."""

    by: Mapping[str, str]
    sums: Mapping[str, str] = field(default_factory=dict)
    counts: Mapping[str, str] = field(default_factory=dict)
    mins: Mapping[str, str] = field(default_factory=dict)
    maxs: Mapping[str, str] = field(default_factory=dict)
    where: str | None = None

    def __post_init__(self) -> None:
        names = [*self.by, *self.sums, *self.counts, *self.mins, *self.maxs, *[f"{s}_values" for s in self.sums], "rows"]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise ValueError(f"two columns of the rollup are called {', '.join(twice)}")

    @property
    def columns(self) -> list[str]:
        return [*self.by, "rows", *[c for s in self.sums for c in (s, f"{s}_values")], *self.counts, *self.mins, *self.maxs]

    def rows(self, df: DataFrame) -> DataFrame:
        """The projected rows that take part; a weight goes with them."""
        kept = df if self.where is None else df.filter(F.expr(self.where))
        parts = {**self.by, **self.sums, **self.counts, **self.mins, **self.maxs}
        rows = kept.select(*[F.expr(e).alias(n) for n, e in parts.items()], *[c for c in df.columns if c == WEIGHT])
        inexact = [s for s in self.sums if isinstance(rows.schema[s].dataType, (T.FloatType, T.DoubleType))]
        if inexact:
            raise TypeError(f"the sums {', '.join(inexact)} are of floating numbers, from which nothing can be taken back exactly; cast them to decimal")
        return rows

    def full(self, df: DataFrame) -> DataFrame:
        """The whole table from all rows."""
        aggregates = [F.count(F.lit(1)).alias("rows")]
        for s in self.sums:
            aggregates += [F.sum(s).alias(s), F.count(s).alias(f"{s}_values")]
        aggregates += [F.count(c).alias(c) for c in self.counts]
        aggregates += [F.min(c).alias(c) for c in self.mins] + [F.max(c).alias(c) for c in self.maxs]
        return self.rows(df).groupBy(*self.by).agg(*aggregates).select(*self.columns)

    def delta(self, changes: DataFrame) -> DataFrame:
        """Per touched group what is added to rows, sums and counts, and the extremes of new and of vanished values."""
        w = F.col(WEIGHT)
        aggregates = [F.sum(w).alias("rows")]
        for s in self.sums:
            aggregates += [F.sum(F.col(s) * w).alias(s), F.sum(F.when(F.col(s).isNotNull(), w)).alias(f"{s}_values")]
        aggregates += [F.sum(F.when(F.col(c).isNotNull(), w)).alias(c) for c in self.counts]
        for pick, names in ((F.min, self.mins), (F.max, self.maxs)):
            for c in names:
                aggregates += [pick(F.when(w > 0, F.col(c))).alias(f"{c}_new"), pick(F.when(w < 0, F.col(c))).alias(f"{c}_gone")]
        return self.rows(changes).groupBy(*self.by).agg(*aggregates)

    def merged(self, table: DataFrame, delta: DataFrame) -> DataFrame:
        """The touched groups with adjusted measures; ``_lost`` marks those whose extreme has to be sought again."""
        types = {f.name: f.dataType for f in table.schema}
        old = table.select(F.struct(*self.by).alias("_group"), F.struct(*self.columns).alias("_old"))
        rows = delta.withColumn("_group", F.struct(*[F.col(b).cast(types[b]).alias(b) for b in self.by])).join(old, "_group", "left")

        def added(name: str) -> Column:
            return (F.coalesce(F.col("_old")[name], F.lit(0)) + F.coalesce(F.col(name), F.lit(0))).cast(types[name])

        out = {"rows": added("rows")}
        for s in self.sums:
            values = added(f"{s}_values")
            out |= {s: F.when(values > 0, added(s)), f"{s}_values": values}
        out |= {c: added(c) for c in self.counts}
        lost = F.lit(False)
        for pick, names in ((F.least, self.mins), (F.greatest, self.maxs)):
            for c in names:
                had, new, gone = F.col("_old")[c], F.col(f"{c}_new").cast(types[c]), F.col(f"{c}_gone").cast(types[c])
                out[c] = pick(had, new)
                # Safe if what vanished lay inside, or if something as extreme has come.
                inside = pick(had, gone) != gone
                replaced = new.isNotNull() & (pick(new, gone) == new)
                lost |= gone.isNotNull() & ~F.coalesce(inside | replaced, F.lit(False))
        merged = rows.select("_group.*", *[v.cast(types[n]).alias(n) for n, v in out.items()], lost.alias("_lost"))
        # Fewer rows than none: the changes do not belong to this state.
        negative = F.raise_error(F.lit("the changes take away rows that the table does not hold"))
        return merged.withColumn("rows", F.when(F.col("rows") < 0, negative).otherwise(F.col("rows")).cast("bigint"))

    def recomputed(self, groups: DataFrame, source: DataFrame) -> DataFrame:
        """The given groups from the rows of the source, and of no others."""
        return self.full(only_groups(source, self.by, groups))


def only_groups(df: DataFrame, by: Mapping[str, str], groups: DataFrame) -> DataFrame:
    """Rows whose group, by the SQL expressions in ``by``, is among ``groups`` (nulls are equal).

    Values of up to a thousand groups are also put into the filter, where they reach the scan: partitions and row groups
    without them are not read.
    """
    wanted = groups.select(*by).distinct()
    listed = wanted.limit(_LISTED + 1).collect()
    if len(listed) <= _LISTED:
        near = []
        for name, expression in by.items():
            values = [r[name] for r in listed if r[name] is not None]
            near.append(F.expr(expression).isin(values) | F.expr(expression).isNull() if len(values) < len(listed) else F.expr(expression).isin(values))
        df = df.filter(reduce(lambda a, b: a & b, near)) if listed else df.limit(0)
    keyed = df.withColumn("_wanted", F.struct(*[F.expr(e).alias(b) for b, e in by.items()]))
    return keyed.join(wanted.select(F.struct(*by).alias("_wanted")), "_wanted", "left_semi").drop("_wanted")


@dataclass(eq=False)
class RollupAsset(TableAsset):
    """A table that is a rollup of its one input."""

    rollup: Rollup | None = None


def rollup_table(name: str, input: AssetNode, rollup: Rollup, partition_by: Sequence[str] = (), output: type | str | None = None) -> RollupAsset:
    """An asset that ``materialize`` computes as a whole and ``materialize_delta`` brings up to date."""
    from assetlake.schema import as_row_type

    foreign = [c for c in partition_by if c not in rollup.by]
    if foreign:
        raise ValueError(f"{name} can only be partitioned by what it is grouped by, not by {', '.join(foreign)}")
    if partition_by and output is None:
        raise TypeError("a partitioned table needs a declared output: partition values are text in its paths")
    rows = None if output is None else as_row_type(output)
    return RollupAsset(name, [input], f=rollup.full, output=rows, partition_by=list(partition_by), rollup=rollup)


@dataclass
class Adjusted:
    """What one run did: groups that the changes touched, and how many of them were computed again or are gone."""

    asset: str
    path: str
    touched: int
    recomputed: int
    removed: int


def materialize_delta(spark: SparkSession, root: str, asset: RollupAsset, changes: DataFrame, source: DataFrame | None = None,
                      branch: str = DEFAULT_BRANCH, run_id: str | None = None) -> Adjusted:
    """Bring the asset's table up to date with ``changes`` (rows with ``_weight``) of its input.

    ``source`` is the input after the changes (default: as the branch sees it); it is read for groups that lost an extreme.
    Of a partitioned table only the partitions with touched groups are written. The changes must be those since the
    table was last written: a run that is repeated after its write adds them twice, as weights have no identity.
    """
    rollup, path = asset.rollup, asset.path(root, branch)
    if source is None:
        up = asset.upstream[0]
        source = read_branch(spark, up, root, branch) if isinstance(up, TableAsset) else up.frame(spark)
    try:
        table = asset.read(spark, root, branch)
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
        raise ValueError(f"{asset.name} has not been materialized yet") from error
    delta = stored(rollup.delta(changes), "delta")
    # Only partitions with touched groups are read and written.
    parts = {c: f"`{c}`" for c in asset.partition_by}
    near = only_groups(table, parts, delta) if parts else table
    merged = stored(rollup.merged(near, delta), "touched")
    lost = merged.filter("_lost and rows > 0")
    fresh = rollup.recomputed(lost, source).select(*[F.col(f.name).cast(f.dataType) for f in table.schema])
    kept = merged.filter("not _lost and rows > 0").select(*table.columns)
    touched = merged.select(F.struct(*rollup.by).alias("_group"))
    rest = near.withColumn("_group", F.struct(*rollup.by)).join(touched, "_group", "left_anti").drop("_group")
    # The table cannot be written while it is read.
    rows = stored(rest.unionByName(kept).unionByName(fresh), "adjusted")
    counts = merged.agg(F.count("*"), F.count_if(F.expr("_lost and rows > 0")), F.count_if(F.col("rows") == 0)).first()
    if counts[0]:
        write_table(rows, path, asset.format, asset.partition_by, replace_partitions=bool(asset.partition_by))
    if asset.partition_by and counts[2]:
        slots = merged.select(*asset.partition_by).distinct().exceptAll(rows.select(*asset.partition_by).distinct())
        for slot in slots.toLocalIterator():  # partitions that lost their last group
            empty_partition(spark, asset, path, slot.asDict())
    total = rows.count()
    append_run(spark, join_path(root, RUN_LOG), run_id or uuid.uuid4().hex, asset.name, branch, path, total, schema_hash(table), ["delta"])
    return Adjusted(asset.name, path, *counts)
