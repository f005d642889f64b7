"""Tables as assets: functions from DataFrames to DataFrames, materialized in dependency order."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from graphlib import TopologicalSorter
from typing import NamedTuple, get_type_hints
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlake.functions.paths import join_path
from assetlake.plans.runlog import append_run, observed, schema_hash
from assetlake.schema import RowType, as_row_type, check_rows
from assetlake.session import is_missing_path, stored
from assetlake.sources.formats import TableFormat, read_table, write_table

Asset = NamedTuple
DEFAULT_BRANCH = "main"
RUN_LOG = "_runs"


@dataclass(eq=False)
class AssetNode:
    """A named DataFrame; ``upstream`` are the nodes it is computed from."""

    name: str
    upstream: list[AssetNode] = field(default_factory=list)

    def compute(self, spark: SparkSession, inputs: Sequence[DataFrame]) -> DataFrame:
        raise NotImplementedError

    def frame(self, spark: SparkSession) -> DataFrame:
        """The whole chain as one lazy plan; nothing is written."""
        return self.compute(spark, [node.frame(spark) for node in self.upstream])


@dataclass(eq=False)
class SourceAsset(AssetNode):
    """An external input. ``load`` reads it, ``rows`` declares its columns."""

    load: Callable[[SparkSession], DataFrame] | None = None
    rows: RowType | None = None

    def compute(self, spark: SparkSession, inputs: Sequence[DataFrame]) -> DataFrame:
        df = self.load(spark)
        if self.rows is None:
            return df
        lacking = [c for c in self.rows.schema.names if c not in df.columns]
        if lacking:
            raise TypeError(f"source {self.name} lacks the declared columns {lacking}")
        return df.select(*self.rows.schema.names)

    def table(self, name: str | None = None, **options: object) -> Callable:
        """Decorator: a table computed from this source."""
        return _table_decorator(lambda f: name or f.__name__, self, **options)


@dataclass(eq=False)
class TableAsset(AssetNode):
    f: Callable[..., object] | None = None
    output: RowType | None = None
    format: TableFormat = TableFormat.PARQUET
    partition_by: list[str] = field(default_factory=list)

    @property
    def view(self) -> str:
        return self.name.replace(".", "__")

    def path(self, root: str, branch: str = DEFAULT_BRANCH) -> str:
        return join_path(root, branch, *self.name.split("."))

    def compute(self, spark: SparkSession, inputs: Sequence[DataFrame]) -> DataFrame:
        result = self.f(*[df.pandas_api() if _wants_pandas(self.f) else df for df in inputs])
        return result if isinstance(result, DataFrame) else result.to_spark()

    def read(self, spark: SparkSession, root: str, branch: str = DEFAULT_BRANCH) -> DataFrame:
        """The materialized table, with the declared schema if there is one."""
        path = self.path(root, branch)
        if self.output is not None:
            return read_table(spark, path, self.output, self.format)
        if self.format in (TableFormat.CSV, TableFormat.JSON):
            raise TypeError(f"{self.name}: {self.format.value} keeps no types, declare the output")
        return spark.read.format(self.format.value).load(path)


def read_branch(spark: SparkSession, node: TableAsset, root: str, branch: str) -> DataFrame:
    """The table as the branch sees it: its own rows if it was written there, else those of the default branch."""
    try:
        return node.read(spark, root, branch)
    except AnalysisException as error:
        if branch == DEFAULT_BRANCH or not is_missing_path(error):
            raise
        return node.read(spark, root, DEFAULT_BRANCH)


def _wants_pandas(f: Callable) -> bool:
    """Whether a parameter is annotated as a pandas-on-Spark frame."""
    hints = [h for name, h in get_type_hints(f).items() if name != "return"]
    return any(getattr(h, "__module__", "").startswith("pyspark.pandas") for h in hints)


def source(name: str, data: type | str | None = None, load: Callable[[SparkSession], DataFrame] | None = None) -> SourceAsset:
    if load is None:
        raise TypeError(f"source {name} needs a loader")
    return SourceAsset(name, load=load, rows=None if data is None else as_row_type(data))


def _table_decorator(name_of: Callable, input: AssetNode | Sequence[AssetNode], output: type | str | None = None,
                     format: TableFormat = TableFormat.PARQUET, partition_by: Sequence[str] = ()) -> Callable:
    rows = None if output is None else as_row_type(output)
    keys = list(partition_by) or (list(rows.partition_by) if rows else [])
    if keys and rows is None:
        raise TypeError("a partitioned table needs a declared output: partition values are text in its paths")
    upstream = [input] if isinstance(input, AssetNode) else list(input)

    def decorate(f: Callable) -> TableAsset:
        return TableAsset(name_of(f), upstream, f=f, output=rows, format=format, partition_by=keys)

    return decorate


class Namespace:
    """A dotted table name under construction: children appear on attribute access."""

    def __init__(self, name: str, parent: Namespace | None = None):
        self.name = name
        self.parent = parent
        self.children: dict[str, Namespace] = {}
        self.declared: list[TableAsset] = []

    def __getattr__(self, name: str) -> Namespace:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.children.setdefault(name, Namespace(name, self))

    @property
    def path(self) -> str:
        return self.name if self.parent is None else f"{self.parent.path}.{self.name}"

    def table(self, *, input: AssetNode | Sequence[AssetNode], name: str | None = None, output: type | str | None = None,
              format: TableFormat = TableFormat.PARQUET, partition_by: Sequence[str] = ()) -> Callable:
        """Decorator: the function computes the table ``<namespace>.<function name>``.

        The function takes one DataFrame per input; parameters annotated as
        pandas-on-Spark frames get that form, and may return it.
        """
        decorate = _table_decorator(lambda f: f"{self.path}.{name or f.__name__}", input, output, format, partition_by)

        def declare(f: Callable) -> TableAsset:
            self.declared.append(decorate(f))
            return self.declared[-1]

        return declare

    def tables(self, names: Sequence[str] | None = None) -> list[TableAsset]:
        """All tables declared here and below, or those with the given full names."""
        found = [*self.declared, *[t for child in self.children.values() for t in child.tables()]]
        if names is None:
            return found
        known = {t.name: t for t in found}
        unknown = [n for n in names if n not in known]
        if unknown:
            raise KeyError(f"no asset {', '.join(unknown)}; known are {', '.join(sorted(known))}")
        return [known[n] for n in names]


_databases: dict[str, DB] = {}


class DB(Namespace):
    """The root of a namespace; its name is unique."""

    def __init__(self, name: str):
        if name in _databases:
            raise ValueError(f"database {name} already exists")
        super().__init__(name)
        _databases[name] = self


@dataclass
class Materialized:
    """What one run wrote for one asset."""

    asset: str
    path: str
    rows: int
    rejected: int


def plan_order(targets: Sequence[AssetNode]) -> list[AssetNode]:
    """The targets and everything upstream, inputs first, each node once; a cycle is an error."""
    links: dict[AssetNode, list[AssetNode]] = {}
    todo = list(targets)
    while todo:
        node = todo.pop()
        if node not in links:
            links[node] = node.upstream
            todo.extend(node.upstream)
    names = [n.name for n in links]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"two assets share the name {', '.join(sorted(twice))}")
    return list(TopologicalSorter(links).static_order())


def _write(spark: SparkSession, node: TableAsset, df: DataFrame, path: str, run_id: str, slots: list[Column] | None = None) -> tuple[Materialized, list[int]]:
    """Conform, write, count; rows that break the declaration go to ``<path>__rejected/run_id=...``.

    A row with a reason is kept whatever its slot: the value of its partition column may be what is wrong. The
    rejected rows of other runs stay.
    """
    checked = check_rows(df, node.output) if node.output is not None else df.withColumn("_reason", F.lit(None).cast("string"))
    if node.output is not None and not df._jdf.queryExecution().analyzed().deterministic():
        # Good and rejected rows are written one after the other; both have to be those of one evaluation.
        checked = stored(checked, "checked")
    if slots is not None:
        checked = checked.filter(reduce(lambda a, b: a | b, slots) | F.col("_reason").isNotNull())
    good = F.col("_reason").isNull()
    per_slot = [F.count_if(good & s).alias(f"slot{i}") for i, s in enumerate(slots or [])]
    watched, seen = observed(checked, node.name, F.count_if(~good).alias("bad"), *per_slot)
    write_table(watched.filter(good).drop("_reason"), path, node.format, node.partition_by, replace_partitions=slots is not None)
    counts = seen.get
    bad = counts["bad"]
    if bad:
        write_table(checked.filter(~good), f"{path}__rejected/run_id={quote(run_id, safe='')}", mode="overwrite")
    result = Materialized(node.name, path, counts["rows"] - bad, bad)
    return result, [counts[f"slot{i}"] for i in range(len(per_slot))]


def materialize(spark: SparkSession, root: str, assets: Sequence[AssetNode] | Namespace, branch: str = DEFAULT_BRANCH,
                run_id: str | None = None, upstream: bool = True) -> list[Materialized]:
    """Write the assets (all tables of a namespace) and all tables upstream of them, each once.

    Without ``upstream`` only the assets themselves are written; their inputs are read as the branch sees them.

    A table is computed from what was written for its inputs, so shared inputs are
    not recomputed and a failed run can be looked into. Every written table is also
    registered as the temporary view ``db__ns__table``.
    """
    if isinstance(assets, Namespace):
        assets = assets.tables()
    run_id = run_id or uuid.uuid4().hex
    frames: dict[AssetNode, DataFrame] = {}
    done = []
    for node in plan_order(assets):
        if isinstance(node, TableAsset) and not upstream and node not in assets:
            if any(node in target.upstream for target in assets):
                frames[node] = read_branch(spark, node, root, branch)
            continue
        if not upstream and node not in assets and not any(node in target.upstream for target in assets):
            continue
        df = node.compute(spark, [frames[up] for up in node.upstream])
        if isinstance(node, TableAsset):
            result, _ = _write(spark, node, df, node.path(root, branch), run_id)
            done.append(result)
            digest = schema_hash(df)
            append_run(spark, join_path(root, RUN_LOG), run_id, node.name, branch, result.path, result.rows, digest, None)
            df = node.read(spark, root, branch)
            df.createOrReplaceTempView(node.view)
        frames[node] = df
    return done


def backfill(spark: SparkSession, root: str, asset: TableAsset, slots: Sequence[dict[str, object]],
             branch: str = DEFAULT_BRANCH, run_id: str | None = None) -> Materialized:
    """Recompute only the partitions in ``slots`` and leave all others as they are.

    Each slot maps every partition column to a value. The condition is put on the
    result; Catalyst moves it down to the scans as far as the transform allows.
    A slot that has no rows any more is emptied.
    """
    if not asset.partition_by:
        raise ValueError(f"{asset.name} has no partitions")
    for slot in slots:
        if set(slot) != set(asset.partition_by):
            raise ValueError(f"slot {slot} must name exactly the columns {asset.partition_by}")
    inputs = [read_branch(spark, up, root, branch) if isinstance(up, TableAsset) else up.frame(spark) for up in asset.upstream]
    df = asset.compute(spark, inputs)
    conditions = [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in slot.items()]) for slot in slots]
    path = asset.path(root, branch)
    run_id = run_id or uuid.uuid4().hex
    result, counts = _write(spark, asset, df, path, run_id, conditions)
    for slot, rows in zip(slots, counts):
        if rows == 0:
            empty_partition(spark, asset, path, slot)
    names = [",".join(f"{c}={v}" for c, v in slot.items()) for slot in slots]
    append_run(spark, join_path(root, RUN_LOG), run_id, asset.name, branch, path, result.rows, schema_hash(df), names)
    return result


def empty_partition(spark: SparkSession, asset: TableAsset, path: str, slot: Mapping[str, object]) -> None:
    """Leave a partition without rows: a dynamic overwrite does not touch one that it gets no rows for."""
    folder = "/".join(f"{c}={_partition_value(slot[c])}" for c in asset.partition_by)
    rest = T.StructType([f for f in asset.output.schema if f.name not in asset.partition_by])
    write_table(spark.createDataFrame([], rest), f"{path}/{folder}", asset.format)


def _partition_value(value: object) -> str:
    if value is None:
        return "__HIVE_DEFAULT_PARTITION__"
    if isinstance(value, bool):
        return str(value).lower()
    return quote(str(value), safe=" -_.,;()@!$&+~")
