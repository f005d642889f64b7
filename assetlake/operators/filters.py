"""Row filters and nested-record work."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assetlake.functions.globs import glob_anchor, glob_regex, matches_any_glob, matching_globs, name_anchors
from assetlake.operators.ordered import range_count

# The states a cluster can be in, and those listed when none are asked for.
CLUSTER_STATES = (
    "STARTING", "BOOTSTRAPPING", "RUNNING", "WAITING", "TERMINATING", "TERMINATED", "TERMINATED_WITH_ERRORS",
)
ACTIVE_STATES = ("STARTING", "BOOTSTRAPPING", "RUNNING", "WAITING")

# The states in which a member of a group is looked at.
MEMBER_STATES = ("AWAITING_FULFILLMENT", "PROVISIONING", "BOOTSTRAPPING", "RUNNING", "TERMINATED")

# Node types in report order, and the group types they are stored as.
NODE_GROUPS = {"primary": "MASTER", "core": "CORE", "task": "TASK"}

#: Globs of a table up to this size, with their regular expressions, are sent to every executor.
BROADCAST_GLOBS = 8 << 20


def glob_filter(df: DataFrame, column: str, patterns: Sequence[str], distinct_keys: bool = False) -> DataFrame:
    """Rows whose name matches any of the globs; all rows when there is no pattern.

    A row that matches k patterns comes k times, as a list of matches per pattern
    would hold it; with ``distinct_keys`` it comes once. One pass either way.
    """
    if not patterns:
        return df
    name = F.col(column)
    if distinct_keys:
        return df.filter(matches_any_glob(name, patterns))
    return df.select("*", F.explode(matching_globs(name, patterns)).alias("_glob")).drop("_glob")


def glob_filter_table(df: DataFrame, column: str, patterns: DataFrame, pattern: str = "pattern", distinct_keys: bool = False) -> DataFrame:
    """``glob_filter`` with the globs of a table, of which there may be very many; null names and null globs match nothing.

    The longest literal start of a glob is its index (or its literal end, or a piece between wildcards, where that is all
    it has). Names are cut to the same texts and joined by equality, and only the globs found in this way are tried as
    regular expressions. Each distinct name is looked up once. All rows come if the table has no globs.

    A name is cut into about as many texts as it has characters, which Spark's estimates do not see: the side of the names
    is never broadcast. The globs are up to ``BROADCAST_GLOBS`` bytes, and with more of them both sides are shuffled.
    """
    globs = patterns.select(F.col(pattern).alias("_glob")).dropna().groupBy("_glob").agg(F.count("*").alias("_times"))
    globs = globs.select("_times", glob_regex(F.col("_glob")).alias("_regex"), glob_anchor(F.col("_glob")).alias("_anchor"))
    # One row for each kind and length that occurs: as many as the longest glob has characters, at most.
    size = F.octet_length("_regex") + F.octet_length("_anchor.key") + 64
    lengths = globs.groupBy("_anchor.kind", F.char_length("_anchor.key").alias("n")).agg(F.sum(size).alias("size")).collect()
    if not lengths:
        return df if not patterns.limit(1).count() else df.limit(0)
    names = df.select(F.col(column).alias("_name")).dropna().distinct()
    looked_up = names.select("_name", F.explode(name_anchors(F.col("_name"), sorted((r["kind"], r["n"]) for r in lengths))).alias("_anchor"))
    globs = globs.hint("broadcast" if sum(r["size"] for r in lengths) <= BROADCAST_GLOBS else "merge")
    tried = looked_up.join(globs, "_anchor").filter(F.expr("_name rlike _regex"))
    hits = tried.groupBy("_name").agg(F.sum("_times").alias("_times"))
    if distinct_keys:
        return df.join(hits.withColumnRenamed("_name", column), column, "left_semi").select(*df.columns)
    # By a fixed number: coalesced by their own small size, all names would get their many rows in one task.
    found = df.join(hits.withColumnRenamed("_name", column).repartition(range_count(df), column), column)
    return found.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*df.columns)


def status_filter(df: DataFrame, column: str, wanted: Sequence[str] | str = ACTIVE_STATES,
                  allowed: Sequence[str] = CLUSTER_STATES) -> DataFrame:
    """Rows in one of the wanted states; a state outside ``allowed`` is an error."""
    states = wanted.split(",") if isinstance(wanted, str) else list(wanted)
    unknown = [s for s in states if s not in allowed]
    if unknown:
        raise ValueError(f"unknown state {', '.join(unknown)}; allowed are {', '.join(allowed)}")
    return df.filter(F.col(column).isin(*states))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns of the rows that have a value in all of them."""
    return df.dropna(how="any", subset=list(columns)).select(*columns)


def node_type(group_type: Column, groups: Mapping[str, str] = NODE_GROUPS) -> Column:
    """Report name of a stored group type; null for a type that is not reported."""
    pairs = [F.lit(v) for name, stored in groups.items() for v in (stored, name)]
    return F.try_element_at(F.create_map(*pairs), group_type)


def flatten_groups(df: DataFrame, group_type: str, members: str, member_id: Column, wanted: str | None = None,
                   groups: Mapping[str, str] = NODE_GROUPS, state: Column | None = None,
                   states: Sequence[str] = MEMBER_STATES) -> DataFrame:
    """One row per member of the reported groups: ``type_pos`` (report order), ``type``, ``id``.

    ``member_id`` and ``state`` are expressions over ``member``, one element of the array column
    ``members``. Members without an id are skipped, and with ``state`` those in no state of ``states``. An
    unknown ``wanted`` is an error.
    """
    if wanted is not None and wanted not in groups:
        raise ValueError(f"unknown type {wanted!r}; allowed are {', '.join(groups)}")
    names = [wanted] if wanted else list(groups)
    kept = [c for c in df.columns if c not in (group_type, members)]
    rows = df.filter(F.col(group_type).isin(*[groups[n] for n in names]))
    rows = rows.select(*kept, node_type(F.col(group_type), groups).alias("type"), F.explode(members).alias("member"))
    if state is not None:
        rows = rows.filter(state.isin(*states))
    rows = rows.select(*kept, "type", member_id.alias("id")).filter(F.col("id").isNotNull())
    position = F.array_position(F.array(*[F.lit(n) for n in groups]), F.col("type")) - 1
    return rows.withColumn("type_pos", position.cast("bigint"))


def first_members(df: DataFrame, group_type: str, members: str, member_id: Callable[[Column], Column], wanted: str,
                  groups: Mapping[str, str] = NODE_GROUPS, state: Callable[[Column], Column] | None = None,
                  states: Sequence[str] = MEMBER_STATES) -> DataFrame:
    """``id`` of the first member (in one of the states) of each group of the wanted type that has one.

    If that member has no id, the query fails: it may not be passed over for another one. Nothing is shuffled.
    """
    if wanted not in groups:
        raise ValueError(f"unknown type {wanted!r}; allowed are {', '.join(groups)}")
    seen = F.col(members) if state is None else F.filter(members, lambda m: state(m).isin(*states))
    kept = [c for c in df.columns if c not in (group_type, members)]
    rows = df.filter(F.col(group_type) == groups[wanted]).select(*kept, seen.alias("_seen")).filter(F.size("_seen") > 0)
    first = member_id(F.element_at("_seen", 1))
    checked = F.when(first.isNull(), F.raise_error(F.lit(f"the first member of type {wanted} has no id"))).otherwise(first)
    return rows.select(*kept, checked.alias("id"))


def first_of_type(df: DataFrame, group: str, order: Sequence[str], require: Sequence[str] = ()) -> DataFrame:
    """First row of every group by ``order``; a group named in ``require`` must exist."""
    first = Window.partitionBy(group).orderBy(*order)
    rows = df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
    if not require:
        return rows
    wanted = df.sparkSession.createDataFrame([(r,) for r in require], f"{group} string")
    missing = F.concat(F.lit("nothing found for "), F.col(group))
    found = wanted.join(rows.withColumn("_found", F.lit(True)), group, "left")
    return found.filter(F.when(F.col("_found"), True).otherwise(F.raise_error(missing).cast("boolean"))).drop("_found")
