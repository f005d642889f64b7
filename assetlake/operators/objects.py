"""Work on object tables: ``key``, ``etag``, ``size``, ``body`` and the like, one row per object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: objects on a listing page when no limit is given.
PAGE_SIZE = 100


def etag_of(body: Column) -> Column:
    """MD5 of the body in hex."""
    return F.md5(body)


def describe(df: DataFrame, key: Column, body: Column) -> DataFrame:
    """Key, etag and size of every object; the body itself is not kept."""
    return df.select(key.alias("key"), etag_of(body).alias("etag"), F.octet_length(body).cast("bigint").alias("size"))


def list_page(objects: DataFrame, prefix: str = "", limit: int | None = None, token: str | None = None) -> DataFrame:
    """One page of keys in key order, starting behind ``token``.

    Only ``limit`` rows per task leave the executors: this plans as a top-k, not as a sort.
    """
    page = objects.filter(F.col("key").startswith(prefix))
    if token is not None:
        page = page.filter(F.col("key") > token)
    return page.orderBy("key").limit(limit or PAGE_SIZE)


def next_token(page: DataFrame, limit: int | None = None) -> str | None:
    """Token for the page behind ``page``; None at the end."""
    last = page.agg(F.max("key").alias("key"), F.count("*").alias("n")).first()
    return last["key"] if last["n"] == (limit or PAGE_SIZE) else None


def list_all(objects: DataFrame, prefix: str = "") -> DataFrame:
    """Every object below a prefix; unordered."""
    return objects.filter(F.col("key").startswith(prefix))


def get(objects: DataFrame, requested: DataFrame, strict: bool = False) -> DataFrame:
    """One row per requested key with the object's columns and ``found``.

    With ``strict`` a missing key fails the query.
    """
    present = objects.withColumn("found", F.lit(True))
    out = requested.join(present, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if strict:
        missing = F.concat(F.lit("no object with key "), F.col("key").cast("string"))
        out = out.withColumn("found", F.when(F.col("found"), True).otherwise(F.raise_error(missing).cast("boolean")))
    return out


def latest(log: DataFrame, key: str | Sequence[str], order: Sequence[Column], tombstone: Column | None = None) -> DataFrame:
    """Newest row of every key in a change log, without the keys whose newest row is a tombstone.

    ``order`` sorts newest first. Each task keeps its best row per key before the
    shuffle, so a key that is written over and over does not overload one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    newest = Window.partitionBy(*keys).orderBy(*order)
    rows = log.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")
    return rows if tombstone is None else rows.filter(~F.coalesce(tombstone, F.lit(False)))


def delete(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """Objects without those in ``keys``; absent keys are ignored."""
    return objects.join(keys.select("key").distinct(), "key", "left_anti")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events that lead from one inventory to the next: ``scope, key, etag, size``.

    A new key and an overwritten one are both ``create``. A ``delete`` carries the
    old etag's absence: etag and size are null. Only etags are compared, never bodies.
    """
    old = before.select("key", F.col("etag").alias("_etag"), F.lit(True).alias("_had"))
    new = after.select("key", "etag", "size", F.lit(True).alias("_has"))
    old, new = (df.withColumn("_key", F.struct("key")).drop("key") for df in (old, new))  # null keys are equal, too
    both = old.join(new, "_key", "full_outer").select("_key.key", "_etag", "_had", "etag", "size", "_has").filter(
        F.col("_had").isNull() | F.col("_has").isNull() | ~F.col("etag").eqNullSafe(F.col("_etag"))
    )
    scope = F.when(F.col("_has").isNull(), "delete").otherwise("create")
    return both.select(scope.alias("scope"), "key", "etag", "size")
