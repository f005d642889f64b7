"""Buckets and folders: objects addressed by key, read and written as DataFrames.

Objects are the files below the bucket's root, overlaid by a put log. Spark cannot
write raw bytes to a file per row, so a put or a delete appends rows to the log,
which lies in the folder ``_puts`` and is therefore invisible to file scans. The
newest entry of a key wins over older entries and over the file of that name.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.functions.paths import join_path
from assetlake.session import is_missing_path
from assetlake.operators import objects as ops
from assetlake.sources.files import open_files, scan_files

PUT_LOG = "_puts"
LOG_SCHEMA = "key string, etag string, size bigint, modified timestamp, body binary, deleted boolean, version bigint"
SCOPES = ("create", "delete")
#: So many keys of a get are looked up one by one; their names pass through the driver.
LISTED_KEYS = 1_000


class _Keyed:
    """What buckets and folders share; ``_full`` maps a relative key to the bucket's key."""

    bucket: Bucket

    def _full(self, name: str | None) -> str:
        raise NotImplementedError

    def _keys(self, spark: SparkSession, keys: str | DataFrame) -> DataFrame:
        if isinstance(keys, str):
            return spark.range(1).select(F.lit(self._full(keys)).alias("key"))
        return keys.withColumn("key", F.concat(F.lit(self._full("")), F.col("key")))

    def folder(self, name: str) -> Folder:
        out: _Keyed = self
        for part in [p for p in name.split("/") if p]:
            out = Folder(out, part)
        return out

    def __truediv__(self, name: str) -> Folder:
        return self.folder(name)

    def binary_files(self, spark: SparkSession, prefix: str | None = None, min_partitions: int | None = None) -> DataFrame:
        """The files below a prefix, with their content."""
        return scan_files(spark, self.bucket.root, self._full(prefix), min_partitions=min_partitions)

    def objects(self, spark: SparkSession, prefix: str | None = None) -> DataFrame:
        """``key, etag, size, modified, body`` of the current objects below a key prefix."""
        return ops.list_all(self.bucket._current(spark, self._full(prefix)), self._full(prefix))

    def list(self, spark: SparkSession, prefix: str = "", limit: int | None = None, next_token: str | None = None) -> DataFrame:
        """One page of object references in key order."""
        refs = self.objects(spark, prefix).select("key", "etag", "size")
        return ops.list_page(refs, self._full(prefix), limit, next_token)

    def get(self, spark: SparkSession, keys: str | DataFrame, strict: bool = True) -> DataFrame:
        """The objects with these keys; a missing one is an error unless ``strict`` is off.

        Up to ``LISTED_KEYS`` keys are opened by their paths, and nothing else is listed or read. For more of them the
        folder is read and joined.
        """
        wanted = self._keys(spark, keys)
        listed = [r["key"] for r in wanted.select("key").distinct().limit(LISTED_KEYS + 1).collect()]
        if len(listed) <= LISTED_KEYS:
            current = self.bucket._current(spark, "", [k for k in listed if k is not None])
        else:
            current = self.bucket._current(spark, self._full(""))
        return ops.get(current, wanted, strict)

    def put(self, spark: SparkSession, key: str | DataFrame, body: bytes | str | None = None) -> int:
        """Write one object, or every ``key``/``body`` row of a DataFrame; returns the log version.

        A key may come once per put, as otherwise it would be open which body wins.
        """
        rows = self._keys(spark, key)
        if not isinstance(key, str) and not rows.groupBy("key").count().filter("count > 1").isEmpty():
            raise ValueError("the same key comes twice in one put")
        if isinstance(key, str):
            data = body.encode("utf-8") if isinstance(body, str) else body
            rows = rows.withColumn("body", F.lit(bytearray(data)))
        return self.bucket._append(rows.select("key", F.col("body").cast("binary").alias("body"), F.lit(False).alias("deleted")))

    def delete(self, spark: SparkSession, keys: str | DataFrame) -> int:
        """Remove objects; absent keys are ignored."""
        rows = self._keys(spark, keys).select("key").distinct()
        return self.bucket._append(rows.select("key", F.lit(None).cast("binary").alias("body"), F.lit(True).alias("deleted")))

    def on(self, scope: str | list[str], prefix: str | None = None) -> Callable:
        """Decorator: call the function with a DataFrame of events below a prefix."""
        scopes = [scope] if isinstance(scope, str) else list(scope)
        unknown = [s for s in scopes if s not in SCOPES]
        if unknown:
            raise ValueError(f"unknown scope {unknown}; allowed are {', '.join(SCOPES)}")

        def subscribe(handler: Callable[[DataFrame, int], object]) -> Callable:
            self.bucket.subscriptions.append(Subscription(scopes, self._full(prefix), handler))
            return handler

        return subscribe


@dataclass
class Subscription:
    scopes: list[str]
    prefix: str
    handler: Callable[[DataFrame, int], object]


@dataclass
class Bucket(_Keyed):
    """A store of objects below ``root``.

    Without a root the name comes from the variable ``<id>_bucket_name``.
    """

    bucket_id: str
    root: str = ""
    subscriptions: list[Subscription] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.root:
            variable = f"{self.bucket_id}_bucket_name"
            name = os.environ.get(variable)
            if name is None:
                raise ValueError(f"give a root or set {variable}")
            self.root = name if "/" in name else f"s3a://{name}"
        self.root = self.root.rstrip("/")

    @property
    def bucket(self) -> Bucket:
        return self

    def __str__(self) -> str:
        return f"{self.root}/"

    def _full(self, name: str | None) -> str:
        return (name or "").lstrip("/")

    @property
    def log_path(self) -> str:
        return join_path(self.root, PUT_LOG)

    def _log(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.schema(LOG_SCHEMA).parquet(self.log_path)
        except AnalysisException as error:
            if not is_missing_path(error):
                raise
            return None

    def _append(self, rows: DataFrame) -> int:
        """Write rows as the next version; two writers of one version cannot both succeed."""
        log = self._log(rows.sparkSession)
        last = log.agg(F.max("version")).first()[0] if log is not None else None
        version = (last or 0) + 1
        entry = rows.select(
            "key", ops.etag_of(F.col("body")).alias("etag"), F.octet_length("body").cast("bigint").alias("size"),
            F.current_timestamp().alias("modified"), "body", "deleted",
        )
        entry.write.mode("errorifexists").parquet(f"{self.log_path}/version={version}")
        return version

    def _current(self, spark: SparkSession, prefix: str = "", keys: list[str] | None = None) -> DataFrame:
        """Objects with at least those below a key prefix, of which only the folder is listed; or just those with ``keys``."""
        columns = ["key", "etag", "size", "modified", "body"]
        log = self._log(spark)
        if log is not None:
            log = log.filter(F.col("key").startswith(prefix) if keys is None else F.col("key").isin(keys))
        folder = prefix.rpartition("/")[0]
        try:
            # A file's etag is taken from its size and time: its bytes stay unread until asked for.
            stamp = F.md5(F.concat_ws("-", "key", "size", F.unix_micros("modified")).cast("binary"))
            files = scan_files(spark, self.root, folder) if keys is None else open_files(spark, self.root, keys)
            files = files.withColumn("etag", stamp).select(*columns)
        except AnalysisException as error:
            if not is_missing_path(error):
                raise
            files = spark.createDataFrame([], LOG_SCHEMA).select(*columns)
        if log is None:
            return files
        # Only keys and versions are compared; the bodies of lost versions are never shuffled by key alone,
        # so a key that was written very often spreads over its versions.
        winners = log.groupBy("key").agg(F.max("version").alias("version"))
        newest = log.join(winners, ["key", "version"], "left_semi").filter(~F.col("deleted")).select(*columns)
        return files.join(winners, "key", "left_anti").unionByName(newest)


@dataclass
class Folder(_Keyed):
    """A key prefix inside a bucket; all keys given to it are relative to it."""

    parent: Bucket | Folder
    name: str

    @property
    def bucket(self) -> Bucket:
        return self.parent.bucket

    @property
    def path(self) -> str:
        return self.name if isinstance(self.parent, Bucket) else join_path(self.parent.path, self.name)

    def __str__(self) -> str:
        return f"{self.bucket.root}/{self.path}/"

    def _full(self, name: str | None) -> str:
        # A trailing slash keeps folder "a" from matching keys of folder "ab".
        return join_path(self.path, name) + ("/" if name.endswith("/") else "") if name else f"{self.path}/"
