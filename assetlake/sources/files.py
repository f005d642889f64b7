"""Whole files, text lines and gzip logs as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.functions.paths import join_path


def file_key(path: Column, root: str, encoded: bool = False) -> Column:
    """Path below ``root``; ``encoded`` for paths that come URL-encoded from file metadata."""
    if encoded:
        path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    bare = root.split(":", 1)[-1].lstrip("/") if ":" in root else root.lstrip("/")
    start = F.locate(f"/{bare.rstrip('/')}/", path) + len(bare.rstrip("/")) + 2
    return F.substr(path, start)


def scan_files(spark: SparkSession, root: str, prefix: str | None = None, recursive: bool = True,
               min_partitions: int | None = None) -> DataFrame:
    """One row per file: ``key``, ``size``, ``modified``, ``body``.

    The prefix goes into the path, so that other folders are never listed. Leave
    ``body`` out of a select and no file is opened. ``min_partitions`` sets the
    session's ``spark.sql.files.minPartitionNum``.
    """
    if min_partitions is not None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(min_partitions))
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(join_path(root, prefix))
    )
    return files.select(
        file_key(F.col("path"), root).alias("key"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), F.col("content").alias("body"),
    )


def open_files(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """``scan_files`` for the files with these keys below ``root``; a key without a file gives no row."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(join_path(root, key)) for key in keys]
    # Files whose names begin like this are not objects: scans do not see them either.
    hidden = [any(part[:1] in ("_", ".") for part in key.split("/")) for key in keys]
    found = [p for p, h in zip(paths, hidden, strict=True) if not h and (fs := p.getFileSystem(conf)).exists(p) and fs.getFileStatus(p).isFile()]
    files = spark.read.format("binaryFile")
    # Paths are patterns to the reader; every special character of a name is quoted.
    quoted = [re.sub(r"([\\{}\[\]*?^,])", r"\\\1", p.toString()) for p in found]
    rows = files.load(quoted) if found else spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    return rows.select(
        file_key(F.col("path"), root).alias("key"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), F.col("content").alias("body"),
    )


def read_lines(spark: SparkSession, paths: str | Sequence[str], root: str | None = None,
               recursive: bool = True) -> DataFrame:
    """Lines of text files, ``.gz`` included, as ``line``; with ``root`` also the file's ``key``.

    Plain files are split over tasks, so a huge file does not become one value in memory.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(paths, lineSep="\n")
    columns = [F.col("value").alias("line")]
    if root is not None:
        columns.insert(0, file_key(F.col("_metadata.file_path"), root, encoded=True).alias("key"))
    return lines.select(*columns)


def read_texts(spark: SparkSession, paths: str | Sequence[str], root: str, recursive: bool = True) -> DataFrame:
    """One row per text file: ``key`` and the whole ``text``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    texts = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(paths, wholetext=True)
    return texts.select(file_key(F.col("_metadata.file_path"), root, encoded=True).alias("key"), F.col("value").alias("text"))


def manifest(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """What a source consists of: one row per file with its size, time and row count."""
    files = spark.read.format(fmt).load(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    return files.groupBy("file_path").agg(
        F.first("file_size").alias("size"), F.first("file_modification_time").alias("modified"), F.count("*").alias("n")
    )
