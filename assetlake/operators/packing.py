"""Compaction in place: small files of a folder are packed together, large ones are not touched."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assetlake.functions.paths import join_path
from assetlake.session import stored

TARGET_BYTES = 256 << 20
#: Files are rewritten by so many at a time; the driver holds their names and nothing else.
_AT_ONCE = 10_000
_PLAN = "_compaction"


def packing_plan(spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, small_bytes: int | None = None) -> DataFrame:
    """Which files become one: ``folder, file, size, bin``, from the listing alone; no file is opened.

    Files below ``small_bytes`` (default: half the target) are laid end to end by falling size in each folder and cut every
    ``target_bytes``, so no bin is larger than the target and one small file, and all but the last of a folder are
    full. A file that would stay alone is left as it is.
    """
    small = target_bytes // 2 if small_bytes is None else small_bytes
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    listed = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.col("path").alias("file"), F.col("length").alias("size"))
    in_folder = Window.partitionBy("folder").orderBy(F.desc("size"), "file")
    before = F.coalesce(F.sum("size").over(in_folder.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = listed.filter(F.col("size") < small).withColumn("bin", F.floor(before / target_bytes))
    alone = F.count("*").over(Window.partitionBy("folder", "bin"))
    return dealt.withColumn("_n", alone).filter("_n > 1").drop("_n")


def compact_small(spark: SparkSession, path: str, partition_by: tuple[str, ...] = (), target_bytes: int = TARGET_BYTES,
                  small_bytes: int | None = None) -> DataFrame:
    """Pack the small Parquet files of a table in place and return the plan that was carried out.

    New files are written to a hidden folder, with rows in the order of the old files, and moved next to those they
    replace before these are removed. The plan is stored with the table: a run that was
    interrupted is finished by ``finish_compaction``. Nobody may write to the table, and a reader that begins between the
    two steps sees rows twice; run it while the table rests.
    """
    finish_compaction(spark, path)
    plan = stored(packing_plan(spark, path, target_bytes, small_bytes), "packing")
    bins = plan.select("folder", "bin").distinct()
    number = F.row_number().over(Window.orderBy("folder", "bin")) - 1  # one row for each new file
    numbered = stored(plan.join(bins.withColumn("number", number), ["folder", "bin"]), "numbered")
    table = spark.read.parquet(path)
    for part, rows in enumerate(_batches(numbered)):
        staged = join_path(path, f"{_PLAN}/part={part}")
        names = spark.createDataFrame([(r["file"], r["folder"], i) for i, r in rows], "_file string, _folder string, _number int")
        new = spark.read.schema(table.schema).option("basePath", path).parquet(*[r["file"] for _, r in rows])
        held = new.select("*", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("_path"), F.col("_metadata.row_index").alias("_row"))
        bare = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:/*", "/")  # noqa: E731  file:/x and file:///x are one
        # At most _AT_ONCE names of files are broadcast.
        placed = held.join(F.broadcast(names.withColumn("_file", bare(F.col("_file")))), bare(F.col("_path")) == F.col("_file"))
        count = 1 + max(i for i, _ in rows)
        ordered = placed.repartitionById(count, F.col("_number")).sortWithinPartitions("_file", "_row").drop("_path", "_file", "_folder", "_row", "_number")
        writer = ordered.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{staged}/new")
        names.coalesce(1).write.parquet(f"{staged}/old")
    finish_compaction(spark, path)
    return plan


def _batches(numbered: DataFrame) -> Iterator[list[tuple[int, Row]]]:
    """Files by bins, at most about ``_AT_ONCE`` in a batch and no bin in two; bins are numbered from 0 in a batch."""
    rows, first, last = [], 0, -1
    for row in numbered.orderBy("number").toLocalIterator():
        if len(rows) >= _AT_ONCE and row["number"] != last:
            yield rows
            rows, first = [], row["number"]
        last = row["number"]
        rows.append((last - first, row))
    if rows:
        yield rows


def finish_compaction(spark: SparkSession, path: str) -> None:
    """Carry out what an earlier compaction has written: move the new files in, then remove the old ones; else nothing."""
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    root = at(join_path(path, _PLAN))
    fs = root.getFileSystem(hadoop)
    if not fs.exists(root):
        return
    for part in fs.listStatus(root):
        staged = part.getPath().toString()
        if not fs.exists(at(f"{staged}/old/_SUCCESS")):
            fs.delete(part.getPath(), True)  # written in part only: nothing has been moved or removed yet
            continue
        listing = fs.listFiles(at(f"{staged}/new"), True)
        base = fs.makeQualified(at(f"{staged}/new")).toString()
        while listing.hasNext():
            file = listing.next().getPath()
            if file.getName().endswith(".parquet"):
                # The folders of the partitions have the same names as in the table.
                to = at(path + fs.makeQualified(file).toString()[len(base):])
                if not fs.rename(file, to):
                    raise OSError(f"could not move {file.toString()} to {to.toString()}")
        for row in spark.read.parquet(f"{staged}/old").select("_file").toLocalIterator():
            fs.delete(at(row["_file"]), False)
        fs.delete(part.getPath(), True)
    fs.delete(root, True)
