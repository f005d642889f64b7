"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.session import with_conf, work_path

#: Rows of text handled at once inside a task, in characters; a single longer text is handled alone.
CHUNK_CHARS = 4_000_000
#: Long texts make the usual 10,000 rows of a batch large, also outside the heap.
_SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: By operator (its module), how to let go of what it keeps in this worker between its tasks.
_KEPT: dict[str, Callable[[], object]] = {}


def keeps(owner: str, drop: Callable[[], object]) -> None:
    """``owner`` keeps something in this worker until a task of another operator begins."""
    _KEPT[owner] = drop


def drop_others(owner: str) -> None:
    """Let go of what other operators than ``owner`` have kept in this worker."""
    for name in [n for n in _KEPT if n != owner]:
        _KEPT.pop(name)()


def give_back() -> None:
    """Hand memory that was freed back to the system; glibc has to be asked for it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator], owner: str | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` as a task that keeps memory low in workers, which live on and serve one operator after the other.

    The owner is the module of ``run`` unless it is given.
    """
    name = owner or run.__module__

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(name)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it is.

    For texts of ASCII only, ``lower`` does just that and is faster.
    """
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, small))


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def map_texts(
    rows: DataFrame, function: Callable[[list, list], dict[str, list]], schema: str, key: str, text: str
) -> DataFrame:
    """One output batch for each bounded run of (key, text) rows.

    ``function`` gets the keys and the texts (null: empty) and returns the columns of ``schema`` by name.
    """
    fields = rows.sparkSession.createDataFrame([], schema).limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in runs(batch):
                columns = function(keys, texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type) for f in fields], schema=fields
                )

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run, function.__module__), schema)


def runs(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of a batch whose columns are those two, a bounded number of characters at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > CHUNK_CHARS:
            part = batch.slice(start, i - start)
            yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
            start, total = i, 0
        total += size
    if len(sizes) > start:
        part = batch.slice(start)
        yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: no lineage, survives lost executors."""
    spark: SparkSession = df.sparkSession
    path = work_path(spark, name)
    with with_conf(spark, _SMALL_BATCHES):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def alnum_words(text: Column) -> Column:
    """Words of digits, letters and non-ASCII characters, A-Z in lower case; null has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ""), F.array())


def computed(value: Column) -> Column:
    """``value`` as a generated column, for ``select``: it is computed once a row.

    An alias may be put in place wherever it is used, also inside lambdas and filters, and be computed again there.
    """
    return F.explode(F.array(value))


def shingle_hashes(words: Column, length: int | Column) -> Column:
    """A 64-bit hash for each run of ``length`` words, in order; none for fewer words."""
    starts = F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - (length - 1))).otherwise(F.array())
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, length)))


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; else as it is, for a shuffled join.

    Tasks count and only numbers meet; what is dear to compute should be stored first.
    """
    return F.broadcast(df) if df.count() <= rows else df
