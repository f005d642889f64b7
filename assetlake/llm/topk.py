"""Exact top-k by inner product, with block-at-a-time pruning.

Components are quantised to floor(SCALE * x). Vectors are dealt by the signs of their components, so that
those of a block are alike, and put into blocks of ``BLOCK`` rows: a forward index (the rows themselves) and the largest
and smallest value of each component (the term maxima). For a query a block's bound is the sum over components
of the larger of query * maximum and query * minimum. Blocks are taken in falling order of their bounds and scored
through the forward index, ``TURN`` blocks for a batch of queries in one product, until no bound reaches a k-th score.

Blocks lie in partitions of about ``PARTITION`` rows, each with bounds of the same kind. A query first goes to the partition
with its largest bound, which gives it a k-th score; then it goes, with that score, only to partitions whose bound
reaches it, and only what beats the k-th comes back. The partitions' bounds are given to all tasks while they are below
``MOST_BOUNDS`` numbers; beyond that every query goes to every partition. Memory: one partition's blocks and one batch.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without
id; a shorter vector counts as ending in zeros; rows with the query's id are never its candidates; rows that repeat
a query row (id and vector) are one query; repeated candidates are candidates each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assetlake.llm.columns import store

SCALE = 64
BLOCK = 64
PARTITION = 16_384
BATCH = 256
TURN = 16
MOST_BOUNDS = 1 << 23
_CODE = 24
_SEARCHED = "query_id bigint, h bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, q) of the rows that take part."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))
    return vectors.where(usable).select(F.col(key).alias("id"), F.transform(numbers, lambda x: F.floor(x * scale)).alias("q"))


def _matrix(vectors: pa.ListArray, width: int = 0) -> np.ndarray:
    """Rows of a column of arrays, filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), dtype=np.float64)
    out[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def bounds_of(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Largest score that a query can have in each of the boxes, with room for rounding where floats are not exact."""
    width = max(queries.shape[1], high.shape[1])
    queries, high, low = _widened(queries, width), _widened(high, width), _widened(low, width)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    most = np.abs(queries).max(initial=0) * max(np.abs(high).max(initial=0), np.abs(low).max(initial=0)) * max(1, width)
    return bounds if most < 2.0**53 else bounds + np.abs(bounds) * 1e-9 + 1


class Blocks:
    """The blocks of one partition."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        cuts = np.arange(0, len(ids), BLOCK)
        self.high, self.low = np.maximum.reduceat(rows, cuts), np.minimum.reduceat(rows, cuts)
        self.largest = np.abs(rows).max(initial=0)

    def best(self, ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, candidate ids, scores) of each query's best k here, ties to the smaller id.

        Only candidates that come before (``kth``, ``kth_id``) count, the query's k-th so far.
        """
        width = max(queries.shape[1], self.rows.shape[1])
        queries, rows = _widened(queries, width), _widened(self.rows, width)
        if np.abs(queries).max(initial=0) * self.largest * max(1, width) >= 2.0**53:
            return self._large(ids, queries, rows, k, kth, kth_id)
        bounds = bounds_of(queries, self.high, self.low)
        order = np.argsort(-bounds.max(axis=0), kind="stable")
        kth, kth_id = kth.copy(), kth_id.copy()
        place, names, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64)
        for turn in range(0, len(order), TURN):
            blocks = order[turn : turn + TURN]
            near = bounds[:, blocks] >= kth[:, None]
            some = np.flatnonzero(near.any(axis=1))
            if not len(some):
                continue
            blocks = blocks[near.any(axis=0)]
            at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            at = at[at < len(self.ids)]
            own, found = self.ids[at], queries[some] @ rows[at].T
            found[own == ids[some][:, None]] = -np.inf
            least = kth[some]
            if len(at) > k:  # what is below the k-th of this product cannot stay
                least = np.maximum(least, np.partition(found, len(at) - k, axis=1)[:, len(at) - k])
            hit = (found >= least[:, None]) & (found > -np.inf)
            hit &= (found > kth[some][:, None]) | (own < kth_id[some][:, None])
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            place = np.concatenate((place, some[i]))
            names, scores = np.concatenate((names, own[j])), np.concatenate((scores, found[i, j]))
            first = np.lexsort((names, -scores, place))
            place, names, scores = place[first], names[first], scores[first]
            rank = np.arange(len(place)) - np.searchsorted(place, place)
            last = rank == k - 1
            kth[place[last]], kth_id[place[last]] = scores[last], names[last]
            place, names, scores = place[rank < k], names[rank < k], scores[rank < k]
        return place, names, scores.astype(np.int64)

    def _large(self, ids: np.ndarray, queries: np.ndarray, rows: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray) -> tuple:
        """The same for values beyond exact floats, in whole numbers of any size and without bounds."""
        out: list[list] = [[], [], []]
        whole = [[int(x) for x in row] for row in rows.tolist()]
        for i, query in enumerate(queries.tolist()):
            q = [int(x) for x in query]
            scored = sorted((-sum(x * y for x, y in zip(q, row, strict=True)), n) for row, n in zip(whole, self.ids.tolist(), strict=True) if n != ids[i])
            for score, name in scored[:k]:
                if np.isinf(kth[i]) or (score, name) < (-int(kth[i]), int(kth_id[i])) or abs(score) >= 2**53:
                    out[0].append(i)
                    out[1].append(name)
                    out[2].append(-score)
        return tuple(np.array(x, dtype=np.int64) for x in out)


def _searched(both: DataFrame, parts: int, k: int) -> DataFrame:
    """Answers of queries (role 1) from the rows (role 0) of the partition they are sent to, as ``_SEARCHED``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, blocks = None, [], None
        for batch in batches:
            part, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(role) != 0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                if part[start] != now:
                    now, rows, blocks = part[start], [], None
                piece = batch.slice(start, end - start)
                if role[start] == 0:
                    rows.append((piece.column(2).to_numpy(), _matrix(piece.column(3))))
                    continue
                if rows:
                    width = max(m.shape[1] for _, m in rows)
                    blocks = Blocks(np.concatenate([i for i, _ in rows]), np.concatenate([_widened(m, width) for _, m in rows]))
                    rows = []
                for first in range(0, end - start if blocks else 0, BATCH):
                    asked = piece.slice(first, BATCH)
                    kth, kth_id = asked.column(5).to_numpy(zero_copy_only=False), asked.column(6).to_numpy()
                    found = blocks.best(asked.column(2).to_numpy(), _matrix(asked.column(3)), k, kth, kth_id)
                    if len(found[0]):
                        place = pa.array(found[0])
                        yield pa.RecordBatch.from_arrays(
                            [asked.column(2).take(place), asked.column(4).take(place), pa.array(found[1]), pa.array(found[2])],
                            names=["query_id", "h", "vec_id", "score"],
                        )

    dealt = both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "role")
    return dealt.mapInArrow(search, _SEARCHED)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by_query = Window.partitionBy("query_id", "h").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


def _partition_bounds(stored: DataFrame) -> DataFrame:
    """(part, high, low): the largest and smallest value of each component in a partition; what a shorter vector lacks is 0."""
    flat = stored.select("part", "id", F.posexplode("q").alias("i", "x")).groupBy("part", "i").agg(F.max("x").alias("hi"), F.min("x").alias("lo"), F.count("*").alias("n"))
    sizes = stored.groupBy("part").agg(F.count("*").alias("all"))
    whole = flat.join(sizes, "part").select(
        "part", "i", F.when(F.col("n") < F.col("all"), F.greatest("hi", F.lit(0))).otherwise(F.col("hi")).alias("hi"),
        F.when(F.col("n") < F.col("all"), F.least("lo", F.lit(0))).otherwise(F.col("lo")).alias("lo"),
    )
    boxes = whole.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("i", "hi", "lo"))).alias("box"))
    return sizes.select("part").join(boxes, "part", "left").select("part", F.coalesce(F.col("box.hi"), F.array()).alias("high"), F.coalesce(F.col("box.lo"), F.array()).alias("low"))


def _sent(queries: DataFrame, parts: np.ndarray, high: np.ndarray, low: np.ndarray, first: bool) -> DataFrame:
    """Queries with a partition each: the one with the largest bound, or all others whose bound reaches the k-th score."""
    columns = ["id", "q", "h", "kth", "kth_id"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                piece = batch.slice(start, BATCH)
                bounds = bounds_of(_matrix(piece.column(1)), high, low)
                best = bounds.argmax(axis=1)
                if first:
                    i, j = np.arange(len(best)), best
                else:
                    reach = bounds >= piece.column(3).to_numpy(zero_copy_only=False)[:, None]
                    reach[np.arange(len(best)), best] = False
                    i, j = np.nonzero(reach)
                for cut in range(0, len(i), 10_000):
                    rows = pa.array(i[cut : cut + 10_000])
                    part = pa.array(parts[j[cut : cut + 10_000]].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([part, *[piece.column(c).take(rows) for c in range(5)]], names=["part", *columns])

    return queries.select(*columns).mapInArrow(send, "part int, id bigint, q array<bigint>, h bigint, kth double, kth_id bigint")


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows of ``vectors`` for each row of ``queries``."""
    kind = vectors.schema[key].dataType.simpleString()
    rows = quantised(vectors, key, vector, scale)
    parts = -(-rows.count() // PARTITION) or 1
    code = F.aggregate(F.slice("q", 1, _CODE), F.lit(0).cast("long"), lambda a, x: a * 2 + (x >= 0).cast("long"))
    dealt = rows.select("id", "q", code.alias("code")).repartitionByRange(parts, "code", "id").sortWithinPartitions("code", "id")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, part, np.int32)), batch.column(0), batch.column(1)], names=["part", "id", "q"]
            )

    # Stored, as sampled range bounds differ from one evaluation to the next.
    stored = store(dealt.select(F.col("id").cast("long"), "q").mapInArrow(number, "part int, id bigint, q array<bigint>"), "vectors")
    # A query is an id and a vector; the vector's hash tells queries of one id apart.
    asked = quantised(queries, key, vector, scale).select(F.col("id").cast("long").alias("id"), "q").distinct().withColumn("h", F.xxhash64("q"))
    open_end = {"kth": F.lit(float("-inf")), "kth_id": F.lit(-(1 << 63)).cast("bigint")}
    shape = stored.agg(F.count_distinct("part").alias("parts"), F.max("part").alias("last"), F.max(F.size("q")).alias("width")).first()
    tasks = (shape["last"] or 0) + 1
    candidates = stored.select(
        "part", F.lit(0).alias("role"), "id", "q", F.lit(0).cast("bigint").alias("h"), F.lit(0.0).alias("kth"), F.lit(0).cast("bigint").alias("kth_id")
    )

    def searched(sent: DataFrame) -> DataFrame:
        return _searched(candidates.unionByName(sent.withColumn("role", F.lit(1))), tasks, k)

    if 2 * shape["parts"] * (shape["width"] or 0) > MOST_BOUNDS:
        held = F.explode(F.array(*[F.lit(r["part"]) for r in stored.select("part").distinct().collect()])).alias("part")  # a number a partition
        found = searched(asked.withColumns(open_end).select(held, "*"))
    else:
        boxes = sorted(_partition_bounds(stored).collect())  # at most MOST_BOUNDS numbers
        width = shape["width"] or 0
        part = np.array([b["part"] for b in boxes], dtype=np.int64)
        high, low = [np.array([[*b[side], *[0] * (width - len(b[side]))] for b in boxes], dtype=np.float64).reshape(len(boxes), width) for side in ("high", "low")]
        if not len(part):
            return stored.select(F.col("id").cast(kind).alias("query_id"), F.lit(0).alias("rank"), F.col("id").cast(kind).alias("vec_id"), F.lit(0).cast("bigint").alias("score"))
        once = store(_ranked(searched(_sent(asked.withColumns(open_end), part, high, low, True)), k), "first")
        last = once.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "h", F.col("score").cast("double").alias("kth"), F.col("vec_id").alias("kth_id"))
        again = asked.join(last, ["id", "h"], "left")
        again = again.withColumns({c: F.coalesce(F.col(c), value) for c, value in open_end.items()})
        found = once.drop("rank").unionByName(searched(_sent(again, part, high, low, False)))
    ranked = _ranked(found, k)
    return ranked.select(F.col("query_id").cast(kind), "rank", F.col("vec_id").cast(kind), "score")
