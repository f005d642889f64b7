"""Documents whose sets of five-word shingles have a Jaccard similarity of 80 % or more.

The join is exact and never lists the pairs of a group of copies:

1. Equal sets become one class (by a 128-bit hash); its smallest id stands for it.
2. *Shards.* Shingle hashes are cut into blocks by value. Two sets that link differ in at most
   (|x| + |y|) / 9 elements, so in at most as many blocks. Of its non-empty blocks, in an order common to
   all sets (most elements first), each set gives the first one more than that as keys: linked sets share a key.
   In small sets a block is little more than a shingle, and one of a very common line would bring all sets with that line
   together: such blocks are counted, and the common ones come last in the order.
   The number of blocks belongs to a size class; a set also gives keys for the class below if a partner can be there.
3. *Neighbourhoods.* Sets that share keys gather round the set with which they share most, and a neighbourhood
   is split into chunks of bounded size. A set also visits the other chunks in which a set shares a key with it
   (of two chunks, the smaller one's sets visit the larger one).
4. *Count-vector R-tree.* Shingles are hashed into ``GROUPS`` groups; a set's group counts are a point. An R-tree
   over the points of a chunk bounds the overlap of a query and everything below a node by the sum of coordinate
   minima; pairs whose bound is enough are verified on the sets, members of a chunk and its visitors. Pairs that are connected already are skipped.
5. Links found in all tasks, a spanning forest from each, are joined to components.

Defined cases: null and empty texts have an empty set and link with nothing; a text of fewer than five words is
one shingle; a row without id counts its shingles and has no component; rows that share an id share its links, also where their
texts differ: each of the texts is compared, and what they link with is one component, also with rows of the id that are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.columns import runs, small_enough, store, tidy
from assetlake.llm.words import mix, shingle_sets

#: A pair links when 100 * intersection >= PERCENT * union.
PERCENT = 80
GROUPS = 64
#: Bounds of a chunk: sets, and shingles of all of them.
CHUNK_SETS, CHUNK_SHINGLES = 256, 1_000_000
#: Sets below this size have single shingles as blocks.
SMALL = 64
#: Below this size the blocks of sets are counted; one that more than COMMON_SETS have is common, of which the most common are kept.
COUNTED, COMMON_SETS, COMMON_KEYS = 128, 32, 65_536
_BATCH_BYTES = 400_000
BROADCAST_ROWS = 1_000_000
_SEEN_SETS = 1_000_000


def sets_of(texts: list[str]) -> Iterator[np.ndarray]:
    """Shingle sets of the texts, some at a time."""
    batch, size = [], 0
    for text in texts:
        data = text.encode("utf-8")
        batch.append(data)
        size += len(data)
        if size > _BATCH_BYTES:
            yield from shingle_sets(batch)
            batch, size = [], 0
    if batch:
        yield from shingle_sets(batch)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed numbers."""
    if not len(shingles):
        return 0, 0
    a, b = mix(shingles).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


class Common:
    """Keys that very many sets have; rarer ones come first in every set."""

    def __init__(self, keys: np.ndarray) -> None:
        """``keys``: the common ones, the least common first."""
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], (order + 1).astype(np.uint32)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """0 for a key that is not common."""
        if not len(self.keys):
            return np.zeros(len(keys), np.uint32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], np.uint32(0))


_NONE = Common(np.empty(0, np.uint64))


def _blocks(level: int) -> int:
    """Blocks of the sets with 2^level shingles and more; 0 stands for single shingles."""
    return (3 << level) // 4 if 1 << level >= SMALL else 0


def _salt(level: int) -> int:
    return 2 * level + 1 if 1 << level >= SMALL else 1


def _block_keys(shingles: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all non-empty blocks of a size class, and how many shingles each has."""
    blocks = _blocks(level)
    if blocks:
        at = ((shingles >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        starts = np.flatnonzero(np.diff(at, prepend=at[:1] + np.uint64(1)))
        sums = np.add.reduceat(mix(shingles), starts)
        counts = np.diff(starts, append=len(shingles))
    else:
        sums, counts = mix(shingles), np.ones(len(shingles), dtype=np.int64)
    return mix(sums ^ np.uint64(_salt(level))), counts


def _first_blocks(shingles: np.ndarray, level: int, differing: int, common: Common) -> np.ndarray:
    """Keys of the first ``differing + 1`` non-empty blocks."""
    keys, counts = _block_keys(shingles, level)
    if len(keys) <= differing + 1:
        return keys
    if 1 << level < COUNTED:
        order = np.lexsort((keys, -counts, common.rank(keys)))
    else:
        order = np.lexsort((keys, -counts))
    return keys[order[: differing + 1]]


def _levels(size: int) -> list[tuple[int, int]]:
    """(size class, blocks that may differ) for which a set of that size gives keys."""
    level = size.bit_length() - 1
    if size < SMALL:
        return [(0, size // 4)]
    floor = 1 << level  # sets of this class have at least so many shingles
    if 4 * size < 5 * floor:  # 0.8 * size < floor: the smaller one of a pair can be in the class below
        return [(level, size // 4), (level - 1, (size + floor - 1) // 9)]
    return [(level, size // 4)]


def shard_keys(shingles: np.ndarray, common: Common = _NONE) -> np.ndarray:
    """Keys such that any two sets that link share one, whatever keys are ``common``, if that is the same for both."""
    if not len(shingles):
        return np.empty(0, np.uint64)
    return np.concatenate([_first_blocks(shingles, level, differing, common) for level, differing in _levels(len(shingles))])


def _membership(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n_shingles, a, b): the size and digest of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in runs(batch):
                rows = [(len(s), *set_digest(s)) for s in sets_of(texts)]
                columns = zip(*rows, strict=True)
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=["id", "n_shingles", "a", "b"]
                )

    return docs.select(F.col(key).cast("long"), text).mapInArrow(tidy(run), "id bigint, n_shingles bigint, a bigint, b bigint")


def _texts_with_digest(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n_shingles, a, b, text) of the rows with id, as ``_membership`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in runs(batch):
                columns = zip(*((len(s), *set_digest(s)) for s in sets_of(texts)), strict=True)
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns), pa.array(texts, pa.string())],
                    names=["id", "n_shingles", "a", "b", "text"],
                )

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), text)
    return rows.mapInArrow(tidy(run), "id bigint, n_shingles bigint, a bigint, b bigint, text string")


def _common(docs: DataFrame, key: str, text: str) -> Common:
    """The most common keys of small sets. They decide on an order only, so a long text need not be looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in runs(batch):
                keys = []
                for shingles in sets_of(texts):
                    if 0 < len(shingles) < COUNTED:
                        keys += [_block_keys(shingles, level)[0] for level, _ in _levels(len(shingles))]
                if keys:
                    found, counts = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], names=["key", "n"])

    rows = docs.where(F.col(key).isNotNull() & (F.octet_length(text) <= 12 * COUNTED)).select(F.col(key).cast("long"), text)
    counts = rows.mapInArrow(tidy(run), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON_SETS)
    most = counts.orderBy(F.desc("n"), "key").limit(COMMON_KEYS).select("key").toArrow().column("key").to_numpy()
    return Common(most[::-1].view(np.uint64))


def _keys(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id) of every set; a task gives equal sets once."""
    common = _common(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for ids, texts in runs(batch):
                keys, owners = [], []
                for i, shingles in zip(ids, sets_of(texts), strict=True):
                    digest = set_digest(shingles)
                    if digest in seen or not len(shingles):
                        continue
                    if len(seen) < _SEEN_SETS:
                        seen.add(digest)
                    own = shard_keys(shingles, common)
                    keys.append(own)
                    owners.append(np.full(len(own), i, dtype=np.int64))
                if keys:
                    yield pa.record_batch(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], names=["key", "id"]
                    )

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), text)
    return rows.mapInArrow(tidy(run), "key bigint, id bigint")


def _shared(keys: DataFrame) -> DataFrame:
    """(key, id, center) of keys that two rows or more have; the center is the smallest id of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, int, bool] | None = None  # the last row so far: key, id, center, shared

        def rows(key, i, center) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, pa.int64()) for x in (key, i, center)], names=["key", "id", "center"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, i = (batch.column(c).to_numpy() for c in (0, 1))
            first_center, first_shared = i[0], False
            if held is not None:
                key, i = np.concatenate(([held[0]], key)), np.concatenate(([held[1]], i))
                first_center, first_shared = held[2], held[3]
            same = key[1:] == key[:-1]
            starts = np.concatenate(([0], np.flatnonzero(~same) + 1))
            lengths = np.diff(starts, append=len(key))
            centers = i[starts]
            centers[0] = first_center
            center = np.repeat(centers, lengths)
            shared = np.concatenate(([first_shared], same))
            keep = shared.copy()
            keep[:-1] |= same
            held = (int(key[-1]), int(i[-1]), int(center[-1]), bool(shared[-1]))
            keep[-1] = False
            if keep.any():
                yield rows(key[keep], i[keep], center[keep])
        if held is not None and held[3]:
            yield rows(held[:1], held[1:2], held[2:3])

    dealt = keys.repartition("key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(tidy(run), "key bigint, id bigint, center bigint")


def group_counts(shingles: np.ndarray) -> np.ndarray:
    """The point of a set: how many of its shingles fall into each group."""
    return np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=GROUPS)


class CountTree:
    """An R-tree over group counts, packed bottom-up; nodes keep coordinate maxima and the range of sizes."""

    FANOUT = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((points.argmax(axis=1), sizes))
        high, least, most = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(high, least, most)]
        while len(high) > self.FANOUT:
            cuts = np.arange(0, len(high), self.FANOUT)
            high = np.maximum.reduceat(high, cuts)
            least, most = np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((high, least, most))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Points whose bound allows a link with the query, the largest bounds first."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, most = (x[nodes] for x in self.levels[depth])
            bound = np.minimum(high, point).sum(axis=1)
            enough = (100 + PERCENT) * bound >= PERCENT * (size + least)
            enough &= (100 * most >= PERCENT * size) & (PERCENT * least <= 100 * size)
            nodes, bound = nodes[enough], bound[enough]
            if depth:
                nodes = (nodes[:, None] * self.FANOUT + np.arange(self.FANOUT)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return self.order[nodes[np.argsort(-bound, kind="stable")]]


class Forest:
    """Union by smallest index."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = sorted((self.root(i), self.root(j)))
        self.up[b] = a


def _links(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


class Chunk:
    """The sets of a chunk: an R-tree over their points, and a forest of what is connected so far."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.forest = Forest(len(sets))
        self.tree = CountTree(np.stack([group_counts(s) for s in sets]), np.array([len(s) for s in sets]))
        leaders: list[int] = []  # sets near one of a few leaders connect at once
        for i in range(len(sets)):
            for leader in leaders:
                if _links(sets[leader], sets[i]):
                    self.forest.link(leader, i)
                    break
            else:
                if len(leaders) < 3:
                    leaders.append(i)
        for i in range(len(sets)):
            for j in self.tree.search(group_counts(sets[i]), len(sets[i])).tolist():
                if j < i and self.forest.root(i) != self.forest.root(j) and _links(sets[i], sets[j]):
                    self.forest.link(i, j)

    def visit(self, shingles: np.ndarray) -> int | None:
        """A member that the visitor is connected with; members it connects are connected from then on."""
        found = None
        for j in self.tree.search(group_counts(shingles), len(shingles)).tolist():
            if (found is None or self.forest.root(found) != self.forest.root(j)) and _links(self.sets[j], shingles):
                if found is None:
                    found = j
                else:
                    self.forest.link(found, j)
        return found

    def edges(self) -> list[tuple[int, int]]:
        return [(r, i) for i in range(len(self.sets)) if (r := self.forest.root(i)) != i]


def _compare(members: DataFrame) -> DataFrame:
    """Links (u, v) within each chunk, from (chunk, side, id, text) rows: its members (side 0) and then its visitors.

    Members are held, their number is bounded; visitors pass by.
    """

    def links(pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        if pairs:
            u, v = zip(*pairs, strict=True)
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts, chunk = None, [], [], None

        def close() -> Iterator[pa.RecordBatch]:
            own = chunk or (Chunk(list(sets_of(texts))) if ids else None)
            if own is not None:
                yield from links([(ids[a], ids[b]) for a, b in own.edges()])

        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                at, side, names, bodies = (c.to_pylist() for c in batch.slice(low, 200).columns)
                passing = sets_of([t if s else "" for s, t in zip(side, bodies, strict=True)])
                pairs = []
                for c, s, i, text, shingles in zip(at, side, names, bodies, passing, strict=True):
                    if c != now:
                        yield from close()
                        now, ids, texts, chunk = c, [], [], None
                    if not s:
                        ids.append(i)
                        texts.append(text)
                        continue
                    if chunk is None and ids:
                        chunk = Chunk(list(sets_of(texts)))
                        texts = []
                    found = chunk.visit(shingles) if chunk is not None else None
                    if found is not None:
                        pairs.append((ids[found], i))
                yield from links(pairs)
        yield from close()

    dealt = members.repartition("chunk").sortWithinPartitions("chunk", "side", "id")
    return dealt.select("chunk", "side", "id", "text").mapInArrow(tidy(run), "u bigint, v bigint")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the edges (u, v); a component is named by its smallest node.

    Alternates large-star and small-star steps until nothing changes; every step is stored.
    """
    edges = store(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")

    def state(df: DataFrame) -> tuple[int, int]:
        row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return row["n"], row["x"] or 0

    before = state(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        large = store(large, "large")
        low = store(large.groupBy("v").agg(F.min("u").alias("m")), "low")
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("m"), F.col("u")), F.struct("m", F.col("v").alias("u")))).alias("e"))
        edges = store(small.select(F.col("e.m").alias("u"), F.col("e.u").alias("v")).where("u <> v").distinct(), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    ends = edges.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component")
    return ends.unionAll(ends.select(F.col("component").alias("node"), "component").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles and component_id (the smallest id that links reach) for every row."""
    members = store(_membership(docs, key, text), "sets")
    span = lambda c: F.min(c) < F.max(c)
    several = members.where("id is not null").groupBy("id").agg((span("a") | span("b") | span("n_shingles")).alias("several"))
    if several.where("several").limit(1).count():
        return _by_number(docs, members, key, text)
    return _one_set_an_id(docs, members, key, text)


def _by_number(docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """``near_duplicates`` where an id has rows of different sets: every (id, set) is compared under a number of its own.

    Numbers rise with the ids, so the smallest number of a component belongs to its smallest id.
    """
    sets = members.where("id is not null").select("id", "a", "b", "n_shingles").distinct()
    ordered = sets.repartitionByRange("id", "a", "b", "n_shingles").sortWithinPartitions("id", "a", "b", "n_shingles")
    numbered = store(ordered.select("*", F.monotonically_increasing_id().alias("number")), "numbered")
    digests = ["id", "a", "b", "n_shingles"]
    texts = _texts_with_digest(docs, key, text).join(numbered, digests).select("number", "text")
    texts = store(texts, "numbered_texts")
    found = near_duplicates(texts, "number", "text").distinct()
    first = numbered.groupBy("id").agg(F.min("number").alias("u"))
    links = found.where("component_id <> number").select(F.col("component_id").alias("u"), F.col("number").alias("v"))
    comps = connected(links.unionAll(numbered.join(first, "id").where("u <> number").select("u", F.col("number").alias("v"))))
    comps = store(comps, "numbered_components")
    names = numbered.select(F.col("number").alias("component"), F.col("id").alias("component_id"))
    by_id = numbered.join(comps, numbered["number"] == comps["node"]).join(names, "component").select("id", "component_id").distinct()
    by_id = store(by_id, "named")
    kind = docs.schema[key].dataType
    out = members.join(by_id, "id", "left")
    return out.select(F.col("id").cast(kind).alias(key), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def _one_set_an_id(docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """``near_duplicates`` where all rows of an id have the same set."""
    full = members.where("n_shingles > 0 and id is not null")
    classes = store(full.groupBy("a", "b", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    shared = store(_shared(_keys(docs, key, text)), "shared")

    # The representative of each row's class, for rows that share keys.
    pairs = store(shared.groupBy("id", "center").agg(F.count("*").alias("n")), "pairs")
    wanted = pairs.select("id").unionAll(pairs.select(F.col("center").alias("id"))).distinct()
    reps = store(
        full.join(small_enough(wanted, BROADCAST_ROWS), "id", "left_semi").join(classes, ["a", "b", "n_shingles"])
        .groupBy("id").agg(F.min("rep").alias("rep"), F.max("n_shingles").alias("n_shingles")), "reps",
    )
    near = pairs.join(reps, "id").select("rep", "n_shingles", "center", "n")
    near = near.join(reps.select(F.col("id").alias("center"), F.col("rep").alias("hub")), "center")
    near = near.groupBy("rep", "hub").agg(F.sum("n").alias("n"), F.max("n_shingles").alias("n_shingles"))
    own = F.col("hub") == F.col("rep")
    homes = store(near.groupBy("rep").agg(
        F.max_by("hub", F.struct(~own, F.col("n"), -F.col("hub"))).alias("hub"), F.max("n_shingles").alias("n_shingles")
    ), "homes")
    # A hub that gathers others is at home with itself.
    hubs = homes.where("hub <> rep").select(F.col("hub").alias("rep")).distinct().withColumn("gathers", F.lit(True))
    homes = store(homes.join(hubs, "rep", "left").select(
        "rep", "n_shingles", F.when(F.col("gathers"), F.col("rep")).otherwise(F.col("hub")).alias("hub")
    ), "homes")
    sizes = homes.groupBy("hub").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("shingles"))
    parts = F.ceil(F.greatest(F.col("sets") / CHUNK_SETS, F.col("shingles") / CHUNK_SHINGLES))
    sizes = store(sizes.select("hub", parts.alias("parts")), "sizes")
    chunks = homes.join(sizes, "hub").select("rep", F.xxhash64("hub", F.pmod(F.xxhash64("rep"), "parts")).alias("chunk"))
    chunks = store(chunks, "chunks")
    chunks = store(chunks.join(chunks.groupBy("chunk").agg(F.count("*").alias("size")), "chunk"), "chunks")

    # A set visits the larger ones of the chunks in which a set has a key of it. A key keeps its chunks, not its sets.
    by_row = store(reps.join(chunks, "rep").select("id", "rep", F.struct("size", "chunk").alias("chunk")), "row_chunks")
    located = shared.select("key", "id").join(by_row, "id").select("key", "rep", "chunk")
    per_key = located.groupBy("key").agg(F.collect_set("chunk").alias("all")).where(F.size("all") > 1)
    larger = F.filter("all", lambda c: c > F.col("chunk"))
    # Most keys of a set name the same chunks: they are put together for each set before they become rows.
    targets = located.join(per_key, "key").select("rep", larger.alias("to")).groupBy("rep").agg(F.collect_set("to").alias("to"))
    targets = targets.select("rep", F.explode(F.array_distinct(F.flatten("to"))).alias("to"))
    visits = store(targets.select("rep", F.col("to.chunk").alias("chunk")), "visits")
    used = chunks.where("size > 1").select("chunk").unionAll(visits.select("chunk")).distinct()
    roles = chunks.join(used, "chunk", "left_semi").select("chunk", F.lit(0).alias("side"), F.col("rep").alias("id"))
    roles = store(roles.unionAll(visits.select("chunk", F.lit(1).alias("side"), F.col("rep").alias("id"))), "roles")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null")
    texts = texts.join(small_enough(roles.select("id").distinct(), BROADCAST_ROWS), "id", "left_semi")
    links = _compare(texts.join(roles, "id"))

    comps = store(connected(links), "components")
    named = classes.join(comps, classes["rep"] == comps["node"], "left").where("copies > 1 or component is not null")
    named = store(named.select("a", "b", "n_shingles", F.coalesce("component", "rep").alias("component")), "named")
    out = members.join(named, ["a", "b", "n_shingles"], "left")
    kind = docs.schema[key].dataType
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").cast(kind).alias(key), "n_shingles", component.alias("component_id"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each component the document that names it stays.

    Of rows that repeat id and text one stays; rows without id stay.
    """
    found = store(near_duplicates(docs).select("doc_id", "component_id"), "duplicates")
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(small_enough(gone, BROADCAST_ROWS), "doc_id", "left_anti").select(*docs.columns)
    again = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    again = small_enough(store(again, "repeated"), BROADCAST_ROWS)
    once = kept.join(again, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
