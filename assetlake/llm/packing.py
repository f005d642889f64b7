"""Packing of documents into sequences of a fixed number of tokens.

A document is its token ids and an end id. Longer ones are cut into pieces of the full capacity and
a rest. Pieces go into sequences by linear grouping: the large lengths, in falling order, are cut into
groups of equal cardinality and every length counts as the largest of its group, so that few sizes
are left; configurations of these sizes are chosen so that each fills a sequence as far as the
remaining demand allows; the actual pieces take the places of the rounded sizes; the small pieces then
go where they fit best, into what rounding and configurations left free.

The plan needs nothing but the number of pieces of each length, so the driver sees at most ``capacity``
rows whatever the input. A piece finds its place by its length and its rank among the pieces of that
length; ranks come from a running number inside each slice of the stored pieces and the offset of
the slice, so a very common length is spread over all slices.

Defined cases: a null or empty text is its end id alone; ``<|startoftext|>`` and ``<|endoftext|>`` written in a text are
the ids 49406 and 49407, as in the tokenizer's own call (``add_special_tokens=False``); repeated rows and null ids are pieces of
their own; an empty table gives no sequences.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assetlake.llm.columns import keeps, runs, store, tidy

CAPACITY = 4_096
END_ID = 1
#: Lengths above this share of the capacity are large.
LARGE_SHARE = 1 / 4
#: Numbers of groups of equal cardinality that are tried; the plan with the fewest sequences is taken.
GROUPS = (8, 16, 24, 32, 64, 128, 256)
CACHE_WORDS, CACHE_CHARS = 250_000, 64

# Below U+0180 (but for two white spaces and one letter) normalising changes nothing, lower case is the same
# in every library, and letters and numbers are those listed here; the tokenizer's own pattern then reads so.
_LETTERS, _NUMBERS, _BLANKS = "a-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", " \t\n\r\x0b\x0c"
_PLAIN = re.compile("[\x00-\x84\x86-\x9f¡-įı-ſ]*")
_WORD = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of a text. Words repeat, so their ids are remembered; new words go to the tokenizer together."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens must be taken as they are written")
        self.added = {t.content: np.array([i], dtype="<u4").tobytes() for i, t in added.items()}
        self.cuts = re.compile(f"({'|'.join(map(re.escape, self.added))})")
        self.tokenizer.encode_special_tokens = True  # for the texts between added tokens
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.fresh: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """Parts of the text that the tokenizer handles apart from each other."""
        if _PLAIN.fullmatch(text):
            return _WORD.findall(text.lower())
        parts: list[str] = []
        for chunk in re.split(f"[{_BLANKS}]+", text):
            if _PLAIN.fullmatch(chunk):
                parts += _WORD.findall(chunk.lower())
            elif chunk:
                parts.append(chunk)
        return parts

    def _new(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of words. Plain words go through the tokenizer as one text and are told apart by their last tokens."""
        plain = [w for w in words if _PLAIN.fullmatch(w)]
        for start in range(0, len(plain), 1_000):
            batch = plain[start : start + 1_000]
            ids = np.array(self.tokenizer.encode(" ".join(batch), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            assert len(ends) == len(batch)
            starts = np.concatenate(([0], ends[:-1]))
            yield from zip(batch, (ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())), strict=True)
        other = [w for w in words if not _PLAIN.fullmatch(w)]
        found = self.tokenizer.encode_batch(other, add_special_tokens=False)
        yield from ((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(other, found, strict=True))

    def encode_marked(self, texts: list[str]) -> list[bytes]:
        """As ``encode``, but added tokens written in a text are ids of their own, as the tokenizer takes them by default."""
        if not any(c in t for t in texts for c in self.added):
            return self.encode(texts)
        cut = [[p for p in self.cuts.split(t) if p] if any(c in t for c in self.added) else [t] for t in texts]
        plain = iter(self.encode([p for parts in cut for p in parts if p not in self.added]))
        return [b"".join([self.added[p] if p in self.added else next(plain) for p in parts]) for parts in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; added tokens written in it are plain characters."""
        out: list[bytes | None] = []
        later: list[tuple[int, list[str]]] = []
        fresh, old, missing, long = self.fresh, self.old, set(), {}
        for i, text in enumerate(texts):
            words = self.words(text)
            try:
                out.append(b"".join(map(fresh.__getitem__, words)))
                continue
            except KeyError:
                out.append(None)
                later.append((i, words))
            for w in words:
                if w not in fresh:
                    found = old.get(w)
                    if found is None:
                        missing.add(w)
                    else:
                        fresh[w] = found
        for w, ids in self._new(sorted(missing)):
            (fresh if len(w) <= CACHE_CHARS else long)[w] = ids
        for i, words in later:
            out[i] = b"".join([fresh[w] if w in fresh else long[w] for w in words])
        if len(fresh) > CACHE_WORDS:
            self.old, self.fresh = fresh, {}
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    keeps(__name__, encoder.cache_clear)
    return Encoder(path)


def cut_pieces(docs: DataFrame, key: str, text: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row per piece, with the slice that made it and its running number among the slice's pieces of that length."""
    end = np.array([end_id], dtype="<u4").tobytes()
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, slice int, number bigint"
    )
    fields = docs.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, part = encoder(tokenizer), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for keys, texts in runs(batch):
                rows = []
                for k, ids in zip(keys, own.encode_marked(texts), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        data = ids[at : at + 4 * capacity]
                        length = len(data) // 4
                        rows.append((k, piece, at // 4, length, zlib.crc32(data), part, seen[length]))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields
                )

    return docs.select(F.col(key), F.col(text)).mapInArrow(tidy(run), schema)


class Plan:
    """Where the pieces of each length go, from the number of pieces of each length.

    A segment says: ``n`` pieces of ``length``, from ``rank`` on, go ``each`` to a sequence, from
    ``sequence`` on, at ``offset``. A stretch is a run of sequences with the same filling.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS[1], large_share: float = LARGE_SHARE) -> None:
        self.capacity = capacity
        self.used = 0
        self.taken: Counter[int] = Counter()
        self.segments: list[tuple[int, int, int, int, int, int]] = []
        self.free: dict[int, list[tuple[int, int]]] = {}
        small_most = int(capacity * large_share)
        large = {n: c for n, c in counts.items() if n > small_most}
        small = {n: c for n, c in counts.items() if n <= small_most}
        self._place_large(self._equal_groups(large, groups))
        for length in sorted(small, reverse=True):
            self._best_fit(length, small[length])

    @staticmethod
    def _equal_groups(large: dict[int, int], groups: int) -> list[list[list[int]]]:
        """Groups of equal cardinality of [length, count], in falling order of length."""
        total = sum(large.values())
        each = max(1, -(-total // groups))
        out: list[list[list[int]]] = []
        room = 0
        for length in sorted(large, reverse=True):
            left = large[length]
            while left:
                if not room:
                    out.append([])
                    room = each
                take = min(left, room)
                out[-1].append([length, take])
                left, room = left - take, room - take
        return out

    def _configuration(self, sizes: list[int], demand: list[int], first: int) -> list[int]:
        """Groups that fill a sequence with ``first`` in it as far as possible."""
        room = self.capacity - sizes[first]
        came = np.full(room + 1, -1, dtype=np.int32)  # the group whose piece reached this filling last
        came[0] = len(sizes)
        for g in range(first, len(sizes)):
            most = min(room // sizes[g], demand[g] - (g == first))
            for _ in range(most):
                reach = np.flatnonzero((came[: room + 1 - sizes[g]] >= 0) & (came[sizes[g] :] < 0))
                if not len(reach):
                    break
                came[reach + sizes[g]] = g
            if came[room] >= 0:
                break
        filled = int(np.flatnonzero(came >= 0)[-1])
        picked = [first]
        while filled:
            g = int(came[filled])
            picked.append(g)
            filled -= sizes[g]
        return picked

    def _place_large(self, groups: list[list[list[int]]]) -> None:
        sizes = [g[0][0] for g in groups]
        demand = [sum(c for _, c in g) for g in groups]
        first = 0
        while first < len(groups):
            if not demand[first]:
                first += 1
                continue
            picked = self._configuration(sizes, demand, first)
            need = Counter(picked)
            times = min(demand[g] // n for g, n in need.items())
            for g, n in need.items():
                demand[g] -= n * times
            self._substitute(groups, picked, times)

    def _substitute(self, groups: list[list[list[int]]], picked: list[int], times: int) -> None:
        """``times`` sequences of the configuration, with actual pieces of its groups."""
        slots: list[list[tuple[int, int, int]]] = []
        for g in picked:
            need, slot = times, []
            while need:
                length, left = groups[g][0]
                take = min(left, need)
                slot.append((length, self.taken[length], take))
                self.taken[length] += take
                need -= take
                if take == left:
                    groups[g].pop(0)
                else:
                    groups[g][0][1] = left - take
            slots.append(slot)
        ends = sorted({e for slot in slots for e in np.cumsum([n for _, _, n in slot]).tolist()})
        start = 0
        for end in ends:
            offset = 0
            for i, slot in enumerate(slots):
                length, rank, n = slot[0]
                self.segments.append((length, rank, end - start, self.used, 1, offset))
                offset += length
                slots[i] = slot[1:] if n == end - start else [(length, rank + end - start, n - end + start), *slot[1:]]
            self.free.setdefault(self.capacity - offset, []).append((self.used, end - start))
            self.used += end - start
            start = end

    def _best_fit(self, length: int, count: int) -> None:
        """The pieces go where the least is left over; new sequences are opened only when nothing fits."""
        rooms = sorted(self.free)
        while count:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = min(count, self.capacity // length)
                self.free.setdefault(self.capacity, []).append((self.used, count // each))
                self.used += count // each
                rooms.append(self.capacity)
            room = rooms[at]
            each = min(count, room // length)
            sequence, n = self.free[room].pop()
            use = min(n, count // each)
            if use < n:
                self.free[room].append((sequence + use, n - use))
            if not self.free[room]:
                del self.free[room]
                rooms.pop(at)
            self.segments.append((length, self.taken[length], each * use, sequence, each, self.capacity - room))
            self.taken[length] += each * use
            count -= each * use
            rest = room - each * length
            if rest not in self.free:
                self.free[rest] = []
                rooms.insert(bisect_left(rooms, rest), rest)
            self.free[rest].append((sequence, use))

    @classmethod
    def best(cls, counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
        return min((cls(counts, capacity, groups) for groups in GROUPS), key=lambda plan: plan.used)

    def table(self) -> np.ndarray:
        """Segments by length and rank."""
        rows = np.array(self.segments, dtype=np.int64).reshape(-1, 6)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None,
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """A row per piece: ``key``, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    pieces = store(cut_pieces(docs, key, text, tokenizer or default_tokenizer(), capacity, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(Plan.best(counts, capacity).table())
    made = pieces.groupBy("slice", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = made.select("slice", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["slice", "length"]).withColumn("rank", F.col("before") + F.col("number"))
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
    fields = spark.createDataFrame([], schema).toArrow().schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        keys = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            found = rows[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            index = rank - found[:, 1]
            sequence, offset = found[:, 3] + index // found[:, 4], found[:, 5] + index % found[:, 4] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in fields.names[:5]), pa.array(sequence), pa.array(offset)], schema=fields
            )

    return ranked.select(key, "piece", "start", "length", "ids_crc32", "rank").mapInArrow(tidy(place), schema)
