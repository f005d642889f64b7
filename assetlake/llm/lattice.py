"""Log probability of documents from a lattice of subwords.

A word, after a word mark, is cut into pieces of an existing unigram vocabulary in every possible way; its
probability is the sum over all cuts, taken by a forward recursion in log space. Characters without a
piece go through their bytes. Piece probabilities start from the vocabulary's scores (a piece of rank r gets a weight of 1 / (r + 1)),
and expectation-maximisation over the counted words of the training documents improves them.
A word of the training documents is one more piece: its discounted count. So

    P(token) = (max(c - D, 0) + D * V * L(token)) / N

with c, N and V from the training documents, L the lattice and D the usual discount from the numbers of words
seen once and twice. A text is its words and one end. The base score is the add-one model of words.

Word counts are a table as large as the corpus' vocabulary. The ``HEAD`` most frequent words are broadcast; texts
meet the counts of all other words in a join on the word, summed per text and word before. The lattice sees each
word once a batch, wherever it is used. Its recursions take many words at once, one place of all of them a step, in
NumPy; only words far longer than the others of their group go alone.

Defined cases: a null or empty text is the end alone; a null id is in neither fold and teaches nothing; repeated
rows get a row each; without training documents N and V are 0 and the lattice alone gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from copy import copy
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.columns import crc32_of_id, runs, store
from assetlake.llm.tokens import default_model, vocabulary

MARK = "▁"
END = b""
HELD_OUT = (7, 2)
HEAD = 60_000
ROUNDS = 2
#: Words whose expectations one task takes; the work goes with the words, not with their bytes.
TASK_WORDS = 100_000
_TABLE_WORDS = 200_000
#: Characters of words handled at once, and those a single word may have for the price of one step of many words.
_GROUP_CHARS, _STEP_CHARS = 50_000, 8
#: Ends a word among the characters of many; no character has this number.
_BREAK = 0x110000


class Trie:
    """Pieces by their characters. A step goes on from many nodes at once, through one open table of (node, character)."""

    def __init__(self, pieces: dict[str, int]) -> None:
        nodes = {"": 0}
        for piece in pieces:
            for n in range(1, len(piece) + 1):
                nodes.setdefault(piece[:n], len(nodes))
        self.piece = np.array([pieces.get(p, -1) for p in nodes])
        children = np.arange(1, len(nodes))
        keys = np.array([(nodes[p[:-1]] << 21) + ord(p[-1]) for p in nodes if p], np.int64)
        self.bits = (4 * len(nodes)).bit_length()
        self.keys, self.children = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # one of those that meet at a slot
            own = self.keys[slots] == keys
            self.children[slots[own]] = children[own]
            keys, children, slots = keys[~own], children[~own], self._next(slots[~own])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _next(self, slots: np.ndarray) -> np.ndarray:
        return (slots + 1) & ((1 << self.bits) - 1)

    def _step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each node by its character, or -1."""
        keys = (nodes << 21) + codes
        slots = self._slots(keys)
        there = self.keys[slots]
        missed = np.flatnonzero((there != keys) & (there >= 0))
        while len(missed):
            slots[missed] = self._next(slots[missed])
            there[missed] = self.keys[slots[missed]]
            missed = missed[(there[missed] != keys[missed]) & (there[missed] >= 0)]
        return np.where(there == keys, self.children[slots], -1)

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces in characters that end with a break; -1 for a character that is no piece."""
        starts, out = np.flatnonzero(codes != _BREAK), []
        nodes, size = np.zeros(len(starts), np.int64), 0
        while len(starts):
            nodes = self._step(nodes, codes[starts + size])
            size += 1
            found = self.piece[nodes]
            found[nodes < 0] = -1
            hit = slice(None) if size == 1 else found >= 0
            out.append((starts[hit], starts[hit] + size, found[hit]))
            starts, nodes = starts[nodes >= 0], nodes[nodes >= 0]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _codes(words: list[str]) -> np.ndarray:
    """Characters of the words, a break after each."""
    size = np.array([len(w) for w in words])
    out = np.full(size.sum() + len(words), _BREAK)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(size + 1) - 1] = False
    out[inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return out


@dataclass(frozen=True)
class Edges:
    """Edges of many words of falling length, by the place where they end, then by word.

    A node is a place in a word; nodes are numbered by place, then by word. Each node but those of place 0 ends an edge,
    as a character is a piece or goes through its bytes.
    """

    piece: np.ndarray  # numbers from len(pieces) on are unknown characters
    word: np.ndarray
    start: np.ndarray  # node
    heads: np.ndarray  # first edge of each node from place 1 on
    borders: list[int]  # first edge of each place
    nodes: list[int]  # first node of each place
    last: np.ndarray  # node at the end of each word
    logs: np.ndarray
    unknown: list[list[int]]  # byte pieces of each unknown character

    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        """Log of the summed weight of all paths of each word, and the share of each edge among the paths to its end."""
        at, share, first = np.zeros(self.nodes[-1]), np.empty(len(self.piece)), self.nodes[1]
        for place in range(1, len(self.nodes) - 1):
            some = slice(self.borders[place], self.borders[place + 1])
            low, high = self.nodes[place], self.nodes[place + 1]
            heads, word = self.heads[low - first : high - first] - some.start, self.word[some]
            weight = at[self.start[some]] + self.logs[self.piece[some]]
            top = np.maximum.reduceat(weight, heads)
            weight = np.exp(weight - top[word])
            total = np.add.reduceat(weight, heads)
            at[low:high] = top + np.log(total)
            share[some] = weight / total[word]
        return at[self.last], share

    def uses(self, share: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece and unknown character, from the shares and the occurrences of each word."""
        through, used = np.zeros(self.nodes[-1]), np.empty(len(share))
        through[self.last] = times
        for place in range(len(self.nodes) - 2, 0, -1):
            some = slice(self.borders[place], self.borders[place + 1])
            used[some] = share[some] * through[self.nodes[place] + self.word[some]]
            through[self.start[some]] += used[some]  # edges of one word to one place start at different places
        return np.bincount(self.piece, weights=used, minlength=len(self.logs))


class Lattice:
    """Pieces with log probabilities (base e)."""

    def __init__(self, pieces: list[str], logs: np.ndarray) -> None:
        self.pieces = pieces
        usual = {}
        self.bytes = [0] * 256
        self.end = pieces.index("</s>")
        for i, piece in enumerate(pieces):
            if len(piece) == 6 and piece.startswith("<0x"):
                self.bytes[int(piece[3:5], 16)] = i
            elif piece not in ("<unk>", "<s>", "</s>"):
                usual[piece] = i
        self.trie = Trie(usual)
        self.single = {p for p in pieces if len(p) == 1}
        self._set(logs)

    def _set(self, logs: np.ndarray) -> None:
        self.values, self.logs = np.asarray(logs), logs.tolist()

    def with_logs(self, logs: np.ndarray) -> Lattice:
        """The same pieces with other log probabilities."""
        other = copy(self)
        other._set(logs)
        return other

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, piece) by end; bytes of an unknown character share one edge, as piece -1."""
        starts, ends, pieces = (c.tolist() for c in self.trie.matches(_codes([word])))
        return sorted(zip(starts, ends, pieces, strict=True), key=lambda e: e[1])

    def _bytes_of(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode("utf-8")]

    def _weight(self, word: str, edge: tuple[int, int, int]) -> float:
        start, _, piece = edge
        return self.logs[piece] if piece >= 0 else sum(self.logs[i] for i in self._bytes_of(word[start]))

    def forward(self, word: str, edges: list[tuple[int, int, int]]) -> list[float]:
        """Log of the summed weight of all paths to each place."""
        logs, exp, log1p = self.logs, math.exp, math.log1p
        at = [-math.inf] * (len(word) + 1)
        at[0] = 0.0
        for edge in edges:
            start, end, piece = edge
            a = at[start] + (logs[piece] if piece >= 0 else self._weight(word, edge))
            b = at[end]
            if a > b:
                at[end] = a + log1p(exp(b - a))
            elif a > -math.inf:
                at[end] = b + log1p(exp(a - b))
        return at

    def word(self, word: bytes) -> float:
        """Log probability of a lower-cased word."""
        marked = MARK + word.decode("utf-8", "replace")
        return self.forward(marked, self.edges(marked))[-1]

    def expect(self, word: bytes, times: int, into: np.ndarray) -> None:
        """Add the expected uses of each piece in ``times`` occurrences of the word."""
        marked = MARK + word.decode("utf-8", "replace")
        edges = self.edges(marked)
        ahead = self.forward(marked, edges)
        total = ahead[-1]
        back = [-math.inf] * len(ahead)
        back[-1] = 0.0
        exp, log1p = math.exp, math.log1p
        for edge in reversed(edges):
            start, end, piece = edge
            a = back[end] + (self.logs[piece] if piece >= 0 else self._weight(marked, edge))
            share = exp(ahead[start] + a - total) * times
            if piece >= 0:
                into[piece] += share
            else:
                for i in self._bytes_of(marked[start]):
                    into[i] += share
            b = back[start]
            if a > b:
                back[start] = a + log1p(exp(b - a))
            elif a > -math.inf:
                back[start] = b + log1p(exp(a - b))

    def _edges_of(self, words: list[str]) -> Edges:
        """Edges of marked words of falling length."""
        size = np.array([len(w) for w in words])
        first = np.cumsum(size + 1) - size - 1
        codes, logs, unknown = _codes(words), self.values, []
        start, end, piece = self.trie.matches(codes)
        strange = np.flatnonzero(piece < 0)
        if len(strange):
            characters, which = np.unique(codes[start[strange]], return_inverse=True)
            unknown = [self._bytes_of(chr(c)) for c in characters.tolist()]
            piece[strange] = len(logs) + which
            logs = np.concatenate([logs, [logs[i].sum() for i in unknown]])
        word = np.repeat(np.arange(len(words)), size + 1)[start]
        place = end - first[word]
        order = np.argsort(word.astype(np.min_scalar_type(len(words))), kind="stable")
        order = order[np.argsort(place[order].astype(np.min_scalar_type(int(size[0]))), kind="stable")]
        piece, word, place, start = piece[order], word[order], place[order], (start - first[word])[order]
        longer = len(size) - np.searchsorted(size[::-1], np.arange(size[0] + 1))  # words with each place
        nodes = np.concatenate([[0], np.cumsum(longer)])
        heads = np.flatnonzero(np.diff(nodes[place] + word, prepend=-1))
        borders = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=size[0] + 1))])
        last = nodes[size] + np.arange(len(words))
        return Edges(piece, word, nodes[start] + word, heads, borders.tolist(), nodes.tolist(), last, logs, unknown)

    def _groups(self, words: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, Edges | None]]:
        """For a bounded group at a time: numbers of words far longer than the others, and numbers and edges of the others."""
        marked = [MARK + w.decode("utf-8", "replace") for w in words]
        size = np.array([len(w) for w in marked], np.int64)
        order = np.argsort(-size, kind="stable")
        bounds = (np.cumsum(size[order]) - size[order]) // _GROUP_CHARS
        for group in np.split(order, np.flatnonzero(np.diff(bounds)) + 1):
            sizes = size[group]
            alone = int(np.argmin(np.append(_STEP_CHARS * sizes + np.cumsum(sizes) - sizes, sizes.sum())))
            rest = group[alone:]
            yield group[:alone].tolist(), rest, self._edges_of([marked[i] for i in rest.tolist()]) if len(rest) else None

    def words(self, words: list[bytes]) -> np.ndarray:
        """Log probabilities of lower-cased words."""
        out = np.empty(len(words))
        for alone, rest, edges in self._groups(words):
            for i in alone:
                out[i] = self.word(words[i])
            if edges:
                out[rest] = edges.forward()[0]
        return out

    def expect_words(self, words: list[bytes], times: np.ndarray, into: np.ndarray) -> None:
        """Add the expected uses of each piece in ``times`` occurrences of each word."""
        for alone, rest, edges in self._groups(words):
            for i in alone:
                self.expect(words[i], int(times[i]), into)
            if edges:
                used = edges.uses(edges.forward()[1], times[rest])
                into += used[: len(into)]
                for ids, n in zip(edges.unknown, used[len(into) :].tolist(), strict=True):
                    for i in ids:
                        into[i] += n


def start_logs(scores: Iterable[float]) -> np.ndarray:
    """Log probabilities from the ranks that the vocabulary's scores give."""
    values = np.array(list(scores))
    rank = np.argsort(np.argsort(-values, kind="stable"), kind="stable")
    weights = 1.0 / (rank + 1.0)
    return np.log(weights / weights.sum())


def smoothed_logs(expected: np.ndarray) -> np.ndarray:
    """Log probabilities from expected counts; a piece that was not used keeps a little."""
    raised = expected + 1e-3
    return np.log(raised / raised.sum())


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c) over (key, text) rows, counted within tasks first; the empty word is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"])
            counts.clear()
            return out

        for batch in batches:
            for _, texts in runs(batch):
                for text in texts:
                    counts.update(words_of(text))
                counts[END] += len(texts)
                if len(counts) > 2 * _TABLE_WORDS:
                    yield emit()
        yield emit()

    return rows.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[list[str], np.ndarray]:
    known = vocabulary(path)
    return [p for p, _ in known], start_logs(s for _, s in known)


@lru_cache(maxsize=2)
def _start(path: str) -> Lattice:
    return Lattice(*_pieces(path))


def lattice_of(path: str, logs: np.ndarray) -> Lattice:
    """The lattice with these log probabilities; its trie is made once in a worker."""
    return _start(path).with_logs(logs)


@dataclass(frozen=True)
class Terms:
    """What a token adds to the base score and to the score, from its count and its lattice log probability."""

    total: int
    distinct: int
    discount: float

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + self.distinct + 1))

    def score(self, c: np.ndarray, log: np.ndarray) -> np.ndarray:
        if not self.total:
            return log / math.log(10)
        # In logarithms, as the lattice's probability of a very long word is below the least number.
        seen = np.log(np.maximum(c - self.discount, 0.0), out=np.full(len(c), -math.inf), where=c > self.discount)
        spread = self.discount * self.distinct
        other = math.log(spread) + log if spread else np.full(len(c), -math.inf)
        return (np.logaddexp(seen, other) - math.log(self.total)) / math.log(10)


def spread(counts: DataFrame, distinct: int) -> DataFrame:
    """The counted words dealt to as many tasks as their number asks for; by their bytes, AQE would join many words in one."""
    return counts.repartition(max(1, -(-distinct // TASK_WORDS)), "word")


def train_lattice(counts: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces after some rounds over all counted words. The driver sees one number per piece."""
    context = counts.sparkSession.sparkContext
    pieces, logs = _pieces(path)
    for _ in range(rounds):
        shared = context.broadcast(logs)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, found = lattice_of(path, shared.value), np.zeros(len(pieces))
            for batch in batches:
                end = pc.equal(batch.column(0), pa.scalar(END, pa.binary()))
                found[own.end] += pc.sum(batch.column(1).filter(end)).as_py() or 0
                batch = batch.filter(pc.invert(end))
                own.expect_words(batch.column(0).to_pylist(), batch.column(1).to_numpy(), found)
            used = np.flatnonzero(found)
            yield pa.record_batch([pa.array(used, pa.int32()), pa.array(found[used])], names=["piece", "uses"])

        rows = counts.select("word", "c").mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        expected = np.zeros(len(pieces))
        for row in rows.collect():  # at most one row per piece
            expected[row["piece"]] = row["uses"]
        if expected.sum() > 0:
            logs = smoothed_logs(expected)
    return logs


def _head(counts: DataFrame) -> list:
    """The most frequent words, at most ``HEAD``: all above a count that a small histogram of counts gives.

    A sorted limit would send ``HEAD`` rows from every task to the driver.
    """
    level = F.floor(F.log2("c") * 16)
    bars = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()  # at most 16 * 64 rows
    taken, lowest = 0, None
    for bar in sorted(bars, key=lambda b: -b["level"]):
        taken += bar["n"]
        if taken > HEAD:
            break
        lowest = bar["level"]
    return [] if lowest is None else counts.where(level >= lowest).collect()


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """For every row: ``key``, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark, path = docs.sparkSession, model or default_model()
    context = spark.sparkContext
    modulus, rest = HELD_OUT
    fold = (crc32_of_id(F.col(key)) % modulus) == rest
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), fold.alias("held_out"))
    counts = store(count_words(rows.where(~F.col("held_out")).select("key", "text")), "words")
    sums = counts.agg(
        F.sum("c").alias("total"), F.count("*").alias("distinct"), F.count_if(F.col("c") == 1).alias("once"),
        F.count_if(F.col("c") == 2).alias("twice"), F.max(F.when(F.col("word") == END, F.col("c"))).alias("ends"),
    ).first()
    once, twice = sums["once"], sums["twice"]
    terms = Terms(sums["total"] or 0, sums["distinct"], once / (once + 2 * twice) if once else 0.5)
    logs = train_lattice(spread(counts, sums["distinct"]), path)
    own = lattice_of(path, logs)
    top = _head(counts.where(F.length("word") > 0))
    words, times = [bytes(r["word"]) for r in top], np.array([r["c"] for r in top], np.int64)
    known = dict(zip(words, zip(terms.base(times).tolist(), terms.score(times, own.words(words)).tolist(), strict=True), strict=True))
    head, shared = context.broadcast(known), context.broadcast(logs)
    ends = sums["ends"] or 0
    end_base, end_score = (float(v[0]) for v in (terms.base(np.array([ends])), terms.score(np.array([ends]), logs[[own.end]])))
    kind = docs.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = head.value
        for batch in batches:
            keys, texts, held = (c.to_pylist() for c in batch.columns)
            for low in range(0, len(keys), 200):
                out: list[tuple] = []
                for k, t, h in zip(keys[low : low + 200], texts[low : low + 200], held[low : low + 200], strict=True):
                    words = words_of(t or "")
                    base, score, seen, rare, times = end_base, end_score, int(ends > 0), [], []
                    for word, n in Counter(words).items():
                        found = first.get(word)
                        if found is None:
                            rare.append(word)
                            times.append(n)
                        else:
                            base += n * found[0]
                            score += n * found[1]
                            seen += n
                    out.append((k, h, len(words) + 1, seen, base, score, rare, times))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields
                )

    schema = (
        f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, "
        "rare array<binary>, times array<bigint>"
    )
    fields = spark.createDataFrame([], schema).toArrow().schema
    parts = store(rows.mapInArrow(split, schema).withColumn("row", F.monotonically_increasing_id()), "parts")
    tail = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    met = tail.join(counts, "word", "left").select("word", "c", "row", "times")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path, shared.value)
        for batch in batches:
            words = batch.column(0).dictionary_encode()
            log = lattice.words(words.dictionary.to_pylist())[words.indices.to_numpy()]
            c, n = pc.fill_null(batch.column(1), 0).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            yield pa.record_batch(
                [batch.column(2), pa.array(np.where(c > 0, n, 0)), pa.array(n * terms.base(c)), pa.array(n * terms.score(c, log))],
                names=["row", "known", "base", "more"],
            )

    added = met.mapInArrow(add, "row bigint, known bigint, base double, more double").groupBy("row").agg(
        *[F.sum(c).alias(c) for c in ("known", "base", "more")]
    )
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return parts.drop("rare", "times").join(added, "row", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens", plus("n_known", "known"), F.lit(terms.total).cast("long").alias("train_tokens"),
        plus("base_score", "base"), plus("score", "more"),
    )
