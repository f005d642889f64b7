"""Toxicity scores from a weighted lexicon.

The lexicon is learnt from labelled documents: words, and word beginnings (stems with varying
endings), that toxic documents hold far more often than others, each with its log odds as weight.
Texts are lower-cased and look-alike letters and digits that stand for letters are folded. An
Aho-Corasick automaton finds the entries at word starts. Pairs of neighbouring words in which an entry
is harmless are exceptions: entries inside them do not count. The weights found, as a whole and
per word of the text, give the score by a logistic curve that is fitted to the same documents.

Bounds: ``SAMPLE`` labelled rows of either class are used for learning (those with the smallest hashes of the
id), ``ENTRIES`` entries and ``EXCEPTIONS`` exceptions are kept. Every text is scored whole. In the fit of the curve a
sampled row counts for all training labels of its class that it stands for, so that a score, and with it the fixed
threshold, means the same whether the bound cuts a class or not.

Defined cases: a null or empty text has the score of a text without any entry; labels that
disagree count as toxic; null labels and ids teach nothing; without labels of both classes the score is the share of
toxic labels, (toxic + 1) / (all + 2); repeated rows get a row each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.columns import crc32_of_id, map_texts, runs, small_enough, store, tidy

SAMPLE = 10_000
ENTRIES, EXCEPTIONS = 2_000, 2_000
#: Toxic documents that an entry must occur in, and the least weight (log odds).
MIN_SUPPORT, MIN_WEIGHT = 8, 3.0
STEM_CHARS = range(4, 9)
THRESHOLD = 0.7
BROADCAST_ROWS = 1_000_000
HELD_OUT = (3, 1)

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
_LOOKALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k",
    "м": "m", "т": "t", "в": "b", "н": "h", "ɡ": "g", "ı": "i", "ο": "o", "α": "a", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case with look-alikes folded; every character keeps its place."""
    low = text.lower()
    for odd, plain in _LOOKALIKE.items():
        if odd in low:
            low = low.replace(odd, plain)
    return low


@dataclass
class Lexicon:
    """Entries (a trailing ``*`` marks a stem) with weights, exceptions, and the curve of the score."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    _matcher: ahocorasick.Automaton | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_matcher": None}

    def matcher(self) -> ahocorasick.Automaton:
        if self._matcher is None:
            self._matcher = ahocorasick.Automaton()
            for entry in self.weights:
                self._matcher.add_word(entry.rstrip("*"), entry)
            if self.weights:
                self._matcher.make_automaton()
        return self._matcher

    def found(self, low: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, entry) of entries at word starts in a folded text; the longest entry of a word counts."""
        if not self.weights or not low:
            return
        best: dict[int, tuple[int, str]] = {}
        for last, entry in self.matcher().iter(low):
            stem = entry.endswith("*")
            start, end = last + 1 - len(entry) + stem, last + 1
            if start and low[start - 1].isalpha() or not stem and end < len(low) and low[end].isalpha():
                continue
            best[start] = (end, entry)  # of the entries that start here, the longest ends last
        for start, (end, entry) in best.items():
            while end < len(low) and low[end].isalpha():
                end += 1
            yield start, end, entry

    def phrases(self, low: str) -> Iterator[tuple[str, str, list[str]]]:
        """Each entry in the text with the word it is in and its pairs with the words beside it."""
        for start, end, entry in self.found(low):
            word = low[start:end]
            before = _WORD.findall(low[max(0, start - 40) : start])[-1:]
            after = _WORD.findall(low[end : end + 40])[:1]
            yield entry, word, [f"{w} {word}" for w in before] + [f"{word} {w}" for w in after]

    def features(self, text: str) -> tuple[float, float]:
        """Sum of weights found, as logarithm, and the sum for each hundred words."""
        low = fold(text)
        total = 0.0
        if self.exceptions:
            for entry, _, pairs in self.phrases(low):
                if not self.exceptions.intersection(pairs):
                    total += self.weights[entry]
        else:
            total = sum(self.weights[entry] for _, _, entry in self.found(low))
        words = low.count(" ") + low.count("\n") + 1 if total else 1
        return math.log1p(total), math.log1p(100 * total / (words + 20))

    def score(self, text: str) -> float:
        a, b, c = self.curve
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * x + c * y))))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of all labelled ids outside the held-out fold."""
    modulus, rest = HELD_OUT
    known = labels.where(F.col("toxic").isin(0, 1) & (crc32_of_id(F.col("doc_id")) % modulus != rest))
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def class_weights(labels: DataFrame, sample: int = SAMPLE) -> tuple[float, float]:
    """For clean and toxic: how many training labels one sampled label stands for; 1 for a class within the bound."""
    counts = {r["toxic"]: r["count"] for r in training_labels(labels).groupBy("toxic").count().collect()}
    return tuple(max(1.0, counts.get(y, 0) / sample) for y in (0, 1))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled rows of either class outside the held-out fold."""
    known = training_labels(labels)
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("toxic = 1").orderBy(*by_hash).limit(sample).unionAll(
        known.where("toxic = 0").orderBy(*by_hash).limit(sample)
    )
    texts = docs.select("doc_id", "text").where("text is not null")
    return texts.join(F.broadcast(picked), "doc_id").select("toxic", "text")  # at most 2 * sample ids


def _candidates(rows: DataFrame) -> DataFrame:
    """Words and stems with the number of toxic and other documents that hold them, counted within tasks first."""
    most = 400_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def emit() -> pa.RecordBatch:
            names = list(held[0].keys() | held[1].keys())
            out = pa.record_batch(
                [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in held)],
                names=["entry", "clean", "toxic"],
            )
            held[0].clear()
            held[1].clear()
            return out

        for batch in batches:
            for toxic, texts in runs(batch):
                for y, text in zip(toxic, texts, strict=True):
                    words = set(_WORD.findall(fold(text)))
                    stems = {f"{w[:n]}*" for w in words for n in STEM_CHARS if len(w) > n}
                    held[y].update(w for w in words if 3 <= len(w) <= 40)
                    held[y].update(stems)
                    if len(held[0]) + len(held[1]) > most:
                        yield emit()
        yield emit()

    counted = rows.mapInArrow(tidy(count), "entry string, clean bigint, toxic bigint")
    return counted.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _choose(rows: list[tuple[str, int, int]], clean: int, toxic: int) -> dict[str, float]:
    """The most telling entries; one under a stem that tells as much is left to the stem."""
    weights = {e: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) for e, c, t in rows}
    support = {e: t for e, _, t in rows}
    kept: dict[str, float] = {}
    for entry in sorted(weights, key=lambda e: (len(e.rstrip("*")), e)):
        stem = entry.rstrip("*")
        above = [f"{stem[:n]}*" for n in STEM_CHARS if n <= len(stem)]
        if any(a in kept and a != entry and kept[a] > 0.6 * weights[entry] for a in above):
            continue
        if f"{stem}*" in weights and entry == stem and weights[f"{stem}*"] >= weights[entry] and support[f"{stem}*"] > support[entry]:
            continue
        kept[entry] = weights[entry]
    return dict(sorted(kept.items(), key=lambda x: (-support[x[0]], x[0]))[:ENTRIES])


def _curve(x: np.ndarray, y: np.ndarray, weights: tuple[float, float] = (1.0, 1.0)) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton steps; ``weights`` of the rows of class 0 and 1."""
    design = np.column_stack([np.ones(len(y)), x])
    beta, ridge = np.zeros(design.shape[1]), np.diag([1e-6, 1e-2, 1e-2])
    w = np.where(y > 0, weights[1], weights[0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (w * (p - y)) + ridge @ beta
        step = np.linalg.solve(design.T @ (design * (w * (p * (1 - p) + 1e-9))[:, None]) + ridge, slope)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from the labelled documents outside the held-out fold. The driver sees the bounded sample's counts."""
    rows = training_rows(docs, labels, sample)
    classes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    clean, toxic = classes.get(0, 0), classes.get(1, 0)
    weights = class_weights(labels, sample)
    if not clean or not toxic:
        return Lexicon({}, curve=(math.log((toxic * weights[1] + 1) / (clean * weights[0] + 1)), 0.0, 0.0))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    telling = _candidates(rows).where((F.col("toxic") >= MIN_SUPPORT) & (odds >= MIN_WEIGHT))
    top = telling.orderBy(F.col("toxic").desc(), "entry").limit(10 * ENTRIES)
    lexicon = Lexicon(_choose([(r["entry"], r["clean"], r["toxic"]) for r in top.collect()], clean, toxic))
    lexicon.exceptions = _exceptions(rows, lexicon)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ys, texts in runs(batch):
                found = [lexicon.features(t) for t in texts]
                yield pa.record_batch(
                    [pa.array(ys, pa.int32()), *(pa.array([f[i] for f in found], pa.float64()) for i in (0, 1))],
                    names=["toxic", "x", "y"],
                )

    seen = rows.mapInArrow(tidy(features), "toxic int, x double, y double").toArrow()  # at most 2 * sample rows of numbers
    x = np.column_stack([seen.column(c).to_numpy() for c in ("x", "y")])
    lexicon.curve = _curve(x, seen.column("toxic").to_numpy().astype(float), weights)
    return lexicon


def _exceptions(rows: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Pairs of words with an entry in them that only harmless documents hold, three of them or more."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ys, texts in runs(batch):
                out = [(p, y) for y, t in zip(ys, texts, strict=True) for p in {p for _, _, ps in lexicon.phrases(fold(t)) for p in ps}]
                yield pa.record_batch(
                    [pa.array([p for p, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32())],
                    names=["pair", "toxic"],
                )

    seen = rows.mapInArrow(tidy(pairs), "pair string, toxic int").groupBy("pair").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("toxic")
    )
    harmless = seen.where("n >= 3 and toxic = 0").orderBy(F.col("n").desc(), "pair").limit(EXCEPTIONS)
    return frozenset(r["pair"] for r in harmless.collect())


def score_documents(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, score and predicted for every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(keys: list, texts: list[str]) -> dict[str, list]:
        return {key: keys, "score": [lexicon.score(t) for t in texts]}

    scored = map_texts(docs, run, f"`{key}` {kind}, score double", key, text)
    modulus, rest = HELD_OUT
    return scored.select(
        key, (crc32_of_id(F.col(key)) % modulus == rest).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def harmless_documents(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold; null texts score as empty ones.

    Only ids and hashes of rejected texts come back from the tasks, so the rows themselves stay where they are.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("_toxic_hash"), "text")

    def reject(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                bad = [lexicon.score(t or "") >= threshold for t in part.column(2).to_pylist()]
                if any(bad):
                    yield part.select([0, 1]).filter(pa.array(bad))

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = rows.mapInArrow(tidy(reject), f"doc_id {kind}, _toxic_hash bigint").distinct().withColumnRenamed("doc_id", "_toxic_id")
    marked = store(marked, "toxic")
    same = docs["doc_id"].eqNullSafe(F.col("_toxic_id")) & (F.xxhash64(docs["text"]) == F.col("_toxic_hash"))
    return docs.join(small_enough(marked, BROADCAST_ROWS), same, "left_anti")
