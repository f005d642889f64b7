"""Periodic runs of words, found by seeds on diagonals.

A run is a stretch of words with smallest period q and at least max(SHORTEST, 2 * q) words that no neighbouring word
extends. Its words equal those q places on over max(q, SHORTEST - q) places or more; that is the overlap which a lag
guarantees. Lags are taken in octaves: 1 to 2k - 1 for k = SHORTEST / 2, then k to 2k - 1 for each doubled k. All lags of
an octave guarantee an overlap of k words, so each of their runs holds a k-gram twice, one lag apart. For each octave

- the k-grams of the text are named (exactly, from pairs of the names of half the length), and only those that
  occur again are kept;
- occurrence pairs of one name with a lag of the octave are enumerated. A k-gram of period k / 2 or less lies in a run
  that an earlier octave has found; of these only the pairs with the start of such a run are taken, and none inside one
  run. (A diagonal that holds only such k-grams begins where one of its two runs begins.) All others occur at most
  once in k / 2 words. Pairs are therefore about as many as words, also in a text of one repeated word;
- a pair is extended to both sides unless the furthest place covered at its lag lies beyond it.

A stretch found at several lags has the smallest of them as its period. Words are compared as a whole and in memory of
one text; nothing is hashed, cut or sampled.

Defined cases: a null or empty text and one of fewer than SHORTEST words has no runs; rows keep their number, repeated
rows and ids give a row each, a null id stays null; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.llm.columns import map_texts

SHORTEST = 12
_SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: str) -> list[bytes]:
    """Runs of other bytes than 0x09-0x0D and 0x20; ``bytes.split`` takes just these as space."""
    return text.encode("utf-8", "surrogatepass").split()


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One name for each pair of names."""
    return np.unique(left * (right.max(initial=0) + 1) + right, return_inverse=True)[1]


class _Grams:
    """Names of the k-grams that occur more than once, by place."""

    def __init__(self, ids: np.ndarray) -> None:
        pairs = _joined(ids[:-1], ids[1:])
        threes = _joined(pairs[:-1], ids[2:])
        self.k, self.size = SHORTEST // 2, len(ids)
        self._keep(np.arange(self.size - self.k + 1), _joined(threes[: -(self.k - 3)], threes[3:]))

    def _keep(self, places: np.ndarray, names: np.ndarray) -> None:
        again = np.bincount(names, minlength=1)[names] > 1
        self.places, self.names = places[again], names[again]

    def double(self) -> None:
        name = np.full(self.size + 1, -1, dtype=np.int64)
        name[self.places] = self.names
        both = self.places[self.places + self.k <= self.size]
        both = both[name[both + self.k] >= 0]
        self.k *= 2
        self._keep(both, _joined(name[both], name[both + self.k // 2]) if len(both) else both)


def _free_pairs(places: np.ndarray, names: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of all pairs of one name with low <= lag < high."""
    order = np.lexsort((places, names))
    places, names = places[order], names[order]
    starts, lags, step = [], [], 1
    while step < len(places):
        lag = places[step:] - places[:-step]
        near = (names[step:] == names[:-step]) & (lag < high)
        if not near.any():
            break
        near &= lag >= low
        starts.append(places[:-step][near])
        lags.append(lag[near])
        step += 1
    return np.concatenate([*starts, np.empty(0, np.int64)]), np.concatenate([*lags, np.empty(0, np.int64)])


def _run_pairs(grams: _Grams, inside: np.ndarray, runs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of the pairs of a k-gram at the start of a run with its occurrences outside that run."""
    k, width = grams.k, grams.size + 1
    where, called = grams.places[inside], grams.names[inside]
    keys = np.sort(called * width + where)
    name = dict(zip(where.tolist(), called.tolist(), strict=True))
    starts, lags = [], []
    for start, length in runs:
        if start not in name:
            continue
        base = name[start] * width
        for low, high in ((start - 2 * k + 1, start - k), (max(start + k, start + length - k + 1), start + 2 * k - 1)):
            a, b = np.searchsorted(keys, base + max(low, 0)), np.searchsorted(keys, base + min(high, width - 1), "right")
            found = keys[a:b] - base if high >= low else keys[:0]
            starts.append(np.minimum(found, start))
            lags.append(np.abs(found - start))
    return np.concatenate([*starts, np.empty(0, np.int64)]), np.concatenate([*lags, np.empty(0, np.int64)])


def _equal_length(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal."""
    n, done, step = min(len(a), len(b)), 0, 64
    while done < n:
        end = min(n, done + step)
        differ = a[done:end] != b[done:end]
        if differ.any():
            return done + int(differ.argmax())
        done, step = end, step * 2
    return n


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence of small numbers, by start and then period."""
    n = len(ids)
    if n < SHORTEST:
        return []
    ids = ids.astype(np.int64)
    grams, period = _Grams(ids), {}
    low, high = 1, SHORTEST
    while len(grams.places) and grams.k <= n // 2:
        k = grams.k
        periodic = [(s, length) for (s, length), q in period.items() if 2 * q <= k and length >= k]
        held = np.zeros(n + 1, dtype=np.int64)
        for start, length in periodic:
            held[start] += 1
            held[start + length - k + 1] -= 1
        inside = np.cumsum(held)[grams.places] > 0
        starts, lags = _free_pairs(grams.places[~inside], grams.names[~inside], low, high)
        if periodic:
            more = _run_pairs(grams, inside, periodic)
            starts, lags = np.concatenate((starts, more[0])), np.concatenate((lags, more[1]))
        order = np.lexsort((starts, lags))
        starts, lags = starts[order], lags[order]
        # The next place at the same lag is covered by the extension of the place before it.
        fresh = np.ones(len(starts), dtype=bool)
        fresh[1:] = (lags[1:] != lags[:-1]) | (starts[1:] > starts[:-1] + 1)
        covered: dict[int, int] = {}
        for i, lag in zip(starts[fresh].tolist(), lags[fresh].tolist(), strict=True):
            if i < covered.get(lag, 0):
                continue
            first = i - _equal_length(ids[:i][::-1], ids[lag : i + lag][::-1])
            last = i + k + _equal_length(ids[i + k :], ids[i + k + lag :])
            covered[lag] = last
            if last - first >= max(lag, SHORTEST - lag):
                period.setdefault((first, last - first + lag), lag)
        grams.double()
        low, high = grams.k, 2 * grams.k
    return sorted((start, length, q) for (start, length), q in period.items())


def runs_of_words(words: list[bytes]) -> list[tuple[int, int, int]]:
    known: dict[bytes, int] = {}
    return find_runs(np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words)))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that lie in a run behind its first period."""
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return words if kept.all() else [w for w, keep in zip(words, kept.tolist(), strict=True) if keep]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``runs`` (start, length and period in words) and ``collapsed``, the text without repeated periods."""
    kind = docs.schema[key].dataType.simpleString()

    def work(keys: list, texts: list[str]) -> dict[str, list]:
        found, rest = [], []
        for words in map(words_of, texts):
            runs = runs_of_words(words)
            found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            rest.append(b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass"))
        return {key: keys, "runs": found, "collapsed": rest}

    schema = f"`{key}` {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return map_texts(docs, work, schema, key, text)


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period), and digests of runs and collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    start, length, period = -longest["s"], longest["l"], -longest["p"]
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    exponent = F.expr("1000L") * length
    return found.select(
        key, F.size("runs").cast("bigint").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(exponent / period).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def repeated_tails(docs: DataFrame, crc: Column, text: str = "text") -> DataFrame:
    """``docs`` in which the text of every row with ``crc`` % 10 = 0 ends in a stretch of one period.

    With g = crc div 10 and n words, word i from a = g % n on becomes word a + (i - a) % p, where p is
    1 + (n - a) div (3 + g % 8). Other rows, and those with a null ``crc``, stay as they are.
    """
    chosen = F.coalesce(crc % 10 == 0, F.lit(False))
    words = F.when(chosen, F.array_remove(F.split(text, _SPACE), ""))
    # A generated column is computed once a row; an alias would be put into the lambda and split for every word.
    rows = docs.withColumn("_g", F.floor(crc / 10)).select("*", F.explode(F.array(words)).alias("_w"))
    rows = rows.withColumn("_n", F.size("_w").cast("bigint")).withColumn("_a", F.expr("_g % _n"))
    rows = rows.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    place = F.expr("transform(_w, (w, i) -> if(i < _a, w, _w[int(_a + (i - _a) % _p)]))")
    changed = F.when(F.col("_n") > 0, F.array_join(place, " ")).otherwise(F.col(text))
    return rows.withColumn(text, changed).drop("_g", "_w", "_n", "_a", "_p")
