"""Token counts of a unigram tokenizer without building the tokens.

A text is cut where white space becomes a word mark, as the tokenizer itself cuts it. Within a cut
an Aho-Corasick automaton lists every vocabulary piece that ends at each character, and a forward
pass keeps the best score and the number of pieces that reach it. Ties go to the piece that starts
first, unknown characters cost ten below the smallest score and count as their UTF-8 bytes: the
rules of the tokenizer. Scores of the vocabulary are whole numbers, so sums are exact in any order.

Defined cases: a null or empty text has no tokens and score 0; repeated rows and null ids give a row
each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from assetlake.llm.columns import keeps, map_texts

MARK = "▁"
_UNKNOWN_PENALTY = 10.0
#: Words remembered by a worker, and the longest word that is remembered.
CACHE_WORDS, CACHE_CHARS = 200_000, 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of the best segmentation."""

    def __init__(self, pieces: Iterable[tuple[str, float]]) -> None:
        scores = {}
        for piece, score in pieces:
            scores[piece] = score
        self.matcher = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.matcher.add_word(piece, (len(piece), score))
        self.matcher.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(scores.values()) - _UNKNOWN_PENALTY
        self.fresh: dict[str, tuple[int, float]] = {}
        self.old: dict[str, tuple[int, float]] = {}

    def best(self, word: str) -> tuple[int, float]:
        """Number of tokens and score of the best path over ``word``."""
        n = len(word)
        ending: list[list[tuple[int, float]] | None] = [None] * (n + 1)
        for last, match in self.matcher.iter(word):
            if ending[last + 1] is None:
                ending[last + 1] = []
            ending[last + 1].append(match)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top, pieces = float("-inf"), 0
            for length, value in ending[end] or ():  # the longest, which starts first, comes first
                reached = score[end - length] + value
                if reached > top:
                    top, pieces = reached, count[end - length] + 1
            character = word[end - 1]
            if character not in self.single:
                reached = score[end - 1] + self.unknown
                if reached > top:
                    top, pieces = reached, count[end - 1] + len(character.encode("utf-8"))
            score[end], count[end] = top, pieces
        return count[n], score[n]

    def word(self, word: str) -> tuple[int, float]:
        found = self.fresh.get(word) or self.old.get(word)
        if found is None:
            found = self.best(MARK + word)
            if len(word) > CACHE_CHARS:
                return found
            if len(self.fresh) >= CACHE_WORDS:
                self.old, self.fresh = self.fresh, {}
            self.fresh[word] = found
        return found

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = text.replace(" ", MARK)
        words = marked.split(MARK)
        if not words[0]:  # a mark at the start stands for itself, else one is put before the text
            words = words[1:]
        tokens, score, known = 0, 0.0, self.fresh.get
        for w in words:
            count, value = known(w) or self.word(w)
            tokens += count
            score += value
        return tokens, score


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    keeps(__name__, counter.cache_clear)
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """``key``, ``n_tokens`` and ``score`` (of the best segmentation) for every row."""
    path = model or default_model()
    kind = docs.schema[key].dataType.simpleString()

    def run(keys: list, texts: list[str]) -> dict[str, list]:
        own = counter(path)
        found = [own.text(t) for t in texts]
        return {key: keys, "n_tokens": [n for n, _ in found], "score": [s for _, s in found]}

    return map_texts(docs, run, f"`{key}` {kind}, n_tokens bigint, score double", key, text)
