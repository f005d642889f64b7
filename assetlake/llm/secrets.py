"""Secrets in texts: three base patterns, and values that are hard to guess after a credential word.

Base patterns (their spans always stay):

* assign - a credential word, ``:`` or ``=`` and a value of six characters or more;
* access - ``AKIA`` and capitals or digits, twenty characters or more;
* hex - twenty-four or more lower-case hexadecimal digits.

The method adds spans of kind ``guess``. After a wider list of credential words a value is cut into
dictionary words, dates, repeats, keyboard walks and brute-force characters so that the number of
guesses, the product over the parts, is least (a forward dynamic program in log10). A dictionary word takes as many guesses
as its rank: first the words that passwords are made of, then the whole words of a public tokenizer's vocabulary in the
order of its merges, which is that of how common they are. Values that take
10**MIN_GUESSES guesses or more are secrets, so eight characters (the fewest that are looked at) are enough when no part
of them is cheaper than brute force. After a plain blank, neither assigned nor in quotes, a value is a word of the text and not
judged when it is letters alone, or up to three words (in small letters, capitals, or capitalised) with signs of
prose between or before them, like ``end-to-end``; with any digit or other sign it is judged by its cost. A value that an assign span holds the beginning of is secret
as a whole, up to a blank, quote, comma, semicolon or angle bracket: a guess span covers all of it. Only values wholly
inside a base span add nothing.

Defined cases: a null or empty text has no spans; repeated rows and null ids give a row each.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from assetlake.llm.columns import keeps, map_texts, store, tidy

KINDS = ("assign", "access", "hex", "guess")
_WORD_END = "</w>"
#: log10 of the guesses from which a value is a secret.
MIN_GUESSES = 8.0

_ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_CONTEXT_WORDS = (
    b"passwo", b"passwd", b"passphrase", b"passcode", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"api-key",
    b"access_key", b"private_key", b"credential", b"bearer", b"authorization",
)
_CONTEXT = re.compile(
    rb"(?<![A-Za-z])(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access_key|private_key"
    rb"|credentials?|bearer|authorization)(?:[\"']?\x20*([:=])\x20*|\x20(?:is\x20)?)([\"']?)([^\s\"'<>,;]{8,})",
    re.IGNORECASE,
)
_REST = re.compile(rb"[^\s\"'<>,;]*")
#: Signs after a value that belong to the text around it, unless the value ends at its closing quote.
_AFTER = b".:!?)]}*#$%&|"

# Words that guessing tries first, in the order in which it tries them.
_WORDS = (
    "password", "qwerty", "admin", "welcome", "letmein", "login", "monkey", "dragon", "master", "secret", "hello",
    "shadow", "sunshine", "princess", "football", "baseball", "superman", "batman", "trustno", "iloveyou", "access",
    "root", "user", "test", "guest", "pass", "default", "changeme", "example", "sample", "demo", "token", "key",
    "love", "summer", "winter", "spring", "autumn", "monday", "friday", "january", "march", "april", "august",
    "blue", "green", "black", "white", "house", "computer", "server", "database", "public", "private", "value",
)
_KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_LEET = str.maketrans("0134578@$", "oieastbas")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)?\d\d")
_REPEAT = re.compile(r"(.{1,16}?)\1+", re.DOTALL)
_PROSE_SIGNS = re.compile(r"[-/()\[\]{}.:*–—‘’“”…]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _dictionary(vocabulary: str) -> ahocorasick.Automaton:
    """Words with their cost: those tried first, then the vocabulary's whole words of three letters or more by rank."""
    keeps(__name__, _dictionary.cache_clear)
    with open(vocabulary, encoding="utf-8") as file:
        ids = json.load(file)["model"]["vocab"]
    whole = sorted((n, t[: -len(_WORD_END)]) for t, n in ids.items() if t.endswith(_WORD_END))
    ranked = dict.fromkeys([*_WORDS, *[w for _, w in whole if len(w) >= 3 and w.isascii() and w.isalpha()]])
    words = ahocorasick.Automaton()
    for rank, word in enumerate(ranked, 1):
        words.add_word(word, (len(word), math.log10(rank + 1)))
    words.make_automaton()
    return words


@lru_cache(maxsize=1)
def _neighbours() -> dict[str, str]:
    near: dict[str, str] = {}
    for y, row in enumerate(_KEYBOARD):
        for x, key in enumerate(row):
            around = [(y, x - 1), (y, x + 1), (y - 1, x), (y - 1, x + 1), (y + 1, x), (y + 1, x - 1)]
            near[key] = "".join(
                _KEYBOARD[j][i] for j, i in around if 0 <= j < len(_KEYBOARD) and 0 <= i < len(_KEYBOARD[j])
            )
    return near


def _parts(value: str, vocabulary: str) -> list[tuple[int, int, float]]:
    """(start, end, log10 of guesses) of everything in ``value`` that is cheaper than brute force."""
    small, parts = value.lower(), []
    plain = small.translate(_LEET)
    if len(plain) == len(value) == len(small):
        for end, (length, cost) in _dictionary(vocabulary).iter(plain):
            start = end + 1 - length
            written = value[start : end + 1]
            changed = sum(a != b for a, b in zip(small[start : end + 1], plain[start : end + 1], strict=True))
            capitals = 0 if written == small[start : end + 1] else 1 if written[1:] == small[start + 1 : end + 1] else 2
            parts.append((start, end + 1, cost + 0.3 * capitals + 0.3 * changed))
    for found in _DATE.finditer(value):
        parts.append((found.start(), found.end(), 2.6 if found.end() - found.start() == 4 else 4.6))
    for found in _REPEAT.finditer(value):
        block, times = found.group(1), (found.end() - found.start()) // len(found.group(1))
        if times * len(block) >= 3:
            parts.append((found.start(), found.end(), 1.0 * len(block) + math.log10(times)))
    near, start = _neighbours(), 0
    for i in range(1, len(small) + 1):
        if i == len(small) or small[i] not in near.get(small[i - 1], ""):
            if i - start >= 3:
                parts.append((start, i, 1.7 + 0.4 * (i - start)))
            start = i
    return parts


def guess_cost(value: str, vocabulary: str | None = None) -> float:
    """log10 of the guesses that the cheapest cut of ``value`` takes. Brute force takes 10 guesses a character."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, end, cost in _parts(value, vocabulary or default_vocabulary()):
        ending.setdefault(end, []).append((start, cost))
    best = [0.0] * (len(value) + 1)
    for end in range(1, len(value) + 1):
        best[end] = min([best[end - 1] + 1.0, *(best[start] + cost for start, cost in ending.get(end, ()))])
    return best[-1]


def _is_prose(text: str) -> bool:
    """Whether a value that only follows a blank is letters alone or a few written words."""
    words = [w for w in _PROSE_SIGNS.split(text) if w]
    written = lambda w: w.isalpha() and w in (w.lower(), w.upper(), w.capitalize())
    return text.isalpha() or len(words) <= 3 and all(map(written, words))


def _is_secret(mark: bytes, quote: bytes, value: bytes, vocabulary: str | None) -> bool:
    text = value.decode("utf-8", "replace")
    if not (mark or quote) and _is_prose(text):
        return False
    return guess_cost(text, vocabulary) >= MIN_GUESSES


def _rests(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Guess spans of values that go on where the value class of an assign span ends: all of the value is secret."""
    found, covered = [], 0
    for start, kind, end in spans:
        if kind or end <= covered:  # an assign span inside an earlier value
            continue
        rest = _REST.match(data, end)
        value = _ASSIGN.match(data, start).start(2)
        quote = data[value - 1 : value]
        tail = rest.group()
        if quote not in (b'"', b"'") or data[rest.end() : rest.end() + 1] != quote:
            tail = tail.rstrip(_AFTER)
        if tail:
            covered = end + len(tail)
            found.append((value, 3, covered))
    return found


def find_spans(text: str, vocabulary: str | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    if not text:
        return []
    data = text.encode("utf-8")
    lower = data.lower()
    spans: list[tuple[int, int, int]] = []
    if any(w in lower for w in _ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in data:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(data)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(data)]
    spans += _rests(data, spans)
    base = sorted(spans)
    if any(w in lower for w in _CONTEXT_WORDS):
        for m in _CONTEXT.finditer(data):
            start, value = m.start(3), m.group(3)
            if not m.group(2) or data[m.end() : m.end() + 1] != m.group(2):
                value = value.rstrip(_AFTER)
            end = start + len(value)
            if len(value) < 8 or any(s <= start and end <= e for s, _, e in base):
                continue
            if _is_secret(m.group(1) or b"", m.group(2), value, vocabulary):
                spans.append((start, 3, end))
    if not spans:
        return []
    spans.sort()
    if len(data) != len(text):  # from bytes to code points
        marks = sorted({p for s, _, e in spans for p in (s, e)})
        at, count, last = {}, 0, 0
        for p in marks:
            count += len(data[last:p].decode("utf-8"))
            at[p], last = count, p
        spans = [(at[s], k, at[e]) for s, k, e in spans]
    return [(KINDS[k], s, e) for s, k, e in spans]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans, for every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(keys: list, texts: list[str]) -> dict[str, list]:
        found = [find_spans(t, vocabulary) for t in texts]
        base = [[s for s in spans if s[0] != "guess"] for spans in found]
        counts = {f"n_{k}": [sum(s[0] == k for s in spans) for spans in base] for k in KINDS[:3]}
        digests = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]
        return {key: keys, **counts, "base_sha256": digests, "spans": [joined(spans) for spans in found]}

    schema = f"`{key}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return map_texts(docs, run, schema, key, text)


def redact(text: str, mark: str = "[SECRET]", vocabulary: str | None = None) -> str:
    """``text`` with every secret, overlapping ones together, replaced by ``mark``."""
    out, last, open_from = [], 0, -1
    for _, start, end in find_spans(text, vocabulary):
        if start >= last or open_from < 0:
            out += [text[last:start], mark]
            open_from = start
        last = max(last, end)
    return "".join([*out, text[last:]])


def redacted_documents(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs``, all columns, with secrets in ``text`` replaced; null stays null.

    Whole texts go to Python and back, so the rows are stored: that is done in small batches, whatever the caller's settings.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                column = part.column(at)
                clean = pa.array([None if t is None else redact(t, vocabulary=vocabulary) for t in column.to_pylist()], type=column.type)
                yield part.set_column(at, part.schema.field(at), clean)

    return store(docs.mapInArrow(tidy(run), docs.schema), "redacted")
