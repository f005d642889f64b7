"""Shell globs as regular expressions that Spark evaluates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ranges(body: str) -> str:
    """Members of a class with Java's special characters escaped; backward ranges dropped."""

    def literal(char: str) -> str:
        return f"\\{char}" if char in "\\[]^&-" else char

    out, i = "", 0
    while i < len(body):
        if body[i + 1 : i + 2] == "-" and i + 2 < len(body):
            low, high = body[i], body[i + 2]
            out += f"{literal(low)}-{literal(high)}" if low <= high else ""
            i += 3
        else:
            out += literal(body[i])
            i += 1
    return out


def _character_class(pattern: str, start: int) -> tuple[str, int] | None:
    """The class opened at ``start`` and the index behind it; None if it never closes."""
    first = start + 1
    negated = pattern[first : first + 1] == "!"
    body = first + negated
    end = pattern.find("]", body + 1)
    if end < 0:
        return None
    members = _ranges(pattern[body:end])
    if not members:  # only ranges that run backwards: matches no character
        return ("." if negated else "(?!)"), end + 1
    return f"[{'^' if negated else ''}{members}]", end + 1


def glob_to_regex(pattern: str) -> str:
    """Anchored Java regex: ``*`` any run (also over ``/``), ``?`` one character, ``[..]``, ``[!..]``."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        matched = _character_class(pattern, i) if char == "[" else None
        if matched:
            text, i = matched
            out.append(text)
            continue
        out.append({"*": ".*", "?": "."}.get(char) or re.escape(char))
        i += 1
    return f"(?s)^{''.join(out)}\\z"


def matches_glob(name: Column, pattern: str) -> Column:
    return name.rlike(glob_to_regex(pattern))


def matches_any_glob(name: Column, patterns: Sequence[str]) -> Column:
    """One regex for all patterns, so that the name is scanned once."""
    if not patterns:
        return F.lit(True)
    return name.rlike("|".join(f"(?:{glob_to_regex(p)})" for p in patterns))


def matching_globs(name: Column, patterns: Sequence[str]) -> Column:
    """Array with the index of every pattern that matches."""
    hits = [F.when(matches_glob(name, p), F.lit(i)) for i, p in enumerate(patterns)]
    return F.array_compact(F.array(*hits))


# A class: "[", perhaps "!", one character of any kind, and what follows up to "]".
_TOKEN = r"\[!?+[\s\S][^\]]*\]|[\s\S]"
_SPECIAL = r"([\\\[\](){}.*+?^$|&#~\-])"


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, _SPECIAL, r"\\$1")


def _class_regex(token: Column) -> Column:
    negated = F.substring(token, 2, 1) == "!"
    start = F.when(negated, 3).otherwise(2)
    body = F.substring(token, start, F.char_length(token) - start)
    parts = F.regexp_extract_all(body, F.lit(r"[\s\S]-[\s\S]|[\s\S]"), F.lit(0))

    def member(part: Column) -> Column:
        low, high = F.substring(part, 1, 1), F.substring(part, 3, 1)
        backward = F.when(low <= high, F.concat(_escaped(low), F.lit("-"), _escaped(high))).otherwise("")
        return F.when(F.char_length(part) == 3, backward).otherwise(_escaped(part))

    members = F.array_join(F.transform(parts, member), "")
    sign = F.when(negated, "^").otherwise("")
    return F.when(members == "", F.when(negated, ".").otherwise("(?!)")).otherwise(F.concat(F.lit("["), sign, members, F.lit("]")))


def glob_regex(pattern: Column) -> Column:
    """``glob_to_regex`` for patterns that are data."""
    def piece(token: Column) -> Column:
        simple = F.when(token == "*", ".*").when(token == "?", ".").otherwise(_escaped(token))
        return F.when(F.char_length(token) > 1, _class_regex(token)).otherwise(simple)

    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit(_TOKEN), F.lit(0)), piece), ""), F.lit(r"\z"))


#: Pieces of this many characters are looked up inside a name; shorter ones between wildcards tell too little.
_PIECE = (3, 8)


def glob_anchor(pattern: Column) -> Column:
    """Text that every match has: ``kind`` (prefix, suffix, piece or any), and that text as ``key``."""
    prefix = F.regexp_extract(pattern, r"^[^*?\[]*", 0)
    # Behind a "[" only what follows its last "]" is surely literal; without a "]" it may be a class or not.
    suffix = F.when(pattern.contains("["), F.regexp_extract(pattern, r"\]([^*?\[\]]*)$", 1)).otherwise(F.regexp_extract(pattern, r"[^*?]*$", 0))
    plain = F.regexp_extract_all(F.regexp_replace(pattern, r"\[[\s\S]*\]", "*"), F.lit(r"[^*?\[\]]+"), F.lit(0))
    longest = F.array_max(F.transform(plain, lambda p: F.struct(F.char_length(p).alias("n"), p.alias("p"))))["p"]
    piece = F.when(F.char_length(longest) >= _PIECE[0], F.substring(longest, 1, _PIECE[1]))
    kinds = F.when((prefix != "") & (F.char_length(prefix) >= F.char_length(suffix)), F.struct(F.lit("prefix").alias("kind"), prefix.alias("key")))
    kinds = kinds.when(suffix != "", F.struct(F.lit("suffix").alias("kind"), suffix.alias("key")))
    kinds = kinds.when(piece.isNotNull(), F.struct(F.lit("piece").alias("kind"), piece.alias("key")))
    return kinds.otherwise(F.struct(F.lit("any").alias("kind"), F.lit("").alias("key")))


def name_anchors(name: Column, lengths: Sequence[tuple[str, int]]) -> Column:
    """The texts of a name by which patterns of these (kind, length) can be found."""
    size = F.char_length(name)

    def texts(kind: str, n: int) -> Column:
        if kind == "any":
            return F.array(F.lit(""))
        if kind == "piece":
            places = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1)))
            return F.array_distinct(F.transform(places, lambda i: F.substring(name, i, F.lit(n))))
        return F.when(size >= n, F.array(F.substring(name, 1, n) if kind == "prefix" else F.right(name, F.lit(n))))

    def anchors(kind: str, n: int) -> Column:
        named = F.transform(texts(kind, n), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("key")))
        return F.coalesce(named, F.array().cast("array<struct<kind:string,key:string>>"))

    return F.flatten(F.array(*[anchors(kind, n) for kind, n in lengths]))
