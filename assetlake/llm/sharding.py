"""Shards by a hierarchical weighted hash tree.

The tree has regions, racks and shards; a node's weight is the sum of the shards below it. A key descends: at each level
every child draws -ln(u) / weight, with u a hash of the key and the child's name, and the smallest draw wins, so a
child gets keys in proportion to its weight. A draw depends on nothing but key, child and weight. If a weight changes,
only the draws of the nodes above that shard change, so keys move into or out of these subtrees and nowhere else.

``topology`` lays out the first shards as full regions. Each further one hangs from the root as a region of its own: no
other subtree's weight changes, hence it takes keys only into itself. The law is therefore the key's: the
shard follows from key and number of shards alone, neither bytes nor counts are levelled.

All of it is column code: the tree is literals, a descent costs one hash for each child on the path and no shuffle.
Numbers inside a shard come from rows dealt by ranges of (shard, key), so a shard may hold any share of all rows.

Defined cases: a null key draws like the text ``-``, so such rows share a shard; rows that share a key share a shard, and
their numbers there follow size and checksum; a null text has no bytes, a size of ``OVERHEAD`` and the checksum 0; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.operators.ordered import number_rows

OVERHEAD = 16
SHARDS = 40
RACKS_IN_REGION = 2
SHARDS_IN_RACK = 4


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree with the names of the nodes above it."""

    number: int
    rack: int
    region: int
    weight: float = 1.0


def topology(count: int, planned: int = SHARDS) -> list[Shard]:
    """``count`` shards: those planned at first in full racks and regions, each later one in a region of its own."""
    if count < planned:
        raise ValueError(f"{count} shards are fewer than the {planned} that are laid out")
    shards = [Shard(i, i // SHARDS_IN_RACK, i // (SHARDS_IN_RACK * RACKS_IN_REGION)) for i in range(planned)]
    for i in range(planned, count):
        shards.append(Shard(i, shards[-1].rack + 1, shards[-1].region + 1))
    return shards


def _draw(key: Column, level: str, child: Column, weight: Column) -> Column:
    """An exponential draw with the weight as its rate; the smallest of several wins in proportion to the weights."""
    digits = F.substring(F.md5(F.concat_ws("/", key, F.lit(level), child.cast("string")).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("bigint") + 1) / F.lit(float(1 << 52))  # 52 bits, above 0
    return -F.ln(u) / weight


def _winner(key: Column, level: str, children: Column) -> Column:
    """Name of the child of ``children`` (structs of name and weight) with the smallest draw, ties to the smaller name."""
    draws = F.transform(children, lambda c: F.struct(_draw(key, level, c["name"], c["weight"]).alias("draw"), c["name"].alias("name")))
    return F.array_min(draws)["name"]


def _literal(children: dict[int, float]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in sorted(children.items())])


def _level(shards: Sequence[Shard], parent: str, child: str) -> dict[int, dict[int, float]]:
    """Weights of the children of each parent."""
    out: dict[int, dict[int, float]] = {}
    for s in shards:
        below = out.setdefault(getattr(s, parent) if parent else 0, {})
        below[getattr(s, child)] = below.get(getattr(s, child), 0.0) + s.weight
    return out


def _lookup(levels: dict[int, dict[int, float]], parent: Column) -> Column:
    entries = [x for name, children in levels.items() for x in (F.lit(name), _literal(children))]
    return F.element_at(F.create_map(*entries), parent)


def place(key: Column, shards: Sequence[Shard]) -> Column:
    """Number of the shard that ``key`` belongs to."""
    key = F.coalesce(key.cast("string"), F.lit("-"))
    region = _winner(key, "region", _literal(_level(shards, "", "region")[0]))
    rack = _winner(key, "rack", _lookup(_level(shards, "region", "rack"), region))
    return _winner(key, "shard", _lookup(_level(shards, "rack", "number"), rack))


def shard_documents(docs: DataFrame, shards: Sequence[Shard], grown: Sequence[Shard], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, size, checksum of the text, shard, ``slot`` in it (from 0) and the shard in the ``grown`` tree."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key), (F.octet_length(body) + OVERHEAD).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), place(F.col(key), shards).alias("shard"), place(F.col(key), grown).alias("grown_shard"),
    )
    slots = number_rows(rows, ["shard"], [key, "size", "text_crc32"], "slot")
    return slots.select(key, "size", "text_crc32", "law", "shard", (F.col("slot") - 1).alias("slot"), "grown_shard")
