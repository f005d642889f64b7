"""A Merkle manifest of a dataset: one digest for all rows, and for each row the siblings that prove it.

Each row is a leaf: the SHA-256 of its fields. Inside a group the leaves ascend by the key, and every ``WIDTH``
consecutive nodes (the last of them fewer) become their digest as long as more than one remains; that is the group's
subroot. The subroots, in the order of their groups, give the root in the same way.

The tree is worked on in superblocks of ``WIDTH ** LEVELS`` nodes, dealt by (group, superblock), so a group of any size
is spread over all tasks. Upwards, ``applyInPandas`` turns each superblock into one node, round by round; a round
has 1 / 512 of the rows of the one before. Downwards, the nodes of a superblock are cogrouped with the node outside it that
holds the siblings of all levels above: in one ``applyInPandas`` the superblock is reduced, each of its nodes gets
its siblings (inside, then outside), and for leaves the root is folded from the row as it is presented.
Texts are hashed where they are read; only keys and digests are shuffled. Each round is stored in the shared folder.

A proof is text: ``place:siblings`` for each level from the leaf upwards, joined by commas, where ``place`` is the node's
place among its run's nodes and ``siblings`` the digests of the others without separators.

Defined cases: null fields count as ``-``; rows with a null group are a group of their own, which comes first; rows
with a null key come first in their group; rows that share a key are ordered by their digest, repeated rows are a
leaf each; a group of one row has that leaf as subroot, as has a single group for the root; an empty table gives no rows;
columns beyond the fields are not looked at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from assetlake.llm.columns import store
from assetlake.operators.ordered import number_rows

WIDTH = 8
LEVELS = 3
_NODES = "grp string, pos bigint, digest string"
_PROOFS = "grp string, pos bigint, proof string, subroot string"


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values: ``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _digest(nodes: Sequence[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def _reduced(nodes: list[str], block: int, levels: int) -> list[list[str]]:
    """The levels of a superblock from its nodes to its only one.

    The first superblock stops at one node, as it may be the whole group; the others always have ``levels`` levels.
    """
    found = [nodes]
    while len(found[-1]) > 1 or (block and len(found) <= levels):
        below = found[-1]
        found.append([_digest(below[i : i + WIDTH]) for i in range(0, len(below), WIDTH)])
    return found


def _proofs(nodes: list[str], block: int, levels: int, outer: str) -> list[str]:
    """Each node's proof: the siblings inside the superblock and then those outside it."""
    segments = []
    for level in _reduced(nodes, block, levels)[:-1]:
        segments.append([])
        for i in range(0, len(level), WIDTH):
            run = level[i : i + WIDTH]
            segments[-1] += [f"{p}:{''.join(run[:p] + run[p + 1 :])}" for p in range(len(run))]
    end = [outer] if outer else []
    return [",".join([s[i // WIDTH**depth] for depth, s in enumerate(segments)] + end) for i in range(len(nodes))]


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and its proof lead to."""
    node = leaf
    for step in proof.split(",") if proof else []:
        place, others = step.split(":")
        at = 64 * int(place)
        node = sha256((others[:at] + node + others[at:]).encode()).hexdigest()
    return node


@dataclass(frozen=True)
class _Tree:
    """Work on superblocks of ``WIDTH ** levels`` nodes."""

    levels: int

    def block(self, nodes: DataFrame) -> GroupedData:
        return nodes.withColumn("block", F.expr(f"pos div {WIDTH**self.levels}")).groupBy("grp", "block")

    def up(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        grp, block = key
        top = _reduced(rows.sort_values("pos")["digest"].tolist(), block, self.levels)[-1][0]
        return pd.DataFrame({"grp": [grp], "pos": [block], "digest": [top]})

    def down(self, key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"grp": [], "pos": [], "proof": [], "subroot": []})
        rows, above = rows.sort_values("pos"), outer.iloc[0]
        proofs = _proofs(rows["digest"].tolist(), key[1], self.levels, above["proof"])
        return pd.DataFrame({"grp": rows["grp"], "pos": rows["pos"], "proof": proofs, "subroot": above["subroot"]})

    def finish(self, key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"id": [], "leaf": [], "subroot": [], "proof": [], "folded_root": []})
        rows, above = rows.sort_values("pos"), outer.iloc[0]
        proofs = _proofs(rows["digest"].tolist(), key[1], self.levels, above["proof"])
        folded = [fold(leaf, proof) for leaf, proof in zip(rows["presented"], proofs, strict=True)]
        return pd.DataFrame(
            {"id": rows["id"], "leaf": rows["digest"], "subroot": above["subroot"], "proof": proofs, "folded_root": folded}
        )

    def rounds(self, nodes: DataFrame) -> list[DataFrame]:
        """The nodes of each round, the last with one node a group. The driver gets one number: the size of the largest group."""
        most = nodes.agg(F.max("pos")).first()[0]
        rounds, count = [nodes], (most or 0) + 1
        while count > 1:
            up = self.block(rounds[-1].select("grp", "pos", "digest")).applyInPandas(lambda key, rows: self.up(key, rows), _NODES)
            rounds.append(store(up, "nodes"))
            count = -(-count // WIDTH**self.levels)
        return rounds

    def below(self, nodes: DataFrame, proofs: DataFrame) -> DataFrame:
        """(grp, pos, proof, subroot) of ``nodes`` from those of their superblocks."""
        sides = self.block(nodes.select("grp", "pos", "digest")).cogroup(_outer(proofs))
        return sides.applyInPandas(lambda key, rows, outer: self.down(key, rows, outer), _PROOFS)

    def descend(self, rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
        """The proofs of the nodes of the second round; ``tops`` are those of the last one."""
        proofs = tops
        for nodes in reversed(rounds[1:-1]):
            proofs = store(self.below(nodes, proofs), "proofs")
        return proofs

    def subroot_proofs(self, upper: list[DataFrame]) -> DataFrame:
        """The groups' subroots with their proofs, as the nodes above the last round of their leaves."""
        subroots = upper[0]
        proofs = upper[-1].select("grp", "pos", F.lit("").alias("proof"), F.col("digest").alias("subroot"))
        if len(upper) > 1:
            proofs = self.below(subroots, self.descend(upper, proofs))
        named = subroots.join(proofs.select("pos", "proof"), "pos")
        zero = F.lit(0).cast("bigint")
        return store(named.select(F.col("child").alias("grp"), zero.alias("pos"), "proof", F.col("digest").alias("subroot")), "tops")


def _outer(proofs: DataFrame) -> GroupedData:
    return proofs.withColumnRenamed("pos", "block").groupBy("grp", "block")


def manifest(
    docs: DataFrame, key: str, group: str, fields: Sequence[str], presented: Mapping[str, Column] | None = None, levels: int = LEVELS,
) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof, ``folded_root`` and ``verified``.

    ``folded_root`` is recomputed from the row as it is presented: with the columns in ``presented`` in place of its own.
    """
    kind = docs.schema[key].dataType.simpleString()
    shown = [(presented or {}).get(f, F.col(f)) for f in fields]
    leaves = docs.select(
        F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string"))).alias("grp"),
        F.col(key).alias("id"), leaf_digest([F.col(f) for f in fields]).alias("digest"), leaf_digest(shown).alias("presented"),
    )
    tree, place = _Tree(levels), (F.col("pos") - 1).alias("pos")
    numbered = number_rows(leaves, ["grp"], ["id", "digest", "presented"], "pos")
    leaves = store(numbered.select("grp", place, F.col("id").cast("string").alias("id"), "digest", "presented"), "leaves")
    rounds = tree.rounds(leaves)
    # The subroots are the leaves of one more tree.
    subroots = rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("child"), "digest")
    subroots = store(number_rows(subroots, ["grp"], ["child"], "pos").select("grp", place, "child", "digest"), "subroots")
    upper = tree.rounds(subroots)
    head = upper[-1].first()  # one row
    root = F.lit(head["digest"] if head else None).cast("string")
    outer = tree.descend(rounds, tree.subroot_proofs(upper))
    schema = "id string, leaf string, subroot string, proof string, folded_root string"
    found = tree.block(leaves).cogroup(_outer(outer)).applyInPandas(lambda key, rows, outer: tree.finish(key, rows, outer), schema)
    return found.select(
        F.col("id").cast(kind).alias(key), "leaf", "subroot", root.alias("root"), "proof", "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


def manifest_digests(proved: DataFrame, key: str = "doc_id") -> DataFrame:
    """The proofs as one SHA-256 of all siblings, level by level."""
    siblings = F.regexp_replace("proof", "[0-9]:|,", "")
    return proved.select(key, "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")
