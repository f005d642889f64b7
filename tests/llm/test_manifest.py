from __future__ import annotations

import hashlib
import zlib

import pytest
from common import SCHEMA, documents, odd_rows

from assetlake.llm import manifest as m
from assetlake.llm.columns import ascii_lower, crc32_of_id
from pyspark.sql import functions as F


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values: list) -> str:
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes: list) -> tuple[str, list[list[tuple[list, list]]]]:
    """The root, and for each node the siblings before and after it on each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            first = place // 8 * 8
            paths[i].append((nodes[first:place], nodes[place + 1 : first + 8]))
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [place // 8 for place in at]
    return nodes[0], paths


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    """Rows of (doc_id, source, lang, n_chars, text)."""
    groups: dict = {}
    for row in rows:
        doc, text = row[0], row[4]
        bent = text
        if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 and text is not None:
            bent = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups.setdefault(row[2], []).append((doc, leaf(list(row)), leaf([*row[:4], bent])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        below[g] = tree([r[1] for r in groups[g]])
    root, upper = tree([below[g][0] for g in order]) if order else (None, [])
    out = []
    for g, above in zip(order, upper):
        for (doc, own, shown), path in zip(groups[g], below[g][1]):
            node, siblings = shown, []
            for before, after in path + above:
                siblings += before + after
                node = sha(*before, node, *after)
            out.append((doc, own, below[g][0], root, sha(*siblings), node, node == root))
    return sorted(out, key=str)


def found(docs, levels: int = m.LEVELS) -> list[tuple]:
    bent = F.when(crc32_of_id(F.col("doc_id")) % 3 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    proved = m.manifest(docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], {"text": bent}, levels)
    return sorted((tuple(r) for r in m.manifest_digests(proved).collect()), key=str)


def test_one_group_with_odd_rows(spark):
    docs = documents(spark, odd_rows()).withColumn("source", F.lit(None).cast("string"))
    assert found(docs) == plain_manifest([(i, None, "en", None, t) for i, t in odd_rows()])


@pytest.mark.parametrize("levels", [1, 3])
def test_many_groups_and_heights(spark, levels):
    sizes = {None: 3, "": 1, "de": 600, "en": 8, "éa": 65, "zz": 64, "Z": 513, "a,b:c": 2, "i": 512, "j": 9}
    rows = [(1000 * k + i, "s", lang, i, f"Text {i} É") for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(None, None, "de", None, "X"), (7, "s", "zz", 1, "x"), (7, "s", "zz", 1, "y"), (7, "s", "zz", 1, "y")]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    got = found(frame.withColumn("pos", F.lit(1)).withColumn("grp", F.lit("g")).withColumn("digest", F.lit("d")), levels)
    assert got == plain_manifest(rows)
    assert {r[6] for r in got} == {True, False}


def test_empty_table_and_one_row(spark):
    assert found(spark.createDataFrame([], SCHEMA).withColumn("source", F.lit("s"))) == []
    row = (3, "s", "en", 1, "Abc")
    frame = spark.createDataFrame([row], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert found(frame) == plain_manifest([row])
