from __future__ import annotations

import hashlib
import re

from common import documents, odd_rows, prose

from assetlake.llm.decontaminate import clean_documents, decontaminate
from assetlake.llm.licenses import TEMPLATES, scan_licenses


def words(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_force(rows: list, items: list) -> list[tuple]:
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (window := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= {str(x) for x in windows[window] if x is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (1, prose(70, 40)), (2, prose(71, 12)), (3, "Short item of six words"), (4, "two WORDS"), (5, None), (6, " .,! "), (7, prose(71, 12)),
    (None, prose(72, 15)), (1, prose(73, 11)), (10, "uno é dos ÉL tres cuatro cinco seis siete ocho nueve diez once"),
]


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, token string, win int")


def contaminated_rows() -> list:
    item = ITEMS[0][1].split()
    return [
        *odd_rows(), (100, "before " + ITEMS[0][1] + " after"), (101, " ".join(item[5:15])), (102, " ".join(item[5:14])),
        (103, prose(71, 12).upper().replace(" ", "-- ")), (104, "a short ITEM, of six words; two words! two, words"), (105, prose(72, 15)),
        (106, ITEMS[-1][1]), (106, ITEMS[0][1]), (107, ITEMS[-1][1].replace("É", "é")), (None, ITEMS[0][1]), (108, prose(70, 40) * 2),
        (109, " ".join(item[:10] + item[:10] + item[1:11])),
    ]


def test_decontamination_by_brute_force(spark):
    rows = contaminated_rows()
    got = sorted((tuple(r) for r in decontaminate(documents(spark, rows), benchmark(spark)).collect()), key=str)
    assert got == brute_force(rows, ITEMS)


def test_clean_documents_stay_as_they_are(spark):
    rows = contaminated_rows()
    docs = documents(spark, rows)
    kept = clean_documents(docs, benchmark(spark))
    assert kept.columns == docs.columns
    hit = [flag for *_, flag in brute_force(rows, ITEMS)]
    assert kept.count() == hit.count(False)


def test_empty_tables(spark):
    assert decontaminate(documents(spark, []), benchmark(spark)).count() == 0
    rows = decontaminate(documents(spark, [(1, "a b"), (2, None)]), benchmark(spark, [])).collect()
    assert sorted((r["doc_id"], r["n_words"], r["contaminated"]) for r in rows) == [(1, 2, False), (2, 0, False)]
    assert scan_licenses(documents(spark, [])).count() == 0


def test_licences_are_found_and_near_misses_are_not(spark):
    mit = TEMPLATES["MIT-permission"]
    rows = odd_rows() + [(100 + i, f"{prose(i, 30)}. {t} {prose(i + 50, 40)}") for i, t in enumerate(TEMPLATES.values())]
    changed = mit.split()
    changed[20] = "CHANGED"
    rows += [
        (200, " ".join(changed)), (201, mit[: len(mit) // 2]), (202, "licensed under the apache licence version two"), (203, None),
        (204, TEMPLATES["MIT"] + "\n" + TEMPLATES["Apache-2.0"]), (204, "nothing"), (205, TEMPLATES["MIT"].upper().replace(" ", " - ")),
    ]
    got: dict = {}
    result = scan_licenses(documents(spark, rows)).collect()
    for r in result:
        got.setdefault(r["doc_id"], []).append(r["licenses"])
    assert len(result) == len(rows)
    for i, name in enumerate(TEMPLATES):
        assert name in got[100 + i][0].split(",")
    assert got[200] == ["MIT-permission"] and got[201] == [""] and got[202] == [""] and got[203] == [""]
    assert sorted(got[204]) == ["", "Apache-2.0,MIT"] and got[205] == ["MIT"]
    assert all(x == "" for i, _ in odd_rows() for x in got[i])


def test_short_templates_have_shingles_of_their_own_width(spark):
    templates = [("rights", "All rights reserved."), ("one", "Copyleft"), ("four", "no part of this"), ("MIT", TEMPLATES["MIT"])]
    rows = [
        (1, "Copyright 2020 X. All rights reserved."), (2, "all RIGHTS, reserved"), (3, "all rights are reserved"), (4, "copyleft"), (5, None),
        (6, prose(5, 50) + " all rights reserved no part of this " + TEMPLATES["MIT"]), (7, "no part of that"), (8, ""), (1, "nothing here"),
    ]
    frame = spark.createDataFrame(templates, "template_id string, text string")
    got = sorted(((r["doc_id"], r["licenses"]) for r in scan_licenses(documents(spark, rows), frame).collect()), key=str)
    assert got == sorted(
        [(1, "rights"), (2, "rights"), (3, ""), (4, "one"), (5, ""), (6, "MIT,four,rights"), (7, ""), (8, ""), (1, "")], key=str
    )


def test_a_very_long_text_takes_seconds(spark):
    """Time grows with the length of a text, not with its square."""
    import time

    item, took = ITEMS[0][1], []
    for size in (20_000, 160_000):
        rows = [(1, prose(7, size, 9_000) + " " + item + " " + prose(8, 50)), (2, prose(9, 50))]
        started = time.time()
        got = {r["doc_id"]: r["n_hit"] for r in decontaminate(documents(spark, rows), benchmark(spark)).collect()}
        took.append(time.time() - started)
        assert got == {1: 40, 2: 0}
    assert took[1] < took[0] + 10


def test_native_queries_have_no_python(spark, sf_dir):
    from assetlake.llm.queries import QUERIES

    for name in ("op6_license_scans", "op7_benchmark_decontamination", "op13_hash_tree_sharding"):
        text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in text for word in ("Python", "Pandas", "Arrow")), name
