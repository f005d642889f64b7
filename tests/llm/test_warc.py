from __future__ import annotations

import gzip

import pytest

from assetlake.llm.warc import members, page_records, page_urn, read_warc, record_bytes, salvage, sha1_base32, write_warc
from assetlake.session import work_path
from assetlake.tables import table


def expected(rows: list) -> list[tuple]:
    largest: dict[bytes, int | None] = {}
    for r in rows:
        data = (r["html"] or "").encode()
        known = [x for x in (largest.get(data), r["page_id"]) if x is not None]
        largest[data] = max(known, default=None)
    out = []
    for r in rows:
        data = (r["html"] or "").encode()
        again = largest[data] != r["page_id"]
        out.append((r["page_id"], len(data), sha1_base32(data), "revisit" if again else "response", largest[data] if again else None))
    return sorted(out, key=str)


def round_trip(spark, pages) -> None:
    path = work_path(spark, "warc")
    write_warc(pages, path, records_per_file=40)
    records = read_warc(spark, path)
    assert records.where("kind = 'gap'").count() == 0
    assert sorted(map(tuple, page_records(records).collect()), key=str) == expected(pages.collect())
    payloads = {r["record_id"]: bytes(r["payload"]) for r in records.where("record_type = 'response'").collect()}
    for row in pages.collect():
        if page_urn(row["page_id"]) in payloads:
            assert payloads[page_urn(row["page_id"])] == (row["html"] or "").encode()


def test_round_trip(spark, sf_dir):
    round_trip(spark, table(spark, sf_dir, "pages"))


def test_odd_pages(spark):
    rows = [
        (1, "u\n é", "x" * (9 << 20), "a"), (2, None, None, "b"), (3, "a", "", "c"), (4, "b", "x" * (9 << 20), "d"), (None, "c", "x\x00y", "e"),
        (4, "b", "x" * (9 << 20), "f"), (5, "c", "x\x00y", "g"), (6, "WARC/1.1", "WARC/1.1\r\n\r\nWARC/1.1\r\n", "h"), (7, "z", "other", "i"),
    ]
    round_trip(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string, sha1 string"))


def test_empty_table(spark):
    path = work_path(spark, "warc")
    write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert read_warc(spark, path).count() == 0


RECORDS = [record_bytes(page_urn(i), "response", f"http://x/{i}", sha1_base32(b"<p>" * i), 3 * i, b"<p>" * i) for i in range(1, 8)]


def covers(data: bytes) -> list[dict]:
    rows, at = list(salvage(data)), 0
    for row in rows:
        assert row["offset"] == at
        at += row["length"]
    assert at == len(data)
    return rows


def ids(rows: list[dict]) -> list[str]:
    return [r["record_id"] for r in rows if r["kind"] == "record"]


@pytest.mark.parametrize("packed", [False, True])
def test_damage_costs_only_the_damaged_record(packed):
    parts = [members(r) if packed else r for r in RECORDS]
    whole = b"".join(parts)
    assert ids(covers(whole)) == [page_urn(i) for i in range(1, 8)]
    middle = sum(map(len, parts[:3])) + 2 * len(parts[3]) // 3
    for damage in (whole[:middle] + b"\x00\xff" + whole[middle + 2 :], whole[:middle] + whole[middle + 9 :], whole[:middle] + b"garbage" + whole[middle:]):
        rows = covers(damage)
        assert ids(rows) == [page_urn(i) for i in (1, 2, 3, 5, 6, 7)]
        assert [r["kind"] for r in rows].count("gap") == 1
    assert ids(covers(b"junk" + whole)) == [page_urn(i) for i in range(1, 8)]
    assert ids(covers(whole[:-3])) == [page_urn(i) for i in range(1, 7)]
    cut = b"".join(parts[:2]) + parts[2][: len(parts[2]) // 2] + b"".join(parts[3:])
    assert ids(covers(cut)) == [page_urn(i) for i in (1, 2, 4, 5, 6, 7)]
    assert covers(b"") == []


def test_a_wrong_digest_is_a_gap():
    bad = record_bytes(page_urn(9), "response", "u", sha1_base32(b"other"), 4, b"this")
    rows = covers(RECORDS[0] + bad + RECORDS[1])
    assert [r["kind"] for r in rows] == ["record", "gap", "record"] and rows[1]["reason"] == "payload digest"


def test_members_are_plain_gzip():
    data = members(RECORDS[0]) + members(RECORDS[1])
    assert gzip.decompress(data) == RECORDS[0] + RECORDS[1] and data[-1] == 0


def test_members_that_hold_several_records():
    whole = gzip.compress(b"".join(RECORDS[:5]))
    rows = covers(whole)
    assert ids(rows) == [page_urn(i) for i in range(1, 6)] and {r["kind"] for r in rows} == {"record"}
    assert [r["inner_offset"] for r in rows] == [sum(map(len, RECORDS[:i])) for i in range(5)]
    mixed = members(RECORDS[0]) + gzip.compress(RECORDS[1] + RECORDS[2]) + members(RECORDS[3])
    assert ids(covers(mixed)) == [page_urn(i) for i in range(1, 5)]
    broken = RECORDS[2][: len(RECORDS[2]) // 2] + b"\r\n"
    rows = covers(members(RECORDS[0]) + gzip.compress(RECORDS[1] + broken + RECORDS[3]) + members(RECORDS[4]))
    assert ids(rows) == [page_urn(i) for i in (1, 2, 4, 5)] and [r["kind"] for r in rows].count("gap") == 1
    nothing = covers(members(RECORDS[0]) + gzip.compress(b"no record at all") + members(RECORDS[1]))
    assert [r["kind"] for r in nothing] == ["record", "gap", "record"] and "inner_offset" not in nothing[1]
