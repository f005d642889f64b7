from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from assetlake.functions.paths import join_path
from assetlake.operators import objects as ops
from assetlake.sources import Bucket, read_lines, read_texts, scan_files
from assetlake.sources.files import manifest


@pytest.fixture
def bucket(tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "f.txt").write_bytes(b"root")
    (tmp_path / "x" / "g.txt").write_bytes(b"one")
    (tmp_path / "x" / "y" / "h+1 %.txt").write_bytes(b"two\n")
    (tmp_path / "xx").mkdir()
    (tmp_path / "xx" / "z.txt").write_bytes(b"other folder")
    return Bucket("data", str(tmp_path))


def keys(df):
    return sorted(r["key"] for r in df.select("key").collect())


def test_scan_is_recursive_and_prefixes_go_into_the_path(spark, bucket):
    assert keys(bucket.binary_files(spark)) == ["f.txt", "x/g.txt", "x/y/h+1 %.txt", "xx/z.txt"]
    assert keys(bucket.binary_files(spark, "x")) == ["x/g.txt", "x/y/h+1 %.txt"]
    assert keys((bucket / "x" / "y").binary_files(spark)) == ["x/y/h+1 %.txt"]
    assert keys(scan_files(spark, bucket.root, recursive=False)) == ["f.txt"]


def test_scan_without_body_does_not_read_it(spark, bucket):
    plan = bucket.binary_files(spark).select("key", "size")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_folder_names(bucket):
    folder = bucket.folder("a/b") / "c"
    assert folder.path == "a/b/c"
    assert str(folder) == f"{bucket.root}/a/b/c/"


def test_join_path():
    assert join_path("s3a://b/", "/x/", "y") == "s3a://b/x/y"
    assert join_path("/", "x") == "/x"
    assert join_path("root", None, "") == "root"


def test_bucket_root_from_environment(monkeypatch):
    with pytest.raises(ValueError):
        Bucket("nowhere")
    monkeypatch.setenv("data_bucket_name", "real-name")
    assert str(Bucket("data")) == "s3a://real-name/"


def test_put_get_delete(spark, bucket):
    folder = bucket / "x"
    folder.put(spark, "new", "text")
    folder.put(spark, "g.txt", b"overwritten")
    got = {r["key"]: bytes(r["body"]) for r in bucket.objects(spark).collect()}
    assert got["x/new"] == b"text" and got["x/g.txt"] == b"overwritten" and got["f.txt"] == b"root"
    assert bytes(folder.get(spark, "new").first()["body"]) == b"text"
    folder.delete(spark, "g.txt")
    folder.delete(spark, "never there")
    assert keys(bucket.objects(spark)) == ["f.txt", "x/new", "x/y/h+1 %.txt", "xx/z.txt"]
    folder.put(spark, "g.txt", "again")
    assert bytes(bucket.get(spark, "x/g.txt").first()["body"]) == b"again"


def test_get_of_a_missing_key(spark, bucket):
    with pytest.raises(Exception, match="no object with key nope"):
        bucket.get(spark, "nope").collect()
    row = bucket.get(spark, "nope", strict=False).first()
    assert row["found"] is False and row["body"] is None


def test_put_many_needs_unique_keys(spark, bucket):
    rows = spark.createDataFrame([("a", "1"), ("a", "2")], "key string, body string")
    with pytest.raises(ValueError):
        bucket.put(spark, rows)


def test_pages_cover_the_listing(spark, tmp_path):
    bucket = Bucket("many", str(tmp_path / "many"))
    rows = spark.range(25).select(F.format_string("k%03d", "id").alias("key"), F.lit("b").alias("body"))
    bucket.put(spark, rows)
    seen, token = [], None
    while True:
        page = bucket.list(spark, "k", limit=10, next_token=token)
        seen += [r["key"] for r in page.collect()]
        token = ops.next_token(page, 10)
        if token is None:
            break
    assert seen == [f"k{i:03d}" for i in range(25)]
    assert bucket.list(spark).count() == 25


def test_folder_listing_stops_at_its_border(spark, bucket):
    assert keys((bucket / "x").list(spark)) == ["x/g.txt", "x/y/h+1 %.txt"]
    assert keys((bucket / "x").list(spark, "y")) == ["x/y/h+1 %.txt"]


def test_changes(spark):
    schema = "key string, etag string, size long"
    before = spark.createDataFrame([("same", "1", 1), ("new body", "1", 1), ("gone", "1", 1)], schema)
    after = spark.createDataFrame([("same", "1", 1), ("new body", "2", 5), ("new", "9", 9)], schema)
    got = {tuple(r) for r in ops.changes(before, after).collect()}
    assert got == {("create", "new body", "2", 5), ("create", "new", "9", 9), ("delete", "gone", None, None)}
    assert ops.changes(after, after).count() == 0


def test_gzip_logs(spark, tmp_path):
    folder = tmp_path / "c-1" / "node" / "i-1"
    folder.mkdir(parents=True)
    (folder / "out.gz").write_bytes(gzip.compress("a\nb ü\n".encode()))
    (folder / "err.gz").write_bytes(gzip.compress(b"c"))
    rows = read_lines(spark, str(folder), str(tmp_path)).collect()
    assert sorted((r["key"], r["line"]) for r in rows) == [
        ("c-1/node/i-1/err.gz", "c"), ("c-1/node/i-1/out.gz", "a"), ("c-1/node/i-1/out.gz", "b ü"),
    ]
    texts = {r["key"]: r["text"] for r in read_texts(spark, str(folder), str(tmp_path)).collect()}
    assert texts["c-1/node/i-1/out.gz"] == "a\nb ü\n"


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).repartition(2).write.parquet(path)
    files = manifest(spark, path).collect()
    assert len(files) == 2 and sum(r["n"] for r in files) == 10 and all(r["size"] > 0 for r in files)


def test_only_the_folder_of_a_prefix_is_listed(spark, bucket):
    plan = (bucket / "x" / "y").objects(spark)._jdf.queryExecution().executedPlan().toString()
    assert f"{bucket.root}/x/y" in plan
    assert keys(bucket.objects(spark, "x/y/h")) == ["x/y/h+1 %.txt"]
    assert keys(bucket.objects(spark, "absent/")) == []


def test_get_opens_only_what_is_asked_for(spark, tmp_path):
    root = tmp_path / "bucket"
    for i in range(60):
        (root / "a").mkdir(parents=True, exist_ok=True)
        (root / f"a/file {i} [{i % 3}] {{x,y}}+%20é.txt").write_text(f"body {i}")
    bucket = Bucket("b", str(root))
    bucket.put(spark, "a/put.txt", b"log")
    names = [f"a/file {i} [{i % 3}] {{x,y}}+%20é.txt" for i in (3, 17)]
    found = bucket.get(spark, spark.createDataFrame([(n,) for n in [*names, "a/put.txt"]], "key string"))
    assert {r["key"]: bytes(r["body"]) for r in found.collect()} == {names[0]: b"body 3", names[1]: b"body 17", "a/put.txt": b"log"}
    from assetlake.sources.files import open_files

    scan = open_files(spark, str(root), [*names, "a/none.txt", "a"])
    assert scan.count() == 2
    assert len(scan.inputFiles()) == 2
    assert bytes((bucket / "a").get(spark, names[0][2:]).first()["body"]) == b"body 3"
    many = spark.range(1_500).selectExpr("if(id = 7, 'a/put.txt', concat('a/none', id)) as key")
    assert bucket.get(spark, many, strict=False).filter("found").count() == 1


@pytest.mark.parametrize("name", ["object_put", "object_event_stream"])
def test_pages_may_share_a_url(spark, tmp_path, name):
    """Several pages of one url, and whole rows that come twice, are objects of their own."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq
    from oracle import expected_rows, rows_of

    from assetlake import queries as registry

    registry.load()
    urls = ["https://a.com/en/1#x", "http://a.com/de/2", "http://spam-farm.net/en/3", "https://a.com"]
    rows = [(i, url, f"body {i % 5}") for i in range(9) for url in urls] + [(1, urls[1], "body 1"), (7, urls[0], None)]
    pq.write_table(pa.table(dict(zip(["page_id", "url", "html"], zip(*rows)))), tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    assert rows_of(registry.QUERIES[name](spark, str(tmp_path))) == expected_rows(con, registry.ORACLES[name])[1]
