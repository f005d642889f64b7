"""Objects: scan, list, get, put, delete, events; files and formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.functions.text import decode_utf8, not_blank, split_lines
from assetlake.operators.filters import glob_filter as filter_globs
from assetlake.operators import objects as ops
from assetlake.operators.objects import latest
from assetlake.queries import query
from assetlake.session import work_path
from assetlake.sources.buckets import Bucket
from assetlake.sources.files import read_lines
from assetlake.sources.formats import TableFormat, read_table, snapshot_sink, write_table
from assetlake.streaming.events import file_events, run_subscriptions
from assetlake.streaming.queues import write_batch
from assetlake.tables import table

EARLY = "1997-01-01 00:00:00"
LATE = "1997-07-01 00:00:00"

STATE_SQL = """(select o_custkey as key, o_orderkey, o_totalprice, o_orderstatus from (
    select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn
    from orders where {where}) where rn = 1 and o_orderstatus <> 'P')"""
EARLY_SQL = STATE_SQL.format(where="o_orderdate <= timestamp '1997-01-01 00:00:00'")
LATE_SQL = STATE_SQL.format(where="o_orderdate <= timestamp '1997-07-01 00:00:00'")


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def order_state(orders: DataFrame, condition: Column) -> DataFrame:
    """Newest order of every customer; an order with status P removes the customer."""
    newest = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    rows = latest(orders.filter(condition), "o_custkey", newest, F.col("o_orderstatus") == "P")
    return rows.select(F.col("o_custkey").alias("key"), "o_orderkey", "o_totalprice", "o_orderstatus")


def page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.describe(table(spark, sf_dir, "pages"), F.col("url"), F.encode("html", "UTF-8"))


@query("object_scan", """
    select regexp_replace(url, '^[a-z]+://', '') as key, md5(html) as etag, octet_length(encode(html)) as size from pages
""")
def object_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return ops.describe(pages, F.regexp_replace("url", "^[a-z]+://", ""), F.encode("html", "UTF-8"))


@query("object_list", """
    select url as key, md5(html) as etag from pages
    where starts_with(url, 'https://') and url > 'https://blog.' order by url limit 25
""")
def object_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "pages").select(F.col("url").alias("key"), ops.etag_of(F.col("html")).alias("etag"))
    return ops.list_page(objects, "https://", limit=25, token="https://blog.")


@query("object_list_all", "select url as key from pages where starts_with(url, 'https://blog.')")
def object_list_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.list_all(table(spark, sf_dir, "pages").select(F.col("url").alias("key")), "https://blog.")


@query("object_get", """
    select l.doc_id as key, p.page_id is not null as found, octet_length(encode(p.html)) as size
    from labels l left join pages p on p.page_id = l.doc_id
""")
def object_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("html").cast("bigint").alias("size")
    objects = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), size)
    requested = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"))
    return ops.get(objects, requested).select("key", "found", "size")


def page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url``, ``body`` and a ``key`` of its own for every page, as several pages may have one url: the url and a digest of
    the row's place in the files, the same each time it is read. A page without a url is no object.
    """
    place = F.md5(F.concat_ws(":", "_metadata.file_path", "_metadata.row_index").cast("binary"))
    pages = table(spark, sf_dir, "pages").select(F.col("url"), F.col("html").alias("body"), F.concat("url", F.lit("#"), place).alias("key"))
    return pages.filter("url is not null")


def page_url(key: Column) -> Column:
    """The url of a page's key."""
    return F.left(key, F.char_length(key) - F.lit(33))


@query("object_put", """
    select url as key, octet_length(encode(body)) as size, md5(body) as etag from (
        select url, case when starts_with(url, 'http://') then upper(lang) || html else html end as body
        from (select url, html, string_split(url, '/')[4] as lang from pages)
    ) where not contains(url, 'spam-farm')
""")
def object_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put all pages, overwrite some, delete some; then read what is there."""
    bucket = Bucket("pages", work_path(spark, "bucket"))
    pages = page_objects(spark, sf_dir)
    bucket.put(spark, pages)
    marked = F.concat(F.upper(F.element_at(F.split("url", "/"), 4)), F.col("body"))
    bucket.put(spark, pages.filter(F.col("url").startswith("http://")).withColumn("body", marked))
    bucket.delete(spark, pages.filter(F.col("url").contains("spam-farm")).select("key"))
    return bucket.objects(spark).select(page_url(F.col("key")).alias("key"), "size", "etag")


@query("upsert_latest", """
    select key, event_type, value from (select user_id as key, event_type, value,
        row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) t where rn = 1
""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")])
    return rows.select(F.col("user_id").alias("key"), "event_type", "value")


@query("object_delete", """
    select doc_id as key from documents d
    where not exists (select 1 from labels l where l.toxic = 1 and l.doc_id = d.doc_id)
""")
def object_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    doomed = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("key"))
    return ops.delete(objects, doomed)


@query("object_events", f"""
    with a as (select key, md5(o_orderkey || '/' || o_orderstatus) as etag from {EARLY_SQL}),
         b as (select key, md5(o_orderkey || '/' || o_orderstatus) as etag, octet_length(encode(o_orderstatus)) as size from {LATE_SQL})
    select coalesce(a.key, b.key) as key, case when b.key is null then 'delete' else 'create' end as scope, b.etag, b.size
    from a full outer join b on a.key = b.key where a.key is null or b.key is null or a.etag <> b.etag
""")
def object_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")

    def inventory(at: str) -> DataFrame:
        state = order_state(orders, F.col("o_orderdate") <= moment(at))
        etag = F.md5(F.concat_ws("/", "o_orderkey", "o_orderstatus").cast("binary"))
        return state.select("key", etag.alias("etag"), F.octet_length("o_orderstatus").cast("bigint").alias("size"))

    return ops.changes(inventory(EARLY), inventory(LATE)).select("key", "scope", "etag", "size")


def line_folders(spark: SparkSession, sf_dir: str, compression: str) -> str:
    """Text files with the lines of all documents, one folder per language."""
    root = work_path(spark, "logs")
    lines = split_lines(table(spark, sf_dir, "documents").select("lang", "text"), "text").select("lang", "line")
    lines.hint("rebalance", F.col("lang")).write.partitionBy("lang").text(root, compression=compression, lineSep="\n")
    return root


def language(key: str) -> Column:
    return F.regexp_extract(key, "^lang=([^/]*)/", 1).alias("lang")


@query("gz_text_scan", "select lang, unnest(string_split(text, chr(10))) as line from documents")
def gz_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as gzip files, then read from all folders."""
    root = line_folders(spark, sf_dir, "gzip")
    return read_lines(spark, root, root).select(language("key"), "line")


@query("log_texts", """
    select lang, line from (select lang, unnest(string_split(text, chr(10))) as line from documents where lang in ('de', 'fr'))
""")
def log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gzip files below a prefix whose names match: the names are filtered before any file is opened."""
    root = line_folders(spark, sf_dir, "gzip")
    matching = filter_globs(read_lines(spark, root, root), "key", ["lang=d*/*.gz", "lang=f[!x]/*.gz"], distinct_keys=True)
    return matching.select(language("key"), "line")


@query("folder_scan", """
    select lang, line from (select lang, unnest(string_split(text, chr(10))) as line from documents where lang = 'de')
    where trim(line) <> ''
""")
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files of one folder of a bucket: bytes to text to lines."""
    folder = Bucket("logs", line_folders(spark, sf_dir, "none")) / "lang=de"
    texts = folder.binary_files(spark).select("key", decode_utf8(F.col("body")).alias("text"))
    return split_lines(texts, "text").filter(not_blank(F.col("line"))).select(language("key"), "line")


@query("folder_list", """
    select 'en/' || lpad(cast(doc_id as varchar), 12, '0') as key, octet_length(encode(text)) as size from documents
    where lang = 'en' order by key limit 100
""")
def folder_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of a folder, in the default page size."""
    bucket = Bucket("texts", work_path(spark, "bucket"))
    key = F.concat_ws("/", "lang", F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    bucket.put(spark, table(spark, sf_dir, "documents").select(key.alias("key"), F.col("text").alias("body")))
    return (bucket / "en").list(spark).select("key", "size")


@query("file_event_stream", """
    select lang, sum(octet_length(encode(line)) + 1)::bigint as bytes
    from (select lang, unnest(string_split(text, chr(10))) as line from documents) group by lang
""")
def file_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that arrived per folder, from the events of new files."""
    bucket, out = Bucket("logs", line_folders(spark, sf_dir, "none")), work_path(spark, "events")
    bucket.on("create")(lambda events, batch_id: write_batch(events.select("key", "size"), out, batch_id))
    run_subscriptions(file_events(spark, bucket), bucket, work_path(spark, "checkpoint")).awaitTermination()
    arrived = spark.read.schema("key string, size long").parquet(f"{out}/*")
    return arrived.groupBy(language("key")).agg(F.sum("size").alias("bytes"))


def _round_trip(spark: SparkSession, sf_dir: str, name: str, fmt: TableFormat) -> DataFrame:
    rows = table(spark, sf_dir, name)
    path = write_table(rows, work_path(spark, fmt.value), fmt)
    return read_table(spark, path, rows.schema, fmt)


@query("fmt_csv", "select doc_id, text, lang, source, n_chars from documents")
def fmt_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "documents", TableFormat.CSV)


@query("fmt_json", "select event_id, ts, user_id, event_type, value, props from events")
def fmt_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "events", TableFormat.JSON)


@query("fmt_orc", """
    select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders
""")
def fmt_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "orders", TableFormat.ORC)


@query("fmt_parquet", "select * from lineitem")
def fmt_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "lineitem", TableFormat.PARQUET)


@query("snapshot_sink", "select page_id, url, html from pages")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = snapshot_sink(pages, work_path(spark, "scans"), "2024-01-31-06-00-00", inputs=[f"{sf_dir}/pages.parquet"])
    return read_table(spark, path, pages.schema)
