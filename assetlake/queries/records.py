"""Records: decode, split, parse, quarantine, filter, flatten."""

from __future__ import annotations

from typing import Literal, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.functions.paths import uri_container
from assetlake.functions.records import check_json, encode_json, infer_json, parse_json
from assetlake.functions.text import decode_utf8, split_lines
from assetlake.functions.variants import infer_variant, variant_columns
from assetlake.operators.filters import first_members, flatten_groups
from assetlake.operators.filters import first_of_type as first_row
from assetlake.operators.filters import glob_filter as filter_globs
from assetlake.operators.filters import glob_filter_table
from assetlake.operators.filters import require_columns as require
from assetlake.operators.filters import status_filter as filter_status
from assetlake.plans.jobs import jsonl_etl as run_jsonl_etl
from assetlake.queries import query
from assetlake.schema import check_rows
from assetlake.session import work_path
from assetlake.sources.formats import read_table
from assetlake.tables import table

EVENT_TYPES = ("click", "view", "purchase", "signup", "error")


class Props(NamedTuple):
    k: int


class EventLine(NamedTuple):
    event_id: int
    user_id: int
    event_type: Literal["click", "view", "purchase", "signup", "error"]
    value: float | None


@query("decode_utf8", "select page_id, html as text from pages")
def decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("body"))
    return bodies.select("page_id", decode_utf8(F.col("body")).alias("text"))


@query("split_lines", """
    select doc_id, i - 1 as pos, parts[i] as line from (select doc_id, string_split(text, chr(10)) as parts,
        unnest(generate_series(1, len(string_split(text, chr(10))))) as i from documents)
""")
def lines_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query("json_typed", "select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events")
def json_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", parse_json(F.col("props"), "k int")["k"].alias("k"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = encode_json("event_id", "user_id", "event_type", "value").alias("value")
    return table(spark, sf_dir, "events").select(line)


@query("json_infer", """
    select event_id, user_id, event_type, value from events
""")
def json_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema comes from all lines; fields come back sorted by name."""
    path = work_path(spark, "lines")
    event_lines(spark, sf_dir).write.text(path)
    return infer_json(spark, path).select("event_id", "user_id", "event_type", "value")


def damaged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event bodies; those of error events have lost their first character."""
    body = F.when(F.col("event_type") == "error", F.expr("substr(props, 2)")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", body.alias("body"))


@query("json_quarantine", """
    select event_id, case when ok then cast(json_extract_string(body, '$.k') as bigint) end as k, ok as good,
        case when not ok then body end as rejected
    from (select event_id, body, json_valid(body) as ok
          from (select event_id, case when event_type = 'error' then substr(props, 2) else props end as body from events))
""")
def json_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = check_json(damaged_events(spark, sf_dir), "body", Props)
    good = F.col("_reason").isNull()
    return checked.select(
        "event_id", F.when(good, F.col("record.k")).alias("k"), good.alias("good"),
        F.when(~good, F.col("body")).alias("rejected"),
    )


def tailed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event bodies, of which one type starts with a tab and three end in text that does not belong to the record."""
    kind = F.col("event_type")
    body = F.when(kind == "view", F.concat(F.lit("\t"), "props")).when(kind == "click", F.concat("props", F.lit(" junk")))
    body = body.when(kind == "error", F.concat("props", "props")).when(kind == "purchase", F.concat("props", F.lit("]")))
    return table(spark, sf_dir, "events").select("event_id", body.otherwise(F.col("props")).alias("body"))


@query("json_variant", """
    select event_id, event_id % 7 = 6 as _corrupt, case when event_id % 7 = 6 then null
        when event_id % 3 = 0 then cast(json_extract(props, '$.k') as varchar)
        when event_id % 3 = 1 then '"' || event_type || '"' else '[' || user_id || ',null]' end as k,
        case when event_id % 7 <> 6 and event_id % 2 = 0 then user_id end as n,
        case when event_id % 7 <> 6 then event_type end as kind from events
""")
def json_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies in which ``k`` is a number, a text or a list; it stays what it is, the other fields get their types."""
    k = """case event_id % 3 when 0 then get_json_object(props, '$.k') when 1 then concat('"', event_type, '"') else concat('[', user_id, ',null]') end"""
    n = """if(event_id % 2 = 0, concat(',"n":', user_id), '')"""
    body = F.expr(f"""if(event_id % 7 = 6, '{{"k":', concat('{{"k":', {k}, {n}, ',"kind":"', event_type, '"}}')) as body""")
    typed = infer_variant(table(spark, sf_dir, "events").select("event_id", body), "body")
    if variant_columns(typed) != ["k"]:
        raise AssertionError(f"variants are {variant_columns(typed)}")
    return typed.select("event_id", "_corrupt", F.to_json("k").alias("k"), "n", "kind")


@query("json_strict", """
    select event_id, json_valid(body) as good from (select event_id, case event_type when 'view' then chr(9) || props
        when 'click' then props || ' junk' when 'error' then props || props when 'purchase' then props || ']' else props end as body from events)
""")
def json_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = check_json(tailed_events(spark, sf_dir), "body", Props)
    return checked.select("event_id", F.col("_reason").isNull().alias("good"))


@query("message_encode_time", """
    select event_id, '{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"}' as body
    from (select event_id, ts + to_microseconds(event_id % 1000) as ts from events)
""")
def message_encode_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps keep their microseconds in messages."""
    moved = F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("event_id") % 1000 / 1_000_000).cast("decimal(18,6)"))
    events = table(spark, sf_dir, "events").select("event_id", moved.alias("ts"))
    return events.select("event_id", encode_json("ts").alias("body"))


@query("jsonl_etl", "select event_id, user_id, event_type, value from events")
def jsonl_etl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines, then taken through the whole job."""
    root = work_path(spark, "jsonl")
    event_lines(spark, sf_dir).write.text(f"{root}/in")
    path = run_jsonl_etl(spark, f"{root}/in", f"{root}/out", "2024-01-31-06-00-00", EventLine)
    return read_table(spark, path, EventLine)


@query("glob_filter", """
    select url as key from pages where url glob '*.com/en/*'
    union all select url from pages where url glob 'http://[!w]*'
""")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "pages").select(F.col("url").alias("key"))
    return filter_globs(names, "key", ["*.com/en/*", "http://[!w]*"])


@query("glob_filter_distinct", "select url as key from pages where url glob '*.com/en/*' or url glob 'http://[!w]*'")
def glob_filter_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "pages").select(F.col("url").alias("key"))
    return filter_globs(names, "key", ["*.com/en/*", "http://[!w]*"], distinct_keys=True)


GLOB_TABLE_SQL = """
    select substr(url, 1, (14 + page_id % 10)::int) || '*' as pattern from pages
    union all select '*/' || (o_orderkey % 1000) from orders
    union all select '*/[d-f]?/' || (c_custkey % 1000) || '?*' from customer
"""


def _glob_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globs with a literal start, with a literal end, and with both ends open; about as many as there are orders."""
    starts = table(spark, sf_dir, "pages").select(F.expr("substr(url, 1, int(14 + page_id % 10)) || '*' as pattern"))
    ends = table(spark, sf_dir, "orders").select(F.expr("'*/' || (o_orderkey % 1000) as pattern"))
    middles = table(spark, sf_dir, "customer").select(F.expr("'*/[d-f]?/' || (c_custkey % 1000) || '?*' as pattern"))
    return starts.unionByName(ends).unionByName(middles)


@query("glob_filter_table", f"select url as key from pages join ({GLOB_TABLE_SQL}) on url glob pattern")
def glob_filter_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "pages").select(F.col("url").alias("key"))
    return glob_filter_table(names, "key", _glob_table(spark, sf_dir))


@query("glob_filter_table_distinct", f"""
    select url as key from pages where exists (select 1 from ({GLOB_TABLE_SQL}) where url glob pattern)
""")
def glob_filter_by_table_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "pages").select(F.col("url").alias("key"))
    return glob_filter_table(names, "key", _glob_table(spark, sf_dir), distinct_keys=True)


@query("status_filter", "select event_id, event_type from events where event_type in ('click', 'view')")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return filter_status(events, "event_type", "click,view", EVENT_TYPES)


@query("require_columns", """
    select event_id, k from (select event_id, nullif(event_type, 'error') as k from events) t where k is not null
""")
def require_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("k", F.expr("nullif(event_type, 'error')"))
    return require(rows, ["event_id", "k"])


@query("nested_flatten", """
    select doc_id, type, type_pos, id from (
        select doc_id, case lang when 'en' then 'primary' when 'de' then 'core' else 'task' end as type,
            case lang when 'en' then 0 when 'de' then 1 else 2 end::bigint as type_pos,
            unnest(string_split(text, chr(10))) as id
        from documents where lang in ('en', 'de', 'fr')) where id <> ''
""")
def nested_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups are documents, members their lines; a blank line is a member without an id."""
    groups = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.nullif(x, F.lit("")).alias("id"))).alias("members")
    )
    stored = {"primary": "en", "core": "de", "task": "fr"}
    return flatten_groups(groups, "lang", "members", F.col("member.id"), groups=stored)


_STATES_SQL = "list_value('RUNNING', 'STOPPED', 'BOOTSTRAPPING', 'TERMINATED', 'FAILED')"


@query("nested_member_states", f"""
    with m as (select doc_id, lang, id, row_number() over (partition by doc_id order by i) as place from (
        select doc_id, lang, generate_subscripts(lines, 1) as i, unnest(lines) as id from (
            select doc_id, lang, string_split(text, chr(10)) as lines from documents where lang in ('en', 'de', 'fr')))
        where {_STATES_SQL}[length(id) % 5 + 1] in ('RUNNING', 'BOOTSTRAPPING', 'TERMINATED'))
    select 'all' as kind, doc_id, count(*) as n, min(id) as id from m where id <> '' group by doc_id
    union all select 'first', doc_id, null, id from m where place = 1 and lang = 'en' and id <> ''
""")
def nested_member_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as members with a state by their length: all that are in a state that counts, and the first of each primary group."""
    names = F.array(*[F.lit(s) for s in ("RUNNING", "STOPPED", "BOOTSTRAPPING", "TERMINATED", "FAILED")])
    groups = table(spark, sf_dir, "documents").select("doc_id", "lang", F.transform(
        F.split("text", "\n", -1), lambda x: F.struct(F.nullif(x, F.lit("")).alias("id"), F.get(names, F.char_length(x) % 5).alias("state"))
    ).alias("members"))
    stored = {"primary": "en", "core": "de", "task": "fr"}
    found = flatten_groups(groups, "lang", "members", F.col("member.id"), groups=stored, state=F.col("member.state"))
    everyone = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("id").alias("id")).select(F.lit("all").alias("kind"), "doc_id", "n", "id")
    # A first member without an id, here a blank line, fails the query; such groups are left out.
    counted = F.filter("members", lambda m: m["state"].isin("RUNNING", "BOOTSTRAPPING", "TERMINATED"))
    first = first_members(groups.filter(F.get(counted, F.lit(0))["id"].isNotNull()), "lang", "members", lambda m: m["id"], "primary", stored, lambda m: m["state"])
    return everyone.unionByName(first.select(F.lit("first").alias("kind"), "doc_id", F.lit(None).cast("bigint").alias("n"), "id"))


@query("first_of_type", """
    select grp, event_id from (select event_type as grp, event_id,
        row_number() over (partition by event_type order by ts, event_id) as rn from events) t where rn = 1
""")
def first_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), "event_id", "ts")
    return first_row(events, "grp", ["ts", "event_id"]).select("grp", "event_id")


@query("uri_host", "select page_id, string_split(url, '/')[3] as host from pages")
def uri_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", uri_container(F.col("url")).alias("host"))


class StrictOrder(NamedTuple):
    o_orderkey: int
    o_custkey: str
    o_orderstatus: Literal["F", "O"]


@query("conform_schema", """
    select o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus,
        case when o_orderstatus not in ('F', 'O') then 'o_orderstatus: value is not allowed' end as reason from orders
""")
def conform_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_rows(table(spark, sf_dir, "orders"), StrictOrder, reason="reason")
