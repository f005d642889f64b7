"""The registered queries of the text operators, with check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.llm.columns import ascii_lower, crc32_of_id
from assetlake.llm.decontaminate import decontaminate
from assetlake.llm.jaccard import near_duplicates
from assetlake.llm.lattice import score_documents as lattice_scores
from assetlake.llm.licenses import TEMPLATES, scan_licenses
from assetlake.llm.manifest import manifest, manifest_digests
from assetlake.llm.packing import pack
from assetlake.llm.runs import periodic_runs, repeated_tails, run_digests
from assetlake.llm.secrets import scan_secrets
from assetlake.llm.sharding import SHARDS, shard_documents, topology
from assetlake.llm.tokens import count_tokens
from assetlake.llm.topk import top_k
from assetlake.llm.toxicity import learn, score_documents
from assetlake.llm.warc import page_records, read_warc, write_warc
from assetlake.session import work_path
from assetlake.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


@query("op5_secret_scans")
def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


_ALNUM = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_TEMPLATE_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())


@query("op6_license_scans", f"""
    with t as (select *, least(5, len(w)) as width from (
        select template_id, {_ALNUM} as w from (values {_TEMPLATE_ROWS}) v(template_id, text))),
    ts as (select distinct template_id, width, list_aggregate(w[i:i + width - 1], 'string_agg', ' ') as s
        from (select template_id, width, w, unnest(range(1, len(w) - width + 2)) as i from t)),
    sizes as (select template_id, count(*) as n from ts group by 1),
    d as (select doc_id, {_ALNUM} as w from documents),
    ds as (select doc_id, width, i - 1 as pos, list_aggregate(w[i:i + width - 1], 'string_agg', ' ') as s
        from (select doc_id, w, width, unnest(range(1, len(w) - width + 2)) as i from d, (select distinct width from t) where len(w) >= width)),
    hits as (select ds.doc_id, ts.template_id, ds.pos, ts.s, sizes.n from ds join ts using (width, s) join sizes using (template_id)),
    regions as (select doc_id, template_id, n, s, pos // n + unnest([-2, -1, 0, 1]) as k, pos from hits),
    held as (select doc_id, template_id, k, n from regions
        where k >= 0 and pos >= (k - 1) * n and pos < (k + 3) * n group by 1, 2, 3, 4 having count(distinct s) >= 0.8 * n),
    found as (select doc_id, count(distinct template_id) as n, string_agg(distinct template_id, ',' order by template_id) as ids
        from held group by 1)
    select d.doc_id, coalesce(n, 0) as n_licenses, coalesce(ids, '') as licenses from d left join found using (doc_id)
""")
def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op7_benchmark_decontamination", f"""
    with d as (select doc_id, {_ALNUM} as w from documents),
    b as (select item_id, {_ALNUM} as w from benchmark),
    wins as (select distinct item_id, w[i:i + 9] as win from
        (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from b where len(w) > 0)),
    sizes as (select distinct len(win) as n from wins),
    places as (select doc_id, i, n, w[i:i + n - 1] as win from
        (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes)),
    found as (select p.doc_id, p.i, p.n, wins.item_id from places p join wins using (win)),
    hit as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(i, i + n)) as x from found) group by 1),
    items as (select doc_id, count(distinct item_id) as n_items,
        string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from found group by 1)
    select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
        sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
    from d left join hit using (doc_id) left join items using (doc_id)
""")
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_warc")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return page_records(read_warc(spark, path))


@query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"))


@query("op4_exact_topk", """
    with q as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null),
    flat as (select vec_id, unnest(range(1, len(q) + 1)) as i, unnest(q) as x from q),
    scores as (select a.vec_id as query_id, b.vec_id as vec_id, sum(a.x * b.x)::bigint as score
        from flat a join flat b on a.i = b.i and a.vec_id <> b.vec_id where a.vec_id % 20 = 0 group by 1, 2)
    select query_id, rank::int as rank, vec_id, score from
        (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores) where rank <= 20
""")
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return run_digests(periodic_runs(repeated_tails(docs, crc32_of_id(F.col("doc_id")))))


# SQL for CRC-32: the table of one byte, and a fold over the bytes of a text in hexadecimal.
_CRC_TABLE = """
    bits(i, k, c) as (select i, 0, i::bigint from range(256) r(i)
        union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end from bits where k < 8),
    crc as (select list(c order by i) as t from bits where k = 8)"""


def _crc_sql(text: str) -> str:
    steps = f"list_transform(range(0, octet_length(encode({text}))::bigint), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce({steps}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::bigint), 4294967295::bigint)"


_MERKLE_LEVELS = 9


def _field_sql(column: str) -> str:
    text = f"{column}::varchar"
    return f"case when {column} is null then '-' else octet_length(encode({text})) || ':' || {text} end"


def _tree_sql(name: str) -> str:
    """Level by level: nodes of ``name``0 (grp, pos, d), their runs, and what a group of one node leaves as it is."""
    out = []
    for i in range(_MERKLE_LEVELS):
        out.append(f"""{name}r{i} as (select grp, pos // 8 as run, list(d order by pos) as ds, count(*) over (partition by grp) as runs
            from {name}{i} group by 1, 2)""")
        out.append(f"""{name}{i + 1} as (select grp, run as pos, case when runs = 1 and len(ds) = 1 then ds[1]
            else sha256(array_to_string(ds, '')) end as d from {name}r{i})""")
    return ", ".join(out)


def _proof_sql(name: str, rows: str, prefix: str) -> str:
    """``rows`` (grp, pos, proof, folded) taken up the tree ``name``."""
    out = []
    for i in range(_MERKLE_LEVELS):
        before = f"{prefix}{i - 1}" if i else rows
        alone = "runs = 1 and len(ds) = 1"
        left, right = "array_to_string(ds[1:pos % 8], '')", "array_to_string(ds[pos % 8 + 2:], '')"
        out.append(f"""{prefix}{i} as (select b.* exclude (pos, proof, folded), pos // 8 as pos,
            case when {alone} then proof else proof || {left} || {right} end as proof,
            case when {alone} then folded else sha256({left} || folded || {right}) end as folded
            from {before} b join {name}r{i} r on b.grp = r.grp and r.run = b.pos // 8)""")
    return ", ".join(out)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
_SHOWN = "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", "shown")) + ")"


@query("op11_merkle_manifest", f"""
    with recursive {_CRC_TABLE},
    d as (select *, case when {_crc_sql("doc_id::varchar")} % 3 = 0 then {_LOWER} else text end as shown from documents, crc),
    leaf as (select doc_id, case when lang is null then '0' else '1' || lang end as grp, {_LEAF} as leaf, {_SHOWN} as presented from d),
    rows as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as pos from leaf),
    a0 as (select grp, pos, leaf as d from rows), {_tree_sql("a")},
    sub as (select '' as grp, grp as child, d as subroot, row_number() over (order by encode(grp)) - 1 as pos from a{_MERKLE_LEVELS}),
    b0 as (select grp, pos, subroot as d from sub), {_tree_sql("b")},
    p as (select doc_id, leaf, grp, pos, '' as proof, presented as folded from rows), {_proof_sql("a", "p", "pa")},
    q as (select doc_id, leaf, subroot, sub.grp, sub.pos, proof, folded from pa{_MERKLE_LEVELS - 1} pa join sub on pa.grp = child),
    {_proof_sql("b", "q", "pb")}
    select doc_id, leaf, subroot, b.d as root, sha256(proof) as proof_sha256, folded as folded_root, folded = b.d as verified
    from pb{_MERKLE_LEVELS - 1} join b{_MERKLE_LEVELS} b using (grp)
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(crc32_of_id(F.col("doc_id")) % 3 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    return manifest_digests(manifest(docs, "doc_id", "lang", fields, {"text": tampered}))


def _draw_sql(level: str, child: str, weight: str) -> str:
    u = f"(('0x' || substr(md5(coalesce(doc_id::varchar, '-') || '/{level}/' || {child}), 1, 13))::bigint + 1) / 4503599627370496"
    return f"-ln({u}) / {weight}"


@query("op13_hash_tree_sharding", f"""
    with recursive {_CRC_TABLE},
    body as (select *, row_number() over () as rid, coalesce(text, '') as body from documents),
    d as (select rid, doc_id, octet_length(encode(body)) + 16 as size, coalesce({_crc_sql("body")}, 0)::bigint as text_crc32 from body, crc),
    tree as (select i as shard, i // 4 as rack, i // 8 as region from range({SHARDS}) r(i)),
    trees as (select false as grown, * from tree union all select true, * from tree union all select true, 40, 10, 5),
    regions as (select grown, region, count(*)::double as w from trees group by 1, 2),
    racks as (select grown, region, rack, count(*)::double as w from trees group by 1, 2, 3),
    at_region as (select rid, doc_id, grown, arg_min(region, {_draw_sql("region", "region", "w")}) as region from d, regions group by 1, 2, 3),
    at_rack as (select rid, doc_id, grown, arg_min(rack, {_draw_sql("rack", "rack", "w")}) as rack
        from at_region join racks using (grown, region) group by 1, 2, 3),
    at_shard as (select rid, doc_id, grown, arg_min(shard, {_draw_sql("shard", "shard", "1.0")})::int as shard
        from at_rack join trees using (grown, rack) group by 1, 2, 3)
    select d.doc_id, size::bigint as size, text_crc32, 'key' as law, a.shard,
        row_number() over (partition by a.shard order by d.doc_id nulls first, size, text_crc32) - 1 as slot, b.shard as grown_shard
    from d join at_shard a on d.rid = a.rid and not a.grown join at_shard b on d.rid = b.rid and b.grown
""")
def op13_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), topology(SHARDS), topology(SHARDS + 1))
