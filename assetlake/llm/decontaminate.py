"""Benchmark passages in documents: a prefix-filtered set join, in DataFrame operations only.

A window is ten consecutive words of a benchmark item, or all of a shorter item. Its tokens are its
five-word shingles (shorter for a shorter item). A window occurs only where all its tokens
do, so the prefix that has to be joined is one token: the rarest, by its count over all documents.

1. One pass over the documents joins the places of their shingles with the set of all window tokens. What remains is
   stored: it is as large as the contamination.
2. Counts over the stored rows give the rarity of every token; each window keeps its rarest one.
3. The prefix tokens are joined with the stored rows. The token's place in the window gives the start, which has to
   lie in the document and leave room for the window.
4. The places that are left are grouped by text and joined with the texts; the words of such a text are taken once and
   compared at each place. No step copies a text, or its words, for each of its places.

Tokens and keys of texts are broadcast up to ``BROADCAST_ROWS`` rows, prefixes up to ``BROADCAST_WIDE_ROWS``; beyond that the
joins are shuffled.

Defined cases: null and empty texts have no words and no hits; rows that share id and text have the
same result each; rows that share only the id do not mix; items without words have no window; items without id
mark words as hit but are not counted; items that share an id are one item; tables without rows give
no hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.columns import alnum_words, computed, shingle_hashes, small_enough, store

WINDOW = 10
SHINGLE = 5
BROADCAST_ROWS = 1_000_000
#: Rows that hold the words of a window.
BROADCAST_WIDE_ROWS = 200_000


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, win) for every window of every item; ``win`` is an array of words."""
    items = benchmark.select("item_id", computed(alnum_words(F.col("text"))).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("win"))


def _tokens(windows: DataFrame) -> DataFrame:
    """(win, width, offset, token) for every shingle of every distinct window."""
    each = windows.select("win").distinct().withColumn("width", F.least(F.size("win"), F.lit(SHINGLE)))
    starts = F.sequence(F.lit(1), F.size("win") - F.col("width") + 1)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice("win", i, F.col("width"))))
    return each.select("win", "width", F.posexplode(hashes).alias("offset", "token"))


def _hits(docs: DataFrame, tokens: DataFrame) -> DataFrame | None:
    """(doc_id, text_hash, size in words, pos, token, width) of document shingles that are tokens of any window."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), computed(alnum_words(F.col("text"))).alias("words"))
    texts = texts.withColumn("size", F.size("words"))
    widths = [r["width"] for r in tokens.select("width").distinct().collect()]  # at most SHINGLE values
    found = None
    for width in sorted(widths):
        wanted = small_enough(tokens.where(F.col("width") == width).select("token").distinct(), BROADCAST_ROWS)
        # The words end here: a row for each place would take a copy of them along.
        at = texts.select("doc_id", "text_hash", "size", F.posexplode(shingle_hashes(F.col("words"), width)).alias("pos", "token"))
        part = at.join(wanted, "token").select("doc_id", "text_hash", "size", "pos", "token", F.lit(width).alias("width"))
        found = part if found is None else found.unionAll(part)
    return found


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame | None:
    """(doc_id, text_hash, start, win) wherever a window occurs; None if there is no window."""
    tokens = store(_tokens(item_windows(benchmark, window)), "tokens")
    hits = _hits(docs, tokens)
    if hits is None:
        return None
    hits = store(hits, "hits")
    counts = hits.groupBy("token").agg(F.count("*").alias("n"))
    ranked = tokens.join(counts, "token")  # a token without a count occurs nowhere, and so does its window
    complete = F.size("win") - F.col("width") + 1
    prefix = ranked.groupBy("win").agg(
        F.min(F.struct("n", "token", "offset", "width")).alias("rarest"), F.count("*").alias("seen"), F.max(complete).alias("needed")
    ).where("seen = needed").select("win", "rarest.token", "rarest.offset", "rarest.width")
    start = F.col("pos") - F.col("offset")
    within = (start >= 0) & (start + F.size("win") <= F.col("size"))
    joined = hits.join(small_enough(store(prefix, "prefix"), BROADCAST_WIDE_ROWS), ["token", "width"]).where(within)
    places = joined.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(start.alias("start"), "win")).alias("places"))
    places = places.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "places")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    same_text = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    places = store(places, "places")
    # Only keys are broadcast; the places meet the texts that they are in by a shuffle of just these.
    texts = texts.join(small_enough(places.select("_id", "_hash"), BROADCAST_ROWS), same_text, "left_semi")
    met = texts.join(places.hint("merge"), same_text)
    taken = met.select("doc_id", "text_hash", "places", computed(alnum_words(F.col("text"))).alias("words"))
    # As an array the places stay one row a text until they have been compared.
    true = F.filter("places", lambda p: F.slice("words", p["start"] + 1, F.size(p["win"])) == p["win"])
    return taken.select("doc_id", "text_hash", F.inline(true))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For every row: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    # Upper-case letters are word characters here: the number of words is the same, without changing the case.
    words = F.array_remove(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")
    rows = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.size(words), F.lit(0)).cast("long").alias("n_words")
    )
    found = occurrences(docs, benchmark, window)
    if found is None:
        found = docs.limit(0).select(
            "doc_id", F.lit(0).cast("long").alias("text_hash"), F.lit(0).alias("start"), F.array(F.lit("")).alias("win")
        )
    else:
        found = store(found.distinct(), "occurrences")
    covered = F.sequence("start", F.col("start") + F.size("win") - 1)
    hit = found.groupBy("doc_id", "text_hash").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(covered)))).cast("long").alias("n_hit")
    )
    items = item_windows(benchmark, window).where("item_id is not null").distinct()
    by_item = found.select("doc_id", "text_hash", "win").distinct().join(items, "win")
    by_item = by_item.groupBy("doc_id", "text_hash").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    same = lambda left, right: left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])
    both = hit.join(by_item, same(hit, by_item), "left").select(hit["doc_id"], hit["text_hash"], "n_hit", "items")
    out = rows.join(both, same(rows, both), "left")
    items = F.coalesce("items", F.array())
    return out.select(
        rows["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array(items)), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs."""
    found = occurrences(docs, benchmark, window)
    if found is None:
        return docs
    marked = store(found.select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash")).distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(F.col("_hit_id")) & (F.xxhash64(docs["text"]) == F.col("_hit_hash"))
    return docs.join(small_enough(marked, BROADCAST_ROWS), same, "left_anti")
