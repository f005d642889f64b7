"""What the plans must look like: pushed filters, pruned columns, partial work before shuffles."""

from __future__ import annotations

import pytest

from assetlake import queries as registry

registry.load()
QUERIES = registry.QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plan(spark, sf_dir):
    return lambda name: plan_of(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["upsert_latest", "as_of", "as_of_tomb", "first_of_type", "rel_topk_group", "object_events", "table_diff"])
def test_ranks_are_limited_before_the_shuffle(plan, name):
    text = plan(name)
    assert "WindowGroupLimit" in text and "Partial" in text


def test_listing_is_a_top_k(plan):
    assert "TakeOrderedAndProject" in plan("object_list") and "TakeOrderedAndProject" in plan("rel_topk")


@pytest.mark.parametrize("name, text", [
    ("as_of", "LessThanOrEqual(ts"), ("object_list", "StringStartsWith(url,https://)"), ("status_filter", "In(event_type"),
    ("pending_messages", "LessThanOrEqual(ts"), ("delete_where", "PushedFilters: ["),
])
def test_filters_reach_the_scan(plan, name, text):
    assert text in plan(name)


@pytest.mark.parametrize("name, column", [
    ("uri_host", "html"), ("object_list_all", "html"), ("json_typed", "value"), ("rel_agg", "l_tax"), ("fifo_order", "props"),
    ("slot_agg", "props"), ("rel_semi_anti", "l_tax"), ("impact", "c_name"),
])
def test_unused_columns_are_not_read(plan, name, column):
    assert f"{column}:" not in plan(name)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith(("rel_", "object_d", "object_g", "table", "branch_merge", "glob_"))))
def test_no_cross_joins(plan, name):
    text = plan(name)
    assert "CartesianProduct" not in text
    if name != "rel_range_join":  # three bands by definition
        assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n != "asset_pandas"))
def test_no_python_in_the_plans(plan, name):
    text = plan(name)
    assert not any(word in text for word in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups"))


@pytest.mark.parametrize("name", ["uri_host", "glob_filter_distinct", "object_list_all", "status_filter", "message_encode", "split_lines", "json_typed", "decode_utf8"])
def test_row_work_needs_no_shuffle(plan, name):
    assert "Exchange" not in plan(name)


def test_three_way_merge_shuffles_each_version_once(spark, plan):
    from assetlake.operators.versions import branch_merge

    sides = [spark.range(10).selectExpr("id as k", f"id * {i} as v") for i in (1, 2, 3)]
    text = plan_of(branch_merge(*sides, "k"))
    assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in text


def test_files_that_do_not_match_are_not_opened(spark, sf_dir):
    from assetlake.queries.objects import log_texts

    found = log_texts(spark, sf_dir)
    found.collect()
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = scan.metrics().apply("numFiles").value()
    languages = {r["lang"] for r in found.select("lang").distinct().collect()}
    assert languages == {"de", "fr"} and 0 < read <= 8 * len(languages)


def test_bucketed_join_has_no_exchange(plan):
    assert plan("rel_bucket_join").count("Exchange") == 0


def test_interval_join_has_no_nested_loop(plan):
    text = plan("rel_interval_join")
    assert "NestedLoop" not in text and "Cartesian" not in text
