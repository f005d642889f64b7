from __future__ import annotations

import fnmatch

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assetlake.functions.globs import glob_to_regex
from assetlake.operators.filters import glob_filter

NAMES = [
    "", "a", "ab", "abc", "a/b/c", "x.log", "x.log.gz", "[x]", "a]b", "a-b", "a^b", "a!b", "a\\b", "a&b", "a&&b", "line\nbreak",
    "node/i-1/stdout.gz", "node/i-2/stderr.gz", "A", "Ab", "ä", "a.b", "a+b", "$", "(a)", "{a}", "|",
]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab]x[!^-&\\.*?/1", max_size=7), min_size=1, max_size=8))
def test_globs_match_as_in_python(spark, patterns):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    flags = df.select("name", *[F.col("name").rlike(glob_to_regex(p)).alias(f"p{i}") for i, p in enumerate(patterns)])
    for row in flags.collect():
        for i, pattern in enumerate(patterns):
            assert row[f"p{i}"] == fnmatch.fnmatchcase(row["name"], pattern), (row["name"], pattern)


def test_bag_and_set(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    patterns = ["*.gz", "node/*", "nothing"]
    want = sorted(n for p in patterns for n in NAMES if fnmatch.fnmatchcase(n, p))
    assert sorted(r["name"] for r in glob_filter(df, "name", patterns).collect()) == want
    assert sorted(r["name"] for r in glob_filter(df, "name", patterns, distinct_keys=True).collect()) == sorted(set(want))
    assert glob_filter(df, "name", []).count() == len(NAMES)
