from __future__ import annotations

from common import documents, odd_rows
from test_jaccard import brute_force as components
from test_native import brute_force as contamination
from test_packing import check_packing

import corpus_pipeline
from assetlake.llm.columns import store
from assetlake.llm.secrets import redact
from assetlake.llm.toxicity import THRESHOLD, learn
from assetlake.tables import table


def rows_of(df) -> list[tuple]:
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_by_brute_force(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = learn(docs, labels)
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    want = rows_of(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        assert result.schema.simpleString() == docs.schema.simpleString()
        docs = store(result, name)
        if name == "toxicity":
            want = [r for r in want if lexicon.score(r[1] or "") < THRESHOLD]
        elif name == "ngram_jaccard_join":
            found = components(want)
            want = [r for r in want if found[r[0]][1] == r[0]]
        elif name == "benchmark_decontamination":
            hit = {r[0] for r in contamination(want, items) if r[5]}
            want = [r for r in want if r[0] not in hit]
        else:
            want = [(i, redact(t)) for i, t in want]
        assert rows_of(docs) == want, name
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_packing(want, last)
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect())) == sorted(
        str(r) for r in spark.createDataFrame(last).select("doc_id", "piece", "ids_crc32").collect()
    )


def test_odd_rows_and_no_rows(spark, sf_dir):
    for rows in (odd_rows(), []):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            result = stage(spark, docs, sf_dir)
            assert result.columns == docs.columns
            docs = store(result, "stage")
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        check_packing(rows_of(docs), packed)
