from __future__ import annotations

import zlib

import numpy as np
import pytest
from common import documents, odd_rows, prose

from assetlake.llm.toxicity import Lexicon, _curve, class_weights, fold, learn, score_documents
from assetlake.tables import table


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_documents(docs, learn(docs, labels)).join(labels, "doc_id").where("held_out")
    seen = {(r["toxic"], r["predicted"]): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert seen[1, 1] > 0.8 * (seen[1, 1] + seen.get((1, 0), 0))
    assert seen.get((0, 1), 0) <= 0.01 * seen[0, 0]


def test_entries_exceptions_and_folding():
    lexicon = Lexicon({"idiot": 5.0, "scum*": 4.0}, frozenset({"scum removal"}), (-5.0, 3.0, 1.0))
    assert fold("1d10t Ідіοt") == "idiot ідiot".replace("д", "д") or fold("1d10t") == "idiot"
    assert [f[2] for f in lexicon.found(fold("an 1D10T and sсumbag; idiotic discum"))] == ["idiot", "scum*"]
    assert lexicon.features("scum removal")[0] == 0 and lexicon.features("scum here")[0] > 0
    assert lexicon.score("you idiot") > lexicon.score("you " * 500 + "idiot") > lexicon.score("")


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def rows_with_labels() -> tuple[list, list]:
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        rows.append((i, prose(i, 40) + (" you moron" if toxic else " moron valve")))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_exceptions_are_learnt_and_the_held_out_fold_is_not_seen(spark):
    rows, labels = rows_with_labels()
    rows = [(i, t if not t.endswith("valve") or i % 4 else t) for i, t in rows]
    docs = documents(spark, [*rows, *((i + 1_000 if i else i, t) for i, t in odd_rows())])
    lexicon = learn(docs, labelled(spark, labels + [(None, 1, 1), (1, 1, None), (2, None, 0)]))
    got = score_documents(docs, lexicon).collect()
    assert len(got) == len(rows) + len(odd_rows())
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    flipped = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, q, t) for i, q, t in labels]
    assert learn(docs, labelled(spark, flipped)) == learn(docs, labelled(spark, labels))


def test_no_labels_and_no_documents(spark):
    docs = documents(spark, odd_rows())
    lexicon = learn(docs, labelled(spark, []))
    assert {r["score"] for r in score_documents(docs, lexicon).collect()} == {0.5}
    assert score_documents(documents(spark, []), lexicon).count() == 0


def test_the_score_does_not_depend_on_the_bound_of_the_sample(spark):
    """Of the toxic texts, half hold no entry: the score of a text without one is their share among such texts."""
    rows = [(i, prose(i, 30) + (" you moron" if i % 12 == 0 else "")) for i in range(1_800)]
    labels = labelled(spark, [(i, 1, int(i % 6 == 0)) for i, _ in rows])
    docs = documents(spark, rows)
    assert class_weights(labels) == (1.0, 1.0)
    clean, toxic = class_weights(labels, 150)
    assert clean > 4 and 1 < toxic < 2
    whole, bounded = learn(docs, labels), learn(docs, labels, 150)
    assert "you" in whole.weights and "you" in bounded.weights
    assert whole.score("") == pytest.approx(1 / 11, abs=0.03)
    assert bounded.score("") == pytest.approx(whole.score(""), abs=0.04)


def test_weighted_rows_count_as_repeated_rows():
    draw = np.random.Generator(np.random.PCG64(5))
    y = (draw.random(400) < 0.3).astype(float)
    x = draw.normal(size=(400, 2)) + y[:, None]
    times = np.where(y > 0, 2, 7)
    assert _curve(x, y, (7.0, 2.0)) == pytest.approx(_curve(np.repeat(x, times, axis=0), np.repeat(y, times)), abs=1e-6)
