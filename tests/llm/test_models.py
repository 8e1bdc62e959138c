"""Learned operators: held-out accuracy, exactness of their parts, and defined results without training data."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsetrail.llm import language, queries, toxicity
from pulsetrail.llm.bpe import merge_table  # noqa: F401 - the vocabulary must be there
from tests.llm import brute
from tests.llm.conftest import SCHEMA

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    found = queries.QUERIES["op8_language_id"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    r = found.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert r[0] > 0.97 and r[1] > 100


def test_forward_sums_all_segmentations():
    pieces = sorted({bytes([b]) for b in range(256)} | {b"ab", b" a", b"abc", b"bc", b" ab"})
    laid = language.Pieces(pieces)
    rng = np.random.default_rng(1)
    p = rng.random((len(pieces), 2))
    words = [b"abcab", b"c", b"bc"]
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    order, flat, begin, size = language.arranged(raw, ends - [len(w) for w in words], ends)
    alpha = language.forward(laid.lay(flat), begin, size, np.vstack([p, [0, 0]]))
    for k, i in enumerate(order):
        w, total = b" " + words[i], np.zeros(2)
        for cuts in product([0, 1], repeat=len(w) - 1):
            at = [0, *(j + 1 for j, c in enumerate(cuts) if c), len(w)]
            parts = [w[a:b] for a, b in zip(at, at[1:])]
            if all(x in pieces for x in parts):
                total += np.prod([p[pieces.index(x)] for x in parts], axis=0)
        assert np.allclose(alpha[k, size[k]], total)


def test_language_of_awkward_texts(docs, rows, plain):
    import regex

    found = language.identify(docs, f"{queries.TOKENIZERS}/piece_bpe_32k.model").collect()
    assert len(found) == len(rows)
    for r in found:
        text = plain[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (text is None or not regex.search(r"\p{L}", text))
        assert 0 <= r["score"] <= 1 and r["held_out"] == brute.held(r["doc_id"], 4, 2)


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    found = queries.QUERIES["op6_toxicity"](spark, sf).join(labels, "doc_id").where("held_out")
    r = found.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false")).first()
    assert r["recall"] > 0.8 and r["false"] < 0.02


def test_non_negative_risk_learns_from_positives_alone():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    x = np.zeros((4000, 6), np.float32)
    x[:, 0] = truth & (rng.random(4000) < 0.9)
    x[:, 1:] = rng.random((4000, 5)) < 0.3
    positive = np.append(np.ones(300, bool), np.zeros(4000, bool))
    sample = np.vstack([x[truth][:300], x])
    w, b = toxicity.fit(sample, positive, 0.2)
    score = 1 / (1 + np.exp(-(x @ w + b)))
    assert (score[x[:, 0] == 1] > 0.5).all() and (score[~truth] < 0.5).mean() > 0.99


def test_toxicity_without_examples(spark, docs, rows, empty):
    none = spark.createDataFrame([(None, None, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.rate(docs, none).collect()
    assert len(found) == len(rows) and {(r["score"], r["predicted"]) for r in found} == {(0.0, 0)}
    assert toxicity.rate(empty, none).count() == 0


def test_language_without_examples(spark, empty):
    rows = [(1, "some text", None, None, 9), (2, None, None, None, None)]
    found = language.identify(spark.createDataFrame(rows, SCHEMA), f"{queries.TOKENIZERS}/piece_bpe_32k.model").collect()
    assert {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}
    assert language.identify(empty, f"{queries.TOKENIZERS}/piece_bpe_32k.model").count() == 0


@pytest.mark.parametrize("text, runs", [("", []), ("ab", ["ab"]), ("A,b é", ["a", "b", "é"])])
def test_letter_runs(text, runs):
    raw = text.encode()
    data = np.frombuffer(raw + raw, np.uint8)
    from pulsetrail.llm.common import LOWER

    data = LOWER[data]
    starts, ends, row = toxicity.letter_runs(data, np.array([0, len(raw), 2 * len(raw)]))
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == runs * 2 and row.tolist() == [0] * len(runs) + [1] * len(runs)
