"""Empty tables, null ids and the pipeline, stage by stage."""

import json
import os
import random

import pytest

import corpus_pipeline as P
from pulsetrail.llm import neighbours, packing, quality, queries, simhash, suffix_dedup, suffix_tree, substring_dedup, tokens
from tests.llm import brute
from tests.llm.conftest import SCHEMA

OPERATORS = {
    "pack": lambda d: packing.pack(d, queries.WORD_BPE), "judge": quality.judge, "copies": suffix_dedup.remove_copies,
    "passages": substring_dedup.remove_passages, "score": suffix_tree.score, "near": simhash.near_duplicates,
    "bpe": lambda d: tokens.round_trip(d, queries.WORD_BPE),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids_come_back_null(spark, name):
    rows = [(None, "a text of some words " * 12, None, None, None), (7, "another text", "en", "s", 12), (None, None, None, None, None)]
    got = [r["doc_id"] for r in OPERATORS[name](spark.createDataFrame(rows[:2], SCHEMA)).collect()]
    assert sorted(got, key=str) == [7, None]
    assert OPERATORS[name](spark.createDataFrame(rows[2:], SCHEMA)).first()["doc_id"] is None


def test_no_vectors(spark):
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0]), (20, None)], "vec_id long, embedding array<double>")
    assert neighbours.nearest(one).count() == 0


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Each stage over what the one before wrote."""
    sf, out = "/root/testdata/sf0.01", tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {"input": docs}
    for name, stage in P.STAGES:
        stage(spark, docs, sf).write.parquet(str(out / name))
        docs = found[name] = spark.read.parquet(str(out / name))
    return found


def test_stages_keep_the_columns(staged):
    for name, df in staged.items():
        if name != P.STAGES[-1][0]:
            assert df.columns == staged["input"].columns


def test_toxic_documents_go(spark, staged):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    left = staged["toxicity"].join(labels, "doc_id")
    before = staged["input"].join(labels, "doc_id")
    assert left.where("toxic = 1").count() < 0.4 * before.where("toxic = 1").count()
    assert left.where("toxic = 0").count() > 0.95 * before.where("toxic = 0").count()


def test_quality_stage_takes_its_verdicts(staged):
    verdicts = quality.judge(staged["toxicity"])
    assert {r[0] for r in verdicts.where("kept").select("doc_id").collect()} == {r[0] for r in staged["quality_rules"].select("doc_id").collect()}


def test_one_document_of_each_group_stays(staged):
    texts = {r["doc_id"]: r["text"] for r in staged["quality_rules"].collect()}
    want = set(brute.groups({d: brute.fingerprint(t) for d, t in texts.items()}).values())
    assert {r["doc_id"] for r in staged["simhash_near_dedup"].collect()} == want


def test_copies_are_cut(staged):
    rows = [(r["doc_id"], r["text"]) for r in staged["simhash_near_dedup"].collect()]
    want = brute.cut_bytes(rows)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in staged["suffix_array_dedup"].collect()}
    assert set(got) == {d for d, (n, gone, _, _) in want.items() if not gone or gone < n}
    for d, (n, gone, _, digest) in want.items():
        if d in got and not gone:
            assert brute.sha(got[d][0].encode()) == digest
        if d in got:
            assert got[d][1] == len(got[d][0])


def test_all_that_is_left_is_packed(spark, staged):
    packed = {r["doc_id"] for r in staged["best_fit_packing"].select("doc_id").distinct().collect()}
    assert packed == {r["doc_id"] for r in staged["suffix_array_dedup"].collect()}


def test_run_gives_the_last_stage(spark, staged):
    got = P.run(spark, "/root/testdata/sf0.01").select("doc_id", "piece", "length", "ids_crc32")
    want = staged["best_fit_packing"].select("doc_id", "piece", "length", "ids_crc32")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stages_take_empty_and_null_documents(spark, empty):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words of a text " * 6, None, None, 5)]
    for docs in (empty, spark.createDataFrame(rows, SCHEMA)):
        for _, stage in P.STAGES:
            assert stage(spark, docs, "/root/testdata/sf0.001").count() <= 3


def test_vocabulary_is_a_parameter():
    assert os.path.exists(queries.WORD_BPE) and json.load(open(queries.WORD_BPE))["model"]["type"] == "BPE"


def unnamed(seed: int, words: int = 130) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in range(words))


def test_texts_of_null_ids_link_nothing(spark):
    a, b = unnamed(1), unnamed(2)
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in ((None, a), (None, b), (5, a), (6, b), (7, unnamed(3)), (8, a), (8, unnamed(3)))], SCHEMA)
    inside = {}
    for r in simhash.grouped(df).collect():
        inside.setdefault(r["component"], set()).add((r["doc_id"], r["bits"]))
    assert sorted(len({bits for _, bits in x}) for x in inside.values()) == [1, 1, 1]
    left = sorted((str(r["doc_id"]), r["text"]) for r in P.simhash_near_dedup(spark, df, "").collect())
    assert left == sorted([("None", a), ("None", b), ("7", unnamed(3))])
    got = {(r["doc_id"], r["bits"]): r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert all(c == (7 if bits % 2**64 == brute.fingerprint(unnamed(3)) else None) for (_, bits), c in got.items())


def test_texts_of_null_ids_are_cut_alone(spark):
    a, b, c = unnamed(1), unnamed(2), unnamed(4)
    twice = a + " " + a
    df = spark.createDataFrame([(None, t, None, None, None) for t in (twice, b, b, c)], SCHEMA)
    kept = {bytes(r["kept"]) for r in suffix_dedup.remove_copies(df).collect()}
    assert b.encode() in kept and c.encode() in kept  # the copy inside the first text cuts nothing of the others
    # copies at equal starts in different texts of null ids: just one keeps them
    df = spark.createDataFrame([(None, a + t, None, None, None) for t in (" first", " second", " third")], SCHEMA)
    assert sorted(bool(r["n_removed"]) for r in suffix_dedup.remove_copies(df).collect()) == [False, True, True]
    assert sorted(r["n_removed"] > 0 for r in substring_dedup.remove_passages(df).collect()) == [False, True, True]


def test_texts_of_one_id_are_cut_alone(spark):
    a, b = unnamed(1), unnamed(2)
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in ((1, a), (2, a), (2, b))], SCHEMA)
    for found in (suffix_dedup.remove_copies(df), substring_dedup.remove_passages(df)):
        assert sorted((r["doc_id"], bool(r["n_removed"])) for r in found.collect()) == [(1, False), (2, False), (2, True)]
