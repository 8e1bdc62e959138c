"""Phrases, spelling variants and quality votes against their plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsetrail.llm import double_array, phrases, queries, spelling, votes
from pulsetrail.llm.common import whole_groups
from tests.llm import brute
from tests.llm.conftest import SCHEMA, framed

SF = "/root/testdata/sf0.01"


# --- 11: phrases -------------------------------------------------------------------
def test_double_array_finds_its_sequences_alone():
    rng = np.random.default_rng(1)
    rows = np.unique(np.column_stack([rng.integers(0, 3, 3000), rng.integers(0, 40, 3000), rng.integers(-1, 9000, 3000), rng.integers(-1, 300, 3000)]), axis=0)
    rows[rows[:, 2] < 0, 3] = -1
    rows = np.unique(rows, axis=0)
    trie = double_array.build(3, rows[:, 0], rows[:, 1:])

    def find(root, symbols):
        state = np.array([root], np.int32)
        for s in symbols:
            for d in double_array.digits(np.array([s])):
                ok, state = trie.step(state, d)
                if not ok[0]:
                    return None
        return int(trie.entry[state[0]])

    known = {(r[0], *(x for x in r[1:] if x >= 0)): k for k, r in enumerate(rows.tolist())}
    for key, k in known.items():
        assert find(key[0], key[1:]) == k
    for _ in range(2000):
        key = (int(rng.integers(0, 3)), int(rng.integers(0, 50)), int(rng.integers(0, 9000)))
        assert find(key[0], key[1:]) in ((known[key],) if key in known else (None, -1))


def repetitive(rows):
    rng = random.Random(5)
    pool = ["of", "the", "New", "York", "city", "état", "x", "Thé", "1.5", "it's"]
    more = [(900 + i, rng.choice([" ", "\t", "  "]).join(rng.choice(pool) + rng.choice(["", "", "", ",", "!", "\n"]) for _ in range(rng.randint(0, 300))), rng.choice(["en", "und", None]), "s", 0) for i in range(30)]
    return rows + more + more[:3]


@pytest.mark.parametrize("bounds", [{}, {"trie": 40, "filter_bits": 1 << 10}, {"reported": 7}, {"least": 3, "inside": 80}])
def test_collocations(spark, rows, bounds):
    rows = repetitive(rows)
    found = phrases.collocations(framed(spark, rows), **bounds).collect()
    want = brute.collocations([(r[2], r[1]) for r in rows], **{k: v for k, v in bounds.items() if k not in ("trie", "filter_bits")})
    assert len(want) > 8 and len(found) == len(want) and {tuple(r) for r in found} == want


def test_numbers_beyond_64_bits(spark):
    one = 3_000_000_000_000
    rows = [("en", "a", None, None, one), ("en", "b", None, None, one + 7), ("en", "a", "b", None, one - 1)]
    r = phrases.scored(spark.createDataFrame(rows, "lang string, a string, b string, c string, f long"), 10, 50).first()
    assert r["score"] == 10**6 * (one - 1) ** 2 // (one * (one + 7))


def test_unlike_words_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(phrases.Words, "hashes", lambda self: np.zeros(len(self.code), np.uint64))  # all share one hash
    rows = [(None, "a b c. d e"), ("en", "a b x")] * 6 + [("en", "q w")]
    words = [(lang, text, None, None, None) for lang, text in rows]
    df = spark.createDataFrame([(1, t, lang, None, 0) for lang, t, *_ in words], SCHEMA)
    assert {tuple(r) for r in phrases.collocations(df, least=4).collect()} == brute.collocations(rows, least=4)


def test_text_is_run_over_a_fixed_number_of_times(spark, rows):
    """However many tries the candidates fill."""
    read, n = spark.sparkContext.accumulator(0), 0
    rows = repetitive(rows)

    def watched(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = framed(spark, rows).coalesce(1)
    n = docs.count()
    phrases.collocations(docs.mapInArrow(watched, docs.schema), trie=40).count()
    assert read.value <= 5 * n  # their size, three filters, the candidates


# --- 12: spelling ------------------------------------------------------------------
def misspelled(rows):
    rng = random.Random(9)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 10))) for _ in range(60)] + ["x" * 300, "straße", "Ångström", "naïvetés", "aaaaaaa", "×÷×÷×÷×÷"]
    texts = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: 6 + i % 60])
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "b", "é", w[k] * 2]) + w[k + 1:]
            words.append(w if rng.random() < 0.8 else w.upper())
        texts.append((2000 + i if i % 9 else None, rng.choice([" ", "-", "1", "\n"]).join(words), None, None, 0))
    texts += [(3000 + i, "chainword " * 100 + "chainwort " * 5 + ("chaimwort" if i < 2 else ""), None, None, 0) for i in range(4)]
    return rows + texts


@pytest.mark.parametrize("crowd", [16_384, 12])
def test_variants(spark, rows, crowd):
    rows = misspelled(rows)
    found = {r["word"]: tuple(r)[1:] for r in spelling.variants(framed(spark, rows), crowd=crowd).collect()}
    want = brute.variants([(r[0], r[1]) for r in rows])
    assert sum(w[0] is not None for w in want.values()) > 30 and want["chaimwort"][:2] == ("chainwort", "chainword")
    assert found == want


def test_each_near_pair_is_found_in_one_block(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(7, 10))) for _ in range(400)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    for crowd in (10_000, 9):
        found = spelling.compared(spelling.blocks(df, crowd)).groupBy("word").agg(F.sum("n_near").alias("n")).collect()
        assert {r["word"]: r["n"] for r in found} == {w: k for w in words if (k := sum(brute.edits(w, v) == 1 for v in words))}


def test_crc_of_runs():
    import zlib

    texts = ["abcdefg", "éÿabcdÀ", "z" * 80]
    points = np.frombuffer("".join(texts).encode("latin-1"), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begun = np.array([zlib.crc32(b"%d:" % i) for i in range(3)], np.uint32)
    got = spelling.crc32(points, ends - [len(t) for t in texts], ends, begun)
    assert got.tolist() == [zlib.crc32(f"{i}:{t}".encode()) for i, t in enumerate(texts)]


# --- 13: votes ---------------------------------------------------------------------
def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality is not null")
    found = queries.QUERIES["op13_quality_votes"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out")
    r = found.agg(F.avg(F.when(F.col("quality") == 1, F.col("predicted"))).alias("kept"), F.avg(F.when(F.col("quality") == 0, 1 - F.col("predicted"))).alias("caught")).first()
    assert r["kept"] > 0.99 and r["caught"] > 0.9


def test_votes_are_those_of_all_cosines():
    rng = np.random.default_rng(3)
    pool = ["alpha", "Beta", "gamma%", "12", "delta", "x|y"]
    texts = [" ".join(rng.choice(pool, rng.integers(0, 30))) for _ in range(70)]
    raw = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    data = np.frombuffer(raw, np.uint8)
    row, h, share = votes.terms(data, offsets)
    keys = np.unique(h)
    model = votes.Voters(keys, rng.random(len(keys)) + 0.5, np.linalg.qr(rng.normal(size=(len(keys), 5)))[0].astype(np.float32), None, (rng.random(70) < 0.6).astype(float), 0.6, 9)
    model.vectors = model.place(model.bags(70, row, h, share))
    got = model.score(data, offsets)
    for i in range(70):
        near = model.vectors @ model.vectors[i]
        if not near.any():
            assert got[i] == 0.6
            continue
        last = np.sort(near)[-9] - 1e-6
        w = np.where(near >= last, np.maximum(near, 0), 0)
        assert abs(got[i] - w @ model.labels / w.sum()) < 1e-3


def test_terms_of_a_document():
    text = "Ab ab, 12 <b> ab, Ab"
    row, h, share = votes.terms(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert len(np.unique(h)) == len(h) and set(row.tolist()) == {0}
    # words ab (2), "ab,", 12, <b>; shapes Aa (2), "a,", 0, <a>; five pairs; none repeats
    assert sorted(np.round(share * 6).astype(int).tolist()) == sorted([2, 2, 1, 1, 2, 2, 1, 1, 1, 1, 1, 1, 1, 5])


def test_votes_without_labels(spark, docs, rows, empty):
    none = spark.createDataFrame([(None, 1, 1), (1, None, 1), (4, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    found = votes.vote(docs, none).collect()
    assert len(found) == len(rows) and {(r["score"], r["predicted"]) for r in found} == {(0.0, 0)}
    assert votes.vote(empty, none).count() == 0
    same = spark.createDataFrame([(i * 3 + 1, int(i % 4 > 0), 0) for i in range(60)] * 2, "doc_id long, quality int, toxic int")
    found = votes.vote(docs, same).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == brute.held(r["doc_id"], 5, 0) for r in found)
    assert len({r["score"] for r in found if not (r["doc_id"] - 1) // 3}) == 1


# --- all ---------------------------------------------------------------------------
@pytest.mark.parametrize("operator", [phrases.collocations, spelling.variants])
def test_nothing_in_nothing_out(spark, empty, operator):
    assert operator(empty).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0)], SCHEMA)
    assert operator(nulls).count() == 0


def test_null_ids_of_votes(spark):
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(None, "some words", None, None, 0), (7, "some words here", "en", "s", 0), (None, None, None, None, None), (8, "## %%", None, None, 0)], SCHEMA)
    assert sorted((r["doc_id"] for r in votes.vote(df, labels).collect()), key=str) == [7, 8, None, None]


def test_no_group_is_cut():
    rng = random.Random(4)
    keys = sorted(rng.choices(range(40), k=600)) + [99] * 500
    table = pa.table({"k": keys, "s": [str(k // 3) for k in keys], "v": range(len(keys))})
    for size in (1, 7, 64, 2000):
        got = list(whole_groups(iter(table.to_batches(max_chunksize=size)), ["k", "s"], 50))
        assert pa.concat_tables(got).equals(table)
        ends = [set(t.column("k").to_pylist()) for t in got]
        assert all(not a & b for a, b in zip(ends, ends[1:]))


def test_a_task_of_many_words_merges_none_again():
    import itertools

    from pulsetrail.llm import bpe
    from pulsetrail.llm.queries import WORD_BPE
    words = ["".join(w).encode() for w in itertools.islice(itertools.product("etaoinsr", repeat=6), 200_000)]
    e = bpe.Encoder(bpe.merge_table(WORD_BPE), limit=bpe.MEMORY)
    assert bpe.encoder(WORD_BPE).limit == bpe.MEMORY
    for lo in range(0, len(words), 10_000):
        e.learn([words[lo:lo + 10_000]])
    assert e.new_chunks([words[:10_000]], e.known) == []


def test_ranks_of_all_pairs():
    import json

    from pulsetrail.llm import bpe
    from pulsetrail.llm.queries import WORD_BPE
    table = bpe.merge_table(WORD_BPE)
    with open(WORD_BPE, encoding="utf-8") as f:
        model = json.load(f)["model"]
    left, right = (np.array([model["vocab"][p[i]] for p in model["merges"]]) for i in (0, 1))
    assert (table.ranks(left, right) == np.arange(len(left))).all()
    pairs, unlike = set(zip(left.tolist(), right.tolist())), np.random.default_rng(1).integers(0, len(model["vocab"]), (2, 100_000))
    new = np.array([p not in pairs for p in zip(*unlike.tolist())])
    assert (table.ranks(*unlike)[new] == table.none).all()
