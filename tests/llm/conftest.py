import random

import pytest
from pyspark.sql import functions as F

#: names that the operators use inside; extra columns of an input may have them too
CLASHING = ("start", "length", "anchor", "content", "key", "score", "held_out", "bits", "piece", "kept", "ranges", "n", "row", "rank")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(rng: random.Random, words: int, pool: list[str]) -> str:
    return " ".join(rng.choice(pool) for _ in range(words))


def awkward() -> list[tuple]:
    """Nulls, empty and odd texts, repeats of every kind, a long text, and repeated rows."""
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(400)] + ["Émile", "naïve", "日本", "🙂", "it's", "A"]
    passage, other = sentences(rng, 70, pool), sentences(rng, 90, pool)
    texts = [None, "", " \t\n", "one", "\x1c \x85 x", "a" * 450, "ab" * 700, "x y " * 200, passage, passage, passage + " end", "begin " + passage,
             other + "\n" + passage + "\n" + other, passage.upper(), other, other[:-3] + "zzz", "<|endoftext|> <|ENDOFTEXT|>", "ΣΑΣ ẛ̣ İx",
             "#$% | <a> & *b*", "line\nline\n\nline\n", "\n".join(["same words on this line again"] * 6), "é" * 120 + "è" * 120, "é" * 120 + "è" * 119 + "ê"]
    texts += [sentences(rng, rng.randint(1, 160), pool) for _ in range(60)]
    texts.append(sentences(rng, 6000, pool) + " " + passage + " " + sentences(rng, 2000, pool))
    rows = [(i * 3 + 1, t, ("en", "de", None)[i % 3], ("s0", None, "s1")[i // 2 % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[8], rows[8], rows[0]]


def framed(spark, rows, parts: int = 4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    for i, c in enumerate(CLASHING):
        df = df.withColumn(c, F.lit(i) if i % 2 else F.lit(None).cast("string"))
    return df


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return framed(spark, rows).cache()


@pytest.fixture(scope="session")
def plain(rows):
    return {r[0]: r[1] for r in rows}


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
