import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in alpha beta gamma delta über façade señor niño clown 42 x1".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, odd white space, nulls, empty and long texts."""
    rng = random.Random(3)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(60)]
    base = words(rng, 90)
    texts += [base] * 6
    for k in range(14):
        near = base.split()
        near[rng.randrange(len(near))] = f"edit{k}"
        texts.append(" ".join(near))
    texts += ["", None, " \n\t ", "one", "One", "two words", "a\x1cb\x85c\xa0d", "<|endoftext|> inside <|endoftext|>", words(rng, 4000), "x" * 5000]
    return [(i, t, rng.choice(["en", "de", None]), None, None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with more columns, named like the operators' own."""
    from pyspark.sql import functions as F

    names = "rep component bucket ghost sig next shard slot atom piece rank size score hit items n_words n_shingles fold row base".split()
    return docs.withColumns({n: F.lit("z") for n in names})
