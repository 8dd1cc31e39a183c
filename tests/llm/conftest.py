"""A small corpus with every awkward case, with extra columns whose names clash."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, kept int, node string, base string, n_words int, salt string"


def sentence(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    other = ["".join(rng.choice("qrstuvwxyzäöü") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    out = []
    add = lambda i, t, lang="en", source="s0": out.append((i, t, lang, source))
    for i in range(40):
        add(i, sentence(rng, rng.randint(12, 80), vocabulary if i % 3 else other) + ".\n" + sentence(rng, 9, vocabulary), "en" if i % 3 else "de", f"s{i % 4}")
    base = sentence(rng, 200, vocabulary).split()
    for i in range(40, 60):  # near copies
        near = list(base)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        add(i, " ".join(near), "en", "s0")
    for i in range(60, 70):  # exact copies
        add(i, out[1][1], "en", "s0")
    add(70, None, None, None)
    add(71, "", "en", "s1")
    add(72, " \n\t ", "en", None)
    add(73, "one two", "en", "s1")
    add(74, "ONE Two", "en", "s1")
    add(75, "a b c d e", "en", "s1")
    add(76, sentence(rng, 9000, vocabulary), "en", "s2")  # long: several packed pieces
    add(77, "same line here\n" * 30, "en", "s3")
    add(78, "x" * 3000, "en", "s3")
    add(79, "Mail bob.42@mail.example.com or +1 (918) 555-4124, host 10.0.0.255, card 4111 1111 1111 1111.", "en", "s1")
    add(80, "é日本語 ### *** $$$ 😀😀 &&& |||", None, "s1")
    add(None, sentence(rng, 30, vocabulary), "en", "s0")
    add(None, None, None, None)
    add(5, out[5][1], "de", "s1")  # a repeated id with the same text
    out.append(out[6])  # a repeated row
    return [(*r, len(r[1] or ""), "row", 1, "node", "base", 5, "salt") for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
