import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at string, line string, n string, label string, token string"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}x{rng.randrange(7)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text) with copies, near copies, shared passages, nulls, empty and very long texts."""
    rng = random.Random(5)
    base = words(rng, 120)
    passage = " ".join(words(rng, 40))
    rows = []
    for i in range(30):
        lines = [" ".join(words(rng, rng.randrange(3, 25))) for _ in range(rng.randrange(2, 7))]
        if i % 4 == 0:
            lines.insert(1, passage)
        rows.append((i, "\n".join(lines)))
    for i in range(30, 40):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(1000)
        rows.append((i, " ".join(w)))
    rows += [(40, rows[3][1]), (41, rows[3][1]), (42, None), (43, ""), (44, " \n\t"), (45, "one"), (46, "one two"), (47, "One TWO"), (48, "é" * 150 + " ünï " * 60)]
    rows += [(49, " ".join(words(rng, 30_000, 5000))), (50, "a b c d e f g h i j\na b c d e f g h i k\na b c d e f g h i"), (51, rows[5][1])]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en" if d is None or d % 3 else "de", f"s{(d or 0) % 4}", len(t or ""), "x", "x", "x", "x", "x") for d, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return frame(spark, corpus).cache()


@pytest.fixture(scope="session")
def odd(spark, corpus):
    """The corpus with repeated rows and null ids."""
    return frame(spark, [*corpus, corpus[0], corpus[0], (None, corpus[1][1]), (None, None)])


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [(1, "x")]).where("doc_id < 0")


@pytest.fixture(scope="session")
def labels(spark, corpus):
    return spark.createDataFrame([(d, 1 if d % 5 else 0, 1 if d % 7 == 0 else 0) for d, _ in corpus] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
