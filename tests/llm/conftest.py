import random

import pytest

COLUMNS = "doc_id long, text string, lang string, score double, slot string, `kept.x` int"


@pytest.fixture(scope="session")
def texts():
    """Id -> text: NULL, empty, blank, one word, copies, near copies, a very long text."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]

    def words(n):
        return rng.choices(vocabulary, k=n)

    base = words(120)
    rows = {1: None, 2: "", 3: " \t\n ", 4: "one", 5: "one", 6: " ".join(base), 7: " ".join(base)}
    for n in range(8, 20):
        near = list(base)
        near[n * 4] = f"changed{n}"
        rows[n] = " ".join(near)
    passage = words(40)
    for n in range(20, 40):
        rows[n] = " ".join(words(rng.randint(3, 90)) + passage * (n % 3 == 0) + words(rng.randint(0, 30)))
    rows[40] = " ".join(words(20_000))
    rows[41] = "x" * 50_000
    rows[42] = "Ünïcode 漢字 🙂 mixed É\u00a0text. " * 9
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with one row repeated, one id missing and clashing column names."""
    rows = [(k, v, "en", 0.5, "s", 1) for k, v in texts.items()]
    rows += [rows[5], (None, "no id here but a text of some words all the same", None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
