"""The shared draws: plain Python gives the same numbers, and they are even."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from docketry.functions.draws import COUNTER_STEP, KEY_STEP, PATH_STEP, PRIME, Draws, key_state
from docketry.plans import queries_records as records


def test_numbers_are_those_of_plain_python(spark):
    rows = [(5, "a"), (-3, None), (None, "é"), (2**62, "")]
    df = spark.createDataFrame(rows, "n long, s string")
    state = key_state(7, [(F.col("n"), "bigint"), (F.col("s"), "string")])
    draw = Draws(state).at(3, F.col("n") % 1 + 4).number()
    got = [tuple(r) for r in df.select(state, Draws(state).at(3, 4).number(), draw).collect()]
    for (n, s), (have, number, by_column) in zip(rows, got):
        want = 7
        for v in (n % PRIME if n is not None else PRIME - 1,
                  int(hashlib.md5(s.encode()).hexdigest()[:7], 16) if s is not None else PRIME - 1):
            want = pow((want * KEY_STEP + v + 1) % PRIME, 5, PRIME)
        counter = 0
        for step in (3, 4):
            counter = (counter * PATH_STEP + step + 1) % PRIME
        assert have == want
        assert number == pow((want + counter * COUNTER_STEP) % PRIME, 5, PRIME)
        assert by_column == (number if n is not None else None)


def test_even_over_rows_and_paths(spark):
    state = key_state(1, [(F.col("id"), "bigint")])
    draws = Draws(state)
    rows = spark.range(4000).select(
        draws.at(1, 2).below(10).alias("a"), draws.at(1, 3).below(10).alias("b"), draws.at(2, 2).uniform().alias("u")
    ).collect()
    for values in (Counter(r.a for r in rows), Counter(r.b for r in rows), Counter(int(r.u * 10) for r in rows)):
        assert sum((n - 400) ** 2 / 400 for n in values.values()) < 30 and len(values) == 10
    pairs = Counter((r.a, r.b) for r in rows)
    assert sum((pairs[i, j] - 40) ** 2 / 40 for i in range(10) for j in range(10)) < 150
    along = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(9999)), lambda i: draws.at(i).below(10)))
    counts = Counter(along.first()[0])
    assert sum((n - 1000) ** 2 / 1000 for n in counts.values()) < 30


def test_each_noise_query_changes_texts(spark, sf_dir):
    """What is compared with the SQL is no copy of the input."""
    plain = {(r.conv_id, r.turn): r.text for r in records.augment_identity(spark, sf_dir).collect()}
    for name, (query, _) in records.QUERIES.items():
        if name.startswith("augment_") and name != "augment_identity":
            rows = query(spark, sf_dir).collect()
            changed = sum(plain[r.conv_id, r.turn] != r.text for r in rows)
            assert changed > len(rows) / 4, name
