"""Benchmark items that are repeated, long or short."""

import random

import pytest

from docketry.llm.decontaminate import contaminated


def vocabulary(letters, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=7)) for _ in range(size)]


def found(spark, docs, items):
    docs = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    items = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}


@pytest.mark.parametrize("size, copies", [(400, 4), (10, 2), (60, 60)])
def test_repeated_item(spark, size, copies):
    rng = random.Random(size)
    plain, fresh = vocabulary("abcdefgh", 300, 1), vocabulary("klmnopqr", 90, 2)
    items = {n: rng.sample(fresh, 30) for n in range(3)}
    docs = {n: rng.choices(plain, k=150) for n in range(size)}
    for n in range(copies):
        docs[n][70:70] = items[0]
    changed = [w if n % 6 else "other" for n, w in enumerate(items[0])]
    docs[size] = rng.choices(plain, k=40) + changed + rng.choices(plain, k=40)
    got = found(spark, {n: " ".join(w) for n, w in docs.items()}, {n: " ".join(w) for n, w in items.items()})
    assert got == {(n, 0) for n in [*range(copies), size]}


def test_long_items(spark):
    rng = random.Random(7)
    plain, fresh = vocabulary("abcdefgh", 300, 1), vocabulary("klmnopqr", 2000, 2)
    items = {n: rng.sample(fresh, size) for n, size in enumerate([40, 124, 160, 223, 400])}
    docs = {n: rng.choices(plain, k=500) + w + rng.choices(plain, k=500) for n, w in items.items()}
    for n, words in items.items():
        changed = [w if k % 6 else "other" for k, w in enumerate(words)]
        docs[10 + n] = changed + rng.choices(plain, k=30)
        docs[20 + n] = words[: len(words) // 4] + rng.choices(plain, k=90)  # too little of it
    got = found(spark, {n: " ".join(w) for n, w in docs.items()}, {n: " ".join(w) for n, w in items.items()})
    assert got == {(n + more, n) for n in items for more in (0, 10)}


@pytest.mark.parametrize("others", [{}, {9: "a longer item of nine words stands here too"}])
def test_short_items(spark, others):
    items = {1: "Paris", 2: "the red fox", 3: "one two three four five six seven", 4: "", 5: "The red fox."}
    docs = {
        1: "he saw the red, fox run", 2: "the red", 3: "fox the red", 4: "in PARIS.", 5: None,
        6: "zero one two three four five six seven eight", 7: "one two three four six five seven",
    }
    assert found(spark, docs, items | others) == {(1, 2), (1, 5), (4, 1), (6, 3)}
