"""The best category: counted in compiled expressions, equal to plain Python."""

import random

from pyspark.sql import functions as F

from docketry.operators.categorize import categorize

RULES = {
    "None": [], "First": ["tea", "Cof", "o'b", "a\\b", "Flat White"], "Second": ["tea", "milk", "ink"],
    "Long": [f"w{i}" for i in range(40)], "Twice": ["pen", "pen"],
}


def best(text):
    found = [(len(hits), -i, c, hits) for i, (c, words) in enumerate(RULES.items())
             for hits in [[w for w in words if w.lower() in text.lower()]]]
    n, _, category, hits = max(found, key=lambda x: x[:2])
    return (category, hits) if n else ("Unclassified", [])


def test_best_category_brute_force(spark):
    rng = random.Random(4)
    words = ["TEA", "coffee", "milk", "O'Brien", "a\\b", "flat", "white", "w1", "w22", "w39", "pen", "pink", "é", ""]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, clean_text string").select(
        "*", F.lit(None).cast("string").alias("vendor"), F.lit(None).cast("array<struct<name:string>>").alias("items")
    )
    out = categorize(rows, RULES)
    got = [(r.category, r.matched_keywords) for r in out.orderBy("i").collect()]
    assert got == [best(t) for t in texts]
    # a lambda would have all keywords interpreted
    assert "array_max(transform" not in out._jdf.queryExecution().optimizedPlan().toString()
