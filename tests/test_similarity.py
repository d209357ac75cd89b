"""Ratios that the plan decides are those of the matcher."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from docketry.functions import scores


def test_known_ratios(spark):
    rng = random.Random(6)
    rows = [("", "a"), ("  ", "b"), ("ab", " "), ("abc", "xyz"), ("a" * 300, "a" * 250), ("b" * 10 + "a" * 250, "a" * 250)]
    for _ in range(300):
        core = "".join(rng.choices("abcd ", k=rng.randint(1, 12)))
        pads = ["".join(rng.choices("abcdxyz ", k=rng.randint(0, 6))) for _ in "ab"]
        rows.append(rng.sample([core, pads[0] + core + pads[1]], 2))
        rows.append(("".join(rng.choices("abc", k=5)), "".join(rng.choices("cxyz", k=7))))
        rows.append((pads[0] * 50 + core, core * rng.randint(1, 60)))
    df = spark.createDataFrame([(i, p, e) for i, (p, e) in enumerate(rows)], "i int, p string, e string")
    got = df.select("i", scores.text_score(F.col("p"), F.col("e")).alias("s")).collect()
    for i, s in got:
        p, e = rows[i]
        want = float(not p and not e) if not p or not e else SequenceMatcher(None, p.lower().strip(), e.lower().strip()).ratio()
        assert s == want, rows[i]
