"""The filter of the language model holds every n-gram; scores do not depend on its parts."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.llm import lm_score


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    rows = [(n, " ".join(rng.choices(words, k=200))) for n in range(300)]
    rows += [(1000 + n, rows[n][1]) for n in range(20)] + [(2000, None), (2001, ""), (2002, "unseen words here")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def _asked(fitted, gram):
    """Mean counts of n-grams from the pieces, as scoring reads them."""
    model, _, _, pieces = fitted
    level = np.zeros(len(gram), dtype=np.int64)
    for row in pieces.select("part", "field", "bits").collect():
        mine = gram % np.uint64(model.parts) == row.part
        flat = np.frombuffer(bytes(row.field), dtype=np.uint8)
        level[mine] = lm_score.levels_of(
            lm_score.part_key(gram[mine]), flat, np.zeros(mine.sum(), int), np.full(mine.sum(), row.bits))
    return model.meant(level)


def test_no_count_is_left_out(spark, prose, monkeypatch):
    train = prose.filter("doc_id < 300").select("text")
    for part_bytes in (6 << 20, 50_000):
        monkeypatch.setattr(lm_score, "PART_BYTES", part_bytes)
        fitted = lm_score.fit(train)
        texts = train.toArrow()["text"]
        tokens, row = lm_score.tokens_of(lm_score.cut_words(texts, lower=True))
        for order in (2, 3):
            gram, count = np.unique(lm_score.grams(tokens, row, order)[0], return_counts=True)
            found = _asked(fitted, gram)
            assert (count == 1).mean() > 0.5 and (found > count / 2).all() and np.median(found / count) < 1.5
            strange = _asked(fitted, np.random.default_rng(order).integers(0, 2**63, 20_000, dtype=np.uint64))
            assert (strange > 0).mean() < 0.01


def test_filter_grows_with_the_input(spark, prose):
    bits = [lm_score.fit(prose.filter(f"doc_id < {n}").select("text"))[3].agg(F.sum("bits")).first()[0]
            for n in (75, 300)]
    assert bits[1] > 3 * bits[0]


def test_words_seen_once_together_are_known(spark, prose):
    rows = lm_score.score_texts(prose, F.col("doc_id") < 300).collect()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[1000 + n].score > by_id[1000 + n].base_score + 50 for n in range(20))


@pytest.mark.parametrize("most", [1 << 19, 50])
def test_parts_do_not_change_scores(spark, prose, monkeypatch, most):
    """Chance members of the filter differ, and little else."""
    monkeypatch.setattr(lm_score, "MOST_FREQUENT", most)
    got = []
    for part_bytes in (6 << 20, 50_000):
        monkeypatch.setattr(lm_score, "PART_BYTES", part_bytes)
        rows = lm_score.score_texts(prose, F.col("doc_id") < 300).collect()
        got.append(sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in rows))
    assert [g[:4] for g in got[0]] == [g[:4] for g in got[1]] and len(got[0]) == 323
    assert all(abs(a[4] - b[4]) < 0.02 * abs(a[4]) + 0.5 for a, b in zip(*got))


def test_scores_are_the_mixture(spark, monkeypatch):
    """Against the mixture computed from exact counts, within the rounding."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdef", k=4)) for _ in range(60)]
    rows = [(n, " ".join(rng.choices(words, weights=range(1, 61), k=60))) for n in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm_score.score_texts(frame, F.col("doc_id") < 160).collect()}
    model, *_ = lm_score.fit(frame.filter("doc_id < 160").select("text"))
    grams = [Counter() for _ in range(4)]
    for n, text in rows[:160]:
        tokens = [*text.split(), None]
        for order in (1, 2, 3):
            grams[order].update(tuple(tokens[k : k + order]) for k in range(len(tokens) - order + 1))
    total, distinct = sum(grams[1].values()), len(grams[1])
    once = lambda part: sum(c for c in part if c == 1) / max(sum(part), 1)
    shorter = {}
    for size in {c.bit_length() for c in grams[1].values()}:
        shorter[size] = once([c for g, c in grams[2].items() if grams[1][g[:1]].bit_length() == size])
    for n, text in rows:
        tokens, want = [*text.split(), None], 0.0
        for k, token in enumerate(tokens):
            p = (grams[1][token,] + 0.5) / (total + 0.5 * (distinct + 1))
            for order in (2, 3):
                gram = tuple(tokens[k - order + 1 : k + 1])
                before = grams[order - 1][gram[:-1]] if k >= order - 1 else 0
                if before:
                    weight = shorter[before.bit_length()] if order == 2 else model.spare[3] / (model.spare[3] + before)
                    weight = min(max(weight, 0.02), 1)
                    p = (1 - weight) * min(grams[order][gram] / before, 1) + weight * p
            want += math.log10(p)
        assert got[n] == pytest.approx(want, rel=0.05), n


def test_texts_are_sent_compressed():
    """Op3: what the shuffle carries of a batch's texts is half their size at most."""
    texts = pa.array(["", None, *[f"the cat {k} sat on the mat and looked at dog {k % 7}" for k in range(500)]])
    for some in (texts, texts.slice(1, 300), texts.slice(0, 2)):
        pack = pa.scalar(lm_score.pack_texts(some), pa.binary())
        assert lm_score.unpack_texts(pack).to_pylist() == some.to_pylist()
    assert 2 * len(lm_score.pack_texts(texts)) < texts.nbytes
