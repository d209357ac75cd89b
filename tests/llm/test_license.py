"""Licence scans against brute force."""

import math
import random
import re

import pyarrow as pa
import pytest

from docketry.llm import q_license
from docketry.llm.license_scan import ANCHORS, COVERED, in_order, license_words, scan_licenses, slack
from docketry.llm.license_texts import BASE, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def cut(text):
    return WORD.findall((text or "").translate(LOWER))


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
        row = new
    return row[-1]


def stands(phrase, words):
    return [k for k in range(len(words) - len(phrase) + 1) if words[k : k + len(phrase)] == phrase]


def brute(texts):
    files = [cut(t) for t in texts]
    sets = [set(f) for f in files]
    idf = lambda w: math.log((len(files) + 1) / (sum(w in s for s in sets) + 1))
    anchors = []
    for t in TEMPLATES:
        words = cut(t.text)
        anchors.append(sorted(range(len(words)), key=lambda k: (-idf(words[k]), k))[:ANCHORS])
    out = []
    for f in files:
        base = sorted((k, label) for phrase, label in BASE for k in stands(phrase.split(), f))
        notices = []
        for t, places in zip(TEMPLATES, anchors):
            words = cut(t.text)
            votes = {(k - p, p) for p in places for k, w in enumerate(f) if w == words[p]}
            room = slack(len(words))
            for b in {b for b, _ in votes}:
                if 2 * len({p for x, p in votes if b <= x <= b + room}) < len(places):
                    continue
                stretch = f[max(0, b - room) : b + len(words) + 2 * room]
                if all(stands(p.split(), stretch) for p in t.phrases):
                    share = common(words, stretch) / len(words)
                    if share >= COVERED:
                        notices.append((b, t.label, share))
        out.append((len(f), base, sorted(notices)))
    return out


@pytest.fixture(scope="module")
def files():
    rng = random.Random(4)
    filler = ["the", "of", "file", "software", "license", "copy", "ñandú", "x1", "gnu", "by", "work"]
    texts = [None, "", " \n ", "plain", "MIT LICENSE", "mit-license", "cc by", "CC BY, cc/by"]
    for n in range(160):
        t = rng.choice(TEMPLATES)
        words = t.text.split()
        kind = n % 6
        if kind == 1:  # a tenth of the words changed
            words = [w if rng.random() > 0.1 else rng.choice(filler) for w in words]
        elif kind == 2:  # words put in
            words = [x for w in words for x in ([w, "//"] + rng.choices(filler, k=rng.random() < 0.05))]
        elif kind == 3:  # cut off
            words = words[: rng.randint(1, len(words))]
        elif kind == 4:
            words = rng.choices(filler, k=30)
        elif kind == 5:
            words = words * 3
        before, after = (rng.choices(filler, k=rng.randint(0, 40)) for _ in "ab")
        texts.append(" ".join(before) + "\n" + "\n# ".join(words).upper() + " " + " ".join(after))
    texts += ["license " * 300 + TEMPLATES[0].text + " the" * 3_000, texts[20], texts[20]]
    return texts


def test_words():
    texts = ["MIT-Licence 2.0", "", None, "é漢x{a}\x7fb", "A", "bB", "\x00a b"]
    words = license_words(pa.array(texts))
    got = [[words.text(k) for k in range(words.row[d], words.row[d + 1])] for d in range(len(texts))]
    assert got == [cut(t) for t in texts]


def test_in_order():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 30))] for _ in "ab")
        assert in_order(a, b) == common(a, b)


def test_scan_is_brute_force(spark, files):
    rows = spark.createDataFrame(list(enumerate(files)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.base], [tuple(x) for x in r.notices])
           for r in scan_licenses(rows).collect()}
    assert len(got) == len(files)
    want = brute(files)
    for n, expected in enumerate(want):
        assert got[n] == expected, files[n]
    assert sum(bool(w[2]) for w in want) > 80
    # Changed and lengthened notices are found, and a file of parts of them is not.
    assert sum(bool(want[8 + n][2]) for n in range(160) if n % 6 in (0, 5)) == 53
    assert not any(want[8 + n][2] for n in range(160) if n % 6 == 4)


def test_rows(spark, docs, nothing, texts):
    out = scan_licenses(docs)
    assert out.columns == [*docs.columns, "n_words", "base", "notices"]
    rows = out.collect()
    assert len(rows) == docs.count()
    assert all(r.n_words == len(cut(r.text)) and not r.notices for r in rows)
    assert scan_licenses(nothing).count() == 0
    clash = spark.createDataFrame([("Released under the MIT License.", 5, "x")], "text string, base int, `a.b` string")
    row = scan_licenses(clash).first()
    assert [tuple(b) for b in row.base] == [(3, "mit")] and row["a.b"] == "x"
    assert [tuple(b) for b in row.notices] == [(0, "mit", 1.0)]


def test_query(spark, files, tmp_path):
    rows = spark.createDataFrame(list(enumerate(files)), "doc_id long, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in q_license.query(spark, str(tmp_path)).collect()}
    for n, (words, base, notices) in enumerate(brute(files)):
        starts, names = [b for b, _ in base], {label for _, label in base}
        assert got[n] == (
            words, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)),
            ",".join(sorted(names | {label for _, label, _ in notices})),
            1.0 if base else max((c for *_, c in notices), default=0.0),
        )
