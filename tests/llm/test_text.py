"""Near-duplicates, repeats, language model, tokens, quality and decontamination."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.llm import lm_score
from docketry.llm.bpe import Encoder, Vocabulary, decode, encode
from docketry.llm.components import components
from docketry.llm.decontaminate import contaminated
from docketry.llm.lm_score import score_texts
from docketry.llm.near_dedup import near_duplicates
from docketry.llm.quality import STATISTICS, fit, holds, score_quality, text_statistics
from docketry.llm.substring_dedup import WINDOW, remove_repeats
from docketry.llm.words import cut_words, word_hashes

PATH = public_tokenizers.path("word_bpe_49k.json")


def split(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def test_words(texts):
    words = cut_words(pa.array(texts.values()), lower=True)
    flat = [w for t in texts.values() for w in split(t, True)]
    assert [words.data[a:b].tobytes() for a, b in zip(words.start, words.end)] == flat
    seen = {}
    for word, value in zip(flat, word_hashes(words).tolist()):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    edges = [(n, n + 1) for n in range(0, 60)] + [(100, n) for n in range(101, 140)] + [(7, 7), (3, 2), (2, 3)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {n: 0 for n in range(61)} | {n: 100 for n in range(100, 140)}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def brute_groups(texts):
    sets = {}
    for k, t in texts.items():
        w = split(t, True)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in texts}


def test_near_duplicates(docs, nothing, texts):
    got = near_duplicates(docs).collect()
    assert len(got) == docs.count() and near_duplicates(nothing).count() == 0
    want = brute_groups(texts)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_without_a_common_centre(spark):
    """Chains and groups in which not everyone is linked to the centre."""
    import random

    rng = random.Random(9)
    base = [f"w{n}" for n in range(140)]
    rows = {}
    for k in range(160):
        own = list(base)
        for at in rng.sample(range(140), rng.choice((0, 1, 2, 3))):
            own[at] = f"c{rng.randint(0, 3)}x{at}"
        rows[k] = " ".join(own)
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame).collect()}
    assert got == brute_groups(rows)


def brute_repeats(texts):
    seen, out = {}, {}
    for k in sorted(texts):
        w = split(texts[k])
        gone = set()
        for s in range(len(w) - WINDOW + 1):
            key = tuple(w[s : s + WINDOW])
            if key in seen:
                gone.update(range(s, s + WINDOW))
            else:
                seen[key] = k
        out[k] = (len(w), len(gone), b" ".join(x for n, x in enumerate(w) if n not in gone).decode())
    return out


def test_repeats(docs, nothing, texts):
    got = remove_repeats(docs).collect()
    assert len(got) == docs.count() and remove_repeats(nothing).count() == 0
    want = brute_repeats(texts)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]
            assert sum(x.last - x.first + 1 for x in r.removed) == r.n_removed


def test_repeats_of_shifted_passages(spark):
    """Passages of all lengths around a window, inside one text and across texts."""
    import random

    rng = random.Random(2)
    base = [rng.choice("abcdef") + str(n) for n in range(60)]
    rows = {}
    for k in range(120):
        a = rng.randint(0, 40)
        piece = base[a : a + rng.randint(15, 45)]
        rows[k] = " ".join([f"u{k}"] + piece + [f"v{rng.randint(0, 5)}"] + piece[: rng.randint(0, 30)])
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(frame).collect()}
    assert got == brute_repeats(rows)


@pytest.mark.parametrize("most", [1 << 19, 50])
def test_language_model(docs, nothing, texts, monkeypatch, most):
    monkeypatch.setattr(lm_score, "MOST_FREQUENT", most)
    train = (F.col("doc_id") % 4 != 0) & F.col("doc_id").isNotNull()
    got = score_texts(docs, train).collect()
    assert len(got) == docs.count()
    count = Counter()
    for k, t in [*texts.items(), (6, texts[6])]:
        if k % 4:
            count.update([*split(t, True), None])
    n, v = sum(count.values()), len(count)
    for r in got:
        if r.doc_id is None:
            continue
        tokens = [*split(texts[r.doc_id], True), None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert r.n_tokens == len(tokens) and r.train_tokens == n
        assert r.n_known == sum(count[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 0
    copies = [r for r in got if r.doc_id == 8]
    assert copies[0].score > copies[0].base_score + 20  # its near copies were learnt
    assert score_texts(nothing, train).count() == 0
    alone = score_texts(docs.filter("doc_id = 4"), F.lit(False)).first()
    assert (alone.train_tokens, alone.n_known, alone.base_score) == (0, 0, 0.0)


def test_filter_holds_levels():
    rng = np.random.default_rng(0)
    key = lm_score.part_key(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    level = np.frexp(np.concatenate([np.ones(2000, int), rng.integers(2, 5000, 2000)]))[1]
    bits = 64 + lm_score.BITS * len(key) + lm_score.LEVEL_BITS * int((level - 1).sum())
    piece = lm_score.piece_of_filter(key, level, bits)
    found = lm_score.levels_of(key, piece, np.zeros(len(key), int), np.full(len(key), bits))
    assert (found >= level).all() and (found > level).mean() < 0.2
    strange = lm_score.part_key(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    none = lm_score.levels_of(strange, piece, np.zeros(20_000, int), np.full(20_000, bits))
    assert (none > 0).mean() < 0.02


def test_keys_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3000):
        key = np.unique(rng.integers(0, 2**32, n, dtype=np.uint64))
        for times in (np.ones(len(key), int), rng.integers(1, 2**31, len(key)), rng.integers(1, 3, len(key))):
            kind = rng.integers(0, 200, len(key)).astype(np.uint8)
            back = lm_score.decode_keys(pa.py_buffer(lm_score.encode_keys(key, times, kind)))
            assert sorted(zip(*map(np.ndarray.tolist, back))) == sorted(zip(key.tolist(), times.tolist(), kind.tolist()))


def test_bpe(docs, nothing, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    got = decode(encode(docs, PATH), PATH).collect()
    assert len(got) == docs.count() and encode(nothing, PATH).count() == 0
    packed = {r.doc_id: r.ids for r in encode(docs, PATH, packed=True).collect()}
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False)
        assert r.ids == want.ids and r.decoded == library.decode(want.ids, skip_special_tokens=False)
        assert packed[r.doc_id] == np.array(want.ids, dtype="<u4").tobytes() and r.slot in ("s", None)


def test_bpe_odd_words():
    import random

    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(PATH), Encoder(Vocabulary.read(PATH))
    rng = random.Random(3)
    letters = "abcdeABCé ßΣİı'’<|>9٣½ \t\n ́가漢字🙂\x1c\x85end.,"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(2000)]
    texts += ["a<|endoftext|>b", "<|ENDOFTEXT|>", "it's don'T we'LL", "ab" * 9000]
    ids, bounds = own.encode(pa.array(texts))
    for n, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[n] : bounds[n + 1]].tolist() == want.ids, texts[n]
    assert 0 < own.exact < len(own.piece_ids)


def test_quality(spark, docs, nothing):
    rows = [(n, ("clean words follow here. " if n % 3 else "BUY!! NOW!! ") * (5 + n % 7), int(n % 3 > 0)) for n in range(300)]
    train = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = train.select("doc_id", "quality")
    scored = score_quality(train.drop("quality"), labels, fold=F.col("_id") % 5 != 0).collect()
    want = {r[0]: r[2] for r in rows}
    assert all(r.predicted == want[r.doc_id] for r in scored) and len(scored) == 300
    other = score_quality(docs, labels)
    assert other.count() == docs.count() and Counter(other.columns) == Counter(docs.columns) + Counter(["predicted"])
    assert all(0 <= r.score <= 1 for r in other.select("score").collect())
    none = score_quality(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5] and score_quality(nothing, labels).count() == 0


def test_rules_are_what_the_columns_say(texts):
    x = np.stack(list(text_statistics(pa.array(texts.values())).values()), axis=1)
    assert x.shape == (len(texts), len(STATISTICS)) and np.isfinite(x).all()
    rng = np.random.default_rng(0)
    x = rng.random((400, len(STATISTICS)))
    y = ((x[:, 3] > 0.5) & (x[:, 5] < 0.7)).astype(float)
    model = fit(x, y)
    z = model.base + sum(w * holds(rule, x) for rule, w in model.rules)
    assert ((z > 0) == (y == 1)).mean() > 0.97 and len(model.rules) < 200


def test_decontamination(spark, docs, nothing, texts):
    import random

    rng = random.Random(4)
    fresh = ["".join(rng.choices("klmnopqrst", k=7)) for _ in range(400)]
    items = {n: rng.sample(fresh, 30) for n in range(12)}
    bench = spark.createDataFrame(
        [(n, " ".join(w)) for n, w in items.items()] + [(90, None), (91, ""), (92, "too short")],
        "item_id long, text string",
    )
    filler = [t for t in texts.values() if t and 50 < len(t) < 2000][:20]
    made = [(100 + n, f"{filler[n]} {' '.join(w)} {filler[n + 1]}") for n, w in items.items() if n < 6]
    changed = [w if n % 6 else "other" for n, w in enumerate(items[6])]
    made.append((106, filler[3] + " " + " ".join(changed).upper() + ". " + filler[4]))
    made.append((107, filler[3] + " " + " ".join(items[7][:8]) + " " + filler[5]))  # too little of it
    leaks = spark.createDataFrame(made, "doc_id long, text string")
    got = contaminated(docs.select("doc_id", "text").unionByName(leaks), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(100 + n, n) for n in range(7)}
    assert contaminated(nothing, bench).count() == 0 and contaminated(leaks, bench.limit(0)).count() == 0
