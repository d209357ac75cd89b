"""Licence notices by a positional index over their rarest words.

1. The document frequency of every word of the licence templates is counted over
   all rows; only these counts, one for each such word, reach the driver.
2. The index has, for each template, the places of its ``ANCHORS`` words of
   highest inverse document frequency.  It is as large as the templates,
   whatever the corpus.
3. The words of a file that are in the index are looked up.  Each posting says
   where the template would begin if it stood here; the postings of a template
   are intersected by that relative position: begins within ``slack`` of each
   other must hold at least half of its anchors.
4. Where they do, the mandatory phrases must stand word for word in the stretch
   that the template would cover, and ``COVERED`` of the template's words must
   stand there in order (a longest common subsequence).
5. The base phrases are found word for word as well, and always count.

Every text is handled whole in its own row.  Words go by 64-bit hashes.
"""

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docketry.llm.frames import named, slices, small_batches
from docketry.llm.license_texts import BASE, TEMPLATES, Template
from docketry.llm.words import Words, text_buffer, word_hashes

#: Places of a template in the index.
ANCHORS = 8
#: Share of a template's words that must stand in order.
COVERED = 0.8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def license_words(texts: pa.Array) -> Words:
    """Runs of ASCII letters, digits and all that is not ASCII; A-Z lower-cased."""
    data, offsets = text_buffer(texts)
    data = _LOWER[data]
    inside = np.concatenate([_INSIDE[data], [False]])
    first = np.zeros(len(inside), dtype=bool)
    first[offsets] = True
    begins = inside & (first | ~np.concatenate([[False], inside[:-1]]))
    start = np.flatnonzero(begins)
    # A word ends before what is no part of words, or where the next text begins.
    stops = np.flatnonzero(~inside | first)
    end = stops[np.searchsorted(stops, start, "right")] if len(start) else start
    return Words(data, start, end, np.searchsorted(start, offsets))


class Index(NamedTuple):
    """All that a task needs, as large as the templates."""

    hashes: np.ndarray  # of the known words, ascending
    base: list[tuple[str, list[int]]]  # label and word numbers of each phrase
    labels: list[str]  # of each template
    words: list[list[int]]  # word numbers of each template
    phrases: list[list[list[int]]]  # of its mandatory phrases
    anchors: list[list[int]]  # its places in the index

    @classmethod
    def of(cls, templates: Sequence[Template], base, frequency: dict[int, int], rows: int) -> "Index":
        """The index for words found in so many of ``rows`` rows, by word hash."""
        hashes = vocabulary(templates, base)
        number = {h: n for n, h in enumerate(hashes.tolist())}
        cut = lambda text: [number[h] for h in _hashed(text)]
        words = [cut(t.text) for t in templates]
        idf = [math.log((rows + 1) / (frequency.get(h, 0) + 1)) for h in hashes.tolist()]
        anchors = [sorted(sorted(range(len(w)), key=lambda k: (-idf[w[k]], k))[:ANCHORS]) for w in words]
        return cls(
            hashes, [(label, cut(text)) for text, label in base], [t.label for t in templates], words,
            [[cut(p) for p in t.phrases] for t in templates], anchors,
        )

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each word, -1 for those that no template has."""
        found = word_hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        return np.where(self.hashes[at] == found, at, -1)


def slack(size: int) -> int:
    """Words by which the parts of a template of ``size`` words may be moved."""
    return max(2, size // 8)


def _hashed(text: str) -> list[int]:
    return word_hashes(license_words(pa.array([text]))).tolist()


def vocabulary(templates: Sequence[Template], base) -> np.ndarray:
    """The hashes of all words of the templates, ascending."""
    texts = [t.text for t in templates] + [p for t in templates for p in t.phrases] + [p for p, _ in base]
    return np.unique(word_hashes(license_words(pa.array(texts))))


def in_order(template: Sequence[int], stretch: Sequence[int]) -> int:
    """Length of the longest common subsequence, a bit for each template word."""
    masks: dict[int, int] = {}
    for k, word in enumerate(template):
        masks[word] = masks.get(word, 0) | 1 << k
    full = (1 << len(template)) - 1
    row = full
    for word in stretch:
        hit = row & masks.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(template) - row.bit_count()


def _stands(phrase: list[int], stretch: list[int]) -> bool:
    n = len(phrase)
    return any(stretch[k : k + n] == phrase for k in range(len(stretch) - n + 1))


def base_places(numbers: np.ndarray, owner: np.ndarray, base) -> list[tuple[int, int, str]]:
    """``(text, word, label)`` of each place of a base phrase."""
    found = []
    for label, phrase in base:
        n = len(phrase)
        at = np.flatnonzero(numbers[: len(numbers) - n + 1] == phrase[0]) if len(numbers) >= n else np.zeros(0, int)
        for k in range(1, n):
            at = at[numbers[at + k] == phrase[k]]
        at = at[owner[at] == owner[at + n - 1]]
        found += [(o, w, label) for o, w in zip(owner[at].tolist(), at.tolist())]
    return sorted(found)


def template_places(index: Index, numbers: np.ndarray, row: np.ndarray, owner: np.ndarray) -> list[tuple]:
    """``(text, begin, label, covered)`` of each verified place of a template."""
    known = np.flatnonzero(numbers >= 0)
    found: list[tuple] = []
    covered: dict[tuple, float] = {}
    for n, (label, words, anchors) in enumerate(zip(index.labels, index.words, index.anchors)):
        begins, which = [], []
        for a, offset in enumerate(anchors):
            at = known[numbers[known] == words[offset]]
            begins.append(at - offset)
            which.append(np.full(len(at), a))
        if not any(map(len, begins)):
            continue
        begin, anchor = np.concatenate(begins), np.concatenate(which)
        text = owner[begin + np.array(anchors)[anchor]]
        order = np.lexsort((begin, text))
        begin, anchor, text = begin[order], anchor[order], text[order]
        # Begins of one text within the slack, by one ascending key.
        room = slack(len(words))
        span = 2 * (len(numbers) + len(words) + room) + 2
        key = text * span + begin + len(words)
        last = np.searchsorted(key, key + room, "right")
        first = np.searchsorted(key, key, "left")
        votes = np.zeros(len(key), dtype=np.int64)
        for a in range(len(anchors)):
            total = np.concatenate([[0], np.cumsum(anchor == a)])
            votes += total[last] > total[first]
        good = np.flatnonzero((2 * votes >= len(anchors)) & (first == np.arange(len(key))))
        for b, d in zip(begin[good].tolist(), text[good].tolist()):
            low = max(int(row[d]), b - room)
            stretch = numbers[low : min(int(row[d + 1]), b + len(words) + 2 * room)].tolist()
            case = (n, *stretch)
            share = covered.get(case)
            if share is None:
                whole = all(_stands(p, stretch) for p in index.phrases[n])
                share = covered[case] = in_order(words, stretch) / len(words) if whole else 0.0
            if share >= COVERED:
                found.append((d, b, label, share))
    return sorted(found)


def _frequencies(docs: DataFrame, text: str, hashes: np.ndarray) -> tuple[dict[int, int], int]:
    """In how many rows each word stands, and the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = Counter(), 0
        for batch in slices(batches, "_text"):
            words = license_words(batch.column("_text"))
            found = word_hashes(words)
            at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            owner = words.owner()[hashes[at] == found]
            at = at[hashes[at] == found]
            pairs = np.unique(owner * len(hashes) + at) % len(hashes)
            total.update(dict(zip(*[x.tolist() for x in np.unique(pairs, return_counts=True)])))
            rows += batch.num_rows
        total[-1] = rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["word", "rows"]
        )

    rows = docs.select(named(text).cast("string").alias("_text")).mapInArrow(count, "word long, rows long")
    # One row for each template word at most.
    counted = {r.word: r.rows for r in rows.groupBy("word").agg(F.sum("rows").alias("rows")).collect()}
    total = counted.pop(-1, 0)
    return {int(hashes[w]): n for w, n in counted.items()}, total


FOUND = {
    "n_words": "bigint",
    "base": "array<struct<start: bigint, label: string>>",
    "notices": "array<struct<start: bigint, label: string, covered: double>>",
}


def scan_licenses(
    docs: DataFrame,
    text: str = "text",
    templates: Sequence[Template] = TEMPLATES,
    base: Sequence[tuple[str, str]] = BASE,
) -> DataFrame:
    """``docs`` with ``n_words``, ``base`` and ``notices``.

    ``base`` has word number and label of every place of a base phrase, ``notices``
    the same of every verified template (where its first word would stand, which
    may be before the text if that begins in the middle of it) and the share of
    its words that stand there in order; both by place, then label.

    NULL, empty and blank texts have no words and hold nothing.  Every row counts
    on its own, so repeated rows and NULL or repeated ids do not matter, and every
    row comes back once.  Other columns stay as they are, whatever their names;
    those named as a result are replaced.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    templates, base = tuple(templates), tuple(base)
    index = Index.of(templates, base, *_frequencies(docs, text, vocabulary(templates, base)))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kept = [named(c) for c in docs.columns if c.lower() not in FOUND]
    rows = docs.select(F.struct(*kept).alias("_row"), named(text).cast("string").alias("_text"))
    schema = T.StructType([rows.schema["_row"]])
    for name, kind in FOUND.items():
        schema = schema.add(name, T._parse_datatype_string(kind))

    def listed(found: list[tuple], row: np.ndarray, names: Sequence[str], kinds: Sequence) -> pa.Array:
        size = Counter(f[0] for f in found)
        ends = np.cumsum([0] + [size[d] for d in range(len(row) - 1)])
        columns = [pa.array([f[1] - int(row[f[0]]) for f in found], pa.int64())]
        columns += [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds, 2)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices(batches, "_text"):
            words = license_words(batch.column("_text"))
            numbers, owner = index.numbers(words), words.owner()
            places = base_places(numbers, owner, index.base)
            notices = template_places(index, numbers, words.row, owner)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_row"), pa.array(np.diff(words.row), pa.int64()),
                    listed(places, words.row, ["start", "label"], [pa.string()]),
                    listed(notices, words.row, ["start", "label", "covered"], [pa.string(), pa.float64()]),
                ],
                ["_row", *FOUND],
            )

    return rows.mapInArrow(work, schema).select("_row.*", *FOUND)
