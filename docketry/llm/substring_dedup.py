"""Substring dedup by seed and extend.

A repeat is a run of ``WINDOW`` words that also starts earlier: in a document
with a smaller id, or before in the same one.  All words of such runs go; what
is left of one place of every passage is its first.

1. Seeds: winnowing picks, in each window of ``WINDOW`` words, the seed of
   ``SEED`` words with the smallest hash.  Equal windows pick equal seeds, so
   every repeat holds one, and a seed stands for the windows that picked it.
2. Extension: the words around a seed, as far as its windows reach, are its
   context.  Occurrences with one context are repeats of the first of them in
   full length, both ways.
3. Seeds that occur in several contexts are compared window by window, the first
   occurrence of each context only.
4. The removed windows of a document are joined to maximal runs and cut out.

Whatever is repeated inside a batch is decided there, so a passage that every
document has leaves one row for each batch, not for each document.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from docketry.llm.frames import named, slices, small_batches, written
from docketry.llm.words import Words, chain, cut_words, mix, runs_inside, span_hashes, word_hashes

WINDOW = 20
SEED = 8

_PLACE = "id long, tag int, first int, last int"


def _keys(batch: pa.RecordBatch, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id (NULL is the smallest) and a tag of the words of each document."""
    ids = pc.fill_null(batch.column("id"), -(2**63)).to_numpy(zero_copy_only=False)
    tags = span_hashes(hashes, words.row[:-1], words.row[1:])
    return ids, (tags & np.uint64(0x7FFFFFFF)).astype(np.int32)


def seeds(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Seed hash, context hash, first and last window (as word numbers) of each
    place where winnowing picks a seed."""
    windows = np.flatnonzero(runs_inside(row, WINDOW))
    if not len(windows):
        none = np.zeros(0, dtype=np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    grams = chain(hashes, SEED)
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - SEED + 1)
    picked = np.argmin(view, axis=1)[windows] + windows
    new = np.ones(len(picked), dtype=bool)
    new[1:] = picked[1:] != picked[:-1]
    first = windows[new]
    last = windows[np.append(np.flatnonzero(new)[1:] - 1, len(picked) - 1)]
    at = picked[new]
    shape = ((at - first) * 32 + (last - first)).astype(np.uint64)
    context = mix(span_hashes(hashes, first, last + WINDOW) + shape)
    return grams[at], context, first, last


def repeated_here(group: tuple[np.ndarray, ...], place: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which rows have a row of the same group at an earlier place."""
    if not len(place[0]):
        return np.zeros(0, dtype=bool)
    order = np.lexsort((*place[::-1], *group[::-1]))
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for g in group:
        new[1:] |= g[order][1:] != g[order][:-1]
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.zeros(len(order), dtype=bool)
    for p in place:
        later |= p[order] != p[lead]
    out = np.zeros(len(order), dtype=bool)
    out[order] = later
    return out


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32))


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values)


def occurrences(docs: DataFrame) -> DataFrame:
    """``seed, context, id, tag, first, last, repeat`` from ``id, text``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = cut_words(batch.column("text"))
            hashes = word_hashes(words)
            ids, tags = _keys(batch, words, hashes)
            seed, context, first, last = seeds(hashes, words.row)
            doc = np.searchsorted(words.row, first, "right") - 1
            first, last = first - words.row[doc], last - words.row[doc]
            repeat = repeated_here((seed, context), (ids[doc], tags[doc], first))
            # A repeat found here has no need to meet its group: any key will do.
            spread = mix(context + doc.astype(np.uint64) + first.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [_longs(np.where(repeat, spread, seed)), _longs(context), _longs(ids[doc]),
                 _ints(tags[doc]), _ints(first), _ints(last), pa.array(repeat)],
                ["seed", "context", "id", "tag", "first", "last", "repeat"],
            )

    return docs.mapInArrow(work, f"seed long, context long, {_PLACE}, repeat boolean")


def _by_document(places: DataFrame) -> DataFrame:
    """``p_id, p_tag, places``; as many places as the document has windows at most."""
    return places.groupBy(F.col("id").alias("p_id"), F.col("tag").alias("p_tag")).agg(
        F.collect_list(F.struct("first", "last")).alias("places")
    )


def _tagged(docs: DataFrame) -> DataFrame:
    """``id, text`` with the tag of :func:`occurrences`, NULL ids as the smallest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = cut_words(batch.column("text"))
            ids, tags = _keys(batch, words, word_hashes(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(ids), _ints(tags), batch.column("text")],
                ["id", "k_id", "k_tag", "text"],
            )

    return docs.mapInArrow(work, "id long, k_id long, k_tag int, text string")


def _with_places(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    found = _by_document(places)
    return _tagged(docs).join(
        found, (F.col("k_id") == F.col("p_id")) & (F.col("k_tag") == F.col("p_tag")), how
    )


def contested_windows(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``window, id, tag, first, repeat`` of every window of the places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = cut_words(batch.column("text"))
            hashes = word_hashes(words)
            listed = batch.column("places")
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(listed).to_numpy())
            flat = listed.flatten()
            first = pc.struct_field(flat, "first").to_numpy().astype(np.int64)
            size = pc.struct_field(flat, "last").to_numpy() - first + 1
            doc = np.repeat(doc, size)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
            begin = words.row[doc] + at
            window = span_hashes(hashes, begin, begin + WINDOW)
            ids = batch.column("k_id").to_numpy()[doc]
            tags = batch.column("k_tag").to_numpy()[doc]
            repeat = repeated_here((window,), (ids, tags, at))
            spread = mix(window + doc.astype(np.uint64) + at.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [_longs(np.where(repeat, spread, window)), pa.array(ids), _ints(tags), _ints(at), pa.array(repeat)],
                ["window", "id", "tag", "first", "repeat"],
            )

    rows = _with_places(docs, places, "inner").select("text", "k_id", "k_tag", "places")
    return rows.mapInArrow(work, "window long, id long, tag int, first int, repeat boolean")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, tag, first, last``: windows ``first`` to ``last`` of the document
    start earlier as well.  Places of one document may overlap."""
    small_batches(docs.sparkSession)
    rows = docs.select(named(doc_id).cast("long").alias("id"), named(text).cast("string").alias("text"))
    place = ["id", "tag", "first"]
    same = Window.partitionBy("seed", "context").orderBy(*place)
    seed = Window.partitionBy("seed")
    judged = occurrences(rows).select(
        "id", "tag", "first", "last",
        (F.col("repeat") | (F.rank().over(same) > 1)).alias("repeat"),
        (F.min("context").over(seed) != F.max("context").over(seed)).alias("contested"),
    )
    judged = written(judged.filter("repeat or contested"), "repeats")
    contested = contested_windows(rows, judged.filter("not repeat").drop("repeat", "contested"))
    rank = F.rank().over(Window.partitionBy("window").orderBy(*place))
    again = contested.select(
        "id", "tag", "first", F.col("first").alias("last"), (F.col("repeat") | (rank > 1)).alias("repeat")
    )
    own = judged.filter("repeat").select("id", "tag", "first", "last")
    return own.unionByName(again.filter("repeat").drop("repeat"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, removed, kept`` for each row of ``docs``.

    ``removed`` lists the maximal runs of removed words as ``first, last`` word
    numbers, ``kept`` has the words left, joined by one blank.  Words are runs
    of anything but blanks and 0x09-0x0D, unchanged.  NULL, empty and blank
    texts have no words; texts under ``WINDOW`` words lose nothing.  A NULL id
    counts as the smallest.  Rows with one id are one document: equal rows do
    not count as repeats of each other, and different texts under one id are
    ordered by a hash of their words.  Every row comes back once.  Other columns
    are not looked at.
    """
    small_batches(docs.sparkSession)
    places = repeats(docs, doc_id, text)
    rows = docs.select(named(doc_id).cast("long").alias("id"), named(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = cut_words(batch.column("text"))
            count = np.diff(words.row)
            edge = np.zeros(len(words.start) + 1, dtype=np.int64)
            listed = batch.column("places")
            sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
            base = np.repeat(words.row[:-1], sizes)
            flat = listed.flatten()
            np.add.at(edge, base + pc.struct_field(flat, "first").to_numpy(), 1)
            np.add.at(edge, base + pc.struct_field(flat, "last").to_numpy() + WINDOW, -1)
            gone = np.cumsum(edge)[:-1] > 0
            kept, runs, removed = [], [], []
            for d in range(batch.num_rows):
                a, b = words.row[d], words.row[d + 1]
                out = gone[a:b]
                removed.append(int(out.sum()))
                turn = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
                runs.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(turn[::2], turn[1::2])])
                left = np.flatnonzero(~out) + a
                kept.append(" ".join(words.texts(left)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                 pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "removed", "kept"],
            )

    found = _with_places(rows, places, "left").select("id", "text", "places")
    return found.mapInArrow(
        work,
        "doc_id long, n_words long, n_removed long, removed array<struct<first: int, last: int>>, kept string",
    )
