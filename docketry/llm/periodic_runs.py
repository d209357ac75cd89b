"""Runs: maximal stretches of consecutive words that repeat with a period.

1. Periods under ``DIRECT`` words are found by comparing each word with the one
   that many places on, a vector comparison per period.
2. Longer periods go by scales.  At the scale of ``t`` words the periods from
   ``3 t`` to ``6 t`` are found, ``t`` doubling from four.  Place ``i`` is in the
   synchronising set of the scale if the least hash of the ``t``-word windows that
   start from ``i`` to ``i + t`` is that of the first or the last of them.  The
   choice depends on the ``2 t`` words from ``i`` on and nothing else, so equal
   contexts are chosen alike wherever they stand.
3. Windows whose own period is at most a third of ``t`` are left out of the
   choice; they lie in runs that smaller scales have found.  Hence equal contexts
   of chosen places stand more than ``t / 3`` apart, and a place has at most 18
   partners within ``6 t``: all of those pairs are looked at, and each proposes
   its distance as a period.
4. A run of period ``q`` in this range has a chosen place with its partner ``q``
   words on, unless its first ``q`` words have a period of at most a third of
   ``t``.  Then they lie in a known run, and the next ``q`` words in the following
   run of the same short period; the phases of such neighbours give the periods
   that are possible, all of which are proposed.
5. A proposed period at a place is extended both ways as far as it holds, by
   bisection over hashes of stretches.  What is at least two periods long is a
   run; of several periods for one stretch the smallest is its own.

A text is handled in its own row, vector operations take a slice of texts at
once, and nothing is shuffled.  Words go by 64-bit hashes.  Memory is about 150
bytes for each word of a slice, or of one text if that is longer.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docketry.llm.frames import named, slices, small_batches
from docketry.llm.words import Words, cut_words, mix, word_hashes

#: Periods below it are compared directly; it is three times the least scale.
DIRECT = 12
#: Fewest words of a run.
SHORTEST = 12
_PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
_BASES = (np.uint64(1203507539), np.uint64(1664525003))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


class Stretches:
    """Compares stretches of one sequence by two polynomial hashes."""

    def __init__(self, symbols: np.ndarray):
        self.size = len(symbols)
        self.parts = []
        for prime, base in zip(_PRIMES, _BASES):
            power = np.ones(self.size + 1, dtype=np.uint64)
            have, factor = 1, base
            while have <= self.size:
                more = power[: min(have, self.size + 1 - have)]
                power[have : have + len(more)] = more * factor % prime
                have, factor = have * 2, factor * factor % prime
            total = np.zeros(self.size + 1, dtype=np.uint64)
            np.cumsum(symbols % prime * power[:-1] % prime, out=total[1:])
            total %= prime
            self.parts.append((prime, power, total))

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``size`` from ``i`` and from ``j > i`` are equal."""
        out = np.ones(len(i), dtype=bool)
        for prime, power, total in self.parts:
            left = (total[i + size] + prime - total[i]) % prime
            right = (total[j + size] + prime - total[j]) % prime
            out &= left * power[j - i] % prime == right
        return out

    def reach(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """For how many words, up to ``most``, the sequence goes on alike from
        ``i`` and ``j > i``, forwards (``way`` 1) or backwards from before them (-1)."""
        got = np.zeros(len(i), dtype=np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            size = got + step
            try_ = np.flatnonzero(size <= most)
            back = size[try_] if way < 0 else 0
            fits = self.equal(i[try_] - back, j[try_] - back, size[try_])
            got[try_[fits]] += step
            step >>= 1
        return got


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, _NEVER)
    padded[: len(values)] = values
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _direct(symbols: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of at least two periods."""
    same = np.flatnonzero(symbols[:-period] == symbols[period:])
    if not len(same):
        return same, same
    cut = np.flatnonzero(np.diff(same) > 1) + 1
    first, last = same[np.concatenate([[0], cut])], same[np.concatenate([cut - 1, [len(same) - 1]])]
    long = last - first + 1 >= period
    return first[long], last[long] + 1 + period


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Rows ``start, end, period``, of those with one stretch the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)
    return runs[new]


def _neighbours(symbols: np.ndarray, runs: np.ndarray, scale: int) -> tuple[list, list]:
    """Places and periods proposed by neighbouring runs of one short period."""
    places, periods = [], []
    low, high = 3 * scale, 6 * scale
    part = runs[(runs[:, 2] <= scale // 3) & (runs[:, 1] - runs[:, 0] >= low)]
    part = part[np.lexsort((part[:, 0], part[:, 2]))]
    near = (part[:-1, 2] == part[1:, 2]) & (part[1:, 0] <= part[:-1, 1]) & (
        part[1:, 0] > part[:-1, 1] - part[1:, 2]
    )
    for k in np.flatnonzero(near):
        (begin, end, short), (after, stop, _) = part[k].tolist(), part[k + 1].tolist()
        root = symbols[after : after + short]
        for at in range(begin, begin + short):
            if np.array_equal(symbols[at : at + short], root):
                # The second run, shifted by a possible period, falls on the first.
                first = after - at
                most = min(end - begin, stop - after + short, high - 1)
                found = np.arange(first - first // short * short, most + 1, short)
                found = found[(found >= low) & (found <= after)]
                places.append(np.maximum(after - found, begin))
                periods.append(found)
                break
    return places, periods


def find_runs(symbols: np.ndarray, row: np.ndarray) -> np.ndarray:
    """All runs ``start, end, period`` of at least two periods in each text.

    ``row`` has the first symbol of each text and the number of symbols; the
    last symbol of each text must be one that stands nowhere else.
    """
    sizes = np.diff(row)
    longest = int(sizes.max(initial=1)) - 1
    runs = np.zeros((0, 3), dtype=np.int64)
    for period in range(1, min(DIRECT, longest // 2 + 1)):
        begin, end = _direct(symbols, period)
        if len(begin):
            runs = np.vstack([runs, np.column_stack([begin, end, np.full(len(begin), period)])])
    runs = _smallest(runs)
    if 6 * (DIRECT // 3) > longest:
        return runs

    stretches = Stretches(symbols)
    left = np.arange(len(symbols)) - np.repeat(row[:-1], sizes)  # words before, in the text
    right = np.repeat(row[1:], sizes) - np.arange(len(symbols)) - 1  # and from here on
    place = np.arange(len(symbols))  # where the symbols still looked at stand
    hashes, covers = symbols, 1
    scale = DIRECT // 3
    while 6 * scale <= longest:
        # Only texts that can hold two of the periods.
        long = np.repeat(sizes > 6 * scale, sizes)
        if not long.all():
            keep = long[place]
            place, hashes = place[keep], hashes[keep]
        room = right[place]
        while covers < 2 * scale:
            window = hashes
            hashes = mix(window * _STEP + np.concatenate([window[covers:], window[:covers]]))
            covers *= 2
        # Now ``window`` is over ``scale`` words, ``hashes`` over twice as many.
        short = runs[(runs[:, 2] <= scale // 3) & (runs[:, 1] - runs[:, 0] >= scale)]
        allowed = window.copy()
        if len(short):
            edge = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.add.at(edge, short[:, 0], 1)
            np.add.at(edge, short[:, 1] - scale + 1, -1)
            allowed[np.cumsum(edge)[place] > 0] = _NEVER
        least = _least(allowed, scale + 1)
        n = len(least)
        chosen = np.flatnonzero(
            (room[:n] >= 2 * scale) & (least < _NEVER)
            & ((allowed[:n] == least) | (allowed[scale : scale + n] == least))
        )
        context = hashes[chosen]
        order = np.argsort(context, kind="stable")
        context, at = context[order], place[chosen[order]]
        places, periods = _neighbours(symbols, runs, scale)
        for lag in range(1, len(at)):
            apart = at[lag:] - at[:-lag]
            near = (context[lag:] == context[:-lag]) & (apart < 6 * scale)
            if not near.any():
                break
            near &= apart >= 3 * scale
            places.append(at[:-lag][near])
            periods.append(apart[near])
        if places:
            i, q = np.concatenate(places), np.concatenate(periods)
            j = i + q
            ahead = stretches.reach(i, j, right[j], 1)
            back = stretches.reach(i, j, left[i], -1)
            whole = ahead + back >= q
            found = np.column_stack([i - back, j + ahead, q])[whole]
            if len(found):
                runs = _smallest(np.vstack([runs, found]))
        scale *= 2
    return runs


def _with_ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words with a symbol of its own after each text."""
    texts = len(words.row) - 1
    row = words.row + np.arange(texts + 1)
    out = np.empty(int(row[-1]), dtype=np.uint64)
    ends = row[1:] - 1
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside] = word_hashes(words)
    out[ends] = mix((np.arange(texts, dtype=np.uint64) + np.uint64(1)) * _STEP)
    return out, row


def _joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one blank."""
    which = np.flatnonzero(keep)
    count = np.concatenate([[0], np.cumsum(keep)])[words.row]
    size = words.end[which] - words.start[which] + 1
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(words.start[which] - ends + size, size)
    data = words.data[np.minimum(at, max(len(words.data) - 1, 0))] if len(at) else np.zeros(0, np.uint8)
    if len(ends):
        data[ends - 1] = 0x20
    bounds = np.concatenate([[0], ends])[count]
    # The blank after the last word of a text is no part of it.
    some = np.diff(count) > 0
    blank = bounds[1:][some] - 1
    solid = np.ones(len(data), dtype=bool)
    solid[blank] = False
    bounds = bounds - np.concatenate([[0], np.cumsum(some)])
    text = pa.LargeStringArray.from_buffers(
        len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[solid]))
    )
    return text.cast(pa.string())


def runs_of(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The number of words, the runs and the collapsed text of each text."""
    words = cut_words(texts)
    symbols, row = _with_ends(words)
    runs = find_runs(symbols, row)
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(SHORTEST, 2 * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = np.searchsorted(row, runs[:, 0], "right") - 1
    edge = np.zeros(len(words.start) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2] - owner, 1)
    np.add.at(edge, runs[:, 1] - owner, -1)
    kept = _joined(words, np.cumsum(edge)[:-1] == 0)
    fields = [runs[:, 0] - row[owner], runs[:, 1] - runs[:, 0], runs[:, 2]]
    listed = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner, np.arange(len(row))), pa.int32()),
        pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], ["start", "length", "period"]),
    )
    return pa.array(np.diff(words.row), pa.int64()), listed, kept


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and ``collapsed``.

    Words are runs of anything but blanks and 0x09-0x0D.  ``runs`` has start (word
    number from 0), length and smallest period, in words, of every run of at least
    ``SHORTEST`` words and two periods, by start and period.  ``collapsed`` has the
    words left, joined by one blank, when each run keeps its first period; a word
    that several runs hold goes if one of them drops it.

    NULL, empty and blank texts have no words, no runs and an empty collapsed
    text.  Every row is judged alone, so repeated rows and NULL or repeated ids
    do not matter, and every row comes back once.  Other columns stay as they are,
    whatever their names; those named as a result are replaced.  An empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    made = ("n_words", "runs", "collapsed")
    kept = [named(c) for c in docs.columns if c.lower() not in made]
    rows = docs.select(F.struct(*kept).alias("_row"), named(text).cast("string").alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), *runs_of(batch.column("_text"))], ["_row", *made]
            )

    schema = T.StructType([rows.schema["_row"]])
    for name, kind in zip(made, ("bigint", RUNS, "string")):
        schema = schema.add(name, T._parse_datatype_string(kind))
    return rows.mapInArrow(work, schema).select("_row.*", *made)


def runs_text(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def longest_run(runs: Column) -> Column:
    """The run of greatest length; ties by smallest start, then period; or NULL."""
    return F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"),
    )))
