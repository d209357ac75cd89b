"""Benchmark decontamination by latent semantic retrieval.

The benchmark is the stated set of queries; it is taken in blocks of at most
``BLOCK_ITEMS`` items, and each block meets all documents.

1. The vocabulary of a block is the words of its items.  How many passages of
   the corpus have each word is counted over all documents, which gives the
   smooth inverse document frequency of the words.  It is level for words that
   fewer than ``COMMON`` of the passages have and never zero, so that an item's
   weights depend little on the size of the corpus or on how often it was copied.
2. Distributed randomised SVD of the TF-IDF matrix of all passages over the
   vocabulary (hashed into ``FEATURES`` columns): every task projects its
   passages on a random basis and adds up two small products; the driver factors
   those, whose size does not depend on the corpus.  Passages with one vocabulary
   word are unit rows and enter by their number.
3. The telling words of an item are its rarer ones; the others carry ``UNTOLD`` of
   its weight at most.  Where a stretch of a document as long as the item could
   span has telling words of less weight than step 4 needs, the item cannot match;
   that leaves no match out, however often the item stands in the corpus.  The
   regions around the other stretches are written with the sums of step 2, so the
   corpus is read twice in all.
4. The stretches are compared with the item in the latent space and tried by
   falling cosine.  A pair is kept if the longest common subsequence of words
   carries ``COPIED`` of the item's weight, or ``PARAPHRASED`` of it and the
   answer, the last words of the item, is there too.  Items of fewer than
   ``LEAST_WORDS`` words are found where all their words stand in a row.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from docketry.llm.frames import named, slices, small_batches, written
from docketry.llm.words import Words, chain, cut_words, runs_inside, word_hashes

BLOCK_ITEMS = 20_000
#: Words of a passage in the statistics.
PASSAGE = 128
FEATURES = 4096
#: Latent dimensions, and additional ones of the random basis.
RANK, EXTRA = 48, 16
#: Words by which a stretch is longer than the item; a longer item may double.
MORE_WORDS = 64
#: Entries of a stretch up to which repeated words are told apart before step 4.
LONG_RUN = 512
COPIED, PARAPHRASED, ANSWERED = 0.8, 0.5, 0.6
ANSWER_WORDS = 5
#: Words in more than this share of the passages weigh less, and may be untold.
COMMON, UNTOLD = 0.005, 0.2
#: Items of fewer words must be there word for word.
LEAST_WORDS = 8

_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b".,;:!?\"'()")] = True


def plain_words(texts: pa.Array) -> Words:
    """Words in lower case without marks at their ends."""
    words = cut_words(texts, lower=True)
    start, end = words.start.copy(), words.end.copy()
    for _ in range(2):
        marked = np.flatnonzero(_MARKS[words.data[end - 1]])
        end[marked] = np.maximum(end[marked] - 1, start[marked] + 1)
    marked = np.flatnonzero(_MARKS[words.data[start]])
    start[marked] = np.minimum(start[marked] + 1, end[marked] - 1)
    return words._replace(start=start, end=end)


@dataclass(frozen=True)
class Items:
    """One block of the benchmark; its size is bounded by ``BLOCK_ITEMS``."""

    ids: list
    words: list[np.ndarray]  # word hashes of each item
    vocabulary: np.ndarray  # sorted word hashes
    short_ids: list
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: sorted hashes of runs, items

    @staticmethod
    def of(rows: pa.Table) -> "Items":
        words = plain_words(rows["text"].combine_chunks())
        hashes = word_hashes(words)
        each = [hashes[a:b] for a, b in zip(words.row, words.row[1:])]
        kept = [n for n, w in enumerate(each) if len(w) >= LEAST_WORDS]
        ids = rows["item_id"].to_pylist()
        brief = [n for n, w in enumerate(each) if 0 < len(w) < LEAST_WORDS]
        short = {}
        for size in sorted({len(each[n]) for n in brief}):
            which = np.array([k for k, n in enumerate(brief) if len(each[n]) == size])
            runs = np.concatenate([chain(each[brief[k]], size, size) for k in which])
            order = np.argsort(runs, kind="stable")
            short[size] = runs[order], which[order]
        long = [each[n] for n in kept]
        vocabulary = np.unique(np.concatenate(long)) if long else np.zeros(0, np.uint64)
        return Items([ids[n] for n in kept], long, vocabulary, [ids[n] for n in brief], short)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary number of each word, -1 where it is none."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def in_a_row(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Short item, begin and end of each place where all its words stand in a row."""
        found = [(np.zeros(0, np.int64),) * 3]
        for size, (runs, which) in self.short.items():
            made = chain(hashes, size, size)
            begin = np.flatnonzero(runs_inside(row, size))
            low, high = (np.searchsorted(runs, made[begin], side) for side in ("left", "right"))
            number = high - low
            at = np.arange(int(number.sum())) + np.repeat(low - np.cumsum(number) + number, number)
            begin = np.repeat(begin, number)
            found.append((which[at], begin, begin + size))
        return tuple(np.concatenate(c) for c in zip(*found))


def _passages(words: Words) -> np.ndarray:
    """The passage of each word, numbered through all texts."""
    size = np.diff(words.row)
    number = -(-size // PASSAGE)
    first = np.cumsum(number) - number
    inside = np.arange(len(words.start)) - np.repeat(words.row[:-1], size)
    return np.repeat(first, size) + inside // PASSAGE


def passage_counts(docs: DataFrame, items) -> tuple[np.ndarray, int]:
    """How many passages have each vocabulary word, and how many there are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = items.value, 0
        total = np.zeros(len(block.vocabulary), dtype=np.int64)
        for batch in slices(batches, "text"):
            words = plain_words(batch.column("text"))
            place, passage = block.places(word_hashes(words)), _passages(words)
            number += int(passage[-1]) + 1 if len(passage) else 0
            known = place >= 0
            pair = np.unique(passage[known] * len(total) + place[known])
            total += np.bincount(pair % len(total), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, -1)), pa.array(np.append(total[found], number))], ["word", "n"]
        )

    rows = docs.mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word, n = rows["word"].to_numpy(), rows["n"].to_numpy()
    size = len(items.value.vocabulary)
    out = np.zeros(size, dtype=np.int64)
    out[word[word >= 0]] = n[word >= 0]
    return out, int(n[word < 0].sum())


def word_weights(have: np.ndarray, passages: int) -> np.ndarray:
    """Smooth inverse document frequency of the vocabulary."""
    return np.log1p((passages + 1) / (np.maximum(have, max(COMMON * passages, 1)) + 0.5))


class Sums:
    """Random projection of passages: ``gram`` and ``cross`` of the products."""

    def __init__(self, weight: np.ndarray):
        self.width = RANK + EXTRA
        self.start = np.random.default_rng(11).standard_normal((FEATURES, self.width)).astype(np.float32)
        self.weight = weight
        self.single = np.zeros(FEATURES)
        self.gram, self.cross = np.zeros((self.width, self.width)), np.zeros((self.width, FEATURES))

    def add(self, place: np.ndarray, passage: np.ndarray) -> None:
        """The known words of some passages."""
        if not len(place):
            return
        number = np.bincount(passage)
        alone = number[passage] == 1
        self.single += np.bincount(place[alone] % FEATURES, minlength=FEATURES)
        place, passage = place[~alone], passage[~alone]
        _, passage = np.unique(passage, return_inverse=True)
        for low in range(0, int(passage[-1]) + 1 if len(passage) else 0, 512):
            a, b = np.searchsorted(passage, [low, low + 512])
            high = min(512, int(passage[b - 1]) - low + 1)
            cell = (passage[a:b] - low) * FEATURES + place[a:b] % FEATURES
            rows = np.zeros((high, FEATURES), dtype=np.float32)
            np.add.at(rows.reshape(-1), cell, self.weight[place[a:b]].astype(np.float32))
            length = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
            y = rows @ self.start / length
            self.gram += y.T @ y
            self.cross += (y / length).T @ rows

    def lines(self) -> np.ndarray:
        """Both products, one line for each direction of the basis."""
        counted = self.start.T * self.single
        return np.hstack([self.gram + counted @ self.start, self.cross + counted])


def sums_and_regions(docs: DataFrame, items, weight: np.ndarray, have: np.ndarray) -> DataFrame:
    """The second pass: rows with ``line, bucket, sums`` for the decomposition, and
    rows with ``doc_id, first, hashes``, the regions that may hold an item."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((weight, Regions(items.value, weight, have)))
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + T._parse_datatype_string("first int, hashes binary, line int, bucket int, sums array<double>").fields
    )
    kind = pa.list_(pa.float64())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, finder = shared.value
        block = finder.items
        sums, id_type = Sums(weight), None
        for batch in slices(batches, "text"):
            id_type = batch.column("doc_id").type
            words = plain_words(batch.column("text"))
            hashes = word_hashes(words)
            place, passage = block.places(hashes), _passages(words)
            known = place >= 0
            sums.add(place[known], passage[known])
            doc, begin, end = finder.regions(hashes, place, words.row)
            if len(doc):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc)), pa.array(begin - words.row[doc], pa.int32()),
                     pa.array([hashes[a:b].tobytes() for a, b in zip(begin, end)], pa.binary()),
                     pa.nulls(len(doc), pa.int32()), pa.nulls(len(doc), pa.int32()), pa.nulls(len(doc), kind)],
                    schema.names,
                )
        if id_type is not None:
            lines = sums.lines()
            bucket = zlib.crc32(lines.tobytes()) % 64
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(lines), id_type), pa.nulls(len(lines), pa.int32()), pa.nulls(len(lines), pa.binary()),
                 pa.array(np.arange(len(lines)), pa.int32()), pa.array(np.full(len(lines), bucket), pa.int32()),
                 pa.array(list(lines), kind)],
                schema.names,
            )

    return written(docs.mapInArrow(work, schema), "contamination")


def latent_basis(passed: DataFrame) -> np.ndarray:
    """``FEATURES x RANK``: right singular vectors of the passages' TF-IDF matrix."""
    width = RANK + EXTRA

    def total(group: pa.Table) -> pa.Table:
        sums = np.zeros(width + FEATURES)
        for line in group["sums"]:
            sums += line.values.to_numpy()
        return pa.table(
            {"line": group["line"][:1], "bucket": pa.array([0], pa.int32()),
             "sums": pa.array([sums], pa.list_(pa.float64()))}
        )

    sums = passed.filter(F.col("line").isNotNull()).select("line", "bucket", "sums")
    for keys in (("line", "bucket"), ("line",)):
        sums = sums.groupBy(*keys).applyInArrow(total, "line int, bucket int, sums array<double>")
    lines = sums.toArrow().sort_by("line")  # ``width`` rows, whatever the corpus
    if not lines.num_rows:
        return np.zeros((FEATURES, RANK))
    both = np.stack([x.values.to_numpy() for x in lines["sums"]])
    gram, cross = both[:, :width], both[:, width:]
    value, vector = np.linalg.eigh(gram)
    good = value > 1e-9 * max(value.max(), 1e-30)
    inverse = vector[:, good] / np.sqrt(value[good])
    basis = np.zeros((FEATURES, RANK))
    found = np.linalg.svd(inverse.T @ cross, full_matrices=False)[2][:RANK].T
    basis[:, : found.shape[1]] = found
    return basis


class Regions:
    """Finds the stretches that could carry enough of an item."""

    def __init__(self, items: Items, weight: np.ndarray, have: np.ndarray):
        self.items = items
        lists = [items.places(w) for w in items.words]
        self.size = np.array([len(x) for x in lists], dtype=np.int64)
        #: Words of a stretch.
        self.span = self.size + np.maximum(self.size, MORE_WORDS)
        place = np.concatenate([np.zeros(0, np.int64), *lists])
        item = np.repeat(np.arange(len(lists)), self.size)
        self.mass = np.bincount(item, weight[place], len(lists))
        # The most frequent words first, with all that an item has of the word.
        key, times = np.unique(item * len(weight) + place, return_counts=True)
        item, place = key // len(weight), key % len(weight)
        order = np.lexsort((-have[place], item))
        item, place, heavy = item[order], place[order], (weight[place] * times)[order]
        total = np.cumsum(heavy)
        before = np.append(0.0, total)[np.searchsorted(item, np.arange(len(lists)))]
        untold = total - before[item] <= UNTOLD * self.mass[item]
        #: What telling words must carry for a match; the others are taken as there.
        self.need = (PARAPHRASED - 1e-9) * self.mass - np.bincount(item, np.where(untold, heavy, 0), len(lists))
        # For each word the items that it tells and its weight.
        item, place, times = item[~untold], place[~untold], times[order][~untold]
        order = np.argsort(place, kind="stable")
        self.item, self.share = item[order], weight[place[order]]
        self.most = self.share * times[order]
        self.at = np.searchsorted(place[order], np.arange(len(weight) + 1))

    def stretches(self, place: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """Item, begin, first telling word and end of the stretches in which telling
        words could carry enough; words that are not telling may lead them."""
        known = np.flatnonzero(place >= 0)
        size = self.at[place[known] + 1] - self.at[place[known]]
        known, size = known[size > 0], size[size > 0]
        entry = np.arange(int(size.sum())) + np.repeat(self.at[place[known]] - np.cumsum(size) + size, size)
        word, item = np.repeat(known, size), self.item[entry]
        order = np.argsort(item, kind="stable")
        word, item, entry = word[order], item[order], entry[order]
        total = np.append(0.0, np.cumsum(self.share[entry]))
        text = np.searchsorted(row, word, "right") - 1
        end = np.minimum(word + self.span[item], row[text + 1])
        # One number for item and word, so that all stretches are found at once.
        number = item * (len(place) + 1) + word
        last = np.searchsorted(number, item * (len(place) + 1) + end)
        kept = np.flatnonzero(total[last] - total[:-1] >= self.need[item] - 1e-6)
        kept = kept[self._distinct(kept, last[kept], entry) >= self.need[item[kept]] - 1e-6]
        lead = np.maximum(word - self.size[item], row[text])
        lead[1:] = np.where(item[1:] == item[:-1], np.maximum(lead[1:], word[:-1] + 1), lead[1:])
        return item[kept], lead[kept], word[kept], end[kept]

    def _distinct(self, first: np.ndarray, last: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """What the runs of entries carry at most if a word counts as often as the
        item has it; infinite where a run is too long to be looked at."""
        order = np.argsort(entry, kind="stable")
        before = np.full(len(entry), -1)
        again = entry[order[1:]] == entry[order[:-1]]
        before[order[1:][again]] = order[:-1][again]
        out = np.full(len(first), np.inf)
        size = last - first
        short = np.flatnonzero(size <= LONG_RUN)
        for low in range(0, len(short), 4096):
            run = short[low : low + 4096]
            ends = np.cumsum(size[run])
            at = np.arange(int(ends[-1])) + np.repeat(first[run] - ends + size[run], size[run])
            new = before[at] < np.repeat(first[run], size[run])
            out[run] = np.add.reduceat(np.where(new, self.most[entry[at]], 0.0), ends - size[run])
        return out

    def regions(
        self, hashes: np.ndarray, place: np.ndarray, row: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, begin and end of the runs of words that stretches and short items cover."""
        edge = np.zeros(len(place) + 1, dtype=np.int64)
        _, begin, _, end = self.stretches(place, row)
        _, first, last = self.items.in_a_row(hashes, row)
        begin, end = np.append(begin, first), np.append(end, last)
        np.add.at(edge, begin, 1)
        np.add.at(edge, end, -1)
        inside = np.cumsum(edge)[:-1] > 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = row[:-1][row[:-1] < row[1:]]
        first[starts] = inside[starts]
        begin = np.flatnonzero(first)
        doc = np.searchsorted(row, begin, "right") - 1
        stops = np.append(np.flatnonzero(~inside), len(place))
        end = np.minimum(stops[np.searchsorted(stops, begin)], row[doc + 1])
        return doc, begin, end


def weighted_lcs(item: np.ndarray, weight: np.ndarray, text: np.ndarray) -> float:
    """The largest weight of a common subsequence of words."""
    best = np.zeros(len(text) + 1)
    for word, w in zip(item, weight):
        step = best.copy()
        hit = np.flatnonzero(text == word)
        step[hit + 1] = np.maximum(step[hit + 1], best[hit] + w)
        best = np.maximum.accumulate(step)
    return float(best[-1])


class Searcher(Regions):
    """Compares stretches with the items of a block."""

    def __init__(self, items: Items, weight: np.ndarray, have: np.ndarray, basis: np.ndarray):
        super().__init__(items, weight, have)
        self.weight = weight
        self.vectors = (weight[:, None] * basis[np.arange(len(weight)) % FEATURES]).astype(np.float32)
        self.place = [items.places(w) for w in items.words]
        self.latent = self._unit(np.array([self.vectors[p].sum(0) for p in self.place]).reshape(-1, basis.shape[1]))

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.maximum(np.sqrt((rows**2).sum(1, keepdims=True)), 1e-12)

    def search(self, hashes: np.ndarray) -> Iterator[tuple]:
        """``item_id, first, last, cosine, overlap, answer`` of the best stretch of each
        item found in one region."""
        place, row = self.items.places(hashes), np.array([0, len(hashes)])
        item, first, last = self.items.in_a_row(hashes, row)
        for n in np.unique(item, return_index=True)[1]:
            yield self.items.short_ids[item[n]], int(first[n]), int(last[n]) - 1, 1.0, 1.0, 1.0
        item, begin, word, end = self.stretches(place, row)
        if not len(item):
            return
        known = np.where((place >= 0)[:, None], self.vectors[place], 0).astype(float)
        total = np.vstack([np.zeros((1, known.shape[1])), np.cumsum(known, axis=0)])
        made = total[np.minimum(word + self.size[item], len(hashes))] - total[word]
        cosine = (self._unit(made) * self.latent[item]).sum(1)
        starts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        for a, b in zip(starts, np.append(starts[1:], len(item))):
            tried = a + np.argsort(-cosine[a:b], kind="stable")
            hit = self._first_match(hashes, int(item[a]), begin[tried], end[tried], cosine[tried])
            if hit:
                yield self.items.ids[item[a]], *hit

    def _first_match(self, hashes: np.ndarray, n: int, begin, end, cosine) -> tuple | None:
        item, weight = self.items.words[n], self.weight[self.place[n]]
        for first, last, near in zip(begin.tolist(), end.tolist(), cosine.tolist()):
            text = hashes[first:last]
            if weight[np.isin(item, text)].sum() < (PARAPHRASED - 1e-9) * self.mass[n]:
                continue
            overlap = weighted_lcs(item, weight, text) / self.mass[n]
            tail, heavy = item[-ANSWER_WORDS:], weight[-ANSWER_WORDS:]
            answer = weighted_lcs(tail, heavy, text) / float(heavy.sum())
            if overlap >= COPIED or (overlap >= PARAPHRASED and answer >= ANSWERED):
                return first, last - 1, near, overlap, answer
        return None


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, first_word, last_word, cosine, overlap, answer``: one row
    for each benchmark item found in a region of a document.

    Words are compared in lower case and without marks at their ends.  NULL and
    empty texts match nothing; an empty benchmark or corpus gives an empty result.
    Items of fewer than ``LEAST_WORDS`` words match word for word only.  Repeated rows of either
    side are found as often as they are there.  Whole texts are searched.  Other
    columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(named(doc_id).alias("doc_id"), named(text).cast("string").alias("text"))
    asked = benchmark.select(named(item_id).alias("item_id"), named(item_text).cast("string").alias("text"))
    id_types = [rows.schema["doc_id"].dataType.simpleString(), asked.schema["item_id"].dataType.simpleString()]
    schema = (
        f"doc_id {id_types[0]}, item_id {id_types[1]}, first_word int, last_word int,"
        " cosine double, overlap double, answer double"
    )
    out = spark.createDataFrame([], schema)
    blocks = -(-asked.count() // BLOCK_ITEMS)
    for n in range(blocks):
        block = Items.of(asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).toArrow())
        if block.ids or block.short_ids:
            out = out.unionByName(_search_block(rows, block, schema))
    return out


def _search_block(rows: DataFrame, block: Items, schema: str) -> DataFrame:
    spark = rows.sparkSession
    items = spark.sparkContext.broadcast(block)
    have, number = passage_counts(rows.select("text"), items)
    weight = word_weights(have, number)
    passed = sums_and_regions(rows, items, weight, have)
    searcher = spark.sparkContext.broadcast(Searcher(block, weight, have, latent_basis(passed)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = searcher.value
        for batch in batches:
            hits = []
            for n, (first, hashes) in enumerate(zip(batch.column("first").to_pylist(), batch.column("hashes"))):
                for item, a, b, *marks in own.search(np.frombuffer(hashes.as_buffer(), np.uint64)):
                    hits.append((n, item, first + a, first + b, *marks))
            if not hits:
                continue
            row, item, first, last, cosine, overlap, answer = zip(*hits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(item),
                 pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(cosine), pa.array(overlap),
                 pa.array(answer)],
                ["doc_id", "item_id", "first_word", "last_word", "cosine", "overlap", "answer"],
            )

    return passed.filter(F.col("hashes").isNotNull()).select("doc_id", "first", "hashes").mapInArrow(work, schema)
