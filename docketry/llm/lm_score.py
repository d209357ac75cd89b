"""Language-model scores from a log-frequency Bloom filter.

1. Token counts over the whole training corpus, exact.  Tokens from a threshold
   on, set so that at most ``MOST_FREQUENT`` reach it, are broadcast with their
   counts.  The others, a small share of the text, are looked up by a join.
2. N-gram counts over the whole training corpus.  They are packed per batch and
   dealt by hash into parts; a part is counted in one task, and the number of
   parts grows with the corpus, so that a part stays small.
3. Each part becomes one piece of a log-frequency Bloom filter: an n-gram with
   count c is entered once for each level 1 .. 1 + log2(c), those seen once
   included.  Probing levels upwards until one is missing gives the level and so
   the count, within its rounding.  A piece has ``BITS`` for each entry, so the
   filter grows with the n-grams and none is left out.
4. Probability of a word: a mixture of the share of its n-gram in the count of
   its history and the probability with a shorter history, down to the smoothed
   token share.  The weight of the shorter history is the mass of the n-grams
   seen once (Good-Turing): for pairs measured by how frequent the history is, for
   longer ones dealt to the histories as k / (k + count).  Shares of one history
   sum to one at most, up to the rounding of the counts.
5. The filter stays in its pieces, at every size: the n-grams of each batch are
   dealt to the pieces by hash, which answer all probes, and their levels come
   back to the batch.  Batches are cut from the input each time they are needed,
   so no second copy of the texts is written; they meet their levels compressed.

Tokens and n-grams go by 64-bit hashes of their bytes, inside a part by 32 bits of
them.  Keys are sent sorted, as differences in byte planes of which the upper
ones are compressed; the count of an n-gram is sent where it is not one.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docketry.llm.frames import named, slices, small_batches, written
from docketry.llm.words import Words, chain, cut_words, mix, word_hashes

#: Longest n-gram.
ORDER = 3
#: Bits of the filter for each n-gram entered, and for each further level of it.
BITS, LEVEL_BITS = 16, 4
#: Hash functions of a level; the first level takes more, as it decides whether an n-gram is known.
PROBES_FIRST, PROBES = 4, 2
#: Most tokens whose counts are broadcast.
MOST_FREQUENT = 1 << 19
#: Bytes of the corpus for one part of the counting.
PART_BYTES = 4 << 20
#: Distinct tokens that a task holds before it hands them on.
HELD = 1 << 20
#: Hash of the token that ends a text; no word has it but by chance.
END = np.uint64(0x5851F42D4C957F2D)
#: Class of histories (log2 of the count) whose count is not broadcast.
RARE = 0
CLASSES = 64
#: What the pieces count, 256 places each.
SUMS = ("mass", "again", "grams", "occurrences")


def tokens_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and where each text begins."""
    row = words.row + np.arange(len(words.row))
    out = np.empty(int(row[-1]), dtype=np.uint64)
    last = np.zeros(len(out), dtype=bool)
    last[row[1:] - 1] = True
    out[last] = END
    out[~last] = word_hashes(words)
    return out, row


def grams(tokens: np.ndarray, row: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram inside a text and the number of its last token."""
    runs = chain(tokens, order, order)
    owner = np.repeat(np.arange(len(row) - 1), np.diff(row))
    inside = owner[: len(runs)] == owner[order - 1 :]
    return runs[inside], np.flatnonzero(inside) + order - 1


@dataclass(frozen=True)
class Counts:
    """Tokens with broadcast counts, sorted by hash, and the totals."""

    tokens: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Counts of the tokens, 0 where not listed."""
        if not len(self.tokens):
            return np.zeros(len(tokens), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.counts[at], 0)

    def share(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.distinct + 1))


def history_class(counts: np.ndarray) -> np.ndarray:
    """1 + log2 of a history's count; ``RARE`` where it is not known."""
    return np.where(counts > 0, np.frexp(np.maximum(counts, 1))[1], RARE)


def _packs(hashes: np.ndarray, parts: int, *columns: np.ndarray) -> pa.RecordBatch:
    """``part, pack``: each part's columns, one after the other."""
    part = hashes % np.uint64(parts)
    turn = np.argsort(part, kind="stable")
    where = np.searchsorted(part[turn], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(where))
    columns = [c[turn] for c in columns]
    blobs = [b"".join(c[where[p] : where[p + 1]].tobytes() for c in columns) for p in full]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int64()), pa.array(blobs, pa.binary())], ["part", "pack"]
    )


def _unpack(packs: pa.ChunkedArray, *kinds: str) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    out = [[] for _ in kinds]
    for pack in packs:
        blob, at = pack.as_buffer(), 0
        size = blob.size // width
        for n, kind in enumerate(kinds):
            out[n].append(np.frombuffer(blob, dtype=kind, count=size, offset=at))
            at += size * np.dtype(kind).itemsize
    return [np.concatenate(c) for c in out]


def part_key(gram: np.ndarray) -> np.ndarray:
    """The 32 bits of an n-gram's hash that tell it from others of its part."""
    return gram >> np.uint64(32)


def _part_of(gram: np.ndarray, parts: int) -> np.ndarray:
    """The part of each n-gram, in as few bits as hold it, which sort faster."""
    return (gram % np.uint64(parts)).astype(np.min_scalar_type(parts))


def encode_keys(key: np.ndarray, times: np.ndarray, kind: np.ndarray) -> bytes:
    """Keys with count and class as bytes, in the order of single or not, class, key."""
    many = times > 1
    # One number for class and key sorts both; single ones carry nothing else.
    code = kind.astype(np.int64) << 32 | key.astype(np.int64)
    alone, others = np.sort(code[~many]), code[many]
    order = np.argsort(others, kind="stable")
    code = np.concatenate([alone, others[order] | 1 << 40])
    key, group = code & 0xFFFFFFFF, code >> 32
    first = np.flatnonzero(np.diff(group, prepend=-1))
    gap = np.diff(key, prepend=0)
    gap[first] = key[first]
    planes = gap.astype("<u4").view(np.uint8).reshape(-1, 4).T
    upper = pa.compress(planes[2:].tobytes(), codec="zstd", asbytes=True)
    count = pa.compress(times[many][order].astype("<u4").tobytes() or b"\0", codec="zstd", asbytes=True)
    head = np.array([len(key), len(first), len(upper)], dtype="<u4")
    groups = np.concatenate([group[first], np.diff(first, append=len(key))]).astype("<u4")
    return b"".join([head.tobytes(), groups.tobytes(), planes[:2].tobytes(), upper, count])


def decode_keys(pack: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, count and class of each, as :func:`encode_keys` ordered them."""
    size, groups, upper = np.frombuffer(pack, dtype="<u4", count=3).tolist()
    at = 12 + 8 * groups
    group, members = np.frombuffer(pack, dtype="<u4", count=2 * groups, offset=12).astype(np.int64).reshape(2, -1)
    planes = np.empty((4, size), dtype=np.uint8)
    planes[:2] = np.frombuffer(pack, dtype=np.uint8, count=2 * size, offset=at).reshape(2, -1)
    at += 2 * size
    packed = pa.decompress(pack.slice(at, upper), decompressed_size=2 * size, codec="zstd")
    planes[2:] = np.frombuffer(packed, dtype=np.uint8).reshape(2, -1)
    key = np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))
    first = np.cumsum(members) - members
    base = np.concatenate([[0], key])[first]
    key -= np.repeat(base, members)
    each = np.repeat(group, members)
    times = np.ones(size, dtype=np.int64)
    many = int(members[group >= 256].sum())
    if many:
        packed = pa.decompress(pack.slice(at + upper), decompressed_size=4 * many, codec="zstd")
        times[each >= 256] = np.frombuffer(packed, dtype="<u4")
    return key.astype(np.uint64), times, (each % 256).astype(np.uint8)


def _gram_packs(gram: np.ndarray, parts: int, times: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    """``part, pack``: the n-grams of each part."""
    part = _part_of(gram, parts)
    turn = np.argsort(part, kind="stable")
    where = np.searchsorted(part[turn], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(where))
    key, times, kind = part_key(gram)[turn], times[turn], kind[turn]
    cut = [slice(where[p], where[p + 1]) for p in full]
    packs = [encode_keys(key[c], times[c], kind[c]) for c in cut]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(packs, pa.binary())], ["part", "pack"])


def pack_texts(texts: pa.Array) -> bytes:
    """The texts of a batch, compressed better than the shuffle does by itself."""
    sink = pa.BufferOutputStream()
    rows = pa.RecordBatch.from_arrays([texts], ["text"])
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpack_texts(pack: pa.Scalar) -> pa.Array:
    """The texts that :func:`pack_texts` took."""
    return pa.ipc.open_stream(pack.as_buffer()).read_next_batch().column(0)


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Which of sorted values differ from the one before.  A sort and this are much
    faster than ``np.unique`` on numbers of 64 bits, and need less memory."""
    first = np.ones(len(ordered), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return first


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of their counts, a row of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first), order[first]


def token_counts(train: DataFrame, parts: int) -> DataFrame:
    """``token, count`` from ``text``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in slices(batches, "text"):
            value, times = np.unique(
                tokens_of(cut_words(batch.column("text"), lower=True))[0], return_counts=True
            )
            token, count, _ = _summed(np.append(token, value), np.append(count, times))
            if len(token) > HELD:
                yield _packs(token, parts, token, count)
                token, count = token[:0], count[:0]
        if len(token):
            yield _packs(token, parts, token, count)

    def total(group: pa.Table) -> pa.Table:
        token, count, _ = _summed(*_unpack(group["pack"], "<u8", "<i8"))
        return pa.table({"token": token.view(np.int64), "count": count})

    packs = train.mapInArrow(work, "part long, pack binary")
    return packs.groupBy("part").applyInArrow(total, "token long, count long")


def frequent(counts: DataFrame) -> tuple[Counts, int]:
    """The tokens that are broadcast, at most ``MOST_FREQUENT``, and the least
    count among them."""
    size = F.floor(F.log2("count"))
    sizes = counts.groupBy(size.alias("size")).agg(
        F.count("*").alias("v"), F.sum("count").alias("n")
    ).orderBy(F.desc("size")).collect()  # at most 63 rows
    total, distinct, least, held = 0, 0, 1 << 62, 0
    for row in sizes:
        total, distinct = total + row["n"], distinct + row["v"]
        held += row["v"]
        if held <= MOST_FREQUENT:
            least = 1 << row["size"]
    rows = counts.filter(F.col("count") >= least).toArrow()
    token = rows["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    return Counts(token[order], rows["count"].to_numpy()[order], total, distinct), least


def gram_packs(train: DataFrame, broadcast, parts: int, order: int) -> DataFrame:
    """``part, pack``: n-grams with count and class, packed by part.

    The class holds the order and, for pairs, how frequent the history is.
    Single tokens are there only where their count is not broadcast.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = broadcast.value
        for batch in slices(batches, "text"):
            tokens, row = tokens_of(cut_words(batch.column("text"), lower=True))
            seen = known.of(tokens)
            found = []
            for n in range(1, order + 1):
                gram, last = grams(tokens, row, n)
                if n == 1:
                    gram, last = gram[seen == 0], last[seen == 0]
                gram, first, times = np.unique(gram, return_index=True, return_counts=True)
                kind = np.full(len(gram), n - 1, dtype=np.uint8) * CLASSES
                if n == 2:
                    kind += history_class(seen[last[first] - 1]).astype(np.uint8)
                found.append((gram, times.astype(np.uint32), kind))
            gram, times, kind = (np.concatenate(c) for c in zip(*found))
            yield _gram_packs(gram, parts, times, kind)

    return train.mapInArrow(work, "part long, pack binary")


def probes(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Start and stride of the bit positions of an n-gram at a level, and their number."""
    one = mix(key + np.uint64(level * 0xD1342543DE82EF95 % 2**64))
    return one, (one >> np.uint64(32)) | np.uint64(1), PROBES_FIRST if level == 1 else PROBES


def piece_of_filter(key: np.ndarray, level: np.ndarray, bits: int) -> np.ndarray:
    """One piece, in which each n-gram is entered once for each level up to its own."""
    field = np.zeros(bits, dtype=bool)
    for step in range(1, int(level.max(initial=0)) + 1):
        one, two, times = probes(key[level >= step], step)
        for k in range(times):
            field[((one + np.uint64(k) * two) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(field)


def filter_pieces(packs: DataFrame) -> DataFrame:
    """``part, field, bits``; by class the ``mass`` of the n-grams and that of those
    seen ``again``; by order and level how many n-grams and occurrences there are."""

    def work(group: pa.Table) -> pa.Table:
        key, times, kind = (np.concatenate(c) for c in zip(*[decode_keys(p.as_buffer()) for p in group["pack"]]))
        key, count, row = _summed(key, times)
        del times
        kind = kind[row].astype(np.int64)
        level = np.frexp(count)[1]  # 1 for 1, 2 for 2 and 3, 3 for 4 to 7, ...
        bits = 64 + BITS * len(key) + LEVEL_BITS * int((level - 1).sum())
        field = piece_of_filter(key, level, bits)
        again, place = count > 1, kind // CLASSES * CLASSES + level
        sums = [
            np.bincount(kind, count, 256),
            np.bincount(kind[again], count[again], 256),
            np.bincount(place, minlength=256),
            np.bincount(place, count, 256),
        ]
        return pa.table(
            {"part": group["part"][:1], "field": pa.array([field.tobytes()], pa.binary()),
             "bits": pa.array([bits], pa.int64())}
            | {n: pa.array([x.astype(float)], pa.list_(pa.float64())) for n, x in zip(SUMS, sums)}
        )

    arrays = ", ".join(f"{n} array<double>" for n in SUMS)
    return packs.groupBy("part").applyInArrow(work, f"part long, field binary, bits long, {arrays}")


def levels_of(key: np.ndarray, flat: np.ndarray, begin: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The level up to which each n-gram is a member of its piece, which begins at
    a byte of ``flat`` and has some bits."""
    level = np.zeros(len(key), dtype=np.int64)
    active = np.arange(len(key))
    bits = np.asarray(bits, dtype=np.uint64)
    for step in range(1, CLASSES):
        one, two, times = probes(key[active], step)
        for k in range(times):
            at = ((one + np.uint64(k) * two) % bits[active]).astype(np.int64)
            byte = flat[begin[active] + (at >> 3)]
            hit = (byte >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            active, one, two = active[hit], one[hit], two[hit]
        if not len(active):
            break
        level[active] = step
    return level


@dataclass(frozen=True)
class Model:
    """All that scoring needs but the pieces of the filter."""

    known: Counts
    parts: int
    mean: np.ndarray  # mean count by level
    shorter: np.ndarray  # weight of the shorter history by class
    order: int
    spare: np.ndarray  # k of the longer histories by order

    def meant(self, level: np.ndarray) -> np.ndarray:
        """Mean count of the level up to which an n-gram is a member, else 0."""
        return np.where(level > 0, self.mean[np.minimum(level, CLASSES - 1)], 0.0)

    def asked(self, tokens: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
        """The n-grams whose counts may be needed, by order; of single tokens those
        without a broadcast count."""
        rare = tokens[self.known.of(tokens) == 0]
        return [chain(rare, 1, 1), *(grams(tokens, row, n)[0] for n in range(2, self.order + 1))]

    def log_probabilities(self, tokens: np.ndarray, row: np.ndarray, counts: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of each token after those before it; ``counts``
        are those of the n-grams that :meth:`asked` lists."""
        seen = self.known.of(tokens)
        count = seen.astype(float)
        count[seen == 0] = counts[0]
        p = self.known.share(count)
        history, kind = count, history_class(seen)
        inside = np.arange(len(tokens)) - np.repeat(row[:-1], np.diff(row))  # place in the text
        for n in range(2, self.order + 1):
            last = np.flatnonzero(inside >= n - 1)
            before = history[last - 1]
            # An n-gram is a member only if its history is.
            asked = before > 0
            last, before = last[asked], before[asked]
            found = np.minimum(counts[n - 1][asked] / before, 1.0)
            if n == 2:
                weight = self.shorter[CLASSES + kind[last - 1]]
            else:
                weight = np.clip(self.spare[n] / (self.spare[n] + before), 0.02, 1)
            p[last] = (1 - weight) * found + weight * p[last]
            history = np.zeros(len(tokens))
            history[last] = found * before
        return np.log10(p)


def _spare(once: float, grams_: np.ndarray, times: np.ndarray) -> float:
    """The k with which k / (k + count) of all histories' mass is what was seen once."""
    mean = times / np.maximum(grams_, 1)
    low, high = 1e-6, 1e12
    for _ in range(100):
        k = (low * high) ** 0.5
        low, high = (k, high) if (times * k / (k + mean)).sum() < once else (low, k)
    return (low * high) ** 0.5


def fit(train: DataFrame, order: int = ORDER) -> tuple[Model, DataFrame, int, DataFrame]:
    """The model of the texts, all token counts, the least count broadcast, and the
    pieces of the filter."""
    spark = train.sparkSession
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // PART_BYTES + 1
    counts = written(token_counts(train, parts), "lm-tokens")
    known, least = frequent(counts)
    broadcast = spark.sparkContext.broadcast(known)
    pieces = written(filter_pieces(gram_packs(train, broadcast, parts, order)), "lm-filter")
    # 1024 sums, whatever the corpus.
    row = pieces.agg(
        *[F.array(*[F.sum(F.col(n)[k]) for k in range(256)]).alias(n) for n in SUMS],
    ).first()
    mass, again, grams_, times = (np.array([x or 0.0 for x in row[n]]) for n in SUMS)
    by_order = [x.reshape(-1, CLASSES) for x in (grams_, times)]
    level_grams, level_times = (x.sum(0) for x in by_order)
    mean = np.where(level_grams > 0, level_times / np.maximum(level_grams, 1), 0.75 * 2.0 ** np.arange(CLASSES))
    shorter = np.ones(256)
    pairs = slice(CLASSES, 2 * CLASSES)
    shorter[pairs] = np.where(mass[pairs] > 0, 1 - again[pairs] / np.maximum(mass[pairs], 1), 1)
    shorter = np.clip(shorter, 0.02, 1)
    spare = np.ones(order + 1)
    for n in range(3, order + 1):
        once = mass[(n - 1) * CLASSES] - again[(n - 1) * CLASSES]
        spare[n] = _spare(once, by_order[0][n - 2], by_order[1][n - 2])
    return Model(known, parts, mean, shorter, order, spare), counts, least, pieces


def dealt_levels(batches: DataFrame, pieces: DataFrame, broadcast) -> DataFrame:
    """``batch, part, levels``: of each batch's n-grams in a part, in their order."""
    parts = broadcast.value.parts

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in rows:
            for n in range(batch.num_rows):
                tokens, row = tokens_of(cut_words(unpack_texts(batch.column("texts")[n]), lower=True))
                gram = np.sort(np.concatenate(model.asked(tokens, row)))
                gram = gram[_firsts(gram)]
                pack = _gram_packs(gram, parts, np.ones(len(gram), np.int64), np.zeros(len(gram), np.uint8))
                number = pa.array(np.full(pack.num_rows, batch.column("batch")[n].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([number, *pack.columns], ["batch", "part", "pack"])

    def look_up(asked: pa.Table, piece: pa.Table) -> pa.Table:
        levels = []
        for pack in asked["pack"]:
            key = decode_keys(pack.as_buffer())[0]
            level = np.zeros(len(key), dtype=np.int64)
            if piece.num_rows:
                flat = np.frombuffer(piece["field"][0].as_buffer(), dtype=np.uint8)
                bits = np.full(len(key), piece["bits"][0].as_py(), dtype=np.uint64)
                level = levels_of(key, flat, np.zeros(len(key), dtype=np.int64), bits)
            levels.append(pa.compress(level.astype(np.uint8).tobytes(), codec="zstd", asbytes=True))
        return pa.table({"batch": asked["batch"], "part": asked["part"], "levels": pa.array(levels, pa.binary())})

    asked = batches.select("batch", "texts").mapInArrow(deal, "batch long, part long, pack binary")
    answers = asked.groupBy("part").cogroup(pieces.select("part", "field", "bits").groupBy("part"))
    return answers.applyInArrow(look_up, "batch long, part long, levels binary")


def score_texts(
    docs: DataFrame, in_training: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER
) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    ``in_training`` (over ``doc_id`` and ``text``) chooses the rows learnt from.
    Tokens are words in lower case (A-Z) and one end a text; NULL and empty
    texts are their end alone.  ``base_score`` smooths single tokens, ``score``
    is the model's log10 probability.  Without any training text every token has
    probability one.  Rows come back as often as they are there, other columns
    are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(named(doc_id).alias("doc_id"), named(text).cast("string").alias("text"))
    model, counts, least, pieces = fit(rows.filter(in_training).select("text"), order)
    broadcast = spark.sparkContext.broadcast(model)
    schema = (
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, "
        "base_score double, score double, others array<long>"
    )

    def scores(ids: pa.Array, texts: pa.Array, level_of) -> pa.RecordBatch:
        model = broadcast.value
        tokens, row = tokens_of(cut_words(texts, lower=True))
        seen = model.known.of(tokens)
        base = np.add.reduceat(np.log10(model.known.share(seen)), row[:-1])
        asked = model.asked(tokens, row)
        ends = np.cumsum([len(a) for a in asked])[:-1]
        asked = np.concatenate(asked)
        order = np.argsort(asked)
        gram = asked[order]
        first = _firsts(gram)
        found = level_of(gram[first])
        level = np.empty(len(asked), dtype=np.uint8)
        level[order] = found[np.cumsum(first, dtype=np.int32) - 1] if len(found) else 0
        del asked, order, gram, first
        made = model.log_probabilities(tokens, row, [model.meant(x) for x in np.split(level, ends)])
        score = np.add.reduceat(made, row[:-1])
        other = seen == 0
        at = np.concatenate([[0], np.cumsum(other)])[row]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.diff(row)),
             pa.array(np.add.reduceat((~other).astype(np.int64), row[:-1])),
             pa.array(base), pa.array(score),
             pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens[other].view(np.int64)))],
            ["doc_id", "n_tokens", "n_known", "base_score", "score", "others"],
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id"))
            texts = pa.array([pack_texts(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, texts], ["doc_id", "texts"])

    def put_together(batch: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = batch["doc_id"].combine_chunks()[0].values, unpack_texts(batch["texts"][0])

        def level_of(gram: np.ndarray) -> np.ndarray:
            model, level = broadcast.value, np.zeros(len(gram), dtype=np.uint8)
            part = _part_of(gram, model.parts)
            turn = np.argsort(part, kind="stable")
            size = np.bincount(part, minlength=model.parts)
            found = answers.sort_by("part")
            each = [
                pa.decompress(x.as_buffer(), decompressed_size=int(size[p]), codec="zstd")
                for p, x in zip(found["part"].to_pylist(), found["levels"])
            ]
            if each:
                level[turn] = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in each])
            return level

        return pa.Table.from_batches([scores(ids, texts, level_of)])

    kind = rows.schema["doc_id"].dataType.simpleString()
    # The scan cuts the same batches each time, so their numbers agree.
    batches = rows.mapInArrow(gather, f"doc_id array<{kind}>, texts binary")
    batches = batches.withColumn("batch", F.monotonically_increasing_id())
    answers = dealt_levels(batches, pieces, broadcast)
    scored = batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(put_together, schema)
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    # Tokens without a broadcast count were taken as unknown; those that are in
    # the corpus after all are put right here.
    rare = counts.filter(F.col("count") < least)
    gain = F.log10(F.col("count") + F.lit(0.5)) - F.log10(F.lit(0.5))
    right = (
        scored.select("row", F.explode("others").alias("token"))
        .join(rare, "token")
        .groupBy("row")
        .agg(F.count("*").alias("more"), F.sum(gain).alias("gain"))
    )
    return scored.join(right, "row", "left").select(
        "doc_id", "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.known.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        "score",
    )
