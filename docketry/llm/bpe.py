"""BPE encoding by speculation and verification, and decoding.

Encoding works on distinct words.  A greedy longest match proposes the tokens
of every piece of a word.  A token sequence is what BPE merging gives exactly
when every two neighbours, merged on their own, stay as they are, so the
proposals of a whole batch are verified together: their neighbour pairs are
looked up as numbers in one array of verdicts.  Only pieces with a failing pair
are merged exactly.  Verdicts of pairs are computed once per worker by exact
merging of the two tokens.

The vocabulary is a published file and is broadcast; its size does not depend
on the data.  A worker remembers the ids of words as packed arrays by word hash,
verdicts of pairs likewise, and pieces, each up to a fixed number of bytes; then
that memory is emptied.  It changes the time, never the result.
"""

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from docketry.llm.frames import named, slices, small_batches
from docketry.llm.words import cut_words, word_hashes

#: Bytes of remembered words, and of pairs with their verdicts.
WORD_BYTES, PAIR_BYTES = 32 << 20, 8 << 20
#: Letters and tokens of remembered pieces; as Python objects about 40 bytes each.
PIECE_UNITS = 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    """What the tokenizer file says; small and of fixed size."""

    token_ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    special: dict[str, int]
    pattern: str
    end: str
    key: str  # hash of the file

    @staticmethod
    def read(path: str) -> "Vocabulary":
        """A ``tokenizers`` file with NFC, lower case, a split pattern whose
        matches are kept, byte letters and an end-of-word mark."""
        with open(path, "rb") as file:
            content = file.read()
        spec = json.loads(content)
        model = spec["model"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
            raise ValueError("the tokenizer file is of another kind")
        return Vocabulary(
            model["vocab"],
            {tuple(pair): rank for rank, pair in enumerate(model["merges"])},
            {t["content"]: t["id"] for t in spec["added_tokens"]},
            split["pattern"]["Regex"],
            model["end_of_word_suffix"] or "",
            hashlib.sha256(content).hexdigest(),
        )

    def tokens(self) -> list[str]:
        """Token text by id; ids without a token are empty."""
        size = max([*self.token_ids.values(), *self.special.values()], default=-1) + 1
        names = [""] * size
        for text, number in (self.token_ids | self.special).items():
            names[number] = text
        return names


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 letters stand for
    themselves, the others for the letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Merger:
    """Exact BPE over token ids: again and again the leftmost pair of the lowest rank."""

    NONE = 1 << 60
    #: Pieces up to this length are scanned for the lowest rank, longer ones keep a queue.
    SCANNED = 128

    def __init__(self, vocabulary: Vocabulary):
        ids = vocabulary.token_ids
        self.made = [0] * len(vocabulary.ranks)
        self.rank = {}
        for (left, right), rank in vocabulary.ranks.items():
            self.made[rank] = ids[left + right]
            self.rank[ids[left] << 32 | ids[right]] = rank

    def __call__(self, ids: list[int]) -> list[int]:
        return self._scan(list(ids)) if len(ids) <= self.SCANNED else self._queue(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        get, none = self.rank.get, self.NONE
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            at = ranks.index(low)
            ids[at : at + 2] = [self.made[low]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 32 | ids[at], none)
            if at < len(ranks):
                ranks[at] = get(ids[at] << 32 | ids[at + 1], none)
        return ids

    def _queue(self, ids: list[int]) -> list[int]:
        parts: list[int | None] = list(ids)
        size, get = len(parts), self.rank.get
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        queue = []

        def offer(at: int) -> None:
            key = parts[at] << 32 | parts[after[at]]
            rank = get(key)
            if rank is not None:
                heapq.heappush(queue, (rank, at, key))

        for at in range(size - 1):
            offer(at)
        while queue:
            rank, at, key = heapq.heappop(queue)
            then = after[at]
            if parts[at] is None or then >= size or parts[at] << 32 | parts[then] != key:
                continue
            parts[at], parts[then] = self.made[rank], None
            after[at] = after[then]
            if after[at] < size:
                before[after[at]] = at
                offer(at)
            if before[at] >= 0:
                offer(before[at])
        return [p for p in parts if p is not None]


class Remembered:
    """Ids of words by word hash, in sorted arrays."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.keys, self.starts = np.zeros(0, np.uint64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """New keys with their ids, one after the other."""
        if self.keys.nbytes + self.starts.nbytes + self.ids.nbytes > WORD_BYTES:
            self.forget()
        keys = np.concatenate([self.keys, keys])
        sizes = np.concatenate([np.diff(self.starts), sizes])
        ids = np.concatenate([self.ids, ids])
        order = np.argsort(keys, kind="stable")
        self.ids = ids[_ranges((np.cumsum(sizes) - sizes)[order], sizes[order])]
        self.keys, self.starts = keys[order], np.concatenate([[0], np.cumsum(sizes[order])])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Encoder:
    """Encodes words; one per worker."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.names = v.tokens()
        self.size = len(self.names)
        self.letters = byte_letters()
        self.table = str.maketrans({chr(b): letter for b, letter in enumerate(self.letters)})
        self.merge = Merger(v)
        # Tokens of one length and beginning: a proposal looks only at lengths that exist.
        reach: dict[str, set[int]] = {}
        for token in v.token_ids:
            reach.setdefault(token[:2], set()).add(len(token.removesuffix(v.end)) or len(token))
        self.lengths = {k: sorted(x, reverse=True) for k, x in reach.items()}
        self.split = regex.compile(v.pattern, regex.V0)
        self.specials = (
            regex.compile("(" + "|".join(map(regex.escape, v.special)) + ")") if v.special else None
        )
        self.pairs, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.piece_ids: dict[str, tuple[int, ...]] = {}
        self.piece_units = 0
        self.known = Remembered()
        self.exact = 0  # pieces that needed exact merging

    def pieces(self, word: str) -> list[str | int]:
        """The pieces of a word in byte letters; special tokens as ids."""
        if word.isascii():
            # The pattern keeps letters together and a mark at the end apart.
            if word.isalpha():
                return [word.lower()]
            if word[-1] in ".,;:!?" and word[:-1].isalpha():
                return [word[:-1].lower(), word[-1]]
        elif word.isalpha() and "Σ" not in word and unicodedata.is_normalized("NFC", word):
            low = word.lower()
            if low.isalpha():
                return [low.encode().decode("latin-1").translate(self.table)]
        found: list[str | int] = []
        parts = self.specials.split(word) if self.specials else [word]
        for n, part in enumerate(parts):
            if n % 2:
                found.append(self.vocabulary.special[part])
            elif part:
                if not part.isascii():
                    # Lower case goes letter by letter, without the rule for a last sigma.
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                for piece in self.split.findall(part.lower()):
                    found.append(piece.encode().decode("latin-1").translate(self.table))
        return found

    def symbols(self, piece: str) -> list[int]:
        ids = self.vocabulary.token_ids
        return [*map(ids.__getitem__, piece[:-1]), ids[piece[-1] + self.vocabulary.end]]

    def propose(self, piece: str) -> list[int]:
        """Greedy longest match."""
        ids, end, n, at, out = self.vocabulary.token_ids, self.vocabulary.end, len(piece), 0, []
        while at < n:
            known = self.lengths.get(piece[at : at + 2], ())
            for size in (*known, 1):
                stop = at + size
                if stop < n:
                    token = ids.get(piece[at:stop])
                elif stop == n:
                    token = ids.get(piece[at:] + end)
                else:
                    continue
                if token is not None:
                    out.append(token)
                    at = stop
                    break
            else:
                raise ValueError(f"no token for {piece[at]!r}")
        return out

    def _token_symbols(self, token: int) -> list[int]:
        name, end = self.names[token], self.vocabulary.end
        if end and name.endswith(end) and len(name) > len(end):
            return self.symbols(name.removesuffix(end))
        return [self.vocabulary.token_ids[letter] for letter in name]

    def _stays(self, key: int) -> bool:
        """Whether a pair (or, with second part ``size``, a single token) merges to itself."""
        left, right = divmod(key, self.size + 1)
        tokens = [left] if right == self.size else [left, right]
        return self.merge([s for t in tokens for s in self._token_symbols(t)]) == tokens

    def verify(self, proposals: list[list[int]]) -> np.ndarray:
        """For each proposal whether it is what merging gives."""
        sizes = np.fromiter(map(len, proposals), dtype=np.int64, count=len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        last = np.ones(len(flat), dtype=bool)
        last[:-1] = owner[1:] != owner[:-1]
        first = np.ones(len(flat), dtype=bool)
        first[1:] = last[:-1]
        right = np.roll(flat, -1)
        right[last] = self.size
        asked = ~last | first  # all neighbours, and tokens that stand alone
        keys = flat[asked] * (self.size + 1) + right[asked]
        distinct, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.pairs, distinct)
        new = np.ones(len(distinct), dtype=bool)
        if len(self.pairs):
            new = self.pairs[np.minimum(at, len(self.pairs) - 1)] != distinct
        verdict = np.empty(len(distinct), dtype=bool)
        verdict[~new] = self.pair_ok[at[~new]]
        verdict[new] = [self._stays(key) for key in distinct[new].tolist()]
        if self.pairs.nbytes + self.pair_ok.nbytes > PAIR_BYTES:
            self.pairs, self.pair_ok = distinct, verdict
        else:
            self.pair_ok = np.insert(self.pair_ok, at[new], verdict[new])
            self.pairs = np.insert(self.pairs, at[new], distinct[new])
        good = np.ones(len(sizes), dtype=bool)
        good[owner[asked][~verdict[back]]] = False
        return good

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word."""
        if self.piece_units > PIECE_UNITS:
            self.piece_ids, self.piece_units = {}, 0
        ids = self.piece_ids
        cut = [self.pieces(w) for w in words]
        new = list({p for c in cut for p in c if isinstance(p, str) and p not in ids})
        proposals = [self.propose(p) for p in new]
        for piece, tokens, good in zip(new, proposals, self.verify(proposals).tolist()):
            if not good:
                self.exact += 1
                tokens = self.merge(self.symbols(piece))
            ids[piece] = tuple(tokens)
            self.piece_units += len(piece) + len(tokens) + 4
        return [
            ids[parts[0]] if len(parts) == 1 and isinstance(parts[0], str)
            else tuple(t for p in parts for t in (ids[p] if isinstance(p, str) else (p,)))
            for parts in cut
        ]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin."""
        words = cut_words(texts)
        keys, first, back = np.unique(word_hashes(words), return_index=True, return_inverse=True)
        place = self.known.find(keys)
        new = np.flatnonzero(place < 0)
        coded = self.encode_words(words.texts(first[new]))
        added = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        more = np.fromiter(chain.from_iterable(coded), dtype=np.int32, count=int(added.sum()))
        starts, sizes = self.known.starts[place], np.zeros(len(keys), dtype=np.int64)
        old = place >= 0
        sizes[old] = self.known.starts[place[old] + 1] - starts[old]
        starts[new], sizes[new] = len(self.known.ids) + np.cumsum(added) - added, added
        flat = np.concatenate([self.known.ids, more])
        each = sizes[back]
        ids = flat[_ranges(starts[back], each)]
        bounds = np.concatenate([[0], np.cumsum(each)])[words.row]
        self.known.add(keys[new], added, more)
        return ids, bounds

    def decode(self, ids: np.ndarray) -> str:
        """Token texts with blanks between; ids outside the vocabulary are left out."""
        names = self.names
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            ids = ids[(ids >= 0) & (ids < self.size)]
        return " ".join(filter(None, map(names.__getitem__, ids.tolist())))


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(broadcast) -> Encoder:
    """The worker's encoder, which keeps what it remembers from task to task."""
    if broadcast.value.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[broadcast.value.key] = Encoder(broadcast.value)
    return _ENCODERS[broadcast.value.key]


def encode(
    docs: DataFrame,
    vocabulary_path: str,
    text: str = "text",
    ids: str = "ids",
    packed: bool = False,
) -> DataFrame:
    """``docs`` with the token ids of the whole text as ``array<int>``, or
    ``packed`` as BINARY of little-endian unsigned 32-bit numbers.

    NULL and empty texts have no ids.  Special tokens in a text become their
    ids.  Texts of any length are taken whole.  All other columns stay as they
    are, repeated rows too; a column already named ``ids`` is replaced.  An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = spark.sparkContext.broadcast(Vocabulary.read(vocabulary_path))
    kept = [named(c) for c in docs.columns if c.lower() != ids.lower()]
    rows = docs.select(F.struct(*kept).alias("_row"), named(text).cast("string").alias("_text"))
    kind = "binary" if packed else "array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in slices(batches, "_text"):
            flat, bounds = encoder.encode(batch.column("_text"))
            if packed:
                ends, data = (bounds * 4).astype(np.int32), flat.astype("<u4")
                made = pa.BinaryArray.from_buffers(
                    pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]
                )
            else:
                made = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), made], ["_row", "_ids"])

    schema = T.StructType([rows.schema["_row"], T.StructField("_ids", T._parse_datatype_string(kind))])
    return rows.mapInArrow(work, schema).select("_row.*", F.col("_ids").alias(ids))


def numbers(ids: pa.Scalar) -> np.ndarray:
    """The ids in one cell, packed or not."""
    if isinstance(ids, pa.BinaryScalar):
        return np.frombuffer(ids.as_buffer(), dtype="<u4").astype(np.int64)
    return ids.values.to_numpy()


def decode(
    docs: DataFrame, vocabulary_path: str, ids: str = "ids", text: str = "decoded"
) -> DataFrame:
    """``docs`` with the text of their ids, tokens separated by blanks;
    both forms of ids are read.

    NULL ids give an empty text.  A column already named as the result is
    replaced, all others stay.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.read(vocabulary_path))
    kept = [named(c) for c in docs.columns if c.lower() != text.lower()]
    rows = docs.select(F.struct(*kept).alias("_row"), named(ids).alias("_ids"))
    schema = T.StructType([rows.schema["_row"], T.StructField("_text", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in slices(batches, "_ids"):
            made = [encoder.decode(numbers(x)) if x.is_valid else "" for x in batch.column("_ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(made, pa.string())], ["_row", "_text"]
            )

    return rows.mapInArrow(work, schema).select("_row.*", F.col("_text").alias(text))
