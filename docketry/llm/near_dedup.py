"""MinHash near-duplicates by an inverted join over signature coordinates.

1. ``sketches``: the set of word shingles of each document, its size, an
   order-free hash of it and a MinHash signature.  Documents with one set form a
   class, so thousands of copies go on as one row.
2. A class is posted under each coordinate-value pair.  Pairs that no other
   class has are dropped; a class left with fewer than ``MATCHES`` of them has
   no partner.  Of ``s`` postings the ``s - MATCHES + 1`` rarest are kept (the
   prefix): two classes that agree on ``MATCHES`` coordinates share one of them.
   The long lists beyond are skipped and looked up in the signature instead.
3. On each list of the prefix everyone meets the list's most central class, not
   each other; each class is tried with the centre it collides with most.  Pairs
   that agree on ``MATCHES`` coordinates are confirmed on the full sets.
4. Lists whose classes are now in one component are done.  In the others a link
   that is still missing joins two classes x and y of a list with centre c, of
   which x is not linked to c.  Seen from c, a class is its difference set (what
   it has beyond c and what it lacks); x and y differ by
   ``|Dx| + |Dy| - 2 |Dx & Dy|`` shingles.  As x differs from c by more than a
   link allows, x and y must share at least ``(|Dy| + (nc - ny) * 15 / 185) / 2``
   of their differences.  That is a prefix join over the differences, which are
   few and mostly a class's own, and it is exact: no link is lost.
5. Components of the confirmed links.

Nothing is capped.  A list of m classes costs m rows in step 3, never m * m.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from docketry.llm.components import components
from docketry.llm.frames import named, slices, small_batches, written
from docketry.llm.words import chain, cut_words, mix, runs_inside, word_hashes

SHINGLE = 5
#: Coordinates of a signature.
COORDINATES = 64
#: Coordinates that a pair must agree on.  At a similarity of 0.85 the number is
#: binomial with mean 54.4; fewer than 38 happen about once in ten million links.
MATCHES = 38
#: Links have PERCENT * union <= 100 * intersection.
PERCENT = 85

_SEEDS = np.random.default_rng(7).integers(0, 2**62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted in each, and where each
    text's begin.  A text of fewer words than a shingle has one: all its words."""
    words = cut_words(texts, lower=True)
    hashes = word_hashes(words)
    count = np.diff(words.row)
    runs = chain(hashes, SHINGLE)
    inside = runs_inside(words.row, SHINGLE)
    owner = words.owner()[: len(runs)]
    shingles, owner = runs[inside], owner[inside]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        whole = [chain(hashes[words.row[d] : words.row[d + 1]], int(count[d]), 99)[0] for d in short]
        shingles = np.concatenate([shingles, np.array(whole, dtype=np.uint64)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), dtype=bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[new], np.searchsorted(owner[new], np.arange(len(count) + 1))


def set_hashes(shingles: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A 128-bit hash of each set."""
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles ^ np.uint64(salt)))])
        out.append(mix(total[bounds[1:]] - total[bounds[:-1]]))
    return [a.tobytes() + b.tobytes() for a, b in zip(*out)]


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts x coordinates: coordinate and value in one number; zero for empty sets."""
    out = np.zeros((len(bounds) - 1, COORDINATES), dtype=np.uint64)
    full = bounds[1:] > bounds[:-1]
    starts = bounds[:-1][full]
    if len(starts):
        for k, seed in enumerate(_SEEDS):
            out[full, k] = mix(np.minimum.reduceat(shingles * seed, starts) + seed)
    return out.view(np.int64)


def _arrays(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, class, tokens`` of each row; ``class`` is NULL for no words."""
    small_batches(docs.sparkSession)
    rows = docs.select(named(doc_id).alias("doc_id"), named(text).cast("string").alias("text"))
    schema = T.StructType(
        [rows.schema["doc_id"]] + T._parse_datatype_string("n long, class binary, tokens array<long>").fields
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, bounds = shingle_sets(batch.column("text"))
            n = np.diff(bounds)
            classes = [c if size else None for c, size in zip(set_hashes(sets, bounds), n)]
            tokens = signatures(sets, bounds)
            at = np.arange(len(n) + 1) * COORDINATES
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(classes, pa.binary()),
                 _arrays(tokens.ravel(), at)],
                ["doc_id", "n", "class", "tokens"],
            )

    return rows.mapInArrow(work, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``class, n, tokens, shingles`` once for each class of ``wanted (class, rep, tokens)``."""
    texts = docs.select(named(doc_id).alias("rep"), named(text).cast("string").alias("text"))
    asked = wanted.select(F.col("rep").alias("asked"))
    rows = texts.join(asked, F.col("rep").eqNullSafe(F.col("asked")), "left_semi")
    schema = "class binary, shingles array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, bounds = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(set_hashes(sets, bounds), pa.binary()), _arrays(sets.view(np.int64), bounds)],
                ["class", "shingles"],
            )

    made = rows.select("text").mapInArrow(work, schema)
    return made.join(wanted.select("class", "n", "tokens"), "class").dropDuplicates(["class"])


def prefix(items: DataFrame, need: Column, by: tuple[str, ...] = ("class",)) -> DataFrame:
    """``by, kept, centre, rare, all``: the items of each class by rarity.

    ``items`` has ``by``, ``item``, ``df`` and ``kept`` (carried along).
    ``need`` is the number of items that two linked classes must share at least;
    a class with fewer is dropped.  ``rare`` are those of which two linked
    classes share one.
    """
    gathered = items.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("df", "item"))).alias("all"),
        F.sum("df").alias("centre"),
        F.first("kept").alias("kept"),
    )
    enough = gathered.filter(F.size("all") >= need)
    return enough.withColumn("rare", F.slice("all", 1, F.size("all") - need + 1))


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` with both sets; sizes that cannot be similar are left out."""
    one = sets.select(*[F.col(c).alias(f"a_{c}") for c in sets.columns])
    two = sets.select(*[F.col(c).alias(f"b_{c}") for c in sets.columns])
    return pairs.join(one, F.col("a") == F.col("a_class")).join(two, F.col("b") == F.col("b_class"))


def similar() -> Column:
    """Whether two sets side by side are linked: enough equal coordinates, then
    the exact similarity."""
    match = F.size(F.array_intersect("a_tokens", "b_tokens")) >= MATCHES
    shared = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return match & (shared * 100 >= PERCENT * (F.col("a_n") + F.col("b_n") - shared))


def sizes_fit() -> Column:
    return F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * PERCENT


def star_links(lists: DataFrame, centres: DataFrame, sets: DataFrame) -> DataFrame:
    """Each class against the centre it collides with most."""
    met = lists.join(centres, "item").filter(F.col("class") != F.col("heart"))
    tried = (
        met.groupBy(F.col("class").alias("a"), F.col("heart").alias("b"))
        .agg(F.count("*").alias("hits"))
        .groupBy("a")
        .agg(F.max_by("b", F.struct("hits", "b")).alias("b"))
    )
    return written(with_sets(tried, sets).filter(sizes_fit() & similar()).select("a", "b"), "near-links")


def open_pairs(lists: DataFrame, centres: DataFrame, links: DataFrame) -> DataFrame:
    """``a, b``: the classes and the centre of each list that is not seen to be
    one component.

    A class bears the name of the centre it is linked to, or of the centre that
    one is linked to: classes of one name are in one component.
    """
    once = links.select(F.col("a").alias("class"), F.col("b").alias("root"))
    twice = links.select(F.col("a").alias("root"), F.col("b").alias("next"))
    names = once.join(twice, "root", "left").select("class", F.coalesce("next", "root").alias("root"))
    rooted = lists.join(names, "class", "left").select(
        "class", "item", F.coalesce("root", "class").alias("root")
    )
    ends = rooted.groupBy("item").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    still = ends.filter("low != high").select("item")
    met = lists.join(still, "item", "left_semi").join(centres, "item")
    return met.select(F.col("class").alias("a"), F.col("heart").alias("b")).filter("a != b").distinct()


#: Two linked sets differ by at most this part of the sum of their sizes.
APART = (100 - PERCENT) / (100 + PERCENT)


def difference_links(seen: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """The links of step 4 between different roots.

    ``seen`` has pairs of class and centre ``a, b`` with ``n, centre_n, linked,
    differences``.
    """
    size = F.size("differences")
    # Half of what a class and an unlinked one must share of their differences.
    need = F.ceil((size + (F.col("centre_n") - F.col("n")) * APART) / 2 - 1e-9).cast("int")
    posted = seen.withColumnRenamed("a", "class").join(roots, "class", "left").select(
        "class", "b", "n", "linked", F.greatest(F.lit(1), need).alias("need"), size.alias("size"),
        F.coalesce("root", "class").alias("root"), F.explode("differences").alias("e"),
    ).select(
        "class", "b", F.struct("n", "linked", "need", "size", "root").alias("kept"),
        F.xxhash64("b", "e").alias("item"),
    )
    across = posted.groupBy("item").agg(
        F.count("*").alias("df"), F.min("kept.root").alias("low"), F.max("kept.root").alias("high")
    ).filter("low != high").select("item", "df")
    shared = written(
        prefix(posted.join(across, "item"), F.lit(1), ("class", "b")).select("class", "kept", "all"),
        "near-shared",
    )
    need = F.col("kept.need")
    rare = shared.filter(F.size("all") >= need).select(
        "class", "kept", F.size("all").alias("held"),
        F.posexplode(F.slice("all", 1, F.size("all") - need + 1)).alias("at", "e"),
    )
    every = shared.filter(~F.col("kept.linked")).select(
        "class", "kept", F.size("all").alias("held"), F.posexplode("all").alias("at", "e")
    )

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(
            F.col("e.item").alias("item"), F.col("class").alias(name),
            F.col("kept.n").alias(f"{name}_n"), F.col("kept.root").alias(f"{name}_root"),
            F.col("kept.size").alias(f"{name}_size"), (F.col("held") - F.col("at")).alias(f"{name}_left"),
        )

    # From the first shared difference on, enough of both must be left.
    must = (F.col("a_size") + F.col("b_size") - (F.col("a_n") + F.col("b_n")) * APART) / 2 - 1e-9
    may = (F.col("a_root") != F.col("b_root")) & sizes_fit() & (F.least("a_left", "b_left") >= must)
    inner = side(rare.filter("kept.linked"), "a").join(side(every, "b"), "item").filter(may)
    free = rare.filter("not kept.linked")
    outer = side(free, "a").join(side(free, "b"), "item").filter(may & (F.col("a") < F.col("b")))
    more = inner.select("a", "b").unionByName(outer.select("a", "b")).distinct()
    return written(with_sets(more, sets).filter(sizes_fit() & similar()).select("a", "b"), "near-links")


def class_roots(docs: DataFrame, classes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``class, root`` of the classes that have a link.

    ``classes`` has ``class, n, rep, tokens``.
    """
    posted = classes.select("class", F.lit(0).alias("kept"), F.explode("tokens").alias("item"))
    shared = posted.groupBy("item").agg(F.count("*").alias("df")).filter("df > 1")
    chosen = prefix(posted.join(shared, "item"), F.lit(MATCHES))
    lists = written(
        chosen.select("class", "centre", F.explode("rare.item").alias("item")), "near-lists"
    )
    centres = lists.groupBy("item").agg(
        F.max(F.struct("centre", "class"))["class"].alias("heart"), F.count("*").alias("size")
    ).filter("size > 1").select("item", "heart")
    wanted = classes.join(lists.select("class").distinct(), "class", "left_semi")
    sets = written(full_sets(docs, wanted, doc_id, text), "near-sets")
    near = star_links(lists, centres, sets)
    pairs = open_pairs(lists, centres, near)
    missing = F.array_except("b_shingles", "a_shingles")
    beyond = F.array_except("a_shingles", "b_shingles")
    seen = written(
        with_sets(pairs, sets).select(
            "a", "b", F.col("a_n").alias("n"), F.col("b_n").alias("centre_n"),
            (sizes_fit() & similar()).alias("linked"), F.concat(missing, beyond).alias("differences"),
        ),
        "near-differences",
    )
    own = near.unionByName(seen.filter("linked").select("a", "b"))
    roots = written(components(own).withColumnRenamed("node", "class"), "near-roots")
    found = difference_links(seen, roots, sets)
    if found.isEmpty():
        return roots
    # What was found joins the components so far.
    named_roots = roots.select(F.col("class").alias("a"), F.col("root").alias("a_root"))
    across = found.join(named_roots, "a", "left").join(
        roots.select(F.col("class").alias("b"), F.col("root").alias("b_root")), "b", "left"
    ).select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    joined = components(across).select(F.col("node").alias("root"), F.col("root").alias("last"))
    alone = joined.join(roots.select("class"), F.col("root") == F.col("class"), "left_anti")
    return roots.join(joined, "root", "left").select(
        "class", F.coalesce("last", "root").alias("root")
    ).unionByName(alone.select(F.col("root").alias("class"), F.col("last").alias("root")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Two documents are linked when ``100 * intersection >= PERCENT * union`` of
    their shingle sets; ``component_id`` is the smallest id reachable.  NULL and
    empty texts and texts of blanks have no shingles, are linked with nothing
    and stay.  Rows with one id and one text are one document and come back as
    often as they are there.  An id of NULL counts as larger than any other; a
    component without any other id has NULL.  Other columns are not looked at.
    """
    base = written(sketches(docs, doc_id, text), "near-sketches")
    classes = written(
        base.filter("n > 0").groupBy("class").agg(
            F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens")
        ),
        "near-classes",
    )
    roots = class_roots(docs, classes, doc_id, text)
    rooted = classes.select("class", "rep").join(roots, "class", "left").select(
        "class", "rep", F.coalesce("root", "class").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named_classes = rooted.join(smallest, "root").select("class", "component_id")
    found = base.select("doc_id", "n", "class").join(named_classes, "class", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
