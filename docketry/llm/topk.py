"""Exact top-k by inner product: ball trees in shards, branch and bound.

Vectors are made integers, so scores are exact.  The rows are dealt into shards
of about ``SHARD_ROWS``; each shard becomes one ball tree.  The queries, a
stated set of rows, are dealt into blocks and every block meets every shard: a
set of queries against all rows, in blocks.

Going down a tree, the nodes of a query are ordered by the upper bound of the
inner product, ``q . centre + radius * |q|``, and a node is left out when its
bound is under the current k-th score.  That score is shared: a first round
descends each tree to its most promising leaf only, the k-th best over all
shards is found by aggregation, and the full search of every shard starts from
it.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from docketry.llm.frames import named, written

#: About so many rows make a shard, and so many queries a block.
SHARD_ROWS, BLOCK_QUERIES = 8192, 1024
LEAF = 64
#: Vectors are scaled by this and rounded down.
SCALE = 256
#: Stands for a score that is not there.
NONE = -(2**62)


@dataclass
class BallTree:
    """Nodes in breadth-first order; leaves are ranges of the reordered rows."""

    ids: np.ndarray
    rows: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    smallest: np.ndarray  # smallest id under the node
    child: np.ndarray  # first child (the second follows), or -1
    begin: np.ndarray
    end: np.ndarray

    @staticmethod
    def build(ids: np.ndarray, rows: np.ndarray) -> "BallTree":
        order = np.arange(len(ids))
        spans, child = [(0, len(ids))], []
        at = 0
        while at < len(spans):
            a, b = spans[at]
            part = rows[order[a:b]].astype(float)
            far = part[np.argmax(((part - part.mean(0)) ** 2).sum(1))]
            other = part[np.argmax(((part - far) ** 2).sum(1))]
            along = part @ (other - far)
            if b - a <= LEAF or along.min() == along.max():
                child.append(-1)
            else:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argsort(along, kind="stable")]
                child.append(len(spans))
                spans += [(a, a + middle), (a + middle, b)]
            at += 1
        ids, rows = ids[order], rows[order]
        begin, end = (np.array(x) for x in zip(*spans))
        centre = np.stack([rows[a:b].mean(0) for a, b in spans])
        radius = np.array(
            [np.sqrt(((rows[a:b] - c) ** 2).sum(1).max()) for (a, b), c in zip(spans, centre)]
        )
        smallest = np.array([ids[a:b].min() for a, b in spans])
        return BallTree(ids, rows, centre, radius, smallest, np.array(child), begin, end)

    def bounds(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Upper bound of the score of each query with each node, rounded up."""
        size = np.sqrt((queries.astype(float) ** 2).sum(1))
        bound = queries @ self.centre[nodes].T + np.outer(size, self.radius[nodes])
        return bound + 1e-9 * np.abs(bound) + 1e-6


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k = k
        self.score = np.full((queries, k), NONE)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        #: A score that k rows are known to reach.
        self.floor = floor

    def take(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates ``ids`` with ``score`` (queries x candidates) for queries ``which``."""
        keep = min(self.k * 2, score.shape[1])
        if score.shape[1] > 4 * keep:
            # Keep everything that ties with the k-th best score.
            cut = np.partition(score, -self.k, axis=1)[:, -self.k]
            used = (score >= cut[:, None]).any(0)
            score, ids = score[:, used], ids[used]
        all_score = np.concatenate([self.score[which], score], axis=1)
        all_ids = np.concatenate([self.id[which], np.broadcast_to(ids, score.shape)], axis=1)
        order = np.lexsort((all_ids, -all_score), axis=1)[:, : self.k]
        self.score[which] = np.take_along_axis(all_score, order, 1)
        self.id[which] = np.take_along_axis(all_ids, order, 1)


def search(
    tree: BallTree, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray, seed: bool
) -> Best:
    """The k best rows of the tree for each query, itself left out; with ``seed``
    only those of its most promising leaf."""
    best = Best(len(queries), k, floor)

    def leaf(node: int, which: np.ndarray) -> None:
        a, b = tree.begin[node], tree.end[node]
        score = queries[which] @ tree.rows[a:b].T
        own = tree.ids[None, a:b] == query_ids[which][:, None]
        best.take(which, np.where(own, NONE, score), tree.ids[a:b])

    if seed:
        at = np.zeros(len(queries), dtype=np.int64)
        while (inner := tree.child[at] >= 0).any():
            for node in np.unique(at[inner]):
                which = np.flatnonzero(at == node)
                pair = np.array([tree.child[node], tree.child[node] + 1])
                at[which] = pair[np.argmax(tree.bounds(queries[which], pair), axis=1)]
        for node in np.unique(at):
            leaf(node, np.flatnonzero(at == node))
        return best

    def still_open(which: np.ndarray, bound: np.ndarray, smallest: int) -> np.ndarray:
        worst, last = best.score[which, -1], best.id[which, -1]
        better = (bound > worst) | ((bound >= worst) & (smallest < last))
        return which[better & (bound >= best.floor[which])]

    def visit(node: int, which: np.ndarray) -> None:
        if tree.child[node] < 0:
            leaf(node, which)
            return
        pair = np.array([tree.child[node], tree.child[node] + 1])
        bound = tree.bounds(queries[which], pair)
        first = np.argmax(bound, axis=1)
        # The node with the larger bound goes first and raises the k-th score.
        for turn in (0, 1):
            side = first if turn == 0 else 1 - first
            for n in (0, 1):
                mine = np.flatnonzero(side == n)
                still = still_open(which[mine], bound[mine, n], tree.smallest[pair[n]])
                if len(still):
                    visit(int(pair[n]), still)

    visit(0, np.arange(len(queries)))
    return best


def integer_vector(vector: Column) -> Column:
    """Components times ``SCALE`` rounded down, NULL for a vector that is NULL or
    has a NULL or non-finite component."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


def _packed(vectors: DataFrame, groups: int, salt: int, name: str) -> DataFrame:
    """``name, ids, rows``: the vectors of each group as packed numbers.

    Groups are by hash of the id and get about equal numbers.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("group").to_numpy()
            ids = batch.column("id").to_numpy()
            listed = batch.column("vector")
            rows = listed.flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
            for g in np.unique(group):
                mine = group == g
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g], pa.int64()), pa.array([ids[mine].tobytes()], pa.binary()),
                     pa.array([rows[mine].tobytes()], pa.binary())],
                    [name, "ids", "rows"],
                )

    group = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(groups))
    packs = vectors.select("id", "vector", group.alias("group")).mapInArrow(
        work, f"{name} long, ids binary, rows binary"
    )
    return packs.groupBy(name).agg(F.collect_list(F.struct("ids", "rows")).alias(name + "_packs"))


def _unpacked(packs: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.frombuffer(p["ids"], dtype=np.int64) for p in packs])
    rows = np.concatenate(
        [np.frombuffer(p["rows"], np.int64).reshape(len(p["ids"]) // 8, -1) for p in packs]
    )
    order = np.argsort(ids, kind="stable")
    return ids[order], rows[order]


def _found(met: DataFrame, k: int, seed: bool) -> DataFrame:
    """``query_id, vec_id, score`` of every block in every shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, BallTree] | None = None
        for batch in batches:
            for n in range(batch.num_rows):
                shard = batch.column("shard")[n].as_py()
                if held is None or held[0] != shard:
                    held = (shard, BallTree.build(*_unpacked(batch.column("shard_packs")[n].as_py())))
                ids, queries = _unpacked(batch.column("block_packs")[n].as_py())
                known = batch.column("floors")[n].as_py() if not seed else None
                floors = {f["query_id"]: f["floor"] for f in known or ()}
                floor = np.array([floors.get(q, -np.inf) for q in ids.tolist()])
                best = search(held[1], ids, queries, k, floor, seed)
                real = best.score > NONE
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, k)[real.ravel()]), pa.array(best.id[real]),
                     pa.array(best.score[real])],
                    ["query_id", "vec_id", "score"],
                )

    return met.mapInArrow(work, "query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the largest inner
    product for every row that ``is_query`` (over the column ``id``) chooses.

    Scores are inner products of integer vectors; ties go to the smaller id.  A
    query is not its own result; with fewer other rows all are returned.  Rows
    whose vector or id is NULL, and vectors with NULL or non-finite components,
    take no part, nor do vectors whose length is not the most common one.  Of
    rows with one id the one with the smallest vector counts.  An empty table
    gives an empty result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    clean = vectors.select(named(vec_id).cast("long").alias("id"), integer_vector(named(vector)).alias("vector"))
    clean = clean.filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
    clean = clean.groupBy("id").agg(F.min("vector").alias("vector"))
    clean = written(clean, "vectors")
    sizes = clean.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None or sizes["size"] == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    clean = clean.filter(F.size("vector") == sizes["size"])
    queries = clean.filter(is_query)
    total, asked = clean.count(), queries.count()
    shards = max(1, -(-total // shard_rows))
    blocks = max(1, -(-asked // block_queries))
    shard_table = written(_packed(clean, shards, 1, "shard"), "shards")
    block_table = written(_packed(queries, blocks, 2, "block"), "blocks")
    # Every shard is asked by every block: one row for each such pair.
    pairs = shard_table.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block")
    )
    wide = min(shards * blocks, max(1, 4 * spark.sparkContext.defaultParallelism))

    def meet(asking: DataFrame) -> DataFrame:
        rows = pairs.join(asking, "block").join(shard_table, "shard")
        return rows.repartition(wide, "shard", "block").sortWithinPartitions("shard")

    row = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    seeds = _found(meet(block_table), k, True).withColumn("rank", F.row_number().over(row))
    floors = (
        seeds.filter(F.col("rank") == k)
        .select("query_id", F.col("score").cast("double").alias("floor"))
        .withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(blocks)))
        .groupBy("block")
        .agg(F.collect_list(F.struct("query_id", "floor")).alias("floors"))
    )
    floors = written(floors, "floors")
    found = _found(meet(block_table.join(floors, "block", "left")), k, False)
    ranked = found.withColumn("rank", F.row_number().over(row)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
