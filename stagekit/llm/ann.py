"""Nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: a node's direction is the difference of two of its points, the
threshold is the median of the sample on it. Every vector is put in one leaf of each tree. A query walks
all trees through one priority queue, ordered by how far it lies on the wrong side of the thresholds
passed, and visits the leaves that come first until their shares of the table add up to a limit. The limit
is the least that finds ``AIM`` of the true neighbours within the sample: a hundredth of the table where
vectors lie in clusters, all of it where they have no structure. A task compares a block of a leaf's
queries with a block of its vectors exactly (cosine in double precision) and hands on the best few of each
query; the best of all leaves are the answer. Blocks have a bound, so no leaf is too large for a task.

Equal vectors are one node: it carries its smallest k+1 ids, which are all that a list of k nearest with
ties to smaller ids can ever show. So a vector that a third of the rows share costs no more than any other.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagekit.plans.session import write_table

SAMPLE = 20_000
TREES = 8
#: Vectors that a leaf should hold, of large tables. The queue needs leaves to rank, so a tree has
#: ``LEAVES`` at least; a table of up to ``WHOLE`` vectors is one leaf, compared exactly.
LEAF, LEAVES, WHOLE = 1024, 64, 4096
#: Share of the sample's true neighbours that the fitted limit finds, by so many of its vectors as queries.
AIM, PROBES = 0.95, 300
#: Vectors and queries of a task's block, and queries and vectors that are compared at once.
ROWS, ASKS, BLOCK_ASKS, BLOCK = 16_384, 4_096, 512, 4_096


@dataclass
class Tree:
    direction: np.ndarray  # node x dimension
    limit: np.ndarray
    low: np.ndarray  # child at or below the limit; negative: -1 - leaf
    high: np.ndarray
    share: np.ndarray  # of the sample, by leaf

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        at = np.zeros(len(x), np.int64) if len(self.limit) else np.full(len(x), -1, np.int64)
        while (open_ := at >= 0).any():
            i = np.flatnonzero(open_)
            n = at[i]
            side = np.einsum("nd,nd->n", x[i], self.direction[n]) > self.limit[n]
            at[i] = np.where(side, self.high[n], self.low[n])
        return -1 - at


def grow(sample: np.ndarray, leaf: float, rng: np.random.Generator) -> Tree:
    """A tree whose leaves hold ``leaf`` points of the (unit length) sample at most, two at least."""
    rows: list = []
    shares: list[float] = []

    def split(ids: np.ndarray) -> int:
        if len(ids) > max(2, leaf):
            for _ in range(3):
                a, b = sample[rng.choice(ids, 2, replace=False)]
                way = (a - b) / max(1e-12, float(np.linalg.norm(a - b)))
                cast = sample[ids] @ way
                limit = float(np.median(cast))
                side = cast > limit
                if 0 < side.sum() < len(ids):
                    me = len(rows)
                    rows.append([way, limit, 0, 0])
                    rows[me][2], rows[me][3] = split(ids[~side]), split(ids[side])
                    return me
        shares.append(len(ids) / len(sample) if len(sample) else 1.0)
        return -len(shares)

    split(np.arange(len(sample)))
    dim = sample.shape[1]
    pick = lambda k, t: np.array([r[k] for r in rows], t)
    return Tree(np.array([r[0] for r in rows]).reshape(-1, dim), pick(1, float), pick(2, np.int64), pick(3, np.int64), np.array(shares))


def visit(trees: list[Tree], q: np.ndarray, share: float) -> list[int]:
    """Keys (tree * 2**32 + leaf) of the leaves of all trees, nearest first, up to this share of the table."""
    queue = [(0.0, t, 0 if len(tree.limit) else -1) for t, tree in enumerate(trees)]
    heapq.heapify(queue)
    cast = [tree.direction @ q - tree.limit for tree in trees]
    found: list[int] = []
    seen = 0.0
    while queue and seen < share:
        far, t, n = heapq.heappop(queue)
        tree = trees[t]
        while n >= 0:
            margin = float(cast[t][n])
            near, other = (tree.high[n], tree.low[n]) if margin > 0 else (tree.low[n], tree.high[n])
            heapq.heappush(queue, (max(far, abs(margin)), t, int(other)))
            n = int(near)
        found.append((t << 32) + (-1 - n))
        seen += float(tree.share[-1 - n])
    return found


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def valid(vec: str, dimension: int | None = None) -> F.Column:
    """Neither null nor zero, without null and non-finite components."""
    c = F.col(vec)
    fine = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)
    return fine if dimension is None else fine & (F.size(c) == dimension)


def needed_share(trees: list[Tree], x: np.ndarray, k: int, seed: int = 1) -> float:
    """The least limit of ``visit`` that finds ``AIM`` of the ``k`` nearest within ``x``, for vectors of ``x`` as queries."""
    if len(x) <= k + 1 or not len(trees[0].limit):
        return 1.0
    probes = np.random.default_rng(seed).choice(len(x), min(PROBES, len(x)), replace=False)
    near = x[probes] @ x.T
    near[np.arange(len(probes)), probes] = -2
    true = np.argpartition(-near, k, axis=1)[:, :k]
    leaves = np.stack([(t << 32) + tree.leaves(x) for t, tree in enumerate(trees)])
    shares = {(t << 32) + i: float(s) for t, tree in enumerate(trees) for i, s in enumerate(tree.share)}
    needs = []
    for probe, rows in zip(probes, true):
        order = visit(trees, x[probe], float("inf"))
        before = np.concatenate([[0.0], np.cumsum([shares[key] for key in order])])
        place = {key: before[i] for i, key in enumerate(order)}
        needs += [min(place[key] for key in column) for column in leaves[:, rows].T.tolist()]
    return float(np.sort(needs)[int(np.ceil(AIM * len(needs))) - 1]) + 1e-9


def _task(leaf: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """One number for a leaf, a block of its vectors and a block of its queries."""
    h = leaf.astype(np.uint64)
    for part in (rows, cols):
        h = (h + part.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _place(trees, query: bool, share: float, total: int, asks: int):
    """(node, vec) to rows (task, kind, node, vec) of all its leaves; a leaf has blocks of vectors and of queries."""

    def run(batches):
        forest = trees.value
        parts = [np.maximum(1, np.ceil(tree.share * total / ROWS).astype(np.int64)) for tree in forest]
        first = np.cumsum([0, *map(len, parts)])
        halves = int(np.ceil(min(1.0, share) * asks / ASKS)) or 1  # blocks of queries, as many for each leaf
        for batch in batches:
            if not batch.num_rows:
                continue
            node, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            u = unit(x)
            if query:
                keys = [visit(forest, row, share) for row in u]
                which = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                leaf = np.array([k for row in keys for k in row], np.int64)
            else:
                leaf = np.concatenate([(t << 32) + tree.leaves(u) for t, tree in enumerate(forest)])
                which = np.tile(np.arange(len(x)), len(forest))
            many = np.concatenate(parts)[first[leaf >> 32] + (leaf & 0xFFFFFFFF)]
            mixed = (node[which].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            # a vector is in one block of its leaf, shown to all blocks of queries there, and the other way round
            times = many if query else np.full(len(leaf), halves)
            own = mixed % halves if query else mixed % many
            other = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            leaf, which, own = np.repeat(leaf, times), np.repeat(which, times), np.repeat(own, times)
            rows, cols = (other, own) if query else (own, other)
            task = _task(leaf, rows, cols)
            for at in range(0, len(leaf), 1 << 16):
                w = which[at : at + (1 << 16)]
                kind = np.full(len(w), 0 if query else 1, np.int8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(task[at : at + (1 << 16)]), pa.array(kind), pa.array(node[w]), _binary(x[w])], names=["task", "kind", "node", "vec"]
                )

    return run


PLACED = "task long, kind byte, node long, vec binary"


def _best(k: int):
    """Rows sorted by (task, kind) to the k best (query, node, score) of each query in each task."""

    def emit(qid, best_s, best_n):
        q = np.repeat(qid, best_s.shape[1])
        s, n = best_s.ravel(), best_n.ravel()
        keep = s > -2
        return pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(n[keep]), pa.array(s[keep])], names=["query", "node", "score"])

    def run(batches):
        task, qid, q, norm, s, n = None, [], [], None, None, None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            kinds, nodes, raw = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])])) if len(keys) else []
            for a, b in zip(edges, [*edges[1:], len(keys)]):
                if keys[a] != task:
                    if s is not None:
                        yield emit(np.array(qid), s, n)
                    task, qid, q, s = keys[a], [], [], None
                x = np.frombuffer(b"".join(raw.slice(a, b - a).to_pylist()), np.float64).reshape(b - a, -1)
                if kinds[a] == 0:
                    qid += nodes[a:b].tolist()
                    q.append(x)
                    continue
                if not qid:
                    continue
                if s is None:
                    q = [np.concatenate(q)]
                    norm = np.sqrt(np.einsum("nd,nd->n", q[0], q[0]))
                    s, n = np.full((len(qid), k), -3.0), np.zeros((len(qid), k), np.int64)
                for i in range(0, len(x), BLOCK):
                    part, ids = x[i : i + BLOCK], nodes[a:b][i : i + BLOCK]
                    size = np.sqrt(np.einsum("nd,nd->n", part, part))
                    for j in range(0, len(qid), BLOCK_ASKS):
                        here = slice(j, j + BLOCK_ASKS)
                        score = np.einsum("qd,nd->qn", q[0][here], part) / (norm[here, None] * size[None, :])
                        s2 = np.concatenate([s[here], score], axis=1)
                        n2 = np.concatenate([n[here], np.broadcast_to(ids, score.shape)], axis=1)
                        order = np.lexsort((n2, -s2), axis=1)[:, :k]
                        s[here], n[here] = np.take_along_axis(s2, order, 1), np.take_along_axis(n2, order, 1)
        if s is not None:
            yield emit(np.array(qid), s, n)

    return run


def fit_forest(nodes: DataFrame, total: int, k: int, trees: int = TREES, seed: int = 1) -> tuple[list[Tree], float]:
    """Trees from at most about ``SAMPLE`` vectors (those of the smallest hashes) of ``nodes`` (node, vec), and the limit they need."""
    share = min(1.0, SAMPLE / max(1, total))
    picked = nodes.where(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = picked.orderBy("node").limit(2 * SAMPLE).select("vec").toArrow().column(0).combine_chunks()
    x = unit(_matrix(sample)) if len(sample) else np.empty((0, 1))
    rng = np.random.default_rng(seed)
    leaf = total if total <= WHOLE else min(LEAF, total / LEAVES)
    grown = [grow(x, leaf * len(x) / max(1, total), rng) for _ in range(trees if total > WHOLE else 1)]
    return grown, needed_share(grown, x, k, seed)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", share: float | None = None, seed: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest that the forest finds for each query.

    ``queries`` has rows of ``vectors``. Vectors that are null, zero, or hold a null or non-finite
    component take no part on either side, nor do those of another length than most have, which have no
    cosine with the others. ``share`` sets the limit of the leaves visited in place of the fitted one. A row is no
    candidate of a query with its own id. With fewer candidates than ``k`` all that are found come back.
    Ties go to the smaller id; repeated rows count once; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec")).where(valid("vec"))
    base = rows(vectors)
    usual = base.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = usual["d"] if usual else 1
    base, asked = base.where(F.size("vec") == dim), rows(queries).where(F.size("vec") == dim)
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = base.distinct().withColumn("i", nth).where(F.col("i") <= k + 1)
    nodes = few.groupBy("vec").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = write_table(nodes, "ann-nodes")
    total = nodes.count()
    grown, need = fit_forest(nodes.select("node", "vec"), total, k, seed=seed)
    trees, share = spark.sparkContext.broadcast(grown), need if share is None else share
    asks = write_table(asked.distinct().join(nodes.select("vec", "node"), "vec").select("id", "node", "vec"), "ann-queries")
    q = asks.select("node", "vec").dropDuplicates(["node"])
    n_asks = q.count()
    place = lambda query: _place(trees, query, share, total, n_asks)
    placed = nodes.select("node", "vec").mapInArrow(place(False), PLACED).unionByName(q.mapInArrow(place(True), PLACED))
    parts = placed.repartition("task").sortWithinPartitions("task", "kind")
    found = parts.mapInArrow(_best(k + 1), "query long, node long, score double")
    found = found.groupBy("query", "node").agg(F.max("score").alias("score"))
    first = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    found = found.withColumn("i", F.row_number().over(first)).where(F.col("i") <= k + 1).drop("i")
    found = found.join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    pairs = asks.select(F.col("id").alias("query_id"), F.col("node").alias("query")).join(found, "query").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_ann(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the five nearest of every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)
