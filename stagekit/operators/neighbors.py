"""Exact nearest neighbours by largest inner product: blocks over a cluster, and a ball tree for one machine; with an optional label condition."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagekit.base import Fitted
from stagekit.plans.session import fresh, write_table

#: Blocks of the index and of the queries; a task holds one of each.
BLOCK_ROWS, BLOCK_ASKS = 20_000, 2_000
#: Products of a query and a row that a task holds at once.
SCORES = 1_000_000
#: Rows of a ball tree, which one machine holds.
TREE_ROWS = 2_000_000


def knn(index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "features", query_id_col: str = "query_id", label_col: str | None = None, conditioner_col: str | None = None) -> DataFrame:
    """(query_id, rank, id, distance[, label]): the ``k`` rows of largest inner product, ties to the larger id.

    Index and queries are dealt into blocks; a task is a matrix product of one of each and hands on ``k``
    rows a query; a window ranks what the blocks found. Neither side is collected.
    With ``conditioner_col`` (an array of labels) only rows with one of these labels count.
    """
    labelled = label_col is not None
    blocks, halves = max(1, -(-index.count() // BLOCK_ROWS)), max(1, -(-queries.count() // BLOCK_ASKS))
    rows = index.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), (F.col(label_col).cast("string") if labelled else F.lit("")).alias("label"), F.array().cast("array<string>").alias("wanted"), F.lit(1).alias("kind"))
    # block of the index * blocks of queries + block of the queries
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(halves - 1))))
    rows = rows.withColumn("block", F.col("block") + F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int") * halves)
    asked = queries.select(F.col(query_id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.lit("").alias("label"), (F.col(conditioner_col).cast("array<string>") if conditioner_col else F.array().cast("array<string>")).alias("wanted"), F.lit(0).alias("kind"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.col("block") * halves + F.pmod(F.xxhash64("id"), F.lit(halves)).cast("int"))
    both = rows.unionByName(asked).where(F.col("vec").isNotNull())

    def search(table: pa.Table) -> pa.Table:
        return nearest_in_block(table, k, conditioner_col is not None)

    schema = "query_id long, id long, distance double, label string"
    found = both.repartition(blocks * halves, "block").groupBy("block").applyInArrow(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("distance"), F.desc("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "distance", *(["label"] if labelled else []))


def nearest_in_block(table: pa.Table, k: int, conditioned: bool) -> pa.Table:
    """(query_id, id, distance, label): the ``k`` best rows (kind 1) of a block for each of its queries (kind 0).

    Vectors are read as one array, and ``SCORES`` products are held at a time.
    """
    names = ["query_id", "id", "distance", "label"]
    asked, rows = (table.filter(pc.equal(table["kind"], kind)).combine_chunks() for kind in (0, 1))
    if not len(asked) or not len(rows):
        return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64(), pa.string()))})
    # the larger id first: a stable order by score then keeps ties as they are
    rows = rows.take(pc.sort_indices(rows["id"], sort_keys=[("", "descending")]))
    vectors = lambda t: pa.concat_arrays([c.flatten() for c in t["vec"].chunks]).to_numpy(zero_copy_only=False).astype(float).reshape(len(t), -1)
    q, x = vectors(asked), vectors(rows)
    if conditioned:
        labels = rows["label"].to_pylist()
        place = {v: i for i, v in enumerate(dict.fromkeys(labels))}
        codes = np.array([place[v] for v in labels])
        allowed = np.zeros((len(q), len(place)), bool)
        for i, wanted in enumerate(asked["wanted"].to_pylist()):
            allowed[i, [place[v] for v in wanted if v in place]] = True
    best, at = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64)
    step = max(k, SCORES // len(q))
    for begin in range(0, len(x), step):
        score = np.einsum("qd,nd->qn", q, x[begin : begin + step])
        if conditioned:
            score[~allowed[:, codes[begin : begin + step]]] = -np.inf
        here = np.argsort(-score, axis=1, kind="stable")[:, :k]
        best = np.concatenate([best, np.take_along_axis(score, here, 1)], axis=1)
        at = np.concatenate([at, here + begin], axis=1)
        order = np.argsort(-best, axis=1, kind="stable")[:, :k]
        best, at = np.take_along_axis(best, order, 1), np.take_along_axis(at, order, 1)
    keep = np.isfinite(best)
    hits = rows.take(pa.array(at[keep]))
    ids = asked["id"].take(pa.array(np.nonzero(keep)[0]))
    return pa.table([ids, hits["id"], pa.array(best[keep]), hits["label"]], names=names)


def fit_knn(index: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "features", value_col: str | None = None, label_col: str | None = None) -> Fitted:
    """The index as a stage: ``neighbors`` of each query row, nearest first, as (value, distance[, label])."""
    cols = {"id": F.col(f"`{id_col}`").cast("long"), "features": F.col(f"`{vec_col}`").cast("array<double>"), "value": F.col(f"`{value_col or id_col}`")}
    if label_col:
        cols["label"] = F.col(f"`{label_col}`").cast("string")
    kept = index.select(*[c.alias(n) for n, c in cols.items()])
    return Fitted(find_neighbors, {"index": kept}, k=k, labelled=label_col is not None)


def find_neighbors(df: DataFrame, index: DataFrame, k: int, labelled: bool, vec_col: str = "features", output_col: str = "neighbors", conditioner_col: str | None = None) -> DataFrame:
    name, found = fresh(df.columns, "query_number", output_col)
    rows = write_table(df.withColumn(name, F.monotonically_increasing_id()), "knn-queries")
    asked = rows if vec_col == "features" else rows.withColumn("features", F.col(f"`{vec_col}`"))
    hits = knn(index, asked, k, "id", "features", name, "label" if labelled else None, conditioner_col)
    named = hits.join(index.select("id", "value"), "id")
    parts = ["rank", "value", "distance", *(["label"] if labelled else [])]
    lists = named.groupBy(F.col("query_id").alias(name)).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias(found))
    lists = lists.withColumn(found, F.transform(found, lambda x: F.struct(*[x[p].alias(p) for p in parts[1:]])))
    return rows.join(lists, name, "left").drop(name)


class BallTree:
    """Points in nested balls: the largest inner products without looking at balls that cannot hold them."""

    def __init__(self, points: np.ndarray, values: list, leaf: int = 50, labels: list | None = None):
        self.points, self.values, self.labels = np.asarray(points, float), list(values), None if labels is None else np.array(labels, object)
        if len(self.points) > TREE_ROWS:
            raise ValueError(f"more than {TREE_ROWS} points: use knn over a DataFrame")
        self.nodes: list[tuple] = []  # centre, radius, rows or children, labels below
        self._build(np.arange(len(self.points)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        me, x = len(self.nodes), self.points[rows]
        centre = x.mean(axis=0) if len(x) else np.zeros(self.points.shape[1])
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()) if len(x) else 0.0
        below = None if self.labels is None else set(self.labels[rows])
        self.nodes.append(())
        if len(rows) <= leaf or radius == 0:
            self.nodes[me] = (centre, radius, rows, None, below)
            return me
        far = x[((x - x[0]) ** 2).sum(axis=1).argmax()]
        other = x[((x - far) ** 2).sum(axis=1).argmax()]
        cast = x @ (other - far)
        side = cast <= np.median(cast)
        if side.all():
            side = np.arange(len(rows)) < len(rows) // 2
        self.nodes[me] = (centre, radius, None, (self._build(rows[side], leaf), self._build(rows[~side], leaf)), below)
        return me

    def find(self, query: np.ndarray, k: int = 1, conditioner: set | None = None) -> list[tuple]:
        """(value, inner product[, label]) of the best ``k``, of rows with one of the labels if there is a condition."""
        import heapq

        q, best = np.asarray(query, float), []
        size = float(np.linalg.norm(q))
        bound = lambda n: float(q @ self.nodes[n][0]) + size * self.nodes[n][1]
        open_ = [(-bound(0), 0)] if len(self.points) else []
        while open_:
            most, n = heapq.heappop(open_)
            if len(best) == k and -most <= best[0][0]:
                break
            _, _, rows, children, below = self.nodes[n]
            if conditioner is not None and below is not None and not below & conditioner:
                continue
            if children:
                for c in children:
                    heapq.heappush(open_, (-bound(c), c))
                continue
            for i, s in zip(rows.tolist(), (self.points[rows] @ q).tolist()):
                if conditioner is not None and self.labels[i] not in conditioner:
                    continue
                heapq.heappush(best, (s, i)) if len(best) < k else heapq.heappushpop(best, (s, i))
        found = sorted(best, reverse=True)
        return [(self.values[i], s) if self.labels is None else (self.values[i], s, self.labels[i]) for s, i in found]

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            pickle.dump(self, f)

    @classmethod
    def load(cls, path: str) -> BallTree:
        with open(path, "rb") as f:
            return pickle.load(f)


class ConditionalBallTree(BallTree):
    """A ball tree whose points have labels."""

    def __init__(self, points: np.ndarray, values: list, labels: list, leaf: int = 50):
        super().__init__(points, values, leaf, labels)


def fit_ball_tree(index: DataFrame, vec_col: str = "features", value_col: str = "id", label_col: str | None = None, leaf: int = 50) -> BallTree:
    """A tree of a table that fits one machine, ``TREE_ROWS`` rows at most, on the driver."""
    if index.limit(TREE_ROWS + 1).count() > TREE_ROWS:
        raise ValueError(f"more than {TREE_ROWS} points: use knn over a DataFrame")
    rows = index.select(F.col(f"`{vec_col}`").cast("array<double>").alias("v"), F.col(f"`{value_col}`").alias("x"), (F.col(f"`{label_col}`") if label_col else F.lit(None)).alias("l")).where("v IS NOT NULL").collect()
    points = np.array([r.v for r in rows], float) if rows else np.empty((0, 1))
    return BallTree(points, [r.x for r in rows], leaf, [r.l for r in rows] if label_col else None)
