"""Isolation forest: seeded subsamples grow trees side by side, rows are scored by the mean path to their leaf."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekit.base import Fitted
from stagekit.operators.columns import vector_values


def path_length(n: float) -> float:
    """Mean path of an unsuccessful search in a tree of ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow(x: np.ndarray, depth: int, rng: np.random.Generator, columns: np.ndarray) -> dict[str, list]:
    """A tree as lists by node: feature (-1: leaf), limit, left and right child, length to add at a leaf."""
    tree: dict[str, list] = {"feature": [], "limit": [], "left": [], "right": [], "length": []}

    def split(rows: np.ndarray, level: int) -> int:
        me = len(tree["feature"])
        for k, v in zip(tree, (-1, 0.0, -1, -1, path_length(len(rows)))):
            tree[k].append(v)
        if level >= depth or len(rows) <= 1:
            return me
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_ = columns[high[columns] > low[columns]]
        if not len(open_):
            return me
        f = int(rng.choice(open_))
        limit = float(rng.uniform(low[f], high[f]))
        side = x[rows, f] < limit
        if side.all() or not side.any():
            return me
        tree["feature"][me], tree["limit"][me] = f, limit
        tree["left"][me] = split(rows[side], level + 1)
        tree["right"][me] = split(rows[~side], level + 1)
        return me

    split(np.arange(len(x)), 0)
    return tree


def lengths(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """Mean path length of each row over all trees."""
    total = np.zeros(len(x))
    for tree in trees:
        t = {k: np.asarray(v) for k, v in tree.items()}
        at, depth = np.zeros(len(x), np.int64), np.zeros(len(x))
        live = np.flatnonzero(t["feature"][at] >= 0)
        while len(live):
            n = at[live]
            left = x[live, t["feature"][n]] < t["limit"][n]
            at[live] = np.where(left, t["left"][n], t["right"][n])
            depth[live] += 1
            live = live[t["feature"][at[live]] >= 0]
        total += depth + t["length"][at]
    return total / max(1, len(trees))


def isolation_forest(
    df: DataFrame, features_col: str = "features", n_trees: int = 100, max_samples: int = 256, max_features: float = 1.0, contamination: float = 0.0, bootstrap: bool = False,
    seed: int = 1, score_col: str = "outlierScore", prediction_col: str = "predictedLabel",
) -> Fitted:
    """Trees over ``max_samples`` rows each, drawn by a hash of row and tree, grown in the workers.

    With a ``contamination`` the rows with that share of the highest scores are outliers (1.0), else none
    are. Rows without features, or with a NaN, take no part and have no score.
    """
    x = vector_values(F.col(f"`{features_col}`"))
    rows = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", F.isnan))
    n = rows.count()
    if not n:
        raise ValueError("no rows with features")
    share = min(1.0, 3.0 * max_samples / n)
    # about three times what a tree needs, then its first ones by another hash
    drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    drawn = drawn.withColumn("h", F.xxhash64("x", "tree", F.lit(seed))).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    def build(table: pa.Table) -> pa.Table:
        number = table["tree"][0].as_py()
        order = np.argsort(table["h"].to_numpy(), kind="stable")
        points = np.array(table["x"].to_pylist(), float)[order]
        rng = np.random.default_rng([seed, number])
        points = points[rng.integers(0, len(points), max_samples)] if bootstrap else points[:max_samples]
        width = points.shape[1]
        columns = np.sort(rng.permutation(width)[: max(1, round(max_features * width))])
        tree = grow(points, math.ceil(math.log2(max(2, len(points)))), rng, columns)
        return pa.table({"tree": pa.array([number], pa.int32()), "size": pa.array([len(points)], pa.int32()), **{k: pa.array([v]) for k, v in tree.items()}})

    schema = "tree int, size int, feature array<bigint>, limit array<double>, left array<bigint>, right array<bigint>, length array<double>"
    found = drawn.groupBy("tree").applyInArrow(build, schema).orderBy("tree").collect()  # n_trees small rows
    trees = [{k: list(r[k]) for k in ("feature", "limit", "left", "right", "length")} for r in found]
    size = float(np.mean([r["size"] for r in found]))
    limit = None
    if contamination > 0:
        scored = score_outliers(df, features_col, trees, size, None, "score", "label")
        limit = scored.agg(F.percentile_approx("score", 1.0 - contamination, 100_000)).first()[0]
    return Fitted(score_outliers, features_col=features_col, trees=trees, size=size, limit=limit, score_col=score_col, prediction_col=prediction_col)


def score_outliers(df: DataFrame, features_col: str, trees: list[dict], size: float, limit: float | None, score_col: str, prediction_col: str) -> DataFrame:
    """Scores from 0 to 1, the higher the easier a row is to isolate, and the label by the limit."""
    forest = df.sparkSession.sparkContext.broadcast(trees)
    usual = max(path_length(size), 1e-9)

    def run(column: pa.Array) -> pa.Array:
        rows = column.to_pylist()
        fine = [i for i, r in enumerate(rows) if r is not None and all(v is not None and v == v for v in r)]
        out = np.full(len(rows), np.nan)
        if fine:
            out[fine] = 2.0 ** (-lengths(forest.value, np.array([rows[i] for i in fine], float)) / usual)
        return pa.array(out, mask=np.isnan(out))

    scored = df.withColumn(score_col, F.arrow_udf(run, "double")(vector_values(F.col(f"`{features_col}`"))))
    label = F.lit(0.0) if limit is None else (F.col(score_col) >= limit).cast("double")
    return scored.withColumn(prediction_col, F.when(F.col(score_col).isNotNull(), label))
