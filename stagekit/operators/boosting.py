"""Gradient boosting over histograms: classes, numbers and rankings.

Rows are binned once and written down. A level of a tree is one pass: every task sums gradients, hessians
and counts by open leaf, feature and bin, and the sums are added by leaf; the driver sees histograms, whose
size does not depend on the rows, and chooses the splits. Scores are brought up to date in the table every
``KEEP`` trees; in between tasks add the trees since. Groups of a ranking are one row each, so a query
never lies in two tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekit.base import Fitted
from stagekit.operators.columns import vector_values
from stagekit.plans.session import fresh, write_table

KEEP = 10


@dataclass
class Params:
    objective: str = "binary"
    n_iterations: int = 100
    learning_rate: float = 0.1
    num_leaves: int = 31
    max_bin: int = 255
    max_depth: int = -1
    min_data_in_leaf: int = 20
    min_sum_hessian: float = 1e-3
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    bagging_fraction: float = 1.0
    bagging_freq: int = 0
    feature_fraction: float = 1.0
    alpha: float = 0.9
    tweedie_power: float = 1.5
    n_classes: int = 1
    max_position: int = 20
    early_stopping: int = 0
    unbalanced: bool = False
    boost_from_average: bool = True
    seed: int = 0


# Objectives ---------------------------------------------------------------------------------------

def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(p: Params, s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the scores (rows x trees of an iteration)."""
    if p.objective == "multiclass":
        q = softmax(s)
        hot = np.arange(s.shape[1])[None, :] == y[:, None]
        return q - hot, 2.0 * q * (1 - q)
    s = s[:, 0]
    one = np.ones(len(y))
    if p.objective == "binary":
        q = sigmoid(s)
        g, h = q - y, q * (1 - q)
    elif p.objective == "regression":
        g, h = s - y, one
    elif p.objective == "regression_l1":
        g, h = np.sign(s - y), one
    elif p.objective == "huber":
        g, h = np.clip(s - y, -p.alpha, p.alpha), one
    elif p.objective == "quantile":
        g, h = np.where(s >= y, 1 - p.alpha, -p.alpha), one
    elif p.objective == "fair":
        g, h = (s - y) / (np.abs(s - y) + 1), 1 / (np.abs(s - y) + 1) ** 2
    elif p.objective == "poisson":
        g, h = np.exp(s) - y, np.exp(s + 0.7)
    elif p.objective == "gamma":
        g, h = 1 - y * np.exp(-s), y * np.exp(-s)
    elif p.objective == "tweedie":
        a, b = np.exp((1 - p.tweedie_power) * s), np.exp((2 - p.tweedie_power) * s)
        g, h = -y * a + b, -y * (1 - p.tweedie_power) * a + (2 - p.tweedie_power) * b
    elif p.objective == "mape":
        g, h = np.sign(s - y) / np.maximum(1, np.abs(y)), 1 / np.maximum(1, np.abs(y))
    else:
        raise ValueError(f"unknown objective {p.objective}")
    return g[:, None], h[:, None]


def ranking_gradients(s: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairwise gradients of one query, weighted by the change of its NDCG (gains 2^label - 1)."""
    g, h, n = np.zeros(len(y)), np.zeros(len(y)), len(y)
    gain = 2.0**y - 1
    ideal = float((np.sort(gain)[::-1][:most] / np.log2(np.arange(2, min(n, most) + 2))).sum())
    if ideal <= 0:
        return g, h
    place = np.empty(n, np.int64)
    place[np.argsort(-s, kind="stable")] = np.arange(n)
    discount = 1 / np.log2(place + 2.0)
    for top in np.argsort(place)[: min(n, most)]:
        other = np.flatnonzero((y != y[top]) & ((place > place[top])))
        if not len(other):
            continue
        up = np.where(y[top] > y[other], 1.0, -1.0)  # whether the higher place is the better one
        change = np.abs(gain[top] - gain[other]) * np.abs(discount[top] - discount[other]) / ideal
        q = sigmoid(-up * (s[top] - s[other]))
        first, second = change * q, np.maximum(change * q * (1 - q), 1e-16)
        g[top] -= (up * first).sum()
        np.add.at(g, other, up * first)
        h[top] += second.sum()
        np.add.at(h, other, second)
    return g, h


#: Rows of a query up to which queries of a size are taken together, and pairs of rows at once.
TOGETHER, AT_ONCE = 64, 1_000_000


def grouped_gradients(s: np.ndarray, y: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``ranking_gradients`` of many queries, whose rows follow one another; those of one size as one array."""
    g, h = np.zeros(len(y)), np.zeros(len(y))
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        first = starts[sizes == n]
        if n > TOGETHER:
            for at in first:
                g[at : at + n], h[at : at + n] = ranking_gradients(s[at : at + n], y[at : at + n], most)
            continue
        step = max(1, AT_ONCE // max(1, int(n) ** 2))
        for begin in range(0, len(first) if n > 1 else 0, step):
            at = first[begin : begin + step, None] + np.arange(n)
            score, label = s[at], y[at]
            gain = 2.0**label - 1
            ideal = (np.sort(gain, axis=1)[:, ::-1][:, :most] / np.log2(np.arange(2, min(n, most) + 2))).sum(axis=1)
            place = np.argsort(np.argsort(-score, axis=1, kind="stable"), axis=1, kind="stable")
            discount = 1 / np.log2(place + 2.0)
            # of each pair the higher place first
            pair = (place[:, :, None] < place[:, None, :]) & (place[:, :, None] < most) & (label[:, :, None] != label[:, None, :]) & (ideal > 0)[:, None, None]
            q, i, j = np.nonzero(pair)
            up = np.where(label[q, i] > label[q, j], 1.0, -1.0)
            change = np.abs(gain[q, i] - gain[q, j]) * np.abs(discount[q, i] - discount[q, j]) / ideal[q]
            chance = sigmoid(-up * (score[q, i] - score[q, j]))
            one, two = up * change * chance, np.maximum(change * chance * (1 - chance), 1e-16)
            top, other = at[q, i], at[q, j]
            low = int(at[0, 0])
            size = int(at[-1, -1]) + 1 - low
            part = slice(low, low + size)
            g[part] += np.bincount(other - low, one, size) - np.bincount(top - low, one, size)
            h[part] += np.bincount(other - low, two, size) + np.bincount(top - low, two, size)
    return g, h


def loss_of(p: Params, s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What validation adds up, by row; smaller is better."""
    if p.objective == "multiclass":
        return -np.log(np.maximum(softmax(s)[np.arange(len(y)), y.astype(int)], 1e-15))
    s = s[:, 0]
    if p.objective == "binary":
        return np.logaddexp(0, s) - y * s
    if p.objective in ("poisson", "tweedie", "gamma"):
        return np.exp(s) - y * s
    if p.objective in ("regression_l1", "mape"):
        return np.abs(s - y)
    if p.objective == "quantile":
        return np.where(y >= s, p.alpha, p.alpha - 1) * (y - s)
    return (s - y) ** 2


# Trees --------------------------------------------------------------------------------------------

def new_tree() -> dict[str, list]:
    return {"feature": [-1], "bin": [0], "limit": [0.0], "left": [-1], "right": [-1], "value": [0.0], "gain": [0.0], "count": [0]}


def leaves_of(tree: dict, bins: np.ndarray) -> np.ndarray:
    """Node of each binned row; bin 0 is missing and goes left."""
    feature, limit, left, right = (np.asarray(tree[k]) for k in ("feature", "bin", "left", "right"))
    at = np.zeros(len(bins), np.int64)
    live = np.arange(len(bins)) if feature[0] >= 0 else np.empty(0, np.int64)
    while len(live):
        n = at[live]
        at[live] = np.where(bins[live, feature[n]] <= limit[n], left[n], right[n])
        live = live[feature[at[live]] >= 0]
    return at


def raw_leaves(tree: dict, x: np.ndarray) -> np.ndarray:
    """Node of each row of values; a missing one goes left."""
    feature, limit, left, right = (np.asarray(tree[k]) for k in ("feature", "limit", "left", "right"))
    at = np.zeros(len(x), np.int64)
    live = np.arange(len(x)) if feature[0] >= 0 else np.empty(0, np.int64)
    while len(live):
        n = at[live]
        v = x[live, feature[n]]
        at[live] = np.where(~(v > limit[n]), left[n], right[n])
        live = live[feature[at[live]] >= 0]
    return at


def best_split(p: Params, hist: np.ndarray, allowed: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of one leaf's histogram (feature x bin x (g, h, n))."""
    left = hist.cumsum(axis=1)[:, :-1]
    total = hist.sum(axis=1)[:, None]
    right = total - left

    def part(x: np.ndarray) -> np.ndarray:
        g = np.maximum(np.abs(x[..., 0]) - p.lambda_l1, 0)
        return g * g / (x[..., 1] + p.lambda_l2 + 1e-12)

    gain = part(left) + part(right) - part(total)
    fine = (left[..., 2] >= p.min_data_in_leaf) & (right[..., 2] >= p.min_data_in_leaf) & (left[..., 1] >= p.min_sum_hessian) & (right[..., 1] >= p.min_sum_hessian)
    gain = np.where(fine & allowed[:, None], gain, -np.inf)
    at = int(gain.argmax())
    best = float(gain.ravel()[at])
    return None if not best > 1e-10 else (best, at // gain.shape[1], at % gain.shape[1])


def leaf_value(p: Params, g: float, h: float) -> float:
    return -math.copysign(max(abs(g) - p.lambda_l1, 0), g) / (h + p.lambda_l2 + 1e-12)


# Training -----------------------------------------------------------------------------------------

def _bin_limits(df: DataFrame, width: int, max_bin: int) -> list[list[float]]:
    """Upper limits of the bins of each feature, from approximate quantiles."""
    at = [(i + 1) / max_bin for i in range(max_bin - 1)]
    row = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.get("x", i)), F.get("x", i)), at, 10_000).alias(f"q{i}") for i in range(width)]).first()
    return [sorted(set(row[f"q{i}"] or [])) for i in range(width)]


def _bytes_of(column: pa.Array) -> bytes:
    """The values of a binary column one after another."""
    if not len(column):
        return b""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    return data.slice(int(at[column.offset]), int(at[column.offset + len(column)] - at[column.offset])).to_pybytes()


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of an array as a value."""
    data = np.ascontiguousarray(rows)
    wide = data.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    offsets = (np.arange(len(data) + 1) * wide).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


class _Rows:
    """A batch of the written table as arrays; the rows of a ranking's groups one after another."""

    def __init__(self, batch: pa.RecordBatch, ranked: bool, width: int, k: int):
        col = lambda name: batch.column(batch.schema.get_field_index(name))
        flat = (lambda c: c.flatten()) if ranked else (lambda c: c)
        self.sizes = col("y").value_lengths().to_numpy(zero_copy_only=False) if ranked else None
        self.bins = np.frombuffer(_bytes_of(flat(col("bins"))), np.uint8).reshape(-1, width)
        self.y, self.w = (flat(col(c)).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "w"))
        self.score = np.frombuffer(_bytes_of(flat(col("score"))), np.float64).reshape(-1, k)
        self.valid = flat(col("valid")).to_numpy(zero_copy_only=False).astype(bool)
        self.id = flat(col("id")).to_numpy(zero_copy_only=False)

    def gradients(self, p: Params, score: np.ndarray, fobj: Callable | None) -> tuple[np.ndarray, np.ndarray]:
        if fobj:
            g, h = fobj(score, self.y)
            g, h = np.reshape(g, score.shape), np.reshape(h, score.shape)
        elif p.objective == "lambdarank":
            g, h = (x[:, None] for x in grouped_gradients(score[:, 0], self.y, self.sizes, p.max_position))
        else:
            g, h = gradients(p, score, self.y)
        return g * self.w[:, None], h * self.w[:, None]

    def drawn(self, p: Params, iteration: int) -> np.ndarray:
        """Rows of this iteration's bag, and none that validate."""
        keep = ~self.valid
        if p.bagging_freq and p.bagging_fraction < 1:
            turn = iteration // p.bagging_freq
            h = (self.id.astype(np.uint64) + np.uint64(turn * 7919 + p.seed)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            keep &= (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(34)).astype(float) / (1 << 30) < p.bagging_fraction
        return keep


def _added(score: np.ndarray, bins: np.ndarray, trees: list[tuple[int, dict]]) -> np.ndarray:
    out = score.copy()
    for k, tree in trees:
        out[:, k] += np.asarray(tree["value"])[leaves_of(tree, bins)]
    return out


def fit_boosted(
    df: DataFrame, features_col: str = "features", label_col: str = "label", weight_col: str | None = None, group_col: str | None = None, validation_col: str | None = None,
    fobj: Callable | None = None, delegate=None, **options,
) -> Fitted:
    """A boosted model; options are those of ``Params``.

    Rows with a null label or features are left out; a missing value goes to the left of a split. Labels
    of classes are 0, 1, 2 ... With ``validation_col`` (true: not trained on) and ``early_stopping`` the
    model ends so many iterations after its best one. ``fobj(score, label)`` gives gradients and hessians
    in place of the objective. A ``delegate`` may have ``learning_rate(iteration)`` and
    ``after(iteration, loss)``.
    """
    p = Params(**options)
    ranked = p.objective == "lambdarank"
    if ranked != (group_col is not None):
        raise ValueError("lambdarank needs group_col, and nothing else has one")
    spark = df.sparkSession
    weight = F.col(f"`{weight_col}`").cast("double") if weight_col else F.lit(1.0)
    valid = F.coalesce(F.col(f"`{validation_col}`").cast("boolean"), F.lit(False)) if validation_col else F.lit(False)
    vector = F.col(f"`{features_col}`")
    x = vector_values(vector) if df.schema[features_col].dataType.typeName() == "vector" else vector.cast("array<double>")
    group = [F.col(f"`{group_col}`").alias("group")] if ranked else []
    rows = df.select(x.alias("x"), F.col(f"`{label_col}`").cast("double").alias("y"), weight.alias("w"), valid.alias("valid"), *group).where("x IS NOT NULL AND y IS NOT NULL")
    rows = write_table(rows, "boost-rows")
    about = rows.where("NOT valid").agg(F.max(F.size("x")), F.sum(F.col("w") * F.col("y")) / F.sum("w"), F.max("y"), F.sum(F.when(F.col("y") > 0, F.col("w")).otherwise(0.0)), F.sum("w")).first()
    if about[0] is None:
        raise ValueError("no rows with label and features")
    width, mean = about[0], about[1]
    k = p.n_classes if p.objective == "multiclass" and p.n_classes > 1 else int(about[2]) + 1 if p.objective == "multiclass" else 1
    p.n_classes = k
    if p.unbalanced and p.objective == "binary":
        lift = (about[4] - about[3]) / max(about[3], 1e-12)
        rows = rows.withColumn("w", F.col("w") * F.when(F.col("y") > 0, lift).otherwise(1.0))
    limits = _bin_limits(rows.where("NOT valid"), width, min(p.max_bin, 255))
    n_bins = max(map(len, limits), default=0) + 2
    start = np.zeros(k)
    if p.boost_from_average and not fobj:
        if p.objective == "binary":
            q = min(max(mean, 1e-6), 1 - 1e-6)
            start[0] = math.log(q / (1 - q))
        elif p.objective in ("poisson", "gamma", "tweedie"):
            start[0] = math.log(max(mean, 1e-12))
        elif p.objective in ("regression", "huber", "fair"):
            start[0] = mean
        elif p.objective in ("regression_l1", "mape", "quantile"):
            start[0] = rows.where("NOT valid").agg(F.percentile_approx("y", p.alpha if p.objective == "quantile" else 0.5, 100_000)).first()[0]
    edges = [np.array(x) for x in limits]
    zero = start.tobytes()

    def binned(column: pa.Array) -> pa.Array:
        if (column.value_lengths().to_numpy(zero_copy_only=False) == width).all():
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            return _binary(np.stack([np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v)) for v, e in zip(x.T, edges)], axis=1).astype(np.uint8))
        out = []
        for row in column.to_pylist():
            v = np.array([np.nan if a is None else a for a in row], float)
            b = [0 if math.isnan(a) else 1 + int(np.searchsorted(e, a)) for a, e in zip(v, edges)]
            out.append(bytes(b))
        return pa.array(out, pa.binary())

    table = rows.select(F.arrow_udf(binned, "binary")("x").alias("bins"), "y", "w", "valid", F.monotonically_increasing_id().alias("id"), F.lit(zero).alias("score"), *(["group"] if ranked else []))
    if ranked:
        table = write_table(table, "boost-bins")
        table = table.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("id", "bins", "y", "w", "valid", "score"))).alias("r"))
        table = table.select(*[F.col("r")[c].alias(c) for c in ("bins", "y", "w", "valid", "id", "score")])
    table = write_table(table, "boost-bins")

    def histograms(tree: dict, which: int, since: list, iteration: int, wanted: list[int]) -> dict[int, np.ndarray]:
        def run(batches):
            sums = np.zeros((len(wanted), width, n_bins, 3))
            slot = np.full(len(tree["feature"]), -1)
            slot[wanted] = np.arange(len(wanted))
            for batch in batches:
                r = _Rows(batch, ranked, width, k)
                if not len(r.y):
                    continue
                g, h = r.gradients(p, _added(r.score, r.bins, since), fobj)
                at = slot[leaves_of(tree, r.bins)]
                use = np.flatnonzero((at >= 0) & r.drawn(p, iteration))
                for f in range(width):
                    index = at[use] * n_bins + r.bins[use, f]
                    for i, v in enumerate((g[use, which], h[use, which], None)):
                        sums[:, f, :, i] += np.bincount(index, v, len(wanted) * n_bins).reshape(len(wanted), n_bins)
            for i, leaf in enumerate(wanted):
                yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int32()), pa.array([sums[i].tobytes()], pa.binary())], names=["leaf", "sums"])

        def total(key, batches):
            found = sum(np.frombuffer(v, np.float64) for b in batches for v in b.column("sums").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=["leaf", "sums"])

        # typed by hand: annotations of this module are text
        total.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
        schema = "leaf int, sums binary"
        # at most num_leaves histograms
        rows_ = table.mapInArrow(run, schema).groupBy("leaf").applyInArrow(total, schema).collect()
        return {r["leaf"]: np.frombuffer(bytes(r["sums"])).reshape(width, n_bins, 3) for r in rows_}

    def grown(which: int, since: list, iteration: int, rate: float, allowed: np.ndarray) -> dict:
        tree, open_, depth, n_leaves = new_tree(), [0], 0, 1
        while open_:
            found = histograms(tree, which, since, iteration, open_)
            choices = []
            for leaf in open_:
                sums = found[leaf][0].sum(axis=0) if leaf in found else np.zeros(3)
                tree["value"][leaf], tree["count"][leaf] = leaf_value(p, sums[0], sums[1]) * rate, int(sums[2])
                if leaf in found and (p.max_depth < 0 or depth < p.max_depth) and (split := best_split(p, found[leaf], allowed)):
                    choices.append((split[0], leaf, split[1], split[2]))
            choices.sort(reverse=True)
            open_ = []
            for gain, leaf, feature, at in choices[: p.num_leaves - n_leaves]:
                for side in ("left", "right"):
                    tree[side][leaf] = len(tree["feature"])
                    for name, v in (("feature", -1), ("bin", 0), ("limit", 0.0), ("left", -1), ("right", -1), ("value", 0.0), ("gain", 0.0), ("count", 0)):
                        tree[name].append(v)
                    open_.append(len(tree["feature"]) - 1)
                # bin b holds values up to limits[b - 1]; the last bin has no limit
                limit = limits[feature][at - 1] if 0 < at <= len(limits[feature]) else -math.inf if at == 0 else math.inf
                tree["feature"][leaf], tree["bin"][leaf], tree["limit"][leaf], tree["gain"][leaf] = feature, at, limit, gain
                n_leaves += 1
            depth += 1
        return tree

    def renewed(tree: dict, since: list, rate: float) -> None:
        """Leaves of absolute losses take the quantile of what is left to explain."""
        share = p.alpha if p.objective == "quantile" else 0.5

        def run(batches):
            for batch in batches:
                r = _Rows(batch, ranked, width, k)
                left = r.y - _added(r.score, r.bins, since)[:, 0]
                at = leaves_of(tree, r.bins)
                yield pa.RecordBatch.from_arrays([pa.array(at[~r.valid], pa.int64()), pa.array(left[~r.valid])], names=["leaf", "rest"])

        for r in table.mapInArrow(run, "leaf long, rest double").groupBy("leaf").agg(F.percentile_approx("rest", share, 10_000).alias("v")).collect():
            tree["value"][r["leaf"]] = r["v"] * rate

    def validation(since: list) -> float:
        def run(batches):
            total = n = 0.0
            for batch in batches:
                r = _Rows(batch, ranked, width, k)
                if not r.valid.any():
                    continue
                s = _added(r.score, r.bins, since)
                if ranked:
                    for size, end in zip(r.sizes, np.cumsum(r.sizes)):
                        if r.valid[end - size]:
                            total, n = total - ndcg(s[end - size : end, 0], r.y[end - size : end], p.max_position), n + 1
                else:
                    total += float((loss_of(p, s[r.valid], r.y[r.valid]) * r.w[r.valid]).sum())
                    n += float(r.w[r.valid].sum())
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n])], names=["total", "n"])

        r = table.mapInArrow(run, "total double, n double").agg(F.sum("total"), F.sum("n")).first()
        return r[0] / r[1] if r[1] else math.nan

    def updated(since: list) -> DataFrame:
        def run(batches):
            for batch in batches:
                r = _Rows(batch, ranked, width, k)
                column = _binary(_added(r.score, r.bins, since))
                at = batch.schema.get_field_index("score")
                if ranked:
                    column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(r.sizes)]), pa.int32()), column)
                yield batch.set_column(at, "score", column)

        return write_table(table.mapInArrow(run, table.schema), "boost-bins")

    trees: list[tuple[int, dict]] = []
    since: list[tuple[int, dict]] = []
    best, best_at, history = math.inf, 0, []
    rng = np.random.default_rng(p.seed)
    for iteration in range(p.n_iterations):
        rate = delegate.learning_rate(iteration) if hasattr(delegate, "learning_rate") else p.learning_rate
        now = []
        for which in range(k):
            allowed = np.ones(width, bool)
            if p.feature_fraction < 1:
                allowed[:] = False
                allowed[rng.permutation(width)[: max(1, round(p.feature_fraction * width))]] = True
            tree = grown(which, since, iteration, rate, allowed)
            if p.objective in ("regression_l1", "quantile") and not fobj:
                renewed(tree, since, rate)
            now.append((which, tree))
        trees += now
        since = since + now
        loss = None
        if validation_col:
            loss = validation(since)
            history.append(loss)
            if loss < best:
                best, best_at = loss, iteration + 1
        if hasattr(delegate, "after"):
            delegate.after(iteration, loss)
        if p.early_stopping and validation_col and iteration + 1 - best_at >= p.early_stopping:
            break
        if len(since) >= KEEP * k:
            table, since = updated(since), []
    if p.early_stopping and validation_col:
        trees = trees[: best_at * k]
    kept = {key: value for key, value in asdict(p).items() if not isinstance(value, float) or math.isfinite(value)}
    return Fitted(score_boosted, features_col=features_col, params=kept, start=start.tolist(), trees=[[w, t] for w, t in trees], width=width, history=history)


# Scoring ------------------------------------------------------------------------------------------

def ndcg(s: np.ndarray, y: np.ndarray, k: int) -> float:
    gain = 2.0**y - 1
    d = 1 / np.log2(np.arange(2, min(len(y), k) + 2))
    ideal = float((np.sort(gain)[::-1][:k] * d).sum())
    return float((gain[np.argsort(-s, kind="stable")][:k] * d).sum()) / ideal if ideal > 0 else 1.0


def raw_scores(trees: list, start: list[float], x: np.ndarray) -> np.ndarray:
    out = np.tile(np.array(start, float), (len(x), 1))
    for which, tree in trees:
        out[:, which] += np.asarray(tree["value"])[raw_leaves(tree, x)]
    return out


def contributions(tree: dict, x: np.ndarray, width: int) -> np.ndarray:
    """Shapley values of one row by one tree (path dependent), with the tree's mean at the end.

    Features outside a coalition go down both ways by the share of training rows; the value of a
    coalition is then a sum over leaves of value x product over the features of the leaf's path, so the
    Shapley value is a sum over leaves of weights that depend on the numbers of features only.
    """
    out = np.zeros(width + 1)

    def walk(node: int, path: dict[int, tuple[float, float]]) -> None:
        f = tree["feature"][node]
        if f < 0:
            value, names = tree["value"][node], list(path)
            m = len(names)
            zeros, ones = np.array([path[n][0] for n in names]), np.array([path[n][1] for n in names])
            out[width] += value * float(np.prod(zeros)) if m else value
            for i, name in enumerate(names):
                # polynomial in the size of the coalition of the other features
                poly = np.array([1.0])
                for j in range(m):
                    if j != i:
                        poly = np.convolve(poly, [zeros[j], ones[j]])
                weight = sum(poly[size] * math.factorial(size) * math.factorial(m - 1 - size) / math.factorial(m) for size in range(m))
                out[name] += value * (ones[i] - zeros[i]) * weight
            return
        left, right = tree["left"][node], tree["right"][node]
        hot = left if not x[f] > tree["limit"][node] else right
        for child in (left, right):
            zero, one = path.get(f, (1.0, 1.0))
            share = tree["count"][child] / max(1, tree["count"][node])
            walk(child, {**path, f: (zero * share, one * (child == hot))})

    walk(0, {})
    return out


def score_boosted(df: DataFrame, features_col: str, params: dict, start: list[float], trees: list, width: int, history: list, leaf_col: str | None = None, shap_col: str | None = None) -> DataFrame:
    """Adds ``rawPrediction`` and ``probability`` of classes, and ``prediction``; leaves and Shapley values if named.

    Rows without features have nulls.
    """
    p = Params(**params)
    model = df.sparkSession.sparkContext.broadcast((trees, start))
    fields = ["raw", "chance", *(["leaf"] if leaf_col else []), *(["shap"] if shap_col else [])]
    kind = "struct<" + ",".join(f"{n}:array<double>" for n in fields) + ">"

    def run(column: pa.Array) -> pa.Array:
        sizes, (all_trees, base) = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), model.value
        fine = sizes >= 0
        x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(fine.sum()), -1) if fine.any() else np.empty((0, width))
        raw = raw_scores(all_trees, base, x)
        found = {"raw": raw, "chance": softmax(raw) if len(raw) else raw}
        if leaf_col:
            found["leaf"] = np.stack([raw_leaves(t, x) for _, t in all_trees], axis=1).astype(float) if all_trees else np.empty((len(x), 0))
        if shap_col:
            found["shap"] = np.empty((len(x), len(base) * (width + 1)))
            for j in range(len(x)):
                parts = np.zeros((len(base), width + 1))
                parts[:, width] = base
                for which, t in all_trees:
                    parts[which] += contributions(t, x[j], width)
                found["shap"][j] = parts.ravel()
        before = np.concatenate([[0], np.cumsum(fine)])
        lists = [pa.ListArray.from_arrays(pa.array(before * found[n].shape[1], pa.int32()), pa.array(found[n].ravel(), pa.float64())) for n in fields]
        return pa.StructArray.from_arrays(lists, names=fields, mask=pa.array(~fine))

    vector = F.col(f"`{features_col}`")
    x = vector_values(vector) if df.schema[features_col].dataType.typeName() == "vector" else vector.cast("array<double>")
    (name,) = fresh(df.columns, "scored")
    out = df.withColumn(name, F.arrow_udf(run, kind)(x))
    raw = F.col(name)["raw"]
    if p.objective == "binary":
        q = 1 / (1 + F.exp(-F.get(raw, 0)))
        out = out.withColumn("rawPrediction", F.when(raw.isNotNull(), F.array(-F.get(raw, 0), F.get(raw, 0)))).withColumn("probability", F.when(raw.isNotNull(), F.array(1 - q, q)))
        out = out.withColumn("prediction", F.when(raw.isNotNull(), (q > 0.5).cast("double")))
    elif p.objective == "multiclass":
        out = out.withColumn("rawPrediction", raw).withColumn("probability", F.col(name)["chance"])
        out = out.withColumn("prediction", (F.array_position(raw, F.array_max(raw)) - 1).cast("double"))
    elif p.objective in ("poisson", "gamma", "tweedie"):
        out = out.withColumn("prediction", F.exp(F.get(raw, 0)))
    else:
        out = out.withColumn("prediction", F.get(raw, 0))
    if leaf_col:
        out = out.withColumn(leaf_col, F.col(name)["leaf"])
    if shap_col:
        out = out.withColumn(shap_col, F.col(name)["shap"])
    return out.drop(name)


def importances(model: Fitted, kind: str = "split") -> list[float]:
    """How often each feature splits, or the gain of its splits."""
    out = [0.0] * model.width
    for _, tree in model.trees:
        for f, gain in zip(tree["feature"], tree["gain"]):
            if f >= 0:
                out[f] += 1.0 if kind == "split" else gain
    return out
