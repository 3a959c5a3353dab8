"""Local explanations of any model: LIME and kernel SHAP over vectors, columns, texts and images.

Samples are columns: an instance is exploded to its samples, whose random numbers are hashes of instance,
sample and feature, so that a lost task draws the same ones. The model scores them as one table, and a
small regression is solved for each instance, whose samples are bounded in number.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagekit.operators.images import masked, superpixels
from stagekit.plans.session import fresh, write_table

#: Weight of the empty and the full coalition, which the fit has to meet.
SURE = 1e8
#: Background rows and levels of a nominal column at most.
BACKGROUND, LEVELS = 10_000, 1_000


# Regressions of one instance ----------------------------------------------------------------------

def least_squares(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, intercept: bool = True) -> tuple[np.ndarray, float, float]:
    """Weighted least squares: coefficients, intercept, r squared."""
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    mean_x, mean_y = (np.average(x, axis=0, weights=w), np.average(y, weights=w)) if intercept else (np.zeros(x.shape[1]), 0.0)
    root = np.sqrt(w)[:, None]
    beta = np.linalg.lstsq((x - mean_x) * root, (y - mean_y) * root[:, 0], rcond=None)[0]
    return beta, float(mean_y - mean_x @ beta), r_squared(x @ beta + mean_y - mean_x @ beta, y, w)


def lasso(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, penalty: float = 0.0, intercept: bool = True, rounds: int = 1000, tolerance: float = 1e-5) -> tuple[np.ndarray, float, float]:
    """Weighted lasso by coordinate descent, weights scaled to their number: coefficients, intercept, r squared."""
    n = len(y)
    w = np.ones(n) if w is None else np.asarray(w, float) * n / np.sum(w)
    mean_x, mean_y = (np.average(x, axis=0, weights=w), np.average(y, weights=w)) if intercept else (np.zeros(x.shape[1]), 0.0)
    a, b = x - mean_x, y - mean_y
    gram, target = a.T @ (a * w[:, None]), a.T @ (b * w)
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        before = beta.copy()
        for j in np.flatnonzero(np.diag(gram) > 0):
            rho = target[j] - gram[j] @ beta + gram[j, j] * beta[j]
            beta[j] = np.sign(rho) * max(abs(rho) - n * penalty, 0.0) / gram[j, j]
        if np.abs(beta - before).max(initial=0.0) <= tolerance:
            break
    constant = float(mean_y - mean_x @ beta)
    return beta, constant, r_squared(x @ beta + constant, y, w)


def r_squared(fit: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    spread = float(np.sum(w * (y - np.average(y, weights=w)) ** 2))
    return 1.0 - float(np.sum(w * (y - fit) ** 2)) / spread if spread > 0 else 1.0


# Coalitions ---------------------------------------------------------------------------------------

def effective_samples(m: int, wanted: int | None) -> int:
    return int(min(max(wanted or 2 * m + 2048, m + 2), 2**min(m, 60)))


def coalitions(m: int, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``n`` subsets of ``m`` features as rows of 0 and 1, and their weights.

    The empty and the full one come first. Sizes k and m - k follow together while what is left, shared by
    kernel weight, covers all their subsets, which then are all listed with the kernel's weight; the rest
    is drawn by size and shares the remaining weight.
    """
    rows, weights = [np.zeros(m), np.ones(m)], [SURE, SURE]
    left = n - 2
    sizes = list(range(1, m // 2 + 1))
    mass = {k: (m - 1) / (k * (m - k)) * (1 if 2 * k == m else 2) for k in sizes}
    while sizes and left > 0:
        k = sizes[0]
        both = math.comb(m, k) * (1 if 2 * k == m else 2)
        if left * mass[k] / sum(mass[s] for s in sizes) < both - 1e-9:
            break
        for size in {k, m - k}:
            for chosen in combinations(range(m), size):
                row = np.zeros(m)
                row[list(chosen)] = 1
                rows.append(row)
                weights.append(mass[k] / both)
        left -= both
        sizes.pop(0)
    if sizes and left > 0:
        rng = np.random.default_rng(seed)
        share = np.array([mass[s] for s in sizes])
        drawn = rng.choice(sizes, size=left, p=share / share.sum())
        for i, k in enumerate(drawn):
            row = np.zeros(m)
            row[rng.permutation(m)[:k]] = 1
            rows.append(row if i % 2 == 0 else 1 - row)
            weights.append(share.sum() / left)
    return np.array(rows), np.array(weights)


def _coalition_column(m: Column, key: Column, wanted: int | None) -> Column:
    """(mask, weight) of every coalition of an instance with ``m`` features."""

    def run(sizes: pa.Array, keys: pa.Array) -> pa.Array:
        out = []
        for k, seed in zip(sizes.to_pylist(), keys.to_pylist()):
            if not k:
                out.append([])
                continue
            masks, weights = coalitions(k, effective_samples(k, wanted), seed & 0x7FFFFFFF)
            out.append([{"state": s, "weight": w} for s, w in zip(masks.tolist(), weights.tolist())])
        return pa.array(out, pa.list_(pa.struct([("state", pa.list_(pa.float64())), ("weight", pa.float64())])))

    return F.arrow_udf(run, "array<struct<state:array<double>,weight:double>>")(m, key)


# The frame that all explainers share --------------------------------------------------------------

def target_values(df: DataFrame, target_col: str, classes: list[int] | None) -> Column:
    """The explained numbers of a row: a number, or the slots of a vector or array, or the keys of a map."""
    kind, x = df.schema[target_col].dataType.typeName(), F.col(f"`{target_col}`")
    if kind == "vector":
        x, kind = vector_to_array(x), "array"
    if kind == "array":
        return F.array(*[F.get(x, c) for c in classes]) if classes else x.cast("array<double>")
    if kind == "map":
        return F.array(*[F.try_element_at(x, F.lit(c)).cast("double") for c in classes or []])
    return F.array(x.cast("double"))


def _uniform(*key) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11) + 0.5) / float(1 << 53)


def _normal(*key) -> Column:
    return F.sqrt(-2 * F.log(_uniform(*key, F.lit(1)))) * F.cos(2 * math.pi * _uniform(*key, F.lit(2)))


Model = Callable[[DataFrame], DataFrame]


def _scored(model, samples: DataFrame) -> DataFrame:
    return model.transform(samples) if hasattr(model, "transform") else model(samples)


def _instances(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows with a number each, written down so that it stays theirs."""
    names = fresh(df.columns, "instance", "sample", "state", "weight", "target", "features")
    return write_table(df.withColumn(names[0], F.monotonically_increasing_id()), "explain"), names


def _solved(kept: DataFrame, scored: DataFrame, names: list[str], output_col: str, metrics_col: str, solve: Callable) -> DataFrame:
    """The regression of each instance over its scored samples, joined to the instances."""
    instance, _, state, weight, target, _ = names

    def run(table: pa.Table) -> pa.Table:
        x = np.array(table["state"].to_pylist(), float)
        y = np.array(table["target"].to_pylist(), float)
        w = table["weight"].to_numpy()
        found = [solve(x, y[:, i], w) for i in range(y.shape[1])]
        return pa.table({
            "instance": [table["instance"][0].as_py()], "coefficients": pa.array([[f[0].tolist() for f in found]], pa.list_(pa.list_(pa.float64()))),
            "r2": pa.array([[f[1] for f in found]], pa.list_(pa.float64())),
        })

    rows = scored.select(F.col(instance).alias("instance"), F.col(state).alias("state"), F.col(weight).alias("weight"), F.col(target).alias("target"))
    fitted = rows.groupBy("instance").applyInArrow(run, "instance long, coefficients array<array<double>>, r2 array<double>")
    out = fitted.select(F.col("instance").alias(instance), F.col("coefficients").alias(output_col), F.col("r2").alias(metrics_col))
    return kept.join(out, instance, "left").drop(instance)


def _lime(df: DataFrame, model, make: Callable, n_samples: int, kernel_width: float, penalty: float, target_col: str, classes: list[int] | None, output_col: str, metrics_col: str) -> DataFrame:
    kept, names = _instances(df)
    instance, sample, state, weight, target, _ = names
    many = kept.withColumn(sample, F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    samples, distance = make(many, names)
    samples = samples.withColumn(weight, F.sqrt(F.exp(-F.pow(distance / kernel_width, 2))))
    scored = _scored(model, samples)
    scored = scored.withColumn(target, target_values(scored, target_col, classes))

    def solve(x, y, w):
        beta, _, r2 = lasso(x, y, w, penalty)
        return beta, r2

    return _solved(kept, scored, names, output_col, metrics_col, solve)


def _shap(df: DataFrame, model, n_features: Column, make: Callable, n_samples: int | None, target_col: str, classes: list[int] | None, output_col: str, metrics_col: str) -> DataFrame:
    kept, names = _instances(df)
    instance, sample, state, weight, target, _ = names
    many = kept.select("*", F.posexplode(_coalition_column(n_features, F.xxhash64(F.col(instance)), n_samples)).alias(sample, state))
    many = many.withColumn(weight, F.col(state)["weight"]).withColumn(state, F.col(state)["state"])
    scored = _scored(model, make(many, names))
    scored = scored.withColumn(target, target_values(scored, target_col, classes))
    # the mean over the background rows of each coalition
    each = scored.select(instance, sample, F.col(state).alias(state), F.col(weight).alias(weight), F.posexplode(target).alias("slot", "value"))
    by_slot = each.groupBy(instance, sample, "slot").agg(F.avg("value").alias("value"), F.first(state).alias(state), F.first(weight).alias(weight))
    means = by_slot.groupBy(instance, sample).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "value"))), lambda s: s["value"]).alias(target), F.first(state).alias(state), F.first(weight).alias(weight)
    )

    def solve(x, y, w):
        beta, constant, r2 = least_squares(x, y, w)
        return np.concatenate([[constant], beta]), r2

    return _solved(kept, means, names, output_col, metrics_col, solve)


def _small(background: DataFrame) -> DataFrame:
    """The background table for every executor, after a look at its size."""
    if background.limit(BACKGROUND + 1).count() > BACKGROUND:
        raise ValueError(f"a background of more than {BACKGROUND} rows; sample it first")
    return F.broadcast(background)


# Vectors and columns ------------------------------------------------------------------------------

LIME = dict(n_samples=1000, kernel_width=0.75, penalty=0.0, target_col="probability", classes=None, output_col="explanation", metrics_col="r2")
SHAP = dict(n_samples=None, target_col="probability", classes=None, output_col="explanation", metrics_col="r2")


def vector_lime(df: DataFrame, model, input_col: str, background: DataFrame, **options) -> DataFrame:
    """Every slot moved by normal noise of the background's deviation; distances are in deviations."""
    from pyspark.ml.stat import Summarizer

    dev = background.select(Summarizer.std(F.col(f"`{input_col}`")).alias("s")).first()["s"].toArray().tolist()
    scale = F.array(*[F.lit(float(s)) for s in dev])

    def make(many: DataFrame, names: list[str]):
        instance, sample, state = names[:3]
        x = vector_to_array(F.col(f"`{input_col}`"))
        noise = F.transform(scale, lambda s, i: F.when(F.col(sample) == 0, 0.0).otherwise(_normal(F.col(instance), F.col(sample), i)))
        out = many.withColumn(names[5], noise)
        out = out.withColumn(state, F.zip_with(x, F.zip_with(names[5], scale, lambda z, s: z * s), lambda a, b: a + b))
        out = out.withColumn(input_col, array_to_vector(F.col(state)))
        return out, F.sqrt(F.aggregate(F.col(names[5]), F.lit(0.0), lambda a, z: a + z * z) / F.size(names[5]))

    return _lime(df, model, make, **{**LIME, **options})


def tabular_lime(df: DataFrame, model, input_cols: list[str], background: DataFrame, categorical: tuple[str, ...] = (), **options) -> DataFrame:
    """Number columns moved by normal noise, nominal ones drawn by their frequency in the background
    (the ``LEVELS`` most frequent), with a state of 1 where the level stayed. The first sample is the row itself."""
    stats: dict = {}
    for c in input_cols:
        if c in categorical:
            top = background.groupBy(F.col(f"`{c}`").alias("v")).count().orderBy(F.desc("count"), "v").limit(LEVELS).collect()
            total = sum(r["count"] for r in top)
            ends = np.cumsum([r["count"] / total for r in top]).tolist()
            stats[c] = ([r.v for r in top], ends)
        else:
            stats[c] = float(background.agg(F.stddev_samp(f"`{c}`")).first()[0] or 0.0)

    def make(many: DataFrame, names: list[str]):
        instance, sample, state = names[:3]
        first, states, squares, values = F.col(sample) == 0, [], [], {}
        for i, c in enumerate(input_cols):
            x, key = F.col(f"`{c}`"), (F.col(instance), F.col(sample), F.lit(i))
            if c in categorical:
                levels, ends = stats[c]
                at = F.aggregate(F.array(*[F.lit(e) for e in ends[:-1]] or [F.lit(2.0)]), F.lit(0), lambda a, e, key=key: a + (_uniform(*key) > e).cast("int"))
                kind = many.schema[c].dataType.simpleString()
                drawn = F.when(first, x).otherwise(F.get(F.array(*[F.lit(v).cast(kind) for v in levels]), at))
                same = drawn.eqNullSafe(x).cast("double")
                states.append(same)
                squares.append(F.pow(1 - same, 2))
            else:
                z = F.when(first, 0.0).otherwise(_normal(*key))
                drawn = x.cast("double") + z * stats[c]
                states.append(drawn)
                squares.append(z * z)
            values[c] = drawn
        total = squares[0]
        for s in squares[1:]:
            total = total + s
        out = many.withColumn(state, F.array(*states)).withColumn(names[5], F.sqrt(total / len(input_cols)))
        return out.withColumns(values), F.col(names[5])

    return _lime(df, model, make, **{**LIME, **options})


def vector_shap(df: DataFrame, model, input_col: str, background: DataFrame, **options) -> DataFrame:
    """The intercept and the share of every slot; a slot outside a coalition takes the background's values."""
    other = _small(background.select(F.col(f"`{input_col}`").alias("other_vector")))

    def make(many: DataFrame, names: list[str]) -> DataFrame:
        both = F.arrays_zip(vector_to_array(F.col(f"`{input_col}`")).alias("a"), vector_to_array("other_vector").alias("b"), F.col(names[2]).alias("s"))
        mixed = F.transform(both, lambda r: F.when(r["s"] == 1, r["a"]).otherwise(r["b"]))
        # the background is small, see _small
        return many.crossJoin(other).withColumn(input_col, array_to_vector(mixed)).drop("other_vector")

    return _shap(df, model, F.size(vector_to_array(F.col(f"`{input_col}`"))), make, **{**SHAP, **options})


def tabular_shap(df: DataFrame, model, input_cols: list[str], background: DataFrame, **options) -> DataFrame:
    """As ``vector_shap`` over columns of any type."""
    taken = fresh(df.columns, *[f"other_{i}" for i in range(len(input_cols))])
    other = _small(background.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(input_cols, taken)]))

    def make(many: DataFrame, names: list[str]) -> DataFrame:
        mixed = {c: F.when(F.get(F.col(names[2]), i) == 1, F.col(f"`{c}`")).otherwise(F.col(o)) for i, (c, o) in enumerate(zip(input_cols, taken))}
        return many.crossJoin(other).withColumns(mixed).drop(*taken)

    return _shap(df, model, F.lit(len(input_cols)), make, **{**SHAP, **options})


# Texts and images ---------------------------------------------------------------------------------

def _kept_tokens(tokens: Column, state: Column) -> Column:
    both = F.filter(F.arrays_zip(tokens.alias("t"), state.alias("s")), lambda r: r["s"] == 1)
    return F.array_join(F.transform(both, lambda r: r["t"]), " ")


def _switches(n: Column, names: list[str], fraction: float) -> Column:
    """Each feature on with a chance of ``fraction``."""
    return F.transform(F.sequence(F.lit(1), n), lambda i: (_uniform(F.col(names[0]), F.col(names[1]), i) < fraction).cast("double"))


def _off_distance(state: Column) -> Column:
    return F.sqrt(F.aggregate(state, F.lit(0.0), lambda a, s: a + 1 - s)) / F.sqrt(F.size(state))


def _with_tokens(df: DataFrame, input_col: str, tokens_col: str) -> DataFrame:
    words = F.filter(F.split(F.col(f"`{input_col}`"), r"\s+"), lambda t: t != "")
    return df.withColumn(tokens_col, F.coalesce(words, F.array().cast("array<string>")))


def text_lime(df: DataFrame, model, input_col: str, tokens_col: str = "tokens", fraction: float = 0.7, **options) -> DataFrame:
    """Words switched off; ``tokens_col`` names them. A text without words has no explanation."""

    def make(many: DataFrame, names: list[str]):
        out = many.where(F.size(tokens_col) > 0).withColumn(names[2], _switches(F.size(tokens_col), names, fraction))
        return out.withColumn(input_col, _kept_tokens(F.col(tokens_col), F.col(names[2]))), _off_distance(F.col(names[2]))

    return _lime(_with_tokens(df, input_col, tokens_col), model, make, **{**LIME, **options})


def text_shap(df: DataFrame, model, input_col: str, tokens_col: str = "tokens", **options) -> DataFrame:
    """The intercept and the share of every word; a word outside a coalition is left out."""

    def make(many: DataFrame, names: list[str]) -> DataFrame:
        return many.withColumn(input_col, _kept_tokens(F.col(tokens_col), F.col(names[2])))

    return _shap(_with_tokens(df, input_col, tokens_col), model, F.size(tokens_col), make, **{**SHAP, **options})


def image_lime(df: DataFrame, model, input_col: str = "image", superpixel_col: str = "superpixels", fraction: float = 0.7, cell: float = 16.0, modifier: float = 130.0, **options) -> DataFrame:
    """Superpixels switched to black."""

    def make(many: DataFrame, names: list[str]):
        out = many.where(F.col(superpixel_col).isNotNull()).withColumn(names[2], _switches(F.array_max(superpixel_col) + 1, names, fraction))
        return out.withColumn(input_col, masked(F.col(input_col), F.col(superpixel_col), F.col(names[2]))), _off_distance(F.col(names[2]))

    return _lime(superpixels(df, input_col, superpixel_col, cell, modifier), model, make, **{**LIME, "n_samples": 900, **options})


def image_shap(df: DataFrame, model, input_col: str = "image", superpixel_col: str = "superpixels", cell: float = 16.0, modifier: float = 130.0, **options) -> DataFrame:
    """The intercept and the share of every superpixel; one outside a coalition is black."""

    def make(many: DataFrame, names: list[str]) -> DataFrame:
        return many.withColumn(input_col, masked(F.col(input_col), F.col(superpixel_col), F.col(names[2])))

    cut = superpixels(df, input_col, superpixel_col, cell, modifier)
    return _shap(cut, model, F.coalesce(F.array_max(superpixel_col) + 1, F.lit(0)), make, **{**SHAP, **options})
