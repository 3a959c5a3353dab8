"""Hashed features of any typed columns, their interactions, and linear learners over them.

Hashed features are a struct (size, indices, values) of a sparse vector with ascending indices: plain
columns that every function reads. ``to_sparse`` and ``from_vector`` change to and from ``pyspark.ml``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagekit.base import Fitted
from stagekit.operators.columns import vector_values
from stagekit.plans.session import write_table

# The constants of 32-bit MurmurHash3, and the FNV prime.
C1, C2, STEP, MIX1, MIX2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
FNV_PRIME = 16777619
WORD = (1 << 32) - 1
SPARSE = "struct<size:int,indices:array<int>,values:array<double>>"
PART = "array<struct<key:string,seed:int,shift:int,value:double,slot:int>>"


def _turn(x: int, by: int) -> int:
    return (x << by | x >> 32 - by) & WORD


def murmur32(data: bytes | str, seed: int = 0) -> int:
    """32-bit MurmurHash3, as a signed number."""
    data = data.encode() if isinstance(data, str) else data
    h = seed & WORD
    for at in range(0, len(data), 4):
        block = data[at : at + 4]
        h ^= _turn(int.from_bytes(block, "little") * C1 & WORD, 15) * C2 & WORD
        if len(block) == 4:
            h = (_turn(h, 13) * 5 + STEP) & WORD
    h ^= len(data)
    for shift, factor in ((16, MIX1), (13, MIX2)):
        h = (h ^ h >> shift) * factor & WORD
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def _parts(kind: T.DataType, name: str, x: Column, space: int, seed: int, split: list[str], prefix: bool, mask: int) -> Column:
    """The features of one value: a key to hash, or a slot that is known already."""
    lead = name if prefix else ""

    def part(key=None, value=1.0, slot=None, shift=0):
        value = value if isinstance(value, Column) else F.lit(value)
        return F.struct(
            (F.lit(None).cast("string") if key is None else key).alias("key"), F.lit(space).alias("seed"), (shift if isinstance(shift, Column) else F.lit(shift)).alias("shift"),
            value.cast("double").alias("value"), (F.lit(None).cast("int") if slot is None else slot).alias("slot"),
        )

    none = F.array().cast(PART)
    own = F.lit(murmur32(lead, space) & mask)
    if isinstance(kind, T.BooleanType):
        found = F.when(x, F.array(part(slot=own)))
    elif isinstance(kind, T.NumericType):
        found = F.when(x != 0, F.array(part(value=x, slot=own)))
    elif isinstance(kind, T.StringType) and name in split:
        found = F.transform(F.regexp_extract_all(x, F.lit(r"((?U)\w+)")), lambda w: part(F.concat(F.lit(lead), w)))
    elif isinstance(kind, T.StringType):
        found = F.when(x != "", F.array(part(F.concat(F.lit(lead), x))))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        found = F.transform(F.filter(x, lambda e: e.isNotNull() & (e != "")), lambda e: part(e))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
        own = F.lit(murmur32(lead, seed) & mask)
        values = F.transform(x, lambda e, i: part(value=e.cast("double"), slot=own, shift=i))
        found = F.filter(values, lambda p: p["value"].isNotNull() & (p["value"] != 0))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        found = F.flatten(F.transform(x, lambda e: F.coalesce(_parts(kind.elementType, name, e, space, seed, split, prefix, mask), none)))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.filter(F.map_entries(x), lambda e: e["value"].isNotNull())
        if isinstance(kind.valueType, T.StringType):
            found = F.transform(entries, lambda e: part(F.concat(F.lit(lead), e["key"], e["value"])))
        else:
            found = F.transform(F.filter(entries, lambda e: e["value"] != 0), lambda e: part(F.concat(F.lit(lead), e["key"]), value=e["value"]))
    elif isinstance(kind, T.StructType):
        inner = murmur32(name, seed)
        found = F.concat(*[F.coalesce(_parts(f.dataType, f.name, x[f.name], inner, seed, split, prefix, mask), none) for f in kind.fields])
    elif isinstance(kind, VectorUDT):
        values = F.transform(vector_values(x), lambda v, i: part(value=v, slot=i.bitwiseAND(F.lit(mask))))
        found = F.filter(values, lambda p: p["value"] != 0)
    else:
        raise ValueError(f"{name}: no hashed features from {kind.simpleString()}")
    return F.coalesce(found.cast(PART), none)


def merged(rows: np.ndarray, indices: np.ndarray, values: np.ndarray, n: int, sum_collisions: bool) -> pa.Array:
    """(row, index, value) triples to one list of ascending indices and one of values a row."""
    order = np.lexsort((indices, rows))
    rows, indices, values = rows[order], indices[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (indices[1:] != indices[:-1])])) if len(rows) else np.empty(0, np.int64)
    kept = (np.add.reduceat(values, first) if len(first) else values[first]) if sum_collisions else values[first]
    bounds = pa.array(np.searchsorted(rows[first], np.arange(n + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(bounds, pa.array(indices[first], pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(kept, pa.float64()))]
    return lists


def _rows_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def hash_features(
    df: DataFrame, input_cols: list[str], output_col: str = "features", bits: int = 30, seed: int = 0, split_cols: tuple[str, ...] = (), sum_collisions: bool = True,
    prefix: bool = True, order_bits: int = 0,
) -> DataFrame:
    """``input_cols`` and ``split_cols`` hashed to one sparse vector of 2^bits slots, in the order of the table's columns.

    Numbers sit at the hash of their column's name (zeros are left out), true at the name alone, texts at
    name and value, split texts at each word, arrays of texts at the value alone, other arrays element by
    element, maps at name and key, structs with a hash of their name as seed, vectors at their own
    indices. The hash of ``output_col`` is the seed. With ``order_bits`` the place of a feature among
    those of its row goes into the highest bits of 30, so that order survives. Nulls give nothing. What is
    hashed is declared as columns; workers hash each distinct text of a batch once.
    """
    if bits + order_bits > 30:
        raise ValueError("bits and order_bits are more than 30")
    split, mask = list(split_cols), (1 << bits) - 1
    wanted = {*input_cols, *split}
    missing = wanted - set(df.columns)
    if missing:
        raise ValueError(f"columns not found: {', '.join(sorted(missing))}")
    space = murmur32(output_col, seed)
    parts = F.concat(*[_parts(f.dataType, f.name, F.col(f"`{f.name}`"), space, seed, split, prefix, mask) for f in df.schema.fields if f.name in wanted])
    size, most = 1 << (30 if order_bits else bits), 1 << order_bits

    def run(column: pa.Array) -> pa.Array:
        rows, flat = _rows_of(column)
        slots = flat.field("slot").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        keys = flat.field("key").dictionary_encode()
        texts, codes = keys.dictionary.to_pylist(), keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        seeds = flat.field("seed").to_numpy(zero_copy_only=False)
        for s in np.unique(seeds[codes >= 0]):
            here = (codes >= 0) & (seeds == s)
            used = np.unique(codes[here])
            table = np.zeros(len(texts), np.int64)
            table[used] = [murmur32(texts[c], int(s)) & mask for c in used]
            slots[here] = table[codes[here]]
        slots += flat.field("shift").to_numpy(zero_copy_only=False)
        if order_bits:
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            if len(place) and place.max() >= most:
                raise ValueError(f"a row has more than {most} features, which order_bits counts")
            slots |= place << (30 - order_bits)
        lists = merged(rows, slots, flat.field("value").to_numpy(zero_copy_only=False), len(column), sum_collisions)
        return pa.StructArray.from_arrays([pa.array([size] * len(column), pa.int32()), *lists], names=["size", "indices", "values"])

    return df.withColumn(output_col, F.arrow_udf(run, SPARSE)(parts))


def interactions(df: DataFrame, input_cols: list[str], output_col: str, bits: int = 30, sum_collisions: bool = True) -> DataFrame:
    """All products of one feature of each input column; the slot is an FNV hash of the slots, in 32 bits that wrap."""
    mask = (1 << bits) - 1

    def run(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        rows, slots, values = np.arange(n), np.zeros(n, np.int64), np.ones(n)
        for c in columns:
            size = c.field("indices").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(size) - size
            many = size[rows]
            at = np.arange(int(many.sum())) + np.repeat(first[rows] - (np.cumsum(many) - many), many)
            new = c.field("indices").flatten().to_numpy(zero_copy_only=False).astype(np.int64)[at]
            slots = (np.repeat(slots, many) * FNV_PRIME & WORD) ^ (new & WORD)
            values = np.repeat(values, many) * c.field("values").flatten().to_numpy(zero_copy_only=False)[at]
            rows = np.repeat(rows, many)
        lists = merged(rows, slots & mask, values, n, sum_collisions)
        return pa.StructArray.from_arrays([pa.array([1 << bits] * n, pa.int32()), *lists], names=["size", "indices", "values"])

    return df.withColumn(output_col, F.arrow_udf(run, SPARSE)(*[F.col(f"`{c}`") for c in input_cols]))


def from_vector(vector: Column) -> Column:
    """A ``pyspark.ml`` vector as a struct of its slots that are not zero."""
    x = vector_values(vector)
    slots = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i) != 0)
    return F.when(vector.isNotNull(), F.struct(F.size(x).alias("size"), slots.alias("indices"), F.filter(x, lambda v: v != 0).alias("values")))


def to_sparse(df: DataFrame, input_col: str, output_col: str) -> DataFrame:
    """Hashed features as a ``pyspark.ml`` vector, for its learners; a Python call a row."""
    make = F.udf(lambda r: None if r is None else SparseVector(r["size"], r["indices"], r["values"]), VectorUDT())
    return df.withColumn(output_col, make(F.col(f"`{input_col}`")))


# Linear learners ----------------------------------------------------------------------------------

#: Slots of a weight table at most: it is sent to every worker.
MOST_BITS = 24


def _gradient(loss: str, raw: np.ndarray, y: np.ndarray, quantile: float) -> np.ndarray:
    if loss == "logistic":
        return -y / (1 + np.exp(np.clip(y * raw, -30, 30)))
    if loss == "hinge":
        return np.where(y * raw < 1, -y, 0.0)
    if loss == "quantile":
        return np.where(y > raw, -quantile, 1 - quantile)
    if loss == "squared":
        return raw - y
    raise ValueError(f"unknown loss {loss}")


def fit_linear(
    df: DataFrame, features_col: str = "features", label_col: str = "label", weight_col: str | None = None, loss: str = "squared", bits: int = 18, passes: int = 1,
    learning_rate: float = 0.5, power: float = 0.5, l1: float = 0.0, l2: float = 0.0, quantile: float = 0.5, batch: int = 16, initial: DataFrame | None = None,
) -> DataFrame:
    """(slot, weight) of a linear model; slot -1 is the constant.

    Every pass goes through all rows once: each task starts from the weights of the pass before, steps by
    the gradient of small batches with a rate that falls with the squares seen in a slot, and sends the
    slots it touched. Weights are averaged over the tasks by how often each has seen the slot, so a slot
    costs one row a task and the result 2^bits rows at most. Rows with a null label or features are left out.
    """
    if bits > MOST_BITS:
        raise ValueError(f"at most {MOST_BITS} bits")
    spark, size = df.sparkSession, 1 << bits
    weight = F.col(f"`{weight_col}`").cast("double") if weight_col else F.lit(1.0)
    rows = df.select(F.col(f"`{features_col}`").alias("x"), F.col(f"`{label_col}`").cast("double").alias("y"), weight.alias("w")).where("x IS NOT NULL AND y IS NOT NULL")
    known = initial
    for _ in range(passes):
        start = np.zeros(size + 1)
        if known is not None:
            for r in known.toLocalIterator():
                start[r["slot"]] = r["weight"]
        shared = spark.sparkContext.broadcast(start)

        def run(batches, shared=shared):
            w, squares, times = shared.value.copy(), np.full(size + 1, 1e-6), np.zeros(size + 1, np.int64)
            for b in batches:
                x, y, importance = b.column("x"), b.column("y").to_numpy(zero_copy_only=False), b.column("w").to_numpy(zero_copy_only=False)
                owner, slots = _rows_of(x.field("indices"))
                slots = slots.to_numpy(zero_copy_only=False).astype(np.int64) & (size - 1)
                values = x.field("values").flatten().to_numpy(zero_copy_only=False)
                bounds = np.searchsorted(owner, np.arange(b.num_rows + 1))
                for at in range(0, b.num_rows, batch):
                    end = min(at + batch, b.num_rows)
                    part = slice(bounds[at], bounds[end])
                    of, s, v = owner[part] - at, slots[part], values[part]
                    raw = np.bincount(of, w[s] * v, end - at) + w[size]
                    g = _gradient(loss, raw, y[at:end], quantile) * importance[at:end]
                    touched, back = np.unique(np.concatenate([s, [size]]), return_inverse=True)
                    step = np.bincount(back, np.concatenate([g[of] * v, [g.sum()]])) / (end - at)
                    seen = np.bincount(back, np.concatenate([np.ones(len(s)), [end - at]]))
                    step += l2 * w[touched]
                    squares[touched] += step * step
                    times[touched] += seen.astype(np.int64)
                    rate = learning_rate / squares[touched] ** power
                    w[touched] -= rate * step
                    if l1:
                        w[touched] = np.sign(w[touched]) * np.maximum(np.abs(w[touched]) - rate * l1, 0)
            used = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(used == size, -1, used)), pa.array(w[used] * times[used]), pa.array(times[used])], names=["slot", "total", "n"])

        sums = rows.mapInArrow(run, "slot long, total double, n long").groupBy("slot").agg((F.sum("total") / F.sum("n")).alias("weight"))
        if known is not None:  # slots that no row of this pass has keep their weight
            sums = sums.unionByName(known.join(sums.select("slot"), "slot", "left_anti"))
        known = write_table(sums, "linear-weights")
    return known


def linear_scores(df: DataFrame, weights: DataFrame, features_col: str, bits: int) -> Column:
    """The raw score of each row, by the weights as one array of 2^bits numbers on every worker."""
    table = np.zeros((1 << bits) + 1)
    for r in weights.toLocalIterator():
        table[r["slot"]] = r["weight"]
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(x: pa.Array) -> pa.Array:
        w = shared.value
        owner, slots = _rows_of(x.field("indices"))
        slots = slots.to_numpy(zero_copy_only=False).astype(np.int64) & (len(w) - 2)
        raw = np.bincount(owner, w[slots] * x.field("values").flatten().to_numpy(zero_copy_only=False), len(x)) + w[-1]
        return pa.array(raw, mask=x.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "double")(F.col(f"`{features_col}`"))


def linear_classifier(df: DataFrame, features_col: str = "features", label_col: str = "label", bits: int = 18, convert_labels: bool = True, **options) -> Fitted:
    """Two classes 0 and 1 (-1 and 1 without ``convert_labels``) by the logistic loss."""
    y = F.col(f"`{label_col}`").cast("double")
    labelled = df.withColumn(label_col, y * 2 - 1 if convert_labels else y)
    weights = fit_linear(labelled, features_col, label_col, loss=options.pop("loss", "logistic"), bits=bits, **options)
    return Fitted(score_linear_classes, {"weights": weights}, features_col=features_col, bits=bits, negative=0.0 if convert_labels else -1.0)


def score_linear_classes(df: DataFrame, weights: DataFrame, features_col: str, bits: int, negative: float) -> DataFrame:
    """Adds ``rawPrediction``, ``probability`` (of the upper class) and ``prediction``."""
    out = df.withColumn("rawPrediction", linear_scores(df, weights, features_col, bits))
    out = out.withColumn("probability", 1 / (1 + F.exp(-F.col("rawPrediction"))))
    return out.withColumn("prediction", F.when(F.col("rawPrediction") > 0, 1.0).when(F.col("rawPrediction").isNotNull(), negative))


def linear_regressor(df: DataFrame, features_col: str = "features", label_col: str = "label", bits: int = 18, **options) -> Fitted:
    weights = fit_linear(df, features_col, label_col, loss=options.pop("loss", "squared"), bits=bits, **options)
    return Fitted(score_linear_values, {"weights": weights}, features_col=features_col, bits=bits)


def score_linear_values(df: DataFrame, weights: DataFrame, features_col: str, bits: int) -> DataFrame:
    """Adds ``rawPrediction`` and the same as ``prediction``."""
    out = df.withColumn("rawPrediction", linear_scores(df, weights, features_col, bits))
    return out.withColumn("prediction", F.col("rawPrediction"))


def joined_features(a: Column, b: Column) -> Column:
    """Two sparse vectors laid over each other: values of equal slots are added; null if one is."""

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        rows, slots, values = [], [], []
        for x in (left, right):
            owner, at = _rows_of(x.field("indices"))
            rows.append(owner)
            slots.append(at.to_numpy(zero_copy_only=False).astype(np.int64))
            values.append(x.field("values").flatten().to_numpy(zero_copy_only=False))
        lists = merged(np.concatenate(rows), np.concatenate(slots), np.concatenate(values), len(left), True)
        size = np.maximum(*[x.field("size").fill_null(0).to_numpy(zero_copy_only=False) for x in (left, right)])
        none = left.is_null().to_numpy(zero_copy_only=False) | right.is_null().to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array(size, pa.int32()), *lists], names=["size", "indices", "values"], mask=pa.array(none))

    return F.arrow_udf(run, SPARSE)(a.cast(SPARSE), b.cast(SPARSE))


def contextual_bandit(
    df: DataFrame, shared_col: str, actions_col: str, chosen_col: str = "chosenAction", cost_col: str = "label", probability_col: str = "probability", bits: int = 18,
    epsilon: float = 0.05, **options,
) -> Fitted:
    """Costs of actions from logged choices: features of the context and of the chosen action (counted from 1),
    the cost it had, and the chance it was chosen with. Rows weigh the inverse of that chance."""
    action = F.get(F.col(f"`{actions_col}`"), F.col(f"`{chosen_col}`") - 1)
    rows = df.select(joined_features(F.col(f"`{shared_col}`"), action).alias("x"), F.col(f"`{cost_col}`").alias("y"), (1 / F.col(f"`{probability_col}`")).alias("w"))
    weights = fit_linear(rows, "x", "y", "w", bits=bits, **options)
    return Fitted(score_actions, {"weights": weights}, shared_col=shared_col, actions_col=actions_col, bits=bits, epsilon=epsilon)


def score_actions(df: DataFrame, weights: DataFrame, shared_col: str, actions_col: str, bits: int, epsilon: float) -> DataFrame:
    """Adds ``prediction``: the chance of each action, the cheapest one (the first of equal ones) preferred, ``epsilon`` spread over all."""
    table = np.zeros((1 << bits) + 1)
    for r in weights.toLocalIterator():
        table[r["slot"]] = r["weight"]
    known = df.sparkSession.sparkContext.broadcast(table)

    def raw(x: pa.Array, w: np.ndarray) -> np.ndarray:
        of, slots = _rows_of(x.field("indices"))
        return np.bincount(of, w[slots.to_numpy(zero_copy_only=False).astype(np.int64) & (len(w) - 2)] * x.field("values").flatten().to_numpy(zero_copy_only=False), len(x))

    def chances(shared: pa.Array, actions: pa.Array) -> pa.Array:
        w = known.value
        owner, each = _rows_of(actions)
        cost, out = raw(each, w) + raw(shared, w)[owner], []
        bounds = np.searchsorted(owner, np.arange(len(actions) + 1))
        for a, b in zip(bounds, bounds[1:]):
            row = np.full(b - a, epsilon / max(1, b - a))
            if b > a:
                row[cost[a:b].argmin()] += 1 - epsilon
            out.append(row.tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return df.withColumn("prediction", F.arrow_udf(chances, "array<double>")(F.col(f"`{shared_col}`").cast(SPARSE), F.col(f"`{actions_col}`").cast(f"array<{SPARSE}>")))
