"""Column, batch and partition shaping stages."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagekit.plans.session import fresh, write_table

log = logging.getLogger(__name__)


def _present(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def select_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    _present(df, cols)
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    _present(df, cols)
    return df.drop(*cols)


def rename_column(df: DataFrame, input_col: str, output_col: str) -> DataFrame:
    _present(df, [input_col])
    return df.withColumnRenamed(input_col, output_col)


def explode_column(df: DataFrame, input_col: str, output_col: str) -> DataFrame:
    """A row for each element; null and empty arrays give none."""
    return df.withColumn(output_col, F.explode(F.col(input_col)))


def apply_lambda(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return df.transform(fn)


def udf_transform(df: DataFrame, fn: Callable[..., Column], output_col: str, input_col: str | None = None, input_cols: list[str] | None = None) -> DataFrame:
    """``fn`` over one column or several; it may build an expression or be a (pandas) UDF."""
    if (input_col is None) == (input_cols is None):
        raise ValueError("give either input_col or input_cols")
    return df.withColumn(output_col, fn(*[F.col(c) for c in ([input_col] if input_col else input_cols)]))


def multi_column(df: DataFrame, stage: Callable[..., DataFrame], input_cols: list[str], output_cols: list[str], **arguments) -> DataFrame:
    """The same stage for each pair of input and output column."""
    if len(input_cols) != len(output_cols):
        raise ValueError("input_cols and output_cols differ in length")
    for a, b in zip(input_cols, output_cols):
        df = stage(df, input_col=a, output_col=b, **arguments)
    return df


def repartition_to(df: DataFrame, n: int, disable: bool = False) -> DataFrame:
    """Fewer partitions by joining neighbours, more by dealing rows anew."""
    if disable:
        return df
    return df.coalesce(n) if n < df.rdd.getNumPartitions() else df.repartition(n)


def consolidate(df: DataFrame, n: int = 1) -> DataFrame:
    """Funnel all partitions into ``n`` working ones, without a shuffle: each takes whole neighbours."""
    return df.coalesce(n)


def stratified_repartition(df: DataFrame, label_col: str, n: int, mode: str = "mixed", seed: int = 0) -> DataFrame:
    """Rows of every label in each of ``n`` partitions, for labels with ``n`` rows or more.

    ``original`` keeps the rows as they are. ``equal`` draws every label up to the count of the most
    frequent one, ``mixed`` up to the mean count of a label, whole repetitions for the whole part of the
    quotient and a share drawn by a hash of the row for the rest; no row goes. A number dealt within the
    label, modulo ``n``, is the partition. A null label is a label.
    """
    if mode not in ("mixed", "equal", "original"):
        raise ValueError(f"unknown mode {mode}")
    label_, count_, times_, copy_, place_ = fresh(df.columns, "label", "count", "times", "copy", "place")
    names, label = [F.col(f"`{c}`") for c in df.columns], F.col(f"`{label_col}`")
    if mode != "original":
        counts = df.groupBy(label.alias(label_)).agg(F.count(F.lit(1)).alias(count_))
        aim = counts.agg((F.max(count_) if mode == "equal" else F.avg(count_)).alias(times_)).first()[0]  # one number
        times = counts.select(label_, F.greatest(F.lit(1.0), F.lit(float(aim or 0)) / F.col(count_)).alias(times_))
        whole = F.floor(times_)
        share = F.pmod(F.xxhash64(*names, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < F.col(times_) - whole
        df = df.join(times, label.eqNullSafe(F.col(label_))).withColumn(copy_, F.explode(F.sequence(F.lit(1), (whole + share.cast("int")).cast("int")))).select(*names)
    # numbers within a label, without gathering a label in one task: blocks of a hash, and their offsets
    block = F.pmod(F.xxhash64(*names), F.lit(64))
    within = Window.partitionBy(label, count_).orderBy(*[c for c, f in zip(names, df.schema.fields) if f.dataType.typeName() != "map"])
    dealt = df.withColumn(count_, block).withColumn(place_, F.row_number().over(within))
    sizes = df.groupBy(label.alias(label_), block.alias(times_)).agg(F.count(F.lit(1)).alias(copy_))
    ahead = sizes.select(label_, times_, F.coalesce(F.sum(copy_).over(Window.partitionBy(label_).orderBy(times_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(copy_))
    placed = dealt.join(ahead, label.eqNullSafe(F.col(label_)) & (F.col(count_) == F.col(times_)))
    placed = placed.withColumn(place_, F.pmod(F.col(place_) + F.col(copy_), F.lit(n)).cast("int"))
    return placed.repartitionById(n, place_).select(*names)


def cacher(df: DataFrame, disable: bool = False) -> DataFrame:
    return df if disable else df.cache()


def timed(stage: Callable[[DataFrame], DataFrame], df: DataFrame, materialize: bool = False) -> tuple[DataFrame, float]:
    """What the stage gives, and the seconds that took; ``materialize`` also counts its rows."""
    began = time.perf_counter()
    out = stage(df)
    if materialize:
        out.count()
    return out, time.perf_counter() - began


class Timer(Estimator):
    """A stage whose fitting and transforming are logged with their seconds; ``seconds`` keeps them."""

    def __init__(self, stage, materialize: bool = True):
        super().__init__()
        self.stage, self.materialize, self.seconds = stage, materialize, {}

    def _fit(self, df: DataFrame) -> TimerModel:
        inner = self.stage
        if isinstance(inner, Estimator):
            inner, self.seconds["fit"] = timed(lambda d: inner.fit(d), df)
            log.info("%s fitted in %.3f s", type(self.stage).__name__, self.seconds["fit"])
        return TimerModel(inner, self.materialize)


class TimerModel(Model):
    """The timed stage after fitting."""

    def __init__(self, stage, materialize: bool = True):
        super().__init__()
        self.stage, self.materialize, self.seconds = stage, materialize, {}

    def _transform(self, df: DataFrame) -> DataFrame:
        out, self.seconds["transform"] = timed(self.stage.transform, df, self.materialize and not df.isStreaming)
        log.info("%s transformed in %.3f s", type(self.stage).__name__, self.seconds["transform"])
        return out


def zip_with_index(df: DataFrame, output_col: str = "id", start: int = 0, partition_by: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Gapless numbers: per group in the given order, or over all rows.

    Over all rows the numbers come from counts of range-partitioned blocks, so no task sees all rows.
    """
    order = [F.col(c) for c in (order_by or df.columns)]
    if partition_by:
        return df.withColumn(output_col, F.row_number().over(Window.partitionBy(*partition_by).orderBy(*order)) - 1 + start)
    part, row, rows, first, ahead = fresh([*df.columns, output_col], "part", "row", "rows", "first", "ahead")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id())
    # a written table: were a block computed again after a loss, its range could be another
    dealt = write_table(dealt, "zip-with-index")
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(rows), F.min(row).alias(first))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    offsets = F.broadcast(counts.select(part, first, F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(ahead)))
    return dealt.join(offsets, part).withColumn(output_col, F.col(row) - F.col(first) + F.col(ahead) + start).drop(part, row, rows, first, ahead)


def fixed_minibatch(df: DataFrame, batch_size: int, order_by: list[str] | None = None) -> DataFrame:
    """Rows to arrays of up to ``batch_size``, in the given order if there is one, with ``batch_id``."""
    names = df.columns
    if order_by:
        df = zip_with_index(df, "_i", order_by=order_by).withColumn("batch_id", F.floor(F.col("_i") / batch_size))
    else:
        id_ = F.monotonically_increasing_id()
        within = id_.bitwiseAND(F.lit((1 << 33) - 1))
        df = df.withColumn("_i", id_).withColumn("batch_id", id_ - within % batch_size)
    grouped = df.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("_i", *names))).alias("_rows"))
    return grouped.select("batch_id", *[F.col("_rows")[c].alias(c) for c in names])


def dynamic_minibatch(df: DataFrame, max_batch_size: int = 1 << 31) -> DataFrame:
    """One batch of all that a partition has, or several of the given size; the size bounds the memory of a batch."""
    names = df.columns
    schema = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in df.schema.fields)

    def run(batches):
        import pandas as pd

        held: list = []

        def out(n):
            frame = pd.concat(held) if len(held) > 1 else held[0]
            held[:] = [frame.iloc[n:]] if len(frame) > n else []
            return pd.DataFrame({c: [frame[c].iloc[:n].tolist()] for c in names})

        for frame in batches:
            if len(frame):
                held.append(frame)
            while sum(map(len, held)) >= max_batch_size:
                yield out(max_batch_size)
        if held:
            yield out(max_batch_size)

    return df.mapInPandas(run, schema)


def time_interval_minibatch(df: DataFrame, millis_to_wait: int, max_batch_size: int = 1 << 31) -> DataFrame:
    """Batches close when the time is over or the size is reached, within a partition."""
    names = df.columns
    schema = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in df.schema.fields)

    def run(batches):
        import pandas as pd

        rows, began = [], time.monotonic()
        for frame in batches:
            for row in frame.itertuples(index=False, name=None):
                rows.append(row)
                if len(rows) >= max_batch_size or (time.monotonic() - began) * 1000 >= millis_to_wait:
                    yield pd.DataFrame({c: [list(v)] for c, v in zip(names, zip(*rows))})
                    rows, began = [], time.monotonic()
        if rows:
            yield pd.DataFrame({c: [list(v)] for c, v in zip(names, zip(*rows))})

    return df.mapInPandas(run, schema)


def flatten_batch(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Batched rows back to rows; a null array stays a column of nulls, other columns repeat."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.explode(F.arrays_zip(*cols)).alias("_r")).select(*rest, *[F.col("_r")[c].alias(c) for c in cols])


def vector_zipper(df: DataFrame, input_cols: list[str], output_col: str) -> DataFrame:
    """Columns of one type to one array column."""
    return df.withColumn(output_col, F.array(*input_cols))


def assemble_fast(df: DataFrame, input_cols: list[str], output_col: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=input_cols, outputCol=output_col, handleInvalid="keep").transform(df)


def vector_values(vector: Column) -> Column:
    """A vector as an array; null for null, which Spark's own function does not take."""
    return F.when(vector.isNotNull(), vector_to_array(vector))


def value_at(vector: Column, i: int) -> Column:
    return F.get(vector_to_array(vector), i)


def to_vector(array: Column) -> Column:
    return array_to_vector(array)


def slice_values(df: DataFrame, input_col: str, output_col: str, indices: list[int], keep_array: bool = False) -> DataFrame:
    """Slots of a vector or array, or values of a map, by a list of indices, as a vector (or array)."""
    kind = df.schema[input_col].dataType.typeName()
    source = vector_to_array(input_col) if kind == "vector" else F.col(input_col)
    pick = [F.try_element_at(source, F.lit(i)) if kind == "map" else F.get(source, i) for i in indices]
    picked = F.array(*[p.cast("double") for p in pick])
    return df.withColumn(output_col, picked if keep_array else array_to_vector(picked))
