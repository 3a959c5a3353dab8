"""Profiling, imputation, encoding, balancing, scaling."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagekit.base import Fitted
from stagekit.plans.session import fresh, write_table

QUANTILES = {"P0_5": 0.005, "P1": 0.01, "P5": 0.05, "1st_Quartile": 0.25, "Median": 0.5, "3rd_Quartile": 0.75, "P95": 0.95, "P99": 0.99, "P99_5": 0.995}
NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")


def _is_nan(df: DataFrame, c: str) -> Column:
    return F.isnan(c) if df.schema[c].dataType.typeName() in ("float", "double") else F.lit(False)


#: Accuracy from which quantiles are exact: a sketch that fine keeps every row.
EXACT = 1_000_000


def exact_quantiles(df: DataFrame, col: str, wanted: list[float], output_type: str | None = None) -> tuple[list, int]:
    """The values of rank ceil(q n) among those that are neither null nor NaN, and how many distinct values there are.

    Values are counted, and the counts lie in range blocks: sums run within a block, on top of the sums of the
    blocks below, of which there is one row each. No task holds the distinct values.
    """
    x = F.when(~_is_nan(df, col), F.col(f"`{col}`"))
    counts = df.select(x.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    counts = write_table(counts.repartitionByRange("v").withColumn("block", F.spark_partition_id()), "value-counts")
    blocks = sorted(counts.groupBy("block").agg(F.min("v").alias("v"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect(), key=lambda r: r.v)  # a row a block
    total, distinct = sum(r.n for r in blocks), sum(r.d for r in blocks)
    if not total:
        return [None] * len(wanted), 0
    # as written, 0.95 is 95 / 100
    if not wanted:
        return [], distinct
    ranks = [max(1, math.ceil(Fraction(str(q)) * total)) for q in wanted]
    places, ahead = {}, 0
    for r in blocks:
        for k in {k for k in ranks if ahead < k <= ahead + r.n}:
            places[k] = (r.block, k - ahead)
        ahead += r.n
    upto = F.sum("n").over(Window.partitionBy("block").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    near = counts.where(F.col("block").isin(sorted({b for b, _ in places.values()}))).withColumn("upto", upto)
    at = lambda block, rank: (F.col("block") == block) & (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
    hits = F.array_compact(F.array(*[F.when(at(*place), F.lit(k).cast("bigint")) for k, place in places.items()]))
    value = F.col("v").cast(output_type) if output_type else F.col("v")
    found = {r.k: r.v for r in near.select(F.explode(hits).alias("k"), value.alias("v")).collect()}  # a row a rank
    return [found[k] for k in ranks], distinct


def summarize(df: DataFrame, cols: list[str] | None = None, counts: bool = True, basic: bool = True, sample: bool = True, percentiles: bool = True, exact_distinct: bool = False, accuracy: int = 10_000) -> DataFrame:
    """One row for each column, from one pass over the table.

    Every statistic of every column is one aggregate of one job; the single row is then turned into rows.
    Quantiles are ``percentile_approx`` with the given accuracy, from ``EXACT`` on exact ones; distinct values
    are estimated unless ``exact_distinct``. What is exact comes from counted values, a job a column.
    Statistics of columns that aren't numbers are null. NaN and null count as missing.
    """
    cols = cols or df.columns
    aggs, layout = [], {}

    def stat(c: str, name: str, value: Column) -> None:
        layout.setdefault(name, {})[c] = f"s{len(aggs)}"
        aggs.append(value.cast("double").alias(f"s{len(aggs)}"))

    def known(value) -> Column:
        return F.max(F.lit(value).cast("double"))

    wanted = [q for q in QUANTILES if (basic if q in ("1st_Quartile", "Median", "3rd_Quartile") else percentiles)]
    for c in cols:
        number = df.schema[c].dataType.typeName() in NUMERIC
        fine = F.when(~_is_nan(df, c), F.col(f"`{c}`"))
        x = fine.cast("double") if number else F.lit(None).cast("double")
        exact = number and accuracy >= EXACT and bool(wanted)
        if exact or (counts and exact_distinct):
            quantiles, distinct = exact_quantiles(df, c, [QUANTILES[q] for q in wanted] if exact else [], "double" if exact else None)
        if counts:
            stat(c, "Count", F.count(fine))
            stat(c, "Unique_Value_Count", F.coalesce(known(distinct), F.lit(0)) if exact_distinct else F.approx_count_distinct(fine))
            stat(c, "Missing_Value_Count", F.sum(F.when(fine.isNull(), 1).otherwise(0)))
        if basic:
            stat(c, "Min", F.min(x))
            stat(c, "Max", F.max(x))
        if sample:
            stat(c, "Sample_Variance", F.variance(x))
            stat(c, "Sample_Standard_Deviation", F.stddev(x))
            stat(c, "Sample_Skewness", F.skewness(x))
            stat(c, "Sample_Kurtosis", F.kurtosis(x))
        if wanted:
            all_q = None if exact else F.percentile_approx(x, [QUANTILES[q] for q in wanted], accuracy)
            for i, q in enumerate(wanted):
                stat(c, q, known(quantiles[i]) if exact else F.get(all_q, i))
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("Feature"), *[F.col(by[c]).alias(name) for name, by in layout.items()]) for c in cols])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def clean_missing(df: DataFrame, cols: list[str], mode: str = "Mean", custom=None, output_cols: list[str] | None = None, exact: bool = False) -> Fitted:
    """Fill null and NaN by the column's mean, its median, or a given value."""
    outs = output_cols or cols
    if mode == "Custom":
        fill = {c: custom for c in cols}
    elif mode in ("Mean", "Median"):
        x = {c: F.when(~_is_nan(df, c), F.col(c)) for c in cols}
        if mode == "Median" and exact:
            fill = {c: exact_quantiles(df, c, [0.5])[0][0] for c in cols}
        else:
            median = (lambda v: F.get(F.percentile_approx(v, [0.5], 10_000), 0))
            fill = df.agg(*[(F.avg(x[c]) if mode == "Mean" else median(x[c])).alias(c) for c in cols]).first().asDict()
    else:
        raise ValueError(f"unknown mode {mode}")

    return Fitted(fill_missing, fill=fill, cols=cols, outs=outs)


def fill_missing(d: DataFrame, fill: dict, cols: list[str], outs: list[str]) -> DataFrame:
    return d.withColumns({o: F.coalesce(F.when(~_is_nan(d, c), F.col(c)), F.lit(fill[c])) for c, o in zip(cols, outs)})


def convert(df: DataFrame, cols: list[str], to: str, date_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Columns to another type; what can't be read becomes null. Timestamps as longs are milliseconds."""
    names = {"boolean": "boolean", "byte": "tinyint", "short": "smallint", "integer": "int", "long": "bigint", "float": "float", "double": "double", "string": "string", "date": "timestamp"}
    if to in ("toCategorical", "clearCategorical"):
        for c in cols:
            df = value_indexer(df, c, c)(df) if to == "toCategorical" else index_to_value(df, c, c)
        return df
    if to not in names:
        raise ValueError(f"unknown type {to}")
    for c in cols:
        kind, x = df.schema[c].dataType.typeName(), F.col(c)
        if to == "boolean" and kind == "string":
            raise ValueError(f"{c}: a string has no conversion to boolean")
        stamp = x.cast("timestamp") if kind in ("timestamp", "timestamp_ntz", "date") else None
        if stamp is not None and to == "string":
            out = F.date_format(x, date_format)
        elif stamp is not None and to == "long":
            out = F.unix_millis(stamp)
        elif to == "date":
            out = F.timestamp_millis(x) if kind in NUMERIC else stamp if stamp is not None else F.try_to_timestamp(x, F.lit(date_format))
        elif to in ("byte", "short", "integer", "long") and kind == "string":
            out = x.try_cast("double").try_cast(names[to])
        else:
            out = x.try_cast(names[to])
        df = df.withColumn(c, out)
    return df


#: Levels up to which an index is one expression and the column's metadata names them.
LEVELS = 10_000


def value_indexer(df: DataFrame, input_col: str, output_col: str) -> Fitted:
    """Levels in ascending order to 0-based ints, null and unknown values behind them; levels go to the column's metadata.

    Beyond ``LEVELS`` levels the index is a join with the table of levels, and the metadata has none.
    """
    from stagekit.operators.columns import zip_with_index

    fine = F.when(~_is_nan(df, input_col), F.col(input_col))
    found = df.select(fine.alias("v")).distinct()
    kind = df.schema[input_col].dataType.simpleString()
    first = found.limit(LEVELS + 2).collect()
    if len(first) <= LEVELS + 1:
        levels = sorted(r.v for r in first if r.v is not None)
        names = [v if isinstance(v, (int, float, bool, str)) else str(v) for v in levels]
        return Fitted(index_levels, input_col=input_col, output_col=output_col, levels=names, kind=kind, has_null=any(r.v is None for r in first))
    table = zip_with_index(found.where("v IS NOT NULL"), "i", order_by=["v"]).withColumn("i", F.col("i").cast("int"))
    has_null = found.where("v IS NULL").count() > 0
    return Fitted(index_by_join, {"levels": table}, input_col=input_col, output_col=output_col, n=table.count(), has_null=has_null)


def index_levels(d: DataFrame, input_col: str, output_col: str, levels: list, kind: str, has_null: bool) -> DataFrame:
    x = F.when(~_is_nan(d, input_col), F.col(input_col))
    index = F.lit(len(levels) + has_null)
    if levels:
        table = F.create_map(*[v for i, level in enumerate(levels) for v in (F.lit(level).cast(kind), F.lit(i))])
        index = F.coalesce(F.try_element_at(table, x), index)
    meta = {"levels": levels, "level_type": kind, "has_null": has_null}
    return d.withColumn(output_col, F.when(x.isNull(), len(levels)).otherwise(index)).withMetadata(output_col, meta)


def index_by_join(d: DataFrame, levels: DataFrame, input_col: str, output_col: str, n: int, has_null: bool) -> DataFrame:
    key, place = fresh([*d.columns, output_col], "v", "i")
    x = F.when(~_is_nan(d, input_col), F.col(input_col))
    joined = d.withColumn(key, x).join(levels.select(F.col("v").alias(key), F.col("i").alias(place)), key, "left")
    index = F.when(F.col(key).isNull(), n).otherwise(F.coalesce(place, F.lit(n + has_null)))
    return joined.withColumn(output_col, index).drop(key, place)


def index_to_value(df: DataFrame, input_col: str, output_col: str) -> DataFrame:
    """Ints back to the levels in the column's metadata; the null level gives null, others beyond it an error."""
    meta = df.schema[input_col].metadata
    if "levels" not in meta:
        raise ValueError(f"{input_col} has no levels in its metadata")
    levels = F.array(*[F.lit(v).cast(meta["level_type"]) for v in meta["levels"]])
    i, n = F.col(input_col), len(meta["levels"])
    bad = F.raise_error(F.lit("index outside the levels")).cast(meta["level_type"])
    return df.withColumn(output_col, F.when(i < n, F.get(levels, i)).when((i == n) & F.lit(meta["has_null"]), F.lit(None)).otherwise(bad))


def count_selector(df: DataFrame, input_col: str, output_col: str) -> Fitted:
    """Keep the slots of a vector that are non-zero in any row.

    Rows stay sparse: a task counts by slot, and the counts are added up.
    """
    from pyspark.ml.stat import Summarizer

    vectors = df.select(input_col).where(F.col(input_col).isNotNull())
    # one number a slot; Spark's summary of no rows is an error
    counts = [] if vectors.isEmpty() else vectors.select(Summarizer.numNonZeros(F.col(input_col))).first()[0].toArray()
    return Fitted(select_slots, input_col=input_col, output_col=output_col, indices=[i for i, n in enumerate(counts) if n])


def select_slots(d: DataFrame, input_col: str, output_col: str, indices: list[int]) -> DataFrame:
    from pyspark.ml.feature import VectorSlicer

    return VectorSlicer(inputCol=input_col, outputCol=output_col, indices=indices).transform(d)


def class_balancer(df: DataFrame, input_col: str, output_col: str = "weight", broadcast: bool | None = None) -> Fitted:
    """Weight of each class: largest count over its count. Rows with a null label go.

    The planner decides how to join from the size of the weights; ``broadcast`` forces it either way.
    """
    most = fresh([input_col, output_col], "most", "n")
    counts = df.groupBy(F.col(input_col)).agg(F.count(F.lit(1)).alias(most[1]))
    top = counts.agg(F.max(most[1]).alias(most[0]))
    weights = counts.join(F.broadcast(top)).select(input_col, (F.col(most[0]) / F.col(most[1])).alias(output_col))  # one row
    return Fitted(join_weights, {"weights": weights}, input_col=input_col, hint={None: None, True: "broadcast", False: "merge"}[broadcast])


def join_weights(d: DataFrame, weights: DataFrame, input_col: str, hint: str | None) -> DataFrame:
    return d.join(weights.hint(hint) if hint else weights, input_col)


def ensemble_by_key(df: DataFrame, keys: list[str], cols: list[str], new_cols: list[str] | None = None, collapse: bool = True) -> DataFrame:
    """Mean of number or vector columns by key; without ``collapse`` it is joined back to the rows."""
    from pyspark.ml.stat import Summarizer

    outs = new_cols or [f"mean({c})" for c in cols]
    means = [(Summarizer.mean(F.col(c)) if df.schema[c].dataType.typeName() == "vector" else F.avg(c)).alias(o) for c, o in zip(cols, outs)]
    grouped = df.groupBy(*keys).agg(*means)
    return grouped if collapse else df.join(grouped, keys)


def id_indexer(df: DataFrame, input_col: str, output_col: str, partition_col: str | None = None, reset_per_partition: bool = True) -> Fitted:
    """Dense 1-based ids of (partition, value); unseen values get 0. The input column goes."""
    keys = [partition_col, input_col] if partition_col else [input_col]
    seen = df.select(*keys).distinct().where(F.col(input_col).isNotNull())
    if partition_col and reset_per_partition:
        vocabulary = seen.withColumn(output_col, F.row_number().over(Window.partitionBy(partition_col).orderBy(input_col)))
    else:
        from stagekit.operators.columns import zip_with_index

        vocabulary = zip_with_index(seen, output_col, start=1, order_by=keys)
    # ids are ints, as long as there are no more of them
    vocabulary = vocabulary.withColumn(output_col, F.coalesce(F.col(output_col).try_cast("int"), F.raise_error(F.lit("more than 2^31 - 1 ids")).cast("int")))
    return Fitted(look_up_ids, {"vocabulary": vocabulary}, keys=keys, input_col=input_col, output_col=output_col)


def look_up_ids(d: DataFrame, vocabulary: DataFrame, keys: list[str], input_col: str, output_col: str) -> DataFrame:
    return d.join(vocabulary, keys, "left").withColumn(output_col, F.coalesce(output_col, F.lit(0))).drop(input_col)


def undo_id_indexer(df: DataFrame, fitted: Fitted, output_col: str, partition_col: str | None = None) -> DataFrame:
    keys = [partition_col, output_col] if partition_col else [output_col]
    return df.join(fitted.vocabulary, keys, "left")


def multi_indexer(df: DataFrame, pairs: list[tuple[str, str]], partition_col: str | None = None) -> Fitted:
    models = [id_indexer(df, a, b, partition_col) for a, b in pairs]
    return Fitted(look_up_all, {f"vocabulary_{i}": m.vocabulary for i, m in enumerate(models)}, each=[m.arguments for m in models])


def look_up_all(d: DataFrame, each: list[dict], **vocabularies: DataFrame) -> DataFrame:
    for i, arguments in enumerate(each):
        d = look_up_ids(d, vocabularies[f"vocabulary_{i}"], **arguments)
    return d


def standard_scaler(df: DataFrame, input_col: str, output_col: str, partition_col: str | None = None, coefficient: float = 1.0) -> Fitted:
    """z-scores by partition (population deviation; x - mean where that is 0)."""
    stats = df.groupBy(*([partition_col] if partition_col else [])).agg(F.avg(input_col).alias("sk_mean"), F.stddev_pop(input_col).alias("sk_dev"))
    return Fitted(standard_scaled, {"stats": stats}, input_col=input_col, output_col=output_col, partition_col=partition_col, coefficient=coefficient)


def standard_scaled(d: DataFrame, stats: DataFrame, input_col: str, output_col: str, partition_col: str | None, coefficient: float) -> DataFrame:
    off = F.col(input_col) - F.col("sk_mean")
    value = F.when(F.col("sk_dev") == 0, off).otherwise(F.try_divide(F.lit(coefficient) * off, F.col("sk_dev")))
    return _scaled(d, stats, partition_col, output_col, value)


def linear_scaler(df: DataFrame, input_col: str, output_col: str, partition_col: str | None = None, low: float = 0.0, high: float = 1.0) -> Fitted:
    """Least and largest value by partition to [low, high]; the middle where they are equal."""
    stats = df.groupBy(*([partition_col] if partition_col else [])).agg(F.min(input_col).alias("sk_low"), F.max(input_col).alias("sk_high"))
    return Fitted(linear_scaled, {"stats": stats}, input_col=input_col, output_col=output_col, partition_col=partition_col, low=low, high=high)


def linear_scaled(d: DataFrame, stats: DataFrame, input_col: str, output_col: str, partition_col: str | None, low: float, high: float) -> DataFrame:
    span = F.col("sk_high") - F.col("sk_low")
    value = F.when(span == 0, F.lit((low + high) / 2)).otherwise(F.lit(low) + F.try_divide((F.col(input_col) - F.col("sk_low")) * (high - low), span))
    return _scaled(d, stats, partition_col, output_col, value)


def _scaled(d: DataFrame, stats: DataFrame, partition_col: str | None, output_col: str, value: Column) -> DataFrame:
    joined = d.join(stats, partition_col, "left") if partition_col else d.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumn(output_col, value).drop(*[c for c in stats.columns if c != partition_col])
