"""Row-to-rows functions: Python table functions, and the same as columns where Spark has them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Passages:
    """Windows of ``size`` words, ``step`` words apart, of a text, with their place; the last one may be shorter."""

    def eval(self, text: str, size: int, step: int) -> Iterator[tuple[int, str]]:
        words = (text or "").split()
        for i, at in enumerate(range(0, max(1, len(words) - size + step), step) if words else ()):
            yield i, " ".join(words[at : at + size])


def register(spark: SparkSession) -> None:
    """``passages(text, size, step)`` as a table function of the session, for SQL with ``LATERAL``."""
    spark.udtf.register("passages", F.udtf(Passages, returnType="place int, passage string"))


def passages(df: DataFrame, text_col: str, size: int, step: int) -> DataFrame:
    """``df`` with a row for each passage: ``place`` and ``passage``, by Spark's own functions."""
    words = F.filter(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - size + step - 1), F.lit(step))).otherwise(F.array().cast("array<int>"))
    out = df.withColumn("words", words).select("*", F.posexplode(starts).alias("place", "at"))
    return out.withColumn("passage", F.array_join(F.slice("words", F.col("at") + 1, size), " ")).drop("words", "at")


def top_values(df: DataFrame, keys: list[str], value_col: str, order_col: str, k: int) -> DataFrame:
    """The ``k`` values of the largest ``order_col`` of each group as an array, by a bounded aggregate (ties to the larger value)."""
    pairs = F.struct(F.col(f"`{order_col}`").alias("o"), F.col(f"`{value_col}`").alias("v"))
    first = Window.partitionBy(*keys).orderBy(F.desc(f"`{order_col}`"), F.desc(f"`{value_col}`"))
    few = df.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
    return few.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(pairs), asc=False), lambda p: p["v"]).alias("values"))
