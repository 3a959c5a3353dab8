"""Model statistics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagekit.plans.session import write_table


def confusion_matrix(df: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label_col).alias("label"), F.col(prediction_col).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def binary_statistics(df: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """accuracy, precision, recall and the four counts of 0/1 labels; 0 where nothing was found."""
    y, p = F.col(label_col), F.col(prediction_col)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    c = df.agg(n((y == 1) & (p == 1)).alias("tp"), n((y == 0) & (p == 1)).alias("fp"), n((y == 0) & (p == 0)).alias("tn"), n((y == 1) & (p == 0)).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return c.select("tp", "fp", "tn", "fn", share(tp + tn, tp + fp + tn + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"))


def multiclass_statistics(df: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """Overall accuracy (micro precision and recall alike), average accuracy, macro precision and recall."""
    cells = confusion_matrix(df, label_col, prediction_col)
    classes = cells.select(F.col("label").alias("c")).union(cells.select("prediction")).distinct()
    at = cells.select(F.col("label").alias("c"), F.col("n").alias("rows"), F.lit(0).alias("cols"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"))
    at = at.unionByName(cells.select(F.col("prediction").alias("c"), F.lit(0).alias("rows"), F.col("n").alias("cols"), F.lit(0).alias("hit")))
    per = classes.join(at, "c").groupBy("c").agg(F.sum("rows").alias("rows"), F.sum("cols").alias("cols"), F.sum("hit").alias("hit"))
    total = F.sum("rows").over(Window.partitionBy())
    per = per.withColumn("n", total)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    hit, rows, cols, n = map(F.col, ("hit", "rows", "cols", "n"))
    return per.agg(
        (F.sum(hit) / F.max(n)).alias("accuracy"),
        F.avg((n - rows - cols + 2 * hit) / n).alias("average_accuracy"),
        F.avg(share(hit, cols)).alias("macro_averaged_precision"),
        F.avg(share(hit, rows)).alias("macro_averaged_recall"),
    )


def _by_score(df: DataFrame, label_col: str, score_col: str) -> DataFrame:
    """(score, p, n, p_upto, n_upto): positives and negatives at each distinct score, and with all lower ones.

    Scores lie in range blocks, so that no task sees all of them: sums run within a block, on top of the
    sums of the blocks below, of which there is one row each.
    """
    one = F.when(F.col(label_col) == 1, 1).otherwise(0)
    found = df.groupBy(F.col(score_col).alias("score")).agg(F.sum(one).alias("p"), F.sum(1 - one).alias("n"))
    dealt = write_table(found.repartitionByRange("score").withColumn("block", F.spark_partition_id()), "scores")
    blocks = dealt.groupBy("block").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"), F.min("score").alias("first"))
    below = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocks.select("block", F.coalesce(F.sum("bp").over(below), F.lit(0)).alias("ap"), F.coalesce(F.sum("bn").over(below), F.lit(0)).alias("an"))
    within = Window.partitionBy("block").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.join(F.broadcast(ahead), "block")  # one row a block
    return rows.select("score", "p", "n", (F.sum("p").over(within) + F.col("ap")).alias("p_upto"), (F.sum("n").over(within) + F.col("an")).alias("n_upto"))


def roc_points(df: DataFrame, label_col: str = "label", score_col: str = "score") -> DataFrame:
    """(score, tpr, fpr) at every distinct score: the shares of positives and negatives of that score and higher."""
    rows = _by_score(df, label_col, score_col)
    whole = rows.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    over = lambda x, every: F.try_divide(F.col(every) - F.col(f"{x}_upto") + F.col(x), F.col(every))
    return rows.crossJoin(F.broadcast(whole)).select("score", over("p", "all_p").alias("tpr"), over("n", "all_n").alias("fpr"))  # one row


def auc(df: DataFrame, label_col: str = "label", score_col: str = "score") -> DataFrame:
    """Exact area under the curve from mid-ranks of distinct scores; null without both labels."""
    won = _by_score(df, label_col, score_col).withColumn("won", F.col("p") * (F.col("n_upto") - F.col("n") / 2.0))
    return won.agg(F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def regression_statistics(df: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    y, e = F.col(label_col).cast("double"), F.col(label_col).cast("double") - F.col(prediction_col)
    s = df.agg(F.avg(e * e).alias("mean_squared_error"), F.avg(F.abs(e)).alias("mean_absolute_error"), F.var_pop(y).alias("v"))
    mse = F.col("mean_squared_error")
    return s.select(mse, F.sqrt(mse).alias("root_mean_squared_error"), (1 - F.try_divide(mse, F.col("v"))).alias("r2"), "mean_absolute_error")


def per_instance_regression(df: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    e = F.col(label_col) - F.col(prediction_col)
    return df.withColumns({"L1_loss": F.abs(e), "L2_loss": e * e})


def per_instance_classification(df: DataFrame, probability_col: str = "probability", label_col: str = "label") -> DataFrame:
    """log_loss of the label's probability (an array), clipped to [1e-15, 1]."""
    p = F.coalesce(F.get(F.col(probability_col), F.col(label_col).cast("int")), F.lit(0.0))
    return df.withColumn("log_loss", -F.ln(F.least(F.greatest(p, F.lit(1e-15)), F.lit(1.0))))


def bandit_estimates(df: DataFrame, reward_col: str, logged_col: str, target_col: str) -> DataFrame:
    """Inverse propensity estimates: ips, and snips normalised by the weights."""
    w = F.col(target_col) / F.col(logged_col)
    return df.agg((F.sum(F.col(reward_col) * w) / F.count(F.lit(1))).alias("ips"), F.try_divide(F.sum(F.col(reward_col) * w), F.sum(w)).alias("snips"))


def group_regression(df: DataFrame, keys: list[str], label_col: str, feature_col: str) -> DataFrame:
    """Slope, intercept and r squared of a line by group, as one aggregate."""
    y, x = F.col(f"`{label_col}`").cast("double"), F.col(f"`{feature_col}`").cast("double")
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def group_least_squares(df: DataFrame, keys: list[str], label_col: str, feature_cols: list[str], weight_col: str | None = None) -> DataFrame:
    """Weighted least squares by group over normal equations: sums are added in the cluster, a row a group is solved.

    Gives ``coefficients`` in the order of the features and ``intercept``; a group may have any number of rows.
    """
    w = F.col(f"`{weight_col}`").cast("double") if weight_col else F.lit(1.0)
    x = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in feature_cols]]
    y, m = F.col(f"`{label_col}`").cast("double"), len(x)
    cells = [F.sum(w * x[i] * x[j]).alias(f"a{i}_{j}") for i in range(m) for j in range(i, m)] + [F.sum(w * x[i] * y).alias(f"b{i}") for i in range(m)]
    sums = df.groupBy(*keys).agg(*cells)
    upper = F.array(*[F.col(f"a{min(i, j)}_{max(i, j)}") for i in range(m) for j in range(m)])

    def solve(grams, targets):
        import numpy as np
        import pyarrow as pa

        out = []
        for g, t in zip(grams.to_pylist(), targets.to_pylist()):
            fine = g is not None and None not in g and None not in t
            out.append(np.linalg.lstsq(np.array(g).reshape(m, m), np.array(t), rcond=None)[0].tolist() if fine else None)
        return pa.array(out, pa.list_(pa.float64()))

    found = F.arrow_udf(solve, "array<double>")(upper, F.array(*[F.col(f"b{i}") for i in range(m)]))
    return sums.select(*keys, found.alias("found")).select(*keys, F.slice("found", 2, m).alias("coefficients"), F.get("found", 0).alias("intercept"))


def vector_moments(df: DataFrame, vector_col: str) -> DataFrame:
    """(slot, mean, std) of a vector column in one pass."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    s = df.select(Summarizer.metrics("mean", "std").summary(F.col(f"`{vector_col}`")).alias("s"))
    both = F.arrays_zip(vector_to_array(F.col("s")["mean"]).alias("mean"), vector_to_array(F.col("s")["std"]).alias("std"))
    return s.select(F.posexplode(both).alias("slot", "m")).select("slot", "m.mean", "m.std")
