"""Mixing sources to target weights by Pareto order sampling.

A document's expected copies are its weight times the rate of its source, ``max_copies`` at most; the
rate is the one at which the expected words of the source are its target, so what capped documents
cannot take goes to the others. A document first gets the whole copies that are certain (the integer
part); what is missing from the target is drawn from the rest: each document has the rank
``odds(random) / odds(inclusion)`` and documents are taken in rank order until the source's target is
met. All of it is small aggregates: sums per (source, weight), of which a source has ``OCTAVE`` an
octave at most, then per (source, bin of the rank), then the exact order within the one bin per source
in which the target is met. Texts never move: a document's fate follows from its own columns and its
source's threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagekit.llm.text import n_words
from stagekit.plans.session import fresh, without, write_table

WEIGHTS = (5.0, 2.0, 1.0)
#: Bins of the logarithm of the rank: so many a unit, over +-40.
BIN_WIDTH = 1 / 256
#: Weights are rounded down to so many steps a doubling.
OCTAVE = 64


def uniform(*key: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that the key decides."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, take the weights in turn. They share the sum of all
    sizes by weight; none gets over ``max_copies`` times its size, and what that leaves is shared
    again by weight. The limit of that is ``least(cap, level * weight)`` with one level for all,
    found from sums over the sources in the order of cap / weight. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", turn.alias("w"))
    s = s.withColumn("cap", F.col("source_size").cast("double") * max_copies)
    by = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(every).cast("double") - before) / after)
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(every))
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.lit(0.0))).alias("target"))


def number_repeats(df: DataFrame, index: str = "copy_index") -> DataFrame:
    """Equal rows of a narrow table, counted before the shuffle and laid out again with 0, 1, 2 ..."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    (n,) = fresh([*df.columns, index], "n")
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(n)).select(*cols, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(index))


def pareto_mix(
    docs: DataFrame, key: list[str], source_col: str = "source", size_col: str = "size",
    weights=WEIGHTS, max_copies: int = 3, seed: int = 0, weight_col: str | None = None,
) -> DataFrame:
    """``docs`` with ``source_size`` (long), ``target`` (double) and ``copies`` (int, 0..max_copies).

    ``key`` names the columns that tell documents apart; rows equal in all of them share a rank (see
    ``number_repeats``). ``weight_col`` makes the expected copies of a document proportional to it
    within its source (null, NaN and negative: 0, rounded down to a 64th of an octave); without it all
    documents of a source are alike.
    Sizes are longs, null counting as 0; a source without words has target 0 and its documents no
    copies; null is a source of its own. Reruns agree. Input columns named like an output are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, "source_size", "target", "copies")
    size = F.coalesce(F.col(f"`{size_col}`"), F.lit(0)).cast("long")
    weight = F.lit(1.0)
    if weight_col:
        weight = F.col(f"`{weight_col}`").cast("double")
        steps = F.floor(F.log2(weight) * OCTAVE + 1e-9)
        weight = F.when(F.isnan(weight) | weight.isNull() | (weight <= 0), 0.0).when(weight == float("inf"), 0.0).otherwise(F.pow(F.lit(2.0), steps / OCTAVE))
    narrow = docs.select(
        F.col(f"`{source_col}`").alias("source"), size.alias("size"), weight.alias("weight"),
        uniform(*[F.col(f"`{k}`") for k in key], seed=seed).alias("u"),
    )
    narrow = write_table(narrow, "mix-narrow")
    by_weight = write_table(narrow.groupBy("source", "weight").agg(F.sum("size").alias("size")), "mix-weights")
    sums = by_weight.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums, weights, max_copies)
    # rate: heaviest weights first, capped ones before; the largest rate at which no other is over the cap
    t = targets.select(F.col("source").alias("t_source"), "target")
    levels = by_weight.where("weight > 0").join(t, F.col("source").eqNullSafe(F.col("t_source")))
    down = Window.partitionBy("source").orderBy(F.desc("weight"))
    capped = F.coalesce(F.sum("size").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("size") * F.col("weight")).over(down.rowsBetween(0, Window.unboundedFollowing))
    levels = levels.withColumn("rate", F.try_divide(F.col("target") - capped * max_copies, open_))
    rates = levels.groupBy("source").agg(
        F.max(F.when(F.col("rate") * F.col("weight") <= max_copies, F.col("rate"))).alias("rate"), F.min("weight").alias("least")
    )
    # where all are capped, the lightest is too
    rates = rates.select(F.col("source").alias("s2"), F.coalesce("rate", max_copies / F.col("least")).alias("rate"))
    # one row a source; the planner broadcasts it only while its written size is under the threshold
    targets = targets.join(rates, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    targets = write_table(targets, "mix-targets")

    def ranked(df: DataFrame, weight: Column) -> DataFrame:
        expected = F.least(F.col("rate") * weight, F.lit(float(max_copies)))
        df = df.withColumn("certain", F.floor(expected).cast("int"))
        p = expected - F.col("certain")
        # log of odds(u) / odds(p); null: not drawn
        rank = F.when(p > 0, F.ln(F.col("u") / (1 - F.col("u"))) - F.ln(p / (1 - p)))
        return df.withColumn("rank", rank)

    same = lambda a, b: a.eqNullSafe(b)
    t = targets.select(F.col("source").alias("t_source"), "target", "rate")
    r = ranked(narrow.join(t, same(F.col("source"), F.col("t_source"))), F.col("weight"))
    r = r.withColumn("bin", F.floor(F.greatest(F.least(F.col("rank"), F.lit(40.0)), F.lit(-40.0)) / BIN_WIDTH).cast("int"))
    bins = r.groupBy("source", "bin").agg(
        F.sum("size").alias("words"), F.sum(F.col("size") * F.col("certain")).alias("sure"), F.max("target").alias("target")
    )
    bins = write_table(bins, "mix-bins")
    by = Window.partitionBy("source")
    upto = by.orderBy(F.col("bin").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("need", F.col("target") - F.sum("sure").over(by)).where(F.col("bin").isNotNull())
    bins = bins.withColumn("ahead", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    cut = bins.where((F.col("ahead") < F.col("need")) & (F.col("ahead") + F.col("words") >= F.col("need")))
    cut = cut.select(F.col("source").alias("c_source"), F.col("bin").alias("cut"), "need", "ahead")
    # sources whose need goes beyond all they have (weights with capped documents): all are taken
    every = bins.groupBy("source").agg(F.max("need").alias("need"), F.sum("words").alias("words")).where(F.col("need") > F.col("words"))
    cut = write_table(cut.unionByName(every.select(F.col("source").alias("c_source"), F.lit(1 << 30).alias("cut"), "need", F.lit(0).cast("long").alias("ahead"))), "mix-cut")
    within = r.join(cut, same(F.col("source"), F.col("c_source")) & (F.col("bin") == F.col("cut")))
    within = within.groupBy("source", "rank", "need", "ahead").agg(F.sum("size").alias("size"))
    run = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    within = within.withColumn("total", F.col("ahead") + F.sum("size").over(run))
    # a document at the edge is taken if that brings the sum nearer
    within = within.where(F.col("total") - F.col("size") / 2.0 <= F.col("need"))
    last = within.groupBy("source").agg(F.max("rank").alias("edge"))
    edges = cut.join(last, same(F.col("c_source"), F.col("source")), "left").select(
        "c_source", F.when(F.col("cut") == 1 << 30, F.lit(float("inf"))).otherwise(F.coalesce(F.col("edge"), F.col("cut") * BIN_WIDTH - 1e-9)).alias("edge")
    )
    fate = targets.join(edges, same(F.col("source"), F.col("c_source")), "left")
    names = fresh(docs.columns, "f_source", "u", "rate", "certain", "rank", "edge")
    f_source, u, rate, _, _, edge = names
    fate = write_table(fate.select(F.col("source").alias(f_source), "source_size", "target", F.col("rate").alias(rate), F.col("edge").alias(edge)), "mix-fate")
    whole = docs.join(fate, same(F.col(f"`{source_col}`"), F.col(f_source)))
    drawn = uniform(*[F.col(f"`{k}`") for k in key], seed=seed)
    expected = F.least(F.col(rate) * weight, F.lit(float(max_copies)))
    certain = F.floor(expected)
    p = expected - certain
    rank = F.ln(drawn / (1 - drawn)) - F.ln(p / (1 - p))
    taken = certain + F.when((p > 0) & (rank <= F.col(edge)), 1).otherwise(0)
    return whole.select(*[F.col(f"`{c}`") for c in docs.columns], "source_size", "target", taken.cast("int").alias("copies"))


def length_weight(size: Column) -> Column:
    """1, 2, 4 or 8 by length: from 32, 128 and 512 words on."""
    return F.when(size >= 512, 8.0).when(size >= 128, 4.0).when(size >= 32, 2.0).otherwise(1.0)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents; longer ones are drawn with higher odds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    rows = write_table(number_repeats(docs), "mix-docs").withColumn("weight", length_weight(F.col("size")))
    mixed = pareto_mix(rows, ["doc_id", "copy_index"], seed=7, weight_col="weight")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         row_number() OVER (PARTITION BY doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) - 1 AS i
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size::DOUBLE * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level <= cap / w THEN level END) OVER () * w, 0)) AS target FROM l),
x AS (SELECT *, CASE WHEN size >= 512 THEN 8.0::DOUBLE WHEN size >= 128 THEN 4.0 WHEN size >= 32 THEN 2.0 ELSE 1.0 END AS weight FROM d),
g AS (SELECT x.source, weight, target, sum(size)::BIGINT AS size FROM x JOIN t ON x.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
h AS (SELECT *, (target - 3 * coalesce(sum(size) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / nullif(sum(size * weight) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS rate FROM g),
q AS (SELECT source, coalesce(max(CASE WHEN rate * weight <= 3 THEN rate END), 3 / min(weight)) AS rate FROM h GROUP BY source),
r AS (SELECT x.*, source_size, target, least(rate * weight, 3.0) AS expected,
        ((('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || i), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
      FROM x JOIN t ON x.source IS NOT DISTINCT FROM t.source JOIN q ON x.source IS NOT DISTINCT FROM q.source),
o AS (SELECT *, floor(expected) AS certain, expected - floor(expected) AS p FROM r),
e AS (SELECT *, target - sum(size * certain) OVER (PARTITION BY source) AS need,
        sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN ln(u / (1 - u)) - ln(p / (1 - p)) END NULLS LAST ROWS UNBOUNDED PRECEDING) AS total FROM o)
SELECT doc_id, size, source_size, target,
       (size * (certain + CASE WHEN p > 0 AND total - size / 2.0 <= need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e
"""
