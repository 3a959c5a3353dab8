"""Reproducible shards: a Feistel permutation with cycle walking over global row numbers.

Every row gets a global number that depends on the table's content alone (not on its files or
partitions), a keyed permutation of 0..n-1 moves the number to a position, and the position gives
``shard = position % n_shards`` and ``slot = position div n_shards``. So shard sizes differ by one
row at most, slots have no gap, and ``permute`` answers where any row number goes without a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagekit.plans.session import fresh, without

ROUNDS = 6
#: Walks after which a position outside 0..n-1 is an error. The domain is the smallest square of at
#: least n, so a walk leaves it with a chance of 2/sqrt(n) a step; at n <= 900 a cycle can't be longer.
WALKS = 64
#: Row numbers are counted within so many blocks; their counts are all that meets in one task.
BLOCKS = 8192


def _round_value(seed: int, i: Column, right: Column) -> Column:
    text = F.concat(F.lit(f"{seed}:"), i.cast("string"), F.lit(":"), right.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _feistel(x: Column, side: Column, seed: int) -> Column:
    start = F.struct(F.floor(x / side).cast("long").alias("l"), (x % side).cast("long").alias("r"))
    return F.aggregate(
        F.array(*[F.lit(i) for i in range(ROUNDS)]),
        start,
        lambda s, i: F.struct(s["r"].alias("l"), ((s["l"] + _round_value(seed, i, s["r"])) % side).cast("long").alias("r")),
        lambda s: s["l"] * side + s["r"],
    )


def domain_side(n: Column) -> Column:
    """Side of the smallest square of at least ``n``."""
    root = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    return F.when(root * root < n, root + 1).otherwise(root)


def permute(x: Column, n: Column, seed: int = 0, side: Column | None = None) -> Column:
    """Position of row number ``x`` (0..n-1) under the permutation with this seed."""
    side = domain_side(n) if side is None else side
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)),
        _feistel(x, side, seed),
        lambda at, _: F.when(at < n, at).otherwise(_feistel(at, side, seed)),
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def number_rows(df: DataFrame, number: str, total: str, side: str, blocks: int = BLOCKS) -> DataFrame:
    """Add a gapless row number that only the rows' values decide, the number of rows and ``domain_side`` of it.

    Equal rows are counted before the shuffle and laid out again afterwards, so that no group of
    repeated rows has to be sorted in one task; they take neighbouring numbers, in whatever order.
    Columns need an order: no maps.
    """
    cols = df.columns
    copies, block, start, first, each = fresh([*cols, number, total, side], "copies", "block", "start", "first", "each")
    key = [F.col(f"`{c}`") for c in cols]
    distinct = df.groupBy(*key).agg(F.count(F.lit(1)).alias(copies))
    distinct = distinct.withColumn(block, F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int"))
    before = Window.partitionBy(block).orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    placed = distinct.withColumn(start, F.coalesce(F.sum(copies).over(before), F.lit(0)))
    counts = distinct.groupBy(block).agg(F.sum(copies).alias(each))
    ahead = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(block, F.coalesce(F.sum(each).over(ahead), F.lit(0)).alias(first), F.sum(each).over(whole).alias(total))
    offsets = offsets.withColumn(side, domain_side(F.col(total)))
    # offsets has one row a block, so its size has a bound
    laid = placed.join(F.broadcast(offsets), block)
    numbered = laid.withColumn(each, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))
    return numbered.select(*key, (F.col(first) + F.col(start) + F.col(each)).alias(number), F.col(total), F.col(side))


def feistel_shards(df: DataFrame, n_shards: int = 16, seed: int = 0, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (int) and ``slot`` (long).

    Law ``rows``: counts are one apart at most. The same rows give the same (row, shard, slot) set
    whatever their files, partitions or order; equal rows trade places freely. Null values are values
    like others; an empty table gives no rows; input columns named like an output are replaced.
    """
    df = without(df, shard, slot)
    number, total, side = fresh([*df.columns, shard, slot], "row_number", "n_rows", "domain_side")
    placed = number_rows(df, number, total, side)
    at = permute(F.col(number), F.col(total), seed, F.col(side))
    (position,) = fresh([*placed.columns, shard, slot], "position")
    placed = placed.withColumn(position, at)
    return placed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col(position) % n_shards).cast("int").alias(shard),
        F.floor(F.col(position) / n_shards).cast("long").alias(slot),
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return feistel_shards(rows, 16, seed=9).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
