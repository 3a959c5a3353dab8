"""Synthetic accesses for tests of the anomaly model: departments that use their own resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def clustered_accesses(spark: SparkSession, departments: int = 3, users: int = 20, resources: int = 30, share: float = 0.5, shared: int = 1, seed: int = 0) -> DataFrame:
    """(tenant, user, res, likelihood): users of a department access a share of its resources, and ``shared`` common ones."""
    d = spark.range(departments).withColumnRenamed("id", "d").withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(users - 1))))
    own = d.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resources - 1))))
    own = own.where(F.pmod(F.xxhash64("d", "u", "r", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    name = lambda kind, *cols: F.concat(F.lit(kind), *[x for c in cols for x in (F.lit("_"), F.col(c).cast("string"))])
    rows = own.select(name("user", "d", "u").alias("user"), name("res", "d", "r").alias("res"))
    if shared:
        common = d.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(shared - 1))))
        rows = rows.unionByName(common.select(name("user", "d", "u").alias("user"), name("common", "r").alias("res")))
    return rows.select(F.lit("t").alias("tenant"), "user", "res", F.lit(1.0).alias("likelihood"))


def cross_accesses(accesses: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Pairs of a user and a resource of another department that were never seen, ``n`` at most."""
    part = lambda c: F.element_at(F.split(c, "_"), 2)
    users = accesses.select("tenant", "user").distinct()
    resources = accesses.where("res LIKE 'res%'").select("tenant", "res").distinct()
    pairs = users.join(resources, "tenant").where(part("user") != part("res"))  # a test table
    return pairs.orderBy(F.xxhash64("user", "res", F.lit(seed))).limit(n).withColumn("likelihood", F.lit(1.0))
