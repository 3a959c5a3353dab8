"""Entity-access anomaly: complement sets, components, factor models per tenant, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagekit.base import Fitted
from stagekit.functions.components import connected_components as _components
from stagekit.plans.session import write_table


def complement_access(df: DataFrame, tenant_col: str, user_col: str, res_col: str, factor: int = 2, seed: int = 0) -> DataFrame:
    """(tenant, user, res) index tuples that ``df`` doesn't have, about ``factor`` for each row.

    Tuples are drawn by a hash of the row inside the tenant's index ranges; those seen, and repeats, go.
    """
    seen = df.select(tenant_col, user_col, res_col).distinct()
    ranges = seen.groupBy(tenant_col).agg(*[f(c).alias(f"_{n}{c}") for c in (user_col, res_col) for n, f in (("a", F.min), ("b", F.max))])
    drawn = seen.join(ranges, tenant_col).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(factor))))

    def pick(c: str, salt: int) -> Column:
        width = F.col(f"_b{c}") - F.col(f"_a{c}") + 1
        return (F.pmod(F.xxhash64(tenant_col, user_col, res_col, "_k", F.lit(seed * 2 + salt)), width) + F.col(f"_a{c}")).alias(c)

    return drawn.select(tenant_col, pick(user_col, 0), pick(res_col, 1)).distinct().join(seen, [tenant_col, user_col, res_col], "left_anti")


def connected_components(edges: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(a, component) and (b, component) of a bipartite graph: smallest label that reaches a node.

    Edges are contracted before they go round: each node of one side becomes the least label beside it, then
    each of the other side the least of those, then once more the first. What is left, a few links between such
    labels, is a graph for alternating stars. Every edge is dealt a fixed number of times, whatever the rounds.
    """
    e = write_table(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").distinct(), "access-edges")
    right = write_table(e.groupBy("y").agg(F.min("x").alias("m")), "access-labels")
    e = write_table(e.join(right, "y").select("x", "m"), "access-edges")
    left = e.groupBy("x").agg(F.min("m").alias("least"))
    e = write_table(e.join(left, "x").where("m <> least").select("m", "least").distinct(), "access-edges")
    lower = e.groupBy("m").agg(F.min("least").alias("v"))
    links = e.join(lower, "m").where("least <> v").select(F.col("least").alias("u"), "v").unionByName(lower.select(F.col("m").alias("u"), "v"))
    reached = write_table(_components(links), "access-components")

    def labelled(table: DataFrame, key: str, label: str, name: str) -> DataFrame:
        found = table.join(reached.withColumnRenamed("node", label), label, "left")
        return found.select(F.col(key).alias(name), F.coalesce("component", label).alias("component"))

    return labelled(left, "x", "least", a), labelled(right, "y", "m", b)


def normalized_vectors(scored: DataFrame, users: DataFrame, resources: DataFrame, tenant_col: str) -> tuple[DataFrame, DataFrame]:
    """Two more slots on each vector, so that the product of a user's and a resource's is minus the z-score.

    ``scored`` has (tenant, score) of the products seen: their mean and deviation by tenant are folded in.
    """
    stats = scored.groupBy(tenant_col).agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s"))
    scale = F.when(F.coalesce("_s", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_s"))
    u = users.join(stats, tenant_col).withColumn("vec", F.concat(F.transform("vec", lambda x: -x / scale), F.array(F.col("_m") / scale, F.lit(1.0))))
    r = resources.join(stats, tenant_col).withColumn("vec", F.concat("vec", F.array(F.lit(1.0), F.lit(0.0))))
    return u.drop("_m", "_s"), r.drop("_m", "_s")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def score_access(df: DataFrame, users: DataFrame, resources: DataFrame, history: DataFrame | None = None, tenant_col: str = "tenant", user_col: str = "user", res_col: str = "res") -> DataFrame:
    """``df`` with ``anomaly_score``: 0 for accesses in the history, null for unknown users or resources,
    infinite across components, else the product of the vectors.

    ``users`` has (tenant, user, vec[, component]), ``resources`` (tenant, res, vec[, component]).
    """
    part = lambda d, key, n: d.select(tenant_col, key, F.col("vec").alias(f"_v{n}"), (F.col("component") if "component" in d.columns else F.lit(0)).alias(f"_c{n}"))
    out = df.join(part(users, user_col, "u"), [tenant_col, user_col], "left").join(part(resources, res_col, "r"), [tenant_col, res_col], "left")
    value = F.when(F.col("_vu").isNull() | F.col("_vr").isNull(), F.lit(None)).when(F.col("_cu") != F.col("_cr"), F.lit(float("inf"))).otherwise(dot(F.col("_vu"), F.col("_vr")))
    if history is not None:
        seen = history.select(tenant_col, user_col, res_col).distinct().withColumn("_seen", F.lit(True))
        out = out.join(seen, [tenant_col, user_col, res_col], "left")
        value = F.when(F.col("_seen"), F.lit(0.0)).otherwise(value)
    return out.withColumn("anomaly_score", value).drop("_vu", "_vr", "_cu", "_cr", "_seen")


def fit_access_anomaly(df: DataFrame, tenant_col: str = "tenant", user_col: str = "user", res_col: str = "res", likelihood_col: str = "likelihood", rank: int = 10, max_iter: int = 25, reg: float = 1.0, implicit: bool = True, alpha: float = 1.0, low: float = 5.0, high: float = 10.0, complement_factor: int = 2, negative: float = 1.0, seed: int = 0):
    """Alternating least squares over (tenant, user) and (tenant, resource) with non-negative factors.

    Likelihoods are scaled to [low, high] by tenant; explicit feedback adds unseen pairs of score
    ``negative``. All tenants are fitted at once: an index belongs to one tenant, so they don't mix.
    """
    from pyspark.ml.recommendation import ALS

    from stagekit.operators.profile import id_indexer, linear_scaler

    keys = df.groupBy(tenant_col, user_col, res_col).agg(F.sum(likelihood_col).alias("_l"))
    user_ids, res_ids = (id_indexer(keys, c, i, tenant_col, False).vocabulary for c, i in ((user_col, "_ui"), (res_col, "_ri")))
    indexed = keys.join(user_ids, [tenant_col, user_col]).join(res_ids, [tenant_col, res_col])
    scaled = linear_scaler(indexed, "_l", "_x", tenant_col, low, high)(indexed).select(tenant_col, "_ui", "_ri", "_x")
    scaled = write_table(scaled, "access-scaled")
    train = scaled
    if not implicit:
        train = train.unionByName(complement_access(scaled, tenant_col, "_ui", "_ri", complement_factor, seed).withColumn("_x", F.lit(negative)))
    ids = lambda c: F.coalesce(F.col(c).try_cast("int"), F.raise_error(F.lit("more than 2^31 - 1 ids")).cast("int"))
    als = ALS(userCol="_ui", itemCol="_ri", ratingCol="_x", rank=rank, maxIter=max_iter, regParam=reg, implicitPrefs=implicit, alpha=alpha, nonnegative=True, coldStartStrategy="drop", seed=seed)
    model = als.fit(train.withColumns({"_ui": ids("_ui"), "_ri": ids("_ri")}))
    vec = F.transform("features", lambda x: x.cast("double"))
    users = model.userFactors.select(F.col("id").alias("_ui"), vec.alias("vec")).join(user_ids, "_ui").select(tenant_col, user_col, "vec")
    resources = model.itemFactors.select(F.col("id").alias("_ri"), vec.alias("vec")).join(res_ids, "_ri").select(tenant_col, res_col, "vec")
    known = score_access(keys, users, resources, None, tenant_col, user_col, res_col).select(tenant_col, F.col("anomaly_score").alias("score"))
    users, resources = normalized_vectors(known, users, resources, tenant_col)
    pair = lambda c: F.to_json(F.struct(tenant_col, F.col(c)))
    left, right = connected_components(keys.select(pair(user_col).alias("_a"), pair(res_col).alias("_b")), "_a", "_b")
    users = users.withColumn("_a", pair(user_col)).join(left, "_a").drop("_a")
    resources = resources.withColumn("_b", pair(res_col)).join(right, "_b").drop("_b")
    users, resources = write_table(users, "access-users"), write_table(resources, "access-resources")
    history = keys.select(tenant_col, user_col, res_col)
    return Fitted(score_access, {"users": users, "resources": resources, "history": history}, tenant_col=tenant_col, user_col=user_col, res_col=res_col)
