"""Queries over the driver's tables: features, learners, explanations, outliers, hashing, joins, sources."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from stagekit.functions import tables as row_functions
from stagekit.operators import boosting, explain, hashing, images, inference, learn, metrics, neighbors, outliers, profile, recommend
from stagekit.plans.tables import _purchases, _read, _round
from stagekit.sources import files

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _slots(df, key: str):
    """A vector column as rows (key, slot, value)."""
    return df.select(key, F.posexplode(vector_to_array("features")).alias("slot", "value"))


@query("""SELECT p_partkey, slot::INT AS slot, round(value, 4) AS value FROM (SELECT p_partkey, unnest([0, 1]) AS slot,
unnest([coalesce(CASE WHEN p_partkey % 11 <> 0 THEN p_size END, (SELECT avg(p_size) FROM part WHERE p_partkey % 11 <> 0)), p_retailprice]) AS value FROM part)""")
def featurize_numbers(spark, sf_dir):
    d = _read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 != 0, F.col("p_size")).alias("p_size"), "p_retailprice")
    return _round(_slots(learn.featurize(d, ["p_size", "p_retailprice"])(d), "p_partkey"), "value", digits=4)


@query("""SELECT o_orderkey, slot::INT AS slot, value FROM (SELECT o_orderkey, unnest(range(8)) AS slot, unnest([epoch_ms(o_orderdate)::DOUBLE, year(o_orderdate), isodow(o_orderdate), month(o_orderdate),
day(o_orderdate), hour(o_orderdate), minute(o_orderdate), second(o_orderdate)]) AS value FROM orders)""")
def featurize_times(spark, sf_dir):
    d = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    out = _slots(learn.featurize(d, ["o_orderdate"])(d), "o_orderkey")
    # a time without zone counts from the epoch in the session's zone
    zone = (F.unix_millis(F.lit("1970-01-01 00:00:00").cast("timestamp"))).cast("double")
    return out.withColumn("value", F.when(F.col("slot") == 0, F.col("value") - zone).otherwise(F.col("value")))


@query("""WITH l AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS i, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS n FROM orders)
SELECT o_orderkey, s::INT AS slot, CASE WHEN s = i THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM l, range(5) t(s) WHERE s < n""")
def featurize_one_hot(spark, sf_dir):
    d = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    indexed = profile.value_indexer(d, "o_orderpriority", "i")(d)
    return _slots(learn.featurize(indexed, ["i"])(indexed), "o_orderkey")


def _part_features(spark, sf_dir):
    d = _read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_type", (F.col("p_retailprice") > 1400).cast("int").alias("label"))
    return d


@query()
def train_classifier_parts(spark, sf_dir):
    from pyspark.ml.classification import LogisticRegression

    d = _part_features(spark, sf_dir)
    return learn.train_classifier(d, LogisticRegression(maxIter=10), "label", ["p_size", "p_type"])(d).select("p_partkey", "scored_labels", _second("scored_probabilities").alias("chance"))


def _second(vector: str):
    return F.get(vector_to_array(vector), 1)


@query()
def train_regressor_parts(spark, sf_dir):
    from pyspark.ml.regression import LinearRegression

    d = _part_features(spark, sf_dir)
    return learn.train_regressor(d, LinearRegression(), "p_retailprice", ["p_size", "p_type"])(d).select("p_partkey", "scores")


@query()
def find_best_model_parts(spark, sf_dir):
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression

    d = _part_features(spark, sf_dir)
    models = [learn.train_classifier(d, x, "label", ["p_size"]) for x in (LogisticRegression(maxIter=5), DecisionTreeClassifier())]
    best = learn.find_best(models, d, "label", "accuracy")
    return spark.createDataFrame([(i, best.metric, float(m[best.metric]), m is best.all_metrics[models.index(best.model)]) for i, m in enumerate(best.all_metrics)], "model int, metric string, value double, chosen boolean")


@query("""SELECT p_brand, round(regr_slope(p_retailprice, p_size), 5) AS slope, round(regr_intercept(p_retailprice, p_size), 3) AS intercept, round(regr_r2(p_retailprice, p_size), 6) AS r2, count(*) AS n FROM part GROUP BY 1""")
def group_regression_brand(spark, sf_dir):
    out = metrics.group_regression(_read(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_size")
    return out.select("p_brand", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query("""SELECT p_brand, round(regr_slope(p_retailprice, p_size), 3) AS slope, round(regr_intercept(p_retailprice, p_size), 2) AS intercept FROM part GROUP BY 1""")
def group_least_squares_brand(spark, sf_dir):
    out = metrics.group_least_squares(_read(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", ["p_size"])
    return out.select("p_brand", F.round(F.get("coefficients", 0), 3).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("""SELECT (i - 1)::INT AS slot, round(avg(embedding[i]::DOUBLE), 5) AS mean, round(stddev_samp(embedding[i]::DOUBLE), 5) AS std FROM embeddings, range(1, 65) t(i) GROUP BY i""")
def vector_moments_embeddings(spark, sf_dir):
    d = _read(spark, sf_dir, "embeddings").select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    return _round(metrics.vector_moments(d, "v"), "mean", "std", digits=5)


@query("""SELECT l_orderkey, l_linenumber, i AS slot, round(v, 6) AS value FROM (SELECT l_orderkey, l_linenumber, unnest([0, 1, 2, 0, 1, 2]) AS a, unnest([0, 0, 0, 1, 1, 1]) AS b,
unnest([l_quantity, l_tax, l_discount, l_quantity, l_tax, l_discount]) * unnest([l_extendedprice, l_extendedprice, l_extendedprice, l_quantity, l_quantity, l_quantity]) AS v FROM lineitem),
LATERAL (SELECT (xor((a * 16777619) & 4294967295, b) & 1023)::INT AS i) WHERE v <> 0""")
def interactions_lineitem(spark, sf_dir):
    d = _read(spark, sf_dir, "lineitem")
    x, y = F.array("l_quantity", "l_tax", "l_discount"), F.array("l_extendedprice", "l_quantity")
    d = d.select("l_orderkey", "l_linenumber", hashing.from_vector(array_to_vector(x)).alias("x"), hashing.from_vector(array_to_vector(y)).alias("y"))
    out = hashing.interactions(d, ["x", "y"], "z", bits=10, sum_collisions=True)
    both = F.arrays_zip(F.col("z")["indices"].alias("slot"), F.col("z")["values"].alias("value"))
    return _round(out.select("l_orderkey", "l_linenumber", F.explode(both).alias("p")).select("l_orderkey", "l_linenumber", "p.slot", "p.value"), "value")


@query()
def hash_features_orders(spark, sf_dir):
    d = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    out = hashing.hash_features(d, ["o_orderstatus", "o_totalprice"], bits=18, split_cols=("o_orderpriority",))
    return out.select("o_orderkey", F.size(F.col("features")["indices"]).alias("n"), F.to_json("features").alias("features"))


@query()
def linear_classifier_orders(spark, sf_dir):
    d = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    hashed = hashing.hash_features(d, ["o_orderstatus", "o_orderpriority"], bits=12)
    return hashing.linear_classifier(hashed, bits=12)(hashed).select("o_orderkey", "label", "probability", "prediction")


@query()
def linear_regressor_parts(spark, sf_dir):
    d = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") / 50).alias("size"), (F.col("p_retailprice") / 1000).alias("label"))
    hashed = hashing.hash_features(d, ["p_brand", "size"], bits=12)
    return hashing.linear_regressor(hashed, bits=12, passes=2)(hashed).select("p_partkey", "label", "prediction")


@query()
def contextual_bandit_events(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (-F.col("value")).alias("label"))
    shared = hashing.hash_features(e, ["event_type"], "shared", bits=10)
    action = lambda a: F.struct(F.lit(1 << 10).alias("size"), F.array(F.lit(1000 + a)).alias("indices"), F.array(F.lit(1.0)).alias("values"))
    logged = shared.withColumns({"actions": F.array(*[action(a) for a in range(3)]), "chosenAction": (F.col("user_id") % 3 + 1).cast("int"), "probability": F.lit(1 / 3)})
    out = hashing.contextual_bandit(logged, "shared", "actions", bits=10)(logged)
    return out.select("event_id", F.posexplode("prediction").alias("action", "chance"))


@query()
def boosted_classifier_parts(spark, sf_dir):
    d = _part_features(spark, sf_dir).withColumn("features", F.array(F.col("p_size").cast("double"), F.length("p_type").cast("double")))
    return boosting.fit_boosted(d, objective="binary", n_iterations=3, num_leaves=7)(d).select("p_partkey", "label", F.get("probability", 1).alias("chance"), "prediction")


@query()
def boosted_ranker_orders(spark, sf_dir):
    o = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_discount").alias("features"), F.floor(F.col("l_quantity") / 15).alias("label"))
    return boosting.fit_boosted(o, objective="lambdarank", group_col="l_orderkey", n_iterations=2, num_leaves=4)(o).select("l_orderkey", "l_linenumber", "prediction")


@query()
def isolation_forest_embeddings(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return outliers.isolation_forest(e, n_trees=20, contamination=0.05)(e).select("vec_id", "outlierScore", "predictedLabel")


def _explained(spark, sf_dir):
    """A table, a model that is a plain formula, and a few rows to explain."""
    d = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), (F.col("p_retailprice") / 100).alias("price"))
    model = lambda x: x.withColumn("probability", 2 * F.col("size") - 3 * F.col("price") + 5)
    return d, model, d.where("p_partkey <= 20")


@query("""SELECT p_partkey, s::INT AS slot, round(3.14159265 * CASE s WHEN 0 THEN 2 * ms - 3 * mp + 5 WHEN 1 THEN 2 * (p_size - ms) ELSE -3 * (p_retailprice / 100 - mp) END, 3) AS value
FROM part, (SELECT avg(p_size) AS ms, avg(p_retailprice / 100) AS mp FROM part WHERE p_partkey <= 100), range(3) t(s) WHERE p_partkey <= 20""")
def tabular_shap_parts(spark, sf_dir):
    d, model, rows = _explained(spark, sf_dir)
    out = explain.tabular_shap(rows, model, ["size", "price"], d.where("p_partkey <= 100"))
    # times a number that leaves no ties to round
    return out.select("p_partkey", F.posexplode(F.get("explanation", 0)).alias("slot", "value")).withColumn("value", F.round(F.col("value") * 3.14159265, 3))


@query("""SELECT p_partkey, s::INT AS slot, CASE s WHEN 0 THEN 2.0 ELSE -3.0 END::DOUBLE AS value FROM part, range(2) t(s) WHERE p_partkey <= 20""")
def tabular_lime_parts(spark, sf_dir):
    d, model, rows = _explained(spark, sf_dir)
    out = explain.tabular_lime(rows, model, ["size", "price"], d, n_samples=200)
    return _round(out.select("p_partkey", F.posexplode(F.get("explanation", 0)).alias("slot", "value")), "value", digits=3)


@query("""SELECT p_partkey, s::INT AS slot, CASE s WHEN 0 THEN 2.0 ELSE -3.0 END::DOUBLE AS value FROM part, range(2) t(s) WHERE p_partkey <= 20""")
def vector_lime_parts(spark, sf_dir):
    d, _, rows = _explained(spark, sf_dir)
    vector = lambda x: x.select("p_partkey", array_to_vector(F.array("size", "price")).alias("v"))
    model = lambda x: x.withColumn("probability", 2 * F.get(vector_to_array("v"), 0) - 3 * F.get(vector_to_array("v"), 1) + 5)
    out = explain.vector_lime(vector(rows), model, "v", vector(d), n_samples=200)
    return _round(out.select("p_partkey", F.posexplode(F.get("explanation", 0)).alias("slot", "value")), "value", digits=3)


@query("""WITH b AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT e.event_id, b.n FROM events e LEFT JOIN (SELECT * FROM b WHERE n > 60) b USING (user_id)""")
def left_outer_events(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n > 60")
    return e.join(n, "user_id", "left").select("event_id", "n")


@query("""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)""")
def left_semi_orders(spark, sf_dir):
    return _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("""SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def broadcast_left_nation(spark, sf_dir):
    # 25 rows, hinted on the left
    return F.broadcast(_read(spark, sf_dir, "nation")).join(_read(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("""SELECT c_nationkey, place::INT AS place, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) - 1 AS place FROM customer) WHERE place < 5""")
def top_values_nation(spark, sf_dir):
    out = row_functions.top_values(_read(spark, sf_dir, "customer"), ["c_nationkey"], "c_custkey", "c_acctbal", 5)
    return out.select("c_nationkey", F.posexplode("values").alias("place", "c_custkey"))


_WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"


@query(f"""SELECT doc_id, i::INT AS place, array_to_string(w[i * 40 + 1:i * 40 + 50], ' ') AS passage FROM (SELECT doc_id, {_WORDS} AS w FROM documents), LATERAL (SELECT unnest(range(greatest(1, ceil((len(w) - 10) / 40.0)::BIGINT))) AS i) WHERE len(w) > 0""")
def passages_documents(spark, sf_dir):
    return row_functions.passages(_read(spark, sf_dir, "documents").select("doc_id", "text"), "text", 50, 40).select("doc_id", "place", "passage")


@query(f"""SELECT doc_id, i::INT AS place, array_to_string(w[i * 40 + 1:i * 40 + 50], ' ') AS passage FROM (SELECT doc_id, {_WORDS} AS w FROM documents), LATERAL (SELECT unnest(range(greatest(1, ceil((len(w) - 10) / 40.0)::BIGINT))) AS i) WHERE len(w) > 0""")
def passages_udtf(spark, sf_dir):
    row_functions.register(spark)
    _read(spark, sf_dir, "documents").select("doc_id", "text").createOrReplaceTempView("stagekit_documents")
    return spark.sql("SELECT doc_id, place, passage FROM stagekit_documents, LATERAL passages(text, 50, 40)")


@query("""SELECT fold::INT AS fold, 'all' AS what, (SELECT count(*) FROM events) AS n FROM range(3) t(fold)""")
def folds_events(spark, sf_dir):
    """Each fold's two parts together are the table, and no row is in both."""
    e = _read(spark, sf_dir, "events").select("event_id", "value")
    parts = learn.folds(e, 3)
    out = None
    for i, (train, held) in enumerate(parts):
        both = train.join(held, "event_id").count()
        one = train.union(held).agg(F.count_distinct("event_id").alias("n")).select(F.lit(i).alias("fold"), F.lit("all" if both == 0 else "twice").alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def binary_files(spark, sf_dir):
    out = files.read_binary_files(spark, sf_dir, pattern="[nr]*.parquet")
    return out.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.length("bytes").alias("size"))


def _pictures(spark, sf_dir):
    """Embeddings as gray images of 8 x 8 pixels."""
    e = _read(spark, sf_dir, "embeddings")
    gray = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x * 40 + 128))).cast("int"))
    data = F.unhex(F.array_join(F.transform(gray, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    image = F.struct(F.col("vec_id").cast("string").alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data"))
    return e.select("vec_id", image.cast(images.IMAGE).alias("image"))


@query("""SELECT vec_id, (63 - (i - 1) // 8 * 8 - (7 - (i - 1) % 8))::INT AS slot, greatest(0, least(255, floor(embedding[i]::DOUBLE * 40 + 128)))::DOUBLE AS value FROM embeddings, range(1, 65) t(i)""")
def image_flip_unroll(spark, sf_dir):
    turned = images.transform_images(_pictures(spark, sf_dir), [{"step": "flip", "code": 0}])
    return _slots(images.unroll_images(turned), "vec_id")


@query("""SELECT vec_id, ((i - 1) // 8 // 2 * 4 + (i - 1) % 8 // 2)::INT AS slot, round_even(avg(greatest(0, least(255, floor(embedding[i]::DOUBLE * 40 + 128)))), 0)::DOUBLE AS value FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2""")
def image_resize_half(spark, sf_dir):
    small = images.transform_images(_pictures(spark, sf_dir), [{"step": "resize", "height": 4, "width": 4}])
    return _slots(images.unroll_images(small), "vec_id")


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * (i % 3))), 4) AS score FROM embeddings""")
def apply_network_embeddings(spark, sf_dir):
    import numpy as np

    e = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    weights = np.arange(1, 65) % 3
    out = inference.apply_network(e, lambda x: {"out": x["in"] @ weights[:, None]}, {"in": "embedding"}, {"score": "out"}, vectors=False)
    return out.select("vec_id", F.round(F.get("score", 0), 4).alias("score"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: e[i]::DOUBLE * embedding[i]::DOUBLE)) AS d FROM q, embeddings)
SELECT query_id, place::INT AS place, id, round(d, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, id DESC) - 1 AS place FROM s) WHERE place < 5""")
def knn_fitted(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "features")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "features")
    out = neighbors.fit_knn(e, 5, "vec_id", "features")(asked)
    return out.select("query_id", F.posexplode("neighbors").alias("place", "n")).select("query_id", "place", F.col("n")["value"].alias("id"), F.round(F.col("n")["distance"], 5).alias("distance"))


@query()
def ranking_train_validation(spark, sf_dir):
    p = _purchases(spark, sf_dir).groupBy("user", "item").agg(F.sum("rating").alias("rating"))
    choices = [recommend.sar_recommender("user", "item", "rating", kind, support=2) for kind in ("jaccard", "lift")]
    best, values, found = recommend.ranking_train_validation(p, choices, "user", "item", "rating", k=5)
    return found.withColumns({"chosen": F.lit(best), "ndcg": F.lit(values[best])})
