"""Queries over the driver's tables: shaping, profiling, text, neighbours, recommendation, metrics, access."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagekit.operators import access, columns, metrics, neighbors, profile, recommend, text
from stagekit.plans.session import write_table


def _read(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINEITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _round(df, *cols, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


_Q = profile.QUANTILES
_SUMMARY = " UNION ALL ".join(
    f"""SELECT '{c}' AS "Feature", count({c})::DOUBLE AS "Count", count(DISTINCT {c})::DOUBLE AS "Unique_Value_Count", (count(*) - count({c}))::DOUBLE AS "Missing_Value_Count",
min({c}) AS "Min", max({c}) AS "Max", round(var_samp({c}), 4) AS "Sample_Variance", round(stddev_samp({c}), 4) AS "Sample_Standard_Deviation", round(kurtosis_pop({c}), 4) AS "Sample_Kurtosis",
round((SELECT avg((x - m) ** 3) / nullif(avg((x - m) ** 2) ** 1.5, 0) FROM (SELECT {c} AS x, avg({c}) OVER () AS m FROM lineitem)), 4) AS "Sample_Skewness", """
    + ", ".join(f"""quantile_disc({c}, {q}) AS "{name}\"""" for name, q in _Q.items()) + " FROM lineitem"
    for c in LINEITEM
)


@query(_SUMMARY)
def summarize_lineitem(spark, sf_dir):
    out = profile.summarize(_read(spark, sf_dir, "lineitem").select(*LINEITEM), exact_distinct=True, accuracy=1_000_000_000)
    return _round(out, "Sample_Variance", "Sample_Standard_Deviation", "Sample_Kurtosis", "Sample_Skewness", digits=4)


@query()
def summarize_events_all(spark, sf_dir):
    return profile.summarize(_read(spark, sf_dir, "events"))


@query("""SELECT p_partkey, p_name AS part_name, p_size FROM part""")
def select_drop_rename_part(spark, sf_dir):
    d = columns.select_columns(_read(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_brand", "p_size"])
    return columns.rename_column(columns.drop_columns(d, ["p_brand"]), "p_name", "part_name")


@query("""SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings""")
def explode_embedding(spark, sf_dir):
    d = columns.explode_column(_read(spark, sf_dir, "embeddings"), "embedding", "x")
    return d.select("vec_id", F.col("x").cast("double").alias("x"))


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_quantity * 2 AS q2, l_tax * 2 AS t2 FROM lineitem""")
def udf_transformer_discount(spark, sf_dir):
    d = columns.udf_transform(_read(spark, sf_dir, "lineitem"), lambda p, r: F.round(p * (1 - r), 4), "net", input_cols=["l_extendedprice", "l_discount"])
    double = lambda d, input_col, output_col: columns.udf_transform(d, lambda x: x * 2, output_col, input_col)
    return columns.multi_column(d, double, ["l_quantity", "l_tax"], ["q2", "t2"]).select("l_orderkey", "l_linenumber", "net", "q2", "t2")


@query("""SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS batch_id, o_orderkey, o_totalprice FROM orders""")
def minibatch_flatten_orders(spark, sf_dir):
    d = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return columns.flatten_batch(columns.fixed_minibatch(d, 100, ["o_orderkey"]))


@query("""SELECT batch_id, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch_id, o_custkey FROM orders) GROUP BY batch_id""")
def fixed_minibatch_orders(spark, sf_dir):
    d = columns.fixed_minibatch(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 64, ["o_orderkey"])
    return d.select("batch_id", F.size("o_custkey").cast("long").alias("n"), F.aggregate("o_custkey", F.lit(0).cast("long"), lambda a, x: a + x).alias("keys"))


@query("""SELECT o_orderkey, o_orderpriority, round(max(n) OVER () / n, 6) AS weight FROM (SELECT o_orderkey, o_orderpriority, count(*) OVER (PARTITION BY o_orderpriority)::DOUBLE AS n FROM orders)""")
def class_balancer_priority(spark, sf_dir):
    d = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return _round(profile.class_balancer(d, "o_orderpriority")(d), "weight").select("o_orderkey", "o_orderpriority", "weight")


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS q, round(avg(l_tax), 6) AS t FROM lineitem GROUP BY ALL""")
def ensemble_by_key(spark, sf_dir):
    return _round(profile.ensemble_by_key(_read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_tax"], ["q", "t"]), "q", "t")


@query("""SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER (PARTITION BY l_suppkey), 6) AS q FROM lineitem""")
def ensemble_by_key_join(spark, sf_dir):
    d = profile.ensemble_by_key(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), ["l_suppkey"], ["l_quantity"], ["q"], collapse=False)
    return _round(d, "q").select("l_orderkey", "l_linenumber", "q")


@query("""SELECT o_orderstatus, least(8, count(*))::BIGINT AS partitions, (count(*) // 8)::BIGINT AS fewest, ceil(count(*) / 8.0)::BIGINT AS most FROM orders GROUP BY 1""")
def stratified_repartition_status(spark, sf_dir):
    d = columns.stratified_repartition(_read(spark, sf_dir, "orders"), "o_orderstatus", 8, "original").withColumn("part", F.spark_partition_id())
    each = d.groupBy("o_orderstatus", "part").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("partitions"), F.min("n").alias("fewest"), F.max("n").alias("most"))


def _holes(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


@query("""SELECT event_id, round(coalesce(CASE WHEN event_id % 7 <> 0 THEN value END, (SELECT avg(value) FROM events WHERE event_id % 7 <> 0)), 6) AS value FROM events""")
def clean_missing_mean(spark, sf_dir):
    d = _holes(spark, sf_dir)
    return _round(profile.clean_missing(d, ["value"])(d), "value")


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN value END, (SELECT quantile_disc(value, 0.5) FROM events WHERE event_id % 7 <> 0)) AS value FROM events""")
def clean_missing_median(spark, sf_dir):
    d = _holes(spark, sf_dir)
    return profile.clean_missing(d, ["value"], "Median", exact=True)(d)


@query("""SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value ELSE -1.0 END AS value FROM events""")
def clean_missing_custom(spark, sf_dir):
    d = _holes(spark, sf_dir)
    return profile.clean_missing(d, ["value"], "Custom", -1.0)(d)


@query("""SELECT o_orderkey, o_custkey::INT AS o_custkey, round(o_totalprice, 2) AS priced, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders""")
def data_conversion_orders(spark, sf_dir):
    d = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    d = profile.convert(profile.convert(profile.convert(d, ["o_custkey"], "integer"), ["o_totalprice"], "string"), ["o_orderdate"], "string")
    return d.select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice").cast("double"), 2).alias("priced"), "o_orderdate")


@query("""SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS i, o_orderpriority AS back FROM orders""")
def value_indexer_priority(spark, sf_dir):
    d = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return profile.index_to_value(profile.value_indexer(d, "o_orderpriority", "i")(d), "i", "back").select("o_orderkey", "i", "back")


@query("""SELECT event_id, event_type, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id)::INT AS id FROM events""")
def id_indexer_partitioned(spark, sf_dir):
    d = _read(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return profile.id_indexer(d, "user_id", "id", "event_type")(d).select("event_id", "event_type", "id")


@query("""SELECT event_id, dense_rank() OVER (ORDER BY user_id)::INT AS id, user_id AS back FROM events""")
def id_indexer_global(spark, sf_dir):
    d = _read(spark, sf_dir, "events").select("event_id", "user_id")
    fitted = profile.id_indexer(d, "user_id", "id")
    return profile.undo_id_indexer(fitted(d), fitted, "id").select("event_id", "id", F.col("user_id").alias("back"))


@query("""SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 5) AS z FROM events WINDOW w AS (PARTITION BY event_type)""")
def standard_scaler_events(spark, sf_dir):
    d = _read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return _round(profile.standard_scaler(d, "value", "z", "event_type")(d), "z", digits=5).select("event_id", "z")


@query("""SELECT event_id, round(5 + (value - min(value) OVER w) * 5 / (max(value) OVER w - min(value) OVER w), 5) AS x FROM events WINDOW w AS (PARTITION BY event_type)""")
def linear_scaler_events(spark, sf_dir):
    d = _read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return _round(profile.linear_scaler(d, "value", "x", "event_type", 5.0, 10.0)(d), "x", digits=5).select("event_id", "x")


@query("""SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS id FROM events""")
def zip_with_index_events(spark, sf_dir):
    return columns.zip_with_index(_read(spark, sf_dir, "events").select("event_id", "ts"), "id", order_by=["ts", "event_id"]).select("event_id", "id")


@query("""SELECT l_orderkey, l_linenumber, l_quantity AS a, l_tax AS b FROM lineitem""")
def vector_zipper_lineitem(spark, sf_dir):
    d = columns.vector_zipper(_read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "v")
    d = columns.slice_values(d, "v", "s", [0, 2], keep_array=True)
    return d.select("l_orderkey", "l_linenumber", F.get("s", 0).alias("a"), F.get("s", 1).alias("b"))


_TOKENS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"


@query(f"""SELECT doc_id, len({_TOKENS})::BIGINT AS n, len(list_distinct({_TOKENS}))::BIGINT AS d, md5(array_to_string({_TOKENS}, ' ')) AS digest FROM documents""")
def text_tokens(spark, sf_dir):
    d = text.tokenize(_read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "t")
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("d"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"""SELECT doc_id, len(g)::BIGINT AS grams, md5(array_to_string(g, '|')) AS digest FROM (SELECT doc_id, list_concat(list_concat(t,
list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])), list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g
FROM (SELECT doc_id, {_TOKENS} AS t FROM documents))""")
def multi_ngram_counts(spark, sf_dir):
    d = text.tokenize(_read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "t")
    grams = text.multi_ngram(d, "t", "g", [1, 2, 3])
    return grams.select("doc_id", F.size("g").cast("long").alias("grams"), F.md5(F.array_join("g", "|")).alias("digest"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, 0::BIGINT AS place, ''::VARCHAR AS page, text AS rest, false AS last FROM documents UNION ALL
SELECT doc_id, place + 1, substr(rest, 1, c), substr(rest, c + 1), length(rest) <= 500 FROM (SELECT *, CASE WHEN length(rest) <= 500 THEN length(rest)
ELSE coalesce(nullif(length(regexp_extract(substr(rest, 1, 500), '^(?s:.{450,499})\\s')), 0), 500) END AS c FROM p WHERE NOT last AND rest IS NOT NULL))
SELECT doc_id, place - 1 AS place, page FROM p WHERE place > 0""")
def page_splitter_pages(spark, sf_dir):
    d = text.page_splitter(_read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "pages", 450, 500)
    return d.select("doc_id", F.posexplode("pages").alias("place", "page")).withColumn("place", F.col("place").cast("long"))


@query("""SELECT doc_id, nfc_normalize(lower(text)) AS text FROM documents""")
def unicode_nfc_lower(spark, sf_dir):
    return text.normalize_unicode(_read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "text", "NFC")


@query()
def text_preprocessor(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return text.preprocess_text(d, "text", "text", {"the": "THE", "then": "THEN", "and": "&"}, "lowerCase")


@query()
def text_featurizer(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return text.featurize_text(d, "text", "features", 1 << 12)(d).select("doc_id", columns.value_at(F.col("features"), 0).alias("slot_0"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: e[i]::DOUBLE * embedding[i]::DOUBLE)) AS d FROM q, embeddings)
SELECT query_id, rank, id, round(d, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, id DESC)::INT AS rank FROM s) WHERE rank <= 5""")
def knn_inner_product(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return _round(neighbors.knn(e, q, 5, "vec_id", "embedding"), "distance", digits=5)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, label, list_sum(list_transform(range(1, 65), lambda i: e[i]::DOUBLE * embedding[i]::DOUBLE)) AS d FROM q, embeddings WHERE label IN (1, 3))
SELECT query_id, rank, id, round(d, 5) AS distance, label::VARCHAR AS label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, id DESC)::INT AS rank FROM s) WHERE rank <= 3""")
def conditional_knn(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id").withColumn("c", F.array(F.lit("1"), F.lit("3")))
    return _round(neighbors.knn(e, q, 3, "vec_id", "embedding", label_col="label", conditioner_col="c"), "distance", digits=5)


def _purchases(spark, sf_dir):
    o, li = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item"), F.col("l_quantity").alias("rating"))


_P = "p AS (SELECT o_custkey AS user_, l_suppkey AS item, l_quantity AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_SIM = f"""WITH {_P}, d AS (SELECT DISTINCT user_, item FROM p), n AS (SELECT item, count(*) AS n FROM d GROUP BY item),
c AS (SELECT x.item AS a, y.item AS b, count(*) AS c FROM d x JOIN d y USING (user_) GROUP BY ALL HAVING count(*) >= 4)"""


@query(f"""WITH {_P} SELECT user_ AS "user", item, sum(rating) AS affinity FROM p GROUP BY ALL""")
def sar_affinity(spark, sf_dir):
    return recommend.sar_affinity(_purchases(spark, sf_dir), "user", "item", "rating")


def _similarity(kind: str, value: str):
    def run(spark, sf_dir):
        return _round(recommend.sar_similarity(_purchases(spark, sf_dir), "user", "item", kind), "similarity", digits=8)

    run.__name__ = f"sar_similarity_{kind}"
    query(f"{_SIM} SELECT a, b, round({value}, 8) AS similarity FROM c JOIN n na ON a = na.item JOIN n nb ON b = nb.item")(run)


for _kind, _value in (("jaccard", "c::DOUBLE / (na.n + nb.n - c)"), ("lift", "c::DOUBLE / (na.n * nb.n)"), ("cooccurrence", "c::DOUBLE")):
    _similarity(_kind, _value)


@query(f"""{_SIM}, s AS (SELECT a, b, c FROM c), f AS (SELECT user_, item, sum(rating) AS affinity FROM p GROUP BY ALL),
r AS (SELECT user_, b AS item, sum(affinity * c) AS score FROM f JOIN s ON f.item = s.a GROUP BY ALL)
SELECT user_ AS "user", rank, item, score FROM (SELECT *, row_number() OVER (PARTITION BY user_ ORDER BY score DESC, item)::INT AS rank FROM r) WHERE rank <= 5""")
def sar_topk(spark, sf_dir):
    p = _purchases(spark, sf_dir)
    return recommend.sar_recommend(recommend.sar_affinity(p, "user", "item", "rating"), recommend.sar_similarity(p, "user", "item", "cooccurrence"), 5)


@query("""SELECT p_brand, row_number() OVER (ORDER BY n DESC, p_brand) - 1 AS i FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)""")
def recommendation_indexer(spark, sf_dir):
    return recommend.index_by_frequency(_read(spark, sf_dir, "part"), "p_brand", "i")


@query()
def ranking_metrics_all(spark, sf_dir):
    p = _purchases(spark, sf_dir)
    split = write_table(recommend.ranking_split(p, "user", "item"), "ranking-split")
    train, test = split.where("is_train"), split.where("NOT is_train")
    rec = recommend.sar_recommend(recommend.sar_affinity(train, "user", "item", "rating"), recommend.sar_similarity(train, "user", "item"), 10)
    lists = rec.groupBy("user").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("prediction"))
    actual = recommend.rank_lists(test, "user", "item", "rating", 10).withColumnRenamed("items", "label")
    return recommend.ranking_metrics(lists.join(actual, "user"), 10)


@query("""WITH d AS (SELECT doc_id, quality AS label, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS prediction FROM labels JOIN documents USING (doc_id))
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, round((tp + tn) / (tp + fp + tn + fn), 8) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall
FROM (SELECT sum((label = 1 AND prediction = 1)::INT)::DOUBLE AS tp, sum((label = 0 AND prediction = 1)::INT)::DOUBLE AS fp, sum((label = 0 AND prediction = 0)::INT)::DOUBLE AS tn, sum((label = 1 AND prediction = 0)::INT)::DOUBLE AS fn FROM d)""")
def classification_metrics(spark, sf_dir):
    return _round(metrics.binary_statistics(_judged(spark, sf_dir)), "accuracy", "precision", "recall", digits=8)


def _judged(spark, sf_dir):
    d = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("label"), F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("prediction"), F.col("n_chars").cast("double").alias("score"))


@query("""SELECT quality AS label, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS prediction, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_judged(spark, sf_dir))


@query("""WITH o AS (SELECT o_orderkey % 5 AS label, o_custkey % 5 AS prediction FROM orders), m AS (SELECT count(*)::DOUBLE AS n FROM o),
c AS (SELECT k, (SELECT count(*) FROM o WHERE label = k)::DOUBLE AS r, (SELECT count(*) FROM o WHERE prediction = k)::DOUBLE AS p, (SELECT count(*) FROM o WHERE label = k AND prediction = k)::DOUBLE AS h FROM range(5) t(k))
SELECT round(sum(h) / max(n), 8) AS accuracy, round(avg((n - r - p + 2 * h) / n), 8) AS average_accuracy, round(avg(coalesce(h / nullif(p, 0), 0)), 8) AS macro_averaged_precision, round(avg(coalesce(h / nullif(r, 0), 0)), 8) AS macro_averaged_recall FROM c, m""")
def multiclass_metrics(spark, sf_dir):
    d = _read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).alias("label"), (F.col("o_custkey") % 5).alias("prediction"))
    out = metrics.multiclass_statistics(d)
    return _round(out, *out.columns, digits=8)


@query("""WITH s AS (SELECT n_chars::DOUBLE AS score, sum(quality)::DOUBLE AS p, sum(1 - quality)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT round(sum(p * (b + n / 2)) / (sum(p) * sum(n)), 8) AS auc FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s)""")
def auc_exact(spark, sf_dir):
    return _round(metrics.auc(_judged(spark, sf_dir)), "auc", digits=8)


@query("""SELECT round(mse, 2) AS mean_squared_error, round(sqrt(mse), 4) AS root_mean_squared_error, round(1 - mse / v, 6) AS r2, round(mae, 4) AS mean_absolute_error
FROM (SELECT avg((l_extendedprice - l_quantity * 1500) ** 2) AS mse, avg(abs(l_extendedprice - l_quantity * 1500)) AS mae, var_pop(l_extendedprice) AS v FROM lineitem)""")
def regression_metrics(spark, sf_dir):
    out = metrics.regression_statistics(_read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction")))
    return out.select(F.round("mean_squared_error", 2).alias("mean_squared_error"), F.round("root_mean_squared_error", 4).alias("root_mean_squared_error"), F.round("r2", 6).alias("r2"), F.round("mean_absolute_error", 4).alias("mean_absolute_error"))


@query("""SELECT l_orderkey, l_linenumber, round(abs(l_quantity - 25), 6) AS "L1_loss", round((l_quantity - 25) ** 2, 6) AS "L2_loss" FROM lineitem""")
def per_instance_loss(spark, sf_dir):
    d = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("label"), F.lit(25.0).alias("prediction"))
    return _round(metrics.per_instance_regression(d), "L1_loss", "L2_loss").drop("label", "prediction")


@query("""SELECT round(sum(value * w) / count(*), 6) AS ips, round(sum(value * w) / sum(w), 6) AS snips FROM (SELECT value, (0.1 + user_id % 3 * 0.2) / (0.2 + user_id % 5 * 0.1) AS w FROM events)""")
def ips_snips(spark, sf_dir):
    d = _read(spark, sf_dir, "events").select("value", (F.lit(0.1) + F.col("user_id") % 3 * F.lit(0.2)).alias("t"), (F.lit(0.2) + F.col("user_id") % 5 * F.lit(0.1)).alias("l"))
    return _round(metrics.bandit_estimates(d, "value", "l", "t"), "ips", "snips")


def _accesses(spark, sf_dir):
    """Who made an event of a type (the tenant) on which day (the resource)."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return _read(spark, sf_dir, "events").select(F.col("event_type").alias("tenant"), F.col("user_id").alias("user"), day.alias("res"), F.lit(1.0).alias("likelihood"))


@query()
def complement_access(spark, sf_dir):
    a = _accesses(spark, sf_dir).withColumn("res", F.dayofyear(F.to_date("res")))
    return access.complement_access(a, "tenant", "user", "res")


@query("""SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey) AS component FROM customer""")
def connected_components(spark, sf_dir):
    return access.connected_components(_read(spark, sf_dir, "customer"), "c_custkey", "c_nationkey")[0]


@query()
def connected_components_orders(spark, sf_dir):
    return access.connected_components(_read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")[1]


@query()
def access_anomaly(spark, sf_dir):
    a = _accesses(spark, sf_dir)
    return access.fit_access_anomaly(a)(a.distinct())
