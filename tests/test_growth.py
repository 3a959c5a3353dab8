"""What grew faster than its input: the mended steps on small tables, against plain versions."""

from __future__ import annotations

import numpy as np
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagekit.operators import access, boosting, learn, neighbors, profile, recommend


def test_slots_are_found_without_dense_rows(spark):
    schema = T.StructType([T.StructField("v", VectorUDT())])
    rows = [(SparseVector(1 << 18, [3, 200_000 + i % 5], [1.0, 0.0 if i % 5 == 4 else 2.0]),) for i in range(40)]
    d = spark.createDataFrame([*rows, (None,)], schema)  # a null vector has no slots
    assert profile.count_selector(d, "v", "s").arguments["indices"] == [3, 200_000, 200_001, 200_002, 200_003]
    assert profile.count_selector(d.where("v IS NULL"), "v", "s").arguments["indices"] == []


def test_regression_on_texts_takes_few_slots(spark):
    from pyspark.ml.regression import LinearRegression

    d = spark.range(400).select("id", F.concat(F.lit("kind "), (F.col("id") % 4).cast("string")).alias("words"), (F.col("id") % 4 * 10.0).alias("y"))
    fitted = learn.train_regressor(d, LinearRegression(), "y", ["words"])
    assert len(fitted.parts[0]["indices"]) <= 5
    assert all(abs(r.y - r.scores) < 1e-3 for r in fitted(d).collect())


def _bought(spark):
    return spark.createDataFrame([(u, f"i{(u * 7 + i * i) % 13:02}", float(1 + (u + i) % 3)) for u in range(40) for i in range(1 + u % 7)], "user long, item string, rating double").distinct()


def test_tiles_give_what_a_join_gives(spark, monkeypatch):
    """A larger similarity makes no row for a user and a pair."""
    rows = [tuple(r) for r in _bought(spark).collect()]
    users, affinity = {}, {}
    for u, i, r in rows:
        users.setdefault(u, set()).add(i)
        affinity[u, i] = affinity.get((u, i), 0.0) + r
    names = sorted({i for _, i, _ in rows})
    both = {(a, b): sum(a in x and b in x for x in users.values()) for a in names for b in names}
    both = {p: float(n) for p, n in both.items() if n >= 2}
    d = _bought(spark)
    similarity = recommend.sar_similarity(d, "user", "item", "cooccurrence", 2)
    assert {(r.a, r.b): r.similarity for r in similarity.collect()} == both
    for name, n in (("SMALL", 3), ("ENTRIES", 20), ("TILE", 30)):
        monkeypatch.setattr(recommend, name, n)
    made = []
    monkeypatch.setattr(recommend, "top_k", lambda scores, key, k, f=recommend.top_k: (made.append(scores.count()), f(scores, key, k))[1])
    for seen in (False, True):
        found = recommend.sar_recommend(recommend.sar_affinity(d, "user", "item", "rating"), similarity, 3, drop_seen=seen)
        wanted = set()
        for u in users:
            score = {}
            for i in users[u]:
                for (a, b), n in both.items():
                    if a == i:
                        score[b] = score.get(b, 0.0) + affinity[u, i] * n
            best = sorted((-s, b) for b, s in score.items() if not (seen and b in users[u]))[:3]
            wanted |= {(u, n + 1, b, -s) for n, (s, b) in enumerate(best)}
        assert {tuple(r) for r in found.collect()} == wanted
        assert made.pop() < 40 * 13


def test_pairs_are_added_up_before_they_move(spark, monkeypatch):
    """Users next to each other that share their items: a count for a pair and a task leaves, not a row for a pair of a user."""
    monkeypatch.setattr(recommend, "USER_ITEMS", 6)
    n_items, sent = 10, []
    run = recommend._counting(n_items, 3)
    import pyarrow as pa

    lists = pa.array([[0, 2, 5]] * 500, pa.list_(pa.int32()))
    for b in run([pa.RecordBatch.from_arrays([lists, lists], names=["a", "b"])]):
        sent += [(np.cumsum(recommend._unpacked(c)).tolist(), recommend._unpacked(n).tolist()) for c, n in zip(b.column("codes").to_pylist(), b.column("counts").to_pylist())]
    assert sorted((c, n) for codes, counts in sent for c, n in zip(codes, counts)) == [(c, 500) for c in (0, 2, 5, 22, 25, 55)]


def test_exact_quantiles_keep_no_sketch_of_all_rows(spark, monkeypatch):
    values = [None, float("nan"), *[float(i * i % 101) / 4 for i in range(400)], *[7.25] * 300]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "k long, x double")
    fine = sorted(x for x in values if x is not None and x == x)
    wanted = [0.005, 0.05, 0.25, 0.5, 0.95, 0.995, 1.0]
    plain = [fine[max(1, -(-int(q * 1000) * len(fine) // 1000)) - 1] for q in wanted]
    assert profile.exact_quantiles(d, "x", wanted) == (plain, len(set(fine)))
    assert profile.exact_quantiles(d.where("x IS NULL"), "x", [0.5]) == ([None], 0)

    def sketch(*_):
        raise AssertionError("a sketch that keeps all rows")

    monkeypatch.setattr(profile.F, "percentile_approx", sketch)
    row = profile.summarize(d.select("x"), exact_distinct=True, accuracy=1_000_000_000).first()
    assert (row["Count"], row["Unique_Value_Count"], row["Missing_Value_Count"], row["Median"]) == (700.0, len(set(fine)), 2.0, plain[3])
    assert profile.clean_missing(d, ["x"], "Median", exact=True).arguments["fill"] == {"x": plain[3]}
    empty = profile.summarize(d.where("k < 0").select("x"), exact_distinct=True, accuracy=1_000_000_000).first()
    assert (empty["Count"], empty["Unique_Value_Count"], empty["Median"]) == (0.0, 0.0, None)


def test_gradients_of_many_queries_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = np.array([1, 3, 2, 70, 5, 3, 0, 30, 5])
    s, y = rng.integers(0, 4, sizes.sum()) / 2.0, rng.integers(0, 4, sizes.sum()).astype(float)
    y[1:4] = 0  # nothing to rank
    ends = np.cumsum(sizes)
    plain = [boosting.ranking_gradients(s[e - n : e], y[e - n : e], 20) for n, e in zip(sizes, ends)]
    calls = []
    monkeypatch.setattr(boosting, "ranking_gradients", lambda *a, f=boosting.ranking_gradients: (calls.append(1), f(*a))[1])
    for got, wanted in zip(boosting.grouped_gradients(s, y, sizes, 20), zip(*plain)):
        assert np.allclose(got, np.concatenate(wanted), rtol=1e-12, atol=1e-14)
    assert len(calls) == 1  # only the query of 70 rows


def test_boosted_scores_of_rows_without_features(spark):
    d = spark.createDataFrame([(i, None if i % 9 == 0 else [float(i % 10), None if i % 4 == 0 else float(i % 3)], float(i % 10 > 4)) for i in range(300)], "id long, features array<double>, label double")
    model = boosting.fit_boosted(d, objective="binary", n_iterations=3, num_leaves=4)
    rows = boosting.score_boosted(d, **model.arguments, leaf_col="leaf", shap_col="shap").collect()
    for r in rows:
        if r.features is None:
            assert r.rawPrediction is None and r.prediction is None and r.leaf is None and r.shap is None
        else:
            x = np.array([[np.nan if v is None else v for v in r.features]])
            raw = boosting.raw_scores(model.trees, model.start, x)[0, 0]
            assert abs(r.rawPrediction[1] - raw) < 1e-12 and abs(sum(r.shap) - raw) < 1e-9 and len(r.leaf) == 3
            assert r.prediction == r.label


def _block(n, m, seed=3):
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    vec = rng.integers(-2, 3, (n + m, 8)).astype(float)  # many ties
    label = [str(i % 3) for i in range(n)] + [""] * m
    wanted = [[]] * n + [["1", "9"] if i % 2 else ["0", "2"] for i in range(m)]
    mixed = rng.permutation(n + m)
    take = lambda x: [x[i] for i in mixed]
    t = {"id": take([*range(n), *range(m)]), "vec": take(list(vec)), "label": take(label), "wanted": take(wanted), "kind": take([1] * n + [0] * m)}
    return vec[:n], vec[n:], pa.table(t, schema=pa.schema({"id": pa.int64(), "vec": pa.list_(pa.float64()), "label": pa.string(), "wanted": pa.list_(pa.string()), "kind": pa.int32()}))


def test_a_block_of_neighbours_holds_few_scores(monkeypatch):
    import tracemalloc

    rows, asked, table = _block(500, 40)
    for conditioned in (False, True):
        for scores in (1, 1_000, 1_000_000):
            monkeypatch.setattr(neighbors, "SCORES", scores)
            got = {}
            for r in neighbors.nearest_in_block(table, 5, conditioned).to_pylist():
                got.setdefault(r["query_id"], []).append((-r["distance"], -r["id"]))
            for i, v in enumerate(asked):
                fine = [j for j in range(len(rows)) if not conditioned or str(j % 3) in (["1"] if i % 2 else ["0", "2"])]
                assert sorted(got[i]) == sorted((-float(rows[j] @ v), -j) for j in fine)[:5]
    monkeypatch.undo()
    table = _block(20_000, 1_000)[2]
    tracemalloc.start()
    neighbors.nearest_in_block(table, 5, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all products at once are 160 MB


def test_components_deal_every_edge_a_few_times(spark, monkeypatch):
    """A path of 200 nodes: rounds grow with its logarithm, and stars, cycles and single edges are right."""
    rng = np.random.default_rng(8)
    path = [(i, f"p{i:03}") for i in range(1000, 1100)] + [(i + 1, f"p{i:03}") for i in range(1000, 1099)]
    edges = [*path, *[(int(x), f"r{y}") for x, y in rng.integers(0, 60, (70, 2))], (500, "one"), (501, "two"), (502, "two"), *[(600 + i, "hub") for i in range(30)]]
    parent = {}

    def root(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for x, y in edges:
        parent[root(x)] = root(y)
    least = {}
    for x, _ in edges:
        least[root(x)] = min(x, least.get(root(x), x))
    written = []
    monkeypatch.setattr(access, "write_table", lambda df, label, f=access.write_table: (written.append(label), f(df, label))[1])
    left, right = access.connected_components(spark.createDataFrame([*edges, (None, "none"), (7_000, None)], "x long, y string"), "x", "y")
    assert {tuple(r) for r in left.collect()} == {(x, least[root(x)]) for x, _ in edges}
    assert {tuple(r) for r in right.collect()} == {(y, least[root(y)]) for _, y in edges}
    assert left.columns == ["x", "component"] and right.columns == ["y", "component"] and len(written) < 10
