"""Featurizing, learners, explanations, outliers, images, files, HTTP and serving against plain versions."""

import http.server
import json
import math
import os
import threading
import time
import urllib.request

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from stagekit.base import Fitted, FittedStage, FunctionEstimator
from stagekit.functions import tables
from stagekit.operators import access, access_data, boosting, columns, explain, hashing, images, inference, learn, metrics, neighbors, outliers, profile, recommend
from stagekit.sources import files, http as web, services
from stagekit.streaming import serving


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, float(i % 7), None if i % 5 == 0 else i * 0.5, ["red", "green", "blue"][i % 3], f"text number {i % 4}", i % 2 == 0, int(i % 7 > 3)) for i in range(140)]
    return spark.createDataFrame(rows, "id long, a double, b double, color string, words string, flag boolean, label int").cache()


def test_featurize_kinds(spark, people):
    indexed = profile.value_indexer(people, "color", "ci")(people)
    fitted = learn.featurize(indexed, ["a", "b", "ci", "words", "flag"], "f", num_features=64)
    out = fitted(indexed)
    size = {len(r.f) for r in out.select("f").collect()}
    assert out.count() == 140 and len(size) == 1 and out.columns == [*indexed.columns, "f"]
    mean = people.agg(F.avg("b")).first()[0]
    first = out.where("id = 0").first().f.toArray()
    assert first[1] == pytest.approx(mean) and first[2:5].sum() == 1 and first[-1] == 1.0


def test_fitted_stages_are_saved(spark, people, tmp_path):
    indexed = profile.value_indexer(people, "color", "ci")
    for name, fitted in {
        "clean": profile.clean_missing(people, ["b"]), "index": indexed, "balance": profile.class_balancer(people, "color"), "ids": profile.id_indexer(people, "color", "cid"),
        "scale": profile.standard_scaler(people, "a", "z", "color"), "text": learn.featurize(people, ["a", "b", "words"], num_features=32),
        "train": learn.train_regressor(people, _linear(), "a", ["b", "flag"]),
    }.items():
        fitted.save(str(tmp_path / name))
        again = Fitted.load(str(tmp_path / name))
        assert sorted(map(str, again(people).collect())) == sorted(map(str, fitted(people).collect())), name
    model = learn.as_pipeline(profile.clean_missing(people, ["b"]), indexed)
    model.write().overwrite().save(str(tmp_path / "pipeline"))
    from pyspark.ml import PipelineModel

    assert sorted(map(str, PipelineModel.load(str(tmp_path / "pipeline")).transform(people).collect())) == sorted(map(str, model.transform(people).collect()))
    stage = FunctionEstimator(profile.clean_missing, cols=["b"]).fit(people)
    assert isinstance(stage, FittedStage) and stage.transform(people).where("b IS NULL").count() == 0


def _linear():
    from pyspark.ml.regression import LinearRegression

    return LinearRegression()


def test_value_indexer_with_many_levels(spark, people, monkeypatch):
    small = profile.value_indexer(people, "id", "i")(people).select("id", "i").collect()
    monkeypatch.setattr(profile, "LEVELS", 10)
    large = profile.value_indexer(people, "id", "i")
    assert "levels" in large.tables
    assert sorted((r.id, r.i) for r in large(people).collect()) == sorted((r.id, r.i) for r in small)
    assert large(spark.createDataFrame([(999,), (None,)], "id long")).orderBy(F.asc_nulls_last("id")).select("i").collect()[0].i == 140


def test_training_and_choice(spark, people):
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier

    tree = learn.train_classifier(people, DecisionTreeClassifier(), "label", ["a", "b"])
    scored = tree(people)
    assert {"scores", "scored_probabilities", "scored_labels"} <= set(scored.columns)
    assert learn.evaluate(scored, "label")["accuracy"] == 1.0 and learn.evaluate(scored, "label")["AUC"] == 1.0
    many = learn.train_classifier(people, LogisticRegression(maxIter=5), "color", ["a", "b"])(people)
    assert {r.scored_labels for r in many.select("scored_labels").distinct().collect()} <= {"red", "green", "blue"}
    assert set(learn.evaluate(many, "color")) == {"accuracy", "average_accuracy", "macro_averaged_precision", "macro_averaged_recall"}
    net = learn.train_classifier(people, MultilayerPerceptronClassifier(layers=[1, 3, 1], maxIter=5), "label", ["a", "b"])(people)
    assert net.count() == 140
    with pytest.raises(ValueError):
        learn.train_classifier(people, GBTClassifier(), "color", ["a"])
    with pytest.raises(ValueError):
        learn.train_regressor(people, _linear(), "color")
    weak = learn.train_classifier(people, DecisionTreeClassifier(maxDepth=1), "label", ["b"])
    best = learn.find_best([weak, tree], people, "label", "accuracy")
    assert best.model is tree and best.value == 1.0 and len(best.all_metrics) == 2 and best.roc().count() >= 2
    assert learn.grid_space({"a": learn.Discrete(1, 2), "b": learn.Discrete("x")}) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    draw = learn.random_space({"n": learn.Between(3, 9), "r": learn.Between(0.1, 1.0, log=True)}, 5)
    again = learn.random_space({"n": learn.Between(3, 9), "r": learn.Between(0.1, 1.0, log=True)}, 5)
    for _ in range(20):
        x = next(draw)
        assert x == next(again) and 3 <= x["n"] <= 9 and 0.1 <= x["r"] <= 1.0
    tuned = learn.tune(people, [DecisionTreeClassifier()], [{"maxDepth": learn.Discrete(1, 3)}], "label", "accuracy", n_folds=2, n_runs=2, input_cols=["a", "b"])
    assert tuned.value > 0.9 and tuned.transform(people).count() == 140
    reg = learn.evaluate(learn.train_regressor(people, _linear(), "a", ["b", "label"])(people), "a")
    assert 0 < reg["R^2"] <= 1


def test_murmur_and_hashed_features(spark):
    for text, seed, want in (("", 0, 0), ("", 1, 0x514E28B7), ("hello", 0, 0x248BFA47), ("hello, world", 0, 0x149BBB7F), ("The quick brown fox jumps over the lazy dog", 0x9747B28C, 0x2FA826CD)):
        assert hashing.murmur32(text, seed) & 0xFFFFFFFF == want
    row = [(1, 2.5, 0, True, "red", ["x", None, "y"], {"k": 3.0, "z": 0.0}, {"m": "v"}, (7, "in"), [1.0, 0.0, 2.0], "two words"), (2, None, 4, False, "", None, None, None, None, None, None)]
    d = spark.createDataFrame(row, "id long, n double, i int, b boolean, s string, l array<string>, m map<string,double>, t map<string,string>, st struct<q:int,w:string>, a array<double>, sp string")
    cols = ["n", "i", "b", "s", "l", "m", "t", "st", "a"]
    got = {r.id: dict(zip(r.features.indices, r.features.values)) for r in hashing.hash_features(d, cols, bits=24, split_cols=("sp",)).collect()}
    h = lambda text, seed: hashing.murmur32(text, seed) & ((1 << 24) - 1)
    space = hashing.murmur32("features")
    inner = hashing.murmur32("st")
    want = {h("n", space): 2.5, h("b", space): 1.0, h("sred", space): 1.0, h("x", space): 1.0, h("y", space): 1.0, h("mk", space): 3.0, h("tmv", space): 1.0, h("q", inner): 7.0,
            h("win", inner): 1.0, h("a", 0): 1.0, h("a", 0) + 2: 2.0, h("sptwo", space): 1.0, h("spwords", space): 1.0}
    assert got[1] == want and got[2] == {h("i", space): 4.0}
    ordered = hashing.hash_features(d.where("id = 1"), ["s", "n"], bits=20, order_bits=4).first().features
    assert [i >> 26 for i in ordered.indices] == [0, 1]
    both = hashing.interactions(hashing.hash_features(d, ["n"], "x", bits=10).withColumn("y", hashing.from_vector(array_to_vector(F.array(F.lit(0.0), F.lit(3.0))))), ["x", "y"], "z", bits=10).first()
    x = both.x["indices"][0]
    assert both.z["indices"] == [((x * 16777619) & 0xFFFFFFFF ^ 1) & 1023] and both.z["values"] == [7.5]


def test_linear_learners(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(rng.integers(0, 5)), float(rng.normal())) for i in range(2000)]
    d = spark.createDataFrame(rows, "id long, k int, x double").withColumn("y", F.col("k") * 2 - F.col("x")).withColumn("label", (F.col("k") + F.col("x") > 2).cast("int"))
    d = hashing.hash_features(d.withColumn("kk", F.col("k").cast("string")), ["kk", "x"], bits=12)
    reg = hashing.linear_regressor(d, label_col="y", bits=12, passes=6)(d)
    assert reg.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.5
    cls = hashing.linear_classifier(d, bits=12, passes=4)(d)
    assert cls.where(F.col("prediction") == F.col("label")).count() > 1800
    action = lambda a: F.struct(F.lit(4096).alias("size"), F.array(F.lit(10 + a)).alias("indices"), F.array(F.lit(1.0)).alias("values"))
    logged = d.withColumns({"actions": F.array(action(0), action(1)), "chosenAction": F.pmod("id", F.lit(2)).cast("int") + 1, "probability": F.lit(0.5)})
    logged = logged.withColumn("cost", F.when(F.col("chosenAction") == 2, 0.0).otherwise(1.0))
    out = hashing.contextual_bandit(logged, "features", "actions", cost_col="cost", bits=12, epsilon=0.1)(logged).first()
    assert out.prediction == pytest.approx([0.05, 0.95])


def test_regressions_and_coalitions():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(200, 3)), rng.uniform(0.5, 2, 200)
    y = x @ [1.0, 0.0, -2.0] + 3
    beta, constant, r2 = explain.least_squares(x, y, w)
    assert np.allclose(beta, [1, 0, -2]) and constant == pytest.approx(3) and r2 == pytest.approx(1)
    beta, constant, _ = explain.lasso(x, y, w)
    assert np.allclose(beta, [1, 0, -2], atol=1e-3)
    beta, _, _ = explain.lasso(x, y, w, 0.5)
    assert beta[1] == 0 and 0 < beta[0] < 1
    masks, weights = explain.coalitions(4, 16)
    assert len({tuple(m) for m in masks.tolist()}) == 16 and weights[0] == weights[1] == explain.SURE
    masks, weights = explain.coalitions(20, explain.effective_samples(20, 100), 3)
    assert masks.shape == (100, 20) and masks[0].sum() == 0 and masks[1].sum() == 20 and (weights > 0).all()
    assert explain.effective_samples(3, None) == 8 and explain.effective_samples(10, 5) == 12


def test_explanations(spark):
    model = lambda d: d.withColumn("probability", F.when(F.col("words").contains("good"), 1.0).otherwise(0.0))
    d = spark.createDataFrame([(1, "a good day"), (2, None)], "id long, words string")
    lime = explain.text_lime(d, model, "words", n_samples=200).where("id = 1").first()
    assert np.argmax(lime.explanation[0]) == 1 and lime.tokens == ["a", "good", "day"]
    shap = explain.text_shap(d, model, "words").where("id = 1").first()
    assert np.allclose(shap.explanation[0], [0, 0, 1, 0], atol=1e-4)
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 0.0])], "id long, x array<double>").select("id", array_to_vector("x").alias("v"))
    linear = lambda d: d.withColumn("probability", F.array(F.get(vector_to_array("v"), 0) * 2 + F.get(vector_to_array("v"), 1), F.lit(0.0)))
    got = explain.vector_shap(v, linear, "v", v).where("id = 1").first()
    assert np.allclose(got.explanation[0], [5, -2, 1], atol=1e-4) and len(got.explanation) == 2
    pixels = np.zeros((16, 16, 1), np.uint8)
    pixels[:, 8:] = 200
    pictures = spark.createDataFrame([(1, images.to_image(pixels))], f"id long, image {images.IMAGE}")
    bright = lambda d: d.withColumn("probability", F.when(F.hex("image.data").contains("C8"), 1.0).otherwise(0.0))
    cut = explain.image_shap(pictures, bright, cell=8.0).first()
    labels = np.array(cut.superpixels).reshape(16, 16)
    on = sorted(set(labels[:, 8:].ravel().tolist()))
    assert sum(cut.explanation[0][1 + i] for i in on) == pytest.approx(1, abs=1e-3)
    assert explain.image_lime(pictures, bright, cell=8.0, n_samples=60).count() == 1


def test_isolation_forest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(1000, [9.0, 9.0]), (1001, [-8.0, 9.0])]
    d = spark.createDataFrame(rows, "id long, x array<double>").select("id", array_to_vector("x").alias("features"))
    out = outliers.isolation_forest(d, n_trees=50, contamination=0.01)(d)
    top = [r.id for r in out.orderBy(F.desc("outlierScore")).limit(2).collect()]
    assert set(top) == {1000, 1001} and 2 <= out.where("predictedLabel = 1").count() <= 8
    assert sorted(map(str, out.collect())) == sorted(map(str, outliers.isolation_forest(d, n_trees=50, contamination=0.01)(d).collect()))


def test_boosting(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, size=(600, 3))
    y = np.where(x[:, 0] * x[:, 1] > 0, 1.0, 0.0)
    rows = [(i, v.tolist(), float(c), float(np.sin(v[0]) + v[1]), i % 40, int(v[2] > 0) + int(v[2] > 1), i % 4 == 0) for i, (v, c) in enumerate(zip(x, y))]
    d = spark.createDataFrame(rows, "id long, features array<double>, c double, r double, g long, m int, valid boolean").cache()
    model = boosting.fit_boosted(d, label_col="c", objective="binary", n_iterations=12, num_leaves=8, learning_rate=0.4)
    scored = model(d)
    assert scored.where(F.col("prediction") == F.col("c")).count() > 550
    gains = boosting.importances(model, "gain")
    assert gains[2] < gains[0] and sum(boosting.importances(model)) > 20
    model.save(str(tmp_path / "boost"))
    assert [r.prediction for r in Fitted.load(str(tmp_path / "boost"))(d).orderBy("id").collect()] == [r.prediction for r in scored.orderBy("id").collect()]
    explained = boosting.score_boosted(d.limit(5), **{**model.arguments, "leaf_col": "leaf", "shap_col": "shap"}).collect()
    for r in explained:
        assert sum(r.shap) == pytest.approx(r.rawPrediction[1], abs=1e-6) and len(r.leaf) == 12
    reg = boosting.fit_boosted(d, label_col="r", objective="regression", n_iterations=8, num_leaves=8, learning_rate=0.5)(d)
    assert reg.agg(F.avg((F.col("prediction") - F.col("r")) ** 2)).first()[0] < 0.1
    half = boosting.fit_boosted(d, label_col="r", objective="quantile", alpha=0.9, n_iterations=5, num_leaves=4, learning_rate=0.5)(d)
    assert 0.8 < half.where("r <= prediction").count() / 600 <= 1
    many = boosting.fit_boosted(d, label_col="m", objective="multiclass", n_iterations=3, num_leaves=4, learning_rate=0.5)(d)
    assert many.where(F.col("prediction") == F.col("m")).count() > 560 and len(many.first().probability) == 3
    stopped = boosting.fit_boosted(d, label_col="c", objective="binary", validation_col="valid", early_stopping=2, n_iterations=30, num_leaves=31, learning_rate=1.0, min_data_in_leaf=2, bagging_fraction=0.7, bagging_freq=1, feature_fraction=0.7)
    assert len(stopped.trees) < 30 and len(stopped.history) >= len(stopped.trees)
    ranked = boosting.fit_boosted(d, label_col="m", objective="lambdarank", group_col="g", n_iterations=4, num_leaves=6, learning_rate=0.3)(d)
    worst = [boosting.ndcg(np.array([r.prediction for r in rs]), np.array([float(r.m) for r in rs]), 5) for rs in _groups(ranked.collect())]
    assert np.mean(worst) > 0.95
    own = boosting.fit_boosted(d, label_col="r", objective="regression", n_iterations=3, num_leaves=4, learning_rate=1.0, fobj=lambda s, y: (s[:, 0] - y, np.ones(len(y))))(d)
    assert own.agg(F.corr("prediction", "r")).first()[0] > 0.7


def _groups(rows):
    by = {}
    for r in rows:
        by.setdefault(r.g, []).append(r)
    return by.values()


def test_image_operations():
    x = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (images.flip(images.flip(x, -1), -1) == x).all() and (images.flip(x, 1)[:, 0] == x[:, 3]).all() and (images.flip(x, 0)[0] == x[3]).all()
    assert (images.resize(x, 4, 4) == x).all() and images.resize(x, 2, 8).shape == (2, 8, 3)
    assert (images.crop(x, 1, 2, 2, 3) == x[2:4, 1:4]).all()
    assert images.color_format(x, "gray").shape == (4, 4, 1) and (images.color_format(x, "rgb") == x[:, :, ::-1]).all()
    flat = np.full((5, 5, 1), 70, np.uint8)
    assert (images.blur(flat, 3, 3) == 70).all() and (images.gaussian(flat, 3, 1.0) == 70).all()
    assert images.threshold(x, 20, 255).max() == 255 and images.threshold(x, 20, 0, "trunc").max() == 20
    for n in (1, 3, 4):
        y = images.channels(x, n)
        assert (images.decode_png(images.encode_png(y)) == y).all()
    assert (images.decode_netpbm(b"P6\n# note\n4 4\n255\n" + x[:, :, ::-1].tobytes()) == x).all()
    assert images.decode_bytes(b"nothing") is None and images.decode_bytes(None) is None
    labels = images.segments(np.concatenate([np.zeros((16, 16, 3), np.uint8), np.full((16, 16, 3), 255, np.uint8)], axis=1), 8.0)
    assert labels.shape == (16, 32) and not set(labels[:, :16].ravel()) & set(labels[:, 16:].ravel())


def test_image_columns_and_files(spark, tmp_path):
    x = np.random.default_rng(4).integers(0, 256, (6, 5, 3), dtype=np.uint8)
    d = spark.createDataFrame([("a.png", images.to_image(x, "a")), ("b.png", None)], f"path string, image {images.IMAGE}")
    assert files.write_images(d, str(tmp_path / "pics")) == 1
    back = files.read_images(spark, str(tmp_path / "pics")).collect()
    assert len(back) == 1 and (images.to_array(back[0].image.asDict()) == x).all()
    assert images.augment_images(d, up_down=True).count() == 6
    vector = images.unroll_images(d).where("image IS NOT NULL").first().features.toArray()
    assert (vector.reshape(3, 6, 5) == x.transpose(2, 0, 1)).all() and images.unroll_images(d).where("image IS NULL").first().features is None
    raw = files.read_binary_files(spark, str(tmp_path / "pics"))
    assert images.unroll_binary_images(raw, "bytes", "v", 2, 2, 1).first().v.size == 4
    import base64

    text = spark.createDataFrame([(base64.b64encode(images.encode_png(x)).decode(),), ("!!",)], "t string")
    assert [r.image is None for r in files.images_from_strings(text, "t").collect()] == [False, True]
    paths = spark.createDataFrame([(str(tmp_path / "pics" / "a.png"),), (str(tmp_path / "none"),), (None,)], "p string")
    assert [r.image is None for r in files.images_from_paths(paths, "p").collect()] == [False, True, True]
    net = lambda inputs: {"pool": inputs["x"].mean(axis=(2, 3))}
    out = inference.featurize_images(d, net, "x", "pool", 4, 4).collect()
    assert len(out) == 1 and len(out[0].features) == 3


def test_binary_files_and_archives(spark, tmp_path):
    import zipfile

    rows = spark.createDataFrame([(f"d/{i}.bin", bytes([i]) * i) for i in range(1, 21)], "path string, bytes binary")
    folder = str(tmp_path / "out")
    assert files.write_binary_files(rows, folder) == 20 and len(os.listdir(f"{folder}/d")) == 20
    with zipfile.ZipFile(f"{folder}/z.zip", "w") as z:
        z.writestr("in/one.txt", b"1")
        z.writestr("two.txt", b"22")
    got = {r.path.rsplit("/out/", 1)[1]: bytes(r.bytes) for r in files.read_binary_files(spark, folder, recursive=True).collect()}
    assert len(got) == 22 and got["z.zip/two.txt"] == b"22" and got["d/3.bin"] == b"\x03" * 3
    some = [r.path for r in files.read_binary_files(spark, folder, recursive=True, subsample=0.5, seed=3).collect()]
    assert 3 < len(some) < 19 and sorted(some) == sorted(r.path for r in files.read_binary_files(spark, folder, recursive=True, subsample=0.5, seed=3).collect())
    query = files.read_binary_files(spark, f"{folder}/d", stream=True, inspect_zip=False).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("seen").count() == 20
    with pytest.raises(Exception, match="leads out"):
        files.write_binary_files(spark.createDataFrame([("../x", b"1")], "path string, bytes binary"), folder)


@pytest.fixture
def service():
    """A server that echoes JSON, fails, waits and polls by path."""
    seen: dict = {"flaky": 0, "busy": 0, "poll": 0}

    class Handler(http.server.BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def say(self, code, body, **headers):
            data = json.dumps(body).encode()
            self.send_response(code)
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self):  # noqa: N802
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            body = json.loads(raw) if raw[:1] in (b"{", b"[") else raw.decode("latin-1")
            path = self.path.split("?")[0]
            if path == "/double":
                self.say(200, [{"y": r["x"] * 2} for r in body] if isinstance(body, list) else {"y": body["x"] * 2})
            elif path == "/flaky":
                seen["flaky"] += 1
                self.say(200 if seen["flaky"] % 3 == 0 else 500, {"y": 1})
            elif path == "/busy":
                seen["busy"] += 1
                self.say(200 if seen["busy"] > 4 else 429, {"y": 7}, Retry_After="0.01")
            elif path == "/bad":
                self.say(400, {"error": "no"})
            elif path.endswith("/sentiment"):
                doc = body["documents"][0]
                self.say(200, {"documents": [{"id": "0", "sentiment": "positive" if "good" in doc["text"] else "negative", "confidenceScores": {"positive": 1.0}}], "errors": []})
            elif path.endswith("/analyze"):
                self.say(202, {}, Operation_Location=f"http://localhost:{self.server.server_address[1]}/result")
            elif path.endswith("/entire/detect"):
                values = [p["value"] for p in body["series"]]
                self.say(200, {"isAnomaly": [v > 50 for v in values], "expectedValues": values, "upperMargins": values, "lowerMargins": values, "period": 0})
            else:
                self.say(404, {})

        def do_GET(self):  # noqa: N802
            seen["poll"] += 1
            done = seen["poll"] > 2
            self.say(200, {"status": "succeeded" if done else "running", "analyzeResult": {"readResults": [{"page": 1, "lines": [{"text": "hello"}, {"text": "there"}]}]}})

    server = http.server.ThreadingHTTPServer(("localhost", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://localhost:{server.server_address[1]}"
    server.shutdown()


def test_http_stages(spark, service):
    d = spark.createDataFrame([(i, float(i)) for i in range(7)], "id long, x double").coalesce(1)
    one = web.call_json(d, ["x"], service + "/double", "out", "y double", concurrency=3).orderBy("id").collect()
    assert [r.out.y for r in one] == [2.0 * i for i in range(7)] and all(r.errors is None for r in one)
    many = web.call_json(d, ["x"], service + "/double", "out", "struct<y:double>", batch_size=3).orderBy("id").collect()
    assert [r.out.y for r in many] == [2.0 * i for i in range(7)]
    bad = web.call_json(d.limit(1), ["x"], service + "/bad", "out", "y double").first()
    assert bad.out is None and bad.errors.status.code == 400 and "no" in bad.errors.response
    assert web.call_json(d.limit(1), ["x"], service + "/flaky", "out", "y double", pick=lambda o: o["y"]).first().out == 1.0
    assert web.call_json(d.limit(1), ["x"], service + "/busy", "out", "y double").first().out.y == 7.0
    assert web.call_json(d.limit(1), ["x"], "http://localhost:9/none", "out", "y double", handler=web.basic).first().out is None
    assert {r.code for r in web.write_rows(d, service + "/bad", batch_size=4).collect()} == {400}
    nothing = spark.createDataFrame([(None,)], "u string").select(web.request(F.col("u")).alias("q"))
    assert web.send(nothing, "q", "r").first().r is None


def test_services(spark, service):
    d = spark.createDataFrame([(1, "a good day"), (2, "bad"), (3, None)], "id long, t string")
    got = services.call_service(d, "sentiment", service, "s", text=F.col("t"), language="en", key="k").orderBy("id").collect()
    assert [r.s and r.s.documents[0].sentiment for r in got] == ["positive", "negative", None] and got[2].errors is None
    read = services.call_service(d.limit(1), "read", service, "r", image=F.lit("http://x/y.png"), handler=web.polling(delay=0.01))
    assert services.flatten_forms(read, "r", "text").first().text == "hello there"
    with pytest.raises(ValueError):
        services.call_service(d, "sentiment", service, "s")
    series = spark.createDataFrame([("g", f"2024-01-0{i}", float(i * 20)) for i in (3, 1, 2)], "g string, day string, v double").withColumn("t", F.to_timestamp("day"))
    out = services.detect_series_anomalies(series, service, "g", "t", "v", "a").orderBy("t").collect()
    assert [r.a.isAnomaly for r in out] == [False, False, True]


def test_serving(spark, tmp_path):
    requests = serving.start(spark, port=18888, path="/score", replyTimeout=30)
    parsed = serving.parse_request(requests, "x double", "full")
    replies = serving.make_reply(parsed.withColumn("out", F.struct((F.col("x") * 2).alias("y"))), "out")
    query = serving.reply_to(replies, str(tmp_path / "check"))
    try:
        answers = {}

        def ask(i, body):
            for _ in range(60):
                try:
                    asked = urllib.request.Request("http://localhost:18888/score", data=body, method="POST")
                    with urllib.request.urlopen(asked, timeout=40) as r:
                        answers[i] = (r.status, r.read())
                        return
                except urllib.error.HTTPError as e:
                    answers[i] = (e.code, e.read())
                    return
                except OSError:
                    time.sleep(0.5)

        threads = [threading.Thread(target=ask, args=(i, json.dumps({"x": i}).encode() if i < 4 else b"{broken")) for i in range(5)]
        for t in threads:
            t.start()
        for t in threads:
            t.join(80)
        assert {i: json.loads(answers[i][1])["y"] for i in range(4)} == {i: 2.0 * i for i in range(4)} and answers[4][0] == 400
    finally:
        query.stop()
    server = serving.RequestServer(port=0, timeout=0.2)
    server.rows = [("a",), ("b",), ("c",)]
    assert server.between(1, 3) == [("b",), ("c",)] == server.between(1, 3)
    server.forget(2)
    assert server.between(0, 3) == [("c",)] and server.end() == 3
    assert server.take("GET", "/", {}, b"")[0] == 504 and not server.reply("gone", {})
    server.close()


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    labels = [i % 3 for i in range(300)]
    tree, conditional = neighbors.BallTree(x, list(range(300)), leaf=10), neighbors.ConditionalBallTree(x, list(range(300)), labels, leaf=10)
    for q in x[:20]:
        s = x @ q
        assert [i for i, _ in tree.find(q, 5)] == np.argsort(-s)[:5].tolist()
        allowed = [i for i in np.argsort(-s) if labels[i] in (0, 2)][:4]
        assert [i for i, _, _ in conditional.find(q, 4, {0, 2})] == allowed
    d = spark.createDataFrame([(i, v.tolist(), f"v{i}", str(labels[i])) for i, v in enumerate(x)], "id long, features array<double>, name string, label string")
    got = neighbors.fit_knn(d, 3, value_col="name")(d.limit(4)).collect()
    for r in got:
        assert [n.value for n in r.neighbors] == [f"v{i}" for i in np.argsort(-(x @ x[r.id]))[:3]]
    assert neighbors.fit_ball_tree(d, value_col="name").find(x[0], 1)[0][0] == f"v{np.argmax(x @ x[0])}"
    many = neighbors.knn(d, d.withColumnRenamed("id", "query_id"), 2)
    assert many.count() == 600


def test_ranking_choice(spark):
    rows = [(u, i, 1.0) for u in range(40) for i in range(12) if (u + i) % 3 != 0]
    d = spark.createDataFrame(rows, "user long, item long, rating double")
    best, values, found = recommend.ranking_train_validation(d, [recommend.sar_recommender("user", "item", "rating", k, support=1) for k in ("jaccard", "cooccurrence")], "user", "item", "rating", k=3)
    assert best in (0, 1) and len(values) == 2 and found.columns == ["user", "rank", "item", "score"]
    fitted = recommend.recommendation_indexer(d, "user", "item")
    back = recommend.recover_ids(fitted(d), fitted)
    assert back.where(F.col("user") == "-1").count() == 0 and back.count() == len(rows)


def test_multiplied_and_joined_recommendations(spark, monkeypatch):
    d = spark.createDataFrame([(u, f"i{(u * 7 + i * i) % 13}", float(1 + i % 3)) for u in range(20) for i in range(6)], "user long, item string, rating double")
    affinity, similarity = recommend.sar_affinity(d, "user", "item", "rating"), recommend.sar_similarity(d, "user", "item", "cooccurrence", 1)
    for seen in (False, True):
        monkeypatch.setattr(recommend, "SMALL", 2_000_000)
        fast = sorted(map(str, recommend.sar_recommend(affinity, similarity, 4, drop_seen=seen).collect()))
        monkeypatch.setattr(recommend, "SMALL", 3)
        assert fast == sorted(map(str, recommend.sar_recommend(affinity, similarity, 4, drop_seen=seen).collect()))


def test_similarity_of_heavy_users(spark, monkeypatch):
    d = spark.createDataFrame([(u, i) for u in range(3) for i in range(30)], "u long, i long")
    plain = sorted(map(str, recommend.sar_similarity(d, "u", "i", support=1).collect()))
    monkeypatch.setattr(recommend, "USER_ITEMS", 4)
    assert sorted(map(str, recommend.sar_similarity(d, "u", "i", support=1).collect())) == plain


def test_stratified_placement(spark):
    d = spark.range(1600).select("id", F.when(F.col("id") % 100 == 0, "rare").otherwise(F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("label")).repartition(16)
    for mode in ("original", "mixed", "equal"):
        out = columns.stratified_repartition(d, "label", 8, mode)
        each = out.groupBy("label", F.spark_partition_id().alias("p")).count().collect()
        by = {}
        for r in each:
            by.setdefault(r.label, []).append(r["count"])
        assert all(len(v) == 8 and max(v) - min(v) <= 1 for v in by.values()), mode
        assert sum(map(sum, by.values())) == 1600 if mode == "original" else out.select("id").distinct().count() == 1600
    counts = {r.label: r["count"] for r in columns.stratified_repartition(d, "label", 8, "equal").groupBy("label").count().collect()}
    assert max(counts.values()) < 1.25 * min(counts.values())


def test_batches_and_timers(spark, people):
    one = columns.dynamic_minibatch(people.select("id").coalesce(1)).collect()
    assert len(one) == 1 and len(one[0].id) == 140
    assert [len(r.id) for r in columns.dynamic_minibatch(people.select("id").coalesce(1), 60).collect()] == [60, 60, 20]
    from pyspark.ml.feature import StringIndexer

    timer = columns.Timer(StringIndexer(inputCol="color", outputCol="i"))
    model = timer.fit(people)
    assert model.transform(people).count() == 140 and timer.seconds["fit"] > 0 and model.seconds["transform"] > 0


def test_curves_in_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(float(rng.integers(0, 50)), int(rng.integers(0, 2))) for _ in range(500)]
    d = spark.createDataFrame(rows, "score double, label int")
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))
    assert metrics.auc(d).first().auc == pytest.approx(want)
    points = sorted((r.fpr, r.tpr) for r in metrics.roc_points(d).collect())
    assert points[-1] == (1.0, 1.0) and all(a[1] <= b[1] for a, b in zip(points, points[1:]))


def test_access_graph(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in zip(rng.integers(0, 60, 50), rng.integers(0, 60, 50))]
    left, right = access.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(("a", a)), find(("b", b))
        parent[y] = x
    groups = {}
    for node in list(parent):
        groups.setdefault(find(node), []).append(node)
    want = {n[1]: min(m[1] for m in ms if m[0] == "a") for ms in groups.values() for n in ms if n[0] == "a"}
    assert {r.a: r.component for r in left.collect()} == want
    seen = spark.createDataFrame([("t", i, j) for i in range(6) for j in range(6) if (i + j) % 2], "t string, u int, r int")
    drawn = access.complement_access(seen, "t", "u", "r", 3).collect()
    assert drawn and len(set(drawn)) == len(drawn) and all((r.u + r.r) % 2 == 0 and 0 <= r.u < 6 and 0 <= r.r < 6 for r in drawn)


def test_access_anomaly_tells_departments_apart(spark):
    a = access_data.clustered_accesses(spark, 2, 12, 16, share=0.6)
    model = access.fit_access_anomaly(a, rank=4, max_iter=8)
    assert model(a.limit(20)).where("anomaly_score <> 0").count() == 0
    strange = model(access_data.cross_accesses(a, 30)).agg(F.avg("anomaly_score")).first()[0]
    assert strange > 0.5 or math.isinf(strange)


def test_passages(spark):
    d = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, ""), (3, None), (4, "one two")], "id long, t string")
    got = sorted((r.id, r.place, r.passage) for r in tables.passages(d, "t", 10, 8).collect())
    made = sorted((r.id, i, p) for r in d.collect() for i, p in tables.Passages().eval(r.t, 10, 8))
    assert got == made and [g[1] for g in got if g[0] == 1] == [0, 1, 2]
