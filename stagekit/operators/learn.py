"""Automatic featurizing, training, model choice and tuning around ``pyspark.ml`` learners."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagekit.base import Fitted
from stagekit.operators import metrics, profile
from stagekit.operators.text import featurize_text
from stagekit.plans.session import fresh

#: Slots for hashed text: learners with a weight a slot, and trees or nets.
WIDE, NARROW = 1 << 18, 1 << 12
TREES = ("DecisionTreeClassifier", "RandomForestClassifier", "GBTClassifier", "DecisionTreeRegressor", "RandomForestRegressor", "GBTRegressor", "MultilayerPerceptronClassifier")
NUMBERS = ("byte", "short", "integer", "long", "float", "decimal")


def _nominal(df: DataFrame, c: str) -> bool:
    meta = df.schema[c].metadata
    return "levels" in meta or meta.get("ml_attr", {}).get("type") == "nominal"


def _time_slots(c: str, kind: str) -> Column:
    """Milliseconds, year, day of week from Monday as 1, month, day; hour, minute, second of a timestamp."""
    x = F.col(f"`{c}`")
    millis = F.unix_millis(x.cast("timestamp"))
    slots = [millis, F.year(x), F.weekday(x) + 1, F.month(x), F.dayofmonth(x)]
    if kind != "date":
        slots += [F.hour(x), F.minute(x), F.second(x)]
    # a row without the time is dropped with the other invalid ones
    return F.when(x.isNotNull(), array_to_vector(F.array(*[s.cast("double") for s in slots])))


def featurize(df: DataFrame, input_cols: list[str], output_col: str = "features", one_hot: bool = True, impute: bool = True, num_features: int = WIDE) -> Fitted:
    """All input columns to one vector column.

    Nominal columns (indexed, with levels in their metadata) become one-hot slots, other numbers doubles
    with the mean for what is missing, texts hashed and weighted terms less the slots that are empty in
    all rows, times their parts; vectors stay. Rows that still hold a null or NaN are dropped.
    """
    parts: list[dict] = []
    tables, models = {}, {}
    taken = fresh([*df.columns, output_col], *[f"f{i}" for i in range(len(input_cols))])
    for c, name in zip(input_cols, taken):
        kind = df.schema[c].dataType.typeName()
        part = {"input": c, "output": name}
        if one_hot and _nominal(df, c):
            part["how"] = "one_hot"
            models[f"encode_{name}"] = OneHotEncoder(inputCols=[c], outputCols=[name], handleInvalid="keep").fit(df)
        elif kind in NUMBERS or kind in ("double", "boolean"):
            part["how"] = "number"
            if impute and kind != "boolean":
                part["fill"] = df.agg(F.avg(F.when(~profile._is_nan(df, c), F.col(f"`{c}`")).cast("double"))).first()[0]
        elif kind == "string":
            part["how"] = "text"
            filled = df.select(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(name))
            text = featurize_text(filled, name, name + "_text", num_features)
            models[f"text_{name}"] = text.models["pipeline"]
            part["indices"] = profile.count_selector(text(filled), name + "_text", name).arguments["indices"]
        elif kind in ("timestamp", "timestamp_ntz", "date"):
            part.update(how="time", kind=kind)
        elif kind == "vector":
            part["how"] = "vector"
        else:
            raise ValueError(f"{c}: no features from {kind}")
        parts.append(part)
    return Fitted(apply_features, tables, models, parts=parts, output_col=output_col)


def apply_features(df: DataFrame, parts: list[dict], output_col: str, **models) -> DataFrame:
    names = df.columns
    inputs = []
    for p in parts:
        c, name = p["input"], p["output"]
        if p["how"] == "one_hot":
            df = models[f"encode_{name}"].transform(df)
        elif p["how"] == "number":
            x = F.col(f"`{c}`").cast("double")
            df = df.withColumn(name, x if p.get("fill") is None else F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(p["fill"])))
        elif p["how"] == "text":
            rest = df.columns
            df = df.withColumn(name, F.coalesce(F.col(f"`{c}`"), F.lit("")))
            df = models[f"text_{name}"].transform(df)
            df = profile.select_slots(df.withColumnRenamed(name, name + "_raw"), name + "_text", name, p["indices"]).select(*rest, name)
        elif p["how"] == "time":
            df = df.withColumn(name, _time_slots(c, p["kind"]))
        else:
            df = df.withColumn(name, F.col(f"`{c}`"))
        inputs.append(name)
    df = VectorAssembler(inputCols=inputs, outputCol=output_col, handleInvalid="skip").transform(df)
    return df.select(*names, output_col)


def _is(learner, *names: str) -> bool:
    return type(learner).__name__ in names


def train_classifier(df: DataFrame, learner: Estimator, label_col: str, input_cols: list[str] | None = None, reindex: bool = True, num_features: int | None = None) -> Fitted:
    """A classifier over automatically made features.

    Rows without a label go. Labels of any type are indexed in ascending order; scores carry the levels.
    A logistic regression with more than two levels is fitted one against the rest; boosted trees take
    two levels only; the input layer of a perceptron is set to the number of features. Scoring adds
    ``scores``, ``scored_probabilities`` (if the learner gives any) and ``scored_labels``.
    """
    from pyspark.ml.classification import OneVsRest

    index, features = fresh(df.columns, "label_index", "features")
    df = df.where(F.col(f"`{label_col}`").isNotNull())
    labels = profile.value_indexer(df, label_col, index) if reindex else None
    indexed = labels(df) if labels else df.withColumn(index, F.col(f"`{label_col}`").cast("double"))
    levels = labels.arguments["levels"] if labels else None
    n_levels = len(levels) if labels else df.select(label_col).distinct().count()
    flat = _is(learner, *TREES)
    inputs = [c for c in input_cols or df.columns if c != label_col]
    made = featurize(indexed, inputs, features, one_hot=not flat, num_features=num_features or (NARROW if flat else WIDE))
    ready = made(indexed).withColumn(index, F.col(index).cast("double"))
    if _is(learner, "LogisticRegression") and n_levels > 2:
        learner = OneVsRest(classifier=learner)
    if _is(learner, "GBTClassifier") and n_levels > 2:
        raise ValueError("boosted trees classify two levels only")
    learner = learner.copy()
    learner._set(labelCol=index, featuresCol=features)
    if _is(learner, "MultilayerPerceptronClassifier"):
        learner.setLayers([len(ready.select(features).first()[0]), *learner.getLayers()[1:-1], n_levels])
    model = learner.fit(ready)
    return Fitted(
        score_classes, made.tables, {"learner": model, **made.models}, parts=made.parts, features_col=features, levels=levels,
        level_type=labels.arguments["kind"] if labels else None,
    )


def score_classes(df: DataFrame, learner: Model, parts: list[dict], features_col: str, levels: list | None, level_type: str | None, **models) -> DataFrame:
    out = learner.transform(apply_features(df, parts, features_col, **models))
    raw, probability, prediction = (learner.getOrDefault(learner.getParam(p)) if learner.hasParam(p) else p for p in ("rawPredictionCol", "probabilityCol", "predictionCol"))
    if raw in out.columns:
        out = out.withColumnRenamed(raw, "scores")
    if probability in out.columns:
        out = out.withColumnRenamed(probability, "scored_probabilities")
    if levels is not None:
        at = F.get(F.array(*[F.lit(v).cast(level_type) for v in levels]), F.col(prediction).cast("int"))
        out = out.withColumn("scored_labels", at).withMetadata("scored_labels", {"levels": levels, "level_type": level_type, "has_null": False})
        return out.drop(features_col, prediction)
    return out.withColumnRenamed(prediction, "scored_labels").drop(features_col)


def train_regressor(df: DataFrame, learner: Estimator, label_col: str, input_cols: list[str] | None = None, num_features: int | None = None) -> Fitted:
    """A regressor over automatically made features; rows without a label go, a text label is an error. Scoring adds ``scores``."""
    if df.schema[label_col].dataType.typeName() == "string":
        raise ValueError(f"{label_col}: a text is no label of a regression")
    label, features = fresh(df.columns, "label", "features")
    df = df.where(F.col(f"`{label_col}`").isNotNull())
    flat = _is(learner, *TREES)
    made = featurize(df, [c for c in input_cols or df.columns if c != label_col], features, one_hot=not flat, num_features=num_features or (NARROW if flat else WIDE))
    learner = learner.copy()
    learner._set(labelCol=label, featuresCol=features)
    model = learner.fit(made(df).withColumn(label, F.col(f"`{label_col}`").cast("double")))
    return Fitted(score_values, made.tables, {"learner": model, **made.models}, parts=made.parts, features_col=features)


def score_values(df: DataFrame, learner: Model, parts: list[dict], features_col: str, **models) -> DataFrame:
    out = learner.transform(apply_features(df, parts, features_col, **models))
    return out.withColumnRenamed(learner.getPredictionCol(), "scores").drop(features_col)


# Model choice -------------------------------------------------------------------------------------

#: Metric to whether more is better.
METRICS = {
    "accuracy": True, "precision": True, "recall": True, "AUC": True, "average_accuracy": True, "macro_averaged_precision": True, "macro_averaged_recall": True,
    "mean_squared_error": False, "root_mean_squared_error": False, "mean_absolute_error": False, "R^2": True,
}


def evaluate(scored: DataFrame, label_col: str, kind: str | None = None) -> dict[str, float]:
    """Statistics of a scored table: of classes where it has ``scored_labels``, else of values in ``scores``."""
    kind = kind or ("classification" if "scored_labels" in scored.columns else "regression")
    if kind == "regression":
        row = metrics.regression_statistics(scored, label_col, "scores").first().asDict()
        return {"R^2": row.pop("r2"), **row}
    meta = scored.schema["scored_labels"].metadata
    levels, level_type = meta.get("levels"), meta.get("level_type")
    seen = scored.select(F.col(f"`{label_col}`").alias("label"), F.col("scored_labels").alias("prediction"), *(["scored_probabilities"] if "scored_probabilities" in scored.columns else []))
    if levels is None:
        levels, level_type = sorted(r[0] for r in seen.select("label").distinct().limit(10_000).collect()), seen.schema["label"].dataType.simpleString()
    if len(levels) > 2:
        return metrics.multiclass_statistics(seen).first().asDict()
    one = F.lit(levels[-1]).cast(level_type)
    binary = seen.withColumns({"label": (F.col("label") == one).cast("int"), "prediction": (F.col("prediction") == one).cast("int")})
    row = metrics.binary_statistics(binary).first().asDict()
    out = {k: row[k] for k in ("accuracy", "precision", "recall")}
    if "scored_probabilities" in binary.columns:
        out["AUC"] = metrics.auc(binary.withColumn("score", F.get(vector_to_array("scored_probabilities"), len(levels) - 1))).first()[0]
    return out


class BestModel:
    """The chosen model, what it reached, and the same of all the others."""

    def __init__(self, model: Fitted, value: float, metric: str, all_metrics: list[dict], scored: DataFrame | None = None, label_col: str | None = None):
        self.model, self.value, self.metric, self.all_metrics, self.scored, self.label_col = model, value, metric, all_metrics, scored, label_col

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model(df)

    __call__ = transform

    def roc(self) -> DataFrame:
        """(score, tpr, fpr) of the scored table, for two levels."""
        levels = self.scored.schema["scored_labels"].metadata["levels"]
        y = (F.col(f"`{self.label_col}`").cast("string") == F.lit(str(levels[-1]))).cast("int")
        return metrics.roc_points(self.scored.select(y.alias("label"), F.get(vector_to_array("scored_probabilities"), len(levels) - 1).alias("score")))

    def save(self, path: str) -> None:
        self.model.save(path)


def _better(metric: str) -> Callable:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    return max if METRICS[metric] else min


def find_best(models: list[Fitted], df: DataFrame, label_col: str, metric: str) -> BestModel:
    """The model with the best metric over ``df``, the first of equal ones."""
    choose = _better(metric)
    scored = [m(df) for m in models]
    found = [evaluate(s, label_col) for s in scored]
    best = choose(range(len(models)), key=lambda i: found[i][metric])
    return BestModel(models[best], found[best][metric], metric, found, scored[best], label_col)


class Discrete:
    """One of the values."""

    def __init__(self, *values):
        self.values = list(values)

    def draw(self, rng: random.Random):
        return rng.choice(self.values)


class Between:
    """A number from ``low`` to ``high``, whole if both are; with ``log`` evenly over its logarithm."""

    def __init__(self, low, high, log: bool = False):
        self.low, self.high, self.log = low, high, log

    def draw(self, rng: random.Random):
        import math

        if self.log:
            x = math.exp(rng.uniform(math.log(self.low), math.log(self.high)))
        elif isinstance(self.low, int) and isinstance(self.high, int):
            return rng.randint(self.low, self.high)
        else:
            x = rng.uniform(self.low, self.high)
        return round(x) if isinstance(self.low, int) and isinstance(self.high, int) else x


def grid_space(space: dict[str, Discrete]) -> list[dict]:
    """Every combination of the values, in order."""
    names = list(space)
    return [dict(zip(names, values)) for values in itertools.product(*[space[n].values for n in names])]


def random_space(space: dict, seed: int = 0) -> Iterator[dict]:
    """Combinations drawn without end; the same seed draws the same ones."""
    rng = random.Random(seed)
    while True:
        yield {name: dist.draw(rng) for name, dist in space.items()}


def default_space(learner: Estimator) -> dict:
    """Search ranges for the usual learners."""
    trees = {"maxBins": Between(16, 32), "maxDepth": Between(2, 5), "minInfoGain": Between(0.0, 0.5), "minInstancesPerNode": Between(1, 100)}
    spaces = {
        "LogisticRegression": {"regParam": Between(0.001, 1.0, log=True), "elasticNetParam": Between(0.0, 1.0), "maxIter": Between(5, 10)},
        "LinearRegression": {"regParam": Between(0.001, 1.0, log=True), "elasticNetParam": Between(0.0, 1.0)},
        "DecisionTree": trees,
        "GBT": {**trees, "maxIter": Between(10, 30), "stepSize": Between(0.05, 0.5)},
        "RandomForest": {**trees, "numTrees": Between(10, 30), "subsamplingRate": Between(0.5, 1.0)},
        "MultilayerPerceptron": {"blockSize": Between(64, 128), "maxIter": Between(50, 100), "tol": Between(1e-6, 1e-4, log=True)},
        "NaiveBayes": {"smoothing": Between(0.1, 1.0)},
    }
    for name, space in spaces.items():
        if type(learner).__name__.startswith(name):
            return space
    raise ValueError(f"no search ranges for {type(learner).__name__}")


def folds(df: DataFrame, k: int, seed: int = 0) -> list[tuple[DataFrame, DataFrame]]:
    """``k`` pairs of (training, held-out) rows; a hash of the row decides, so a lost task gives the same rows."""
    fold = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "vector", "struct"))], F.lit(seed)), F.lit(k))
    return [(df.where(fold != i), df.where(fold == i)) for i in range(k)]


def tune(
    df: DataFrame, learners: list[Estimator], spaces: list[dict] | None, label_col: str, metric: str, n_folds: int = 3, n_runs: int = 4, parallelism: int = 4, seed: int = 0,
    input_cols: list[str] | None = None, kind: str = "classification",
) -> BestModel:
    """Random search: each run takes the next learner with parameters drawn from its space.

    The mean of the metric over the folds decides; the best run is fitted again on all rows. Runs go
    side by side, ``parallelism`` at a time, as jobs of one session.
    """
    choose = _better(metric)
    draws = [random_space(space, seed + i) for i, space in enumerate(spaces or [default_space(x) for x in learners])]
    train = train_classifier if kind == "classification" else train_regressor
    runs = [(learners[i % len(learners)], next(draws[i % len(learners)])) for i in range(n_runs)]
    df = df.persist()
    parts = folds(df, n_folds, seed)

    def fitted(run, rows: DataFrame) -> Fitted:
        learner, chosen = run
        return train(rows, learner.copy({learner.getParam(k): v for k, v in chosen.items()}), label_col, input_cols)

    def value(run) -> float:
        found = [evaluate(fitted(run, rows)(held), label_col)[metric] for rows, held in parts]
        return sum(found) / len(found)

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            values = list(pool.map(value, runs))
        best = choose(range(len(runs)), key=lambda i: values[i])
        about = [{"learner": type(run[0]).__name__, **run[1], metric: x} for run, x in zip(runs, values)]
        return BestModel(fitted(runs[best], df), values[best], metric, about)
    finally:
        df.unpersist()


def as_pipeline(*fitted: Fitted) -> PipelineModel:
    """Fitted stages one after another as a model that ``pyspark.ml`` saves and loads."""
    from stagekit.base import FittedStage

    return PipelineModel([FittedStage(f) for f in fitted])
