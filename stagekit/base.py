"""Wraps DataFrame functions as ``pyspark.ml`` stages that can be saved and loaded."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession


def import_path(fn: Callable) -> str:
    return f"{fn.__module__}:{fn.__qualname__}"


def load_path(path: str) -> Callable:
    module, _, name = path.partition(":")
    found = importlib.import_module(module)
    for part in name.split("."):
        found = getattr(found, part)
    return found


class _Call(Params):
    """A function by its import path, with keyword arguments as JSON."""

    path = Param(Params._dummy(), "path", "import path of the function", TypeConverters.toString)
    arguments = Param(Params._dummy(), "arguments", "keyword arguments, JSON", TypeConverters.toString)

    def __init__(self, fn: Callable | None = None, **arguments):
        super().__init__()
        if fn is not None:
            self._set(path=import_path(fn), arguments=json.dumps(arguments))

    def call(self, df: DataFrame):
        return load_path(self.getOrDefault(self.path))(df, **json.loads(self.getOrDefault(self.arguments)))


class FunctionStage(_Call, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``FunctionStage(select_columns, cols=["a"])`` as a stage of a pipeline."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.call(df)


class Fitted:
    """What a fitting function returns: ``apply`` with everything that it learned, callable on a DataFrame.

    ``apply(df, **tables, **models, **arguments)`` is a function at the top of its module. Arguments are
    saved as JSON, tables (DataFrames) as Parquet, models by their own writers; tables and models are
    also attributes.
    """

    def __init__(self, apply: Callable, tables: dict[str, DataFrame] | None = None, models: dict | None = None, **arguments):
        self.apply, self.tables, self.models, self.arguments = apply, tables or {}, models or {}, arguments

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df, **self.tables, **self.models, **self.arguments)

    transform = __call__

    def __getattr__(self, name: str):
        for found in ("tables", "models", "arguments"):
            if name in self.__dict__.get(found, {}):
                return self.__dict__[found][name]
        raise AttributeError(name)

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        about = {"apply": import_path(self.apply), "arguments": self.arguments, "tables": list(self.tables), "models": list(self.models)}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
        for name, table in self.tables.items():
            table.write.parquet(f"{path}/tables/{name}")
        for name, model in self.models.items():
            model.write().save(f"{path}/models/{name}")

    @classmethod
    def load(cls, path: str) -> Fitted:
        spark = SparkSession.getActiveSession()
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        tables = {name: spark.read.parquet(f"{path}/tables/{name}") for name in about["tables"]}
        models = {name: DefaultParamsReader.loadParamsInstance(f"{path}/models/{name}", spark) for name in about["models"]}
        return cls(load_path(about["apply"]), tables, models, **about["arguments"])


class _FittedWriter(MLWriter):
    def __init__(self, stage: FittedStage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.fitted.save(f"{path}/fitted")


class _FittedReader(MLReader):
    def load(self, path: str) -> FittedStage:
        stage = FittedStage(Fitted.load(f"{path}/fitted"))
        stage._resetUid(DefaultParamsReader.loadMetadata(path, self.sparkSession)["uid"])
        return stage


class FittedStage(Model, MLWritable, MLReadable):
    """A ``Fitted`` as a model of a pipeline, saved and loaded with it."""

    def __init__(self, fitted: Fitted | None = None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.fitted(df)

    def write(self) -> MLWriter:
        return _FittedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FittedReader()


class FunctionEstimator(_Call, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """``FunctionEstimator(clean_missing, cols=["x"])``: fitting calls the function, which returns a ``Fitted``."""

    def _fit(self, df: DataFrame) -> FittedStage:
        return FittedStage(self.call(df))
