"""Trained networks over columns: any function of arrays, or an ONNX file, batch by batch in the workers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekit.operators.columns import vector_values
from stagekit.operators.images import transform_images, unroll_images
from stagekit.plans.session import fresh

Network = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]
_sessions: dict[int, object] = {}


def onnx_network(data: bytes, outputs: list[str] | None = None) -> Network:
    """The network of an ONNX file, built once a worker."""

    def run(inputs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        import onnxruntime

        key = hash(data)
        if key not in _sessions:
            _sessions.clear()
            _sessions[key] = onnxruntime.InferenceSession(data, providers=["CPUExecutionProvider"])
        session = _sessions[key]
        names = outputs or [o.name for o in session.get_outputs()]
        kinds = {i.name: np.float64 if "double" in i.type else np.int64 if "int64" in i.type else np.float32 for i in session.get_inputs()}
        return dict(zip(names, session.run(names, {k: v.astype(kinds.get(k, np.float32)) for k, v in inputs.items()})))

    return run


def apply_network(
    df: DataFrame, network: Network | str, feed: dict[str, str], fetch: dict[str, str], batch_size: int = 64, shapes: dict[str, tuple[int, ...]] | None = None, vectors: bool = True,
) -> DataFrame:
    """``df`` with the network's outputs: ``feed`` maps its inputs to columns, ``fetch`` output columns to its outputs.

    Inputs are numbers, arrays or vectors; ``shapes`` gives an input's shape without the batch. A path
    names an ONNX file, which is read on the driver and broadcast. Rows with a null input have null
    outputs. Outputs are vectors, or arrays of doubles.
    """
    if isinstance(network, str):
        with open(network, "rb") as f:
            data = df.sparkSession.sparkContext.broadcast(f.read())
        wanted = list(fetch.values())
        network = lambda inputs: onnx_network(data.value, wanted)(inputs)
    kinds = {c: df.schema[c].dataType.typeName() for c in feed.values()}
    columns = [vector_values(F.col(f"`{c}`")) if kinds[c] == "vector" else F.col(f"`{c}`") for c in feed.values()]
    names, outputs, shapes = list(feed), list(fetch), shapes or {}

    def run(*parts: pa.Array) -> pa.Array:
        rows = list(zip(*[p.to_pylist() for p in parts]))
        fine = [i for i, r in enumerate(rows) if None not in r]
        found: list = [None] * len(rows)
        for at in range(0, len(fine), batch_size):
            here = fine[at : at + batch_size]
            inputs = {n: np.array([rows[i][k] for i in here], float).reshape(len(here), *shapes.get(n, (-1,))) for k, n in enumerate(names)}
            got = network(inputs)
            for j, i in enumerate(here):
                found[i] = {o: np.asarray(got[fetch[o]])[j].astype(float).ravel().tolist() for o in outputs}
        return pa.array(found, pa.struct([(o, pa.list_(pa.float64())) for o in outputs]))

    (name,) = fresh([*df.columns, *outputs], "network")
    kind = "struct<" + ",".join(f"`{o}`:array<double>" for o in outputs) + ">"
    out = df.withColumn(name, F.arrow_udf(run, kind)(*columns))
    for o in outputs:
        value = F.col(name)[o]
        out = out.withColumn(o, F.when(value.isNotNull(), array_to_vector(value)) if vectors else value)
    return out.drop(name)


def featurize_images(
    df: DataFrame, network: Network | str, input_name: str, output_name: str, height: int, width: int, n_channels: int = 3, input_col: str = "image", output_col: str = "features",
    scale: float = 1.0, drop_null: bool = True, batch_size: int = 64,
) -> DataFrame:
    """Images brought to one size, unrolled by channel and put through a network whose last layers are cut off."""
    (name,) = fresh([*df.columns, output_col], "pixels")
    sized = transform_images(df, [{"step": "resize", "height": height, "width": width}, {"step": "channels", "n": n_channels}], input_col, name)
    ready = unroll_images(sized, name, name)
    ready = ready.withColumn(name, F.transform(vector_values(F.col(name)), lambda v: v * scale))
    out = apply_network(ready, network, {input_name: name}, {output_col: output_name}, batch_size, {input_name: (n_channels, height, width)}).drop(name)
    return out.where(F.col(output_col).isNotNull()) if drop_null else out
