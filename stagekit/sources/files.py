"""Whole files and images as rows: reading with subsampling and archives, paths in columns, one file a row written."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagekit.operators.images import decode, encode_png, to_array

FILE = "path string, bytes binary"


def read_binary_files(spark: SparkSession, path: str, recursive: bool = False, subsample: float = 1.0, inspect_zip: bool = True, seed: int = 0, stream: bool = False, pattern: str | None = None) -> DataFrame:
    """(path, bytes) of the files under ``path``; members of ``.zip`` files are rows of their own.

    ``subsample`` keeps a file, or a member, by a hash of its path, so that a repeated read gives the same
    ones; the files left out are not read where the source can tell. ``stream`` reads files as they come.
    """
    reader = spark.readStream if stream else spark.read
    reader = reader.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    found = reader.load(path).select("path", F.col("content").alias("bytes"))
    keep = _drawn(subsample, seed)
    if not inspect_zip:
        return found.where(keep)
    zipped = F.lower("path").endswith(".zip")

    def members(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not name.lower().endswith(".zip"):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["path", "bytes"])
                    continue
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for info in archive.infolist():
                        if not info.is_dir():  # one member at a time: an archive may hold more than memory
                            yield pa.RecordBatch.from_arrays([pa.array([f"{name}/{info.filename}"]), pa.array([archive.read(info)], pa.binary())], names=["path", "bytes"])

    return found.where(zipped | keep).mapInArrow(members, FILE).where(keep)


def _drawn(subsample: float, seed: int):
    if subsample >= 1.0:
        return F.lit(True)
    return F.pmod(F.xxhash64("path", F.lit(seed)), F.lit(1 << 30)) < int(subsample * (1 << 30))


def read_from_paths(df: DataFrame, path_col: str, bytes_col: str = "bytes", concurrency: int = 8, timeout: float = 60.0) -> DataFrame:
    """The bytes of the file that each row names, several at once in a task, in order; null where none can be read.

    Paths are those that an executor sees: of a mounted file system, or ``http(s)`` addresses.
    """
    import urllib.request

    def fetch(name: str | None) -> bytes | None:
        if name is None:
            return None
        try:
            if name.startswith(("http://", "https://")):
                with urllib.request.urlopen(name, timeout=timeout) as found:
                    return found.read()
            with open(name.removeprefix("file://").removeprefix("file:"), "rb") as f:
                return f.read()
        except OSError:
            return None

    def run(paths: pa.Array) -> pa.Array:
        with ThreadPoolExecutor(concurrency) as pool:
            return pa.array(list(pool.map(fetch, paths.to_pylist())), pa.binary())

    return df.withColumn(bytes_col, F.arrow_udf(run, "binary")(F.col(f"`{path_col}`")))


def write_binary_files(df: DataFrame, folder: str, bytes_col: str = "bytes", path_col: str = "path") -> int:
    """One file a row in ``folder``, a file system that all executors see, named by the path column; how many.

    A file appears whole or not at all, and a repeated task writes the same ones again.
    """

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = os.path.join(folder, name.lstrip("/"))
                if not os.path.realpath(target).startswith(os.path.realpath(folder) + os.sep):
                    raise ValueError(f"{name} leads out of the folder")
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(data or b"")
                os.replace(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = df.select(F.col(f"`{path_col}`").alias("path"), F.col(f"`{bytes_col}`").alias("bytes"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_images(spark: SparkSession, path: str, recursive: bool = False, subsample: float = 1.0, inspect_zip: bool = True, seed: int = 0, drop_invalid: bool = False) -> DataFrame:
    """(path, image): PNG, BMP, PGM and PPM files, also in archives; the image is null where a file is none."""
    files = read_binary_files(spark, path, recursive, subsample, inspect_zip, seed)
    out = files.select("path", decode(F.col("bytes"), F.col("path")).alias("image"))
    return out.where("image IS NOT NULL") if drop_invalid else out


def images_from_paths(df: DataFrame, path_col: str, image_col: str = "image", concurrency: int = 8) -> DataFrame:
    read = read_from_paths(df, path_col, image_col, concurrency)
    return read.withColumn(image_col, decode(F.col(image_col), F.col(f"`{path_col}`")))


def images_from_bytes(df: DataFrame, bytes_col: str, image_col: str = "image") -> DataFrame:
    return df.withColumn(image_col, decode(F.col(f"`{bytes_col}`")))


def images_from_strings(df: DataFrame, text_col: str, image_col: str = "image") -> DataFrame:
    """Images of base64 texts; null where a text is none."""
    return df.withColumn(image_col, decode(F.try_to_binary(F.col(f"`{text_col}`"), F.lit("base64"))))


def write_images(df: DataFrame, folder: str, image_col: str = "image", path_col: str = "path") -> int:
    """PNG files, one a row; null images are left out."""

    def run(images: pa.Array) -> pa.Array:
        return pa.array([None if i is None else encode_png(to_array(i)) for i in images.to_pylist()], pa.binary())

    rows = df.where(F.col(f"`{image_col}`").isNotNull())
    return write_binary_files(rows.select(F.col(f"`{path_col}`").alias("path"), F.arrow_udf(run, "binary")(F.col(f"`{image_col}`")).alias("bytes")), folder)
