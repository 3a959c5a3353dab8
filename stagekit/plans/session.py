"""Session helpers shared by every query: worker imports and lineage cuts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

PACKAGE_PARENT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows of an Arrow batch, where the session does not say: texts are long, and batches of Spark's default of
#: 10,000 of them keep hundreds of megabytes beside the heap of an executor.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where only the driver has it on its path, and take small batches.

    On a cluster the package is installed or sent with ``--py-files``; this only adds the
    driver's own directory to the workers' search path, which does no harm where it is missing.
    A batch size that the session sets itself stays.
    """
    key, rows = BATCH_ROWS
    if key not in spark.conf.getAll:
        spark.conf.set(key, rows)
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if PACKAGE_PARENT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (PACKAGE_PARENT, path) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` named.

    Only a local session that names none gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return "/tmp/checkpoints"


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that none of ``columns`` has (compared without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        base, i = name, 0
        while name.lower() in taken:
            i += 1
            name = f"{base}_{i}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *outputs: str) -> DataFrame:
    """``df`` less the columns that an operator is about to produce."""
    names = {o.lower() for o in outputs}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in names])
