"""Corpus pipeline: documents through the training-data operators, stage by stage.

Each stage takes the documents that its predecessor kept, as a table in the shared folder, and all but
the last return the columns of ``documents``; other columns of its input are left behind. An empty table
gives an empty one, and repeated rows are rows of their own except where copies go.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagekit.llm.langid import fit, keep_identified
from stagekit.llm.mixing import pareto_mix
from stagekit.llm.neardup import drop_near_duplicates
from stagekit.llm.pieces import encode
from stagekit.llm.secret_scan import redact_secrets
from stagekit.llm.text import id_fold, n_words
from stagekit.plans.session import ship_package, write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "piece_bpe_32k.model"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text fits a language learned from four fifths of the labelled ones; null texts, and texts without a letter, go."""
    ship_package(spark)
    return keep_identified(docs.select(*COLUMNS), fit(docs.where(id_fold(F.col("doc_id")) != 0)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; one without words is like no other."""
    ship_package(spark)
    return drop_near_duplicates(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text replaced and ``n_chars`` counted again; null texts stay null."""
    ship_package(spark)
    redacted = redact_secrets(docs.select("doc_id", "text", "lang", "source", F.col("n_chars").alias("n_chars")))
    return redacted.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one taken no time goes, and so does one without words in a source without any."""
    ship_package(spark)
    sized = docs.select(*COLUMNS, n_words(F.col("text")).alias("mix_size"))
    mixed = pareto_mix(sized, ["doc_id"], size_col="mix_size", seed=7).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, ids and whether decoding gives the text back; null and empty texts have no pieces."""
    ship_package(spark)
    path = public_tokenizers.path(TOKENIZER)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", F.crc32(text.cast("binary")).alias("text_crc32"), "text")
    decoded = encode(rows, path, decoded="decoded")
    return decoded.select("doc_id", "lang", "source", "n_pieces", "ids", (F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc32")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]
#: Language models, similarity groups and guess costs are not SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage for the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
