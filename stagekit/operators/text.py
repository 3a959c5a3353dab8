"""Text stages: features, n-grams, pages, replacement, normal forms."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stagekit.base import Fitted


def tokenize(df: DataFrame, input_col: str, output_col: str, pattern: str = r"\s+", gaps: bool = True, lower: bool = True, min_length: int = 0) -> DataFrame:
    """Tokens by a pattern of gaps or of tokens, inside code generation."""
    x = F.lower(input_col) if lower else F.col(input_col)
    found = F.split(x, pattern) if gaps else F.regexp_extract_all(x, F.lit(f"({pattern})"))
    return df.withColumn(output_col, F.filter(found, lambda t: F.char_length(t) >= max(1, min_length)))


def featurize_text(df: DataFrame, input_col: str, output_col: str, num_features: int = 1 << 18, stop_words: list[str] | None = None, n_gram: int | None = None, binary: bool = False, use_idf: bool = True, min_doc_freq: int = 1, pattern: str = r"\s+") -> Fitted:
    """Tokenizer, optional stop words and n-grams, hashed counts, inverse document frequency."""
    from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, StopWordsRemover

    stages = [RegexTokenizer(inputCol=input_col, outputCol="_tokens", pattern=pattern, gaps=True, toLowercase=True, minTokenLength=0)]
    at = "_tokens"
    if stop_words is not None:
        stages.append(StopWordsRemover(inputCol=at, outputCol="_kept", stopWords=stop_words))
        at = "_kept"
    if n_gram:
        stages.append(NGram(inputCol=at, outputCol="_grams", n=n_gram))
        at = "_grams"
    stages.append(HashingTF(inputCol=at, outputCol="_counts" if use_idf else output_col, numFeatures=num_features, binary=binary))
    if use_idf:
        stages.append(IDF(inputCol="_counts", outputCol=output_col, minDocFreq=min_doc_freq))
    return Fitted(text_features, models={"pipeline": Pipeline(stages=stages).fit(df)}, temporary=["_tokens", "_kept", "_grams", "_counts"])


def text_features(d: DataFrame, pipeline, temporary: list[str]) -> DataFrame:
    return pipeline.transform(d).drop(*temporary)


def multi_ngram(df: DataFrame, input_col: str, output_col: str, lengths: list[int]) -> DataFrame:
    """n-grams of several lengths of a token array, in the order of ``lengths``."""
    tokens = F.col(input_col)

    def grams(n: int):
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return df.withColumn(output_col, F.concat(*[grams(n) for n in lengths]))


def split_pages(text: str, least: int, most: int) -> list[str]:
    """Pages of at most ``most`` characters, cut behind the last white space after ``least``, else hard."""
    pages, at = [], 0
    while len(text) - at > most:
        cut = at + most
        for i in range(at + most, at + least, -1):
            if text[i - 1].isspace():
                cut = i
                break
        pages.append(text[at:cut])
        at = cut
    pages.append(text[at:])
    return pages


def page_splitter(df: DataFrame, input_col: str, output_col: str, minimum: int = 4500, maximum: int = 5000) -> DataFrame:
    """Array of pages, in code points; joined again they are the text."""

    @pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_pages(t, minimum, maximum))

    return df.withColumn(output_col, split(F.col(input_col)))


class Trie:
    """Longest-match replacement of map keys."""

    def __init__(self, table: dict[str, str], norm: str = "identity"):
        self.norm = {"identity": str, "lowerCase": str.lower, "upperCase": str.upper}[norm]
        self.root: dict = {}
        for key, value in table.items():
            node = self.root
            for c in self.norm(key):
                node = node.setdefault(c, {})
            node[""] = value

    def replace(self, text: str) -> str:
        """Each longest match becomes its value; letters, digits and ``_`` behind it go."""
        shown = self.norm(text)
        if len(shown) != len(text):
            shown = text
        out, i = [], 0
        while i < len(text):
            node, j, end, value = self.root, i, 0, ""
            while j < len(text) and shown[j] in node:
                node = node[shown[j]]
                j += 1
                if "" in node:
                    end, value = j, node[""]
            if not end:
                out.append(text[i])
                i += 1
                continue
            out.append(value)
            i = end
            while i < len(text) and (text[i].isalnum() or text[i] == "_"):
                i += 1
        return "".join(out)


def preprocess_text(df: DataFrame, input_col: str, output_col: str, table: dict[str, str], norm: str = "identity") -> DataFrame:
    @pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = Trie(table, norm)
        for texts in parts:
            yield texts.map(lambda t: None if t is None else trie.replace(t))

    return df.withColumn(output_col, run(F.col(input_col)))


def normalize_unicode(df: DataFrame, input_col: str, output_col: str, form: str = "NFKD", lower: bool = True) -> DataFrame:
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown form {form}")

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t.lower() if lower else t))

    return df.withColumn(output_col, run(F.col(input_col)))
