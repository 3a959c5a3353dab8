"""Quality rules: counting rules first, then compression bands.

A text's zstandard ratio (bytes before over bytes after) tells repetition (high) and noise or encoded
data (low). Both ends of the band depend on length, since short texts hardly compress and long ones
compress better: ``BANDS`` has them for whole texts. A long text can hide a bad part, so it is also cut
into chunks of ``CHUNK`` bytes, each with the band of a text of that length, its upper end widened by ``CHUNK_SLACK``;
over ``BAD_SHARE`` of all bytes in chunks outside rejects the text.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekit.plans.session import fresh, without

#: (up to so many bytes, least ratio, largest ratio). zstd level 3, no dictionary: text in words takes
#: 0.6 to 0.9 below 64 bytes for the frame alone, 1.3 to 2 at some hundreds, 1.8 to 2.6 at some
#: thousands, 2.2 to 3.5 beyond; one phrase over and over starts at 5. These least ratios hold for
#: texts mostly outside ASCII.
BANDS = ((64, 0.0, 1.6), (128, 0.6, 2.0), (256, 0.8, 2.6), (512, 1.05, 3.0), (2048, 1.2, 3.6), (16384, 1.3, 4.5), (1 << 62, 1.35, 6.0))
#: (bytes, least ratio) of texts in ASCII for the most part, between them along the logarithm of the size.
#: Base64 reaches 1.12 at 300 bytes, 1.27 at 800, 1.35 at 4,096; random letters 1.68 at 4,096, hex 1.96
#: at 50,000; prose and code start at 1.37 at 800, 1.77 at 4,096, 1.99 at 8,000.
LEAST = ((128, 0.8), (200, 1.03), (300, 1.15), (500, 1.27), (800, 1.38), (1500, 1.55), (2048, 1.63), (4096, 1.76), (8000, 1.97), (16000, 2.05), (50000, 2.1))
#: Hex reaches the ratio of prose below 8,000 bytes, and digits do at any size: they are told by their characters,
#: so many of those that aren't blank, digits among them.
HEX_SHARE, HEX_DIGITS, HEX_LEAST = 0.9, 0.1, 128
LEVEL = 3
CHUNK = 4096
CHUNK_SLACK = 1.25
BAD_SHARE = 0.2

FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
          ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("ratio", pa.float64()), ("bad_share", pa.float64()), ("kept", pa.bool_())]
OUTPUTS = [name for name, _ in FIELDS]
SCHEMA = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,ratio:double,bad_share:double,kept:boolean>"
BLANK = " \t\n\x0b\x0c\r"
BLANK_BYTES = BLANK.encode()
NOT_ASCII = bytes(range(128, 256))
_LEAST = np.log([size for size, _ in LEAST]), [low for _, low in LEAST]


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first ones included."""
    if len(words) <= width:
        return 0
    windows = list(zip(*[words[i:] for i in range(width)]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + width - max(at, end)
            end = at + width
    return covered


def base_counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and whether the counting rules fail."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, BLANK))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(BLANK)] if "\n" in text else []
    repeated = repeat_words(words)
    failed = len(words) < 10 or 100 * repeated > 20 * len(words)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, failed


def band(data: bytes) -> tuple[float, float]:
    """Least and largest ratio of a text like ``data``."""
    size = len(data)
    low, high = next((low, high) for most, low, high in BANDS if size <= most)
    if size >= LEAST[0][0] and 2 * len(data.translate(None, NOT_ASCII)) > size:
        low = float(np.interp(math.log(size), *_LEAST))
    return low, high


def encoded(data: bytes) -> bool:
    """Whether nearly all characters are digits or hex digits."""
    full = len(data) - sum(map(data.count, BLANK_BYTES))
    digits = full and sum(map(data.count, b"0123456789"))
    letters = digits and sum(map(data.count, b"abcdefABCDEF"))
    return full >= HEX_LEAST and digits >= HEX_DIGITS * full and letters + digits >= HEX_SHARE * full


def fits(data: bytes, ratio: float, slack: float = 1.0) -> bool:
    low, high = band(data)
    return low <= ratio <= high * slack and not encoded(data)


def compression(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole, share of bytes in chunks outside their band, and whether both rules pass."""
    if not data:
        return 1.0, 0.0, True
    ratio = len(data) / len(packer.compress(data))
    bad = 0
    if len(data) > CHUNK:
        for at in range(0, len(data), CHUNK):
            part = data[at : at + CHUNK]
            if not fits(part, len(part) / len(packer.compress(part)), CHUNK_SLACK):
                bad += len(part)
    share = bad / len(data)
    return ratio, share, fits(data, ratio) and share <= BAD_SHARE


def _judge(texts: pa.Array) -> pa.Array:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    rows = []
    for text in texts.to_pylist():
        base = base_counts(text)
        ratio, share, fine = compression((text or "").encode("utf-8", "surrogatepass"), packer)
        rows.append((*base, ratio, share, fine and not base[-1]))
    columns = zip(*rows) if rows else [[] for _ in FIELDS]
    return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)], names=OUTPUTS)


def quality_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, ``ratio``, ``bad_share``, ``base_failed`` and ``kept``.

    Whole texts are judged, row by row, without a shuffle. A null or empty text has no words, ratio 1
    and fails the counting rules; so does one of white space. Repeated rows get the same answer each.
    Input columns named like an output are replaced; a table without rows stays so.
    """
    docs = without(docs, *OUTPUTS)
    (judged,) = fresh([*docs.columns, *OUTPUTS], "judged")
    found = docs.withColumn(judged, F.arrow_udf(_judge, SCHEMA)(F.col(f"`{text_col}`")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(judged)[name].alias(name) for name in OUTPUTS])


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).drop("text")
