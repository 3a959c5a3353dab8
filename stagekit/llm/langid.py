"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled running text. A text is parsed against it from left to
right: the longest piece that occurs in the labelled text is one phrase, then the next begins. A language
that fits needs few phrases; ``phrases * log2(labelled length) / characters`` estimates the cross entropy
in bits a character, which makes automata of different sizes comparable, and the least wins.

Phrases run over white space. Whole texts are parsed, in blocks of ``BLOCK`` characters that each begin
with a new phrase: so all blocks of many texts, against all languages, go through dense transition tables
side by side, a character at a time. Text is lower-case letters, and one space for everything else; the
``FREQUENT`` letters of the labelled texts are symbols, all others share ``BUCKETS`` by code point, so that
a script of thousands of letters keeps a table of bounded size.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagekit.llm.lookup import text_slices
from stagekit.llm.text import id_fold
from stagekit.plans.session import fresh, without, write_table

#: The labelled sample: documents of a language at most, characters of a document's passage, of a language (fewer
#: than 2^15, as states are 16-bit numbers), and of all languages together.
DOCS, PASSAGE, CHARS, ALL_CHARS = 400, 300, 32_000, 4_000_000
FREQUENT, BUCKETS = 47, 16
SYMBOLS = 1 + FREQUENT + BUCKETS
BLOCK = 256
#: Labels up to which their table is broadcast.
FEW = 100_000
#: Labelled characters that the estimate counts with at least: a label of a few words would win with its few bits a phrase.
LEAST = 256
UNKNOWN = "und"
#: Bits a character from which no language fits; short texts, which tell little, count as so many characters more.
MOST_BITS, MORE = 5.5, 16
OTHERS = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> str:
    """Lower-case letters, with one space for whatever lies between them."""
    return OTHERS.sub(" ", (text or "").lower()).strip()


class SuffixAutomaton:
    """All substrings of a sequence of symbols, as a dense table (state, symbol) to state; 0 is the start, and no way on."""

    def __init__(self, symbols: list[int]):
        goto: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            new = len(goto)
            goto.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in goto[p]:
                goto[p][c] = new
                p = link[p]
            if p != -1:
                q = goto[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(goto)
                    goto.append(dict(goto[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and goto[p].get(c) == q:
                        goto[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.table = np.zeros((len(goto), SYMBOLS), np.uint16)
        for s, row in enumerate(goto):
            for c, t in row.items():
                self.table[s, c] = t


class CrossParser:
    """Automata of all languages in one table, and the symbols they read."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        seen = Counter(c for k in self.langs for c in samples[k])
        self.symbol = np.arange(0x110000, dtype=np.uint32) % BUCKETS
        self.symbol = (self.symbol + 1 + FREQUENT).astype(np.uint8)
        for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]):
            self.symbol[ord(c)] = i + 1
        tables = [SuffixAutomaton(self.symbols(samples[k]).tolist()).table for k in self.langs]
        self.first = (np.cumsum([0, *map(len, tables)])[:-1] * SYMBOLS).astype(np.int32)
        self.table = np.concatenate(tables).ravel() if tables else np.empty(0, np.uint16)
        self.bits = np.array([math.log2(max(LEAST, len(samples[k]))) for k in self.langs])

    def symbols(self, text: str) -> np.ndarray:
        return self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(texts, languages) phrases of normal texts; the sum over a text's blocks."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = self.symbols("".join(texts))
        many = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), many)
        place = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * BLOCK
        first = np.repeat(np.cumsum(sizes) - sizes, many) + place
        length = np.minimum(np.repeat(sizes, many) - place, BLOCK)
        order = np.argsort(-length, kind="stable")  # the longest first: those that go on are at the front
        first, length, owner = first[order], length[order], owner[order]
        state = np.zeros((len(self.langs), len(owner)), np.int32)
        count = np.zeros((len(self.langs), len(owner)), np.int32)
        base = self.first[:, None]
        for at in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -at, side="left"))
            c = flat[first[:n] + at].astype(np.int32)
            before = state[:, :n]
            after = self.table[before * SYMBOLS + (c + base)]
            stuck = after == 0
            root = self.table[c + base]
            # a phrase ends before a character that does not go on, and one that no phrase begins with is one itself
            count[:, :n] += (stuck & (before != 0)).view(np.int8) + (stuck & (root == 0)).view(np.int8)
            state[:, :n] = np.where(stuck, root, after)
        count += state != 0
        for i in range(len(self.langs)):
            out[:, i] = np.bincount(owner, count[i], len(texts))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        """Language, score and the winner's bits a character."""
        plain = [normal(t) if t else "" for t in texts]
        if not self.langs:
            return [(UNKNOWN, 0.0, None)] * len(texts)
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        bits = self.phrases(plain) * self.bits / np.maximum(sizes, 1)[:, None]
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(plain)), best]
        if len(self.langs) > 1:
            second = np.partition(bits, 1, axis=1)[:, 1]
            score = np.clip(1 - least / np.maximum(second, 1e-9), 0, 1)
        else:
            score = np.ones(len(plain))
        return [(self.langs[b], float(s), float(x)) if n else (UNKNOWN, 0.0, None) for n, b, s, x in zip(sizes, best, score, least)]


#: The parser of the samples that this worker met last.
_parsers: dict[int, CrossParser] = {}


def _parser(samples: dict[str, str]) -> CrossParser:
    key = hash(tuple(sorted(samples.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(samples)
    return _parsers[key]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Labelled text by language, from a bounded sample of ``labelled``: every label that has a text with a letter.

    ``DOCS`` documents a language, in the order of a hash of their id, show a passage of ``PASSAGE``
    characters each, from a place that the hash chooses, up to ``CHARS`` characters (less with so many
    languages that ``ALL_CHARS`` are shared out). The counts see all rows; the text column is read only
    for rows whose hash is under a limit that leaves about twice ``DOCS`` a language. Null labels and null
    texts are left out; an empty table gives no language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    hashed, text = F.pmod(F.xxhash64(id_col), F.lit(1 << 40)), F.col(text_col)
    place = F.pmod(hashed, F.greatest(F.lit(1), F.char_length(text) - PASSAGE + 1)).cast("int")
    rows = rows.select(F.col(lang_col).alias("lang"), hashed.alias("h"), F.substr(text, place + 1, F.lit(PASSAGE)).alias("text"))
    counts = write_table(rows.groupBy("lang").count(), "langid-counts")
    limits = counts.select(F.col("lang").alias("l"), (F.lit(2.0 * DOCS * (1 << 40)) / F.col("count")).alias("most"))
    if counts.count() <= FEW:
        limits = F.broadcast(limits)
    near = rows.join(limits, (F.col("lang") == F.col("l")) & (F.col("h") <= F.col("most"))).select("lang", "h", "text")
    first = near.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("i") <= DOCS)
    texts: dict[str, list[str]] = {}
    for row in first.select("lang", "i", "text").orderBy("lang", "i").toLocalIterator():
        texts.setdefault(row["lang"], []).append(normal(row["text"]))
    chars = min(CHARS, ALL_CHARS // max(1, len(texts)))
    learned = {k: " ".join(filter(None, v))[:chars] for k, v in texts.items()}
    return {k: text for k, text in learned.items() if text}


SCHEMA = "struct<lang_pred:string,score:double,bits_per_char:double>"
OUTPUTS = ["lang_pred", "score", "bits_per_char"]


def identify(docs: DataFrame, samples: dict[str, str], text_col: str = "text", outputs: list[str] = OUTPUTS) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1: lead over the next language) and ``bits_per_char``.

    Whole texts, row by row. Null text and text without a letter give ``und`` and score 0, as does any
    text if nothing was learned; of languages that fit alike the first by name wins. Repeated rows get the
    same answer each. Input columns named like an output are replaced; an empty table stays so.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def judge(texts: pa.Array) -> pa.Array:
        parser, rows = _parser(shared.value), []
        for at, end in text_slices(texts, 1 << 20):
            rows += parser.predict(texts.slice(at, end - at).to_pylist())
        cols = list(zip(*rows)) if rows else [[], [], []]
        kinds = (pa.string(), pa.float64(), pa.float64())
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=OUTPUTS)

    docs = without(docs, *outputs)
    (found,) = fresh([*docs.columns, *outputs], "found")
    judged = docs.withColumn(found, F.arrow_udf(judge, SCHEMA)(F.col(f"`{text_col}`")))
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(found)[n].alias(name) for n, name in zip(OUTPUTS, outputs)])


def keep_identified(docs: DataFrame, samples: dict[str, str], text_col: str = "text", most_bits: float = MOST_BITS) -> DataFrame:
    """Rows of ``docs``, columns as they are, whose text one of the languages fits.

    Null texts, texts without a letter and texts over ``most_bits`` go; so does every row if nothing was
    learned. Repeated rows share their fate; an empty table stays so.
    """
    pred, _, bits = names = fresh(docs.columns, *OUTPUTS)
    judged = identify(docs, samples, text_col, names)
    size = F.char_length(F.col(f"`{text_col}`"))
    return judged.where((F.col(pred) != UNKNOWN) & (F.col(bits) * size <= most_bits * (size + MORE))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_langid(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = id_fold(F.col("doc_id")) == 0
    samples = fit(docs.where(~held_out))
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return identify(rows, samples).select("doc_id", "held_out", "lang_pred", "score", "bits_per_char")
