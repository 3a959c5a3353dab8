"""Language-model scores by logistic context mixing.

A text is a sequence of words and one end (the empty word). Each token is a string of binary decisions:
the ``CODED`` most frequent training words, and one escape, have a prefix code by their counts, so that a
token takes about as many bits as its entropy; after the escape the word is spelled byte by byte, with an
end. Every bit is predicted by hashed-context predictors (none, the token before, the two before; in a
spelling the last one to four bytes), mixed by gated weights and refined (``bitmix``). The score is the
sum over all bits of a text, so it depends on the order of its words, and the chances of all bits at a
place sum to one.

Counts come from the whole training part: word counts by map-side combining, predictor tables as sums of
each task's table, spelling from all words without a code, each once. Tables have about as many slots as
there are bit events, up to 2^22 an order; the vocabulary may have any size. The mixing weights and the
refinement, a few thousand numbers, are learned from every training bit too, each left out of its own
counts: tasks count the bits by case (what the predictors say, in steps, and the bit), and the driver fits
the summed cases, which depends neither on the tasks nor on the order of rows.

``base_score`` and ``n_known`` need exact counts of all words: those of the ``HEAD`` most frequent ones
are broadcast with their spelling, other words of a document are spelled where they are met and joined by
word for their counts, a row per document and word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekit.llm import bitmix
from stagekit.llm.bitmix import Mixer, Tally
from stagekit.llm.lookup import Lookup, counted, flat_words, hashes_of, text_slices
from stagekit.llm.text import id_fold
from stagekit.plans.session import fresh, write_table

#: Words in the dictionary that every worker holds, at most (some 50 bytes each); those of them with a code.
HEAD, CODED = 500_000, 16_384
FLUSH = 400_000
#: Tokens of a task that counts and tasks at most, so that the tables on their way do not grow with the number of input files.
TASK_TOKENS, TRAIN_TASKS = 4_000_000, 2_000
#: Text bytes that a worker learns from or scores at a time, words of a task that learns to spell.
STEP, TASK_WORDS = 1 << 20, 300_000


def flat_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts with A-Z lowered, an empty word after each text, and how many tokens each text has."""
    flat, counts = flat_words(texts)
    # place of each word among the tokens: one end more for each text before it
    at = np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)
    take = np.full(len(flat) + len(counts), len(flat), np.int64)
    take[at] = np.arange(len(flat))
    return pa.concat_arrays([flat, pa.array([""], pa.string())]).take(pa.array(take)), counts + 1


def _count(batches):
    yield from counted((flat_tokens(b.column(0).slice(at, end - at))[0] for b in batches for at, end in text_slices(b.column(0))), "word", "c", FLUSH)


def word_counts(texts: DataFrame) -> DataFrame:
    """(text) to (word string, c long); the empty word is the end of a text."""
    return texts.mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Words:
    """The head of the vocabulary: counts, prefix codes of its ``CODED`` most frequent words, spelling of the others."""

    def __init__(self, words: pa.Array, counts: np.ndarray, spelling: np.ndarray | None, total: float):
        self.lookup = Lookup(words)
        self.counts = counts[self.lookup.order].astype(np.uint32 if len(counts) and counts.max() < 1 << 32 else np.int64)
        self.spelling = None if spelling is None else spelling[self.lookup.order].astype(np.float32)
        # the most frequent ones, equal counts in the order of their hashes
        named = np.sort(np.argsort(-self.counts.astype(np.int64), kind="stable")[:CODED])
        own = self.counts[named].astype(float)
        weight = np.concatenate([own, [max(1.0, total - own.sum())]])
        size = np.ceil(np.log2(weight.sum() / weight) - 1e-9).astype(np.int64)
        order, longest = np.argsort(size, kind="stable"), int(size.max())
        room = np.uint64(1) << (longest - size[order]).astype(np.uint64)
        self.code = np.empty(len(size), np.uint64)
        self.code[order] = (np.cumsum(room) - room) >> (longest - size[order]).astype(np.uint64)
        self.size = size
        #: Place of each word among the codes; the last one is the escape, for words without one, and for -1, a word that is not here.
        self.code_of = np.full(len(counts) + 1, len(named), np.int16)
        self.code_of[named] = np.arange(len(named))
        self.lookup.order = None
        #: Bits of all ``total`` tokens.
        self.events = float((weight * size).sum())

    @property
    def coded(self) -> np.ndarray:
        return self.code_of[:-1] < len(self.code) - 1

    def tokens(self, texts: pa.Array):
        """Flat tokens of the texts: dictionary, codes into it, places in the head (-1: none), hashes, tokens a text."""
        flat, counts = flat_tokens(texts)
        coded = flat.dictionary_encode()
        hashes = hashes_of(coded.dictionary)
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), self.lookup.find(coded.dictionary, hashes), hashes, counts

    def walk(self, index, place, hashes, counts, bits: int):
        """Bits of all tokens, see ``bitmix.code_walk``."""
        start = np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = self.code_of[place][index]
        return bitmix.code_walk(hashes[index], start, self.code[at], self.size[at], bits)


def _emit(counts: Tally):
    """A task's table in chunks, empty ones left out; the size of a chunk tells its numbers' width."""
    pack = zstandard.ZstdCompressor(level=1)
    for i, chunk in counts.chunks():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack.compress(chunk.tobytes())], pa.binary())], names=["chunk", "counts"])


def _sum_chunks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack, total = zstandard.ZstdDecompressor(), np.zeros(2 << bitmix.CHUNK_BITS, np.int64)
    for b in batches:
        for x in b.column("counts"):
            data = unpack.decompress(x.as_buffer())
            total += np.frombuffer(data, np.uint16 if len(data) == 2 * len(total) else np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bitmix.pack(total.reshape(-1, 2)).tobytes()], pa.binary())], names=["chunk", "counts"])


class Fit:
    """A fitted mixer on its way to the workers: the table is broadcast once, and each worker holds it once."""

    def __init__(self, orders: int, bits: int, table, weights=None, cells=None):
        self.orders, self.bits, self.table, self.weights, self.cells = orders, bits, table, weights, cells

    def mixer(self) -> Mixer:
        return Mixer(self.orders, self.table.value, self.weights, self.cells)


def _fit(data: DataFrame, steps, orders: int, bits: int) -> Fit:
    """Tables, then weights and refinement, from all of ``data``; ``steps(batches)`` yields runs of (slots, depth, bit)."""
    sc = data.sparkSession.sparkContext

    def tally(batches):
        counts = Tally(orders << bits)
        for slots, _, bit in steps(batches):
            counts.add(slots, bit)
        yield from _emit(counts)

    schema = "chunk int, counts binary"
    summed = data.mapInArrow(tally, schema).groupBy("chunk").applyInArrow(_sum_chunks, schema)
    # at most orders * 2^MOST_BITS slots of two bytes, whatever the corpus
    table = np.zeros(orders << bits, np.uint16)
    for r in summed.toLocalIterator():
        table[r["chunk"] << bitmix.CHUNK_BITS : (r["chunk"] + 1) << bitmix.CHUNK_BITS] = np.frombuffer(bytes(r["counts"]), np.uint16)
    fit = Fit(orders, bits, sc.broadcast(table))

    def cases(batches):
        mixer, n = fit.mixer(), 0
        seen = np.zeros(mixer.cases, np.uint32)
        for slots, depth, bit in steps(batches):
            np.add.at(seen, mixer.case_of(slots, depth, bit), np.uint32(1))
            n += len(bit)
            if n >= 1 << 31:
                yield _nonzero(seen)
                seen[:], n = 0, 0
        yield _nonzero(seen)

    # every training bit, summed by case: as many rows as there are cases, whatever the corpus
    met = data.mapInArrow(cases, "case int, times long").groupBy("case").agg(F.sum("times").alias("times")).toArrow()
    if not met.num_rows:
        return fit
    case, times = met["case"].to_numpy(), met["times"].to_numpy()
    order = np.argsort(case)
    mixer = Mixer(orders, table)
    mixer.fit(case[order], times[order])
    return Fit(orders, bits, fit.table, mixer.weights, mixer.cells)


def _nonzero(seen: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(seen)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["case", "times"])


def train_tokens_model(texts: DataFrame, words, bits: int) -> Fit:
    def steps(batches):
        for batch in batches:
            for at, end in text_slices(batch.column(0), STEP):
                _, index, place, hashes, counts = words.value.tokens(batch.column(0).slice(at, end - at))
                for _, slots, depth, bit in words.value.walk(index, place, hashes, counts, bits):
                    yield slots, depth, bit

    return _fit(texts, steps, bitmix.TOKEN_ORDERS, bits)


def train_spelling(words: DataFrame, n_words: int) -> Fit:
    bits = bitmix.table_bits(n_words * 80.0)

    def steps(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                data, place, _ = bitmix.flat_bytes([w.encode() for w in batch.column(0).slice(at, 10_000).to_pylist()])
                yield from bitmix.byte_walk(data, place, bits)

    dealt = words.repartition(max(1, -(-n_words // TASK_WORDS)), "word")
    return _fit(dealt, steps, bitmix.BYTE_ORDERS, bits)


def spelled(words: list[str], mixer: Mixer, bits: int) -> np.ndarray:
    """log10 of the chance of each word, its end included."""
    if not words:
        return np.empty(0)
    out = []
    for at in range(0, len(words), 10_000):
        data, place, first = bitmix.flat_bytes([w.encode("utf-8", "surrogatepass") for w in words[at : at + 10_000]])
        total = np.zeros(len(data))
        for slots, depth, bit in bitmix.byte_walk(data, place, bits):
            total += mixer.log10(slots, depth, bit)
        out.append(np.add.reduceat(total, first))
    return np.concatenate(out)


class Scorer:
    """The whole model: codes, token bits and spelling."""

    def __init__(self, words: Words, tokens: Fit, spelling: Fit):
        self.words, self.bits, self.spelling = words, tokens.bits, spelling.bits
        self.token_mixer, self.byte_mixer = tokens.mixer(), spelling.mixer()

    def token_scores(self, texts: pa.Array):
        """log10 chance of every token; with dictionary, index, places and tokens a text."""
        words, index, place, hashes, counts = self.words.tokens(texts)
        total = np.zeros(len(index), np.float32)
        for live, slots, depth, bit in self.words.walk(index, place, hashes, counts, self.bits):
            total[live] += self.token_mixer.log10(slots, depth, bit)
        extra = np.zeros(len(place), np.float32)
        if self.words.spelling is not None and len(self.words.spelling):
            extra = np.where((place >= 0) & (self.words.code_of[place] == len(self.words.code) - 1), self.words.spelling[place], 0).astype(np.float32)
        extra[place < 0] = spelled(words.filter(pa.array(place < 0)).to_pylist(), self.byte_mixer, self.spelling)
        return total + extra[index], words, index, place, counts


def _head(vocabulary: DataFrame, spelling: str | None, total: float, coded: Words | None = None) -> Words:
    """The head on the driver, in the order of the words' hashes whatever order the rows came in; with the codes of ``coded``."""
    top = vocabulary.toArrow().combine_chunks()
    words = pa.concat_arrays(top["word"].chunks).cast(pa.string()) if top.num_rows else pa.array([], pa.string())
    found = Words(words, top["c"].to_numpy(), top[spelling].to_numpy() if spelling else None, total)
    if coded:
        at = coded.lookup.find(found.lookup.strings)
        found.code, found.size = coded.code, coded.size
        found.code_of = np.append(np.where(at >= 0, coded.code_of[at], len(coded.code) - 1), len(coded.code) - 1).astype(np.int16)
    return found


def score_texts(docs: DataFrame, training: DataFrame, text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(row columns but the text) with n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Whole texts of ``docs`` are scored with what all of ``training`` says. A null or empty text is one
    end. Without training rows every count is 0 and every word is spelled at even chances. Rows may
    repeat and ids may be null: each row has its own score. Columns named like an output are replaced.
    An empty table gives an empty one.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = training.select(F.col(f"`{text_col}`").alias("text"))
    vocabulary = write_table(word_counts(texts), "lm-words")
    size, n = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    # the least count of the head, from the number of words at each count
    least, many = 1, size
    if size > head:
        least, many = 1001, 0
        for r in sorted(vocabulary.groupBy(F.least("c", F.lit(1000)).alias("c")).count().collect(), key=lambda r: -r["c"]):
            if many + r["count"] > head:
                break
            least, many = r["c"], many + r["count"]
    # a code needs the count of the most frequent ones only, so that this first dictionary is small
    chosen = _head(vocabulary.orderBy(F.desc("c"), "word").limit(min(CODED, many)), None, n)
    words = sc.broadcast(chosen)
    # at most CODED of them
    named = chosen.lookup.strings.filter(pa.array(chosen.coded)).to_pylist()
    uncoded = vocabulary.select("word").join(F.broadcast(spark.createDataFrame([(w,) for w in named], "word string")), "word", "left_anti").where("word <> ''")
    spelling = train_spelling(uncoded, max(0, size - len(named)))
    bits = bitmix.table_bits(chosen.events)
    dealt = texts.coalesce(int(min(TRAIN_TASKS, max(1, -(-n // TASK_TOKENS)))))
    tokens_model = train_tokens_model(dealt, words, bits)

    def spell(batches):
        model = spelling.mixer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spelled(b.column(0).to_pylist(), model, spelling.bits))], names=["word", "c", "spelling"])

    # spelled once, for all tasks
    whole = vocabulary.where(F.col("c") >= least).mapInArrow(spell, "word string, c long, spelling double")
    words = sc.broadcast(_head(whole, "spelling", n, chosen))
    floor = math.log10(n + 0.5 * (size + 1))

    keep = [c for c in docs.columns if c != text_col and c.lower() not in ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")]
    row, n_bytes, rest, text = fresh([*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"], "row", "n_bytes", "rest", "text")

    def score(batches):
        model = Scorer(words.value, tokens_model, spelling)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for at, end in text_slices(column, STEP):
                part = column.slice(at, end - at)
                points, found, index, place, many = model.token_scores(part)
                of = np.repeat(np.arange(len(many)), many)
                sure = place[index] >= 0 if least > 1 else np.ones(len(index), bool)
                c = np.where(place >= 0, model.words.counts[place] if len(model.words.counts) else 0, 0)[index]
                known = np.bincount(of[sure], c[sure] > 0, len(many)).astype(np.int64)
                base = np.bincount(of[sure], np.log10(c[sure] + 0.5), len(many)) - many * floor
                # words that are not in the head: (text, word, times)
                pairs, times = np.unique(of[~sure] * np.int64(len(found)) + index[~sure], return_counts=True)
                of_pair, word = np.divmod(pairs, np.int64(max(1, len(found))))
                bounds = np.searchsorted(of_pair, np.arange(len(many) + 1)).astype(np.int32)
                waits = pa.StructArray.from_arrays([found.take(pa.array(word)), pa.array(times, pa.int64())], names=["word", "times"])
                yield pa.RecordBatch.from_arrays(
                    [*[x.slice(at, end - at) for x in batch.columns[:-1]], pa.array(many, pa.int64()), pa.array(known), pa.array(base), pa.array(np.bincount(of, points, len(many))),
                     pc.fill_null(pc.binary_length(part), 0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), waits)],
                    names=[*batch.schema.names[:-1], "n_tokens", "n_known", "base_score", "score", n_bytes, rest],
                )

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text))
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
        + [f"n_tokens long, n_known long, base_score double, score double, `{n_bytes}` long, `{rest}` array<struct<word:string,times:bigint>>"]
    )
    scored = rows.mapInArrow(score, schema)
    if least > 1:
        scored = write_table(scored.withColumn(row, F.monotonically_increasing_id()), "lm-scored")
        tail = vocabulary.where(F.col("c") < least)
        waiting = scored.select(F.col(row).alias("row"), F.explode(rest).alias("o")).select("row", "o.word", "o.times")
        c = F.coalesce(F.col("c"), F.lit(0))
        joined = waiting.join(tail, "word", "left").groupBy(F.col("row").alias(row)).agg(
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(c + 0.5)).alias("more_base")
        )
        more = joined.select(row, F.struct("more_known", "more_base").alias(rest))
        scored = scored.drop(rest).join(more, row, "left")
        zero = lambda x: F.coalesce(F.col(f"{rest}.{x}"), F.lit(0))
        scored = scored.withColumns({"n_known": F.col("n_known") + zero("more_known"), "base_score": F.col("base_score") + zero("more_base")})
    # an empty text has no bytes; its end is counted over one
    per_byte = -F.col("score") * math.log2(10) / F.greatest(F.col(n_bytes), F.lit(1))
    return scored.select(*[F.col(f"`{k}`") for k in keep], "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", per_byte.alias("bits_per_byte"))


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(id_fold(F.col("doc_id")) == 1, F.lit(False))
    return score_texts(docs.withColumn("held_out", held_out).select("doc_id", "held_out", "text"), docs.where(~held_out))
