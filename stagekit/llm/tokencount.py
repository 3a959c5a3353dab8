"""Token counts by finite-state tokenizer compilation.

Byte-level BPE tokenizers cut a text into pre-tokens first and merge bytes inside each. The cutting is
compiled to a deterministic transducer over character classes with eleven states (``STATES``); its
transitions carry the cuts they make, before this character or before the one ahead, so that look-ahead
is gone. Each cut closes a pre-token, and the closing transition is annotated with the number of tokens
that the merges leave of it, computed once per distinct pre-token.

A batch of texts is one string. It is divided into chunks of ``CHUNK`` characters; each chunk's map from
every start state to its end state is built for all chunks side by side, the maps are composed by a
parallel prefix scan, and a second sweep from the now known start states writes the cuts. No step is
sequential in the length of a text.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekit.plans.session import fresh, without

CHUNK = 64
#: Characters that are handled at once, and distinct pre-tokens that a worker remembers.
BLOCK, CACHE = 1_000_000, 600_000

# character classes
SP, WS, NUM, OTHER, APOS, LET, STMD, RV, E, ELL, END = range(11)
# states: start, letters, numbers, others, apostrophe at a start, 'r or 'v, 'l, and white space by
# whether it is one or more and ends in a space
STATES = ("C", "L", "N", "P", "A", "Ae", "Al", "1s", "1o", "2s", "2o")
HERE, BEFORE = 1, 2
WIDTH = 16


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Next state and cuts for class * WIDTH + state."""
    at = {s: i for i, s in enumerate(STATES)}
    letters = (LET, STMD, RV, E, ELL)
    kind = lambda c: "L" if c in letters else {NUM: "N", OTHER: "P", APOS: "P", SP: "W", WS: "W", END: "END"}[c]

    def start(c: int) -> str:
        return {"L": "L", "N": "N", "P": "A" if c == APOS else "P", "W": "1s" if c == SP else "1o", "END": "C"}[kind(c)]

    def step(s: str, c: int) -> tuple[str, int]:
        k = kind(c)
        if s == "A":
            if c == STMD:
                return "X", 0  # placeholder: the contraction is whole, the next character starts
            if c == RV:
                return "Ae", 0
            if c == ELL:
                return "Al", 0
            if k == "P":
                return "P", 0
        if s == "Ae":
            if c == E:
                return "X", 0
            to, cuts = step("L", c)
            return to, cuts | BEFORE
        if s == "Al":
            if c == ELL:
                return "X", 0
            to, cuts = step("L", c)
            return to, cuts | BEFORE
        if s in ("L", "N", "P") and k == s:
            return s, 0
        if s in ("1s", "1o", "2s", "2o"):
            if k == "W":
                return ("2s" if c == SP else "2o"), 0
            if k != "END":
                cuts = BEFORE if s[0] == "2" else 0
                if s[1] == "s":
                    return k, cuts  # the space goes with what follows
                return start(c), cuts | HERE
        return start(c), HERE

    nxt, out = np.zeros(WIDTH * WIDTH, np.uint8), np.zeros(WIDTH * WIDTH, np.uint8)
    for c in range(11):
        for s in STATES:
            to, cuts = step(s, c)
            nxt[c * WIDTH + at[s]] = at["C" if to == "X" else to]
            out[c * WIDTH + at[s]] = cuts
    # Ae and Al before a cut that lies behind: a letter that was read on approval
    return nxt, out


NEXT, CUTS = _compile()
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, np.uint8)
        for i in range(0x110000):
            top = unicodedata.category(chr(i))[0]
            if top in "LN":
                table[i] = LET if top == "L" else NUM
        for i in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
            table[i] = WS
        table[0x20] = SP
        table[ord("'")] = APOS
        for chars, c in (("stmd", STMD), ("rv", RV), ("e", E), ("l", ELL)):
            for x in chars:
                table[ord(x)] = c
        _classes = table
    return _classes


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps (rows) one after the other; associative."""
    return np.take_along_axis(then, first, axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Row i becomes the composition of rows 0..i, in log2(rows) rounds."""
    maps, d = maps.copy(), 1
    while d < len(maps):
        maps[d:] = compose(maps[:-d], maps[d:])
        d *= 2
    return maps


def cuts(kinds: np.ndarray) -> np.ndarray:
    """Positions at which a pre-token begins, for one string of classes (texts end in END)."""
    n, s = len(kinds), len(STATES)
    lanes = -(-n // CHUNK)
    padded = np.full(lanes * CHUNK, END, np.uint16)
    padded[:n] = kinds
    steps = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T) * WIDTH
    maps = np.broadcast_to(np.arange(s, dtype=np.uint8), (lanes, s))
    for row in steps:
        maps = NEXT[row[:, None] + maps]
    state = np.zeros(lanes, np.uint8)
    state[1:] = prefix_scan(maps)[:-1, 0]
    made = np.empty((CHUNK, lanes), np.uint8)
    for j, row in enumerate(steps):
        index = row + state
        made[j] = CUTS[index]
        state = NEXT[index]
    flat = made.T.reshape(-1)
    begin = (flat & HERE).astype(bool)
    begin[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return np.flatnonzero(begin[:n])


def _byte_names() -> list[str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {}, 0
    for b in range(256):
        if b in shown:
            names[b] = chr(b)
        else:
            names[b], extra = chr(256 + extra), extra + 1
    return [names[b] for b in range(256)]


class Lexicon(dict):
    """Pre-token to number of tokens; merges are run for those not met yet."""

    def __init__(self, model: dict):
        super().__init__()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.names = _byte_names()

    def __missing__(self, word: str) -> int:
        count = self.tokens(word)
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = count
        return count

    def tokens(self, word: str) -> int:
        parts = [self.names[b] for b in word.encode("utf-8", "surrogatepass")]
        return len(self.merged(parts) if len(parts) <= 48 else self.merged_long(parts))

    def merged(self, parts: list[str]) -> list[str]:
        rank = self.rank
        while len(parts) > 1:
            found = [rank.get(p, 1 << 30) for p in zip(parts, parts[1:])]
            least = min(found)
            if least == 1 << 30:
                break
            i = found.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def merged_long(self, parts: list[str]) -> list[str]:
        """The same with a heap and links: n log n."""
        n, rank = len(parts), self.rank
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p]


class TokenCounter:
    """A compiled tokenizer file (byte-level BPE, JSON)."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without prefix space and normalizer can be compiled")
        self.lexicon = Lexicon(spec["model"])
        added = sorted((a["content"] for a in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text, added tokens inside counting as one."""
        totals, block, owner, size = [0] * len(texts), [], [], 0
        for k, text in enumerate(texts):
            pieces = [text or ""]
            if self.special and self.special.search(pieces[0]):
                pieces = self.special.split(pieces[0])
                totals[k] += len(pieces) - 1
            for piece in pieces:
                block.append(piece)
                owner.append(k)
                size += len(piece) + 1
            if size >= BLOCK:
                self._block(block, owner, totals)
                block, owner, size = [], [], 0
        if block:
            self._block(block, owner, totals)
        return totals

    def _block(self, pieces: list[str], owner: list[int], totals: list[int]) -> None:
        whole = "\0".join(pieces) + "\0"
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        kinds = classes()[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        kinds[ends] = END
        begin = cuts(kinds)
        lexicon, at = self.lexicon, begin.tolist()
        found = np.fromiter((lexicon[whole[i:j]] for i, j in zip(at, [*at[1:], len(whole)])), np.int64, len(at))
        found[np.searchsorted(begin, ends)] = 0  # the ends themselves
        run = np.concatenate([[0], np.cumsum(found)])
        upto = run[np.searchsorted(begin, ends)]
        for k, n in zip(owner, np.diff(upto, prepend=0).tolist()):
            totals[k] += n


_counters: dict[int, TokenCounter] = {}


def _counter(data: bytes) -> TokenCounter:
    key = hash(data)
    if key not in _counters:
        _counters.clear()
        _counters[key] = TokenCounter(data)
    return _counters[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", output: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text (long; null and empty: 0).

    ``tokenizer_path`` is read on the driver and its bytes are broadcast (a vocabulary's size has a
    bound). Row by row, no shuffle; repeated rows count alike; an input column named like the output is
    replaced.
    """
    with open(tokenizer_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(texts: pa.Array) -> pa.Array:
        return pa.array(_counter(data.value).counts(texts.to_pylist()), pa.int64())

    docs = without(docs, output)
    return docs.withColumn(output, F.arrow_udf(count, "bigint")(F.col(f"`{text_col}`")))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n_bytes = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
