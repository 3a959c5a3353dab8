"""Secret scans: fixed patterns, and guess costs of values that stand where credentials stand.

The second part prices a value the way a password cracker meets it: the cheapest way to cut it into
words (rank in a list, capital letters priced), dates, repeats, keyboard walks, and brute-force spans
(characters at the price of their alphabet), each piece besides costing ``PIECE``. Prices are base-10
logarithms, so the cheapest cutting is a shortest path over the places of the value, which the dynamic
program finds exactly. A value is a secret from ``GUESSES`` on; ``password=changeme`` and ``token:
required`` stay far below. The word list is a short one of words frequent in passwords and settings, and
behind it the ``CORPUS_WORDS`` most frequent words of the corpus.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekit.llm.lookup import counted, flat_words, text_slices
from stagekit.plans.session import fresh, without

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: What makes the assign pattern possible at all; cheap to look for.
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "pwd", "passphrase", "credential", "authorization", "bearer")
#: Contexts of the guess-cost method: more names than the pattern has, any value without spaces.
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|credentials?|authorization|bearer)["']?\x20*(?:[:=]|\x20is\x20)\x20*(?:bearer\x20+|basic\x20+)?["']?([^\s"'<>]{8,})""",
    re.I | re.A,
)
#: log10 of the guesses from which a value counts as a secret.
GUESSES = 12.0
PIECE = 0.7
KINDS = ("assign", "access", "hex", "guess")

#: Frequent words in passwords, settings and placeholders; the place is the rank.
WORDS = (
    "password the pass admin user login test love secret root welcome monkey dragon master hello qwerty letmein change changeme me default example sample dummy "
    "your here none null true false empty required optional string value placeholder token key api access private public my new old this that is not and for you "
    "with from have name data file path server client service account database host port local localhost http https www com org net config setting option param "
    "type field input output request response header body content text json xml html code number index size count list array object class method function return "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday spring summer "
    "autumn fall winter football baseball soccer hockey basketball shadow sunshine princess charlie michael jordan superman batman trustno iloveyou jesus ninja "
    "mustang access flower cookie cheese coffee computer internet google facebook apple orange banana purple yellow silver golden black white green blue red "
    "freedom whatever hunter killer pepper ginger summer harley ranger george thomas robert daniel andrew joshua jessica ashley amanda nicole hannah matthew "
    "london paris berlin madrid america england france germany spain family friend house money power magic music movie guitar tiger lion eagle wolf bear horse "
    "one two three four five six seven eight nine ten first second third last next good best great happy lucky super mega ultra demo temp guest support system "
    "manager office company business customer product order price total sales team group project work home school student teacher doctor please enter forgot reset "
    "redacted hidden masked removed xxx abc xyz foo bar baz lorem ipsum insert replace todo fixme variable environment env var getenv process"
).split()
#: Words of the corpus in the list: that many, of so many ASCII letters, seen so often at least.
CORPUS_WORDS, LETTERS, TIMES = 20_000, (3, 24), 10
LEET = str.maketrans("@4301$5!7", "aaeoissit")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik9ol0p")
STEPS = {a + b for row in ROWS for a, b in zip(row, row[1:])}
STEPS |= {x[::-1] for x in STEPS}
DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")


def _alphabet(c: str) -> float:
    """log10 of the guesses for one character by brute force."""
    if c.isdigit():
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26)
    return math.log10(33) if c.isascii() else 2.0


class Guesser:
    """Prices of values by a ranked word list: ``WORDS``, then those of the corpus in their order."""

    def __init__(self, corpus: list[str] = ()):
        self.rank = {w: math.log10(i + 2) for i, w in reversed(list(enumerate([*WORDS, *corpus])))}
        self.longest = max(map(len, self.rank))

    def _word(self, value: str, low: str, plain: str, i: int, j: int) -> float | None:
        rank = self.rank.get(low[i:j])
        if rank is None:
            rank = self.rank.get(plain[i:j])
            if rank is None:
                return None
            rank += 0.5
        upper = sum(map(str.isupper, value[i:j]))
        return rank + (0.0 if not upper else 0.3 if upper in (1, j - i) else 0.3 * min(upper, j - i - upper) + 0.3)

    def cost(self, value: str) -> float:
        """log10 of the guesses for ``value``: the least over all cuttings."""
        n, low = len(value), value.lower()
        if len(low) != n:  # lower case of another length: no use for places
            low = value
        plain = low.translate(LEET)
        walk, same = [1] * n, [1] * n  # lengths of the runs that end here
        for i in range(1, n):
            if low[i - 1 : i + 1] in STEPS:
                walk[i] = walk[i - 1] + 1
            if low[i] == low[i - 1]:
                same[i] = same[i - 1] + 1
        best, price = [0.0] * (n + 1), [_alphabet(c) for c in value]
        brute = math.inf  # cheapest cutting whose last piece is an open brute-force span
        for j in range(1, n + 1):
            brute = min(brute, best[j - 1] + PIECE) + price[j - 1]
            cost = brute
            for i in range(max(0, j - self.longest), j - 2):
                word = self._word(value, low, plain, i, j)
                if word is not None:
                    cost = min(cost, best[i] + PIECE + word)
            if low[j - 1].isdigit():
                for i in range(max(0, j - 10), j - 3):
                    if DATE.fullmatch(low, i, j):
                        cost = min(cost, best[i] + PIECE + (2.1 if j - i == 4 else 4.6))
            # every walk and repeat that ends here, not the longest alone: a word may end inside
            for run, base in ((walk[j - 1], 1.7), (same[j - 1], price[j - 1])):
                if 3 <= run <= 64:
                    cost = min(cost, min(best[j - k] + _LOG[k] for k in range(3, run + 1)) + PIECE + base)
                elif run > 64:
                    ahead = np.array(best[j - run : j - 2][::-1]) + np.log10(np.arange(3, run + 1))
                    cost = min(cost, float(ahead.min()) + PIECE + base)
            best[j] = cost
        return best[n]


_LOG = [math.log10(max(1, k)) for k in range(65)]


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = CORPUS_WORDS) -> list[str]:
    """The most frequent words of whole texts, by count and then by name; ``most`` of them come to the driver."""
    shape = "^[a-z]{%d,%d}$" % LETTERS

    def run(batches):
        def words():
            for b in batches:
                for at, end in text_slices(b.column(0)):
                    coded = flat_words(b.column(0).slice(at, end - at))[0].dictionary_encode()
                    fine = pc.match_substring_regex(coded.dictionary, shape)
                    yield coded.dictionary.take(coded.indices.filter(fine.take(coded.indices)))

        yield from counted(words(), "word", "n", 200_000)

    counts = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.where(F.col("n") >= TIMES).orderBy(F.desc("n"), "word").limit(most).collect()]


def base_spans(text: str, lowered: str | None = None) -> list[tuple[str, int, int]]:
    """Spans of the three patterns, unordered."""
    found = []
    lowered = text.lower() if lowered is None else lowered
    if any(h in lowered for h in HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def guess_spans(text: str, guesser: Guesser, lowered: str | None = None, least: float = GUESSES) -> list[tuple[str, int, int]]:
    """Values in a credential's place that cost at least ``least`` guesses (log10)."""
    lowered = text.lower() if lowered is None else lowered
    if not any(h in lowered for h in HINTS):
        return []
    found = []
    for m in CONTEXT.finditer(text):
        value = m.group(1).rstrip(".,;:!?)]}")
        if len(value) >= 8 and guesser.cost(value) >= least:
            found.append(("guess", m.start(1), m.start(1) + len(value)))
    return found


def scan(text: str | None, guesser: Guesser) -> tuple[list, list]:
    """Base spans and all spans, each by start, then kind."""
    text = text or ""
    lowered = text.lower()
    order = lambda s: (s[1], KINDS.index(s[0]))
    base = sorted(base_spans(text, lowered), key=order)
    more = [g for g in guess_spans(text, guesser, lowered) if not any(a < g[2] and g[1] < b for _, a, b in base)]
    return base, sorted(base + more, key=order)


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans, mark: str = "[secret]") -> str:
    """``text`` with the union of the spans replaced."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


FIELDS = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
OUTPUTS = [name for name, _ in FIELDS]
SCHEMA = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string>"


def _guesser(docs: DataFrame, words: list[str] | None, text_col: str):
    """The word list on its way to the workers: ``words``, or those of ``docs``."""
    words = corpus_words(docs, text_col) if words is None else words[:CORPUS_WORDS]
    return docs.sparkSession.sparkContext.broadcast(Guesser(words))


def secret_scan(docs: DataFrame, text_col: str = "text", words: list[str] | None = None) -> DataFrame:
    """``docs`` with counts per base kind, ``base_sha256`` and ``spans`` (``kind:start:end``, code points).

    One pass counts the corpus's words (unless ``words`` names them, the most frequent first), one scans
    row by row. A null or empty text has no span, repeated rows have the same ones, an empty table stays
    so. The guess-cost method adds spans of kind ``guess`` where no base span lies and never takes one
    away. Input columns named like an output are replaced.
    """
    guesser = _guesser(docs, words, text_col)

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            base, every = scan(text, guesser.value)
            kinds = [k for k, _, _ in base]
            rows.append((*map(kinds.count, KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        columns = zip(*rows) if rows else [[] for _ in FIELDS]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)], names=OUTPUTS)

    docs = without(docs, *OUTPUTS)
    (found,) = fresh([*docs.columns, *OUTPUTS], "found")
    scanned = docs.withColumn(found, F.arrow_udf(run, SCHEMA)(F.col(f"`{text_col}`")))
    return scanned.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(found)[n].alias(n) for n in OUTPUTS])


def redact_secrets(docs: DataFrame, text_col: str = "text", words: list[str] | None = None) -> DataFrame:
    """``docs`` with every span of ``secret_scan`` in the text replaced by ``[secret]``; null stays null, empty empty."""
    guesser = _guesser(docs, words, text_col)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([t and redact(t, scan(t, guesser.value)[1]) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text_col, F.arrow_udf(run, "string")(F.col(f"`{text_col}`")))


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return secret_scan(docs).drop("text")
