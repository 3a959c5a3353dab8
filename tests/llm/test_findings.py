"""The training-data operators where a review found the work cut short."""

import random
import string
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard

from pyspark.sql import functions as F

from stagekit.llm import ann, bitmix, langid, lmscore, lookup, neardup, pieces, quality, secret_scan
from stagekit.llm.text import id_fold

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [2000, 5000])
def test_ann_recall_without_structure(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    d = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(d, d.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, n, 50):
        score = unit @ unit[q]
        score[q] = -2
        hits += len(got[q] & set(np.argsort(-score)[:5].tolist()))
    assert hits / (5 * len(got)) >= 0.9


ALPHABETS = {"base64": string.ascii_letters + string.digits + "+/", "hex": "0123456789abcdef", "letters": string.ascii_lowercase, "printable": string.digits + string.ascii_letters + string.punctuation}


def _junk(kind, size, blank=" ", seed=0):
    rng, out = random.Random(f"{kind}{size}{blank}{seed}"), ""
    while len(out) < size:
        out += "".join(rng.choices(ALPHABETS[kind], k=76 if blank == "\n" else rng.randint(3, 12))) + blank
    return out[:size]


@pytest.mark.parametrize("kind", ALPHABETS)
def test_quality_rejects_encoded_and_random_text(spark, kind):
    # random letters compress like prose up to some thousand bytes
    sizes = (4096, 8000, 16000, 50000, 100000) if kind == "letters" else (500, 800, 1500, 3000, 8000, 16000, 50000, 100000)
    rows = [(_junk(kind, n, blank, seed),) for n in sizes for blank in " \n" for seed in range(3)]
    # prose around junk: the whole looks fine, the chunks don't
    prose = "\n".join(sorted((r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars > 1500").collect() if not quality.base_counts(r.text)[-1]), key=len))
    rows += [(prose[:20000] + _junk(kind, 40000),), (prose[:30000] + _junk(kind, 15000),)]
    assert len(prose) >= 30000
    got = quality.quality_rules(spark.createDataFrame(rows, "text string")).where("kept").collect()
    assert [len(r.text) for r in got] == []


def test_quality_keeps_prose():
    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    with open("/usr/share/common-licenses/GPL-3", "rb") as f:
        text = f.read()
    for size in (300, 500, 800, 1500, 3000, 8000, 16000, len(text)):
        assert quality.compression(text[5000 : 5000 + size] if size < len(text) else text, packer)[2]


CONTEXT_NAMES = ["password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "X-Api-Key", "credential", "credentials", "authorization", "bearer"]


@pytest.mark.parametrize("name", CONTEXT_NAMES)
def test_every_credential_context_alone(name):
    value = "kX9!vQ2#zL7pR4"
    text = f"see {name}: {value} and go on"
    _, spans = secret_scan.scan(text, secret_scan.Guesser())
    assert spans == [("guess", text.index(value), text.index(value) + len(value))]
    assert value not in secret_scan.redact(text, spans)


def test_languages_without_spaces_or_words(spark):
    rng = random.Random(3)
    hanzi = ["".join(chr(0x4E00 + rng.randrange(300)) for _ in range(2)) for _ in range(400)]
    often = [1 / (k + 1) for k in range(400)]
    base = spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL AND doc_id < 200").collect()
    rows = [(r.doc_id, r.text, r.lang) for r in base]
    rows += [(1000 + i, "".join(rng.choices(hanzi, often, k=200)), "zh") for i in range(30)]
    rows += [(2000 + i, ["", "  ", "12 34 !?", None][i % 4], "no words") for i in range(40)] + [(3000, "Q7 x", "few words")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held_out = id_fold(F.col("doc_id")) == 0
    samples = langid.fit(d.where(~held_out | (F.col("doc_id") == 3000)))
    assert {"zh", "few words"} <= set(samples) and "no words" not in samples
    got = [r for r in langid.identify(d.where(held_out), samples).collect() if any(map(str.isalpha, r.text or ""))]
    assert sum(r.lang == "zh" for r in got) > 2 and all(r.lang_pred == "zh" for r in got if r.lang == "zh")
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95


def test_pipeline_links_from_0_80(spark):
    import corpus_pipeline

    # sets of 100 shingles; pairs just over and just under 0.8, all under 0.85
    rows, want = [], set()
    for g in range(60):
        base = [f"g{g}w{k}" for k in range(104)]
        cut = 10 + g % 3  # shingles that the copy does not share, at its end
        copy = base[: 104 - cut] + [f"g{g}x{k}" for k in range(cut)]
        a, b = (set(zip(*[w[i:] for i in range(5)])) for w in (base, copy))
        similarity = len(a & b) / len(a | b)
        rows += [(2 * g, " ".join(base), "en", "s", 1), (2 * g + 1, " ".join(copy), "en", "s", 1)]
        want |= {2 * g} if similarity >= 0.8 else {2 * g, 2 * g + 1}
        assert 0.75 < similarity < 0.85
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, d, SF).collect()} == want and 60 < len(want) < 120
    assert neardup.near_duplicates(d, percent=85).where("kept").count() == 120


def test_weights_learn_from_every_bit(spark, monkeypatch):
    texts = [" ".join(f"{w}{k % 9}" for w in ("ab", "cd", "ef")) + f" {k}" for k in range(9_000)]
    kept = []

    def train(texts, words, *rest, f=lmscore.train_tokens_model):
        kept.append((words.value, f(texts, words, *rest)))
        return kept[-1][1]

    monkeypatch.setattr(lmscore, "train_tokens_model", train)
    lmscore.score_texts(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    (words, fit), = kept
    _, index, place, _, _ = words.tokens(pa.array(texts))
    assert fit.cells.sum() == words.size[words.code_of[place]][index].sum()


def test_weights_fitted_on_cases_follow_single_bits():
    """Against plain steps over single bits, where the levels of the predictors are exact."""
    rng = np.random.default_rng(3)
    zero = rng.integers(0, 3, 3 << 12)
    table = bitmix.pack(np.stack([zero, rng.integers(0, 3, 3 << 12) * (zero < 1)], axis=1) + [[1, 1]])
    slots, bit = rng.integers(0, 1 << 12, (3, 60_000)) + (np.arange(3) << 12)[:, None], rng.integers(0, 2, 60_000).astype(np.int32)
    m = bitmix.Mixer(3, table)
    cases, times = np.unique(m.case_of(slots, 1, bit), return_counts=True)
    m.fit(cases, times)
    assert m.cells.sum() == len(bit)
    # chance and times seen of each predictor without the bit itself
    counts = np.stack([table >> 8, table & 255], axis=-1)[slots].astype(int)
    counts[np.arange(3)[:, None], np.arange(len(bit)), bit] -= 1
    n = counts.sum(axis=2)
    x = np.vstack([np.log((counts[..., 1] + 0.3) / (counts[..., 0] + 0.3)), np.full((1, len(bit)), 0.3)])
    x[:3][n > 2] = np.rint(x[:3][n > 2] / 0.5) * 0.5
    gate = m.gate_of[(np.minimum(n, 3) << np.array([[0], [2], [4]])).sum(axis=0)] + 1
    for g in np.unique(gate):
        here = x[:, gate == g]
        error = bit[gate == g] - 1 / (1 + np.exp(-0.4 * here.sum(axis=0)))
        assert np.allclose(m.weights[g], 0.4 + 0.3 * (here @ error) / ((here**2).sum(axis=1) * 0.25 + 20), atol=1e-3)


def test_tally_is_exact_beyond_16_bits():
    rng = np.random.default_rng(4)
    slots, bit = np.minimum(rng.zipf(1.2, (3, 300_000)), 4095) + (np.arange(3) << 12)[:, None], rng.integers(0, 2, 300_000)
    plain, tally = np.zeros((3 << 12) * 2, np.uint32), bitmix.Tally(3 << 12)
    for _ in range(4):
        bitmix.add(plain, slots, bit)
        tally.add(slots, bit)
    assert plain.max() > 65_535 and tally.low.nbytes < plain.nbytes
    rows = pa.Table.from_batches(lmscore._emit(tally))
    for chunk in rows["chunk"].to_pylist():
        (got,) = lmscore._sum_chunks((pa.scalar(chunk),), iter(rows.filter(pc.equal(rows["chunk"], chunk)).to_batches()))
        want = bitmix.pack(plain.reshape(-1, 2)[chunk << bitmix.CHUNK_BITS : (chunk + 1) << bitmix.CHUNK_BITS])
        assert got["counts"][0].as_py() == want.tobytes()


def test_hashing_many_strings_keeps_memory():
    strings = pa.array([f"unit {k} of many" for k in range(200_000)])
    tracemalloc.start()
    got = lookup.hashes_of(strings)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20
    assert (got[::5000] == lookup.hashes_of(strings.take(pa.array(range(0, 200_000, 5000))))).all()


def test_dictionary_stays_packed_on_the_driver(spark):
    units = spark.createDataFrame([(f"▁word{k}", k + 1) for k in range(6_000)], "unit string, n long")
    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    parts = pieces.head_ids(units, model, "bpe", 1_000_000)
    assert parts.made is None and sum(map(len, parts.parts)) < 150_000
    made, folder = parts.dictionary(), pieces.Folder(model, "bpe")
    assert parts.dictionary() is made and len(made.first) == 6_001
    for i in range(0, 6_000, 97):
        assert made.ids[made.first[i] : made.first[i + 1]].tolist() == folder.ids(made.lookup.strings[i].as_py())
