"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units, before a space mark that follows something else, and around characters that no
longer piece has; no piece runs over such a cut, so a unit's pieces depend on the unit alone. Over the
``HEAD`` most frequent distinct units of the corpus the lattice is relational: substrings of bounded
length are exploded, joined by equality to the piece table, and the edges are grouped by unit again (the
units are already partitioned by that key, so this adds no shuffle). A higher-order ``aggregate`` folds
each unit by Viterbi, from left to right, with the best edge into every place and a way back from the end:

* ``unigram`` models: the best edge has the highest score of the path up to its end;
* ``bpe`` models (such as piece_bpe_32k.model): an edge counts only where it is stable behind the best
  edge into its start, which means that no piece over their joint would have been merged first. The
  encoding is the one path all whose joints are stable, so exactly one edge into each place is left and
  the ids are those of merging the best pair first. Whether a joint is stable follows from when each
  suffix of the left and each prefix of the right piece is a symbol while that piece is being merged
  (``Pieces.spans_of``); this needs a model whose pieces merge in the order of their scores, which
  ``Pieces`` checks.

Units beyond the head, and units of over ``LONG`` characters, take the same fold in the worker that meets
them (``Folder``), in linear time. Characters without a piece become their UTF-8
bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagekit.llm.lookup import SLICE, Lookup, counted, ranges, slices, text_slices
from stagekit.plans.session import fresh, without, write_table

MARK, CUT = "▁", "\x1f"
#: Distinct units in the dictionary that every worker holds, at most (some 60 bytes each).
HEAD = 1_000_000
#: Longer units are folded by the workers: a fold in SQL copies its state at every place.
LONG = 48
#: Units of a lattice task; distinct units a worker counts before it sends them on.
TASK_UNITS, FLUSH = 4_000, 250_000
#: Ranks of merges take 20 bits; ``ALWAYS`` is behind all of them.
NEVER, ALWAYS = -1, (1 << 20) - 1
EDGE = "struct<end:int,start:int,rank:int,id:int,score:double,right:array<int>,left:array<bigint>>"


class Pieces:
    """The piece table of a model file: strings, scores, and where the byte pieces begin."""

    def __init__(self, data: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = model.get_piece_size()
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        strings = [model.id_to_piece(i) for i in range(n)]
        table = {s: (i, float(model.get_score(i))) for i, s in enumerate(strings) if plain[i]}
        self._set(strings, table, next((i for i in range(n) if model.is_byte(i)), None), model.unk_id())

    @classmethod
    def from_table(cls, scores: dict[str, float], unknown: int = 0) -> Pieces:
        """Pieces of a hand-made table; ids follow its order, from 1."""
        made = cls.__new__(cls)
        made._set(["", *scores], {s: (i, x) for i, (s, x) in enumerate(scores.items(), 1)}, None, unknown)
        return made

    def _set(self, strings, table, first_byte, unknown) -> None:
        self.strings, self.table, self.first_byte, self.unknown = strings, table, first_byte, unknown
        order = {score: k for k, score in enumerate(sorted({score for _, score in table.values()}, reverse=True))}
        #: Pieces of two characters and more by rank, the smaller merging first.
        self.rank = {s: order[score] for s, (_, score) in table.items() if len(s) > 1}
        self.longest = max(map(len, table))
        self.lowest = min(score for _, score in table.values())
        inside = {c for s in table if len(s) > 1 for c in s}
        self.alone = "".join(c for c in map(chr, range(0x20)) if c not in inside)

    def spans_of(self, piece: str) -> tuple[list[tuple], list[tuple]] | None:
        """When the suffixes and the prefixes of ``piece`` are symbols during its merging: (length, birth, death).

        Times are the ranks of the merges that make and use a symbol. None if the piece is not what its
        own characters merge to, so that no text has it.
        """
        n, cuts, last = len(piece), list(range(len(piece) + 1)), NEVER
        right, left, birth_r, birth_l = [], [], 0, 0
        while len(cuts) > 2:
            rank, k = min((self.rank.get(piece[cuts[k] : cuts[k + 2]], ALWAYS), k) for k in range(len(cuts) - 2))
            if rank == ALWAYS:
                return None
            if rank < last:
                raise ValueError(f"piece {piece!r} is not merged in the order of scores")
            last = rank
            if k == 0:
                left.append((cuts[1], birth_l, rank))
                birth_l = rank
            if k == len(cuts) - 3:
                right.append((n - cuts[-2], birth_r, rank))
                birth_r = rank
            del cuts[k + 1]
        return [*right, (n, birth_r, ALWAYS)], [*left, (n, birth_l, ALWAYS)]

    def rows(self, kind: str) -> list[tuple]:
        """(piece, rank, id, score, right, left) of all pieces that a text can have.

        ``right`` holds birth * 2^20 + death by suffix length (``NEVER`` for no symbol) in two ints,
        ``left`` holds length * 2^40 + birth * 2^20 + death of the prefixes that are symbols.
        """
        out = []
        for s, (i, score) in self.table.items():
            spans = self.spans_of(s) if kind == "bpe" else ([], [])
            if spans:
                births, deaths = [NEVER] * len(s), [NEVER] * len(s)
                for size, birth, death in spans[0]:
                    births[size - 1], deaths[size - 1] = birth, death
                left = [size << 40 | birth << 20 | death for size, birth, death in spans[1]]
                out.append((s, self.rank.get(s, NEVER), i, score, [x for pair in zip(births, deaths) for x in pair], left))
        return out

    def beginnings(self) -> set[str]:
        """Everything that some piece begins with."""
        return {s[:k] for s in self.table for k in range(1, len(s) + 1)}

    def unit_pattern(self) -> re.Pattern:
        alone = re.escape(self.alone)
        return re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))

    def surfaces(self) -> list[bytes]:
        """What each id stands for when decoded."""
        out = []
        for i, s in enumerate(self.strings):
            if self.first_byte is not None and self.first_byte <= i < self.first_byte + 256:
                out.append(bytes([i - self.first_byte]))
            elif s in self.table:
                out.append(s.encode())
            else:
                out.append(b"")
        return out


def marked(text: str | None) -> str:
    """The text as the model sees it: a mark in front and for each space; nothing for null or empty."""
    return MARK + text.replace(" ", MARK) if text else ""


def spelled(char: str, pieces: Pieces) -> list[int]:
    if pieces.first_byte is None:
        return [pieces.unknown]
    return [pieces.first_byte + b for b in char.encode("utf-8", "surrogatepass")]


class Folder:
    """The fold that ``lattice`` does in SQL, for one unit at a time in a worker."""

    def __init__(self, pieces: Pieces, kind: str):
        self.pieces, self.kind, self.begins = pieces, kind, pieces.beginnings()
        self.ids_of = {s: i for s, (i, _) in pieces.table.items()}
        self.spans, self.joints = {}, {}

    def _span(self, piece: str):
        if piece not in self.spans:  # as many as there are pieces
            self.spans[piece] = self.pieces.spans_of(piece)
        return self.spans[piece]

    def _stable(self, left: str, right: str) -> bool:
        """Whether the two pieces stay apart, the right one being what its characters merge to."""
        n, both, rank, found = len(left), left + right, self.pieces.rank, self._span(right)
        if found is None:
            return False
        for k, birth, death in found[1]:
            for m, born, dead in self._span(left)[0]:
                r = rank.get(both[n - m : n + k])
                if r is not None and r < dead and r <= death and birth < dead and born <= death:
                    return False
        return True

    def ids(self, unit: str) -> list[int]:
        n, ids_of, begins, joints = len(unit), self.ids_of, self.begins, self.joints
        into: list[list[tuple]] = [[] for _ in range(n + 1)]
        for i in range(n):
            into[i + 1].append((i, ids_of.get(unit[i], -1)))
            for j in range(i + 2, n + 1):
                s = unit[i:j]
                if s in begins:
                    if s in ids_of:
                        into[j].append((i, ids_of[s]))
                else:
                    break
        back: list[tuple] = [(0, -1)] * (n + 1)
        if self.kind == "bpe":
            if len(joints) > 300_000:
                joints.clear()
            for j in range(1, n + 1):
                for edge in into[j]:
                    i, b = edge
                    if i == 0:
                        fine = b < 0 or self._span(unit[:j]) is not None
                    else:
                        a = back[i][1]
                        key = a << 32 | b
                        fine = a < 0 or b < 0 or joints.get(key)
                        if fine is None:
                            fine = joints[key] = self._stable(unit[back[i][0] : i], unit[i:j])
                    if fine:
                        back[j] = edge
                        break
        else:
            best, table, low = [0.0] * (n + 1), self.pieces.table, self.pieces.lowest - 10.0
            for j in range(1, n + 1):
                best[j], *edge = max((best[i] + (table[unit[i:j]][1] if b >= 0 else low), i, b) for i, b in into[j])
                back[j] = tuple(edge)
        out: list[list[int]] = []
        while n:
            start, i = back[n]
            out.append([i] if i >= 0 else spelled(unit[start:n], self.pieces))
            n = start
        return [x for part in reversed(out) for x in part]


def _let(value: Column, use) -> Column:
    """Whether ``use(value)`` holds, with the value computed once."""
    return F.exists(F.array(value), use)


def _fold(unit: Column, n: Column, by_end: Column, pieces: Pieces, kind: str) -> Column:
    """Ids of the best path; ``by_end`` holds the edges into each place from 1 on."""
    low = F.lit(ALWAYS).cast("long")
    first_of, last_of = (lambda y: F.shiftright(y, 20).bitwiseAND(low)), (lambda y: y.bitwiseAND(low))

    def broken(best: Column, edge: Column) -> Column:
        """Whether a piece over the joint before ``edge`` would have been merged first."""

        def by(before: Column, cross: Column, y: Column) -> Column:
            at = (edge["start"] - cross["start"] - 1) * 2
            over = (cross["start"] < edge["start"]) & (cross["start"] >= before["start"]) & (cross["rank"] <= last_of(y))
            birth = F.get(before["right"], at)
            return over & _let(F.get(before["right"], at + 1), lambda death: (cross["rank"] < death) & (first_of(y) < death)) & (birth <= last_of(y))

        return _let(
            F.get(best, edge["start"]),
            lambda before: F.exists(edge["left"], lambda y: F.exists(F.get(by_end, edge["start"] + F.shiftright(y, 40).cast("int") - 1), lambda cross: by(before, cross, y))),
        )

    start = F.array(F.expr("struct(0 AS end, -1 AS start, -1 AS rank, -1 AS id, 0D AS score, array() AS right, array() AS left)").cast(EDGE))

    def step(best: Column, edges: Column) -> Column:
        if kind == "bpe":
            top = F.get(F.filter(edges, lambda e: (e["start"] == 0) | ~broken(best, e)), 0)
        else:
            top = F.array_max(F.transform(edges, lambda e: F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), e["start"].alias("start"), e["id"].alias("id"))))
            top = F.struct(F.lit(0).alias("end"), top["start"].alias("start"), F.lit(0).alias("rank"), top["id"].alias("id"), top["score"].alias("score"), F.array().alias("right"), F.array().alias("left")).cast(EDGE)
        return F.concat(best, F.array(top))

    ways = F.aggregate(by_end, start, step)

    def ids_of(edge: Column) -> Column:
        if pieces.first_byte is None:
            return F.array(F.when(edge["id"] < 0, F.lit(pieces.unknown)).otherwise(edge["id"]))
        code = F.hex(F.encode(F.substr(unit, edge["start"] + 1, F.lit(1)), "UTF-8"))
        spelt = F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda k: F.conv(F.substr(code, k, F.lit(2)), 16, 10).cast("int") + pieces.first_byte)
        return F.when(edge["id"] >= 0, F.array(edge["id"])).otherwise(spelt)

    def back(found: Column) -> Column:
        first = F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids"))
        walk = F.aggregate(
            F.sequence(F.lit(1), n), first,
            lambda s, _: F.when(s["at"] == 0, s).otherwise(F.struct(F.get(found, s["at"])["start"].alias("at"), F.concat(ids_of(F.get(found, s["at"])), s["ids"]).alias("ids"))),
        )
        return walk["ids"]

    return F.get(F.transform(F.array(ways), back), 0)


def lattice(units: DataFrame, pieces: Pieces, kind: str = "bpe") -> DataFrame:
    """(unit), distinct and not empty, to (unit, ids array<int>)."""
    spark = units.sparkSession
    # the model's own size; the join is on a hash, which one number makes cheap, and compares the piece itself after it
    columns = "piece string, rank int, id int, score double, right array<int>, left array<bigint>"
    table = spark.createDataFrame(pieces.rows(kind), columns)
    table = F.broadcast(table.select(F.xxhash64("piece").alias("hash"), F.col("piece").alias("named"), "rank", "id", "score", "right", "left"))
    size = F.char_length("unit")
    starts = units.select("unit", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    cut = starts.select("unit", "start", F.explode(F.sequence(F.col("start") + 1, F.least(size, F.col("start") + pieces.longest))).alias("end"))
    cut = cut.withColumn("piece", F.expr("substring(unit, start + 1, end - start)")).withColumn("hash", F.xxhash64("piece"))
    edges = cut.join(table, "hash", "left").where("named = piece OR end = start + 1")
    # a character without a piece is an edge that no merge concerns
    hit = F.col("named") == F.col("piece")
    edge = F.struct(
        "end", "start", F.when(hit, F.col("rank")).otherwise(NEVER).alias("rank"), F.when(hit, F.col("id")).otherwise(-1).alias("id"),
        F.when(hit, F.col("score")).otherwise(pieces.lowest - 10.0).alias("score"), F.when(hit, F.col("right")).otherwise(F.array(F.lit(0), F.lit(ALWAYS))).alias("right"),
        F.when(hit, F.col("left")).otherwise(F.array(F.lit((1 << 40) + ALWAYS).cast("long"))).alias("left"),
    ).cast(EDGE)
    # units are dealt by this key already: no exchange
    grouped = edges.select("unit", edge.alias("edge")).sortWithinPartitions("unit").groupBy("unit").agg(F.collect_list("edge").alias("edges"))
    by_end = F.transform(F.sequence(F.lit(1), size), lambda j: F.filter("edges", lambda e: e["end"] == j))
    ids = F.get(F.transform(F.array(by_end), lambda found: _fold(F.col("unit"), size, found, pieces, kind)), 0)
    return grouped.select("unit", ids.alias("ids"))


def flat_units(texts: pa.Array, pieces: Pieces) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts one after another, and how many each text has."""
    pattern, newline = pieces.unit_pattern(), "\n" if "\n" in pieces.alone else ""
    texts = texts.cast(pa.string()).fill_null("")
    # texts that splitting at single spaces and line ends cuts right; the pattern does the others
    rare = "".join(c for c in pieces.alone + CUT if c != newline)
    plain = pc.invert(pc.match_substring_regex(texts, f"^ |  |{MARK}|[{re.escape(rare)}]"))
    some = texts.filter(pc.and_(plain, pc.not_equal(texts, "")))
    some = pc.replace_substring(pc.binary_join_element_wise(MARK, some, ""), " ", CUT + MARK)
    if newline:
        some = pc.replace_substring(some, newline, CUT + newline + CUT)
    lists = pc.split_pattern(some, CUT)
    flat, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    counts = np.zeros(len(texts), np.int64)
    here = pc.and_(plain, pc.not_equal(texts, "")).to_numpy(zero_copy_only=False)
    counts[here] = np.diff(np.concatenate([[0], np.cumsum(full)])[bounds])
    flat = flat.filter(pa.array(full))
    others = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
    if not len(others):
        return flat, counts
    found = [pattern.findall(marked(t)) for t in texts.take(pa.array(others)).to_pylist()]
    first = np.zeros(len(texts), np.int64)
    first[here] = np.cumsum(counts[here]) - counts[here]
    counts[others] = [len(f) for f in found]
    first[others] = len(flat) + np.cumsum(counts[others]) - counts[others]
    flat = pa.concat_arrays([flat, pa.array([u for f in found for u in f], pa.string())])
    return flat.take(pa.array(ranges(first, counts))), counts


def _count(pieces: Pieces):
    def run(batches):
        yield from counted((flat_units(b.column(0).slice(at, end - at), pieces)[0] for b in batches for at, end in text_slices(b.column(0))), "unit", "n", FLUSH)

    return run


def unit_counts(docs: DataFrame, pieces: Pieces, text_col: str = "text") -> DataFrame:
    """(unit, n) of all distinct units of the texts."""
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    return texts.mapInArrow(_count(pieces), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


class Dictionary:
    """Units and their ids."""

    def __init__(self, units: pa.Array, ids: pa.Array):
        self.lookup = Lookup(units)
        ids = ids.take(pa.array(self.lookup.order))
        self.lookup.order = None
        offsets = ids.offsets.to_numpy()
        self.first, self.ids = offsets - offsets[0], ids.flatten().to_numpy().astype(np.int32)


class Parts:
    """A dictionary on its way: compressed parts, which the driver passes on as they are and each worker puts together once."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.made = parts, None

    def dictionary(self) -> Dictionary:
        if self.made is None:
            found = pa.Table.from_batches([b for p in self.parts for b in pa.ipc.open_stream(p)], HEAD_SCHEMA).combine_chunks()
            self.parts = None
            one = lambda name: pa.concat_arrays(found[name].chunks) if found[name].num_chunks else pa.array([], HEAD_SCHEMA.field(name).type)
            self.made = Dictionary(one("unit"), one("ids"))
            del found
            pa.default_memory_pool().release_unused()
        return self.made


HEAD_SCHEMA = pa.schema([("unit", pa.string()), ("ids", pa.list_(pa.int32()))])


def _packed(batches):
    for b in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, HEAD_SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.list_(pa.int32()))], schema=HEAD_SCHEMA))
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part"])


def head_ids(units: DataFrame, pieces: Pieces, kind: str, head: int) -> Parts:
    """Lattice ids of the units that occur most often, ``head`` at most: all above the least count that fits."""
    total, least = units.count(), 1
    if total > head:
        least, many = 1001, 0
        for r in sorted(units.groupBy(F.least("n", F.lit(1000)).alias("n")).count().collect(), key=lambda r: -r["n"]):
            if many + r["count"] > head:
                break
            least, many = r["n"], many + r["count"]
        total = many
    top = units.where((F.col("n") >= least) & (F.char_length("unit") <= LONG)).select("unit")
    found = lattice(top.repartition(max(1, -(-total // TASK_UNITS)), "unit"), pieces, kind)
    return Parts([bytes(r["part"]) for r in found.mapInArrow(_packed, "part binary").collect()])


def encode(docs: DataFrame, model: str | Pieces, text_col: str = "text", kind: str = "bpe", head: int = HEAD, decoded: str | None = None) -> DataFrame:
    """``docs`` without the text, with ``n_pieces`` (long) and ``ids`` (array<int>).

    ``decoded`` names a column for what ``decode`` makes of the ids, by the same worker: a second one for
    each task would take as much memory again. Null and empty texts have no pieces, an empty table gives an empty one. Rows may repeat, ids may be
    null; input columns named like an output are replaced. Ties between edges into a place can only be
    met by ``unigram`` models; the later start wins.
    """
    spark = docs.sparkSession
    pieces = model if isinstance(model, Pieces) else load(model)
    outputs = ["n_pieces", "ids", *([decoded] if decoded else [])]
    keep = [c for c in docs.columns if c != text_col and c.lower() not in [o.lower() for o in outputs]]
    units = write_table(unit_counts(docs, pieces, text_col), "sp-units")
    known = spark.sparkContext.broadcast(head_ids(units, pieces, kind, head))

    def run(batches):
        words, folder = known.value.dictionary(), Folder(pieces, kind)
        surfaces = pa.array(pieces.surfaces(), pa.binary())
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            for at, end in text_slices(text):
                flat, counts = flat_units(text.slice(at, end - at), pieces)
                coded = flat.dictionary_encode()
                place = words.lookup.find(coded.dictionary)
                n = np.zeros(len(place), np.int64)
                hit = place >= 0
                n[hit] = words.first[place[hit] + 1] - words.first[place[hit]]
                own = [folder.ids(u) for u in coded.dictionary.filter(pa.array(~hit)).to_pylist()]
                n[~hit] = [len(x) for x in own]
                # ids of this slice's distinct units: those of the dictionary, then those folded here
                local = np.concatenate([words.ids[ranges(words.first[place[hit]], n[hit])], np.array([i for x in own for i in x], np.int32)]).astype(np.int32)
                first = np.zeros(len(place), np.int64)
                first[hit] = np.cumsum(n[hit]) - n[hit]
                first[~hit] = int(n[hit].sum()) + np.cumsum(n[~hit]) - n[~hit]
                codes = coded.indices.to_numpy(zero_copy_only=False)
                ids = local[ranges(first[codes], n[codes])]
                ends = np.concatenate([[0], np.cumsum(n[codes])])[np.concatenate([[0], np.cumsum(counts)])]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                cols = [c.slice(at, end - at) for c in batch.columns[:-1]]
                made = [pa.array(np.diff(ends), pa.int64()), lists, *([texts_of(lists, surfaces)] if decoded else [])]
                yield pa.RecordBatch.from_arrays([*cols, *made], names=[*batch.schema.names[:-1], *outputs])

    text_name = fresh([*keep, *outputs], "text")[0]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text_name))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["n_pieces long, ids array<int>", *([f"`{decoded}` string"] if decoded else [])])
    return rows.mapInArrow(run, schema)


def texts_of(ids: pa.Array, surfaces: pa.Array) -> pa.Array:
    """The text that each list of ids stands for; null for null."""
    out = []
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    for at, end in slices(sizes + 1, SLICE):
        part = ids.slice(at, end - at)
        bounds = np.concatenate([[0], np.cumsum(sizes[at:end])])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), surfaces.take(part.flatten())), b"")
        try:
            text = joined.cast(pa.string())
        except pa.ArrowInvalid:
            text = pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())
        text = pc.replace_substring(text, MARK, " ")
        text = pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)
        out.append(pc.if_else(pc.is_valid(part), text, pa.scalar(None, pa.string())))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def decode(df: DataFrame, model: str | Pieces, ids_col: str = "ids", output: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for; null ids give null, no ids the empty text.

    Rows may repeat; a column named like the output is replaced. Bytes that are no UTF-8 become U+FFFD.
    """
    pieces = model if isinstance(model, Pieces) else load(model)
    surfaces = df.sparkSession.sparkContext.broadcast(pieces.surfaces())

    def run(column: pa.Array) -> pa.Array:
        return texts_of(column, pa.array(surfaces.value, pa.binary()))

    df = without(df, output)
    return df.withColumn(output, F.arrow_udf(run, "string")(F.col(f"`{ids_col}`")))


def load(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, decoded_crc32 (of the decoded text, UTF-8) and round_trip of all documents."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "text")
    decoded = encode(docs, path, decoded="decoded")
    crc = F.crc32(F.col("decoded").cast("binary"))
    return decoded.select("doc_id", "n_pieces", "ids", crc.alias("decoded_crc32"), (crc == F.col("text_crc32")).alias("round_trip"))
