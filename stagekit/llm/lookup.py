"""Runs of text and strings looked up many at a time, for workers that go through Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a worker cuts up at a time.
SLICE = 2 << 20


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), then the same for all others."""
    before = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(first - before, n)


def slices(sizes: np.ndarray, most: int):
    """Runs of rows of about ``most`` in size, a row at least."""
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


def text_slices(column: pa.Array, most: int = SLICE):
    """``slices`` of a column of texts; between them Arrow gives back the memory that it keeps for itself."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for at, end in slices(sizes + 1, most):
        yield at, end
        pa.default_memory_pool().release_unused()


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts with A-Z lowered, one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    flat = lists.flatten()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    full = pc.not_equal(flat, "")
    counts = np.diff(np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[bounds])
    return flat.filter(full), counts


def counted(runs, name: str, number: str, most: int):
    """Batches of the distinct strings in ``runs`` and how often they occur; a string comes again after ``most`` others."""
    seen, n = [], 0

    def merged() -> pa.Table:
        return pa.Table.from_batches(seen).group_by(name).aggregate([(number, "sum")]).rename_columns([name, number])

    for run in runs:
        found = run.value_counts()
        seen.append(pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=[name, number]))
        n += len(found)
        if n > 2 * most:
            table = merged()
            seen, n = table.to_batches(), len(table)
            if n > most:
                yield from seen
                seen, n = [], 0
    if seen:
        yield from merged().to_batches()


_WIDE = 64
#: Bytes that are hashed at a time.
HASHED = 1 << 18
_PARTS = np.random.default_rng(1).integers(0, 2**64, _WIDE * 256, np.uint64)


def hashes_of(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: a number for each byte and its place (modulo 64, with the round), summed and mixed."""
    strings = strings.cast(pa.large_binary())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    size = np.diff(offsets)
    out = size.astype(np.uint64)
    # some ten numbers a byte: a run of strings at a time
    for at, end in slices(size, HASHED):
        if offsets[end] > offsets[at]:
            first = offsets[at : end + 1] - offsets[at]
            data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[at] : offsets[end]]
            place = np.arange(len(data)) - np.repeat(first[:-1], size[at:end])
            part = _PARTS[place % _WIDE * 256 + data] * (place // _WIDE * 2 + 1).astype(np.uint64)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
            out[at:end] += total[first[1:]] - total[first[:-1]]
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(32)


class Lookup:
    """Distinct strings in the order of their hashes; ``order`` is that order. A hit compares the strings themselves."""

    def __init__(self, strings: pa.Array):
        hashes = hashes_of(strings)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.strings = hashes[self.order], strings.take(pa.array(self.order))

    def find(self, strings: pa.Array, hashes: np.ndarray | None = None) -> np.ndarray:
        """Places of the strings, -1 where they are not here."""
        if not len(self.hashes) or not len(strings):
            return np.full(len(strings), -1, np.int64)
        hashes = hashes_of(strings) if hashes is None else hashes
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = pc.equal(self.strings.take(pa.array(at)), strings).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1)
