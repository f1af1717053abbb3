"""Words of many texts at once, in numpy on the UTF-8 bytes.

A word is a run of bytes other than the six white-space characters of ASCII, so words are those of
``[^\\x20\\x09-\\x0D]+``. A word's hash is a polynomial over a random value of each byte, modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at once, and texts that are handled at once.
PIECE = 1 << 20
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, 2 * PIECE)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = both
    return _powers[0], _powers[1]


class Words:
    """starts and ends (bytes of ``data``), hash, and text number of each word; ``first`` has the first word of each text, and the number of words last."""

    def __init__(self, texts: pa.Array, fold: bool = False) -> None:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, at, data = texts.buffers()
        at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        self.data = data[at[0] : at[-1]]
        self.at = at - at[0]
        starts, ends, hashes = [], [], []
        table = _FOLDED if fold else _TABLE
        begins = np.zeros(len(self.data) + 1, bool)
        begins[self.at] = True
        low = 0
        while low < len(self.data):
            high = min(low + PIECE, len(self.data))
            # A piece ends before a white space or where a text begins.
            while high < len(self.data) and not (_SPACE[self.data[high]] or begins[high]):
                step = self.data[high : high + 4096]
                stop = np.flatnonzero(_SPACE[step] | begins[high : high + len(step)])
                high += int(stop[0]) if len(stop) else len(step)
            part = self.data[low:high]
            solid = ~_SPACE[part]
            edge = begins[low : high + 1]
            before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1]
            after = np.concatenate([solid[1:], [False]]) & ~np.concatenate([edge[1:-1], [True]])
            s = np.flatnonzero(solid & ~before)
            e = np.flatnonzero(solid & ~after) + 1
            power, inverse = _power_tables(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[part] * power[: len(part)], out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * inverse[s]))
            starts.append(s + low)
            ends.append(e + low)
            low = high
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.starts, self.ends, self.hash = join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64)
        self.first = np.searchsorted(self.starts, self.at)
        self.first[-1] = len(self.starts)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))


def pieces(batches: Iterable[pa.RecordBatch], column: int, most: int = 4 * PIECE) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches whose texts have about ``most`` bytes at most; a longer text comes alone."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = sizes[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, before + most, "right")))
            yield batch.slice(low, high - low)
            low = high


def binary_column(rows: np.ndarray) -> pa.Array:
    """Rows of a 2-d array as binary values."""
    width = rows.shape[1] * rows.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows))])


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def key_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Batches sorted by their first ``keys`` integer columns, as tables that hold whole groups only."""
    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        changes = np.zeros(len(t), bool)
        for k in range(keys):
            v = batch.column(k).to_numpy(zero_copy_only=False)
            changes[1:] |= v[1:] != v[:-1]
        last = int(np.flatnonzero(changes)[-1]) if changes.any() else 0
        same = waiting and all(waiting[-1].column(k)[-1].as_py() == t.column(k)[0].as_py() for k in range(keys))
        if waiting and not same:
            yield pa.concat_tables(waiting).combine_chunks()
            waiting = []
        if last:
            yield pa.concat_tables([*waiting, t.slice(0, last)]).combine_chunks()
            waiting = []
        waiting.append(t.slice(last))
    if waiting:
        yield pa.concat_tables(waiting).combine_chunks()


def group_bounds(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows begin, and the number of rows."""
    changes = np.zeros(len(columns[0]), bool)
    changes[:1] = True
    for v in columns:
        changes[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(changes), len(columns[0]))
