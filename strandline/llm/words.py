"""Words of Arrow text columns as small integer codes, for operators that work on whole texts.

White space is `[\\x20\\x09-\\x0D]+`; a null text has no words. All steps run in Arrow's and numpy's own
loops, so a task pays per distinct word, not per occurrence, for anything that has to look at a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20  # text held at a time by a task


def slices(batches, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about `limit` bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each text starts (one more entry than texts)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[starts[0]:starts[-1]], starts - starts[0]


def strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(np.ascontiguousarray(starts)), pa.py_buffer(data))


def plain_spaces(texts: pa.Array, lower: bool = False) -> pa.Array:
    """Every white-space byte becomes a space; with `lower`, A-Z become a-z."""
    data, starts = buffers(texts)
    data = data.copy()
    data[(data >= 9) & (data <= 13)] = 32
    if lower:
        data[(data >= 65) & (data <= 90)] += 32
    return strings(data, starts)


@dataclass
class Words:
    codes: np.ndarray  # of every word, in order
    starts: np.ndarray  # first word of each text; one more entry than texts
    vocabulary: pa.Array  # by code; may hold an unused empty string

    def __len__(self) -> int:
        return len(self.starts) - 1

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def position(self) -> np.ndarray:
        return np.arange(len(self.codes)) - np.repeat(self.starts[:-1], np.diff(self.starts))


def words(texts: pa.Array, lower: bool = False) -> Words:
    if not len(texts):
        return Words(np.zeros(0, np.int32), np.zeros(1, np.int64), pa.array([], pa.large_string()))
    parts = pc.split_pattern(plain_spaces(texts, lower), " ")
    flat = parts.flatten()
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    there = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    count = np.concatenate(([0], np.cumsum(there)))
    offsets = parts.offsets.to_numpy()
    return Words(codes[there], count[offsets - offsets[0]], coded.dictionary)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed(vocabulary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    data, starts = buffers(vocabulary)
    if not len(vocabulary):
        return np.zeros(0, np.uint64)
    length = np.diff(starts)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts[:-1], length)
    power = powers(int(length.max(initial=0)))
    terms = mix(data.astype(np.uint64) + np.uint64(0x9E37)) * power[place]
    total = np.concatenate(([np.uint64(0)], np.cumsum(terms, dtype=np.uint64)))
    return mix(total[starts[1:]] - total[starts[:-1]] + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def runs(values: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words inside one text, and the index of its first word. values: hashes by word."""
    at = inside(starts, n)
    if not len(at):
        return np.zeros(0, np.uint64), at
    out = np.zeros(len(at), np.uint64)
    for j, p in enumerate(powers(n - 1)):
        out += values[at + j] * p
    return mix(out), at


def inside(starts: np.ndarray, n: int) -> np.ndarray:
    """Indexes at which a run of n words of one text starts."""
    count = np.maximum(np.diff(starts) - n + 1, 0)
    return np.arange(count.sum()) + np.repeat(starts[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count)


def gather(lists: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists `chosen` of a ragged array, one after the other, and where each begins in the result."""
    length = (starts[1:] - starts[:-1])[chosen]
    begin = np.concatenate(([0], np.cumsum(length)))
    return lists[np.arange(begin[-1]) + np.repeat(starts[chosen] - begin[:-1], length)], begin
