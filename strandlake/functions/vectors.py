"""Whole Arrow batches of reads at once in numpy, where a loop over letters would be interpreted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int>"
#: Bytes of the texts that are worked on at a time: what numpy needs for them is some fifty times as much.
CHUNK = 1 << 20


def sliced(texts: pa.Array, most: int | None = None):
    """Neighbouring texts of at most so many bytes together, or one longer text; an empty array as it is."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts) or low == 0:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + (most or CHUNK), side="right")))
        yield texts.slice(low, high - low)
        low = high


def _by_slices(run):
    """run over an array, a slice at a time."""

    def whole(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([run(part) for part in sliced(texts)])

    return whole


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the place at which each text begins (and the last ends)."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    codes = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if codes.max(initial=0) > 127:
        ends = np.concatenate(([0], np.cumsum((codes & 0xC0) != 0x80)))[ends]
        codes = np.frombuffer(codes.tobytes().decode().encode("utf-32-le"), np.uint32)
    return codes, ends


def _spans(start: np.ndarray, end: np.ndarray, known: np.ndarray) -> pa.Array:
    fields = [pa.array(x.astype(np.int32)) for x in (start, end)]
    return pa.StructArray.from_arrays(fields, ["start", "end"], mask=pa.array(~known))


def mean_code(text: Column, offset: int) -> Column:
    """Mean of the code points less offset; null for null and empty texts."""

    def run(texts: pa.Array) -> pa.Array:
        codes, ends = code_points(texts)
        sums = np.concatenate(([0], np.cumsum(codes, dtype=np.int64)))
        n = np.diff(ends)
        means = (sums[ends[1:]] - sums[ends[:-1]] - n * offset) / np.maximum(n, 1)
        return pa.array(means, mask=n == 0)

    return F.arrow_udf(_by_slices(run), "double")(text)


def longest_upper(seq: Column) -> Column:
    """The longest run of A-Z as (start, end), 0-based and inclusive; of equal ones the first, null without."""

    def run(texts: pa.Array) -> pa.Array:
        codes, ends = code_points(texts)
        upper = (codes >= ord("A")) & (codes <= ord("Z"))
        row = np.repeat(np.arange(len(texts)), np.diff(ends))
        same = row[1:] == row[:-1]
        after = np.zeros(len(codes), bool)
        after[1:] = same & upper[:-1]
        before = np.zeros(len(codes), bool)
        before[:-1] = same & upper[1:]
        first, last = np.flatnonzero(upper & ~after), np.flatnonzero(upper & ~before)
        order = np.lexsort((first, first - last, row[first]))
        rows, at = np.unique(row[first][order], return_index=True)
        best = order[at]
        start, end = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        start[rows], end[rows] = first[best] - ends[rows], last[best] - ends[rows]
        return _spans(start, end, np.isin(np.arange(len(texts)), rows))

    return F.arrow_udf(_by_slices(run), SPAN)(seq)


def best_stretch(qual: Column, window: int, threshold: float, left: bool, right: bool, offset: int) -> Column:
    """(start, end) around the first best window, stretched both ways until a window's mean is below the
    threshold; null where even the best one is, or where no window fits."""

    def run(texts: pa.Array) -> pa.Array:
        codes, ends = code_points(texts)
        n, none = np.diff(ends), len(codes) + window
        sums = np.concatenate(([0], np.cumsum(codes, dtype=np.int64)))
        used = np.flatnonzero(n >= window)
        count = n[used] - window + 1
        begins = np.cumsum(count) - count
        place = np.arange(count.sum()) - np.repeat(begins, count)
        at = place + np.repeat(ends[used], count)
        total = sums[at + window] - sums[at] - window * offset
        over = lambda ufunc, values: ufunc.reduceat(values, begins) if len(begins) else values
        most = over(np.maximum, total)
        best = np.repeat(over(np.minimum, np.where(total == np.repeat(most, count), place, none)), count)
        low = total < threshold * window
        start, end = np.zeros(len(texts), np.int64), n - 1
        if left:
            start[used] = over(np.maximum, np.where(low & (place < best), place, -1)) + 1
        if right:
            stop = over(np.minimum, np.where(low & (place > best), place, none))
            end[used] = np.where(stop < none, stop + window - 2, end[used])
        known = np.zeros(len(texts), bool)
        known[used] = most >= threshold * window
        return _spans(start, end, known)

    return F.arrow_udf(_by_slices(run), SPAN)(qual)


def _kmers_of(texts: pa.Array, k: int) -> tuple[list[str], np.ndarray]:
    codes, ends = code_points(texts)
    n = np.clip(np.diff(ends) - k + 1, 0, None)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[:-1], n)
    if k <= 8 and codes.dtype == np.uint8:
        packed = np.zeros(len(at), np.uint64)
        for j in range(k):
            packed = packed << np.uint64(8) | codes[at + j]
        found, times = np.unique(packed, return_counts=True)
        return [int(x).to_bytes(k, "big").decode() for x in found], times
    wide = np.lib.stride_tricks.sliding_window_view(codes.astype(np.uint32), k)[at] if len(at) else np.zeros((0, k), np.uint32)
    found, times = np.unique(np.ascontiguousarray(wide).view(f"V{4 * k}").ravel(), return_counts=True)
    return [x.tobytes().decode("utf-32-le") for x in found], times


def count_kmers(texts: pa.Array, k: int) -> tuple[list[str], np.ndarray]:
    """The different k-mers of the texts and how often each occurs."""
    total: dict[str, int] = {}
    for part in sliced(texts):
        for kmer, n in zip(*_kmers_of(part, k)):
            total[kmer] = total.get(kmer, 0) + int(n)
    return list(total), np.fromiter(total.values(), np.int64, len(total))


def count_places(texts: pa.Array, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pos, value (code point less offset), n: how often each value is at each place of the texts."""
    keys, counts = [], []
    for part in sliced(texts):
        codes, ends = code_points(part)
        place = np.arange(len(codes)) - np.repeat(ends[:-1], np.diff(ends))
        found, times = np.unique(place << 21 | codes.astype(np.int64), return_counts=True)
        keys.append(found)
        counts.append(times)
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    times = np.zeros(len(found), np.int64)
    np.add.at(times, at, np.concatenate(counts))
    return found >> 21, (found & ((1 << 21) - 1)) - offset, times
