"""What the operators share: small text slices from Arrow batches, and rolling fingerprints of byte strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# Bytes of text one slice holds; numpy work arrays are a few dozen times that.
SLICE_BYTES = 1 << 20
MASK = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` of about ``most`` bytes of text; one row at least."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def strings(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset: column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTE_CODES = _table(1, 256)
STEP = 0xD1342543DE82EF95  # odd, so that it can be inverted modulo 2**64
BACK = pow(STEP, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    have, top = 1, base
    while have < n:
        more = min(have, n - have)
        out[have: have + more] = out[:more] * np.uint64(top)
        top = top * top & MASK
        have *= 2
    return out


KEPT: dict[int, np.ndarray] = {}


def kept_powers(base: int, n: int) -> np.ndarray:
    """As ``powers``, computed once for a worker and grown as needed."""
    if len(KEPT.get(base, ())) < n:
        KEPT[base] = powers(base, max(n, SLICE_BYTES + SLICE_BYTES // 4))
    return KEPT[base][:n]


class Rolling:
    """Fingerprints of any substring of a byte array: random byte codes times powers of an odd number, summed."""

    def __init__(self, body: np.ndarray):
        n = len(body)
        self.back = kept_powers(BACK, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[body] * kept_powers(STEP, n), out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """Of every window of ``width`` bytes, by its start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.back[:n] + np.uint64(width))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start .. start + length - 1 of every run, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
