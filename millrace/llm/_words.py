"""Words and hashes of whole Arrow batches of texts, vectorised over their bytes.

A word is a maximal run of characters other than the ASCII white space 0x20 and 0x09-0x0D. All of
these are single bytes in UTF-8, so words can be cut on the bytes. Hashes are 64-bit: a polynomial
over per-byte random values (words) or over word hashes (runs of words), modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken in blocks of about so many bytes; a block holds at least one whole text.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240613).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C1B  # odd, 3 modulo 8
_WORD_BASE = 0xD1342543DE82EF93  # odd, 3 modulo 8
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def run_hashes(word_hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` consecutive words (whatever document they lie in)."""
    n = len(word_hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = _prefix(word_hashes, _WORD_BASE)
    inverse = powers(pow(_WORD_BASE, -1, 1 << 64), n)
    return mix((sums[length:] - sums[:-length]) * inverse)


class Block:
    """Consecutive texts as one byte array with the words found in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        solid = ~_SPACE[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = solid[:-1]
        self.starts = np.flatnonzero(solid & (~before | first[:n]))
        after = np.empty(n, dtype=bool)
        after[-1:] = False
        after[:-1] = solid[1:]
        self.ends = np.flatnonzero(solid & (~after | first[1:])) + 1
        #: words of text d: word_offsets[d] .. word_offsets[d + 1]
        self.word_offsets = np.searchsorted(self.starts, offsets)

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    def hashes(self) -> np.ndarray:
        """One hash for each word."""
        sums = _prefix(_BYTE[self.data], _BASE)
        inverse = powers(pow(_BASE, -1, 1 << 64), len(self.data) + 1)
        raw = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        return mix(raw + (self.ends - self.starts).astype(np.uint64))

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.counts())

    def text(self, d: int) -> bytes:
        return self.data[self.offsets[d] : self.offsets[d + 1]].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def blocks(batch: pa.RecordBatch, column: str = "text", lower: bool = False, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first row, row after the last, Block) over the rows of an Arrow batch."""
    rows = batch.num_rows
    if not rows:
        return
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + block_bytes, side="right")) - 1
        stop = min(rows, max(stop, start + 1))
        yield start, stop, Block(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start], lower)
        start = stop
