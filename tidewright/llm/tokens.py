"""Hashes of words, word starts and word runs of a batch of texts, computed on flat byte arrays.

A word is a run of ASCII letters and digits and of characters above ASCII, with A-Z in lower case, as in ``common.words_of``."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_CHARS = 500_000
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def free_buffers() -> None:
    """Give back what Arrow's pool holds unused: workers live on after their task and share the executor's memory."""
    pa.default_memory_pool().release_unused()


class Words:
    """Words of texts: ``start``, ``size`` (bytes), ``doc`` for each, and hashes of any byte ranges."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        buf = _LOW[np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)]
        inside = _IN_WORD[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, stop = edge[::2], edge[1::2]
        self.size = stop - self.start
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) + 1
        self.doc = np.searchsorted(ends, self.start, "right")
        self.offsets = np.r_[0, np.cumsum(np.bincount(self.doc, minlength=len(texts)))].astype(np.int64)
        powers = np.full(buf.size, _BASE)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers)])
        inverse = np.full(buf.size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        self._inverse = inverse

    def hashes(self, start: np.ndarray | None = None, size=None, salt: int = 0) -> np.ndarray:
        """64-bit hashes of byte ranges, of all words by default."""
        start = self.start if start is None else start
        size = self.size if size is None else size
        return mix((self._sums[start + size] - self._sums[start]) * self._inverse[start] + np.uint64(salt * int(_BASE) % 2**64))


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch whose texts hold about ``most`` characters at most (or one text)."""
    start, total, texts = 0, 0, batch.column(column).to_pylist()
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > start and total + n > most:
            yield batch.slice(start, k - start), texts[start:k]
            start, total = k, 0
        total += n
    if len(texts) > start:
        yield batch.slice(start), texts[start:]
