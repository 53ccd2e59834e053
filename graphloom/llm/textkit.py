"""Vectorised numpy kernels over Arrow string columns.

Everything here works on the raw UTF-8 bytes of a slice of documents at once: no per-word Python loop.
Words, lines and windows are named by 64-bit polynomial hashes taken from prefix sums, so hashing a word
costs two lookups whatever its length.  Hashes are fixed by constants and agree on every worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PI = pow(_P, -1, 1 << 64)
_Q = 0xC2B2AE3D27D4EB4F | 1
_QI = pow(_Q, -1, 1 << 64)
#: Text bytes handled at a time; scratch memory is some sixty times this.
SLICE_BYTES = 700_000

_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_pows: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _pows.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 12, 1 << int(n + 1).bit_length())
        seed = np.full(size, U(base))
        seed[0] = U(1)
        with np.errstate(over="ignore"):
            have = _pows[base] = np.multiply.accumulate(seed)
    return have[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U(30))
        h = h * U(0xBF58476D1CE4E5B9)
        h = h ^ (h >> U(27))
        h = h * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Slice:
    """Some consecutive documents: `data` holds their bytes, `off` the n + 1 document bounds, `valid` tells nulls."""

    def __init__(self, data: np.ndarray, off: np.ndarray, valid: np.ndarray, first: int):
        self.data, self.off, self.valid, self.first, self.n = data, off, valid, first, len(off) - 1
        self._prefix: dict[bool, np.ndarray] = {}

    def spans(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of member bytes within documents: starts, ends, and the first run of each document (n + 1)."""
        return runs(member[self.data], self.off)

    def prefix(self, lower: bool) -> np.ndarray:
        if lower not in self._prefix:
            n = len(self.data)
            out = np.zeros(n + 1, U)
            with np.errstate(over="ignore"):
                np.cumsum((_LOWER if lower else _TABLE)[self.data] * powers(_P, n)[:n], out=out[1:])
            self._prefix[lower] = out
        return self._prefix[lower]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        c = self.prefix(lower)
        with np.errstate(over="ignore"):
            h = (c[ends] - c[starts]) * powers(_PI, len(self.data))[starts]
            return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))

    def text(self, i: int) -> str:
        return self.data[self.off[i] : self.off[i + 1]].tobytes().decode("utf-8", "replace")


def runs(isin: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(isin)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, ~isin[:-1]
    after[-1], after[:-1] = True, ~isin[1:]
    starts = np.flatnonzero(isin & (before | cut[:-1]))
    ends = np.flatnonzero(isin & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def lines(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """\\n-split lines of every document (a text has one more than it has \\n; a null has none)."""
    nl = np.flatnonzero(s.data == 10)
    at = np.searchsorted(nl, s.off)
    per = np.diff(at) + s.valid
    first = np.concatenate([[0], np.cumsum(per)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    doc = np.repeat(np.arange(s.n), per)
    k = np.arange(first[-1]) - first[doc]
    inner = at[doc] + k
    last = k == per[doc] - 1
    ends[last] = s.off[doc[last] + 1]
    ends[~last] = nl[inner[~last]]
    starts[k == 0] = s.off[doc[k == 0]]
    starts[k > 0] = nl[inner[k > 0] - 1] + 1
    return starts, ends, first


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k items from each position, for positions whose window stays in its document: positions, hashes."""
    n = len(h)
    doc_end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + k <= doc_end) if n else np.zeros(0, np.int64)
    if not len(at):
        return at, np.zeros(0, U)
    c = np.zeros(n + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(h * powers(_Q, n)[:n], out=c[1:])
        return at, mix((c[at + k] - c[at]) * powers(_QI, n)[at] + U(k))


def per_doc_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return c[first[1:]] - c[first[:-1]]


def text_slices(column: pa.Array | pa.ChunkedArray, most: int | None = None) -> Iterator[Slice]:
    """Cuts a string column into slices of about SLICE_BYTES; a longer document is a slice of its own."""
    most = most or SLICE_BYTES
    for a in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(a):
            continue
        if not (pa.types.is_string(a.type) or pa.types.is_large_string(a.type)):
            a = a.cast(pa.large_string())
        wide = np.int64 if pa.types.is_large_string(a.type) else np.int32
        valid = ~np.asarray(a.is_null())
        bufs = a.buffers()
        off = np.frombuffer(bufs[1], wide)[a.offset : a.offset + len(a) + 1].astype(np.int64)
        data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
        if not valid.all() and np.any(np.diff(off)[~valid]):
            a = pa.array(a.to_pylist(), pa.large_string())
            bufs = a.buffers()
            off, data = np.frombuffer(bufs[1], np.int64)[: len(a) + 1], np.frombuffer(bufs[2], np.uint8)
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            j = min(j, len(a), i + 20000)
            yield Slice(data[off[i] : off[j]], off[i : j + 1] - off[i], valid[i:j], i)
            i = j
