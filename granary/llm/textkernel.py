"""Vectorised text kernel on UTF-8 bytes: word hashes, shingle hashes, distinct sets.

Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z is folded to a-z.
Both act on single ASCII bytes, so they are the same on UTF-8 bytes as on code
points.  Work is done in byte blocks cut between words, so memory does not grow
with the length of a text (a single word longer than a block is hashed whole).

Nulls count as empty texts.  An empty text has no words and no shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK, LONG = 1 << 19, 256
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (the public splitmix64 constants)."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


# A random 64-bit value for each byte, from a counter; folding to lower case is built in.
_AS_IS = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BYTE = _AS_IS[_LOWER]
_P = U64(0xD6E8FEB86659FD93)
_P_INV = U64(pow(int(_P), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "pw" not in _tables or len(_tables["pw"]) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("pw", _P), ("inv", _P_INV)):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            np.multiply.accumulate(a, out=a)
            _tables[name] = a
    return _tables["pw"], _tables["inv"]


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets (int64, from 0)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):  # no chunks at all
        col = pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(col, size: int = BLOCK):
    """(first row, part) of a column in parts of about `size` bytes, a text at least."""
    _, off = utf8(col)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, col.slice(i, j - i)
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) byte places of all words, and n + 1 offsets of each text's words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    sep = separators[data]
    first = np.empty(n, dtype=bool)
    first[0] = True
    first[1:] = sep[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    first[cuts] = True
    first &= ~sep
    last = np.empty(n, dtype=bool)
    last[-1] = True
    last[:-1] = sep[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = True
    last &= ~sep
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, offsets)


def hash_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans (starts and ends ascending), A-Z folded.  Spans of over `LONG`
    bytes have a BLAKE2 digest: long enough texts can be made to collide under a polynomial."""
    value = _BYTE if fold else _AS_IS
    out = np.empty(len(s), dtype=U64)
    i = 0
    while i < len(s):
        base = int(s[i])
        j = max(i + 1, int(np.searchsorted(e, base + BLOCK, side="right")))
        top = int(e[j - 1])
        pw, inv = _powers(top - base + 1)
        h = np.zeros(top - base + 1, dtype=U64)
        np.multiply(value[data[base:top]], pw[: top - base], out=h[1:])
        np.add.accumulate(h, out=h)
        a, b = s[i:j] - base, e[i:j] - base
        out[i:j] = (h[b] - h[a]) * inv[a] + (b - a).astype(U64)
        i = j
    out = mix64(out)
    for k in np.flatnonzero(e - s > LONG):
        own = data[s[k] : e[k]]
        out[k] = int.from_bytes(hashlib.blake2b((_LOWER[own] if fold else own).tobytes(), digest_size=8).digest(), "little")
    return out


def words(col) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column and n + 1 offsets of each text's words."""
    data, off = utf8(col)
    s, e, w = word_spans(data, off)
    return hash_spans(data, s, e), w


_C = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _weight(i: int) -> np.uint64:
    return _C[i] if i < len(_C) else mix64(np.array([i], U64))[0] | U64(1)


def shingles(h: np.ndarray, w: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's k-word shingles in order, and their n + 1 offsets.

    A text with fewer than k words, but at least one, has one shingle: all of them."""
    n = np.diff(w)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    off = np.zeros(len(w), np.int64)
    np.cumsum(count, out=off[1:])
    if not len(h):
        return np.zeros(0, U64), off
    full = np.zeros(max(0, len(h) - k + 1), dtype=U64)
    for i in range(k if len(full) else 0):
        full += h[i : i + len(full)] * _weight(i)
    out = np.empty(int(off[-1]), dtype=U64)
    if len(out):
        doc = np.repeat(np.arange(len(n)), count)
        at = np.arange(len(out)) - off[:-1][doc] + w[:-1][doc]
        long = (n >= k)[doc]
        out[long] = full[at[long]]
        for m in range(1, k):
            short = np.flatnonzero(n == m)
            if len(short):
                x = np.full(len(short), U64(m), dtype=U64)
                for i in range(m):
                    x += h[w[:-1][short] + i] * _weight(i)
                out[off[:-1][short]] = x
    return mix64(out), off


def distinct(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats, and their n + 1 offsets."""
    parts, new = [], np.zeros(len(off), np.int64)
    for i in range(len(off) - 1):
        u = np.unique(x[off[i] : off[i + 1]])
        parts.append(u)
        new[i + 1] = new[i] + len(u)
    return (np.concatenate(parts) if parts else x[:0]), new
