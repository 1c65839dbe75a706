"""Vectorised words and hashes over the UTF-8 bytes of an Arrow string array."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
#: Longer words are hashed one by one.
_LONG = 64

#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and all that is not ASCII.
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
#: A-Z to a-z, the rest unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a fresh array."""
    h = h ^ (h >> np.uint64(30))
    h *= _K2
    h ^= h >> np.uint64(27)
    h *= _K3
    h ^= h >> np.uint64(31)
    return h


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with 8 zero bytes behind, offsets) of a string or binary array; null counts as empty."""
    array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    n = len(array)
    if not n:
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if large else np.int32
    off = np.frombuffer(offsets, kind)[array.offset : array.offset + n + 1].astype(np.int64)
    lo, hi = int(off[0]), int(off[-1])
    out = np.zeros(hi - lo + 8, np.uint8)
    if hi > lo:
        out[: hi - lo] = np.frombuffer(data, np.uint8)[lo:hi]
    return out, off - lo


@dataclass
class Words:
    """data: the bytes; starts, ends: of each word; first: index of the first word of each text, and the total."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """Index of the text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends, seed)


def find_words(array: pa.Array, word_bytes: np.ndarray, lower: bool = False) -> Words:
    data, off = utf8(array)
    if lower:
        data = LOWER[data]
    body = len(data) - 8
    inside = word_bytes[data[:body]]
    edge = np.empty(body, bool)
    lo, hi = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0]
    edge[:1], edge[1:] = True, ~inside[:-1]
    edge[lo] = True
    starts = np.flatnonzero(edge & inside)
    edge[-1:], edge[:-1] = True, ~inside[1:]
    edge[hi - 1] = True
    ends = np.flatnonzero(edge & inside) + 1
    return Words(data, starts, ends, np.searchsorted(starts, off))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span; data needs 8 bytes behind the last."""
    lens = ends - starts
    at8 = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    h = mix(lens.astype(np.uint64) * _K1 + np.uint64((seed * 0xD1B54A32D192ED03 + 1) & ((1 << 64) - 1)))
    h ^= (at8[starts] & _MASKS[np.minimum(lens, 8)]) * _K1
    h = mix(h)
    more = np.flatnonzero(lens > 8)
    done = 8
    while len(more) and done < _LONG:
        x = at8[starts[more] + done] & _MASKS[np.minimum(lens[more] - done, 8)]
        h[more] = mix(h[more] ^ (x * _K1))
        done += 8
        more = more[lens[more] > done]
    for i in np.flatnonzero(lens > _LONG):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return h


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive values; windows run over all of h, across texts too."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = int(_K1) ^ (seed * 2 + 1) << 7 | 1
    power, out = 1, np.full(n, (k * int(_K2) + seed) & ((1 << 64) - 1), np.uint64)
    for j in range(k):
        out += h[j : j + n] * np.uint64(power)
        power = power * base & ((1 << 64) - 1)
    return mix(out)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Mask over the words: a window of k words of one text starts here."""
    counts = np.diff(first)
    ends = np.repeat(first[1:], counts)
    return np.arange(int(first[0]), int(first[-1])) + k <= ends


def sha_of(parts: bytes) -> str:
    import hashlib

    return hashlib.sha256(parts).hexdigest()


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Mask of n positions that lie in any of the spans."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:-1]) > 0


def joined_words(words: Words, i: int, keep: np.ndarray | None = None) -> bytes:
    """The (kept) words of text i joined by one space."""
    a, b = int(words.first[i]), int(words.first[i + 1])
    if a == b:
        return b""
    starts, ends = words.starts[a:b], words.ends[a:b]
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
        if not len(starts):
            return b""
    lens = ends - starts + 1
    total = int(lens.sum())
    out_at = np.cumsum(lens) - lens
    src = np.arange(total) - np.repeat(out_at - starts, lens)
    out = words.data[src]
    out[out_at + lens - 1] = 0x20
    return out[:-1].tobytes()
