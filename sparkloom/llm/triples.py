"""Hashed word triples of whole batches of texts, in NumPy.

A text is lower-cased; each longest run of a-z and 0-9 is a word. Its triples are the set of all
three consecutive words, each as a 64-bit hash. No Python object is made per word: words are
hashed by differences of one running polynomial sum over the bytes of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts with fewer words are never alike to any other.
MIN_WORDS = 8
#: Bytes of text handled at once; a longer text is handled alone.
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters() -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    out = np.zeros(256, np.uint64)
    for c in "0123456789abcdefghijklmnopqrstuvwxyz":
        out[ord(c)] = out[ord(c.upper())] = codes[ord(c)]
    return out


_LETTERS = _letters()
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n+1 offsets); nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _lowered(texts: pa.Array) -> pa.Array:
    """The two characters whose lower case holds an ASCII letter, made that letter."""
    texts = pc.replace_substring(texts, "K", "k")  # Kelvin sign
    return pc.replace_substring(texts, "İ", "i̇")  # capital I with dot


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text), in order."""
    data, offsets = _bytes_of(texts)
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if (data == 0xC4).any() or (data == 0xE2).any():
        data, offsets = _bytes_of(_lowered(texts))
    v = _LETTERS[data]
    inside = v != 0
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a text starts here; the last entry is the end
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    start = np.flatnonzero(inside & (~before | first[:-1]))
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * _powers_of(_BASE, len(v)), dtype=np.uint64)])
    h = (total[end] - total[start]) * _powers_of(_INVERSE, len(v))[start]
    h = mix(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return h, np.searchsorted(offsets, start, "right") - 1


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, doc = word_hashes(texts)
    n = len(texts)
    if len(h) < 3:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    long = np.bincount(doc, minlength=n) >= MIN_WORDS
    ok = (doc[2:] == doc[:-2]) & long[doc[:-2]]
    a, b, c = h[:-2][ok], h[1:-1][ok], h[2:][ok]
    t = mix(a * np.uint64(0x9FB21C651E98DF25) + mix(b * np.uint64(0xD6E8FEB86659FD93) + c))
    return distinct(t, doc[:-2][ok], n)


def distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values by owner, ascending; n+1 offsets)."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def triple_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct triple hashes of each text, ascending; n+1 offsets). Null, empty and texts under
    MIN_WORDS words have none. Texts of any length are handled whole."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts, offsets, at, i = [], [np.zeros(1, np.int64)], 0, 0
    ends = np.cumsum(sizes)
    while i < len(texts):
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        values, off = _sets(texts.slice(i, j - i))
        parts.append(values)
        offsets.append(off[1:] + at)
        at += len(values)
        i = j
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.concatenate(offsets)


def set_hash(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit hash per set; equal for equal sets (0 for the empty set)."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    n = np.diff(offsets).astype(np.uint64)
    return np.where(n > 0, mix(total[offsets[1:]] - total[offsets[:-1]] + n), np.uint64(0)).view(np.int64)


def shared(texts_a: pa.Array, texts_b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shared, all distinct) triples of each pair of texts."""
    (va, oa), (vb, ob) = triple_sets(texts_a), triple_sets(texts_b)
    n = len(texts_a)
    na, nb = np.diff(oa), np.diff(ob)
    owner = np.concatenate([np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)])
    _, both = distinct(np.concatenate([va, vb]), owner, n)
    union = np.diff(both)
    return na + nb - union, union


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
