"""Hashed n-grams of texts as sparse rows, for many texts at once.

A text is a row of tokens: runs of letters (a-z and all that is not ASCII), of digits, and of
other signs. Two sequences of n-grams are taken from it. The words, lower-cased, alone and in
pairs with the next word; and the shapes of all tokens, alone, in pairs and in threes, where a
word's shape is how its ASCII letters are written and whether it repeats the word before it, and
signs stand for themselves. Each n-gram is a number of `bits` bits; a text's row has the counts
of its numbers, scaled to length one.
"""

from __future__ import annotations

import numpy as np

BITS = 18

_WORD, _DIGITS, _SIGNS = 1, 2, 3
_KIND = np.full(256, _SIGNS, np.int8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[0x30:0x3A] = _DIGITS
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = _WORD

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: An odd number, its inverse modulo 2^64, and numbers that stir the bits of a product.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STIR = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

_SAME, _LOW, _TITLE, _UPPER, _MIXED, _NUMBER = (np.uint64(k) for k in range(1, 7))


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _STIR[0]
    x = (x ^ (x >> np.uint64(27))) * _STIR[1]
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def token_hashes(text: bytes, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, kind, hash, shape) of the tokens of texts that lie in a row, each with a blank at its end."""
    data = np.frombuffer(text, np.uint8)
    kind = _KIND[data]
    edge = np.flatnonzero(np.diff(kind, prepend=np.int8(0)))
    at = edge[kind[edge] != 0]
    ends = np.append(edge, len(data))[np.searchsorted(edge, at) + 1]
    # A token's hash is the polynomial of its bytes; differences of running sums give all at once.
    powers, inverse = _powers(_BASE, len(data)), _powers(_INVERSE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    hashes = _stir((sums[ends] - sums[at]) * inverse[at])
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data != _LOWER[data], out=upper[1:])
    kinds = kind[at]
    doc = np.searchsorted(begins, at, "right") - 1
    n_upper, size = upper[ends] - upper[at], ends - at
    first = data[at] != _LOWER[data[at]]
    shape = np.where(n_upper == 0, _LOW, np.where(first & (n_upper == 1), _TITLE, np.where(n_upper == size, _UPPER, _MIXED)))
    words = np.flatnonzero(kinds == _WORD)
    again = words[1:][(hashes[words[1:]] == hashes[words[:-1]]) & (doc[words[1:]] == doc[words[:-1]])]
    shape[again] = _SAME
    shape = np.where(kinds == _WORD, shape, np.where(kinds == _DIGITS, _NUMBER, hashes))
    return doc, kinds, hashes, shape


def _grams(units: np.ndarray, doc: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of all n consecutive units of one text."""
    size = max(0, len(units) - n + 1)
    mixed = np.full(size, seed, np.uint64)
    for k in range(n):
        mixed = _stir(mixed * np.uint64(_BASE) + units[k:k + size])
    whole = doc[:size] == doc[n - 1:n - 1 + size]
    return doc[:size][whole], mixed[whole]


def sparse_rows(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, numbers, values): the row of text i is numbers[offsets[i]:offsets[i + 1]], in order, with its values."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.cumsum(sizes) - sizes
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    doc, kinds, hashes, shape = token_hashes(b" ".join(texts) + b" ", begins)
    words = kinds == _WORD
    found = [_grams(hashes[words], doc[words], n, n) for n in (1, 2)] + [_grams(shape, doc, n, 10 + n) for n in (1, 2, 3)]
    shift = np.uint64(64 - bits)
    keys = np.concatenate([(d.astype(np.uint64) << np.uint64(bits)) | (h >> shift) for d, h in found])
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(keys))).astype(np.float64)
    owner = (keys[first] >> np.uint64(bits)).astype(np.int64)
    norm = np.sqrt(np.bincount(owner, counts * counts, len(texts)))
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    numbers = (keys[first] & np.uint64((1 << bits) - 1)).astype(np.int32)
    return offsets, numbers, (counts / norm[owner]).astype(np.float32)
