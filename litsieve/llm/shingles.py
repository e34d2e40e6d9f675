"""Vectorised word and shingle hashes of whole texts, for use inside Arrow functions."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _power(base: _U, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        out = np.full(size, base, dtype=_U)
        out[0] = 1
        _powers[name] = have = np.multiply.accumulate(out)
    return have[:n]


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in the texts: hash, number of the text, and place in its UTF-8 bytes (start, stop).

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D; A-Z are lower-cased first if `lower`.
    """
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(data), dtype=np.uint8)
    n = len(buf)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(_U), none, none, none
    word = ~_SPACE[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[begins[sizes > 0]] = True
    edge[n] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, ~word[:-1]
    start = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, ~word[1:]
    stop = np.flatnonzero(word & (after | edge[1:])) + 1
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * _power(_BASE, n, "up"), out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * _power(_INVERSE, n, "down")[start] + (stop - start).astype(_U))
    text = np.searchsorted(begins, start, side="right") - 1
    return hashes, text, start - begins[text], stop - begins[text]


def _factors(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    value = np.zeros(max(0, len(hashes) - k + 1), dtype=_U)
    for j, f in enumerate(_factors(k)):
        value += hashes[j : j + len(value)] * f
    return mix(value + _U(k))


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles as (hash, text), sorted by text and hash; with fewer words the whole sequence is one."""
    n = len(hashes)
    counts = np.bincount(text, minlength=n_texts) if n else np.zeros(n_texts, dtype=np.int64)
    factor = _factors(k)
    found, of = [], []
    if n >= k:
        same = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
        found.append(runs(hashes, k)[same])
        of.append(text[same])
    begin = np.cumsum(counts) - counts
    for t in np.flatnonzero((counts > 0) & (counts < k)):
        h = hashes[begin[t] : begin[t] + counts[t]]
        found.append(mix(np.array([(h * factor[: len(h)]).sum(dtype=_U) + _U(len(h))], dtype=_U)))
        of.append(np.array([t]))
    if not found:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    value, of = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[new], of[new]
