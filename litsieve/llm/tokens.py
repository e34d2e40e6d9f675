"""Token ids by the tokenizers library, word by word through a per-worker cache.

A cut at a single space or line end between other characters is a cut between pre-tokens for byte-level and word-end
vocabularies, so the ids of a text are those of its chunks in a row. Chunks recur, so each is encoded once per worker
as long as the cache has room. The cache is a sorted array of 64-bit chunk hashes beside a pool of ids, so a batch is
looked up and put together without a Python object for each word. Texts with runs of white space, with other white space,
or with one of the vocabulary's added tokens are encoded whole, as the library gives them.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .shingles import mix, word_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LOADED: dict[str, ChunkEncoder] = {}
# All white space but the space and the line end; the separator of joined calls; pairs of white space.
_WHITE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_NOT_CUT = (*_WHITE, "\x01", "  ", " \n", "\n ", "\n\n")


def _odd(text: str) -> bool:
    """Whether a text has other white space than single spaces and line ends between other characters."""
    return text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _NOT_CUT)


class ChunkEncoder:
    MOST_CHUNKS = 1_000_000
    CALL_CHARS = 1 << 18

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.signs = {t[0] for t in self.added}
        line = self._whole(["a\nb"])[0]
        self.line_end = self._whole(["\n"])[0].tobytes() if len(line) == 3 else b""  # kept by one vocabulary, dropped by the other
        self.between = "\n" if self.line_end else " \x01 "
        self.mark = int(self._whole(["\n" if self.line_end else "\x01"])[0][0])
        self.cache, self.recent = _Chunks(), _Chunks()

    def _marked(self, text: str) -> bool:
        """Whether a text may hold one of the vocabulary's added tokens, which no chunk may cut."""
        if not any(c in text for c in self.signs):
            return False
        lower = text.lower()
        return any(t in lower for t in self.added)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without line ends, many to a call."""
        out, at = [], 0
        while at < len(chunks):
            upto, size = at, 0
            while upto < len(chunks) and size < self.CALL_CHARS:
                size += len(chunks[upto])
                upto += 1
            ids = self._whole([self.between.join(chunks[at:upto])])[0]
            ends = np.flatnonzero(ids == self.mark).tolist()
            if len(ends) != upto - at - 1:
                raise ValueError("the separator is not a token of its own in this vocabulary")
            data = ids.tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True)]
            at = upto
        return out

    def _fill(self, keys: np.ndarray, words: list[str], kinds: np.ndarray) -> _Chunks:
        """The ids of new chunks; kind 0 begins a text, 1 follows a space, 2 a line end."""
        ids = self._chunks([" " + w if k == 1 else w for w, k in zip(words, kinds.tolist(), strict=True)])
        made = _Chunks.of(keys, [self.line_end + i if k == 2 else i for i, k in zip(ids, kinds.tolist(), strict=True)])
        if len(self.cache) + len(self.recent) + len(made) <= self.MOST_CHUNKS:
            self.recent = self.recent.with_(made)
            if 8 * len(self.recent) > len(self.cache):
                self.cache, self.recent = self.cache.with_(self.recent), _Chunks()
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        plain = ["" if not t or _odd(t) or self._marked(t) else t for t in texts]
        hashes, text, start, stop = word_hashes(plain, lower=False)
        out = [b""] * len(texts)
        if len(hashes):
            data = [t.encode("utf-8", "surrogatepass") for t in plain]
            raw = np.frombuffer(b"".join(data), dtype=np.uint8)
            base = np.cumsum([0] + [len(d) for d in data])[:-1]
            before = raw[np.maximum(base[text] + start - 1, 0)]
            kind = np.where(start == 0, 0, np.where(before == 32, 1, 2))
            keys, index, word = np.unique(mix(hashes + kind.astype(np.uint64)), return_index=True, return_inverse=True)
            offset, size = np.zeros(len(keys), dtype=np.int64), np.full(len(keys), -1, dtype=np.int64)
            pools, shift = [], 0
            tiers = [self.cache, self.recent]
            for tier in tiers:
                at = tier.find(keys)
                hit = np.flatnonzero(at >= 0)
                offset[hit], size[hit] = tier.offset[at[hit]] + shift, tier.size[at[hit]]
                pools.append(tier.pool)
                shift += len(tier.pool)
            new = np.flatnonzero(size < 0)
            if len(new):
                first = index[new]
                words = [data[t][a:b].decode("utf-8", "surrogatepass") for t, a, b in zip(text[first].tolist(), start[first].tolist(), stop[first].tolist(), strict=True)]
                made = self._fill(keys[new], words, kind[first])
                offset[new], size[new] = made.offset + shift, made.size
                pools.append(made.pool)
            lengths = size[word]
            ends = np.cumsum(lengths)
            place = np.repeat(offset[word] - (ends - lengths), lengths) + np.arange(ends[-1])
            ids = np.empty(len(place), dtype="<u4")
            shift = 0
            for pool in pools:
                here = (place >= shift) & (place < shift + len(pool))
                ids[here] = pool[place[here] - shift]
                shift += len(pool)
            upto = np.concatenate([[0], ends])[np.searchsorted(text, np.arange(len(texts) + 1))].tolist()
            out = [ids[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True)]
        for i, t in enumerate(texts):
            if t and not plain[i]:
                out[i] = self._whole([t])[0].tobytes()
        return out


class _Chunks:
    """Sorted chunk keys with the place and number of their ids in a pool."""

    def __init__(self, keys=None, offset=None, size=None, pool=None):
        self.keys = np.zeros(0, dtype=np.uint64) if keys is None else keys
        self.offset = np.zeros(0, dtype=np.int64) if offset is None else offset
        self.size = np.zeros(0, dtype=np.int64) if size is None else size
        self.pool = np.zeros(0, dtype="<u4") if pool is None else pool

    def __len__(self) -> int:
        return len(self.keys)

    @classmethod
    def of(cls, keys: np.ndarray, ids: list[bytes]) -> _Chunks:
        size = np.array([len(i) // 4 for i in ids], dtype=np.int64)
        return cls(keys, np.cumsum(size) - size, size, np.frombuffer(b"".join(ids), dtype="<u4"))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it isn't held."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def with_(self, more: _Chunks) -> _Chunks:
        keys = np.concatenate([self.keys, more.keys])
        order = np.argsort(keys, kind="stable")
        offset = np.concatenate([self.offset, more.offset + len(self.pool)])
        return _Chunks(keys[order], offset[order], np.concatenate([self.size, more.size])[order], np.concatenate([self.pool, more.pool]))


def encoder(path: str) -> ChunkEncoder:
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]


def encode_column(path: str, texts: pa.Array) -> list[bytes]:
    return encoder(path).encode([t or "" for t in texts.to_pylist()])
