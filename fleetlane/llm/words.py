"""Vectorised word hashing of whole texts.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes with A-Z lower-cased.
A word of up to 256 bytes gets a multilinear 64-bit hash computed by numpy
over the bytes of many words at once; longer words are hashed one by one.
Texts are handled in slices of about 64 KB, cut between words, so
memory does not grow with the length of a text beyond eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from fleetlane.llm.common import mix64

SLICE = 1 << 16
LONG_WORD = 256

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# white space, controls and ASCII punctuation: words are then runs of
# letters, digits and bytes of other scripts
NON_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_POW = mix64(np.arange(1, LONG_WORD + 1, dtype=np.uint64)) | np.uint64(1)


def _spans(buf: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte buffer."""
    inside = ~gaps[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def _hash_slice(data: bytes, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word starts, word hashes) of lower-cased bytes."""
    buf = np.frombuffer(data, np.uint8)
    starts, ends = _spans(buf, gaps)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lens = ends - starts
    small = lens <= LONG_WORD
    whole = bool(small.all())
    s, n = (starts, lens) if whole else (starts[small], lens[small])
    out = np.zeros(len(starts), np.uint64)
    if len(s):
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(first, n)
        v = (buf[at + np.repeat(s, n)].astype(np.uint64) + np.uint64(1)) * _POW[at]
        h = mix64(np.add.reduceat(v, first) + n.astype(np.uint64))
        if whole:
            return starts, h
        out[small] = h
    for i in np.flatnonzero(~small):
        out[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]])
    return starts, out


def _slices(data: bytes) -> Iterator[bytes]:
    """Parts of a text, cut at a space after about SLICE bytes."""
    at = 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            cuts = [x for x in (data.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                    if x >= 0]
            end = min(cuts, default=len(data))
        yield data[at:end]
        at = end


def word_hashes(text: bytes | None, gaps: np.ndarray = WHITE) -> np.ndarray:
    """Hashes of all words of one text, in order; ``gaps`` marks the bytes
    between words."""
    data = (text or b"").lower()
    if len(data) <= SLICE:
        return _hash_slice(data, gaps)[1]
    return np.concatenate([_hash_slice(p, gaps)[1] for p in _slices(data)])


def batch_hashes(texts: list[bytes | None], gaps: np.ndarray = WHITE) -> Iterator[np.ndarray]:
    """word_hashes() of each text; short texts are hashed together."""
    i, n = 0, len(texts)
    while i < n:
        j, size = i, 0
        while j < n and (j == i or size + len(texts[j] or b"") <= SLICE):
            size += len(texts[j] or b"") + 1
            j += 1
        if j == i + 1:
            yield word_hashes(texts[i], gaps)
        else:
            part = [t or b"" for t in texts[i:j]]
            starts, h = _hash_slice(b"\n".join(part).lower(), gaps)
            ends = np.cumsum([len(t) + 1 for t in part])
            cut = np.searchsorted(starts, ends[:-1])
            yield from np.split(h, cut)
        i = j
