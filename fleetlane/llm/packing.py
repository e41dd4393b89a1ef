"""Packing of tokenised documents into sequences of bounded length.

Each partition tokenises its documents and packs them online in bounded
space: a fixed number of windows is open; a piece goes into the fullest
window it fits (best fit); if none fits, the fullest window is emitted and
a new one opened.  A document longer than a window is first cut into whole
windows and one rest.  At the end the windows still open are merged, some
partitions at a time: best fit again, longest first.

Every piece's place is written to the shared checkpoint folder before the
merge, so a task that runs again after an executor is lost cannot disagree
with what the merge has read.

Edge cases: a null or empty text is one piece that holds only the end id;
repeated rows are packed once each; a null doc_id is kept as it is; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PackParams:
    length: int = 1024
    open_windows: int = 64
    end_id: int = 0
    merge_windows: int = 4096  # open windows merged in one task, about


def _runs(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[start:start + n] of each pair, one after the other."""
    end = np.cumsum(n)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + n, n)]


class _Generation:
    """Cuts and their ids."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.start, self.n, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, keys: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        self.at.update(zip(keys, range(len(self.at), len(self.at) + len(keys))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
        self.n, self.ids = np.concatenate([self.n, n]), np.concatenate([self.ids, ids])


class SegmentTokenizer:
    """Token ids of texts by a byte-level BPE file of ``tokenizers``, equal
    to encode(text, add_special_tokens=False) of the whole text.

    Such a vocabulary never joins bytes across the space before a word, so
    texts are cut before every space that something other than white space
    follows, but not before an added token, which is looked for before words
    are.  The ids of cuts of at most KEY bytes are kept for the worker's next
    tasks, in two generations of at most LIMIT cuts: a full one replaces the
    one before it, and what is met again there moves on.  Texts are handled
    in slices; a cut longer than LONG is cut further where the vocabulary's
    own word pattern cuts it."""

    LIMIT = 200_000
    KEY = 64
    SLICE = 1 << 22
    LONG = 1 << 16
    _OPEN: dict[str, SegmentTokenizer] = {}

    @classmethod
    def of(cls, path: str) -> SegmentTokenizer:
        if path not in cls._OPEN:
            cls._OPEN[path] = cls(path)
        return cls._OPEN[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added]
        # one that takes in white space around it could reach across a cut
        self.whole = any(t.lstrip or t.rstrip or t.single_word or not t.content.split() == [t.content] for t in added)
        nul = self._ids("\0")
        holds = [i for t, i in self.tok.get_vocab().items() if "\u0100" in t]  # how byte-level BPE spells byte 0
        self.nul = int(nul[0]) if nul.tolist() == holds else None
        self.young, self.old = _Generation(), _Generation()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _long(self, cut: str) -> np.ndarray:
        """Ids of a long cut, a window at a time: the word pattern's last
        match may go on behind the window, so the next begins with it."""
        out, at, size = [], 0, self.LONG
        while at < len(cut):
            part = cut[at:at + size]
            last = at + size >= len(cut)
            words = [] if last else self.tok.pre_tokenizer.pre_tokenize_str(part)
            if not last and len(words) < 3:
                size *= 2
                continue
            # white space may be shared out otherwise when more text follows:
            # end at a match that begins and ends with something else
            end = len(part)
            if not last:
                edges = [w[1][0] for w in words[1:-1] if not (part[w[1][0] - 1:w[1][0] + 1].isspace()
                                                               or part[w[1][0]].isspace() or part[w[1][0] - 1].isspace())]
                if not edges:
                    size *= 2
                    continue
                end = edges[-1]
            out.append(self._ids(part[:end]))
            at, size = at + end, self.LONG
        return np.concatenate([np.zeros(0, np.uint32), *out])

    def _encode(self, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each, all ids).  Cuts are encoded many at a time
        with a NUL between them, which no entry of the vocabulary joins to
        other bytes; alone those that hold a NUL or an added token or end in
        white space, and those that start with an apostrophe: after a NUL it
        would be punctuation, not the start of a contraction."""
        cuts = cuts.cast(pa.string())
        alone = pc.or_(pc.utf8_is_space(pc.utf8_slice_codeunits(cuts, -1)), pc.starts_with(cuts, "'"))
        for t in [b"\0", *self.added]:
            alone = pc.or_(alone, pc.match_substring(cuts, t.decode()))
        alone = alone.to_numpy(zero_copy_only=False) if self.nul is not None else np.ones(len(cuts), bool)
        alone |= pc.binary_length(cuts).to_numpy() > self.LONG
        joint = cuts.filter(pa.array(~alone))
        parts = [np.zeros(0, np.uint32)] * len(cuts)
        flat, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(joint):
            runs = pa.ListArray.from_arrays(pa.array([*range(0, len(joint), 64), len(joint)], pa.int32()), joint)
            encoded = self.tok.encode_batch_fast(pc.binary_join(runs, "\0").to_pylist(), add_special_tokens=False)
            flat = np.concatenate([np.array([*e.ids, self.nul], np.uint32) for e in encoded])
            n = np.diff(np.flatnonzero(flat == self.nul), prepend=-1) - 1
            flat = flat[flat != self.nul]
        single = np.flatnonzero(alone)
        if not len(single):
            return n, flat
        ends = np.concatenate([[0], np.cumsum(n)])
        for i, (lo, hi) in zip(np.flatnonzero(~alone).tolist(), zip(ends[:-1].tolist(), ends[1:].tolist())):
            parts[i] = flat[lo:hi]
        for i in single.tolist():
            text = cuts[i].as_py()
            held = any(t in text.encode() for t in self.added)
            parts[i] = self._long(text) if len(text) > self.LONG and not held else self._ids(text)
        return np.array([len(x) for x in parts], np.int64), np.concatenate(parts)

    def _starts(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where cuts start in the bytes of texts that lie between bounds."""
        texts = bounds[:-1][np.diff(bounds) > 0]
        if self.whole or len(buf) < 2:
            return texts
        pad = np.concatenate([buf, np.zeros(3, np.uint8)])
        at = np.flatnonzero(buf == 0x20)
        a, b, c = pad[at + 1], pad[at + 2], pad[at + 3]
        # white space: controls and space of ASCII, and that of other planes
        white = ((a <= 0x20) & (a != 0) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
                 | (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
                 | (a == 0xE3) & (b == 0x80) & (c == 0x80))
        at = at[~white]
        at = at[~np.isin(at, bounds[1:] - 1)]           # a text's last byte
        data = buf.tobytes()
        for t in self.added:
            hits, p = [], data.find(b" " + t)
            while p >= 0:
                hits.append(p)
                p = data.find(b" " + t, p + 1)
            at = at[~np.isin(at, hits)] if hits else at
        here = np.zeros(len(buf), bool)
        here[at] = here[texts] = True
        return np.flatnonzero(here)

    def _slice(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's ids end) of one slice."""
        starts = self._starts(buf, bounds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        offsets = np.append(starts, len(buf)).astype(np.int32)
        cuts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf)])
        coded = cuts.dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary
        keys = words.to_pylist()
        start, n = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        base, todo = 0, np.arange(len(keys))
        for g in (self.young, self.old):
            at = np.fromiter((g.at.get(keys[i], -1) for i in todo), np.int64, len(todo))
            hit = at >= 0
            start[todo[hit]], n[todo[hit]] = base + g.start[at[hit]], g.n[at[hit]]
            base, todo = base + len(g.ids), todo[~hit]
            if g is self.young:
                fresh = todo  # not in the young generation
        every = [self.young.ids, self.old.ids]
        if len(todo):
            n[todo], ids = self._encode(words.take(pa.array(todo)))
            start[todo] = base + np.cumsum(n[todo]) - n[todo]
            every.append(ids)
        every = np.concatenate(every)
        short = fresh[np.fromiter((len(keys[i]) <= self.KEY for i in fresh), bool, len(fresh))][:self.LIMIT]
        if len(self.young.at) + len(short) > self.LIMIT:
            self.young, self.old = _Generation(), self.young
        self.young.add([keys[i] for i in short], _runs(every, start[short], n[short]), n[short])
        ids = _runs(every, start[code], n[code])
        end = np.concatenate([[0], np.cumsum(n[code])])
        return ids, end[np.searchsorted(starts, bounds[1:])]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text."""
        texts = texts.cast(pa.binary())
        bounds = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + self.SLICE, "right")) - 1)
            buf = np.frombuffer(b"".join(texts.slice(lo, hi - lo).to_pylist()), np.uint8)
            if hi == lo + 1 and len(buf) > self.SLICE:
                yield self._one(buf)
            else:
                ids, ends = self._slice(buf, bounds[lo:hi + 1] - bounds[lo])
                yield from np.split(ids, ends[:-1])
            lo = hi

    def _one(self, buf: np.ndarray) -> np.ndarray:
        """A text longer than a slice, cut where cuts start."""
        starts = self._starts(buf, np.array([0, len(buf)]))
        out, lo = [], 0
        while lo < len(buf):
            at = int(np.searchsorted(starts, lo + self.SLICE))
            hi = int(starts[at]) if at < len(starts) else len(buf)
            part = buf[lo:hi].copy()
            out.append(self._slice(part, np.array([0, len(part)]))[0])
            lo = hi
        return np.concatenate(out)


class Packer:
    """Open windows of one partition: place() gives (window, offset)."""

    def __init__(self, p: PackParams, first: int):
        self.p, self.next, self.open = p, first, []

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, n: int) -> tuple[int, int]:
        if n >= self.p.length:
            return self._new(), 0
        at = bisect_right(self.open, (self.p.length - n, float("inf"))) - 1
        if at >= 0:
            used, window = self.open.pop(at)
        else:
            if len(self.open) >= self.p.open_windows:
                self.open.pop()  # emit the fullest
            used, window = 0, self._new()
        if used + n < self.p.length:
            insort(self.open, (used + n, window))
        return window, used


_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
          ("doc_tokens", pa.int64()), ("window", pa.int64()), ("at", pa.int64()), ("left", pa.bool_())]


def _pack(tokenizer: str, p: PackParams):
    def fn(batches):
        tok, part = SegmentTokenizer.of(tokenizer), TaskContext.get().partitionId()
        packer = Packer(p, part << 32)
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), tok.encode(pc.fill_null(b.column(1), ""))):
                ids = np.append(ids, np.uint32(p.end_id)).astype("<u4")
                for s in range(0, len(ids), p.length):
                    piece = ids[s:s + p.length]
                    window, at = packer.place(len(piece))
                    rows.append((doc, s, len(piece), piece.tobytes(), len(ids), window, at, False))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _PIECE)],
                                                 names=[n for n, _ in _PIECE])
        if packer.open:  # the windows still open: length is what they hold
            rows = [(None, None, used, None, None, window, None, True) for used, window in packer.open]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _PIECE)],
                                             names=[n for n, _ in _PIECE])
    return fn


def _merge(p: PackParams):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "window"], ascending=[False, True], kind="stable")
        bins: list[tuple[int, int]] = []  # (used, sequence), sorted
        out = []
        for window, n in zip(pdf["window"].tolist(), pdf["length"].tolist()):
            at = bisect_right(bins, (p.length - n, float("inf"))) - 1
            used, seq = bins.pop(at) if at >= 0 else (0, window)
            insort(bins, (used + n, seq))
            out.append((window, seq, used))
        return pd.DataFrame(out, columns=["window", "seq", "base"])
    return fn


def pack(docs: DataFrame, tokenizer: str, params: PackParams | None = None,
         carry: Mapping[str, Column] | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset) and,
    by default, ``ids`` (little-endian unsigned 32-bit, binary).  ``carry``
    replaces that column by expressions over it."""
    p = params or PackParams()
    carry = {"ids": F.col("ids")} if carry is None else carry
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, window bigint, "
              "at bigint, left boolean")
    placed = (d.mapInArrow(_pack(tokenizer, p), schema)
               .select("doc_id", "start", "length", "doc_tokens", "window", "at", "left",
                       *[c.alias(n) for n, c in carry.items()]).checkpoint())
    left = placed.where("left").select("window", "length")
    groups = max(1, -(-left.count() // p.merge_windows))
    # the windows of a partition go to the same group: about open_windows each
    grp = F.pmod(F.xxhash64(F.shiftright("window", 32)), F.lit(groups))
    merged = (left.withColumn("grp", grp).groupBy("grp")
                  .applyInPandas(_merge(p), "window bigint, seq bigint, base bigint"))
    out = placed.where("not left").join(merged, "window", "left")
    return out.select("doc_id", "start", "length", "doc_tokens",
                      F.coalesce("seq", "window").alias("sequence_id"),
                      (F.col("at") + F.coalesce("base", F.lit(0))).alias("offset"), *carry)
