"""Brown class-based bigram language model.

Tokens are words (A-Z lower-cased) and one end after each text.  Every
training word is a unit of the exchange clustering: it gets the class that
raises the likelihood of the class bigrams most, given all others' classes.
Words with a larger share than ``known_share`` (a bounded number) and their
classes are sent to every task; all others live in blocks by hash, whose
number follows from the vocabulary and no setting.  A pair of words is kept
in the block of its rarer word, in both blocks if both are rare.  A round
joins each block's pairs with its words' classes, sends the counts (word,
side, class) to the block of the word, and moves a random half of the words
there: those above ``unit_share`` one at a time, the others ``tail_units``
at a time against one table of class bigrams.  The table is summed anew
before each round.

A token's probability is its class's after the class before it, times the
word's within its class, both with add-constant smoothing; every class
keeps the mass of one unseen word.  A word never seen in training has no
class of its own: in each text it gets the one that makes the text most
probable beside the words whose class is known.  Texts are read in chunks of
about ``CHUNK`` bytes; a chunk asks the blocks of its rarer words for their
counts and classes, each word once.

Edge cases: null and blank texts are one end token; with no training texts
all counts are zero; repeated rows are scored alike; a null id is kept;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlane.llm.common import mix64, saved
from fleetlane.llm.words import batch_hashes


@dataclass(frozen=True)
class ClassLmParams:
    classes: int = 32
    unit_share: float = 1 / 30_000    # words moved one at a time: at most 30,000
    known_share: float = 1 / 200_000  # words sent to every task: at most 200,000
    tail_units: int = 1024            # rarer words moved at a time
    block_words: int = 50_000         # words of a block, about
    rounds: int = 6
    smooth: float = 0.5
    seed: int = 3


END = np.uint64(0x5DEECE66D1234567)  # hash of the end token
END_ID = int(np.array([END]).view(np.int64)[0])


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts (each with its end) and first positions."""
    parts, n = [], []
    for h in batch_hashes(texts):
        parts += [h, np.array([END])]
        n.append(len(h) + 1)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def _sum_pairs(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, keys sorted; neither is negative."""
    if not len(keys):
        return keys, n
    bits = int(n.max()).bit_length()
    if int(keys.max()).bit_length() + bits < 64:  # sorting both as one is quicker than ordering by keys
        by, low = keys.dtype.type(bits), keys.dtype.type((1 << bits) - 1)
        x = np.sort(keys << by | n.astype(keys.dtype))
        k, v = x >> by, (x & low).astype(n.dtype)
    else:
        order = np.argsort(keys)
        k, v = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(v, first)


class _Sums:
    """Sums by 64-bit key, compacted as they come, handed out in parts."""

    LIMIT = 2_000_000

    def __init__(self):
        self.keys, self.n, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k), self.n.append(n)
        self.held += len(k)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = _sum_pairs(np.concatenate(self.keys), np.concatenate(self.n))
        self.keys, self.n, self.held = [], [], 0
        return out


def _counted(make, names):
    """mapInArrow: sums of the keys that ``make`` finds in the texts."""
    def fn(batches):
        s = _Sums()
        for b in batches:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            for lo in range(0, len(texts), 200):
                s.add(make(texts[lo:lo + 200]))
            if s.held > s.LIMIT:
                k, n = s.take()
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=names)
        k, n = s.take()
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=names)
    return fn


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def gains(t: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(units x classes) what the class bigram likelihood gains over leaving
    a unit out if it is put into a class, all others staying.  at: classes
    now; left/right: counts of the classes before/after each unit without
    itself; own: counts of the unit after itself; t: class bigrams."""
    m, k = left.shape
    unit = np.arange(m)
    out = np.zeros((m, k))
    few = np.arange(1, 17)[:, None, None]
    for x, y, tt in ((right, left, t.T), (left, right, t)):  # tt[c, b]: the cell that class c and class b share
        e = np.flatnonzero(x != 0)
        u, c, n = e // k, e % k, x.ravel()[e]
        a = at[u]
        if m > 64:  # small counts by a table
            step = _phi(tt + few) - _phi(tt)
            g = step.reshape(-1, k).take((np.minimum(n, 16).astype(np.int64) - 1) * k + c, axis=0)
            many = np.flatnonzero(n > 16)
            cell = tt[c[many]]
            g[many] = _phi(cell + n[many, None]) - _phi(cell)
        else:
            cell = tt[c]
            g = _phi(cell + n[:, None]) - _phi(cell)
        e = np.arange(len(u))
        cell = tt[c, a] - n
        g[e, a] = _phi(cell + n) - _phi(cell)
        same = np.flatnonzero(c == a)  # the unit's own counts are in all these cells
        cell = tt[c[same]] - y[u[same]]
        cell[np.arange(len(same)), a[same]] -= n[same] + own[u[same]]
        g[same] = _phi(cell + n[same, None]) - _phi(cell)
        first = np.flatnonzero(np.diff(u, prepend=-1))
        if len(u):
            out[u[first]] += np.add.reduceat(g, first, axis=0)
    both = left + right + own[:, None]

    def less(row, x):
        """Each unit's copy of a row, less x in its class, and its phi."""
        d, f = np.repeat(row[None, :], m, axis=0), np.repeat(_phi(row)[None, :], m, axis=0)
        d[unit, at] -= x
        f[unit, at] = _phi(d[unit, at])
        return d, f

    d, f = less(t.diagonal(), both[unit, at])
    out += _phi(d + both) + f - _phi(d + left) - _phi(d + right)
    for total, x in ((t.sum(1), right), (t.sum(0), left)):
        n = x.sum(1) + own
        d, f = less(total, n)
        out -= _phi(d + n[:, None]) - f
    return out


def exchange(t: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray,
             alone: np.ndarray, together: int) -> np.ndarray:
    """One sweep over units, those marked ``alone`` first and one by one;
    the last class is the end's and takes none."""
    t, out, k = t.astype(np.float64), at.copy(), len(t)
    rest = np.flatnonzero(~alone)
    for u in [*np.flatnonzero(alone)[:, None], *(rest[i:i + together] for i in range(0, len(rest), together))]:
        g, a = gains(t, out[u], left[u], right[u], own[u]), out[u]
        g[:, -1] = -np.inf
        e = np.arange(len(u))
        b = np.argmax(g, axis=1)
        b = np.where(g[e, b] > g[e, a] + 1e-9, b, a)
        go = b != a
        for c, sign in ((a[go], -1), (b[go], 1)):
            cell = (c[:, None] * k + np.arange(k)).ravel()
            for tt, x in ((t, right), (t.T, left)):
                tt += sign * np.bincount(cell, weights=x[u[go]].ravel(), minlength=k * k).reshape(k, k)
            t[np.arange(k), np.arange(k)] += sign * np.bincount(c, weights=own[u[go]], minlength=k)
        out[u] = b
    return out


# ---- blocks: the word table and the pairs, by hash ----------------------

def _dump(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _load(b: bytes, t: str) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], n, "zstd", asbytes=True) if n else b"", t)


@dataclass
class Blocks:
    """A word's code is its number among the known words or else its hash."""

    known: np.ndarray  # sorted hashes
    number: int
    params: ClassLmParams

    @cached_property
    def _starts(self) -> tuple[np.uint64, np.ndarray, np.ndarray]:
        """Shift of a hash to its slot, the place of each slot's first known word, and the words with an end."""
        bits = len(self.known).bit_length() + 3
        slots = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        return (np.uint64(64 - bits), np.searchsorted(self.known, slots),
                np.append(self.known, np.uint64(0xFFFFFFFFFFFFFFFF)))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the known words, and whether they are the words."""
        shift, start, known = self._starts
        at = start[h >> shift]
        more = np.flatnonzero(known[at] < h)
        while len(more):  # slots hold few words
            at[more] += 1
            more = more[known[at[more]] < h[more]]
        at = np.minimum(at, len(self.known) - 1)
        return at, self.known[at] == h

    def codes(self, h: np.ndarray) -> np.ndarray:
        at, hit = self.find(h)
        return np.where(hit, at.astype(np.uint64), h)

    def of(self, code: np.ndarray) -> np.ndarray:
        return (mix64(code + np.uint64(1)) % np.uint64(self.number)).astype(np.int32)

    def first_class(self, code: np.ndarray) -> np.ndarray:
        x = mix64(code * np.uint64(2 * self.params.seed + 1) + np.uint64(7))
        return (x % np.uint64(self.params.classes)).astype(np.int64)

    def turn(self, code: np.ndarray, turn: int) -> np.ndarray:
        x = mix64(mix64(code + np.uint64(1)) * np.uint64(2 * (self.params.seed + turn // 2) + 1))
        return (x >> np.uint64(7)) % np.uint64(2) == turn % 2


def _numbered(code: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, sorted, and each code's place among them."""
    rare = code >= known
    low = code[~rare].astype(np.int64)
    seen = np.zeros(known, bool)
    seen[low] = True
    words, place = np.unique(code[rare], return_inverse=True)
    at, first = np.empty(len(code), np.int64), np.flatnonzero(seen)
    at[~rare] = (np.cumsum(seen) - 1)[low]
    at[rare] = len(first) + place
    return np.concatenate([first.astype(np.uint64), words]), at


def _dealt(block: np.ndarray, cols: Iterable[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row a block, of flat arrays, which are taken one by one."""
    short = block.astype(np.uint16) if len(block) and block.max() < 1 << 16 else block  # sorted by counting
    order = np.argsort(short, kind="stable")
    block = block[order]
    first = np.flatnonzero(np.diff(block, prepend=-1))
    ends = [*first[1:].tolist(), len(block)]
    dumped = lambda c: pa.array([_dump(c[i:j]) for i, j in zip(first.tolist(), ends)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(block[first], pa.int32()), *(dumped(c[order]) for c in cols)],
                                      names=["block", *names])


_PAIRS = "block int, a binary, b binary, n binary"
_STORED = "block int, words binary, a binary, b binary, n binary"
_SUMS = "block int, u binary, what binary, n binary"
_MOVED = "block int, cls binary, known binary, known_cls binary, moved bigint, offered bigint"


def _pairs(shared):
    """mapInArrow over texts: counted word pairs, dealt to their blocks."""
    def deal(held):
        bl = shared.value
        known = len(bl.known)
        words, at = _numbered(bl.codes(np.concatenate(held)), known)
        held.clear()
        # every text follows an end, and the last token is one
        pair = np.concatenate([at[-1:], at[:-1]]) << 32 | at
        del at
        pair, n = np.unique(pair, return_counts=True)
        a, b = (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)
        del pair
        block, rare = bl.of(words), words >= known
        in_a, in_b = block[a], block[b]
        twice = np.flatnonzero(rare[a] & rare[b] & (in_a != in_b)).astype(np.int32)
        row = np.concatenate([np.arange(len(a), dtype=np.int32), twice])
        into = np.concatenate([np.where(rare[b], in_b, in_a), in_a[twice]])
        return _dealt(into, (f(x[row]) for f, x in ((words.take, a), (words.take, b), (np.asarray, n))),
                      ["a", "b", "n"])

    def fn(batches):
        held, size = [], 0
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for lo in range(0, len(texts), 200):
                held.append(_tokens(texts[lo:lo + 200])[0])
                size += len(held[-1])
                if size > _Sums.LIMIT:
                    yield deal(held)
                    held, size = [], 0
        if held:
            yield deal(held)
    return fn


def _by_block(batches, types: tuple[str, ...]):
    """(block, arrays) of the rows of a partition, which has whole blocks."""
    held: dict[int, list] = {}
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(1 + len(types))]
        for block, *row in zip(*cols):
            held.setdefault(block, []).append(row)
    for block in list(held):
        rows = held.pop(block)
        yield block, [np.concatenate([_load(r[i], t) for r in rows]) for i, t in enumerate(types)]


def _store(shared):
    """mapInArrow over _PAIRS: one row a block, pairs by place in ``words``."""
    def fn(batches):
        for block, (a, b, n) in _by_block(batches, ("<u8", "<u8", "<i8")):
            words, at = _numbered(np.concatenate([a, b]), len(shared.value.known))
            pair, n = _sum_pairs(at[:len(a)] * len(words) + at[len(a):], n)
            cols = words, (pair // len(words)).astype("<i4"), (pair % len(words)).astype("<i4"), n
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), *(pa.array([_dump(x)], pa.binary()) for x in cols)],
                names=["block", "words", "a", "b", "n"])
    return fn


def _stored(batches, bl: Blocks, known_cls: np.ndarray):
    """(block, words, own, their classes or -1, a, b, n) of each row of
    _STORED and ``cls``: classes of the block's own rare words, in order."""
    for batch in batches:
        for r in range(batch.num_rows):
            block, words, a, b, n, cls = (batch.column(i)[r].as_py() for i in range(6))
            words = _load(words, "<u8")
            rare = words >= len(bl.known)
            own = rare & (bl.of(words) == block)
            c = np.full(len(words), -1, np.int64)
            c[~rare] = known_cls[words[~rare].astype(np.int64)]
            c[own] = bl.first_class(words[own]) if cls is None else _load(cls, "i1")
            yield block, words, own, c, _load(a, "<i4"), _load(b, "<i4"), _load(n, "<i8")


LEFT, RIGHT, OWN, STATE, CELL = range(5)


def _sent(shared, known_cls, turn: int | None):
    """mapInArrow over _STORED and cls: what the words' blocks need.  With
    a turn, counts of the classes beside each word whose turn it is; else
    the class bigrams, and of pairs in two blocks the right class."""
    def fn(batches):
        bl = shared.value
        k = bl.params.classes + 1
        for block, words, own, c, a, b, n in _stored(batches, bl, known_cls.value):
            ca, cb = c[a], c[b]
            if turn is None:
                x, both = (ca < 0) & (cb >= 0), (ca >= 0) & (cb >= 0)
                keys, num = [(a[x] * np.int64(8) + RIGHT) * k + cb[x]], [n[x]]
                cells = np.bincount(ca[both] * k + cb[both], weights=n[both], minlength=k * k).astype(np.int64)
            else:
                mine, same = bl.turn(words, turn), a == b
                x, y, z = (cb >= 0) & mine[a] & ~same, (ca >= 0) & mine[b] & ~same, same & mine[a]
                keys = [(a[x] * np.int64(8) + RIGHT) * k + cb[x], (b[y] * np.int64(8) + LEFT) * k + ca[y],
                        (a[z] * np.int64(8) + OWN) * k]
                num, cells = [n[x], n[y], n[z]], np.zeros(0, np.int64)
            key, num = _sum_pairs(np.concatenate(keys), np.concatenate(num))
            unit, what = words[key // (8 * k)], key % (8 * k)
            cell = np.flatnonzero(cells)
            here = np.full(own.sum() + len(cell), block, np.int32)
            yield _dealt(np.concatenate([bl.of(unit), here]),
                         [np.concatenate([unit, words[own], cell.astype(np.uint64)]),
                          np.concatenate([what, STATE * k + c[own], np.full(len(cell), CELL * k)]).astype("<i4"),
                          np.concatenate([num, np.zeros(own.sum(), np.int64), cells[cell]])], ["u", "what", "n"])
    return fn


def _place(u: np.ndarray, words: np.ndarray, known: int) -> np.ndarray:
    """Places of codes among the known ones and, after them, the sorted ``words``."""
    at = u.astype(np.int64)
    rare = u >= known
    at[rare] = known + np.searchsorted(words, u[rare])
    return at


def _received(batches, k: int):
    """(block, sorted rare words, their classes, word, side, class, n)."""
    for block, (u, what, n) in _by_block(batches, ("<u8", "<i4", "<i8")):
        side, c = what // k, what % k
        words, cls = u[side == STATE], c[side == STATE].astype(np.int64)
        order = np.argsort(words)
        x = side != STATE
        yield block, words[order], cls[order], u[x], side[x], c[x], n[x]


def _cells(shared, known_cls):
    """mapInArrow over _SUMS: class bigrams."""
    def fn(batches):
        k = shared.value.params.classes + 1
        t = np.zeros(k * k)
        for _, words, cls, u, side, c, n in _received(batches, k):
            x = side == CELL
            t += np.bincount(u[x].astype(np.int64), weights=n[x], minlength=k * k)
            of = np.concatenate([known_cls.value, cls])[_place(u[~x], words, len(known_cls.value))]
            t += np.bincount(of * k + c[~x], weights=n[~x], minlength=k * k)
        nz = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array(nz), pa.array(t[nz].astype(np.int64))], names=["cell", "n"])
    return fn


def _sweep(shared, known_cls, table: np.ndarray, total: int):
    """mapInArrow over _SUMS: new classes of each block's words."""
    def fn(batches):
        bl, end = shared.value, shared.value.codes(np.array([END]))
        p, k = bl.params, bl.params.classes + 1
        for block, words, cls, u, side, c, n in _received(batches, k):
            at = _place(u, words, len(bl.known))
            seen = np.zeros(len(bl.known) + len(words), bool)
            seen[at] = True
            here = np.flatnonzero(seen)
            unit = np.concatenate([np.arange(len(bl.known), dtype=np.uint64), words])[here]
            at = (np.cumsum(seen) - 1)[at]
            flat = np.bincount((side * np.int64(len(unit)) + at) * k + c, weights=n, minlength=3 * len(unit) * k)
            left, right, own = flat.reshape(3, len(unit), k)
            may = unit != end[0]
            unit, left, right, own = unit[may], left[may], right[may], own[may].sum(1)
            old = np.concatenate([known_cls.value, cls])[here[may]]
            new = exchange(table, old, left, right, own, left.sum(1) + own >= total * p.unit_share, p.tail_units)
            rare = unit >= len(bl.known)
            cls[np.searchsorted(words, unit[rare])] = new[rare]
            blobs = (cls.astype("i1"), unit[~rare], new[~rare].astype("i1"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), *(pa.array([_dump(x)], pa.binary()) for x in blobs),
                 pa.array([int((new != old).sum())]), pa.array([len(unit)])],
                names=["block", "cls", "known", "known_cls", "moved", "offered"])
    return fn


@dataclass
class Model:
    params: ClassLmParams
    cls: np.ndarray          # class of each known word; the last class is the end's
    trans: np.ndarray        # log10 P(class | class before)
    tokens: np.ndarray       # training tokens of each class
    types: np.ndarray        # distinct training words of each class
    known: np.ndarray        # sorted hashes of words scored without a join
    known_n: np.ndarray
    total: int               # N
    distinct: int            # V
    rare: DataFrame | None   # (h, n, c) of all other training words

    def emission(self, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 P(word | class) from the word's count."""
        a = self.params.smooth
        return np.log10((n + a) / (self.tokens[cls] + a * (self.types[cls] + 1)))

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def _texts(docs: DataFrame, text_col: str, where: Column) -> DataFrame:
    return docs.where(where).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def word_counts(docs: DataFrame, training: Column, text_col: str = "text") -> DataFrame:
    """(h, n): count of every token hash in the training texts."""
    d = _texts(docs, text_col, training)
    part = d.mapInArrow(_counted(lambda t: _tokens(t)[0], ["h", "n"]), "h bigint, n bigint")
    return part.groupBy("h").agg(F.sum("n").alias("n"))


# a query's shuffle files go when it has ended
AT_END = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def _conf(spark: SparkSession, key: str, value: str):
    """A session setting for the queries made inside."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def train(docs: DataFrame, counts: DataFrame, training: Column, params: ClassLmParams | None = None,
          text_col: str = "text") -> Model:
    """Cluster and count; ``counts`` is word_counts() of the same texts."""
    p = params or ClassLmParams()
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = total or 0
    # at most 1 / known_share words have that share of all tokens
    share = (F.col("n") >= total * p.known_share) & (F.col("n") > 0) | (F.col("h") == END_ID)
    top = counts.where(share).toArrow()
    h = top["h"].to_numpy().astype(np.int64).view(np.uint64)
    h, n = (h, top["n"].to_numpy()) if len(h) else (np.array([END]), np.zeros(1, np.int64))
    order = np.argsort(h)
    h, n = h[order], n[order]
    k, spark, sc = p.classes, docs.sparkSession, docs.sparkSession.sparkContext
    blocks = Blocks(h, max(1, -(-distinct // p.block_words)), p)
    shared = sc.broadcast(blocks)
    known_cls = np.where(h == END, k, blocks.first_class(np.arange(len(h), dtype=np.uint64)))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(blocks.number, "block")

    # planned without AQE, a checkpoint keeps its partitioning: the pairs stay where they are in every round
    with _conf(spark, *AT_END), _conf(spark, "spark.sql.adaptive.enabled", "false"):
        pairs = dealt(_texts(docs, text_col, training).mapInArrow(_pairs(shared), _PAIRS))
        stored = dealt(pairs.mapInArrow(_store(shared), _STORED)).checkpoint()
    del pairs
    cls = None

    def now() -> DataFrame:
        """Pairs beside the classes of their block's words."""
        if cls is None:
            return stored.withColumn("cls", F.lit(None).cast("binary"))
        return stored.join(cls.hint("merge"), "block", "left").select(*stored.columns, "cls")

    def table() -> np.ndarray:
        c = sc.broadcast(known_cls)
        sent = dealt(now().mapInArrow(_sent(shared, c, None), _SUMS))
        t = np.zeros((k + 1) ** 2)
        for cell, m in (sent.mapInArrow(_cells(shared, c), "cell bigint, n bigint")
                            .groupBy("cell").agg(F.sum("n")).collect()):
            t[cell] = m
        return t.reshape(k + 1, k + 1)

    with _conf(spark, *AT_END):
        for turn in range(p.rounds):
            t, c = table(), sc.broadcast(known_cls)
            sent = dealt(now().mapInArrow(_sent(shared, c, turn), _SUMS))
            moved = sent.mapInArrow(_sweep(shared, c, t, total), _MOVED).checkpoint()
            known_cls = known_cls.copy()
            for u, to in moved.select("known", "known_cls").collect():  # the known words', a bounded number
                known_cls[_load(u, "<u8").astype(np.int64)] = _load(to, "i1")
            cls = moved.select("block", "cls")
        t = table()
    trans = np.log10((t + p.smooth) / (t.sum(1, keepdims=True) + p.smooth * (k + 1)))
    c = sc.broadcast(known_cls)

    def words(batches):
        for _, w, own, of, *_ in _stored(batches, shared.value, c.value):
            yield pa.RecordBatch.from_arrays([pa.array(w[own].view(np.int64)), pa.array(of[own])], names=["h", "c"])

    with _conf(spark, *AT_END):
        rare = (counts.where(~share).join(now().mapInArrow(words, "h bigint, c bigint"), "h")
                      .select("h", "n", "c").checkpoint())
    tokens = np.bincount(known_cls, weights=n, minlength=k + 1)
    types = np.bincount(known_cls, weights=n > 0, minlength=k + 1)
    for r in rare.groupBy("c").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types")).collect():
        tokens[r.c] += r.tokens
        types[r.c] += r.types
    return Model(p, known_cls, trans, tokens, types, h, n.astype(np.float64), total, distinct, rare)


CHUNK = 1 << 22  # bytes of the texts read together, about


def _chunks(batches):
    """(ids, texts) of whole texts, read together."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            ids.append(i), texts.append(t)
            size += len(t) + 64
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


_READ = ("doc_id array<bigint>, n_tokens binary, n_known binary, base binary, score binary, cls binary, place binary, "
         "asks array<struct<block: int, h: binary>>")


def _read(model, shared):
    """mapInArrow: one row a chunk of texts.  Per text what needs no join,
    per token its class (above all: a rarer word), per rarer word its place
    among the chunk's, which are asked of their blocks."""
    def fn(batches):
        m, bl = model.value, shared.value
        k = m.params.classes
        emission, base, some = m.emission(m.known_n, m.cls), m.base(m.known_n), (m.known_n > 0).astype(float)
        for ids, texts in _chunks(batches):
            flat, first = _tokens(texts)
            docs = len(ids)
            at, here = bl.find(flat)
            words, place = np.unique(flat[~here], return_inverse=True)
            block = bl.of(words)
            order = np.argsort(block, kind="stable")
            rank = np.empty(len(order), "<i4")
            rank[order] = np.arange(len(order))
            words, block = words[order], block[order]
            start = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
            asks = [{"block": int(block[i]), "h": words[i:j].tobytes()} for i, j in zip(start, [*start[1:], len(words)])]
            doc, at = np.repeat(np.arange(docs), np.diff(first))[here], at[here]
            total = lambda v: np.bincount(doc, weights=v[at], minlength=docs)
            cls = np.full(len(flat), k + 1, "u1")
            cls[here] = m.cls[at]
            blobs = np.diff(first), total(some).astype("<i8"), total(base), total(emission), cls, rank[place]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), *(pa.array([_dump(x)], pa.binary()) for x in blobs),
                 pa.array([asks], pa.list_(pa.struct([("block", pa.int32()), ("h", pa.binary())])))],
                names=["doc_id", "n_tokens", "n_known", "base", "score", "cls", "place", "asks"])
    return fn


def _told(shared):
    """mapInArrow over (h, n, c): dealt to the words' blocks."""
    def fn(batches):
        for b in batches:
            h, n, c = (b.column(i).to_numpy() for i in range(3))
            h = h.view(np.uint64)
            if len(h):
                yield _dealt(shared.value.of(h), [h, n.astype("<i8"), c.astype("i1")], ["h", "n", "c"])
    return fn


def _answered(batches):
    """mapInArrow over a block's rarer words and, after them, the chunks'
    asks: count and class (-1: never seen in training) of each word."""
    now, told = None, []
    for b in batches:
        col = {x: b.column(x) for x in ("block", "chunk", "h", "n", "c")}
        out = []
        for r in range(b.num_rows):
            block, chunk, h, n, c = (col[x][r].as_py() for x in col)
            if block != now:
                now, told, words = block, [], None
            if chunk is None:
                told.append((_load(h, "<u8"), _load(n, "<i8"), _load(c, "i1")))
                continue
            if words is None:
                words, count, cls = (np.concatenate([np.zeros(1, t), *x]) for t, x in zip(
                    ("<u8", "<i8", "i1"), zip(*told) if told else ((), (), ())))
                order = np.argsort(words[1:]) + 1
                words, count, cls = words[order], count[order], cls[order]
            h = np.frombuffer(h, "<u8")
            n, c = np.zeros(len(h), "<i8"), np.full(len(h), -1, "i1")
            if len(words):
                at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                hit = words[at] == h
                n[hit], c[hit] = count[at[hit]], cls[at[hit]]
            out.append((chunk, block, _dump(n), _dump(c)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
            names=["chunk", "block", "n", "c"])


def _finish(model):
    """mapInArrow: a row per text, its rarer words' counts and classes in ``found``."""
    def fn(batches):
        m = model.value
        k = m.params.classes
        unseen = m.emission(0, np.arange(k))
        for b in batches:
            for r in range(b.num_rows):
                row = {x: b.column(i)[r] for i, x in enumerate(b.schema.names)}
                tokens, known, base, score, cls, place = (_load(row[x].as_py(), t) for x, t in (
                    ("n_tokens", "<i8"), ("n_known", "<i8"), ("base", "<f8"), ("score", "<f8"), ("cls", "u1"),
                    ("place", "<i4")))
                found = sorted(row["found"].as_py() or [], key=lambda x: x["block"])
                n, c = (np.concatenate([np.zeros(0, t), *(_load(x[y], t) for x in found)])
                        for y, t in (("n", "<i8"), ("c", "i1")))
                words = len(n)
                doc = np.repeat(np.arange(len(tokens)), tokens)
                total = lambda d, v: np.bincount(d, weights=v, minlength=len(tokens))
                rare, ref = np.flatnonzero(cls > k), cls.astype(np.int64)
                n, ref[rare] = n[place], c[place]
                before = np.concatenate([[k], ref[:-1]])  # a text follows an end
                new = rare[ref[rare] < 0]
                # a word never seen has one class in a text
                of, uses = np.unique(doc[new] * np.int64(words) + place[ref[rare] < 0],
                                     return_inverse=True, return_counts=True)[1:]
                fit = unseen[None, :] * uses[:, None]
                for beside, t in ((ref[new + 1], m.trans[:k].T), (before[new], m.trans[:, :k])):
                    np.add.at(fit, of[beside >= 0], t[beside[beside >= 0]])
                ref[new] = np.argmax(fit, axis=1)[of]
                before[1:] = ref[:-1]
                score = score + total(doc[rare], m.emission(n, ref[rare])) + total(doc, m.trans[before, ref])
                yield pa.RecordBatch.from_arrays(
                    [row["doc_id"].values, pa.array(tokens), pa.array(known + total(doc[rare], n > 0).astype(np.int64)),
                     pa.array(np.full(len(tokens), m.total, np.int64)), pa.array(base + total(doc[rare], m.base(n))),
                     pa.array(score), pa.array(10.0 ** (-score / tokens))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])
    return fn


def score(docs: DataFrame, counts: DataFrame, model: Model, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score,
    perplexity) per row; ``counts`` are the model's, whose rarer words it
    holds with their classes."""
    sc, p = docs.sparkSession.sparkContext, model.params
    shared = sc.broadcast(replace(model, rare=None))
    number = max(1, -(-model.distinct // p.block_words))
    blocks = sc.broadcast(Blocks(model.known, number, p))
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    read = d.mapInArrow(_read(shared, blocks), _READ)
    read = saved(read.withColumn("chunk", F.monotonically_increasing_id()), "classlm-texts")
    asked = read.select("chunk", F.explode("asks").alias("ask")).select(
        "chunk", "ask.block", "ask.h", *(F.lit(None).cast("binary").alias(x) for x in "nc"))
    told = model.rare.select("h", "n", "c").mapInArrow(_told(blocks), "block int, h binary, n binary, c binary")
    found = (asked.unionByName(told.withColumn("chunk", F.lit(None).cast("bigint"))).repartition(number, "block")
                  .sortWithinPartitions("block", F.col("chunk").asc_nulls_first())
                  .mapInArrow(_answered, "chunk bigint, block int, n binary, c binary")
                  .groupBy("chunk").agg(F.collect_list(F.struct("block", "n", "c")).alias("found")))
    return (read.drop("asks").join(found, "chunk", "left").drop("chunk")
                .mapInArrow(_finish(shared), "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, "
                                             "base_score double, score double, perplexity double"))
