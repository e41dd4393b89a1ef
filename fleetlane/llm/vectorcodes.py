"""Vector codes by product quantisation with Drake-Hamerly adaptive bounds.

Components become integers, floor(scale x); a vector is cut into equal
parts and every part position has a codebook of integer entries, trained by
rounds of nearest-entry assignment and floored means.  All decisions are in
64-bit integers.

What makes a round cheap is the state kept for each part between rounds: its
entry, its b closest other entries in order with lower bounds on their
distance, and one outer bound on the distance to all the rest.  The bound of
a rank holds for every entry at that rank or beyond it, so the bounds are
ordered.  When entries move, bounds sink by the distances moved; the part's
distance to its own entry is computed anew.  If it is below all bounds, the
part keeps its entry.  Otherwise only the entries whose bounds it reaches
are compared, in exact integers (lower index wins a tie); if it reaches the
outer bound, all entries are.  Bounds are rounded down and distances up, so
rounding can only cost a comparison.  After each round b becomes the
smallest that would have been enough for nearly all undecided parts; it
only shrinks, and dropped ranks move into the outer bound.

State and vectors are written between rounds to the shared folder, read
and rewritten without a shuffle.  A task hands on one sum per entry, so an
entry that holds a third of all parts costs no more than another; codebooks
(entries x dimension integers) are the only thing the driver collects.

Edge cases: vectors that are null or hold null or non-finite components are
dropped.  The width is that of the smallest vec_id; a width that is no
multiple of the parts is filled up with zeros.  Vectors of another width,
and those with components so large that a squared distance might not fit 62
bits, stay with null code and error and take no part in training.  Repeated
rows are rows of their own, but an id gives one entry at the start (of its
vectors, the first by bytes).  A null vec_id is coded and starts no entry; a null label
is a label of its own.  Fewer ids than entries give a smaller codebook, no
ids at all null codes; an empty table gives no rows.  Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlane.llm.common import discard, saved

CELLS = 1 << 22          # integers of a work area
HISTOGRAM = 64           # ranks told apart when b is adapted


@dataclass(frozen=True)
class CodeParams:
    parts: int = 4
    entries: int = 256       # at most 256: an index is one byte
    rounds: int = 4
    scale: int = 1024
    closest: int = 24        # first b
    least: int = 2           # b never falls below it
    enough: float = 0.98     # share of undecided parts that b should serve


def finite(v: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad, F.lit(False))


# ---- one part position, vectorised over parts -----------------------------

def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _exact(x: np.ndarray, book: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each part to its own list of entries."""
    out = np.empty(ids.shape, np.int64)
    step = max(1, CELLS // max(1, ids.shape[1] * book.shape[1]))
    for i in range(0, len(x), step):
        d = x[i:i + step, None, :] - book[ids[i:i + step]]
        out[i:i + step] = np.einsum("nbd,nbd->nb", d, d)
    return out


def _all(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each part to all entries: a matrix product in
    doubles where every sum is exact, else in integers."""
    reach = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * reach * reach * book.shape[1] < 1 << 52:
        f, g = x.astype(np.float64), book.astype(np.float64)
        d = (f * f).sum(axis=1)[:, None] - 2 * (f @ g.T) + (g * g).sum(axis=1)[None, :]
        return d.astype(np.int64)
    return _exact(x, book, np.broadcast_to(np.arange(len(book)), (len(x), len(book))))


@dataclass
class Bounds:
    """State of n parts: own entry, the b closest others, their ordered
    lower bounds, the outer bound."""
    own: np.ndarray      # uint8 (n)
    near: np.ndarray     # uint8 (n, b)
    low: np.ndarray      # float32 (n, b)
    outer: np.ndarray    # float32 (n)

    @classmethod
    def full(cls, x: np.ndarray, book: np.ndarray, b: int) -> Bounds:
        """Search among all entries."""
        n, k = len(x), len(book)
        b = min(b, k - 1)
        out = cls(np.empty(n, np.uint8), np.empty((n, b), np.uint8), np.empty((n, b), np.float32),
                  np.full(n, np.inf, np.float32))
        step = max(1, CELLS // k)
        for i in range(0, n, step):
            d = _all(x[i:i + step], book)
            best = d.argmin(axis=1)                       # the first of equals
            rows = np.arange(len(d))
            out.own[i:i + step] = best
            d[rows, best] = np.iinfo(np.int64).max
            keep = min(b + 1, k - 1)
            if keep:
                at = np.argpartition(d, keep - 1, axis=1)[:, :keep]
                at = np.take_along_axis(at, np.take_along_axis(d, at, 1).argsort(axis=1, kind="stable"), 1)
                low = _down(np.sqrt(np.take_along_axis(d, at, 1).astype(np.float64)))
                out.near[i:i + step], out.low[i:i + step] = at[:, :b], low[:, :b]
                if keep > b:
                    out.outer[i:i + step] = low[:, b]
        return out

    def take(self, b: int) -> Bounds:
        """The same with only b ranks; the first dropped bound is the outer
        one, as it holds for all ranks from there on."""
        if b >= self.near.shape[1]:
            return self
        return Bounds(self.own, self.near[:, :b].copy(), self.low[:, :b].copy(), self.low[:, b].copy())

    def moved(self, x: np.ndarray, book: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Assign again after entries moved by ``shift`` (rounded up).
        Returns the ranks each part had to look at: 0 where bounds decided,
        b + 1 where all entries were searched."""
        b = self.near.shape[1]
        self.outer = _down(self.outer.astype(np.float64) - shift.max(initial=0.0))
        self.low = _down(self.low.astype(np.float64) - shift[self.near])
        if b:
            self.low[:, -1] = np.minimum(self.low[:, -1], self.outer)
            self.low = np.minimum.accumulate(self.low[:, ::-1], axis=1)[:, ::-1].copy()
        mine = _exact(x, book, self.own[:, None])[:, 0]
        u = np.sqrt(mine.astype(np.float64)) * (1 + 1e-12)
        need = (self.low <= u[:, None]).sum(axis=1)       # bounds are ordered: a prefix
        need[self.outer <= u] = b + 1
        some = np.flatnonzero((need > 0) & (need <= b))
        # parts that need like numbers of ranks are compared together
        for lo, hi in zip((1, 2, 4, 8, 16, 32, 64, 128), (1, 3, 7, 15, 31, 63, 127, 255)):
            at = some[(need[some] >= lo) & (need[some] <= hi)]
            if len(at):
                self._compare(at, x, book, mine, min(hi, b))
        everywhere = np.flatnonzero(need == b + 1)
        if len(everywhere):
            f = Bounds.full(x[everywhere], book, b)
            self.own[everywhere], self.near[everywhere] = f.own, f.near
            self.low[everywhere], self.outer[everywhere] = f.low, f.outer
        return need

    def _compare(self, at: np.ndarray, x: np.ndarray, book: np.ndarray, mine: np.ndarray, w: int) -> None:
        """Exact comparison with the first w ranks; entries and bounds of
        those ranks are put in order."""
        ids = np.concatenate([self.own[at, None], self.near[at, :w]], axis=1)
        d = np.concatenate([mine[at, None], _exact(x[at], book, self.near[at, :w])], axis=1)
        order = np.lexsort((ids, d), axis=1)
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        self.own[at], self.near[at, :w] = ids[:, 0], ids[:, 1:]
        low = self.low[at]
        low[:, :w] = _down(np.sqrt(d[:, 1:].astype(np.float64)))
        if w < low.shape[1]:
            low[:, w - 1] = np.minimum(low[:, w - 1], low[:, w])
        else:
            low[:, w - 1] = np.minimum(low[:, w - 1], self.outer[at])
        self.low[at] = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]


# ---- tables ----------------------------------------------------------------

# rows of kind 0 are vectors with their state; of kind 1 a task's sums per
# part and entry; of kind 2 a task's histogram of ranks looked at
_STATE = ("kind int, vec_id bigint, label string, x binary, own binary, near binary, low binary, outer binary, "
          "error bigint, part int, entry int, n bigint, sums array<bigint>")
_NAMES = [c.split()[0] for c in _STATE.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.string(), *[pa.binary()] * 5, pa.int64(), pa.int32(), pa.int32(), pa.int64(),
          pa.list_(pa.int64())]


def _batch(rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t)
                                       for c, t in zip(_NAMES, _TYPES)], names=_NAMES)


def _cut(a: np.ndarray) -> list[bytes]:
    """One byte string per row."""
    a = np.ascontiguousarray(a)
    data, step = a.tobytes(), a[:1].nbytes
    return [data[i:i + step] for i in range(0, len(data), step)] if step else [b""] * len(a)


def _joined(column: pa.Array, dtype, shape: tuple) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(shape)


def _assign(p: CodeParams, books: list[np.ndarray], shifts: list[np.ndarray] | None, was: int, b: int, last: bool):
    """One round over vectors (first, ``shifts`` is None) or rows of _STATE
    that hold ``was`` ranks: writes them with b ranks, sums and histogram."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, (k, d) = len(books), books[0].shape
        sums = np.zeros((size, k, d), np.int64)
        count = np.zeros((size, k), np.int64)
        looked = np.zeros((size, HISTOGRAM + 2), np.int64)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            x = _joined(col["x"], np.int32, (n, size, d)).astype(np.int64)
            if shifts is not None:
                own, near, low, outer = (_joined(col[c], t, (n, size) if c in ("own", "outer") else (n, size, was))
                                         for c, t in (("own", np.uint8), ("near", np.uint8), ("low", np.float32),
                                                      ("outer", np.float32)))
            states, error = [], np.zeros(n, np.int64)
            for m in range(size):
                if shifts is None:
                    s = Bounds.full(x[:, m], books[m], b)
                else:
                    s = Bounds(own[:, m].copy(), near[:, m].copy(), low[:, m].copy(), outer[:, m].copy()).take(b)
                    need = s.moved(x[:, m], books[m], shifts[m])
                    need = np.where(need > s.near.shape[1], HISTOGRAM + 1, np.minimum(need, HISTOGRAM))
                    looked[m] += np.bincount(need, minlength=HISTOGRAM + 2)
                states.append(s)
                np.add.at(sums[m], s.own, x[:, m])
                count[m] += np.bincount(s.own, minlength=k)
                if last:
                    error += _exact(x[:, m], books[m], s.own[:, None])[:, 0]
            out = {"kind": np.zeros(n, np.int32), "vec_id": col["vec_id"], "label": col["label"],
                   "own": _cut(np.stack([s.own for s in states], 1))}
            if last:
                out["error"] = error
            else:
                out |= {"x": col["x"], "near": _cut(np.stack([s.near for s in states], 1)),
                        "low": _cut(np.stack([s.low for s in states], 1)),
                        "outer": _cut(np.stack([s.outer for s in states], 1))}
            yield _batch(n, **out)
        m, j = np.nonzero(count)
        if len(m) and not last:
            yield _batch(len(m), kind=np.ones(len(m), np.int32), part=m, entry=j, n=count[m, j],
                         sums=list(sums[m, j]))
        m, j = np.nonzero(looked)
        if len(m):
            yield _batch(len(m), kind=np.full(len(m), 2, np.int32), part=m, entry=j, n=looked[m, j])
    return fn


def _means(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The next codebooks: floored means of what each entry holds."""
    d = books[0].shape[1]
    got = (state.where("kind = 1").groupBy("part", "entry")
                .agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(d)]).collect())
    books = [b.copy() for b in books]
    for r in got:  # at most parts x entries rows
        books[r["part"]][r["entry"]] = np.array(r[3:], np.int64) // r["n"] if r["n"] else 0
    return books


def _shifts(old: list[np.ndarray], new: list[np.ndarray]) -> list[np.ndarray]:
    """How far each entry moved, rounded up."""
    out = []
    for a, b in zip(old, new):
        d = (b - a).astype(np.float64)
        out.append(np.sqrt((d * d).sum(axis=1)) * (1 + 1e-9))
    return out


def _adapted(state: DataFrame, b: int, p: CodeParams) -> int:
    """The smallest b that would have served ``enough`` of the parts that
    bounds did not decide."""
    seen = {r[0]: r[1] for r in state.where("kind = 2 and entry > 0").groupBy("entry").agg(F.sum("n")).collect()}
    total, served = sum(seen.values()), 0
    for rank in range(1, b + 1):
        served += seen.get(rank, 0)
        if rank >= p.least and served >= p.enough * total:
            return rank
    return b


def _integers(rows: DataFrame, width: int, p: CodeParams) -> DataFrame:
    """(vec_id, label, x) of the vectors that can be coded: 32-bit integers,
    zeros up to a multiple of the parts."""
    d = -(-width // p.parts)
    limit = min(2.0 ** 31 - 1, np.floor(np.sqrt(2.0 ** 62 / max(1, d * p.parts)) / 2))

    def fn(batches):
        for b in batches:
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(b), width)
            with np.errstate(over="ignore"):
                v = np.floor(v * float(p.scale))
            ok = (np.abs(v) <= limit).all(axis=1)
            x = np.zeros((len(b), d * p.parts), np.int32)
            x[ok, :width] = v[ok]
            cells = [c if k else None for c, k in zip(_cut(x), ok.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.binary())],
                                             names=["vec_id", "label", "x"])

    r = rows.where(F.size("v") == width).select("vec_id", "label", "v")
    return r.mapInArrow(fn, "vec_id bigint, label string, x binary")


def encode(vectors: DataFrame, params: CodeParams | None = None, id_col: str = "vec_id",
           vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes, error) per row - codes one byte per part - and
    the codebooks, one (entries x part width) integer array per part."""
    p = params or CodeParams()
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("v")).where(finite(F.col("v")))
    first = rows.where("vec_id is not null").select("vec_id", F.size("v").alias("w")).orderBy("vec_id", "w").first()
    width = first["w"] if first else 0
    null = [F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("bigint").alias("error")]
    if not width:
        return rows.select("vec_id", "label", *null), []
    whole = saved(_integers(rows, width, p), "codes-vectors")
    start = (whole.where("vec_id is not null and x is not null").groupBy("vec_id").agg(F.min("x").alias("x"))
                  .orderBy("vec_id").limit(p.entries).collect())
    uncoded = (rows.where(F.size("v") != width).select("vec_id", "label", *null)
                   .unionByName(whole.where("x is null").select("vec_id", "label", *null)))
    if not start:
        return uncoded, []
    x = np.array([np.frombuffer(r["x"], np.int32) for r in start], np.int64)
    books = [b.copy() for b in np.split(x, p.parts, axis=1)]

    b = was = min(p.closest, len(books[0]) - 1)
    state = saved(whole.where("x is not null").mapInArrow(_assign(p, books, None, 0, b, False), _STATE), "codes-state")
    for done in range(1, p.rounds + 1):
        last = done == p.rounds
        new = _means(state, books)
        after = state.where("kind = 0").mapInArrow(_assign(p, new, _shifts(books, new), was, b, last), _STATE)
        after = saved(after, "codes-state")
        discard(state)
        state, books, was = after, new, b
        b = _adapted(state, b, p)
    coded = state.where("kind = 0").select("vec_id", "label", F.col("own").alias("codes"), "error")
    return coded.unionByName(uncoded), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components, by part, entry and position."""
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def codes(vectors: DataFrame, params: CodeParams | None = None, id_col: str = "vec_id",
          vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) per vector."""
    coded, books = encode(vectors, params, id_col, vec_col, label_col)
    by = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    return (coded.join(by, F.col("label").eqNullSafe(F.col("l")))
                 .select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
                         F.lit(digest(books)).alias("codebooks_sha256")))
