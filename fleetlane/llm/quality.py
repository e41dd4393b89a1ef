"""Text quality by a factorisation machine.

Inputs of a score are hashed words (log counts, scaled to unit length),
structure statistics of the text (each cut into ten bins) and, where the
table has it, the character count kept as metadata (binned too).  The model
adds a weight per input and, for every pair of inputs, the product of their
low-rank vectors; the pair sum is computed in linear time as half the sum
over factors of (sum v x)^2 - sum (v x)^2.

It is fitted with Adam on log loss over a bounded sample of the labelled
rows of the training folds (``max_train_rows``, those with the smallest
hashed ids); bins are quantiles of that sample.

Edge cases: null and blank texts are scored as empty texts; null labels are
not learnt from; a label repeated for a doc_id counts once (the smallest);
no usable labels give the constant score 0.5; an empty table gives no rows;
repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlane.llm.common import fold
from fleetlane.llm.words import batch_hashes


@dataclass(frozen=True)
class FmParams:
    word_log2: int = 11          # 2^n hashed word inputs
    bins: int = 10
    rank: int = 8
    epochs: int = 12
    batch: int = 128
    rate: float = 0.02
    decay: float = 1e-5
    max_train_rows: int = 8000   # bound of the labelled sample
    seed: int = 11


STATS = ("bytes", "words", "upper", "digit", "punct", "other", "lines", "word_len", "distinct",
         "top_word", "same_next", "distinct_pairs", "short_words", "long_words", "n_chars")

_CLASS = np.zeros((6, 256), bool)
_CLASS[0, 65:91] = True                                        # upper case
_CLASS[1, 48:58] = True                                        # digits
_CLASS[2] = [32 < b < 127 and not chr(b).isalnum() for b in range(256)]
_CLASS[3, 128:] = True                                         # non-ASCII bytes
_CLASS[4, 10] = True                                           # line ends
_CLASS[5, [32, 9, 10, 11, 12, 13]] = True                      # white space


def features(texts: list[bytes | None], n_chars: list[int | None],
             p: FmParams) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per text: (word inputs, values), and a row of STATS."""
    words, stats = [], np.zeros((len(texts), len(STATS)))
    mask = np.uint64((1 << p.word_log2) - 1)
    for r, (t, meta, h) in enumerate(zip(texts, n_chars, batch_hashes(texts))):
        t = t or b""
        count = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        size, n = max(1, len(t)), max(1, len(h))
        upper, digit, punct, other, lines, white = (int(count[c].sum()) for c in _CLASS)
        hs, uses = np.unique(h, return_counts=True)
        pair = h[1:] * np.uint64(3) + h[:-1]
        stats[r] = (np.log1p(len(t)), np.log1p(len(h)), upper / size, digit / size, punct / size, other / size,
                    (lines + 1) / n, (size - white) / n, len(hs) / n ** 0.8, uses.max(initial=0) / n,
                    np.count_nonzero(h[1:] == h[:-1]) / n, (len(np.unique(pair)) + 1) / n,
                    0.0, 0.0, np.log1p(max(0, meta if meta is not None else 0)) - np.log1p(len(t)))
        cut = np.flatnonzero(_CLASS[5][np.frombuffer(t, np.uint8)])
        gap = np.diff(np.concatenate([[-1], cut, [len(t)]])) - 1
        gap = gap[gap > 0]
        stats[r, 12:14] = np.count_nonzero(gap <= 2) / n, np.count_nonzero(gap > 15) / n
        at, c = np.unique((hs & mask).astype(np.int64), return_inverse=True)
        v = np.log1p(np.bincount(c, weights=uses, minlength=len(at)))
        words.append((at, (v / max(np.sqrt((v * v).sum()), 1e-9)).astype(np.float32)))
    return words, stats


class Model:
    """w0, weights w and low-rank vectors v over word and binned inputs."""

    def __init__(self, p: FmParams, edges: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.p, self.edges, self.w0, self.w, self.v = p, edges, w0, w, v

    def score(self, texts, n_chars) -> np.ndarray:
        words, stats = features(texts, n_chars, self.p)
        base = (1 << self.p.word_log2) + np.arange(len(STATS)) * self.p.bins
        at_bin = base + bin_stats(stats, self.edges)
        out = np.empty(len(texts))
        scale = 1 / np.sqrt(len(STATS))
        for r, (at, val) in enumerate(words):
            idx = np.concatenate([at, at_bin[r]])
            x = np.concatenate([val, np.full(len(STATS), scale, np.float32)]).astype(np.float64)
            vx = self.v[idx] * x[:, None]
            out[r] = self.w0 + self.w[idx] @ x + 0.5 * ((vx.sum(0) ** 2).sum() - (vx ** 2).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def bin_stats(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, s, "right") for e, s in zip(edges, stats.T)], axis=1)


def _fit(p: FmParams, y: np.ndarray, words, stats: np.ndarray) -> Model:
    d = (1 << p.word_log2) + len(STATS) * p.bins
    rng = np.random.default_rng(p.seed)
    if len(y) == 0:
        return Model(p, np.zeros((len(STATS), p.bins - 1)), 0.0, np.zeros(d), np.zeros((d, p.rank)))
    edges = np.quantile(stats, np.linspace(0, 1, p.bins + 1)[1:-1], axis=0).T
    cols = (1 << p.word_log2) + np.arange(len(STATS)) * p.bins + bin_stats(stats, edges)

    def inputs(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), d), np.float32)
        for i, r in enumerate(rows.tolist()):
            at, val = words[r]
            x[i, at] = val
        x[np.arange(len(rows))[:, None], cols[rows]] = 1 / np.sqrt(len(STATS))
        return x

    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    par = [np.array([np.log(share / (1 - share))], np.float32), np.zeros(d, np.float32),
           rng.normal(0, 0.05, (d, p.rank)).astype(np.float32)]
    m1, m2, step = [np.zeros_like(a) for a in par], [np.zeros_like(a) for a in par], 0
    for _ in range(p.epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), p.batch):
            b = order[lo:lo + p.batch]
            xb, yb = inputs(b), y[b]
            sq = xb * xb
            s = xb @ par[2]
            z = par[0][0] + xb @ par[1] + 0.5 * ((s * s).sum(1) - (sq @ (par[2] * par[2])).sum(1))
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - yb) / len(b)).astype(np.float32)
            grads = [np.array([g.sum()], np.float32), xb.T @ g + p.decay * par[1],
                     xb.T @ (g[:, None] * s) - (sq.T @ g)[:, None] * par[2] + p.decay * par[2]]
            step += 1
            for a, gr, u, v in zip(par, grads, m1, m2):
                u += 0.1 * (gr - u)
                v += 0.01 * (gr * gr - v)
                a -= p.rate * (u / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Model(p, edges, float(par[0][0]), par[1].astype(np.float64), par[2].astype(np.float64))


def _n_chars(docs: DataFrame):
    """The table's own count of characters, null where it is no number."""
    kind = dict(docs.dtypes).get("n_chars", "void")
    if kind in ("string", "boolean") or kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
        return F.col("n_chars").try_cast("double").try_cast("bigint")
    return F.lit(None).cast("bigint")


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                       _n_chars(docs).alias("n_chars"))


def _featured(p: FmParams):
    def fn(batches):
        for b in batches:
            words, stats = features(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), p)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(3), pa.array([at for at, _ in words], pa.list_(pa.int64())),
                 pa.array([v for _, v in words], pa.list_(pa.float32())),
                 pa.array(list(stats), pa.list_(pa.float64()))], names=["doc_id", "y", "at", "val", "stats"])
    return fn


def train(docs: DataFrame, labels: DataFrame, params: FmParams | None = None, label_col: str = "quality",
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the training folds (crc32(id) mod 5 != 0) of the labels."""
    p = params or FmParams()
    y = (labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
               .where("y in (0, 1) and doc_id is not null").where(fold("doc_id") != 0)
               .groupBy("doc_id").agg(F.min("y").alias("y"))
               .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_train_rows))  # the bounded sample
    x = _inputs(docs, id_col, text_col).join(F.broadcast(y), "doc_id").select("doc_id", "text", "n_chars", "y")
    t = x.mapInArrow(_featured(p), "doc_id bigint, y int, at array<bigint>, val array<float>, "
                                   "stats array<double>").toArrow()
    rows = sorted(zip(t["doc_id"].to_pylist(), range(t.num_rows)))
    t = t.take(pa.array([r for _, r in rows], pa.int64()))
    at, val = (t[c].combine_chunks() for c in ("at", "val"))
    cut = np.cumsum(at.value_lengths().to_numpy())[:-1] if t.num_rows else []
    words = list(zip(np.split(at.flatten().to_numpy(), cut), np.split(val.flatten().to_numpy(), cut)))
    stats = t["stats"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, len(STATS))
    return _fit(p, t["y"].to_numpy().astype(np.float32), words, stats)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): probability of a good text, per row."""
    m = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batches):
        for b in batches:
            s = m.value.score(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    return _inputs(docs, id_col, text_col).mapInArrow(fn, "doc_id bigint, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``."""
    m = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def fn(batches):
        for b in batches:
            n = b.column(b.num_columns - 1).to_pylist()
            good = m.value.score(b.column(at).cast(pa.binary()).to_pylist(), n) >= threshold
            yield b.select(range(b.num_columns - 1)).filter(pa.array(good))

    extra = "n"
    while extra in docs.columns:
        extra += "_"
    return docs.withColumn(extra, _n_chars(docs)).mapInArrow(fn, docs.schema)
