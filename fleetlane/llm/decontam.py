"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased.
Every run of ``min_match`` item words is a seed.  One pass over the texts
keeps the documents' runs that may be seeds (a Bloom bitmap of fixed size
stands in front of the shuffle); an equi-join on the seed gives documents
and items with shared runs, counted per pair.  A pair whose shared runs
could not cover the threshold is dropped; the others are tiled: the longest
common run of unmarked words is marked again and again, found by Karp-Rabin
hashes of a window that slides over both sides, until none of ``min_match``
words is left.  Passages in another order are thus all found.  A pair whose
tiles cover at least ``coverage`` of the item is reported.

Edge cases: null or blank texts match nothing; an item of fewer than
``min_match`` words cannot be found; rows that share a doc_id are one
document and rows that share an item_id one item (each pair reports its
best text); rows without an id report nothing; empty tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlane.llm.common import bloom_bitmap, bloom_test, mix64, mixed_id
from fleetlane.llm.words import NON_WORD, batch_hashes


@dataclass(frozen=True)
class TilingParams:
    min_match: int = 4     # words of the shortest tile
    coverage: float = 0.5  # least covered share of an item's words


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def karp_rabin(words: np.ndarray, s: int) -> np.ndarray:
    """Hash of every window of s words, from one running polynomial sum."""
    n = len(words)
    if n < s:
        return np.zeros(0, np.uint64)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, n), dtype=np.uint64)])
    return mix64((run[s:] - run[:-s]) * _powers(_BASE_INV, n - s + 1))


def tiles(item: np.ndarray, doc: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (item start, doc start, length), longest first, ties
    to the smallest starts; no word of either side lies in two tiles."""
    hi, hd = karp_rabin(item, s), karp_rabin(doc, s)
    if not len(hi) or not len(hd):
        return []
    order = np.argsort(hi, kind="stable")
    hi = hi[order]
    lo, up = np.searchsorted(hi, hd, "left"), np.searchsorted(hi, hd, "right")
    n = up - lo
    d = np.repeat(np.arange(len(hd)), n)
    i = order[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    for j in range(s):  # equal hashes are checked word by word
        same = item[i + j] == doc[d + j]
        i, d = i[same], d[same]
    used_i, used_d = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out = []
    while len(i):
        o = np.lexsort((i, d - i))
        i, d = i[o], d[o]
        new = np.concatenate([[True], (np.diff(i) != 1) | (np.diff(d) != 1)])
        first = np.flatnonzero(new)
        length = np.diff(np.concatenate([first, [len(i)]])) + s - 1
        best = int(length.max())
        top = first[length == best]
        for x, y in sorted(zip(d[top].tolist(), i[top].tolist())):
            if not (used_i[y:y + best].any() or used_d[x:x + best].any()):
                used_i[y:y + best] = used_d[x:x + best] = True
                out.append((y, x, best))
        ci = np.concatenate([[0], np.cumsum(used_i)])
        cd = np.concatenate([[0], np.cumsum(used_d)])
        free = (ci[i + s] == ci[i]) & (cd[d + s] == cd[d])
        i, d = i[free], d[free]
    return out


def _seeds(s: int):
    def fn(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            rows = [(i, len(h), karp_rabin(h, s)) for i, h in zip(ids, batch_hashes(texts, NON_WORD))]
            n = [len(k) for _, _, k in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), n)),
                 pa.array(np.repeat(np.array([r[1] for r in rows], np.int64), n)),
                 pa.array(np.concatenate([r[2] for r in rows] or [np.zeros(0, np.uint64)]).view(np.int64))],
                names=["item_id", "n", "seed"])
    return fn


def _doc_seeds(s: int, bits):
    def fn(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            out_id, out_k = [], []
            for i, h in zip(ids, batch_hashes(texts, NON_WORD)):
                k = karp_rabin(h, s)
                k = np.unique(k[bloom_test(bits.value, k)])
                out_id.append(np.full(len(k), i, np.int64))
                out_k.append(k.view(np.int64))
            if out_id:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_id)),
                                                  pa.array(np.concatenate(out_k))], names=["doc_id", "seed"])
    return fn


def _texts(bits):
    def fn(batches):
        for b in batches:
            k = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield b.filter(pa.array(bloom_test(bits.value, k))).select([0, 2])
    return fn


def _tile(p: TilingParams):
    def fn(batches):
        for b in batches:
            docs, items = (b.column(c).cast(pa.binary()).to_pylist() for c in (2, 3))
            rows = []
            for x, y in zip(batch_hashes(docs, NON_WORD), batch_hashes(items, NON_WORD)):
                t = tiles(y, x, p.min_match)
                rows.append((len(y), sum(n for _, _, n in t), len(t),
                             [{"item_start": a, "doc_start": c, "n": n} for a, c, n in t]))
            tile = pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("n", pa.int32())])
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(tile))],
                names=["doc_id", "item_id", "item_words", "covered_words", "n_tiles", "tiles"])
    return fn


def contaminated(docs: DataFrame, items: DataFrame, params: TilingParams | None = None,
                 id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, coverage, n_tiles,
    tiles) of every document and item at or above the coverage; tiles hold
    word positions."""
    p = params or TilingParams()
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    d = d.where("doc_id is not null")
    it = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("item_text"))
    it = it.where("item_id is not null and item_text is not null").distinct()
    seeds = it.mapInArrow(_seeds(p.min_match), "item_id bigint, n bigint, seed bigint").checkpoint()
    bits = bloom_bitmap(docs.sparkSession, seeds, "seed")
    hits = d.mapInArrow(_doc_seeds(p.min_match, bits), "doc_id bigint, seed bigint")
    # how many of an item's positions start a shared run; each adds at most
    # min_match covered words
    pairs = (hits.join(seeds, "seed").groupBy("doc_id", "item_id")
                 .agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"))
                 .where(F.col("c") * p.min_match >= F.col("n") * p.coverage)
                 .select("doc_id", "item_id").checkpoint())
    bits = bloom_bitmap(docs.sparkSession, pairs.select(mixed_id("doc_id").alias("k")), "k")
    texts = (d.select("doc_id", mixed_id("doc_id").alias("k"), "text")
              .mapInArrow(_texts(bits), "doc_id bigint, text string"))
    both = (pairs.join(texts, "doc_id").join(it, "item_id")
                 .select("doc_id", "item_id", "text", "item_text"))
    tiled = both.mapInArrow(_tile(p), "doc_id bigint, item_id bigint, item_words bigint, covered_words bigint, "
                            "n_tiles bigint, tiles array<struct<item_start:int,doc_start:int,n:int>>")
    cov = F.col("covered_words") / F.col("item_words")
    full = (tiled.withColumn("coverage", cov).where(F.col("coverage") >= p.coverage)
                 .groupBy("doc_id", "item_id")
                 .agg(F.max(F.struct("coverage", "item_words", "covered_words", "n_tiles", "tiles")).alias("m")))
    return full.select("doc_id", "item_id", "m.item_words", "m.covered_words", "m.coverage", "m.n_tiles", "m.tiles")


def remove_contaminated(docs: DataFrame, items: DataFrame, params: TilingParams | None = None,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    bad = contaminated(docs, items, params, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)
