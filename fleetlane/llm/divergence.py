"""Source divergence audit by one-hot level products.

Each language keeps the terms that occur in at least ``min_docs`` of its
documents.  A group (lang, source) prices every kept term by its count
there: 1 + floor(10^9 (count + 5) / (N + 5 V)), so the price depends on the
count level alone.  For two groups the joint table of their levels (how
many terms have level a here and level b there) holds all that their
distance sum |p - q| needs.

Joint tables come from matrix products: the kept terms of a language are
dealt to blocks of bounded size, terms of like frequency together so that
levels are few; a block's indicator matrix has a row per term and a column
per (group, level), level 0 included; its transpose times itself, one pair
of column chunks at a time, counts every joint level.  The products are
exact (0/1 entries, at most 4,096 rows, in single precision), the pricing
is in 64-bit integers, and a block hands on one number per pair of groups.
Languages with very many sources are also cut by source: a cell is a block
of terms and two buckets of sources.

Terms are counted per task and group before the shuffle, so a hot source
or term crosses it once a task.  Texts are read in slices of about 8 MB; a
document counts once towards a term's documents however long it is.

Edge cases: null text, lang and source are read as empty; repeated rows
are documents of their own; a group without terms is priced like any other
(all its levels are 0); a language without kept terms gives pairs of value
0 and no terms; ties rank by item; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlane.llm.common import saved

SLICE = 1 << 23          # bytes of text looked at together
PENDING = 1 << 21        # counted rows of a task before they are added up
CHUNK = 1024             # columns of a product
BUCKET = 256             # sources of one language on a side of a cell

# bytes of terms: letters A-Z, a-z and every byte of other characters
_IN_TERM = np.array([x >= 0x80 or chr(x).isalpha() for x in range(256)])
_LOWER = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint8)


@dataclass(frozen=True)
class DivergenceParams:
    min_docs: int = 30
    smooth: int = 5
    scale: int = 1_000_000_000
    top_terms: int = 50
    block_terms: int = 4096  # rows of a product, fewer where levels are many


def terms(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """(terms in order, their starts) of a byte string."""
    buf = np.frombuffer(data, np.uint8)
    inside = _IN_TERM[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    flat = _LOWER[buf[inside]]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]), starts


def _counts(data: bytes, doc_ends: np.ndarray, groups: np.ndarray) -> pa.Table:
    """(g, term, n, df) of the documents that end at ``doc_ends``."""
    words, starts = terms(data)
    enc = words.dictionary_encode()
    size = max(1, len(enc.dictionary))
    doc = np.searchsorted(doc_ends, starts, "right")
    pair, n = np.unique(doc * size + enc.indices.to_numpy(), return_counts=True)
    key, at = np.unique(groups[pair // size] * size + pair % size, return_inverse=True)
    return pa.table({"g": pa.array(key // size), "term": enc.dictionary.take(pa.array(key % size)),
                     "n": pa.array(np.bincount(at, n, len(key)).astype(np.int64)),
                     "df": pa.array(np.bincount(at, minlength=len(key)).astype(np.int64))})


def _long(data: bytes, group: int) -> pa.Table:
    """_counts() of one long document, slice by slice."""
    parts, at, one = [], 0, np.array([group])
    while at < len(data):
        end = at + SLICE
        while end < len(data) and _IN_TERM[data[end]]:
            end += 1
        parts.append(_counts(data[at:end], np.array([SLICE * 2 + len(data)]), one))
        at = end
    t = pa.concat_tables(parts).group_by(["g", "term"]).aggregate([("n", "sum"), ("df", "max")])
    return t.rename_columns({"n_sum": "n", "df_max": "df"})


def _summed(parts: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(parts).group_by(["g", "term"]).aggregate([("n", "sum"), ("df", "sum")])
    return t.rename_columns({"n_sum": "n", "df_sum": "df"})


def _count(batches):
    """(lang, source, text) -> (lang, source, term, n, df), added up over
    the task as far as memory allows."""
    seen: dict[tuple, int] = {}
    pending: list[pa.Table] = []

    def rows(t: pa.Table):
        names = list(seen)
        g = t["g"].combine_chunks()
        cols = [pa.array([x[i] for x in names], pa.string()).take(g) for i in (0, 1)]
        for b in pa.table([*cols, t["term"], t["n"], t["df"]],
                          names=["lang", "source", "term", "n", "df"]).to_batches(max_chunksize=1 << 16):
            yield b

    for b in batches:
        keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
        group = np.array([seen.setdefault(k, len(seen)) for k in keys], np.int64)
        texts = b.column(2).cast(pa.binary())
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1
        lo = 0
        while lo < len(texts):
            grown = np.cumsum(size[lo:])
            hi = lo + max(1, int(np.searchsorted(grown, SLICE, "right")))
            part = texts.slice(lo, hi - lo).to_pylist()
            if hi == lo + 1 and len(part[0]) > SLICE:
                pending.append(_long(part[0], int(group[lo])))
            else:
                pending.append(_counts(b"\n".join(part), grown[:hi - lo], group[lo:hi]))
            lo = hi
        if sum(len(t) for t in pending) > PENDING:
            pending = [_summed(pending)]
            if len(pending[0]) > PENDING // 2:
                yield from rows(pending.pop())
    if pending:
        yield from rows(_summed(pending))


def price(count: Column, total: Column, vocabulary: Column, p: DivergenceParams) -> Column:
    """1 + floor(scale (count + smooth) / (total + smooth V)), exactly; null
    if there is no vocabulary."""
    num = F.lit(p.scale).cast("decimal(10,0)") * (count + p.smooth).cast("decimal(20,0)")
    den = (total + p.smooth * vocabulary).cast("decimal(20,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", num, F.when(den > 0, den))


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """One cell: rows (source, side, term, level, price), term null for a
    source's level 0; the sum over the block's terms of |price difference|
    for each pair of sources."""
    columns = (pdf[["side", "source", "level", "price"]].drop_duplicates(["side", "source", "level"])
               .sort_values(["side", "source", "level"], kind="stable").reset_index(drop=True))
    columns["col"] = np.arange(len(columns))
    head = columns.groupby(["side", "source"], sort=True)["col"].first()
    first = head.to_numpy()                                    # each source's level 0
    names = head.index.get_level_values("source").to_numpy()
    side = head.index.get_level_values("side").to_numpy()
    source_of = np.searchsorted(first, columns["col"].to_numpy(), "right") - 1
    own = pdf[pdf["term"].notna()].merge(columns[["side", "source", "level", "col"]], on=["side", "source", "level"])
    row, labels = pd.factorize(own["term"])
    col_of = np.repeat(first[:, None], len(labels), axis=1)    # (source, term) -> its one-hot column
    col_of[source_of[own["col"].to_numpy()], row] = own["col"].to_numpy()
    prices = columns["price"].to_numpy(np.int64)
    total = np.zeros((len(first), len(first)), np.int64)

    def indicators(lo: int, hi: int) -> np.ndarray:
        s0, s1 = source_of[lo], source_of[hi - 1] + 1
        s, t = np.nonzero((col_of[s0:s1] >= lo) & (col_of[s0:s1] < hi))
        x = np.zeros((len(labels), hi - lo), np.float32)
        x[t, col_of[s0 + s, t] - lo] = 1
        return x

    cuts = [(lo, min(lo + CHUNK, len(prices))) for lo in range(0, len(prices), CHUNK)]
    for i, (lo, hi) in enumerate(cuts):
        x = indicators(lo, hi)
        for lo2, hi2 in cuts[i:]:
            y = x if lo2 == lo else indicators(lo2, hi2)
            priced = (x.T @ y).astype(np.int64) * np.abs(prices[lo:hi, None] - prices[None, lo2:hi2])
            a, b = source_of[lo:hi], source_of[lo2:hi2]
            at, bt = np.flatnonzero(np.diff(a, prepend=-1)), np.flatnonzero(np.diff(b, prepend=-1))
            total[np.ix_(a[at], b[bt])] += np.add.reduceat(np.add.reduceat(priced, at, axis=0), bt, axis=1)
    i, j = np.nonzero(np.triu(np.ones_like(total, bool), 1) & ((side.max() == 0) | (side[:, None] != side[None, :])))
    swap = names[i] > names[j]
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "a": np.where(swap, names[j], names[i]),
                         "b": np.where(swap, names[i], names[j]), "value": total[i, j]})


def _band(total: Column) -> Column:
    """Terms of like frequency share a block: floor(log2) of their count."""
    return F.floor(F.log2(total)).cast("int")


def _languages(kept: DataFrame, p: DivergenceParams) -> DataFrame:
    """Per language: number and total count of its kept terms, and how many
    blocks each band needs (the more levels, the fewer terms in a block)."""
    rows = F.greatest(F.lit(128), F.least(F.lit(p.block_terms), F.expr(f"shiftright({p.block_terms << 6}, band)")))
    return (kept.groupBy("lang", _band(F.col("total")).alias("band"))
                .agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("total"))
                .groupBy("lang").agg(F.sum("terms").alias("v"), F.sum("total").alias("lang_n"),
                                     F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("terms") / rows)))).alias("blocks")))


def _cells(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of every cell: a block of a language's terms and one or two
    buckets of its sources."""
    mine = F.pmod(F.xxhash64("source"), "buckets")
    cols = [mine.alias("mine"), "buckets"]
    c = priced.withColumn("band", _band(F.col("total"))).select(
        "lang", "band", F.pmod(F.xxhash64("term"), F.try_element_at("blocks", "band")).alias("block"), "source", "term",
        F.col("n").alias("level"), "price", *cols)
    zero = (groups.select("lang", "source", "p0", "buckets", F.explode("blocks").alias("band", "n"))
                  .select("lang", "band", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("block"),
                          "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("level"),
                          F.col("p0").alias("price"), *cols))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("buckets") - 1),
                        lambda x: F.struct(F.least(x, "mine").alias("i"), F.greatest(x, "mine").alias("j")))
    return (c.unionByName(zero)
             .select("lang", "band", "block", F.explode(pairs).alias("cell"), "source", "term", "level", "price", "mine")
             .select("lang", "band", "block", "cell", "source", "term", "level", "price",
                     F.when(F.col("mine") == F.col("cell.i"), 0).otherwise(1).alias("side")))


def audit(docs: DataFrame, params: DivergenceParams | None = None, text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): per group its distance to
    each other source of the language (part ``pair``) and the terms it
    prices highest above the language (part ``term``)."""
    p = params or DivergenceParams()
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                      for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = (d.mapInArrow(_count, "lang string, source string, term binary, n bigint, df bigint")
                .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))
    counted = saved(counted, "divergence-counts")
    kept = (counted.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"))
                   .where(F.col("df") >= p.min_docs).select("lang", "term", "total"))
    counts = saved(counted.join(kept, ["lang", "term"])
                          .select("lang", "source", F.col("term").cast("string").alias("term"), "n", "total"),
                   "divergence-kept")
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    zero = F.lit(0).cast("bigint")
    groups = d.select("lang", "source").distinct()
    sources = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("buckets"))
    groups = (groups.join(own, ["lang", "source"], "left").join(sources, "lang").join(_languages(kept, p), "lang", "left")
                    .select("lang", "source", F.coalesce("group_n", zero).alias("group_n"), F.coalesce("v", zero).alias("v"),
                            F.coalesce("lang_n", zero).alias("lang_n"), "blocks", "buckets"))
    groups = saved(groups.withColumn("p0", price(zero, F.col("group_n"), F.col("v"), p)), "divergence-groups")
    priced = (counts.join(groups, ["lang", "source"])
                    .withColumn("price", price(F.col("n"), F.col("group_n"), F.col("v"), p))
                    .withColumn("q", price(F.col("total"), F.col("lang_n"), F.col("v"), p)))

    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = (priced.where("price > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                            (F.col("price") - F.col("q")).alias("value"))
                 .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= p.top_terms))

    sums = (_cells(priced, groups).groupBy("lang", "band", "block", "cell")
            .applyInPandas(_block, "lang string, a string, b string, value bigint")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = (groups.select("lang", "source")
                   .join(groups.select("lang", F.col("source").alias("item")), "lang").where("source != item")
                   .join(both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value"),
                         ["lang", "source", "item"], "left")
                   .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))
                   .withColumn("rank", F.row_number().over(rank)))
    return pairs.unionByName(top)
