"""Near-duplicate documents by b-bit MinHash.

One pass over the texts gives each document its set of distinct k-word
shingles (64-bit hashes), 160 minima, 32 band keys of five minima each and
a packed signature that keeps only the low b bits of every minimum.
Documents with equal sets are one vertex (its representative is the
smallest doc_id).  Vertices that share a band key are candidates.  Their
similarity is estimated from the packed signatures by bit counts,
corrected for chance agreement of b-bit values: each vertex of a bucket is
compared with the bucket's smallest, then, in blocks, vertices of one
bucket that this left unconnected.  The connected components of the
estimates are candidate clusters; all links lie inside them.  Full sets are
then intersected inside a cluster, at most two blocks of vertices at a
time, as products of 0/1 matrices, and a task hands on a spanning forest of
the links it finds, never all pairs.  Large clusters are first joined
within blocks; only blocks of components still apart meet afterwards.

A pair at exactly 0.8 misses all bands with probability
(1 - 0.8^5)^32 = 3e-6; the estimate's cut lies five standard errors below
the threshold.

Edge cases: a null or blank text has an empty set and is linked with
nothing; fewer than k words count as one shingle; repeated rows with the
same doc_id are one vertex; a null doc_id takes no part in linking
(component_id is null, kept is true); an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlane.llm.common import (bloom_bitmap, bloom_test, connected_components, gram_hashes,
                                  mix64, mixed_id)
from fleetlane.llm.words import batch_hashes


@dataclass(frozen=True)
class MinHashParams:
    shingle_words: int = 5
    threshold_pct: int = 80   # link if 100 * intersection >= pct * union
    bands: int = 32
    rows: int = 5
    bits: int = 4             # bits kept of each minimum; divides 64
    block: int = 128          # vertices of a block; two blocks meet in one task

    @property
    def k(self) -> int:
        return self.bands * self.rows

    @property
    def max_mismatch(self) -> int:
        """Most differing b-bit values of a candidate pair."""
        t, chance = self.threshold_pct / 100, 2.0 ** -self.bits
        p = t + (1 - t) * chance
        return int(np.ceil(self.k * (1 - p) + 5 * np.sqrt(self.k * p * (1 - p))))


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes from a text's word hashes."""
    g = np.sort(gram_hashes(h, k))
    return g[np.concatenate([[True], g[1:] != g[:-1]])] if len(g) else g


def _multipliers(k: int) -> np.ndarray:
    return mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minima(s: np.ndarray, mult: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over a non-empty set; ``buf``
    is a work area of len(mult) rows."""
    out = np.full(len(mult), np.uint64(0xFFFFFFFFFFFFFFFF))
    step = buf.shape[1]
    for i in range(0, len(s), step):
        part = s[i:i + step]
        v = np.multiply(mult[:, None], part[None, :], out=buf[:, :len(part)])
        np.minimum(out, v.min(axis=1), out=out)
    return out


def pack_bits(m: np.ndarray, bits: int) -> np.ndarray:
    """Low ``bits`` bits of each row's mixed minima, packed into 64-bit words."""
    low = mix64(m) & np.uint64((1 << bits) - 1)
    per = 64 // bits
    pad = (-low.shape[1]) % per
    low = np.pad(low, ((0, 0), (0, pad)))
    low = low.reshape(len(m), low.shape[1] // per, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(bits)), axis=2)


def band_keys(m: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of each row's minima."""
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(m), bands))
    for j in range(rows):
        acc = mix64(acc ^ m.reshape(len(m), bands, rows)[:, :, j])
    return acc


def _lists(values: np.ndarray, live: np.ndarray) -> pa.Array:
    """Equal-length lists for the live rows, null for the others."""
    offsets = np.concatenate([[0], np.cumsum(live * values.shape[1])]).astype(np.int32)
    flat = np.ascontiguousarray(values).view(np.int64).ravel()
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(~live))


def _sign(p: MinHashParams):
    def fn(batches):
        mult = _multipliers(p.k)
        buf = np.empty((p.k, 256), np.uint64)
        for b in batches:
            sets = [shingle_set(h, p.shingle_words)
                    for h in batch_hashes(b.column(1).cast(pa.binary()).to_pylist())]
            n = np.array([len(s) for s in sets], np.int64)
            live = n > 0
            m = np.array([minima(s, mult, buf) for s in sets if len(s)],
                         np.uint64).reshape(int(live.sum()), p.k)
            key = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), pa.array(key, pa.binary()),
                 _lists(pack_bits(m, p.bits), live), _lists(band_keys(m, p.bands, p.rows), live)],
                names=["doc_id", "n_shingles", "key", "sig", "bands"])
    return fn


def signatures(docs: DataFrame, p: MinHashParams, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, key, sig, bands) per row of ``docs``."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_sign(p), "doc_id bigint, n_shingles bigint, key binary, "
                                  "sig array<bigint>, bands array<bigint>")


def mismatches(a: str, b: str, p: MinHashParams) -> Column:
    """Number of b-bit values that differ between two packed signatures:
    XOR, fold each group of b bits to its lowest bit, count bits."""
    def folded(x: Column) -> Column:
        s = p.bits
        while s > 1:
            s //= 2
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        ones = sum(1 << i for i in range(0, 64, p.bits))
        return F.bit_count(x.bitwiseAND(F.lit(ones - (1 << 64) if ones >> 63 else ones)))

    counts = F.zip_with(a, b, lambda x, y: folded(x.bitwiseXOR(y)).cast("bigint"))
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def similarity(mismatch: Column, p: MinHashParams) -> Column:
    """Collision-corrected estimate from the mismatch count."""
    chance = 2.0 ** -p.bits
    return (F.lit(1.0) - mismatch / F.lit(float(p.k)) - F.lit(chance)) / F.lit(1 - chance)


def _size_ok(p: MinHashParams) -> Column:
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * p.threshold_pct


def _estimated(pairs: DataFrame, verts: DataFrame, p: MinHashParams) -> DataFrame:
    """Candidate pairs whose sizes and signatures allow a link."""
    va = verts.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    vb = verts.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    j = pairs.join(vb, "b").join(va, "a").where(_size_ok(p))
    return j.where(mismatches("sa", "sb", p) <= p.max_mismatch).select("a", "b").distinct()


def _sets(bits, k: int):
    def fn(batches):
        for b in batches:
            mixed = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            hit = np.flatnonzero(bloom_test(bits.value, mixed))
            texts = b.column(2).cast(pa.binary()).take(pa.array(hit)).to_pylist()
            sets = [shingle_set(h, k).view(np.int64) for h in batch_hashes(texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(hit)), pa.array(sets, pa.list_(pa.int64()))],
                names=["doc_id", "s"])
    return fn


def _shingle_sets(nodes: DataFrame, docs: DataFrame, p: MinHashParams, id_col: str,
                  text_col: str) -> DataFrame:
    """(node, s) full sets of the documents that may be among ``nodes``:
    only texts that pass a Bloom bitmap of the ids are shingled again."""
    bits = bloom_bitmap(docs.sparkSession, nodes.select(mixed_id("node").alias("k")), "k")
    d = (docs.select(F.col(id_col).cast("bigint").alias("node"), F.col(text_col).alias("text"))
             .where(F.col("node").isNotNull())
             .select("node", mixed_id("node").alias("k"), "text"))
    return d.mapInArrow(_sets(bits, p.shingle_words), "node bigint, s array<bigint>")


def intersections(left: list[np.ndarray], right: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: a product of 0/1
    matrices over the values that occur on both sides, in slices."""
    lv, rv = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(lv, rv)
    out = np.zeros((len(left), len(right)), np.float32)

    def cells(sets, v):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        col = np.searchsorted(both, v)
        ok = (col < len(both)) & (both[np.minimum(col, len(both) - 1)] == v)
        return row[ok], col[ok]

    if len(both):
        (lr, lc), (rr, rc) = cells(left, lv), cells(right, rv)
        for i in range(0, len(both), step):
            m = [np.zeros((len(x), step), np.float32) for x in (left, right)]
            for a, row, col in ((m[0], lr, lc), (m[1], rr, rc)):
                here = (col >= i) & (col < i + step)
                a[row[here], col[here] - i] = 1
            out += m[0] @ m[1].T
    return np.rint(out).astype(np.int64)


def spanning_links(comp, left, right, sets, pct: int) -> list[tuple[int, int]]:
    """Components that links between the documents at ``left`` and at
    ``right`` join: (smallest, other) of each."""
    size = np.array([len(x) for x in sets], np.int64)
    if len(left) == len(right) == 1:
        inter = np.array([[len(np.intersect1d(sets[left[0]], sets[right[0]], assume_unique=True))]])
    else:
        inter = intersections([sets[i] for i in left], [sets[j] for j in right])
    union = size[left][:, None] + size[right][None, :] - inter
    top: dict = {}

    def find(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for i, j in zip(*np.nonzero(inter * 100 >= union * pct)):
        x, y = find(comp[left[i]]), find(comp[right[j]])
        if x != y:
            top[max(x, y)] = min(x, y)
    return [(int(find(x)), int(x)) for x in top]


def _link_group(pct: int):
    """All candidate clusters (or one pair of blocks) of a group."""
    def fn(pdf):
        import pandas as pd
        pdf = pdf.sort_values(["cell", "node"], kind="stable")
        comp, side = pdf["comp"].to_numpy(), pdf["side"].to_numpy()
        sets, cell = pdf["s"].to_list(), pdf["cell"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])).tolist() + [len(cell)]
        out = []
        for lo, hi in zip(cuts, cuts[1:]):
            at = np.arange(lo, hi)
            left, right = at[side[lo:hi] == 0], at[side[lo:hi] == 1]
            if len(right) == 0:  # one block with itself
                left, right = (left[:1], left[1:]) if len(left) == 2 else (left, left)
            if len(left) and len(right):
                out += spanning_links(comp, left, right, sets, pct)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")
    return fn


_CELL = ("grp", "cell", "node", "comp", "side", "s")
_LINKS = "a bigint, b bigint"


def _links_inside(members: DataFrame, p: MinHashParams) -> DataFrame:
    """First round over (node, cluster, n, s): every cluster in blocks of
    about p.block; small clusters share a task."""
    nb = F.ceil(F.col("n") / p.block)
    blk = F.pmod(F.xxhash64("node"), nb)
    grp = F.when(F.col("n") <= p.block,
                 F.xxhash64(F.lit(0), F.pmod(F.xxhash64("cluster"), F.lit(4096))))
    cell = F.xxhash64("cluster", blk)
    m = members.select(F.coalesce(grp, cell).alias("grp"), cell.alias("cell"), "node",
                       F.col("node").alias("comp"), F.lit(0).alias("side"), "s")
    return m.groupBy("grp").applyInPandas(_link_group(p.threshold_pct), _LINKS)


def _links_across(members: DataFrame, comps: DataFrame, p: MinHashParams) -> DataFrame:
    """Second round, for clusters of more than one block that the first
    left in several components."""
    m = (members.where(F.col("n") > p.block).join(comps, "node", "left")
                .select("cluster", "node", F.coalesce("comp", "node").alias("comp"), "s"))
    g = _block_pairs(m, "cluster", p).withColumn("grp", F.col("cell"))
    return g.select(*_CELL).groupBy("grp").applyInPandas(_link_group(p.threshold_pct), _LINKS)


def _block_pairs(m: DataFrame, group: str, p: MinHashParams) -> DataFrame:
    """Deal (group, node, comp, ...) out to cells, each two blocks of a
    group: large components get blocks of their own, small ones are
    gathered; a pair of blocks meets unless both belong to one component.
    Adds cell and side (0, or 1 for the second block of a pair)."""
    size = m.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("c"))
    small = (size.groupBy(group)
                 .agg(F.sum(F.when(F.col("c") <= p.block, F.col("c")).otherwise(0)).alias("few"),
                      F.count(F.lit(1)).alias("parts")).where("parts > 1"))
    size = size.join(small, group)
    own = F.xxhash64(F.lit(1), group, "comp", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / p.block)))
    shared = F.xxhash64(F.lit(2), group, F.pmod(F.xxhash64("comp"), F.ceil(F.col("few") / p.block)))
    m = (m.join(size, [group, "comp"]).withColumn("blk", F.when(F.col("c") > p.block, own).otherwise(shared))
          .drop("c", "few", "parts"))
    blocks = m.groupBy(group, "blk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    x = blocks.select(group, F.col("blk").alias("i"), F.col("lo").alias("l1"), F.col("hi").alias("h1"))
    y = blocks.select(group, F.col("blk").alias("j"), F.col("lo").alias("l2"), F.col("hi").alias("h2"))
    pairs = (x.join(y, group).where("i <= j and not (l1 = h1 and l2 = h2 and l1 = l2)")
              .select("i", "j", F.xxhash64("i", "j").alias("cell")))
    one = pairs.select(F.col("i").alias("blk"), "cell", F.lit(0).alias("side"))
    two = pairs.where("i != j").select(F.col("j").alias("blk"), "cell", F.lit(1).alias("side"))
    return m.join(one.unionByName(two), "blk")


def _estimate(p: MinHashParams):
    """One row is a cell: (comp, side, sig) of two blocks; (smallest, other)
    of the components that similar signatures join."""
    ones = np.uint64(sum(1 << i for i in range(0, 64, p.bits)))

    def fn(batches):
        for b in batches:
            m = b.column(0)
            off = m.offsets.to_numpy()
            f = {x.name: m.values.field(i) for i, x in enumerate(m.type.value_type)}
            side, comp = (f[x].to_numpy(zero_copy_only=False) for x in ("side", "comp"))
            sig = f["sig"].values.to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(comp), -1)
            out = []
            for lo, hi in zip(off[:-1], off[1:]):
                lab, s = comp[lo:hi].copy(), sig[lo:hi]
                left, right = np.flatnonzero(side[lo:hi] == 0), np.flatnonzero(side[lo:hi] == 1)
                right = right if len(right) else left  # one block with itself
                for i in left:
                    near = right[lab[right] != lab[i]]
                    x = s[near] ^ s[i]
                    step = p.bits
                    while step > 1:
                        step //= 2
                        x = x | (x >> np.uint64(step))
                    for j in near[np.bitwise_count(x & ones).sum(axis=1) <= p.max_mismatch]:
                        a, z = sorted((int(lab[i]), int(lab[j])))
                        lab[lab == z] = a
                joined = np.flatnonzero(lab != comp[lo:hi])
                out += set(zip(lab[joined].tolist(), comp[lo:hi][joined].tolist()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(x, np.int64)) for x in zip(*out)], names=["a", "b"])
    return fn


def _unresolved(bucket: DataFrame, hubs: DataFrame, comps: DataFrame, verts: DataFrame,
                p: MinHashParams) -> DataFrame:
    """Links by estimate between different components inside buckets of
    three or more vertices (pairs with the smallest were done before)."""
    m = (bucket.join(hubs.where("n > 2").select("band"), "band").join(comps, "node", "left")
               .select("band", "node", F.coalesce("comp", "node").alias("comp")))
    apart = (m.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
              .where("lo != hi").select("band"))
    m = m.join(apart, "band").checkpoint()
    cells = (_block_pairs(m, "band", p).join(verts.select(F.col("rep").alias("node"), "sig"), "node")
             .groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("side", "node", "comp", "sig"))).alias("m")))
    # several bands often hold the same vertices: compare them once
    same = F.xxhash64(F.col("m.side"), F.col("m.node"))
    cells = cells.groupBy(same.alias("same")).agg(F.any_value("m").alias("m"))
    return cells.select("m").mapInArrow(_estimate(p), _LINKS).distinct()


def near_duplicates(docs: DataFrame, params: MinHashParams | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``."""
    p = params or MinHashParams()
    sig = signatures(docs, p, id_col, text_col).checkpoint()
    live = sig.where("key is not null and doc_id is not null")
    # equal sets have equal signatures, so any() of them is the same value
    reps = live.groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"),
                                   F.any_value("sig").alias("sig"),
                                   F.any_value("bands").alias("bands")).checkpoint()
    verts = reps.select("rep", "n", "sig")
    bucket = reps.select(F.explode("bands").alias("band"), F.col("rep").alias("node"))
    hubs = (bucket.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n"))
                  .where("n > 1").checkpoint())
    star = (bucket.join(hubs, "band").where("node != hub")
                  .select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    cand = _estimated(star, verts, p).checkpoint()
    near = connected_components(cand)
    more = _unresolved(bucket, hubs, near, verts, p).checkpoint()
    if more.limit(1).count():
        cand = cand.union(more).checkpoint()
        near = connected_components(cand)
    size = near.groupBy(F.col("comp").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    members = near.withColumnRenamed("comp", "cluster").join(size, "cluster")
    members = (_shingle_sets(near, docs, p, id_col, text_col).join(members, "node")
               .select("node", "cluster", "n", "s").checkpoint())
    # a doc_id that occurs with several texts ties their vertices together
    own = live.join(reps.select("key", "rep"), "key").select("doc_id", "rep")
    several = (own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
                  .where("a != b").select("doc_id", "a"))
    ties = own.join(several, "doc_id").where("rep != a").select("a", F.col("rep").alias("b")).distinct()
    links = _links_inside(members, p).union(ties).checkpoint()
    comps = connected_components(links)
    if members.where(F.col("n") > p.block).limit(1).count():
        links = links.union(_links_across(members, comps, p)).checkpoint()
        comps = connected_components(links)
    member = (reps.join(comps, reps["rep"] == comps["node"], "left")
                  .select("key", F.coalesce("comp", "rep").alias("comp")))
    out = sig.select("doc_id", "n_shingles", "key").join(member, "key", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, params: MinHashParams | None = None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is kept: one per group of near
    duplicates (its smallest id; of repeated rows with that id, one).
    Rows without an id stay."""
    dup = (near_duplicates(docs, params, id_col, text_col)
           .groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    drop = dup.where("not kept").select(F.col("doc_id").alias(id_col))
    rest = docs.join(drop, id_col, "left_anti")
    again = dup.where("kept and n > 1 and doc_id is not null").select(F.col("doc_id").alias(id_col))
    once = rest.join(again, id_col, "left_anti")
    return once.unionByName(rest.join(again, id_col, "left_semi").dropDuplicates([id_col]))
