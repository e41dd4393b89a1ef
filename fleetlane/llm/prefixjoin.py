"""Jaccard self-join of documents on k-word shingles by grouped prefixes.

All shingles are put in one fixed order, rare ones first.  Two sets of
similarity t share a shingle among the first n - ceil(t n) + 1 of each (their
prefixes).  Documents with identical prefix and size form one group, and
groups, not documents, are posted under the shingles of their prefix.  A
pair of groups posted under one shingle is a candidate if sizes allow it,
if the places of the shingle in both prefixes leave enough shingles to
share (the bound holds for the first shingle they share, so no link is
lost), and if their parity bitmaps allow it: each shingle flips one of as
many bits as the set has shingles (a power of two), so the number of
differing bits is at most the number of differing shingles; a bitmap of
twice the bits is folded first.  A group of several different sets has no bitmap and
passes that filter.  Candidates are then expanded to the groups' members
and verified on full sets.

Only components are wanted, so pairs are never listed.  Under a shingle
every group meets the smallest; groups that this leaves in different
components meet in blocks, at most two blocks of 128 in memory, and a cell
hands on a spanning forest of the candidates it finds (there the places in
the prefixes are not looked at: shingles with the same groups are one).  A
shingle whose m groups all stay apart costs m^2 / 2 bitmap comparisons, in
(m / 128)^2 / 2 cells; rare ones being first, it takes a corpus in which
many documents consist of one common text without being alike.  All links lie inside the components of candidate
groups.  There full sets are intersected, a cell of at most two blocks at a
time; a cell hands on a spanning forest of links; blocks of one component
of links are not compared again.  Equal sets are one member.

The order needs no exact counts, only the same rule everywhere: a shingle
is placed by a count sketch of all sets (2^22 counters, quantised to one
byte each: 4 MB, whatever the corpus), then by its hash.  A worse sketch
makes longer postings, never a lost link.

Edge cases: a null or blank text has an empty set and is linked with
nothing; fewer than k words count as one shingle; repeated rows with the
same doc_id are one document, different texts under one doc_id are tied
together; a null doc_id takes no part (component_id null); an empty table
gives no rows; extra columns are ignored.  Shingles are 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlane.llm.common import bloom_bitmap, bloom_test, connected_components, discard, mix64, mixed_id, saved
from fleetlane.llm.minhash import shingle_set, spanning_links
from fleetlane.llm.words import batch_hashes

SKETCH_LOG2 = 22
CHUNK = 1 << 13          # counters of one row of the sketch
LEAST_BITS = 512         # of a parity bitmap; a power of two of at least the set's size


@dataclass(frozen=True)
class JoinParams:
    shingle_words: int = 5
    threshold_pct: int = 80     # link if 100 * intersection >= pct * union; over 50
    block: int = 128            # groups or members of a block
    block_shingles: int = 1 << 20   # shingles of a block of members, about


def prefix_length(n, pct: int):
    """Shingles of the prefix of a set of n > 0."""
    return n - (n * pct + 99) // 100 + 1


def least_overlap(n, m, pct: int):
    """Fewest common shingles of linked sets of sizes n and m."""
    return ((n + m) * pct + 99 + pct) // (100 + pct)


# ---- order of shingles -----------------------------------------------------

def _sketch(k: int):
    """Counters of the shingle sets of a task, as rows (chunk, counters)."""
    def fn(batches):
        count = np.zeros(1 << SKETCH_LOG2, np.uint32)
        for b in batches:
            for h in batch_hashes(b.column(0).cast(pa.binary()).to_pylist()):
                np.add.at(count, shingle_set(h, k) >> np.uint64(64 - SKETCH_LOG2), 1)
        chunks = count.reshape(-1, CHUNK)
        live = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(live, pa.int32()), pa.array([_narrow(chunks[i]) for i in live], pa.binary())],
            names=["chunk", "counters"])
    return fn


def _narrow(c: np.ndarray) -> bytes:
    """Counters in the narrowest type they fit (first byte: its width), or
    places and counters of the few that are not 0 (width + 16)."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or c.max(initial=0) < 1 << (8 * w))
    at = np.flatnonzero(c)
    if len(at) * (2 + width) < len(c) * width:
        return bytes([width + 16]) + len(at).to_bytes(4, "little") + at.astype("<u2").tobytes() + c[at].astype(f"<u{width}").tobytes()
    return bytes([width]) + c.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    if data[0] < 16:
        return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)
    n, out = int.from_bytes(data[1:5], "little"), np.zeros(CHUNK, np.int64)
    out[np.frombuffer(data, "<u2", n, 5)] = np.frombuffer(data, f"<u{data[0] - 16}", n, 5 + 2 * n)
    return out


def _summed(batches):
    """Sums of the chunks of a task, one array per chunk in memory."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            total[chunk] = total.get(chunk, 0) + _wide(data)
    level = [np.round(8 * np.log2(1 + c)).astype(np.uint8).tobytes() for c in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(level, pa.binary())],
                                     names=["chunk", "counters"])


def shingle_order(texts: DataFrame, k: int):
    """Broadcast levels: one byte per counter, larger for shingles that more
    documents hold."""
    schema = "chunk int, counters binary"
    rows = texts.mapInArrow(_sketch(k), schema).repartition("chunk").mapInArrow(_summed, schema).collect()
    levels = np.zeros((1 << SKETCH_LOG2) // CHUNK * CHUNK, np.uint8)  # at most 2^SKETCH_LOG2 bytes
    for r in rows:
        levels[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counters"], np.uint8)
    return texts.sparkSession.sparkContext.broadcast(levels)


def in_order(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set's shingles, rare ones first."""
    mixed = mix64(s)
    return s[np.lexsort((mixed, levels[s >> np.uint64(64 - SKETCH_LOG2)]))]


# ---- groups ------------------------------------------------------------------

def parity_bitmap(s: np.ndarray) -> np.ndarray:
    """At least as many bits as shingles, as 64-bit integers.  The xor of
    its halves is the bitmap of half the bits."""
    bits = max(LEAST_BITS, 1 << (len(s) - 1).bit_length())
    at = (mix64(s + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool)).view(np.int64)


def _describe(p: JoinParams, levels):
    """Size, key of the set, key of the group (size and prefix), prefix and
    bitmap of each text."""
    def fn(batches):
        for b in batches:
            out = {c: [] for c in ("n", "skey", "gkey", "prefix", "bits")}
            for h in batch_hashes(b.column(1).cast(pa.binary()).to_pylist()):
                s = shingle_set(h, p.shingle_words)
                n = len(s)
                out["n"].append(n)
                if not n:
                    for c in ("skey", "gkey", "prefix", "bits"):
                        out[c].append(None)
                    continue
                first = in_order(s, levels.value)[:prefix_length(n, p.threshold_pct)]
                out["skey"].append(xxhash.xxh3_128_digest(s.tobytes()))
                out["gkey"].append(xxhash.xxh3_128_digest(first.tobytes() + n.to_bytes(8, "little")))
                out["prefix"].append(first.view(np.int64))
                out["bits"].append(parity_bitmap(s))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out["n"], pa.int64()), pa.array(out["skey"], pa.binary()),
                 pa.array(out["gkey"], pa.binary()), pa.array(out["prefix"], pa.list_(pa.int64())),
                 pa.array(out["bits"], pa.list_(pa.int64()))],
                names=["doc_id", "n", "skey", "gkey", "prefix", "bits"])
    return fn


def possible(n, i, m, j, pct: int):
    """Whether sets of sizes n and m, prefixes sharing a shingle at places i
    and j (the first they share), may be linked."""
    return ((np.minimum(n, m) * 100 >= np.maximum(n, m) * pct)
            & (np.minimum(n - i, m - j) >= least_overlap(n, m, pct)))


def _possible(pct: int) -> Column:
    """possible() as an expression over two postings (na, ia), (nb, ib)."""
    need = F.expr(f"((na + nb) * {pct} + 99 + {pct}) div (100 + {pct})")
    return ((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * pct)
            & (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= need))


def _bitmaps_allow(pct: int) -> Column:
    """Whether the bitmaps ba and bb differ in no more bits than linked sets
    of sizes na and nb in shingles; without a bitmap, true."""
    need = F.expr(f"((na + nb) * {pct} + 99 + {pct}) div (100 + {pct})")
    k = F.least(F.size("ba"), F.size("bb"))

    def folded(c: str) -> Column:
        halves = F.zip_with(F.slice(c, F.lit(1), k), F.slice(c, k + 1, k), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(c) > k, halves).otherwise(F.col(c))

    bits = F.zip_with(folded("ba"), folded("bb"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda acc, x: acc + x)
    return F.coalesce(apart <= F.col("na") + F.col("nb") - 2 * need, F.lit(True))


PAIRS = 1 << 16          # pairs of groups looked at together
WORDS = 1 << 20          # 64-bit words of their bitmaps


def _pairs(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All i < j inside each of consecutive runs of rows."""
    end = np.repeat(np.cumsum(size), size)
    row = np.arange(len(end))
    later = end - row - 1
    i = np.repeat(row, later)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)


def _folded(flat: np.ndarray, where: np.ndarray, width: np.ndarray, w: int) -> np.ndarray:
    """Bitmaps of w words; those of twice as many are folded (sets of like
    sizes differ by no more)."""
    out = flat[where[:, None] + np.arange(w)]
    wide = np.flatnonzero(width > w) if w else []
    if len(wide):
        out[wide] ^= flat[where[wide, None] + w + np.arange(w)]
    return out


def _forest(pct: int):
    """One row is a cell, a list of (side, node, comp, n, bits): (smallest,
    other) of the components that possible pairs join."""
    def fn(batches):
        for b in batches:
            cells = b.column(0)
            size = cells.value_lengths().to_numpy()
            rows = cells.flatten()
            f = {x.name: rows.field(k) for k, x in enumerate(rows.type)}
            side, comp, n = (f[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in ("side", "comp", "n"))
            # bit counts of signed numbers would be of their absolute values
            flat = f["bits"].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            width = f["bits"].value_lengths().to_numpy().astype(np.int64)    # 0: no bitmap
            where = np.cumsum(width) - width
            cut = np.cumsum(size * (size - 1) // 2) // PAIRS
            last, top = np.concatenate([[0], np.cumsum(size)]), {}

            def find(x):
                while top.get(x, x) != x:
                    x = top[x]
                return x

            for c in np.unique(cut):
                at = np.flatnonzero(cut == c)
                i, j = _pairs(size[at])
                i, j = i + last[at[0]], j + last[at[0]]
                one = np.repeat(np.maximum.reduceat(side, last[at]) == 0, size[at] * (size[at] - 1) // 2)
                keep = (comp[i] != comp[j]) & (one | (side[i] != side[j]))
                keep &= np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * pct
                i, j = i[keep], j[keep]
                both = np.minimum(width[i], width[j])
                for w in np.unique(both).tolist():
                    of, step = np.flatnonzero(both == w), max(1, WORDS // max(1, w))
                    for lo in range(0, len(of), step):
                        x, y = i[of[lo:lo + step]], j[of[lo:lo + step]]
                        apart = np.bitwise_count(_folded(flat, where[x], width[x], w)
                                                 ^ _folded(flat, where[y], width[y], w)).sum(axis=1)
                        ok = apart <= n[x] + n[y] - 2 * least_overlap(n[x], n[y], pct)
                        if not ok.any():
                            continue
                        for p, q in np.unique(np.stack([comp[x[ok]], comp[y[ok]]]), axis=1).T.tolist():
                            p, q = find(p), find(q)
                            if p != q:
                                top[max(p, q)] = min(p, q)
            if top:
                yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in top], pa.int64()),
                                                  pa.array(list(top), pa.int64())], names=["a", "b"])
    return fn


# ---- blocks that meet ----------------------------------------------------------

def meeting(m: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Deal (group, comp, node, size, ...) out to cells of two blocks of a
    group, unless both blocks belong to one component.  ``blocks`` says how
    many blocks rows of (c, size) - their number, their sum of size - need.
    Large components get blocks of their own, small ones are gathered.
    Adds cell and side."""
    part = (m.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("size"))
             .withColumn("own", blocks))
    whole = (part.groupBy(group).agg(F.sum(F.when(F.col("own") == 1, F.col("c")).otherwise(0)).alias("c"),
                                     F.sum(F.when(F.col("own") == 1, F.col("size")).otherwise(0)).alias("size"),
                                     F.count(F.lit(1)).alias("parts"))
                 .where("parts > 1").select(group, blocks.alias("shared")))
    part = part.select(group, "comp", "own").join(whole, group)
    blk = F.when(F.col("own") > 1, F.xxhash64(F.lit(1), "comp", F.pmod(F.xxhash64("node"), "own"))
                 ).otherwise(F.xxhash64(F.lit(2), F.pmod(F.xxhash64("comp"), "shared")))
    m = m.join(part, [group, "comp"]).withColumn("blk", blk).drop("own", "shared")
    held = m.groupBy(group, "blk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    x = held.select(group, F.col("blk").alias("i"), F.col("lo").alias("l1"), F.col("hi").alias("h1"))
    y = held.select(group, F.col("blk").alias("j"), F.col("lo").alias("l2"), F.col("hi").alias("h2"))
    pairs = x.join(y, group).where("i <= j and not (l1 = h1 and l2 = h2 and l1 = l2)")
    sides = F.explode(F.expr("if(i = j, array(struct(i as blk, 0 as side)),"
                             " array(struct(i as blk, 0 as side), struct(j as blk, 1 as side)))"))
    ends = (pairs.select(group, F.xxhash64(group, "i", "j").alias("cell"), sides.alias("e"))
                 .select(group, "cell", "e.blk", "e.side"))
    return m.join(ends, [group, "blk"])


def _ceil_div(x: Column, y: int) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(x / y))


_LINKS = "a bigint, b bigint"


def _candidates(groups: DataFrame, p: JoinParams) -> DataFrame:
    """(node, comp): components of possible pairs of groups (gid, n, prefix,
    bits); groups without a possible partner are left out."""
    pct = p.threshold_pct
    place = F.expr("shiftleft(n, 32) | at").alias("place")
    posted = groups.select("gid", "n", F.posexplode("prefix").alias("at", "token")).select("token", "gid", place)
    # shingles of two or more groups: a small part of all
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    posted = saved(posted.join(shared, "token")
                         .select("token", "c", "gid", F.shiftright("place", 32).alias("n"),
                                 F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at")), "join-postings")
    # the smallest group under a shingle (then the smallest gid) is its hub
    hubs = posted.groupBy("token").agg(F.min(F.struct("n", "gid", "at")).alias("hub"))
    star = (posted.join(hubs, "token")
                  .select(F.col("hub.gid").alias("a"), F.col("hub.n").alias("na"), F.col("hub.at").alias("ia"),
                          F.col("gid").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"))
                  .where("a != b").where(_possible(pct)).select("a", "b", "na", "nb").distinct())
    bits = groups.where("bits is not null").select("gid", F.col("bits").alias("w"))
    star = (star.join(bits.select(F.col("gid").alias("a"), F.col("w").alias("ba")), "a", "left")
                .join(bits.select(F.col("gid").alias("b"), F.col("w").alias("bb")), "b", "left")
                .where(_bitmaps_allow(pct)).select("a", "b"))
    star = saved(star, "join-candidates")
    near = connected_components(star)
    # groups under one shingle that are still apart; shingles with the same
    # groups (told by 128 bits) are one
    m = (posted.where("c > 2").join(near, posted["gid"] == near["node"], "left")
               .select("token", F.coalesce("comp", "gid").alias("comp"), F.col("gid").alias("node"), "n"))
    spread = (m.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c"),
                                     F.bit_xor(F.xxhash64("node")).alias("x"),
                                     F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
               .where("lo != hi").groupBy("c", "x", "y").agg(F.min("token").alias("token")).select("token"))
    m = saved(m.join(spread, "token").withColumn("size", F.lit(1).cast("bigint")), "join-apart")
    none = F.array().cast("array<bigint>")
    cells = (meeting(m, "token", _ceil_div(F.col("c"), p.block))
             .join(groups.select(F.col("gid").alias("node"), "bits"), "node")
             .groupBy("cell").agg(F.sort_array(F.collect_list(F.struct(
                 "side", "node", "comp", "n", F.coalesce("bits", none).alias("bits")))).alias("rows")))
    more = saved(cells.select("rows").mapInArrow(_forest(pct), _LINKS).distinct(), "join-candidates")
    discard(m)
    discard(posted)
    if more.limit(1).count():
        near = connected_components(star.union(more))
    return near


# ---- members -------------------------------------------------------------------

def _sets(bits, k: int):
    def fn(batches):
        for b in batches:
            mixed = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            hit = pa.array(np.flatnonzero(bloom_test(bits.value, mixed)))
            sets = [shingle_set(h, k).view(np.int64)
                    for h in batch_hashes(b.column(2).cast(pa.binary()).take(hit).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(hit), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["node", "s"])
    return fn


def _links(pct: int):
    """Links inside every cell (comp, side, s) of a task's group."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, c in pdf.sort_values(["cell", "node"], kind="stable").groupby("cell", sort=False):
            side, comp, sets = c["side"].to_numpy(), c["comp"].to_numpy(), c["s"].to_list()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(right):
                left, right = (left[:1], left[1:]) if len(left) == 2 else (left, left)
            if len(left) and len(right):
                out += spanning_links(comp, left, right, sets, pct)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")
    return fn


def _verified(members: DataFrame, p: JoinParams) -> DataFrame:
    """Spanning links of (node, cluster, size, s): first inside blocks of a
    cluster, then between blocks of components still apart."""
    blocks = F.greatest(_ceil_div(F.col("c"), p.block), _ceil_div(F.col("size"), p.block_shingles))
    held = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("size"))
    held = held.select("cluster", blocks.alias("blocks"), "size")
    total = held.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, -(-total // (2 * p.block_shingles)))  # small clusters share a task
    m = members.join(held.select("cluster", "blocks"), "cluster")
    cell = F.xxhash64("cluster", F.pmod(F.xxhash64("node"), "blocks"))
    task = F.when(F.col("blocks") == 1, F.xxhash64(F.lit(0), F.pmod(F.xxhash64("cluster"), F.lit(tasks)))).otherwise(cell)
    inside = (m.select(task.alias("task"), cell.alias("cell"), "node", F.col("node").alias("comp"),
                       F.lit(0).alias("side"), "s")
               .groupBy("task").applyInPandas(_links(p.threshold_pct), _LINKS))
    links = saved(inside, "join-links")
    large = saved(m.where("blocks > 1").drop("blocks"), "join-large")
    if large.limit(1).count():
        comps = connected_components(links)
        rest = (large.join(comps, "node", "left")
                     .select("cluster", F.coalesce("comp", "node").alias("comp"), "node", "size", "s"))
        across = meeting(rest.drop("s"), "cluster", blocks).join(large.select("node", "s"), "node")
        across = across.groupBy("cell").applyInPandas(_links(p.threshold_pct), _LINKS)
        links = links.union(saved(across, "join-links"))
    return links


def components(docs: DataFrame, params: JoinParams | None = None, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``."""
    p = params or JoinParams()
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    levels = shingle_order(d.select("text"), p.shingle_words)
    sets = saved(d.mapInArrow(_describe(p, levels), "doc_id bigint, n bigint, skey binary, gkey binary, "
                                                    "prefix array<bigint>, bits array<bigint>"), "join-sets")
    live = sets.where("skey is not null and doc_id is not null")
    # members: different sets, each by its smallest doc_id; groups: by theirs
    members = saved(live.groupBy("skey").agg(F.min("doc_id").alias("node"), F.any_value("gkey").alias("gkey"),
                                             F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"),
                                             F.any_value("bits").alias("bits")), "join-members")
    groups = (members.groupBy("gkey").agg(F.min("node").alias("gid"), F.any_value("n").alias("n"),
                                          F.any_value("prefix").alias("prefix"), F.any_value("bits").alias("bits"),
                                          F.count(F.lit(1)).alias("different"))
                     .withColumn("bits", F.when(F.col("different") == 1, F.col("bits"))))
    groups = saved(groups, "join-groups")
    near = _candidates(groups, p)
    # expand: members of groups with a possible partner, or of several sets
    clusters = (groups.join(near, groups["gid"] == near["node"], "left")
                      .where("comp is not null or different > 1")
                      .select("gkey", F.coalesce("comp", "gid").alias("cluster")))
    wanted = saved(members.join(clusters, "gkey").select("node", "cluster", F.col("n").alias("size")), "join-wanted")
    bits = bloom_bitmap(docs.sparkSession, wanted.select(mixed_id("node").alias("k")), "k")
    texts = (d.where("doc_id is not null").select("doc_id", mixed_id("doc_id").alias("k"), "text")
              .mapInArrow(_sets(bits, p.shingle_words), "node bigint, s array<bigint>"))
    links = _verified(texts.join(wanted, "node").where(F.size("s") == F.col("size")), p)
    # different texts under one doc_id tie their members together
    own = live.select("doc_id", "skey").distinct().join(members.select("skey", "node"), "skey")
    several = (own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z")
                  .select("doc_id", "a"))
    ties = own.join(several, "doc_id").where("node != a").select("a", F.col("node").alias("b")).distinct()
    comps = connected_components(links.union(ties))
    named = (members.join(comps, "node", "left").select("skey", F.coalesce("comp", "node").alias("comp")))
    out = sets.select("doc_id", "n", "skey").join(named, "skey", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
