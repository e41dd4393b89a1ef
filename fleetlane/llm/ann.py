"""Approximate nearest neighbours: a hierarchical navigable small-world
graph per shard.

Equal vectors are indexed once, with the smallest ids that can appear in a
result; so many equal rows cannot cut a graph apart, and ties come out in
order.  Vectors get one more component that makes their lengths equal, which
turns the largest inner product into the nearest vector.  Each shard builds
its graph in one task of bounded size: vectors draw levels, the upper levels
hold ever fewer of them, and every level is a flat array of neighbour
numbers.  Insertion and search run for many vectors side by side (one
best-first step of each at a time).  Queries, in blocks, visit every shard,
and the shards' results are merged.

Scores are inner products of the original vectors in double precision.

Edge cases: vectors that are null, zero, or hold a null or non-finite
component, and rows with a null id, take no part; so do vectors of another
than the commonest length; repeated rows of an id and vector count once;
equal scores are ordered by the smaller id; with fewer candidates than k
all are returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HnswParams:
    links: int = 16               # per vector and upper level; twice that on level 0
    ef_build: int = 64
    ef_search: int = 128
    min_shards: int = 8
    shard_vectors: int = 50_000   # bound of a shard, about
    query_block: int = 2048
    seed: int = 5


def _top(sim: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n largest of every row, largest first (ties: smaller number)."""
    if sim.shape[1] > n:
        part = np.argpartition(-sim, n - 1, axis=1)[:, :n]
        sim, ids = np.take_along_axis(sim, part, 1), np.take_along_axis(ids, part, 1)
    order = np.lexsort((ids, -sim), axis=1)
    return np.take_along_axis(sim, order, 1), np.take_along_axis(ids, order, 1)


def beam(x: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int,
         widen: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one level for all queries at once.  near: flat
    neighbour array (vectors x links, -1: none); entry: (queries x starts).
    Returns the ef best (similarity, vector number) found, -1 where none."""
    rows = len(q)
    seen = np.zeros((rows, len(x) + 1), bool)  # the last column stands for -1
    seen[:, -1] = True
    ids = np.full((rows, ef), -1)
    sim = np.full((rows, ef), -np.inf, np.float32)
    k = entry.shape[1]
    s0 = np.einsum("qkd,qd->qk", x[entry], q)
    s0[entry < 0] = -np.inf
    s0, e0 = _top(s0, entry, min(k, ef))
    ids[:, :e0.shape[1]], sim[:, :s0.shape[1]] = e0, s0
    seen[np.arange(rows)[:, None], e0] = True
    done = ids < 0
    live = np.arange(rows)
    while len(live):
        open_sim = np.where(done[live], -np.inf, sim[live])
        pick = np.argsort(-open_sim, axis=1, kind="stable")[:, :widen]
        ok = np.take_along_axis(open_sim, pick, 1) > -np.inf
        go = ok.any(axis=1)
        live, pick, ok = live[go], pick[go], ok[go]
        if not len(live):
            break
        node = np.where(ok, ids[live[:, None], pick], -1)
        d = done[live]
        np.put_along_axis(d, pick, True, 1)
        done[live] = d
        cand = np.where(node[:, :, None] >= 0, near[node], -1).reshape(len(live), -1)
        cand = np.sort(cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[seen[live[:, None], cand]] = -1
        seen[live[:, None], cand] = True
        s = np.einsum("qkd,qd->qk", x[cand], q[live])
        s[cand < 0] = -np.inf
        all_s, all_i = np.concatenate([sim[live], s], 1), np.concatenate([ids[live], cand], 1)
        all_d = np.concatenate([done[live], cand < 0], 1)
        best = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        sim[live], ids[live] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_i, best, 1)
        done[live] = np.take_along_axis(all_d, best, 1)
    return _top(sim, ids, ef)


class Hnsw:
    """Vectors and, per level, the flat neighbour array and its members."""

    def __init__(self, x: np.ndarray, p: HnswParams):
        self.x, self.p = np.ascontiguousarray(x, np.float32), p
        rng = np.random.default_rng(p.seed)
        level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(p.links)).astype(int)
        self.members, self.near = [], []
        for lv in range(int(level.max(initial=0)) + 1):
            m = np.flatnonzero(level >= lv)
            if lv and len(m) < 8:
                break
            self.members.append(m)
        for lv in reversed(range(len(self.members))):  # upper levels first: they lead the way
            self._level(lv)

    def _level(self, lv: int) -> None:
        m = self.members[lv]
        width = self.p.links * (2 if lv == 0 else 1)
        near = np.full((len(m), width), -1)
        self.near.insert(0, near)
        x, at = self.x[m], 0
        # entry points: nearest of the level above (as numbers of this level)
        while at < len(m):
            new = np.arange(at, min(len(m), at + max(32, min(512, at))))
            if at <= 256:
                sim = x[new] @ x[:at + len(new)].T
                sim[np.arange(len(new)), new] = -np.inf
                s, i = _top(sim, np.broadcast_to(np.arange(sim.shape[1]), sim.shape).copy(), self.p.ef_build)
            else:
                start = self._descend(x[new], lv, at)
                s, i = beam(x, near, x[new], start, self.p.ef_build)
            self._connect(x, near, new, s, i, width)
            at += len(new)

    def _descend(self, q: np.ndarray, lv: int, at: int) -> np.ndarray:
        """Starts for a search of level lv among its first ``at`` members."""
        here = self.members[lv]
        if lv + 1 < len(self.members):
            _, top = self._search_level(q, lv + 1, 4)
            pos = np.searchsorted(here, self.members[lv + 1][np.maximum(top, 0)])
            pos = np.where((top >= 0) & (pos < at), pos, -1)
        else:
            pos = np.full((len(q), 0), -1)
        fixed = np.linspace(0, at - 1, 8).astype(int)  # always some member that is linked already
        return np.concatenate([pos, np.broadcast_to(fixed, (len(q), 8))], 1)

    def _search_level(self, q: np.ndarray, lv: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        m = self.members[lv]
        if len(m) <= 256:
            sim = q @ self.x[m].T
            return _top(sim, np.broadcast_to(np.arange(len(m)), sim.shape).copy(), ef)
        near = self.near[lv - len(self.members)]
        return beam(self.x[m], near, q, self._descend(q, lv, len(m)), max(ef, 8))

    def _connect(self, x, near, new, sim, ids, width) -> None:
        """Link new members to their best and those back; a full list keeps
        its most similar, spread ones: a candidate nearer to a kept link
        than to the member is taken only if there is room."""
        keep = self._spread(x, new, sim, ids, width // 2)
        near[new, :keep.shape[1]] = keep
        src = np.repeat(new, keep.shape[1])
        dst = keep.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        for t in np.unique(dst):
            add = src[dst == t]
            old = near[t][near[t] >= 0]
            cand = np.setdiff1d(np.concatenate([old, add]), [t])
            if len(cand) > width:
                s = x[cand] @ x[t]
                order = np.argsort(-s, kind="stable")
                cand = self._spread(x, np.array([t]), s[order][None], cand[order][None], width)[0]
                cand = cand[cand >= 0]
            near[t] = -1
            near[t, :len(cand)] = cand

    @staticmethod
    def _spread(x, rows, sim, ids, n) -> np.ndarray:
        """Choose up to n of each row's candidates (best first): first those
        nearer to the row than to any chosen one, then the best of the rest."""
        c = min(ids.shape[1], 3 * n)
        sim, ids = sim[:, :c], ids[:, :c]
        v = x[ids]
        between = np.einsum("rad,rbd->rab", v, v)
        chosen = np.zeros(ids.shape, bool)
        for j in range(c):
            covered = (chosen & (between[:, j] > sim[:, j:j + 1])).any(axis=1)
            chosen[:, j] = ~covered & (ids[:, j] >= 0) & (chosen.sum(axis=1) < n)
        rank = np.where(ids >= 0, np.where(chosen, 0, 1), 2) * c + np.arange(c)
        order = np.argsort(rank, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(ids, order, 1)

    def search(self, q: np.ndarray, k: int, ef: int) -> np.ndarray:
        """Numbers of about the k nearest of every query, -1 where none."""
        out = []
        for lo in range(0, len(q), 256):
            part = np.ascontiguousarray(q[lo:lo + 256], np.float32)
            _, i = self._search_level(part, 0, max(ef, k))
            out.append(self.members[0][np.maximum(i, 0)][:, :k] * (i[:, :k] >= 0) - (i[:, :k] < 0))
        return np.concatenate(out) if out else np.zeros((0, k), int)

    # flat storage: members and neighbours of each level in one binary each
    def dump(self) -> dict:
        return {"n": len(self.x), "vectors": self.x.astype("<f4").tobytes(),
                "levels": [len(m) for m in self.members],
                "members": np.concatenate(self.members).astype("<i4").tobytes(),
                "neighbours": np.concatenate([n.ravel() for n in self.near]).astype("<i4").tobytes()}

    @classmethod
    def load(cls, d: dict, p: HnswParams) -> Hnsw:
        h = cls.__new__(cls)
        h.p, h.x = p, np.frombuffer(d["vectors"], "<f4").reshape(d["n"], -1)
        flat, links = np.frombuffer(d["members"], "<i4"), np.frombuffer(d["neighbours"], "<i4")
        h.members, h.near, a, b = [], [], 0, 0
        for lv, n in enumerate(d["levels"]):
            w = p.links * (2 if lv == 0 else 1)
            h.members.append(flat[a:a + n].astype(int))
            h.near.append(links[b:b + n * w].astype(int).reshape(n, w))
            a, b = a + n, b + n * w
        return h


_INDEX = ("shard int, keys binary, n int, vectors binary, levels array<int>, members binary, neighbours binary")


def _build(p: HnswParams, longest: float):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vkey", kind="stable")
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        extra = np.sqrt(np.maximum(longest ** 2 - (v * v).sum(axis=1), 0))
        h = Hnsw(np.concatenate([v, extra[:, None]], axis=1) / longest, p)
        keys = pdf["vkey"].to_numpy().astype("<i8").tobytes()
        return pd.DataFrame([{"shard": pdf["shard"].iloc[0], "keys": keys, **h.dump()}])
    return fn


def _search(p: HnswParams, k: int):
    def fn(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        names = ["qkey", "vkey"]
        if not len(queries) or not len(index):
            return pd.DataFrame([], columns=names).astype("int64")
        d = index.iloc[0].to_dict()
        h, keys = Hnsw.load(d, p), np.frombuffer(d["keys"], "<i8")
        q = np.stack(queries["v"].to_numpy()).astype(np.float64)
        q /= np.sqrt((q * q).sum(axis=1, keepdims=True))
        q = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        found = h.search(q, k, p.ef_search)
        r, c = np.nonzero(found >= 0)
        return pd.DataFrame({"qkey": queries["vkey"].to_numpy()[r], "vkey": keys[found[r, c]]}, columns=names)
    return fn


def usable(v: Column) -> Column:
    """Whether a vector takes part: finite components, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, params: HnswParams | None = None,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row
    with ``is_query`` (over ``vec_id``), by inner product."""
    p = params or HnswParams()
    rows = (vectors.select(F.col(id_col).cast("bigint").alias("vec_id"),
                           F.col(vec_col).cast("array<double>").alias("v"))
                   .where(F.col("vec_id").isNotNull() & usable(F.col("v"))).distinct())
    rows = rows.withColumn("vkey", F.xxhash64("v")).checkpoint()
    dim = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "d").first()
    if dim is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id",
                           F.lit(0.0).alias("score"))
    rows = rows.where(F.size("v") == dim["d"])
    distinct = rows.groupBy("vkey").agg(F.any_value("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, longest = distinct.agg(F.count(F.lit(1)), F.sqrt(F.max(square))).first()
    shards = max(p.min_shards, -(-n // p.shard_vectors))
    index = (distinct.withColumn("shard", F.pmod(F.xxhash64(F.lit(p.seed), "vkey"), F.lit(shards)).cast("int"))
                     .repartition(shards, "shard").groupBy("shard").applyInPandas(_build(p, float(longest)), _INDEX).checkpoint())
    asked = rows.where(is_query)
    q = asked.select("vkey", "v").dropDuplicates(["vkey"]).checkpoint()
    blocks = max(1, -(-q.count() // p.query_block))
    q = q.withColumn("block", F.pmod(F.xxhash64(F.lit(p.seed + 1), "vkey"), F.lit(blocks)).cast("int"))
    # a stated query set against every shard, block by block
    qs = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    ix = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = (qs.groupBy("shard", "block").cogroup(ix.groupBy("shard", "block"))
               .applyInPandas(_search(p, k + 1), "qkey bigint, vkey bigint"))
    # exact scores; each vector stands for the smallest ids that hold it
    few = Window.partitionBy("vkey").orderBy("vec_id")
    ids = (rows.select("vkey", "vec_id").withColumn("r", F.row_number().over(few))
               .where(F.col("r") <= k + 1).drop("r"))
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = (found.join(q.select(F.col("vkey").alias("qkey"), F.col("v").alias("qv")), "qkey")
                   .join(distinct, "vkey").select("qkey", "vkey", dot.alias("score")))
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    top = (scored.join(ids, "vkey").withColumn("r", F.row_number().over(best))
                 .where(F.col("r") <= k + 1).select("qkey", "vec_id", "score"))
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.select(F.col("vec_id").alias("query_id"), F.col("vkey").alias("qkey")).join(top, "qkey")
                 .where("query_id != vec_id").withColumn("rank", F.row_number().over(mine))
                 .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
