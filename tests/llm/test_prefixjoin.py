"""Grouped prefix join against brute force, and the edge cases."""

import random

import numpy as np
import pytest

from fleetlane.llm import prefixjoin as P
from test_minhash import brute, corpus


def got(df, **params):
    return P.components(df, P.JoinParams(**params)).collect()


@pytest.mark.parametrize("k,pct", [(3, 90), (2, 80), (5, 80), (1, 95)])
def test_brute_force(llm, k, pct):
    rows = corpus()
    want, sets = brute(rows, k, pct)
    r = got(llm.createDataFrame(rows, "doc_id bigint, text string"), shingle_words=k, threshold_pct=pct,
            block=16, block_shingles=2000)
    assert {x.doc_id: x.component_id for x in r} == want
    assert all(x.n_shingles == len(sets[x.doc_id][0]) for x in r)


def test_dense_group_near_the_threshold(llm):
    """Hundreds of texts that differ in a few words of one core, some links
    only through third texts, with a bad order (all levels equal)."""
    rnd = random.Random(11)
    core = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        w = list(core)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(80)] = f"x{rnd.randrange(40)}"
        rows.append((i * 7, " ".join(w)))
    want, _ = brute(rows, 3, 90)
    df = llm.createDataFrame(rows, "doc_id bigint, text string")
    assert {x.doc_id: x.component_id for x in got(df, shingle_words=3, threshold_pct=90, block=8)} == want
    assert len(set(want.values())) > 1


def test_filters_lose_no_link():
    rnd = random.Random(3)
    levels = np.zeros(1 << P.SKETCH_LOG2, np.uint8)
    linked = folded = 0
    for _ in range(4000):
        pct = rnd.choice([80, 90])
        size = rnd.choice([rnd.randint(1, 60), rnd.randint(500, 540)])
        a = np.unique(np.array([rnd.getrandbits(64) for _ in range(size)], np.uint64))
        b = a.copy()
        for _ in range(rnd.randint(0, 5)):
            b[rnd.randrange(len(b))] = rnd.getrandbits(64)
        b = np.unique(b)[rnd.randint(0, 2) * max(1, size // 50):]
        inter = len(np.intersect1d(a, b))
        if not len(b) or 100 * inter < pct * (len(a) + len(b) - inter):
            continue
        linked += 1
        pa, pb = (P.in_order(s, levels)[:P.prefix_length(len(s), pct)].tolist() for s in (a, b))
        shared = [x for x in pa if x in pb]
        assert shared
        assert P.possible(len(a), pa.index(shared[0]), len(b), pb.index(shared[0]), pct)
        x, y = (P.parity_bitmap(s).view(np.uint64) for s in (a, b))
        w = min(len(x), len(y))
        x, y = (P._folded(z, np.array([0]), np.array([len(z)]), w)[0] for z in (x, y))
        apart = int(np.bitwise_count(x ^ y).sum())
        folded += w < max(len(z) for z in (P.parity_bitmap(a), P.parity_bitmap(b)))
        assert apart <= len(a) + len(b) - 2 * P.least_overlap(len(a), len(b), pct)
    assert linked > 300 and folded > 20


def test_counters_travel_whole():
    rng = np.random.default_rng(1)
    for share, top in ((0, 1), (.01, 200), (.9, 200), (.01, 70_000), (.9, 70_000), (1, 1 << 31)):
        c = (rng.random(P.CHUNK) < share) * rng.integers(1, top + 1, P.CHUNK)
        data = P._narrow(c.astype(np.uint32))
        assert (P._wide(data) == c).all() and len(data) <= 1 + 4 * P.CHUNK


def test_long_sets_with_common_shingles(llm):
    """Sets larger than a bitmap's least bits, of sizes around a power of
    two, that share much and differ much."""
    rnd = random.Random(7)
    common = [f"c{i}" for i in range(500)]
    rows = []
    for i in range(60):
        own = [f"o{i % 20}_{j}" for j in range(rnd.choice([480, 530, 560]) if i < 20 else 530)]
        for _ in range(rnd.randint(0, 12)):
            own[rnd.randrange(len(own))] = f"x{rnd.random()}"
        rows.append((i, " ".join(own + common)))
    want, _ = brute(rows, 1, 90)
    df = llm.createDataFrame(rows, "doc_id bigint, text string")
    assert {x.doc_id: x.component_id for x in got(df, shingle_words=1, threshold_pct=90, block=8)} == want
    assert 10 < len(set(want.values())) < 60


def test_edges(llm):
    long = "c " * 3000 + "d"
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "One", "x"), (5, "oNE", "x"), (6, "a b c d", "y"),
            (6, "a b c d", "y"), (None, "a b c d", "y"), (7, "A  B\tc d", "z"), (8, long, "z"), (8, "A b C d", "q"),
            (9, "one two", "q"), (10, long, "z")]
    df = llm.createDataFrame(rows, "doc_id bigint, text string, n string").withColumn("node", llm_lit())
    r = got(df, shingle_words=3, threshold_pct=90)
    assert len(r) == len(rows)
    by = {}
    for x in r:
        by.setdefault(x.doc_id, set()).add(x.component_id)
    assert by == {1: {1}, 2: {2}, 3: {3}, 4: {4}, 5: {4}, 6: {6}, 7: {6}, 8: {6}, 9: {9}, 10: {6}, None: {None}}
    assert {x.n_shingles for x in r if x.doc_id in (1, 2, 3)} == {0}
    assert P.components(df.limit(0)).count() == 0


def llm_lit():
    from pyspark.sql import functions as F
    return F.lit("clash")


def test_one_id_with_three_texts_ties_them_all(llm):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(9, t) for t in texts]
    r = got(llm.createDataFrame(rows, "doc_id bigint, text string"))
    assert {x.component_id for x in r} == {1}


def test_query(llm, tmp_path):
    from fleetlane.llm import queries as Q
    rows = corpus(12)
    llm.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = Q.QUERIES["op13_prefixjoin"](llm, str(tmp_path))
    assert dict(r.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}
    assert {x.doc_id: x.component_id for x in r.collect()} == brute(rows, 3, 90)[0]
