"""Vector codes against plain rounds of integer k-means, and edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from fleetlane.llm import vectorcodes as V


def brute(rows, entries=256, rounds=4):
    """rows: (vec_id, vector, label) with usable vectors only."""
    x = np.array([[math.floor(1024 * c) for c in v] for _, v, _ in rows], object)
    parts = np.split(x, 4, axis=1)
    ids = sorted({i for i, _, _ in rows if i is not None})[:entries]
    first = [min(j for j, r in enumerate(rows) if r[0] == i) for i in ids]
    books = [p[first].copy() for p in parts]

    def assign():
        d = [((p[:, None, :] - b[None]) ** 2).sum(axis=2) for p, b in zip(parts, books)]
        return [m.argmin(axis=1) for m in d], sum(m.min(axis=1) for m in d)

    for _ in range(rounds):
        for m, own in enumerate(assign()[0]):
            for e in set(own.tolist()):
                held = parts[m][own == e]
                books[m][e] = held.sum(axis=0) // len(held)
    own, error = assign()
    by = {}
    for (_, _, label), e in zip(rows, error):
        by[label] = by.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel()).encode()).hexdigest()
    return sorted((str(i), "".join(f"{o[j]:02x}" for o in own), int(error[j]), int(by[label]), sha)
                  for j, (i, _, label) in enumerate(rows))


def collect(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(n=700, d=16, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, .2, (12, d))
    v = (centres[rnd.integers(0, 12, n)] + rnd.normal(0, .05, (n, d))).astype(np.float32)
    return [(int(3 * i), [float(c) for c in v[i]], None if i % 7 == 0 else int(i % 4)) for i in range(n)]


@pytest.mark.parametrize("closest", [24, 3, 1])
def test_brute_force(llm, closest):
    rows = vectors()
    random.Random(2).shuffle(rows)
    got = V.codes(llm.createDataFrame(rows, SCHEMA).repartition(3), V.CodeParams(closest=closest))
    assert collect(got) == brute(rows)


def test_ties_and_repeated_rows(llm):
    """Vectors on a coarse grid: many equal distances, entries that stay
    unused, repeated rows, a null id."""
    rnd = random.Random(4)
    rows = [(i, [rnd.randint(-2, 2) / 1024 for _ in range(8)], rnd.choice([None, 1])) for i in range(400)]
    rows += rows[:50] + [(None, [0.5] * 8, 1)]
    got = V.codes(llm.createDataFrame(rows, SCHEMA), V.CodeParams(closest=5))
    assert collect(got) == brute(rows)


def test_bounds_decide_without_error():
    """Every round equals a full search, whatever the entries do."""
    rnd = np.random.default_rng(0)
    x = rnd.integers(-300, 300, (800, 8)).astype(np.int64)
    book = x[:40].copy()
    state, decided = V.Bounds.full(x, book, 10), 0
    for scale in (40, 10, 3, 1, 0):
        new = book + rnd.integers(-scale, scale + 1, book.shape)
        state = state.take(max(2, state.near.shape[1] - 2))
        need = state.moved(x, new, V._shifts([book], [new])[0])
        book = new
        d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (state.own == d.argmin(axis=1)).all()
        reach = np.take_along_axis(d, state.near.astype(int), 1)
        assert (state.low.astype(float) ** 2 * np.sign(state.low) <= reach).all()
        decided += int((need == 0).sum())
    assert decided > 800  # bounds do decide


def test_large_components_are_exact():
    rnd = np.random.default_rng(1)
    x = rnd.integers(-2 ** 28, 2 ** 28, (50, 4)).astype(np.int64)
    book = x[:9].copy()
    got = V.Bounds.full(x, book, 4).own
    d = ((x.astype(object)[:, None, :] - book.astype(object)[None]) ** 2).sum(axis=2)
    assert (got == np.array([min(range(9), key=lambda j: (r[j], j)) for r in d])).all()


def test_edges(llm):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.1, None, 0.2, 0.3], 1), (3, [nan, 0.0, 0.0, 0.0], 1), (4, [inf, 0.0, 0.0, 0.0], 1),
            (5, [0.1, 0.2, -0.3, 0.4], 1), (6, [0.0] * 4, None), (7, [0.5, 0.5], 1), (8, [3e38, 0.0, 0.0, 0.0], None),
            (9, [-0.0001, 0.2, 0.3, 0.4], 2)]
    df = llm.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", code string, error int")
    got = {r.vec_id: r for r in V.codes(df).collect()}
    assert sorted(got) == [5, 6, 7, 8, 9]
    assert got[7].code is None and got[7].error is None and got[8].code is None
    want = {r[0]: r for r in brute([r for r in rows if r[0] in (5, 6, 9)])}
    assert {(got[i].code, got[i].error) for i in (5, 6, 9)} == {want[str(i)][1:3] for i in (5, 6, 9)}
    assert V.codes(df.limit(0)).count() == 0
    assert V.codes(df.where("vec_id < 4")).count() == 0
    odd = llm.createDataFrame([(1, [0.1] * 6, 1), (2, [0.2] * 6, 1)], SCHEMA)
    assert [len(r.code) for r in V.codes(odd).collect()] == [8, 8]
    nobody = llm.createDataFrame([(None, [0.1] * 4, 1)], SCHEMA).collect
    assert V.codes(llm.createDataFrame(nobody(), SCHEMA)).collect()[0].code is None


def test_query(llm, tmp_path):
    from fleetlane.llm import queries as Q
    rows = vectors(300, 8)
    llm.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = Q.QUERIES["op12_vectorcodes"](llm, str(tmp_path))
    assert dict(got.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint",
                                "codebooks_sha256": "string"}
    assert collect(got) == brute(rows)
