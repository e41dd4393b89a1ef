"""Near duplicates against brute force, and the edge cases."""

import itertools
import random
import re

from fleetlane.llm import minhash as M


def brute(rows, k, pct):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
        sets.setdefault(i, []).append(s)
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= pct * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, sets


def corpus(seed=7):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeXYé") for _ in range(rnd.randint(1, 5)))
    base = [[word() for _ in range(rnd.randint(1, 90))] for _ in range(40)]
    rows = []
    for i in range(260):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 9])):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(w)))
    # one large group whose members are close to the threshold
    core = [word() for _ in range(60)]
    for i in range(260, 560):
        w = list(core)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(60)] = word()
        rows.append((i, " ".join(w)))
    return rows


def test_brute_force(llm):
    rows = corpus()
    for k in (2, 5):
        want, sets = brute(rows, k, 80)
        df = llm.createDataFrame(rows, "doc_id bigint, text string")
        got = M.near_duplicates(df, M.MinHashParams(shingle_words=k, block=32)).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(r.n_shingles == len(sets[r.doc_id][0]) for r in got)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(llm):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "One", "x"), (5, "oNE", "x"), (6, "a b", "y"),
            (6, "a b", "y"), (None, "a b", "y"), (7, "A  B", "z"), (8, "c " * 3000 + "d", "z"), (8, "A b", "q")]
    df = llm.createDataFrame(rows, "doc_id bigint, text string, comp string").withColumnRenamed("comp", "node")
    got = M.near_duplicates(df, M.MinHashParams(shingle_words=2)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by[1] == {(1, True)} and by[2] == {(2, True)} and by[3] == {(3, True)}
    assert by[4] == {(4, True)} and by[5] == {(4, False)}
    assert by[6] == {(6, True)} and by[7] == {(6, False)} and by[8] == {(6, False)}
    assert by[None] == {(None, True)}
    kept = M.keep_one(df, M.MinHashParams(shingle_words=2))
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6]
    empty = M.near_duplicates(df.limit(0))
    assert empty.count() == 0


def test_estimate():
    p = M.MinHashParams()
    assert 0 < p.max_mismatch < p.k
    assert M.intersections([__import__("numpy").array([1, 2, 3])], [__import__("numpy").array([2, 3, 9])])[0, 0] == 2


def test_one_id_with_three_texts_ties_them_all(llm):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(9, t) for t in texts]
    got = M.near_duplicates(llm.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {1} and {r.doc_id for r in got if r.kept} == {1}
