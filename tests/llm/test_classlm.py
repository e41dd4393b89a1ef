"""The class model's scores against brute force, and what scoring ships."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from fleetlane.llm import classlm, common
from fleetlane.llm.words import word_hashes


def _docs(llm, texts, parts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return llm.createDataFrame(rows, "doc_id bigint, text string").repartitionByRange(parts, "doc_id")


def _texts(n):
    rnd = random.Random(11)
    words = [f"W{i}" for i in range(30)] + [f"r{i}" for i in range(400)]
    share = [100] * 30 + [1] * 400
    texts = [" ".join(rnd.choices(words, share, k=rnd.randint(1, 60))) for _ in range(n)]
    return texts + [None, "", " \t", "new1 w1 new1 new2 r3", "new1 new1", texts[0]]


def _model(llm, df, training):
    counts = classlm.word_counts(df, training).checkpoint()
    p = classlm.ClassLmParams(classes=5, unit_share=1 / 500, known_share=1 / 60, tail_units=16, block_words=90)
    return counts, classlm.train(df, counts, training, p)


def test_scores_brute_force(llm):
    texts = _texts(150)
    df = _docs(llm, texts, 3)
    counts, m = _model(llm, df, common.fold("doc_id") != 1)
    got = {r.doc_id: r for r in classlm.score(df, counts, m).collect()}
    k, emit = m.params.classes, lambda n, c: float(m.emission(np.float64(n), c))
    word = {int(h): (int(n), int(c)) for h, n, c in zip(m.known, m.known_n, m.cls)}
    rare = {r.h & (1 << 64) - 1: (r.n, r.c) for r in m.rare.collect()}
    assert len(rare) > 200 and not set(rare) & set(word)
    word.update(rare)
    unseen = 0
    for i, t in enumerate(texts):
        h = [int(word_hashes(w.lower().encode())[0]) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        h.append(int(classlm.END))
        cls = {w: word[w][1] for w in h if w in word}
        pairs = list(zip([int(classlm.END), *h], h))
        at = lambda w: k if w == int(classlm.END) else cls.get(w)
        fits = {}
        for w in set(h) - set(word):
            unseen += 1
            fits[w] = max(range(k), key=lambda c: h.count(w) * emit(0, c)
                          + sum(m.trans[c, at(b)] for a, b in pairs if a == w and at(b) is not None)
                          + sum(m.trans[at(a), c] for a, b in pairs if b == w and at(a) is not None))
        cls.update(fits)
        want = sum(m.trans[at(a), at(b)] + emit(word.get(b, (0,))[0], at(b)) for a, b in pairs)
        assert math.isclose(got[i].score, want, rel_tol=1e-9), i
        assert (got[i].n_tokens, got[i].n_known) == (len(h), sum(w in word for w in h))
        assert math.isclose(got[i].perplexity, 10 ** (-want / len(h)), rel_tol=1e-9)
    assert unseen > 10 and len(got) == len(texts)


def test_a_chunk_asks_for_each_rarer_word_once(llm, monkeypatch):
    """What scoring ships does not grow with the uses of a rarer word in the texts read together."""
    texts = _texts(300)
    df = _docs(llm, texts, 1).coalesce(1)
    counts, m = _model(llm, df, F.lit(True))
    kept = []
    saved = classlm.saved
    monkeypatch.setattr(classlm, "saved", lambda d, name: kept.append(saved(d, name)) or kept[-1])
    assert classlm.score(df, counts, m).count() == len(texts)
    asked = [int(h) for r in kept[0].collect() for a in r.asks for h in np.frombuffer(a.h, "<u8")]
    assert len(asked) == len(set(asked)) == m.rare.count()


def test_exchange_keeps_the_table_it_moves_words_in():
    """Word by word or many at a time, a sweep's moves leave counts that were summed anew."""
    rng = np.random.default_rng(4)
    words = rng.integers(0, 120, 3000)
    at = rng.integers(0, 6, 120)
    at[0] = 6

    def counted(cls):
        t, left, right, own = np.zeros((7, 7)), np.zeros((120, 7)), np.zeros((120, 7)), np.zeros(120)
        for a, b in zip(words[:-1], words[1:]):
            t[cls[a], cls[b]] += 1
            if a == b:
                own[a] += 1
            else:
                right[a, cls[b]] += 1
                left[b, cls[a]] += 1
        return t, left, right, own

    t, left, right, own = counted(at)
    unit = np.arange(1, 120)
    for u in unit:  # the best class of one word, all others staying
        new = classlm.exchange(t, at[[u]], left[[u]], right[[u]], own[[u]], np.array([True]), 64)
        g = classlm.gains(t, at[[u]], left[[u]], right[[u]], own[[u]])[0, :-1]
        assert math.isclose(g[new[0]], g.max(), abs_tol=1e-8)
    # 100 at once: the gains by a table of small counts are those of one word alone
    many = classlm.gains(t, at[unit], left[unit], right[unit], own[unit])
    for i, u in enumerate(unit):
        assert np.allclose(many[i], classlm.gains(t, at[[u]], left[[u]], right[[u]], own[[u]])[0])


def test_sums_by_key():
    rng = np.random.default_rng(1)
    for top, most, dtype in ((50, 9, np.int64), (1 << 40, 1 << 30, np.int64), (1 << 62, 1 << 20, np.uint64)):
        keys = rng.integers(0, top, 500).astype(dtype)
        keys[:50] = keys[50:100]
        n = rng.integers(0, most, 500)
        want = {}
        for x, y in zip(keys.tolist(), n.tolist()):
            want[x] = want.get(x, 0) + y
        k, v = classlm._sum_pairs(keys, n)
        assert k.dtype == dtype and k.tolist() == sorted(want) and dict(zip(k.tolist(), v.tolist())) == want
    k, v = classlm._sum_pairs(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(k) == len(v) == 0
