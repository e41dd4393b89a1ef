"""Source divergence against a plain computation, and the edge cases."""

import random
import re
from collections import Counter

import pytest

from fleetlane.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, min_docs=30, top=50):
    docs = [(a or "", b or "", words(t)) for a, b, t in rows]
    df = Counter((a, w) for a, _, ws in docs for w in set(ws))
    kept = {a: {w for (x, w), n in df.items() if x == a and n >= min_docs} for a in {d[0] for d in docs}}
    count = {(a, b): Counter() for a, b, _ in docs}
    for a, b, ws in docs:
        count[a, b].update(w for w in ws if w in kept[a])
    out = []
    for a, vocabulary in kept.items():
        v, whole = len(vocabulary), Counter()
        for (x, _), c in count.items():
            if x == a:
                whole.update(c)

        def price(c, w, v=v):
            return 1 + 10 ** 9 * (c[w] + 5) // (c.total() + 5 * v)

        mine = {b: {w: price(c, w) for w in vocabulary} for (x, b), c in count.items() if x == a}
        q = {w: price(whole, w) for w in vocabulary}
        for b, p in mine.items():
            parts = {"pair": [(i, sum(abs(p[w] - r[w]) for w in vocabulary)) for i, r in mine.items() if i != b],
                     "term": [(w, p[w] - q[w]) for w in vocabulary if count[a, b][w] > 0 and p[w] > q[w]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(a, b, part, i, f, r) for r, (i, f) in enumerate(items, 1) if part == "pair" or r <= top]
    return sorted(out)


def corpus(seed=3, n=400):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcXéя中") for _ in range(rnd.randint(1, 4))) for _ in range(150)]
    weight = [1 / (i + 1) for i in range(150)]
    rows = []
    for _ in range(n):
        text = rnd.choice([" ", ", ", "\n", "1"]).join(rnd.choices(vocabulary, weight, k=rnd.randint(0, 80)))
        rows.append((rnd.choice(["en", "de", None, ""]), rnd.choice(["hot"] * 4 + ["a", "b", None, "é"]), text))
    return rows


def collect(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


@pytest.mark.parametrize("block_terms", [4096, 4])
def test_brute_force(llm, block_terms):
    rows = corpus()
    df = llm.createDataFrame(rows, "lang string, source string, text string")
    got = D.audit(df, D.DivergenceParams(min_docs=10, top_terms=7, block_terms=block_terms))
    assert collect(got) == brute(rows, 10, 7)


def test_many_sources_and_column_chunks(llm, monkeypatch):
    """Sources in several buckets, columns in several chunks."""
    rnd = random.Random(5)
    rows = [("x", f"s{i % 40}", " ".join(rnd.choices(["aa", "bb", "cc", "dd"], k=rnd.randint(1, 9)))) for i in range(200)]
    monkeypatch.setattr(D, "BUCKET", 7)
    df = llm.createDataFrame(rows, "lang string, source string, text string")
    assert collect(D.audit(df, D.DivergenceParams(min_docs=5))) == brute(rows, 5)


def test_edges(llm):
    schema = "lang string, source string, text string, term string, n bigint, price bigint"
    long = " ".join(["word"] * 30_000)
    rows = [("en", "a", long, "x", 1, 1)] * 3 + [("en", "b", None, "x", 1, 1), ("en", None, "word 12 ..", "x", 1, 1),
                                                 ("fr", "a", "seul", "x", 1, 1), ("fr", "b", "", "x", 1, 1)]
    df = llm.createDataFrame(rows, schema)
    plain = [r[:3] for r in rows]
    got = collect(D.audit(df, D.DivergenceParams(min_docs=4)))
    assert got == brute(plain, 4)
    assert [r for r in got if r[0] == "fr"] == [("fr", "a", "pair", "b", 0, 1), ("fr", "b", "pair", "a", 0, 1)]
    assert D.audit(df.limit(0)).count() == 0


def test_a_long_text_counts_once(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(D, "SLICE", 1000)
    text = ("Alpha beta9 " * 500) + "ω" * 3000
    b = pa.RecordBatch.from_pydict({"lang": ["en", "en"], "source": ["s", "s"], "text": [text, "beta"]})
    got = {r["term"]: (r["n"], r["df"]) for out in D._count([b]) for r in out.to_pylist()}
    assert got == {b"alpha": (500, 1), b"beta": (501, 2), ("ω" * 3000).encode(): (1, 1)}


def test_query(llm, tmp_path):
    """The registered query over a small folder: its columns and values."""
    from fleetlane.llm import queries as Q
    rows = corpus(9, 300)
    llm.createDataFrame(rows, "lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.QUERIES["op11_divergence"](llm, str(tmp_path))
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string",
                                "value": "bigint", "rank": "int"}
    assert collect(got) == brute(rows)
