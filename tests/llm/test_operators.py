"""Each operator against brute force, a round trip or held-out accuracy,
with nulls, empty and long texts, repeats, empty tables and extra columns."""

import binascii
import hashlib
import io
import math
import random
import re
import struct
import zipfile
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlane.llm import ann, classlm, common, decontam, langid, packing, quality, queries, sharding, urlfilter, warc
from fleetlane.llm.words import batch_hashes, word_hashes

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum " * 30_000


def docs(llm, texts, **more):
    rows = [(i, t, "en", "src", 1, "x") for i, t in enumerate(texts)]
    return llm.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                     "score string")


def fold(i):
    return binascii.crc32(str(i).encode()) % 5


def test_word_hashes_agree_however_cut():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aB \t\né") for _ in range(rnd.randint(0, 400))).encode() for _ in range(50)]
    texts += [b"", None, (" ".join("w%d" % (i % 50) for i in range(40_000))).encode(), b"x" * 200_000 + b" y"]
    for t, h in zip(texts, batch_hashes(texts)):
        words = (t or b"").lower().split()
        assert len(h) == len(words) and (h == word_hashes(t)).all()
        assert len(set(h.tolist())) == len(set(words))


# ---- 1 language ------------------------------------------------------------

def test_language_and_spans(llm):
    rnd = random.Random(2)
    stock = {"en": ["the", "shining", "nth", "water"], "fr": ["eau", "été", "queue", "les"],
             "ru": ["вода", "огонь", "это", "мир"]}
    text = lambda g, n: " ".join(rnd.choice(stock[g]) for _ in range(n))
    rows = [(i, text(g, 40), g) for i, g in enumerate(list(stock) * 40)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 %% 3", "fr"), (903, text("en", 30) + " " + text("fr", 20), None),
             (904, text("ru", 20_000), None), (904, text("ru", 20_000), None)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string, lang string")
    m = langid.train(df)
    got = {r.doc_id: r for r in langid.detect(df.withColumn("score", F.lit("x")), m).collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows[:120]) and got[904].lang_pred == "ru"
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and got[900].score == 0
    assert got[903].n_spans == 2 and 0 < got[903].score < 1
    spans = langid.label_spans(df.where("doc_id = 903"), m).first().spans
    assert [s.lang for s in spans] == ["en", "fr"]
    assert rows[123][1][spans[1].start:spans[1].end].split()[0] in stock["fr"]
    assert langid.keep_known(df, m).count() == 123
    assert langid.detect(df.limit(0), m).count() == 0
    none = langid.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.detect(df.limit(3), none).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    m = langid.Model(langid.LangParams(switch=1.5), ["a", "b", "c"], None, None)
    e = np.log(rng.dirichlet([1, 1, 1], 12))
    first = np.array([0, 7, 7, 12])
    lab = np.zeros(12, int)
    m._viterbi(e, first, np.array([0, 2]), lab)

    def value(path, rows):
        return sum(e[r, x] for r, x in zip(rows, path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))

    import itertools
    for lo, hi in ((0, 7), (7, 12)):
        best = max(value(p, range(lo, hi)) for p in itertools.product(range(3), repeat=hi - lo))
        assert math.isclose(best, value(lab[lo:hi], range(lo, hi)))


def test_label_equals_every_path_tried():
    """The shortcut before Viterbi included: random emissions, and the case
    of two runs in two other languages that share one switch."""
    import itertools
    rng = np.random.default_rng(5)
    m = langid.Model(langid.LangParams(switch=8.0), ["a", "b", "c"], None, None)
    cases = [np.array([[-7.0, 0, -20], [-7, -20, 0]])]
    cases += [np.log(rng.dirichlet([.2, .2, .2], rng.integers(1, 7))) * rng.choice([1, 3, 6]) for _ in range(300)]

    def value(e, path):
        return sum(e[t, x] for t, x in enumerate(path)) - 8.0 * sum(a != b for a, b in zip(path, path[1:]))

    for lo in range(0, len(cases), 7):
        part = cases[lo:lo + 7]
        e = np.concatenate(part)
        m._emissions = lambda codes, e=e: (e, np.ones(len(e), np.int64), np.arange(len(e)) * 2)
        lab, *_, first, _ = m.label([" ".join("x" * len(c))[:2 * len(c) - 1] for c in part])
        for c, a, z in zip(part, first, first[1:]):
            best = max(value(c, p) for p in itertools.product(range(3), repeat=len(c)))
            assert math.isclose(best, value(c, lab[a:z].tolist()), abs_tol=1e-9)


def test_scores_of_words_do_not_depend_on_what_is_known(monkeypatch):
    rng = np.random.default_rng(2)
    p = langid.LangParams(table_log2=8)
    new = lambda: langid.Model(p, ["a", "b"], logp, np.ones((len(langid.SCRIPTS), 2), bool))
    logp = np.log(rng.dirichlet(np.ones(2), 256))
    rnd = random.Random(1)
    texts = [" ".join("".join(rnd.choice("abCéя中") for _ in range(rnd.randint(1, 6))) for _ in range(50)) for _ in range(20)]
    texts += ["x" * 10_000 + " y", "", "12", "é" * 40]
    want = [new().detect([t]) for t in texts]
    monkeypatch.setattr(langid, "KNOWN", 16)
    monkeypatch.setattr(langid, "SLICE", 37)
    m = new()
    for t, w in zip(texts * 2, want * 2):
        got = m.detect([t])
        assert got[0] == w[0] and np.allclose(got[1], w[1]) and (got[2] == w[2]).all()


# ---- 2 quality -------------------------------------------------------------

def test_quality(llm):
    rnd = random.Random(4)
    good = lambda: " ".join(rnd.choice("of the river stone wind and light".split()) for _ in range(60)) + "."
    bad = lambda: " ".join(rnd.choice(["BUY!!", "$$$", "|", "NOW%%"]) for _ in range(60))
    texts = [good() if i % 3 else bad() for i in range(300)] + [None, "", LONG]
    df = docs(llm, texts)
    labels = llm.createDataFrame([(i, int(i % 3 > 0), "x") for i in range(300)] + [(5, None, "x")],
                                 "doc_id bigint, quality int, text string")
    m = quality.train(df, labels)
    got = {r.doc_id: r.score for r in quality.score(df, m).collect()}
    assert len(got) == 303 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(300) if fold(i) == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in held]) > 0.95
    assert quality.keep_good(df, m).columns == df.columns
    assert quality.score(df.limit(0), m).count() == 0
    assert {r.score for r in quality.score(df.limit(2), quality.train(df, labels.limit(0))).collect()} == {0.5}


def test_fm_pair_sum_identity():
    p = quality.FmParams(word_log2=4, bins=3, rank=2)
    d = 16 + len(quality.STATS) * 3
    rng = np.random.default_rng(0)
    m = quality.Model(p, np.zeros((len(quality.STATS), 2)), 0.3, rng.normal(size=d), rng.normal(size=(d, 2)))
    words, stats = quality.features([b"a b b c"], [7], p)
    x = np.zeros(d)
    x[words[0][0]] = words[0][1]
    x[16 + np.arange(len(quality.STATS)) * 3 + quality.bin_stats(stats, m.edges)[0]] = 1 / math.sqrt(len(quality.STATS))
    z = 0.3 + m.w @ x + sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in range(d) for j in range(i))
    assert math.isclose(m.score([b"a b b c"], [7])[0], 1 / (1 + math.exp(-z)), rel_tol=1e-6)


# ---- 3 URL lists -----------------------------------------------------------

def test_url_lists(llm):
    entries = llm.createDataFrame(
        [("l", "ex.org", 10, "add"), ("l", "ex.org", 20, "remove"), ("l", "ex.org", 30, "add"), ("k", "a.ex.org/p", 0, "add"),
         ("k", "a.ex.org/p", 5, "add"), ("l", "z.net", 3, "add"), ("l", "z.net", 3, "remove"), (None, "q", 1, "add")],
        "list string, rule string, at bigint, action string")
    caps = [(1, "http://u:p@A.ex.org:80/p/q?x#y", 15), (2, "http://a.ex.org/p2", 15), (3, "http://ex.org", 20),
            (4, "https://ex.org/", 31), (5, None, 15), (6, "junk", 15), (7, "http://ex.org", None), (8, "http://z.net/", 4),
            (9, "http://notex.org/", 15), (1, "http://u:p@A.ex.org:80/p/q?x#y", 15)]
    df = llm.createDataFrame(caps, "page_id bigint, url string, fetched bigint").withColumn("rule", F.lit("x"))
    got = {}
    for size in (7, 1_000_000):
        rows = urlfilter.listed(df, entries, urlfilter.UrlFilterParams(bucket_seconds=size)).collect()
        assert len(rows) == len(caps)
        got[size] = {r.page_id: (r.blocked, r.n_rules, r.lists, r.rule, r.valid_from) for r in rows}
    assert got[7] == got[1_000_000]
    g = got[7]
    assert g[1] == (True, 2, "k,l", "a.ex.org/p", 5) and g[2] == (True, 1, "l", "ex.org", 10)
    assert g[4] == (True, 1, "l", "ex.org", 30)
    assert all(g[i] == (False, 0, None, None, None) for i in (3, 5, 6, 7, 8, 9))
    assert urlfilter.listed(df.limit(0), entries).count() == 0
    assert not any(r.blocked for r in urlfilter.listed(df, entries.limit(0)).collect())


def test_rules_and_actions_however_written(llm):
    captures = llm.createDataFrame([(1, "http://Ex.ORG./A/b/c", 50), (2, "http://x.ex3.org/", 50), (3, "http://ex4.org/a", 50)],
                                   "page_id bigint, url string, fetched bigint")
    entries = llm.createDataFrame([("l", " eX.org.//A/b/ ", 10, " ADD"), ("l", "ex.org/A/b", 20, "update"),
                                   ("l", "ex3.org.", 10, "Add"), ("l", "ex4.org", 10, "add"), ("l", "EX4.org", 40, "REMOVE")],
                                  "list string, rule string, at bigint, action string")
    got = {r.page_id: r.rule for r in urlfilter.listed(captures, entries).collect()}
    assert got == {1: "ex.org/A/b", 2: "ex3.org", 3: None}


def test_columns_that_clash(llm):
    """Foreign n_chars columns, and shard and slot in the table to be
    sharded."""
    texts = ["good words here " * 9, "BUY!! $$$ " * 9] * 30
    labels = llm.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id bigint, quality int")
    base = llm.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for extra in (F.lit("many"), F.lit(2.5), F.lit(None).cast("string"), F.array(F.lit(1)), F.lit("17")):
        df = base.withColumn("n_chars", extra).withColumn("n", F.lit("x"))
        m = quality.train(df, labels)
        assert quality.score(df, m).count() == 60
        kept = quality.keep_good(df, m)
        assert kept.columns == df.columns and kept.count() == 30
    df = base.withColumns({"shard": F.lit("a"), "Slot": F.lit(1.5), "row": F.lit("r"), "__part": F.lit("p"), "__row": F.lit("q"),
                           "__sub": F.lit(None).cast("string")})
    out = sharding.shard(df, sharding.ShardParams(shards=7))
    assert out.columns == ["doc_id", "text", "row", "__part", "__row", "__sub", "shard", "slot"]
    assert sorted(r.doc_id for r in out.collect()) == list(range(60)) and {r.row for r in out.collect()} == {"r"}


def test_shard_placements_are_uniform():
    """Frequencies of all placements of a tiny table: four rows, two by two
    to two shards, from partitions of one, two and one rows."""
    n, seen = 6000, Counter()
    for seed in range(n):
        rng = random.Random(seed)
        rows, place = [[0], [1, 2], [3]], {}
        for part, m in zip(rows, sharding.communication_matrix([1, 2, 1], 2, seed)):
            order = rng.sample(part, len(part))          # the local permutation
            for r, s in zip(order, [0] * int(m[0]) + [1] * int(m[1])):
                place[r] = s
        seen[tuple(place[r] for r in range(4))] += 1
    assert len(seen) == 6 and all(sum(p) == 2 for p in seen)
    assert sum((c - n / 6) ** 2 / (n / 6) for c in seen.values()) < 20.5      # chi-squared, 5 degrees: p = 0.001


# ---- 4 packing -------------------------------------------------------------

def test_packing(llm):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["a", "the", " ", "  ", "\n", "é", " ", "'s", "1", ".", "\t"]) for _ in range(rnd.randint(0, 300)))
             for _ in range(120)] + [None, "", "x y " * 3000, "same", "same", "<|endoftext|> q", "a  <|endoftext|>  b <|endoftext|>", "x<|endoftext|>", "a\0b \0 c", "end \n\n", "\n x\n\n\n y"]
    df = docs(llm, texts).repartition(3)
    out = packing.pack(df, path, packing.PackParams(length=128, open_windows=4)).collect()
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    seqs, parts = {}, {}
    for r in out:
        assert len(r.ids) == 4 * r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        parts.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0] + [n for _, n in s])[:-1]) and sum(n for _, n in s) <= 128
    for i, t in enumerate(texts):
        ids = b"".join(x for _, x, _ in sorted(parts[i]))
        want = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert list(struct.unpack(f"<{len(want)}I", ids)) == want and parts[i][0][2] == len(want)
    total = sum(r.length for r in out)
    assert total / (128 * len(seqs)) > 0.9
    assert packing.pack(df.limit(0), path).count() == 0


@pytest.mark.parametrize("limit,size,long", [(40, 1 << 22, 1 << 16), (30, 40, 6), (50, 100, 20)])
def test_segment_tokenizer_equals_the_plain_call(limit, size, long):
    """With small slices, long cuts and few kept cuts too; the plain call is
    the tokenizer's own, added tokens included."""
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, plain = packing.SegmentTokenizer(path), Tokenizer.from_file(path)
    tok.LIMIT, tok.SLICE, tok.LONG = limit, size, long
    rnd = random.Random(8)
    pieces = ["a", "the", " ", "  ", "\n", "é", " ", "'s", "1", ".", "\t", "<|endoftext|>", "\0", "\u3000", "\u2028", "中", "“", "\x1c",
              "don't", " <|endoftext|>", "\u00a0", "x\t"]
    for _ in range(60):
        texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(1, 9))]
        texts += [" ".join(chr(rnd.randint(0x21, 0x3100)) for _ in range(rnd.randint(0, 12)))]
        for t, ids in zip(texts, tok.encode(pa.array(texts, pa.string()))):
            assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, t
    assert 0 < len(tok.young.at) <= limit and len(tok.old.at) <= limit
    for texts in (["a  b", "\0"], ["", ""], [" "]):
        assert [i.tolist() for i in tok.encode(pa.array(texts))] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(tok.encode(pa.array([], pa.string()))) == []


def test_a_long_text_without_spaces_is_cut_by_the_word_pattern():
    tok = packing.SegmentTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    text = "".join(f"{'字' * (i % 7)}，{i}ab" for i in range(40_000))
    ids = next(iter(tok.encode(pa.array([text]))))
    assert ids.tolist() == tok.tok.encode(text, add_special_tokens=False).ids


def test_contractions_that_start_a_text_anywhere_in_a_batch():
    tok = packing.SegmentTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    starts = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'tis", "'", "''s", "'S", "!'s", "’s"]
    texts = [t for i, s in enumerate(starts) for t in (f"w{i}", f"{s}", f"{s} x", f"{s}. {s}", f"v{i}'", f"{s}{i}")]
    for part in (texts, texts[::-1], texts * 3):
        for t, ids in zip(part, tok.encode(pa.array(part, pa.string()))):
            assert ids.tolist() == tok.tok.encode(t, add_special_tokens=False).ids, t
        tok = packing.SegmentTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


# ---- 6 class language model -------------------------------------------------

def test_class_model(llm):
    rnd = random.Random(6)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    texts = [" ".join(f"{rnd.choice(nouns)} {rnd.choice(verbs)}" for _ in range(20)) for _ in range(200)]
    texts += [None, "", "N1 V2 unseen_word", "N1 V2 unseen_word", LONG]
    df = docs(llm, texts)
    training = common.fold("doc_id") != 1
    counts = classlm.word_counts(df, training).checkpoint()
    # so few known words that most counts come by the join
    p = classlm.ClassLmParams(classes=4, unit_share=1 / 1000, known_share=1 / 40, tail_units=16)
    m = classlm.train(df, counts, training, p)
    got = {r.doc_id: r for r in classlm.score(df, counts, m).collect()}
    toks = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None] for t in texts]
    c = Counter(w for i, t in enumerate(toks) if fold(i) != 1 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(toks):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in t), rel_tol=1e-9)
    small = [i for i in range(200) if fold(i) == 1]
    assert sum(got[i].score for i in small) > sum(got[i].base_score for i in small)
    # probabilities: classes after a class, and words with one unseen in a class
    assert np.allclose((10 ** m.trans).sum(axis=1), 1)
    assert m.tokens.sum() == n and m.types.sum() == v
    assert classlm.score(df.limit(0), counts, m).count() == 0


def _likelihood(t):
    phi = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return phi(t) - phi(t.sum(0)) - phi(t.sum(1))


def test_exchange_gains_brute_force():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 90, 4000)
    cls = rng.integers(0, 4, 90)
    cls[0] = 4
    def table(c):
        t = np.zeros((5, 5))
        np.add.at(t, (c[words[:-1]], c[words[1:]]), 1)
        return t
    left, right, own = np.zeros((90, 5)), np.zeros((90, 5)), np.zeros(90)
    for a, b in zip(words[:-1], words[1:]):
        if a == b:
            own[a] += 1
        else:
            right[a, cls[b]] += 1
            left[b, cls[a]] += 1
    all_at_once = classlm.gains(table(cls), cls, left, right, own)
    for u in range(1, 90):
        alone = classlm.gains(table(cls), cls[[u]], left[[u]], right[[u]], own[[u]])[0]
        assert np.allclose(alone, all_at_once[u])
        def at(c):
            other = cls.copy()
            other[u] = c
            return _likelihood(table(other))
        assert np.allclose(alone - alone[cls[u]], [at(c) - at(cls[u]) for c in range(5)], atol=1e-6)


def test_rare_words_are_clustered_too(llm):
    """Words of three uses get the class of their neighbours, not of their hash."""
    rnd = random.Random(9)
    rare = [(f"r{i}", i % 2) for i in range(600)] * 3
    rnd.shuffle(rare)
    texts = [" ".join(f"{'ab'[s]} {w} {'cd'[s]}" for w, s in rare[i:i + 30]) for i in range(0, len(rare), 30)]
    df = docs(llm, texts)
    training = F.lit(True)
    counts = classlm.word_counts(df, training).checkpoint()
    p = classlm.ClassLmParams(classes=8, unit_share=1 / 50, known_share=1 / 50, tail_units=16, block_words=100)
    was = llm.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for parts in ("3", was):
            llm.conf.set("spark.sql.shuffle.partitions", parts)
            m = classlm.train(df, counts, training, p)
            seen.append(sorted((r.h, r.n, r.c) for r in m.rare.collect()))
    finally:
        llm.conf.set("spark.sql.shuffle.partitions", was)
    assert seen[0] == seen[1] and len(seen[0]) == 600  # every rare word, whatever the session's setting
    cls = {h: c for h, _, c in seen[0]}
    of = lambda w: cls[int(word_hashes(w.encode()).view(np.int64)[0])]
    sides = [Counter(of(f"r{i}") for i in range(s, 600, 2)) for s in (0, 1)]
    assert sum(min(sides[0][c], sides[1][c]) for c in range(8)) < 30  # hash classes share about 300


# ---- 7 shards ---------------------------------------------------------------

def test_shards(llm):
    rows = [(i % 90, None if i % 7 == 0 else f"t{i}") for i in range(1003)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    p = sharding.ShardParams(shards=8, slice_rows=50)
    out = sharding.shard(df, p).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert {len(s) for s in by.values()} <= {125, 126} and all(sorted(s) == list(range(len(s))) for s in by.values())
    few = sharding.shard(df.limit(3), p).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0] and sharding.shard(df.limit(0), p).count() == 0
    m = sharding.communication_matrix([5, 0, 9, 2], 3, 1)
    assert m.sum(1).tolist() == [5, 0, 9, 2] and sorted(m.sum(0).tolist()) == [5, 5, 6]


def test_hypergeometric_beyond_numpys_limit():
    rng = np.random.default_rng(0)
    good, bad, n = 3_000_000_000, 9_000_000_000, 40_000
    x = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(4000)])
    assert abs(x.mean() - n / 4) < 6 and abs(x.std() / math.sqrt(n * 3 / 16) - 1) < 0.05


# ---- 8 nearest neighbours ----------------------------------------------------

def test_nearest(llm):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[200:500] = x[7]
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 3), (None, [1.0] * 16), rows[40]]
    df = llm.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x"))
    p = ann.HnswParams(min_shards=2, ef_search=64)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, p).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hit, d = 0, x.astype(np.float64)
    for q, rs in got.items():
        rs.sort()
        s = d @ d[q]
        s[q] = -np.inf
        want = sorted(range(1500), key=lambda i: (-s[i], i))[:20]
        assert [r for r, _, _ in rs] == list(range(1, 21)) and all(math.isclose(s[i], v, abs_tol=1e-9) for _, i, v in rs)
        assert [(-v, i) for _, i, v in rs] == sorted((-v, i) for _, i, v in rs)
        hit += len(set(want) & {i for _, i, _ in rs})
    assert hit / (20 * len(got)) > 0.95
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).count() == 4


# ---- 9 WARC packages ----------------------------------------------------------

def test_warc_round_trip(llm):
    big, other = "<p>ü</p>" * 300, "z" * 1000
    rows = [(1, "http://a/", big), (9, "http://b/\nX: y", big), (5, None, big), (2, "u", other), (3, "u", "short"),
            (4, "u", "short"), (6, "u", None), (-7, "u", other), (None, "u", other), (9, "http://b/\nX: y", big)]
    df = llm.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("x"))
    root = common.scratch_folder(llm, "warc-test")
    packages = warc.write_packages(df.repartition(2), root, warc.WarcParams(package_bytes=700))
    out = warc.read_packages(packages).collect()
    assert len(out) == len(rows) and packages.count() > 2
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == b and j is not None]
        keep = max(same, default=None)
        rev = len(b) >= 1000 and i is not None and i != keep
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if rev else "response", keep if rev else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    none = warc.write_packages(df.limit(0), root)
    assert none.count() == 0 and warc.read_packages(none).count() == 0


class _Bytes:
    def __init__(self, b):
        self.b = b

    def read_at(self, n, at):
        return self.b[at:at + n]


def test_zip64_directories(monkeypatch):
    import gzip
    rec = [gzip.compress(x * 50) for x in (b"one", b"two", b"three")]
    for limit in (None, 10):
        if limit:  # every size and offset then overflows into ZIP64 records
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
            monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr("readme", "x" * 99)
            z.writestr("archive/other.warc.gz", b"".join(rec))
            z.comment = b"note"
        f = _Bytes(out.getvalue())
        names = [e["name"] for e in warc.central_directory(f, len(f.b))]
        assert names == ["readme", "archive/other.warc.gz"]
        got = [gzip.decompress(f.read_at(n, at)) for at, n in warc.records_of(f, len(f.b))]
        assert got == [b"one" * 50, b"two" * 50, b"three" * 50]
    with pytest.raises(ValueError):
        list(warc.central_directory(_Bytes(b"nothing"), 7))


# ---- 10 decontamination ----------------------------------------------------------

def _tiles(item, doc, s):
    """Greedy string tiling by trying every pair of positions."""
    a, b, out = [False] * len(item), [False] * len(doc), 0
    while True:
        best, where = s - 1, []
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not a[i + n] and not b[d + n]:
                    n += 1
                if n > best:
                    best, where = n, []
                if n == best and n >= s:
                    where.append((d, i))
        if not where:
            return out
        for d, i in where:
            if not any(a[i:i + best]) and not any(b[d:d + best]):
                a[i:i + best], b[d:d + best] = [True] * best, [True] * best
                out += best


def test_tiling_brute_force():
    rnd = random.Random(9)
    for _ in range(60):
        item = [rnd.randrange(4) for _ in range(rnd.randint(0, 25))]
        doc = [rnd.randrange(4) for _ in range(rnd.randint(0, 40))]
        t = decontam.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), 3)
        assert sum(n for _, _, n in t) == _tiles(item, doc, 3)
        assert all(item[i:i + n] == doc[d:d + n] for i, d, n in t)


def test_contaminated(llm):
    w = [f"w{i}" for i in range(60)]
    item = " ".join(w[:30])
    mixed = " ".join(w[20:30] + ["x"] + w[:10] + ["y"] + w[10:20])
    texts = ["pad " * 50 + item.upper() + ".", mixed, " ".join(w[:14]) + " end", "clean text here now and then", None, "",
             LONG + item, " ".join(reversed(w))]
    df = docs(llm, texts + [texts[1]])
    df = df.unionByName(df.where("doc_id = 0")).unionByName(df.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("bigint")))
    bench = llm.createDataFrame([(7, item, "x"), (8, "a b", "x"), (9, None, "x"), (7, item, "x")],
                                "item_id bigint, text string, coverage string")
    got = {(r.doc_id, r.item_id): (r.covered_words, r.n_tiles) for r in decontam.contaminated(df, bench).collect()}
    assert got == {(0, 7): (30, 1), (1, 7): (30, 3), (6, 7): (30, 1), (8, 7): (30, 3)}
    kept = decontam.remove_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [2, 3, 4, 5, 7]
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0


# ---- registered queries and the pipeline ------------------------------------------

def test_registered_names():
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline(llm, tmp_path):
    rnd = random.Random(10)
    good = lambda: " ".join(rnd.choice("of the river stone wind and light falls on".split()) for _ in range(80)) + "."
    bad = lambda: " ".join(rnd.choice(["BUY!!", "$$$", "|", "NOW%%"]) for _ in range(60))
    item = " ".join(f"w{i}" for i in range(30))
    texts = [bad() if i % 4 == 0 else good() for i in range(200)]
    texts += [texts[1], texts[2], good() + " " + item, None, ""]
    docs(llm, texts).drop("score").write.parquet(str(tmp_path / "documents.parquet"))
    llm.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id bigint, quality int, toxic int"
                        ).write.parquet(str(tmp_path / "labels.parquet"))
    llm.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(llm, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    clean = {i for i in range(200) if i % 4}
    assert len(clean - ids) <= 3 and len(ids & (set(range(200)) - clean)) <= 2
    assert not ids & {200, 201, 202, 203, 204}
