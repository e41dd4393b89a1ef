"""Language of texts, with mixed-language spans.

A word is a run of letters (a run of more than 4,096 is several).  Its script (Unicode ranges) narrows the
languages it may belong to: those whose training text has that script.
Each candidate scores the word by the log probabilities of its character
1- to 4-grams (hashed counts per language, with the word's borders).
Viterbi over a text's words with a penalty for each switch of language
gives the spans; the text's language is the one whose spans hold most
letters, and the score is that share of letters times how clearly the words
of the spans prefer it.

A path with m switches has at most m + 1 runs in other languages than the
text's best single one.  If no run of words in one other language gains more
than half the penalty, all of them gain at most what the switches cost, so
the text is one span without Viterbi; the others go through Viterbi side by
side, word by word.  A word is scored once while a task knows it: scores of
words are kept in two generations of bounded size.  Texts are scored in
slices; what is kept of a long text is a score per word and language.

The model is counted on a bounded sample of the training folds
(``max_docs_per_lang`` documents of each language, those with the smallest
hashed ids; a cut-off from the languages' counts leaves little more than
these to be ranked).  Of several rows with one id and language one is taken.

Edge cases: null texts and texts without a letter are ``und`` with score 0;
ties go to the first language by name; with no labelled rows everything is
``und``; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlane.llm.common import fold, mix64

UND = "und"

# First code point of each range and its script (Unicode).
SCRIPT_RANGES = ((0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
                 (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
                 (0x0A00, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x1000, "Myanmar"),
                 (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1E00, "Latin"),
                 (0x1F00, "Greek"), (0x2000, "Latin"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"),
                 (0x3130, "Hangul"), (0x3190, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Han"),
                 (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"),
                 (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han"))
SCRIPTS = tuple(sorted({s for _, s in SCRIPT_RANGES}))
_STARTS = np.array([a for a, _ in SCRIPT_RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES], np.int8)


@dataclass(frozen=True)
class LangParams:
    max_docs_per_lang: int = 1000  # bound of the labelled sample
    orders: int = 4                # character n-grams of 1 to n
    table_log2: int = 15           # hashed n-grams per language
    switch: float = 8.0            # penalty of a change of language
    weight: float = 0.5            # n-grams overlap: scale of a word's score
    script_share: float = 0.01     # least share of letters for a script


SLICE = 1 << 20          # characters scored together
LONG_WORD = 4096
KNOWN = 1 << 17          # words of a generation, of at most KNOWN_LETTERS
KNOWN_LETTERS = 32

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters (built once per worker)."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def _codes(texts: list[str]) -> np.ndarray:
    """Lower-case code points; every text is followed by a line end."""
    return np.frombuffer("".join(t.lower() + "\n" for t in texts).encode("utf-32-le", "replace"), np.uint32)


def _word_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with 0 in place of non-letters; word starts; word ends."""
    letter = _letters()[codes]
    c = np.where(letter, codes, 0).astype(np.uint32)
    edge = np.flatnonzero(np.diff(letter.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    if len(starts) and (ends - starts).max() > LONG_WORD:
        parts = -(-(ends - starts) // LONG_WORD)
        k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends = np.repeat(starts, parts) + k * LONG_WORD, np.repeat(ends, parts)
        ends = np.minimum(ends, starts + LONG_WORD)
    return c, starts, ends


def _bordered(c: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words one after the other with a 0 before and after each, and their
    new starts."""
    at = np.cumsum(lens + 1) - lens
    out = np.zeros(int(lens.sum()) + len(lens) + 1, np.uint64)
    within = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    out[np.repeat(at, lens) + within] = c[np.repeat(starts, lens) + within]
    return out, at


def _ngrams(c: np.ndarray, p: LangParams):
    """For each order, the table slot of the n-gram at each position."""
    padded = np.concatenate([c, np.zeros(p.orders, np.uint64)])
    mask = np.uint64((1 << p.table_log2) - 1)
    acc = np.zeros(len(c), np.uint64)
    for n in range(1, p.orders + 1):
        acc = acc * np.uint64(0x100000001B3) + padded[n - 1:n - 1 + len(c)] + np.uint64(n)
        yield n, (mix64(acc) & mask).astype(np.int64)


def _valid(n: int, lens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word number and first position of each word's n-grams (from its left
    border, or the word's first letter for single letters)."""
    lead = 0 if n == 1 else 1
    k = np.maximum(lens + 2 * lead - n + 1, 0)
    w = np.repeat(np.arange(len(lens)), k)
    at = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    return w, at + (starts - lead)[w]


class _Known:
    """Words and their scores."""

    def __init__(self, k: int):
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((0, k))

    def add(self, keys: list[bytes], rows: np.ndarray) -> None:
        self.at.update(zip(keys, range(len(self.at), len(self.at) + len(keys))))
        self.rows = np.concatenate([self.rows, rows])


class Model:
    def __init__(self, p: LangParams, langs: list[str], logp: np.ndarray, scripts: np.ndarray):
        self.p, self.langs, self.logp, self.scripts = p, langs, logp, scripts
        self._forget()

    def _forget(self) -> None:
        self.young, self.old = _Known(len(self.langs)), _Known(len(self.langs))

    def __getstate__(self):
        k = len(self.langs)
        return {**self.__dict__, "young": _Known(k), "old": _Known(k)}

    def _score(self, c: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Scores (words x languages), 0 for a word's best language."""
        c, starts = _bordered(c, starts, lens)
        e = np.zeros((len(starts), len(self.langs)))
        for n, slot in _ngrams(c, self.p):
            w, at = _valid(n, lens, starts)
            if len(w):
                part = self.logp[slot[at]]
                for j in range(len(self.langs)):
                    e[:, j] += np.bincount(w, weights=part[:, j], minlength=len(lens))
        e *= self.p.weight
        script = _SCRIPT[np.searchsorted(_STARTS, c[starts], "right") - 1]
        ok = self.scripts[script]                      # words x languages
        ok[~ok.any(axis=1)] = True
        e = np.where(ok, e, e.min(axis=1, keepdims=True) - 50.0)
        return e - e.max(axis=1, keepdims=True)

    def _slice(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, lengths and starts of the words of one slice; each
        different word is scored once, known ones not at all."""
        c, starts, ends = _word_spans(codes)
        lens = ends - starts
        offsets = np.concatenate([[0], np.cumsum(lens)])
        flat = np.concatenate([c[c > 0], np.zeros(1, np.uint32)])
        words = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer((offsets * 4).astype(np.int32)),
                                                               pa.py_buffer(flat)]).dictionary_encode()
        keys, code = words.dictionary.to_pylist(), words.indices.to_numpy()
        table, todo = np.empty((len(keys), len(self.langs))), np.arange(len(keys))
        for g in (self.young, self.old):
            at = np.fromiter((g.at.get(keys[i], -1) for i in todo.tolist()), np.int64, len(todo))
            table[todo[at >= 0]] = g.rows[at[at >= 0]]
            todo = todo[at < 0]
            if g is self.young:
                fresh = todo
        if len(todo):
            flat = np.frombuffer(b"".join(keys[i] for i in todo.tolist()), np.uint32)
            n = np.array([len(keys[i]) // 4 for i in todo.tolist()], np.int64)
            table[todo] = self._score(flat, np.cumsum(n) - n, n)
        keep = np.array([i for i in fresh.tolist() if len(keys[i]) <= 4 * KNOWN_LETTERS][:KNOWN], np.int64)
        if len(self.young.at) + len(keep) > KNOWN:
            self.young, self.old = _Known(len(self.langs)), self.young
        self.young.add([keys[i] for i in keep.tolist()], table[keep])
        return table[code], lens, starts

    def _emissions(self, codes: np.ndarray):
        """Word scores (words x languages), lengths and starts, slice by
        slice; slices end behind a character that is no letter."""
        out, lo = [], 0
        while lo < len(codes):
            hi = min(lo + SLICE, len(codes))
            if hi < len(codes):
                stop = np.flatnonzero(~_letters()[codes[hi:hi + SLICE]])
                hi = hi + int(stop[0]) + 1 if len(stop) else min(hi + SLICE, len(codes))
            e, lens, starts = self._slice(codes[lo:hi])
            out.append((e, lens, starts + lo))
            lo = hi
        if not out:
            return np.zeros((0, len(self.langs))), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))

    def label(self, texts: list[str]):
        """(word labels, word scores, lengths, word starts, first word of
        each text) of the texts taken together; starts count code points,
        each text being followed by one."""
        codes = _codes(texts)
        e, lens, starts = self._emissions(codes)
        bounds = np.cumsum([0] + [len(t.lower()) + 1 for t in texts])
        first = np.searchsorted(starts, bounds)
        lab = np.zeros(len(starts), np.int64)
        if not len(starts):
            return lab, e, lens, starts, first, bounds
        n = np.diff(first)
        text_of = np.repeat(np.arange(len(texts)), n)
        total = np.stack([np.bincount(text_of, weights=e[:, j], minlength=len(texts))
                          for j in range(e.shape[1])], axis=1)
        best = total.argmax(axis=1)
        lab[:] = best[text_of]
        gain = e - e[np.arange(len(e)), lab][:, None]
        # largest sum of a run of words in another language, per text
        mixed = np.zeros(len(texts), bool)
        off = text_of * (np.abs(gain).sum() + 1.0)
        for j in range(e.shape[1]):
            run = np.cumsum(gain[:, j]) - off
            before = np.concatenate([run[:1] * 0, run[:-1]])
            at0 = first[:-1][n > 0]
            before[at0] = np.concatenate([[0.0], np.cumsum(gain[:, j])])[at0] - off[at0]
            top = run - np.minimum.accumulate(before)
            mixed |= np.bincount(text_of, weights=top > self.p.switch / 2, minlength=len(texts)) > 0
        self._viterbi(e, first, np.flatnonzero(mixed), lab)
        return lab, e, lens, starts, first, bounds

    def _viterbi(self, e, first, texts, lab) -> None:
        """Best paths of the given texts, side by side: at step t the t-th
        word of every text that has one.  Rows of a step lie together,
        longest text first, so a step is a few operations on slices.  With
        one penalty for every switch a language's best predecessor is itself
        or the best of all."""
        n = (first[1:] - first[:-1])[texts]
        order = np.argsort(-n, kind="stable")
        s, n = first[:-1][texts][order], n[order]
        if not len(n):
            return
        live = np.searchsorted(-n, -np.arange(int(n[0])), "left")  # texts longer than t
        off = np.concatenate([[0], np.cumsum(live)])
        step = np.repeat(np.arange(len(live)), live)
        word = s[np.arange(len(step)) - off[step]] + step
        v = e[word]
        bounds = list(zip(off[:-1].tolist(), live.tolist()))
        for (p, _), (o, a) in zip(bounds, bounds[1:]):
            prev = v[p:p + a]
            v[o:o + a] += np.maximum(prev, prev.max(axis=1, keepdims=True) - self.p.switch)
        top = v.argmax(axis=1)
        stay = v >= v[np.arange(len(v)), top][:, None] - self.p.switch
        path = np.empty(len(v), np.int64)
        last = bounds[-1]
        path[last[0]:last[0] + last[1]] = top[last[0]:last[0] + last[1]]
        rows = np.arange(len(n))
        for (p, b), (o, a) in zip(bounds[-2::-1], bounds[:0:-1]):
            cur = path[o:o + a]
            path[p:p + a] = np.where(stay[p + rows[:a], cur], cur, top[p:p + a])
            path[p + a:p + b] = top[p + a:p + b]   # texts that end here
        lab[word] = path

    def detect(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, spans) per text."""
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        lab, e, lens, _, first, _ = self.label([t or "" for t in texts])
        k, n = len(self.langs), np.diff(first)
        text_of = np.repeat(np.arange(len(texts)), n)
        mass = np.bincount(text_of * k + lab, weights=lens, minlength=len(texts) * k).reshape(len(texts), k)
        best = mass.argmax(axis=1)
        q = np.exp(e)
        own = q[np.arange(len(e)), lab] / q.sum(axis=1) if len(e) else np.zeros(0)
        mine = lab == best[text_of]
        sure = np.bincount(text_of, weights=own * mine * lens, minlength=len(texts))
        score = np.clip(sure / np.maximum(mass.sum(axis=1), 1), 0, 1)
        change = np.concatenate([[True], (lab[1:] != lab[:-1]) | (text_of[1:] != text_of[:-1])])[:len(lab)]
        spans = np.bincount(text_of, weights=change, minlength=len(texts)).astype(np.int64)
        return [self.langs[b] if m else UND for b, m in zip(best, n > 0)], np.where(n > 0, score, 0.0), spans

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Per text: (start, end, language) in characters of the lower-cased text."""
        out: list[list] = [[] for _ in texts]
        if self.langs:
            lab, _, lens, starts, first, bounds = self.label([t or "" for t in texts])
            for r in range(len(texts)):
                for w in range(first[r], first[r + 1]):
                    a, z = int(starts[w] - bounds[r]), int(starts[w] + lens[w] - bounds[r])
                    if out[r] and out[r][-1][2] == self.langs[lab[w]]:
                        out[r][-1] = (out[r][-1][0], z, self.langs[lab[w]])
                    else:
                        out[r].append((a, z, self.langs[lab[w]]))
        return out


def _pieces(texts: list, size: int = 2 * SLICE):
    """Row ranges of about ``size`` characters."""
    lo = 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi] or "") <= size):
            n += len(texts[hi] or "")
            hi += 1
        yield lo, hi
        lo = hi


def _count(p: LangParams, langs: list[str]):
    def fn(batches):
        k, slots = len(langs), 1 << p.table_log2
        grams, script = np.zeros(k * slots, np.int64), np.zeros(k * len(SCRIPTS), np.int64)
        for b in batches:
            texts, lang = b.column(0).to_pylist(), b.column(1).to_pylist()
            for t, g in zip(texts, lang):
                j, codes = langs.index(g), _codes([t or ""])
                for lo in range(0, len(codes), SLICE):  # a word cut here is two
                    c, starts, ends = _word_spans(codes[lo:lo + SLICE])
                    lens = ends - starts
                    s = _SCRIPT[np.searchsorted(_STARTS, c[c > 0], "right") - 1]
                    script[j * len(SCRIPTS):(j + 1) * len(SCRIPTS)] += np.bincount(s, minlength=len(SCRIPTS))
                    c, starts = _bordered(c, starts, lens)
                    for n, slot in _ngrams(c, p):
                        np.add.at(grams[j * slots:(j + 1) * slots], slot[_valid(n, lens, starts)[1]], 1)
        for kind, a in ((0, grams), (1, script)):
            nz = np.flatnonzero(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nz), kind, np.int32)), pa.array(nz),
                                              pa.array(a[nz])], names=["kind", "slot", "n"])
    return fn


def train(docs: DataFrame, params: LangParams | None = None, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count n-grams and scripts on the training folds (crc32(id) mod 5 != 0)."""
    p = params or LangParams()
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    d = d.where("text is not null and lang is not null and doc_id is not null").where(fold("doc_id") != 0)
    # a cut-off of the hash leaves a little more than is wanted of a large
    # language (five standard errors and the estimate's), all of a small one
    wanted = p.max_docs_per_lang * 1.2 + 5 * p.max_docs_per_lang ** 0.5 + 20
    counts = d.groupBy("lang").agg((F.lit(wanted) / F.approx_count_distinct("doc_id", 0.03)).alias("share"))
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = (d.select("doc_id", "lang", h.alias("h")).join(counts, "lang").where(F.col("h") < F.col("share") * float(1 << 63))
            .select("doc_id", "lang", "h").distinct().withColumn("r", F.row_number().over(w))
            .where(F.col("r") <= p.max_docs_per_lang).select("doc_id", "lang"))
    ids = ids.checkpoint()
    langs = sorted(r.lang for r in ids.select("lang").distinct().collect())
    sample = d.join(F.broadcast(ids), ["doc_id", "lang"])  # bounded: per language
    sample = sample.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("text", "lang")
    rows = (sample.mapInArrow(_count(p, langs), "kind int, slot bigint, n bigint")
                  .groupBy("kind", "slot").agg(F.sum("n").alias("n")).collect())
    slots, k = 1 << p.table_log2, len(langs)
    grams, script = np.zeros(k * slots), np.zeros(k * len(SCRIPTS))
    for kind, slot, n in rows:
        (script if kind else grams)[slot] = n
    grams, script = grams.reshape(k, slots) + 0.5, script.reshape(k, len(SCRIPTS))
    logp = np.log(grams / grams.sum(axis=1, keepdims=True)).T
    seen = (script >= p.script_share * np.maximum(script.sum(axis=1, keepdims=True), 1)).T
    return Model(p, langs, np.ascontiguousarray(logp), np.ascontiguousarray(seen))


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_spans) per row."""
    m = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _pieces(texts):
                lang, score, spans = m.value.detect(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(lang, pa.string()), pa.array(score),
                                                  pa.array(spans)], names=["doc_id", "lang_pred", "score", "n_spans"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(fn, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, "
                            "score double, n_spans bigint")


def label_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): the language spans of each row's text."""
    m = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def fn(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _pieces(texts):
                s = [[dict(zip(("start", "end", "lang"), x)) for x in y] for y in m.value.spans(texts[lo:hi])]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(s, pa.list_(span))],
                                                 names=["doc_id", "spans"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(fn, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, "
                            "spans array<struct<start:bigint,end:bigint,lang:string>>")


def keep_known(docs: DataFrame, model: Model, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a clear language."""
    m = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def fn(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            for lo, hi in _pieces(texts):
                lang, score, _ = m.value.detect(texts[lo:hi])
                keep = (np.array(lang) != UND) & (score >= min_score)
                yield b.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(fn, docs.schema)
