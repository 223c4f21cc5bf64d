"""Language of words and documents by a linear-chain conditional random field.

A word's score for each language sums weights of its affixes, character n-grams and lexicon entries (hashed to
a fixed table); learned transitions join neighbouring words, and forward-backward gives each word's language given all
others, so a text may switch language. A document gets the language with most word probability, and as score its share.

The field is fitted on the driver from a bounded sample of labelled rows; sequences of the fit join stretches of different
languages, else no switch could be learned. The fit's parameters bound it: ``per_lang`` documents of each of the ``max_langs`` most
frequent languages (rarer ones are not learned), ``per_lang_sequences`` sequences of 48 words for each of them, and the
``lexicon_size`` most frequent words of each as its lexicon. Prediction reads whole texts and words: a run of over 32 letters, as in
scripts without spaces, counts as several words of 32 letters; a long text's chain is cut into blocks whose transfer matrices are joined exactly.

Defined results: null text, or one without a letter: ``und``, score 0. Nothing labelled: all ``und``. Repeated rows are
labelled each; an empty table gives no rows. Ties between languages go to the first by name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import docs_of, keep_rows, sample_by_key, text_blocks

WIDTH, BITS, BLOCK = 32, 16, 32
WORDS_AT_ONCE = 65_536  # about as many words are held at once as Python strings or with probabilities, whatever the block of texts
WORD = re.compile(rf"[^\W\d_]{{1,{WIDTH}}}")  # a longer run is several words
SCHEMA = ("doc_id long, lang_pred string, score double, n_words long, switches long, "
          "runs array<struct<lang:string,start:long,end:long>>")


def words_of(text: str) -> list[str]:
    """Lower-cased words; none if there is no letter among them (other numerals than digits look like words too)."""
    words = WORD.findall(text.lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def _codes(words: list[str]) -> np.ndarray:
    """Code points of ^word$, one row each; a word has WIDTH letters at most."""
    flat = np.array(words, dtype=f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH)
    out = np.zeros((len(words), WIDTH + 2), dtype=np.uint32)
    out[:, 0], out[:, 1:-1] = ord("^"), flat
    out[np.arange(len(words)), 1 + (flat != 0).sum(1)] = ord("$")
    return out


def feature_ids(words: list[str]) -> np.ndarray:
    """Hashed features, 0 where there is none: character 1- to 3-grams in their word, and affixes of 2 to 4 characters."""
    c = _codes(words)
    n = (c != 0).sum(1)
    mul = np.uint32(0x9E3779B1)

    def hashed(cols: list[np.ndarray], salt: int) -> np.ndarray:
        h = np.full(cols[0].shape, salt, dtype=np.uint32)
        ok = np.ones(cols[0].shape, dtype=bool)
        for x in cols:
            h = (h ^ x) * mul
            h ^= h >> np.uint32(15)
            ok &= x != 0
        return np.where(ok, 1 + (h >> np.uint32(32 - BITS)) % np.uint32((1 << BITS) - 1), 0).astype(np.int32)

    w = c.shape[1]
    parts = [hashed([c[:, k:w - size + 1 + k] for k in range(size)], size) for size in (1, 2, 3)]
    rows = np.arange(len(words))
    for size in (3, 4, 5):  # with the mark of the word's start or end
        has = n >= size
        parts.append(np.where(has, hashed([c[:, k] for k in range(size)], 16 + size), 0)[:, None])
        last = np.maximum(n - size, 0)
        parts.append(np.where(has, hashed([c[rows, np.minimum(last + k, w - 1)] for k in range(size)], 32 + size), 0)[:, None])
    return np.concatenate(parts, axis=1)


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # (2 ** BITS, languages); row 0 is zero
    lexicon: dict[str, int]  # word to the language whose lexicon has it
    lexicon_weights: np.ndarray  # (languages + 1, languages); the last row is for words in none
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        k = len(self.langs)
        out = np.empty((len(words), k))
        for at in range(0, len(words), 2048):
            some = words[at:at + 2048]
            lex = np.array([self.lexicon.get(w, k) for w in some], dtype=np.int64)
            out[at:at + 2048] = self.weights[feature_ids(some)].sum(1) + self.lexicon_weights[lex]
        return out


def marginals(e: np.ndarray, doc: np.ndarray, n_docs: int, transitions: np.ndarray) -> np.ndarray:
    """P(language | all words of the document) for each word; e: word scores, doc: ascending document numbers.

    Chains are cut into blocks of BLOCK words. The product of a block's matrices carries messages over it, so the loop
    along a document is over blocks, and the loop over words runs for all blocks at once."""
    k = e.shape[1]
    a = np.exp(transitions - transitions.max())
    b_all = np.exp(np.maximum(e - e.max(1, keepdims=True), -60.0))
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    within = np.arange(len(doc)) - first[doc]
    blocks = -(-count // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    row, col = first_block[doc] + within // BLOCK, within % BLOCK
    n = int(blocks.sum())
    b = np.ones((n, BLOCK, k))
    live = np.zeros((n, BLOCK), dtype=bool)
    b[row, col], live[row, col] = b_all, True
    full = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(BLOCK):
        step = (full @ a) * b[:, t, None, :]
        step /= step.sum((1, 2), keepdims=True)
        full = np.where(live[:, t, None, None], step, full)
    left, right = np.full((n, k), 1.0 / k), np.ones((n, k))
    order = np.argsort(-blocks, kind="stable")
    for j in range(1, int(blocks.max(initial=0))):
        at = first_block[order[:np.searchsorted(-blocks[order], -j, side="left")]] + j
        v = (left[at - 1, None, :] @ full[at - 1])[:, 0]
        left[at] = v / v.sum(1, keepdims=True)
    for j in range(int(blocks.max(initial=0)) - 2, -1, -1):
        at = first_block[order[:np.searchsorted(-blocks[order], -(j + 1), side="left")]] + j
        v = (full[at + 1] @ right[at + 1, :, None])[..., 0]
        right[at] = v / v.sum(1, keepdims=True)
    ahead = np.empty((n, BLOCK, k))
    for t in range(BLOCK):
        v = (left @ a) * b[:, t]
        left = np.where(live[:, t, None], v / v.sum(1, keepdims=True), left)
        ahead[:, t] = left
    for t in range(BLOCK - 1, -1, -1):
        ahead[:, t] *= right
        v = (right * b[:, t]) @ a.T
        right = np.where(live[:, t, None], v / v.sum(1, keepdims=True), right)
    out = ahead[row, col]
    return out / out.sum(1, keepdims=True)


def training_sequences(texts: list[tuple[str, str]], langs: list[str], length: int, seed: int, per_lang: int) -> tuple[list[list[str]], np.ndarray]:
    """Sequences of ``length`` words, ``per_lang`` for each language at most: half of one language, half of stretches (4 to 24 words)
    of several."""
    rng = np.random.default_rng(seed)
    stock = {lang: [w for t, x in texts if x == lang for w in words_of(t)] for lang in langs}
    stock = {lang: ws for lang, ws in stock.items() if len(ws) >= 4}
    names = sorted(stock)
    if not names:
        return [], np.empty((0, length), dtype=np.int64)
    total = sum(map(len, stock.values())) // length + 1
    seqs, labels = [], []
    for s in range(min(total, per_lang * len(names))):
        ws: list[str] = []
        ys: list[int] = []
        lang = names[s % len(names)]
        while len(ws) < length:
            size = length if s % 2 else int(rng.integers(4, 25))
            at = int(rng.integers(0, max(1, len(stock[lang]) - size)))
            got = stock[lang][at:at + size]
            ws += got
            ys += [langs.index(lang)] * len(got)
            if not s % 2:
                lang = names[int(rng.integers(len(names)))]
        seqs.append(ws[:length])
        labels.append(ys[:length])
    return seqs, np.array(labels)


def fit_rows(texts: list[tuple[str, str]], length: int = 48, steps: int = 40, rate: float = 0.3, l2: float = 1e-6, lexicon_size: int = 200,
             per_lang_sequences: int = 1500, seed: int = 7) -> Crf:
    """Maximum likelihood of the labelled sequences by full-batch AdaGrad, with forward-backward for the gradient."""
    langs = sorted({x for _, x in texts})
    k = len(langs)
    counts = {lang: Counter(w for t, x in texts if x == lang for w in words_of(t)) for lang in langs}
    lexicon: dict[str, int] = {}
    for j, lang in enumerate(langs):
        total = max(1, counts[lang].total())
        for w, c in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]:
            share = [counts[o][w] / max(1, counts[o].total()) for o in langs]
            if c >= 3 and c / total >= 0.8 * sum(share):
                lexicon[w] = j
    model = Crf(langs, np.zeros((1 << BITS, k)), lexicon, np.zeros((k + 1, k)), np.zeros((k, k)))
    seqs, y = training_sequences(texts, langs, length, seed, per_lang_sequences)
    if not seqs or k < 2:
        return model
    index: dict[str, int] = {}
    x = np.array([[index.setdefault(w, len(index)) for w in s] for s in seqs])
    words = list(index)
    f = feature_ids(words)
    lex = np.array([lexicon.get(w, k) for w in words])
    n, size = y.shape
    gold = np.zeros((n, size, k))
    np.put_along_axis(gold, y[..., None], 1.0, axis=2)
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
    sums = [np.zeros_like(model.weights), np.zeros_like(model.lexicon_weights), np.zeros_like(model.transitions)]
    cuts = range(0, len(words), 8192)  # words at a time: their gathered weights and gradients are large
    for _ in range(steps):
        e = (np.concatenate([model.weights[f[at:at + 8192]].sum(1) for at in cuts]) + model.lexicon_weights[lex])[x]
        a = np.exp(model.transitions)
        b = np.exp(e - e.max(2, keepdims=True))
        ahead, back = np.empty_like(b), np.ones_like(b)
        v = np.full((n, k), 1.0 / k)
        for t in range(size):
            v = (v @ a) * b[:, t]
            v /= v.sum(1, keepdims=True)
            ahead[:, t] = v
        for t in range(size - 2, -1, -1):
            v = (back[:, t + 1] * b[:, t + 1]) @ a.T
            back[:, t] = v / v.sum(1, keepdims=True)
        p = ahead * back
        p /= p.sum(2, keepdims=True)
        pairs = np.zeros((k, k))
        for t in range(size - 1):
            q = ahead[:, t, :, None] * a * (b[:, t + 1] * back[:, t + 1])[:, None, :]
            pairs += (q / q.sum((1, 2), keepdims=True)).sum(0)
        flat = (gold - p).reshape(-1, k)
        by_word = np.stack([np.bincount(x.ravel(), flat[:, j], len(words)) for j in range(k)], axis=1)
        by_feature = np.zeros_like(model.weights)
        for at in cuts:
            some = f[at:at + 8192].ravel()
            for j in range(k):
                by_feature[:, j] += np.bincount(some, np.repeat(by_word[at:at + 8192, j], f.shape[1]), 1 << BITS)
        grads = [
            by_feature / n - l2 * model.weights,
            np.stack([np.bincount(lex, by_word[:, j], k + 1) for j in range(k)], axis=1) / n - l2 * model.lexicon_weights,
            (gold_pairs - pairs) / n - 1e-3 * model.transitions,
        ]
        grads[0][0] = 0
        for total, g, target in zip(sums, grads, (model.weights, model.lexicon_weights, model.transitions), strict=True):
            total += g * g
            target += rate * g / np.sqrt(total + 1e-12)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 250, max_langs: int = 200, **options) -> Crf:
    """Fit on about ``per_lang`` documents of each of the ``max_langs`` most frequent languages of the labelled rows (rows without text or
    label are left out). ``options`` go to ``fit_rows``, ``per_lang_sequences`` and ``lexicon_size`` among them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    got = sample_by_key(rows, "lang", per_lang, max_langs).select("text", "lang").collect()
    return fit_rows(sorted((r.text, r.lang) for r in got), **options)


@dataclass
class Labels:
    """What the field says of a block of texts."""

    pred: list[str]
    score: np.ndarray
    n_words: np.ndarray
    switches: np.ndarray
    top: list[np.ndarray]  # each word's language


def label_texts(texts: list[str | None], m: Crf) -> Labels:
    k, n = len(m.langs), len(texts)
    parts, flat, count = [], [], np.zeros(n, dtype=np.int64)
    for i, t in enumerate(texts):
        words = words_of(t) if t else []
        flat += words
        count[i] = len(words)
        if len(flat) >= WORDS_AT_ONCE:  # few are Python strings at a time
            parts.append(pa.array(flat, pa.string()))
            flat = []
    if not (count.sum() and k):
        return Labels(["und"] * n, np.zeros(n), count, np.zeros(n, dtype=np.int64), [np.empty(0, np.int64)] * n)
    flat = pa.concat_arrays([*parts, pa.array(flat, pa.string())]).dictionary_encode()
    known, word = m.emissions(flat.dictionary.to_pylist()), flat.indices.to_numpy()
    doc = np.repeat(np.arange(n), count)
    upto = np.concatenate([[0], np.cumsum(count)])
    by, top = np.empty((n, k)), np.empty(len(doc), dtype=np.int64)
    lo = 0
    while lo < n:  # documents of about WORDS_AT_ONCE words together
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + WORDS_AT_ONCE, "right")) - 1)
        some, own = slice(upto[lo], upto[hi]), doc[upto[lo]:upto[hi]] - lo
        p = marginals(known[word[some]], own, hi - lo, m.transitions)
        by[lo:hi] = np.stack([np.bincount(own, p[:, j], hi - lo) for j in range(k)], axis=1)
        top[some] = p.argmax(1)
        lo = hi
    best = by.argmax(1)
    turn = np.concatenate([[0], (top[1:] != top[:-1]) & (doc[1:] == doc[:-1])])
    return Labels([m.langs[b] if c else "und" for b, c in zip(best, count, strict=True)], np.where(count > 0, np.minimum(by[np.arange(n), best] / np.maximum(count, 1), 1.0), 0.0),
                  count, np.bincount(doc, turn, n).astype(np.int64), np.split(top, np.cumsum(count)[:-1]))


def label(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """Per document: language, its share of word probability, words, language switches and, on request, the runs of
    words of one language (character offsets in the lower-cased text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: a hashed table and bounded lexicons

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for ids, texts in text_blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = label_texts(texts, m)
                runs = [_runs(t, top, m.langs) if len(top) else [] for t, top in zip(texts, got.top, strict=True)] if spans else [None] * len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(got.pred, pa.string()), pa.array(got.score), pa.array(got.n_words), pa.array(got.switches),
                     pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "lang_pred", "score", "n_words", "switches", "runs"])

    return docs_of(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: Crf, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The documents, all their columns, that have a language with a share of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def accepted(texts: list[str | None]) -> list[bool]:
        got = label_texts(texts, shared.value)
        return [p != "und" and s >= least for p, s in zip(got.pred, got.score, strict=True)]

    return keep_rows(docs, text_col, accepted)


def _runs(text: str | None, top: np.ndarray, langs: list[str]) -> list[dict]:
    out: list[dict] = []
    for m, j in zip(WORD.finditer((text or "").lower()), top, strict=True):  # only for texts with a letter
        if out and out[-1]["lang"] == langs[j]:
            out[-1]["end"] = m.end()
        else:
            out.append({"lang": langs[j], "start": m.start(), "end": m.end()})
    return out
