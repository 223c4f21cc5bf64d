"""Toxicity of documents: sparse logistic regression whose scores do not depend on which group a text names.

Features are a text's words, word pairs and word starts (4 to 7 letters, so that unseen inflections count), and those
words and starts that make up at least 1 in 200 of its words. The fit minimises the log loss of labelled texts, an elastic
net, and a counterfactual term: each labelled text that names an identity group is repeated with the terms swapped for
others of the same kind, and the squared change of its score is penalised. A neutral mention then carries no weight.

The fit runs on the driver over a bounded sample weighted back to the table's class shares. Its parameters: ``per_class`` texts of
either label (each id and text once, drawn by a hash of both, so neither a repeated row nor an id of many rows adds to it),
``min_docs`` and ``max_features``: a feature is learned if so many sampled texts have it, the most frequent so many at most. Scoring reads whole texts, and needs only the weights that are not zero.

Defined results: null or empty text: the score of the intercept alone. A document with several labels is toxic if one
says so; null labels are left out. Without labels of both kinds every score is the share of toxic labels (0 without
any). Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import docs_of, text_blocks

TOKEN = re.compile(r"[^\W_]+")
STARTS, DENSE = range(4, 8), 200

#: Identity terms by kind; terms of one line replace each other. Give your own list for other languages or groups.
IDENTITY_TERMS: list[list[str]] = [
    ["muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "protestant", "sikh", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "catholics", "protestants", "sikhs", "atheists"],
    ["islam", "christianity", "judaism", "hinduism", "buddhism", "catholicism"],
    ["gay", "lesbian", "bisexual", "transgender", "queer", "heterosexual", "straight", "homosexual"],
    ["black", "white", "asian", "latino", "hispanic", "arab", "african", "european", "indigenous"],
    ["woman", "man"], ["women", "men"], ["girl", "boy"], ["girls", "boys"], ["female", "male"],
    ["blind", "deaf", "disabled", "autistic", "paralyzed"],
    ["immigrant", "refugee", "citizen", "foreigner"], ["immigrants", "refugees", "citizens", "foreigners"],
    ["mexican", "american", "chinese", "german", "french", "spanish", "turkish", "russian", "nigerian", "indian"],
    ["old", "young", "elderly"],
    ["femme", "homme"], ["femmes", "hommes"], ["musulman", "chrétien", "juif"], ["musulmans", "chrétiens", "juifs"],
    ["frau", "mann"], ["frauen", "männer"], ["muslime", "christen", "juden"], ["schwarze", "weiße"],
    ["mujer", "hombre"], ["mujeres", "hombres"], ["musulmán", "cristiano", "judío"], ["musulmanes", "cristianos", "judíos"],
]


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def starts(word: str) -> list[str]:
    return [word[:k] + "*" for k in STARTS if len(word) > k]


def features(words: list[str]) -> set:
    """Words and starts as text ('!' before a dense one), pairs as tuples."""
    count = Counter(words)
    for w, c in list(count.items()):
        for x in starts(w):
            count[x] += c
    return {*count, *("!" + x for x, c in count.items() if c * DENSE >= len(words)), *zip(words, words[1:], strict=False)}


def swap(words: list[str], terms: dict[str, list[str]], shift: int) -> list[str] | None:
    """The words with every identity term replaced by another of its kind; None if there is no term."""
    if not any(w in terms for w in words):
        return None
    return [(line := terms[w])[(line.index(w) + 1 + shift % max(1, len(line) - 1)) % len(line)] if w in terms else w for w in words]


@dataclass
class Weights:
    bias: float
    words: dict[str, float]  # of words, starts ('abcd*') and their dense forms ('!...')
    pairs: dict[tuple[str, str], float]

    def __post_init__(self):
        self.heads = {x.lstrip("!")[:STARTS[0]] for x in self.words if x.endswith("*")}

    def raw(self, words: list[str]) -> tuple[float, list[str]]:
        """The log-odds of being toxic, and the words and starts with a positive weight that were found."""
        count = Counter(words)
        for w, c in [(w, c) for w, c in count.items() if w[:STARTS[0]] in self.heads]:
            for x in starts(w):
                count[x] += c
        total, found = self.bias, []
        for x in count.keys() & self.words.keys():
            total += self.words[x]
            if self.words[x] > 0:
                found.append(x)
        for x in self.dense:
            if count[x] * DENSE >= len(words) and count[x]:
                total += self.words["!" + x]
        if self.pairs:
            total += sum(self.pairs[p] for p in self.pairs.keys() & set(zip(words, words[1:], strict=False)))
        return total, found

    @property
    def dense(self) -> list[str]:
        if "_dense" not in self.__dict__:
            self._dense = [x[1:] for x in self.words if x[0] == "!"]
        return self._dense

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(tokens(text or ""))[0], -30, 30))))


def fit_rows(rows: list[tuple[str, int, float]], terms: list[list[str]] | None = None, swaps: int = 3, counterfactual: float = 1.0,
             l1: tuple[float, ...] = (1e-3, 4e-4, 1e-4), l2: float = 1e-4, min_docs: int = 4, max_features: int = 20_000,
             steps: int = 200) -> Weights:
    """rows: (text, label, weight). Accelerated proximal gradient; ``counterfactual`` scales the penalty on score changes.

    Of several strengths ``l1`` the one with the least log loss on a fifth of the rows, left out of those fits, is taken."""
    line_of = {w: line for line in (IDENTITY_TERMS if terms is None else terms) if len(line) > 1 for w in line}
    y, weight = np.array([float(v) for _, v, _ in rows]), np.array([w for _, _, w in rows])
    if not len(y) or y.min() == y.max():
        p = float(np.clip((y @ weight) / weight.sum(), 1e-6, 1 - 1e-6)) if len(y) else 0.0
        return Weights(float(np.log(p / (1 - p))) if p else -30.0, {}, {})
    weight = weight / weight.sum()
    n = len(rows)

    def texts() -> Iterator[tuple[int, list[str]]]:
        """(row, words) of the labelled texts, then of their swapped forms; made anew for each reading, to hold few at a time."""
        for i, (t, _, _) in enumerate(rows):
            yield i, tokens(t or "")
        for i, (t, _, _) in enumerate(rows):
            words = tokens(t or "")
            for s in range(swaps if any(w in line_of for w in words) else 0):
                yield i, swap(words, line_of, s)

    # Most features are in one text only: a table of hashed counts keeps them from ever being held.
    hashed = np.zeros(1 << 22, dtype=np.int32)
    slot = lambda words: [(f, hash(f) & (len(hashed) - 1)) for f in features(words)]
    origin: list[int] = []
    for i, words in texts():
        origin.append(i)
        hashed[np.unique([h for _, h in slot(words)]).astype(np.int64)] += 1
    seen: dict = {}
    got = [np.array([seen.setdefault(f, len(seen)) for f, h in slot(words) if hashed[h] >= min_docs], dtype=np.int32) for _, words in texts()]
    m, origin = len(origin), np.array(origin[n:], dtype=np.int64)
    count = np.bincount(np.concatenate(got), minlength=len(seen))
    toxic = np.bincount(np.concatenate([np.empty(0, np.int32), *(g for g, v in zip(got, y, strict=False) if v)]), minlength=len(seen))
    # The features whose document counts are least like chance; the rest could only add noise.
    unlike = np.where(count >= min_docs, np.abs(toxic - count * y.mean()) / np.sqrt(np.maximum(count, 1)), -1.0)
    names = list(seen)
    kept = sorted((k for k in np.flatnonzero(unlike >= 0)), key=lambda k: (-unlike[k], repr(names[k])))[:max_features]
    index = {names[k]: j for j, k in enumerate(sorted(kept, key=lambda k: repr(names[k])))}
    place = np.full(len(seen), -1)
    for f, j in index.items():
        place[seen[f]] = j
    got = [place[g] for g in got]
    got = [np.sort(g[g >= 0]) for g in got]
    row = np.repeat(np.arange(m), [len(g) for g in got])
    col = np.concatenate(got) if got else np.empty(0, np.int64)
    d = len(index)
    del seen, names, hashed, got

    def forward(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, v[:-1][col], m) + v[-1]

    def solve(strength: float, used: np.ndarray, n_steps: int) -> np.ndarray:
        """Weights and intercept from the rows with a weight in ``used``."""
        used = used / used.sum()
        pair_weight = counterfactual * used[origin] / swaps if len(origin) else np.zeros(0)

        def pull(outer: np.ndarray, z: np.ndarray) -> np.ndarray:
            """Gradient for each text: the loss's for the labelled ones, and both ends of each swap."""
            g = np.zeros(m)
            g[:n] = outer
            if len(origin):
                change = 2 * pair_weight * (z[n:] - z[origin])
                g[n:] += change
                g[:n] -= np.bincount(origin, change, n)
            return g

        def grad(v: np.ndarray) -> np.ndarray:
            z = forward(v)
            g = pull(used * (1 / (1 + np.exp(-np.clip(z[:n], -30, 30))) - y), z)
            return np.concatenate([np.bincount(col, g[row], d) + l2 * v[:-1], [g.sum()]])

        size, top = np.ones(d + 1), 1.0  # the largest curvature, by power iteration
        for _ in range(12):
            z = forward(size)
            h = pull(used * z[:n] / 4, z)
            size = np.concatenate([np.bincount(col, h[row], d), [h.sum()]])
            top = float(np.linalg.norm(size))
            size /= max(top, 1e-12)
        rate = 1 / (1.05 * top + l2 + 1e-9)
        v = np.zeros(d + 1)
        share = float(np.clip(used @ y, 1e-6, 1 - 1e-6))
        v[-1] = np.log(share / (1 - share))
        ahead, t = v.copy(), 1.0
        for _ in range(n_steps):
            new = ahead - rate * grad(ahead)
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * strength, 0)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            if (ahead - new) @ (new - v) > 0:
                t2, ahead = 1.0, new.copy()
            else:
                ahead = new + (t - 1) / t2 * (new - v)
            v, t = new, t2
        return v

    held = np.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) % 5 == 0 for t, _, _ in rows])
    if len(l1) > 1 and held.any() and not held.all() and len(set(y[~held])) == 2:
        def loss(strength: float) -> float:
            z = np.clip(forward(solve(strength, np.where(held, 0.0, weight), steps // 2))[:n][held], -30, 30)
            return float((weight[held] * (np.log1p(np.exp(z)) - y[held] * z)).sum())

        best = min(l1, key=loss)
    else:
        best = l1[0]
    v = solve(best, weight, steps)
    kept = {f: float(v[k]) for f, k in index.items() if v[k]}
    return Weights(float(v[-1]), {f: x for f, x in kept.items() if isinstance(f, str)}, {f: x for f, x in kept.items() if not isinstance(f, str)})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1500, **options) -> Weights:
    """Fit on about ``per_class`` labelled texts of either label, weighted to the shares of all labelled texts.

    ``options`` go to ``fit_rows``, ``min_docs`` and ``max_features`` among them."""
    truth = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    truth = truth.groupBy("doc_id").agg(F.max((F.col("y") > 0).cast("int")).alias("y"))
    keyed = docs_of(docs, id_col, text_col).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    # ids and hashes only: each labelled (id, text) once, however many rows have it
    known = keyed.select("doc_id", "th").join(truth, "doc_id").distinct().persist()
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, per_class / n))).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(1 << 30)) / float(1 << 30) < share)
    # The sample is small by construction, so it is broadcast to the texts; equal rows are combined where they are read.
    got = keyed.join(F.broadcast(sample), ["doc_id", "th"]).groupBy("doc_id", "th").agg(F.first("text").alias("text"), F.first("y").alias("y")).collect()
    known.unpersist()
    taken = Counter(r.y for r in got)
    return fit_rows(sorted((r.text or "", r.y, counts[r.y] / taken[r.y]) for r in got), **options)


def score(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: score, the number of toxic-leaning features found and the strongest of them."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # bounded by the sample that it was fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for ids, texts in text_blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw, evidence, found = [], [], []
                for t in texts:
                    ws = tokens(t) if t else []
                    value, hits = w.raw(ws)
                    raw.append(value)
                    hits.sort(key=lambda x: (-w.words[x], x))
                    found.append(len(hits))
                    evidence.append(hits[0] if hits else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(np.array(raw), -30, 30)))), pa.array(found, pa.int64()), pa.array(evidence, pa.string())],
                    names=["doc_id", "score", "n_evidence", "evidence"])

    return docs_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, n_evidence long, evidence string")
