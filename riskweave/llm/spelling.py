"""Spelling variants of a corpus's words by pivotal bigrams.

1. Words: maximal runs of letters of whole texts, ``A-Z`` lower-cased, one in ``drop_mod`` of a document's distinct runs
   without one of its letters (a planted misspelling). Each task counts a block of texts before anything moves.
2. Bigrams are ordered by the number of words that have them, rare ones first; the alphabet bounds their number (90 letters:
   8,100), so their counts are broadcast. A word's prefix is its three rarest bigrams, of which two do not overlap; dynamic
   programming chooses the two of least total count as its pivots. One edit can touch but one of them.
3. Pivots are looked up among the other words' prefixes. Of two near words the one whose third bigram comes first has a pivot
   that the edit leaves alone and that is a prefix bigram of the other: below the other's third bigram, and among its first
   five (the edit adds two bigrams at most). Position limits: what lies before or after that pivot is the same in
   both words too, so the pivot meets at the same distance from the start or the end, on a hash of that side.
4. What meets is verified on the words. Meeting places of over ``chunk`` rows are split first: of the side with the edit
   one half is the same as well, so it joins the key.
5. Each word's form is its most frequent near word, and its root is found by pointer jumping over the forms.

A word occurs at most 7 times in the index whatever its length and the pairs of a place are never emitted, only near ones:
a word of m letters has under 200 m of them.

Defined results: null text has no runs; a null id counts as ''; repeated rows count as often as they occur; an empty
table gives no rows; a word without near words is its own root.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import docs_of, drop_shared, text_blocks, write_shared
from riskweave.llm.grouped import mix, whole_groups

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
HELD = 400_000  # words that a task counts before it hands them on
P = np.uint64(0xD6E8FEB86659FD93)
P_BACK = np.uint64(pow(int(P), -1, 1 << 64))  # modulo 2**64
PREFIX, RANKS = 3, 5  # bigrams of a prefix; ranks at which another word's pivot can be found


def count_words(docs: DataFrame, id_col: str, text_col: str, drop_mod: int, min_length: int) -> DataFrame:
    """(word, n) of every task's blocks of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for ids, texts in text_blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for doc, text in zip(ids, texts, strict=True):
                    own: dict[str, int] = {}
                    for x in RUN.findall(text) if text else ():
                        own[x] = own.get(x, 0) + 1
                    runs: dict[str, int] = {}
                    for x, n in own.items():
                        x = x.lower() if x.isascii() else x.translate(UPPER)
                        runs[x] = runs.get(x, 0) + n
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for x, n in runs.items():
                        h = zlib.crc32(x.encode(), start)
                        if not h % drop_mod:
                            h %= len(x)
                            x = x[:h] + x[h + 1:]
                        if len(x) >= min_length:
                            held[x] = held.get(x, 0) + n
                    if len(held) >= HELD:
                        yield handed()
        if held:
            yield handed()

    return docs_of(docs, id_col, text_col).mapInArrow(run, "word string, n long")


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after another, and where each word's start."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.concatenate([[0], np.cumsum(size)])


def bigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, word and position of every bigram of the words, in order."""
    flat, at = letters_of(words)
    n = np.maximum(np.diff(at) - 1, 0)
    of = np.repeat(np.arange(len(words)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i = at[of] + pos
    return (flat[i].astype(np.int64) << 32) | flat[i + 1], of, pos


def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, words) of each batch of words: how many have the bigram."""
    for batch in batches:
        gram, of, _ = bigrams(batch.column(0).to_pylist())
        if len(gram):
            code, slot = np.unique(gram, return_inverse=True)
            once = np.unique(of * len(code) + slot)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.bincount(once % len(code), minlength=len(code)))], names=["gram", "words"])


class Sides:
    """Hashes of the start and the end of every word, up to any place."""

    def __init__(self, words: list[str]):
        self.flat, self.at = letters_of(words)
        total = len(self.flat)
        one = np.ones(1, dtype=np.uint64)
        power = np.concatenate([one, np.cumprod(np.full(total, P))])
        self.back = np.concatenate([one, np.cumprod(np.full(total, P_BACK))])
        self.sums = np.concatenate([one * np.uint64(0), np.cumsum(mix(self.flat.astype(np.uint64) + np.uint64(1)) * power[:total])])

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the letters lo:hi (places among all letters): the same for the same letters anywhere."""
        return mix((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64))


def pivots(pos: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which two of a word's prefix bigrams, (words, PREFIX) in order of position, do not overlap and cost least together.

    least[j] is the least cost of one bigram that ends before bigram j starts, and from[j] that bigram."""
    words, k = pos.shape
    best, pick = np.full(words, np.inf), np.zeros((words, 2), dtype=np.int64)
    rows = np.arange(words)
    least, came = np.full((words, k), np.inf), np.zeros((words, k), dtype=np.int64)
    for j in range(k):
        for i in range(j):
            better = (pos[:, i] + 2 <= pos[:, j]) & (cost[:, i] < least[:, j])
            least[better, j], came[better, j] = cost[better, i], i
        total = least[:, j] + cost[:, j]
        better = total < best
        best[better] = total[better]
        pick[better] = np.stack([came[:, j], np.full(words, j)], axis=1)[better]
    out = np.zeros((words, k), dtype=bool)
    out[rows, pick[:, 0]] = out[rows, pick[:, 1]] = True
    return out


def index_rows(order: dict[int, tuple[int, int]], halves: bool):
    """Words to rows of the index: key, word, n, last (rank of the third bigram), rank (of this one), pivot.

    order: the rank and the number of words of each bigram code. Each row stands for one side of a pivot or prefix bigram that is
    the same in both words; its place is the key. halves: and for the half of the other side that is the same too."""
    codes = np.array(sorted(order), dtype=np.int64)
    ranks = np.array([order[c][0] for c in codes.tolist()], dtype=np.int64)
    costs = np.array([order[c][1] for c in codes.tolist()], dtype=np.float64)

    def places(words: list[str]):
        gram, of, pos = bigrams(words)
        slot = np.searchsorted(codes, gram)
        by = np.lexsort((pos, ranks[slot], of))
        first = np.searchsorted(of[by], np.arange(len(words)))
        turn = np.arange(len(by)) - first[of[by]]
        by, turn = by[turn < RANKS], turn[turn < RANKS]
        of, pos, slot = of[by], pos[by], slot[by]
        last = ranks[slot[turn == PREFIX - 1]]  # of each word
        # the prefix in order of position, for the pivots
        own = np.flatnonzero(turn < PREFIX)
        own = own[np.lexsort((pos[own], of[own]))]
        pivot = np.zeros(len(by), dtype=bool)
        pivot[own] = pivots(pos[own].reshape(-1, PREFIX), costs[slot[own]].reshape(-1, PREFIX)).ravel()
        keep = ranks[slot] <= last[of]
        return of[keep], pos[keep], codes[slot[keep]], ranks[slot[keep]], last[of[keep]], pivot[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(0), batch.column(1)
            if not len(words):
                continue
            texts = words.to_pylist()
            sides = Sides(texts)
            of, pos, gram, rank, last, pivot = places(texts)
            lo, hi, at = sides.at[of], sides.at[of + 1], sides.at[of] + pos
            for end in (False, True):
                same = sides.hash(at, hi) if end else sides.hash(lo, at + 2)  # the bigram and what is beyond it
                place = mix(same ^ mix(gram.view(np.uint64) ^ np.uint64(end + 1)) ^ (hi - at if end else pos).astype(np.uint64))
                a, b = (lo, at) if end else (at + 2, hi)  # the side with the edit
                for shorter in ((0, 1) if halves else (0,)):
                    for late in ((False, True) if halves else (False,)):
                        pick = np.flatnonzero(b - a >= shorter) if halves else np.arange(len(of))
                        key = place[pick]
                        if halves:  # m: letters that the shorter word has there; one half of those is the same
                            m = (b - a)[pick] - shorter
                            cut = m // 2
                            half = sides.hash(b[pick] - (m - cut), b[pick]) if late else sides.hash(a[pick], a[pick] + cut)
                            key = mix(key ^ mix(half + np.uint64(late + 1)) ^ m.astype(np.uint64) * P)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key.view(np.int64)), words.take(pa.array(of[pick])), n.take(pa.array(of[pick])), pa.array(last[pick]), pa.array(rank[pick]), pa.array(pivot[pick])],
                            names=["key", "word", "n", "last", "rank", "pivot"])

    return run


def near(flat: np.ndarray, at: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs of words differ by exactly one inserted, deleted or replaced letter."""
    size = np.diff(at)
    ok = (np.abs(size[p] - size[q]) <= 1) & (p != q)
    out = np.zeros(len(p), dtype=bool)
    some = np.flatnonzero(ok)
    for lo in range(0, len(some), 1 << 17):
        pick = some[lo:lo + (1 << 17)]
        a, b = at[p[pick]], at[q[pick]]
        shorter = np.minimum(size[p[pick]], size[q[pick]])
        longer = np.maximum(size[p[pick]], size[q[pick]])
        agree = []
        for step, a0, b0 in ((1, a, b), (-1, at[p[pick] + 1] - 1, at[q[pick] + 1] - 1)):
            run, left = np.zeros(len(pick), dtype=np.int64), np.arange(len(pick))
            while left.size:
                left = left[run[left] < shorter[left]]
                left = left[flat[a0[left] + step * run[left]] == flat[b0[left] + step * run[left]]]
                run[left] += 1
            agree.append(run)
        equal = (shorter == longer) & (agree[0] == shorter)
        out[pick] = ~equal & (agree[0] + agree[1] >= longer - 1)
    return out


def verified(chunk: int):
    """Sorted (key, word, n, last, rank, pivot) rows to near pairs (word, other, other_n), each in both directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, "key"):
            last, rank, pivot = (table.column(c).to_numpy() for c in ("last", "rank", "pivot"))
            starts = np.append(starts, len(last))
            size = np.diff(starts)
            lead = np.flatnonzero(pivot & (np.repeat(size, size) > 1))  # each pivot row with all rows of its place
            if not lead.size:
                continue
            flat, at = letters_of(table.column("word").to_pylist())
            group = np.repeat(np.arange(len(size)), size)[lead]
            upto = np.cumsum(size[group])
            a, b = [], []
            for lo in range(0, int(upto[-1]), 1 << 20):  # a million meetings at a time
                i, j = np.searchsorted(upto, lo, "right"), np.searchsorted(upto, min(lo + (1 << 20), int(upto[-1])) - 1, "right")
                mine = np.arange(i, j + 1)
                n = size[group[mine]]
                p = np.repeat(lead[mine], n)
                q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[group[mine]], n)
                met = np.arange(upto[i] - size[group[i]], upto[j])
                pick = (met >= lo) & (met < lo + (1 << 20)) & (last[p] <= last[q])
                p, q = p[pick], q[pick]
                ok = near(flat, at, p, q)
                a.append(p[ok])
                b.append(q[ok])
            a, b = np.concatenate(a), np.concatenate(b)
            if a.size:
                word, count = table.column("word"), table.column("n")
                x, y = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
                pairs = pa.table({"word": word.take(x), "other": word.take(y), "other_n": count.take(y)}).combine_chunks()
                yield from pairs.group_by(["word", "other", "other_n"]).aggregate([]).select(["word", "other", "other_n"]).to_batches(max_chunksize=1 << 16)

    return run


def near_words(words: DataFrame, chunk: int = 2048) -> DataFrame:
    """(word, other, other_n) of all near words, both directions, of a table (word, n) of distinct words, three letters at least."""
    counted = words.mapInArrow(count_bigrams, "gram long, words long").groupBy("gram").agg(F.sum("words").alias("words"))
    grams = counted.collect()  # bounded by the alphabet
    order = {r.gram: (k, r.words) for k, r in enumerate(sorted(grams, key=lambda r: (r.words, r.gram)))}
    schema = "key long, word string, n long, last long, rank long, pivot boolean"
    rows, path = write_shared(words.mapInArrow(index_rows(order, False), schema), "places")
    crowded, crowded_path = write_shared(rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > chunk).select("key"), "crowded")
    met = lambda some: some.repartition("key").sortWithinPartitions("key").mapInArrow(verified(chunk), "word string, other string, other_n long")
    found = met(rows.join(crowded, "key", "left_anti"))
    if crowded.take(1):
        again = rows.join(crowded, "key", "left_semi").select("word", "n").distinct().mapInArrow(index_rows(order, True), schema)
        found = found.unionAll(met(again))
    out, _ = write_shared(found.distinct(), "near")
    drop_shared(words.sparkSession, path)
    drop_shared(words.sparkSession, crowded_path)
    return out


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer jumping over (word, form) where form is never null. Forms only lead to more frequent words, at
    least twice as frequent, so a chain has at most 62 links and is found in six rounds."""
    spark = forms.sparkSession
    now, path = write_shared(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new, new_path = write_shared(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_shared(spark, path)
        now, path = new.select("word", "root"), new_path
        if not new.where("moved").take(1):
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_mod: int = 97, min_length: int = 5, min_count: int = 3,
             ratio: int = 2, chunk: int = 2048) -> DataFrame:
    """One row per word of at least ``min_length`` letters and ``min_count`` occurrences: word, form (the near word of largest n, the
    first in code-point order of several, if that n is at least ``ratio`` times the word's), root, n, n_near, form_n."""
    if min_length < PREFIX + 1:
        raise ValueError("words need four letters for three bigrams")
    counted = count_words(docs, id_col, text_col, drop_mod, min_length).groupBy("word").agg(F.sum("n").alias("n"))
    words, _ = write_shared(counted.where(F.col("n") >= min_count), "words")
    pairs = near_words(words, chunk)
    top = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("top"))
    strong = -F.col("top.less") >= ratio * F.col("n")
    own, _ = write_shared(words.join(top, "word", "left").select(
        "word", F.when(strong, F.col("top.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, -F.col("top.less")).alias("form_n")), "forms")
    roots = roots_of(own.where("form is not null").select("word", "form"))
    return own.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
