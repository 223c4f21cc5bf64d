"""Benchmark items inside documents: containment search by MinHash over windows, partitioned by size, then exact.

An item is short and a document long, so their Jaccard similarity says little. Items are therefore put into classes by
their number of shingles (each class reaches sqrt(2) times as far as the one before), and a document is read, for each
class, in overlapping windows of twice the class's size: an item that a document holds lies whole in one of them, and
makes up over a third of it. Windows and items of a class meet when one of ``functions`` minimum hashes agrees;
the share of the item's distinct shingles that the whole document has is then counted exactly.

The chance that a match is missed is under ``(1 - 0.26) ** functions`` at a containment of 0.8, and less above.

Documents stay where they are: no shuffle. Items are the query set; they are broadcast in blocks of at most
``block_words`` words, and each further block is one more pass over the documents.

Shingles are of ``width`` lower-cased words; an item of fewer words is one shingle of all its words, looked for at that
width. Defined results: null or empty texts and items without a word match nothing; repeated rows of either side match
each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import docs_of, keep_rows, text_blocks
from riskweave.llm.shingles import word_hashes, word_shingles

SCHEMA = "doc_id long, item_id long, containment double, shared long, item_shingles long, first_shingle long"
BASE = 4  # shingles of the smallest block of minima; every window is made of such blocks


class Items:
    """A block of items, arranged by shingle width and size class for lookups of minimum hashes."""

    def __init__(self, ids: list[int | None], texts: list[str | None], width: int, functions: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(1, 1 << 31, functions, dtype=np.uint32) * np.uint32(2) + np.uint32(1))
        self.b = rng.integers(0, 1 << 32, functions, dtype=np.uint32)
        flat, count = word_hashes(texts)
        self.ids, self.sets = ids, [np.empty(0, np.uint64)] * len(ids)
        groups: dict[tuple[int, int], list[int]] = defaultdict(list)
        for w in sorted({min(width, int(c)) for c in count if c}):
            h, n = word_shingles(flat, count, w)
            at = np.concatenate([[0], np.cumsum(n)])
            for i in np.flatnonzero((count >= 1) & (np.minimum(count, width) == w)):
                self.sets[i] = np.unique(h[at[i]:at[i + 1]])
                step = max(0, math.ceil(2 * math.log2(max(1, n[i]) / BASE)))
                groups[w, BASE * math.ceil(2 ** (step / 2))].append(int(i))
        #: By width: (size of a class's half window, for each function: sorted minima, their items, a table of marks).
        self.classes: dict[int, list[tuple[int, list]]] = defaultdict(list)
        for (w, size), members in sorted(groups.items()):
            minima = np.stack([(self.sets[i].astype(np.uint32) * self.a[:, None] + self.b[:, None]).min(1) for i in members], axis=1)
            bits = max(12, math.ceil(math.log2(32 * len(members))))
            tables = []
            for row in minima:
                order = np.argsort(row, kind="stable")
                marks = np.zeros(1 << bits, dtype=bool)
                marks[row & np.uint32((1 << bits) - 1)] = True
                tables.append((row[order], np.array(members)[order], marks))
            self.classes[w].append((size, tables))

    def search(self, flat: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(document, item, the document's shingles in order, and distinct) of all that agree in a minimum hash."""
        for w, classes in self.classes.items():
            h, n = word_shingles(flat, count, w)
            if not len(h):
                continue
            start = np.concatenate([[0], np.cumsum(n)])
            low = h.astype(np.uint32)
            # Blocks of BASE shingles, none over two documents.
            blocks = -(-n // BASE)
            first = np.concatenate([[0], np.cumsum(blocks)])
            doc_of = np.repeat(np.arange(len(n)), blocks)
            cuts = start[doc_of] + (np.arange(len(doc_of)) - first[doc_of]) * BASE
            windows = []
            for size, tables in classes:
                per = size // BASE
                halves = -(-blocks // per)
                at = np.concatenate([[0], np.cumsum(halves)])
                doc = np.repeat(np.arange(len(n)), halves)
                begins = first[doc] + (np.arange(len(doc)) - at[doc]) * per
                last = np.concatenate([doc[1:] != doc[:-1], [True]])
                windows.append((begins, last, doc, tables))
            pairs: set[tuple[int, int]] = set()
            for j in range(len(self.a)):
                base = np.minimum.reduceat(low * self.a[j] + self.b[j], cuts)
                for begins, last, doc, tables in windows:
                    half = np.minimum.reduceat(base, begins)
                    # The window that starts at a document's last half is that half; it lies in the one before unless it is the only one.
                    whole = np.where(last, half, np.minimum(half, np.concatenate([half[1:], half[-1:]])))
                    values, members, marks = tables[j]
                    hit = np.flatnonzero(marks[whole & np.uint32(len(marks) - 1)])
                    if hit.size:
                        lo, hi = np.searchsorted(values, whole[hit], "left"), np.searchsorted(values, whole[hit], "right")
                        for k in np.flatnonzero(hi > lo):
                            d = int(doc[hit[k]])
                            pairs.update((d, int(m)) for m in members[lo[k]:hi[k]])
            of = -1
            for d, i in sorted(pairs):
                if d != of:
                    of, own = d, np.unique(h[start[d]:start[d + 1]])
                yield d, i, h[start[d]:start[d + 1]], own


def item_blocks(items: DataFrame, item_col: str, item_text_col: str, width: int, functions: int, block_words: int) -> Iterator[Broadcast]:
    """The items as broadcasts of about ``block_words`` words each."""
    queries = docs_of(items, item_col, item_text_col)
    words = queries.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n_blocks = max(1, math.ceil(words / block_words))
    for k in range(n_blocks):
        rows = queries.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)) == k).collect()
        yield items.sparkSession.sparkContext.broadcast(Items([r.doc_id for r in rows], [r.text for r in rows], width, functions))


def contained(texts: list[str | None], block: Items, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, shared shingles, place of the first) of the items that the texts contain."""
    for d, i, h, own in block.search(*word_hashes(texts)):
        wanted = block.sets[i]
        n = int((own[np.minimum(np.searchsorted(own, wanted), len(own) - 1)] == wanted).sum())
        if n >= threshold * len(wanted) - 1e-9:
            yield d, i, n, int(np.isin(h, wanted).argmax())


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           width: int = 5, threshold: float = 0.8, functions: int = 32, block_words: int = 4_000_000) -> DataFrame:
    """One row per document and item of which the document has at least ``threshold`` of the distinct shingles."""
    texts = docs_of(docs, id_col, text_col)
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    parts = []
    for shared in item_blocks(items, item_col, item_text_col, width, functions, block_words):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for ids, some in text_blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    out = [(ids[d], block.ids[i], n / len(block.sets[i]), n, len(block.sets[i]), at) for d, i, n, at in contained(some, block, threshold)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                                         names=["doc_id", "item_id", "containment", "shared", "item_shingles", "first_shingle"])

        parts.append(texts.mapInArrow(run, SCHEMA))
    return reduce(DataFrame.unionAll, parts)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5,
                      threshold: float = 0.8, functions: int = 32, block_words: int = 4_000_000) -> DataFrame:
    """The documents, all their columns, that contain no item."""
    for shared in item_blocks(items, item_col, item_text_col, width, functions, block_words):

        def accepted(texts: list[str | None], shared=shared) -> list[bool]:
            hit = {d for d, _, _, _ in contained(texts, shared.value, threshold)}
            return [k not in hit for k in range(len(texts))]

        docs = keep_rows(docs, text_col, accepted)
    return docs
