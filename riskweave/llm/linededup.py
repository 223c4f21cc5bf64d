"""Fuzzy line deduplication: near-equal lines of all documents form groups, and one line of each group is kept.

1. Every non-blank line is hashed, and gets a MinHash signature of its character shingles, cut into bands. Long lines
   use one-permutation hashing (a shingle goes to one bin), short ones one function per value; lines between use both,
   so similar lines always share a scheme. A block of documents gives the bands of a repeated line once.
2. Lines that share a band meet after a shuffle of (band, line) numbers. Groups with the same members in several bands
   are taken once. A group of more than ``chunk`` lines, or ``chunk_chars`` characters, is dealt out as pairs of its chunks;
   bands that may be so large are found by counts of band hashes modulo a number of slots, and no task holds one.
3. Only lines that met are fetched. In each group they are linked where the exact Jaccard similarity of their shingle sets
   reaches the threshold; a pair that is connected already needs no comparison, so large groups of near copies cost
   little more than their size.
4. Components of the links (distributed union-find) and equal lines form the classes; the first line by document id,
   line number and row is kept.

Lines are told apart by 64-bit hashes, shingles by 40 bits within a comparison. A pair at similarity s is missed with a
chance of ``(1 - s ** rows) ** bands``: 0.5 % at 0.8, under 0.003 % from 0.9.

Lines end at a line feed. Blank lines are nobody's copies: they have no row. Defined results: null or empty text: no
row; a line shorter than the shingle width is one shingle; repeated rows (same id, same text) are separate rows of
which the first keeps its lines; a null id sorts first; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import batch_slices, docs_of, drop_shared, free_names, write_shared
from riskweave.llm.components import components
from riskweave.llm.grouped import mix, whole_groups
from riskweave.llm.shingles import char_shingles

LEAST = -(1 << 63)  # stands for a null id
EMPTY = np.uint32(0xFFFFFFFF)
SMALL = 16  # lines of a group that is compared together with others
BLOCK_BYTES = 1_000_000  # of the lines of several groups whose shingles are held at once
HASH_CHARS = 500_000  # of the lines whose shingles are hashed at once, and shingles that are compared at once


def line_runs(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs (from, to) of items of together not much over HASH_CHARS."""
    block = np.cumsum(sizes) // HASH_CHARS
    cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
    return [(int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(block)], strict=True)]


def line_id(line: str) -> int:
    """As Spark's xxhash64 of the string."""
    x = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), seed=42)
    return x - (1 << 64) if x >> 63 else x


class Banding:
    """Band hashes of lines: ``bands`` for a long or a short line, twice as many for one between."""

    def __init__(self, width: int, bands: int, rows: int, seed: int = 5):
        self.width, self.bands, self.rows = width, bands, rows
        rng = np.random.default_rng(seed)
        k = bands * rows
        self.a = rng.integers(1, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, k, dtype=np.uint32)
        self.jumps = rng.integers(0, k, (k, 64))

    def _hash(self, values: np.ndarray, scheme: int) -> np.ndarray:
        """(lines, bands) hashes of signatures, different for every band and scheme."""
        v = values.reshape(len(values), self.bands, self.rows).astype(np.uint64)
        h = np.broadcast_to(np.arange(self.bands, dtype=np.uint64) * np.uint64(2) + np.uint64(scheme + 1), v.shape[:2]).copy()
        for r in range(self.rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + v[:, :, r])
        return h.view(np.int64)

    def __call__(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Band hashes of all lines, one after another, and how many each has."""
        parts = [self._some(lines[a:b]) for a, b in line_runs(np.array([len(x) for x in lines], dtype=np.int64))]
        return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])

    def _some(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        k = self.bands * self.rows
        h, n = char_shingles(lines, self.width)
        low = h.astype(np.uint32)
        sig = np.full(len(lines) * k, EMPTY, dtype=np.uint32)
        bins = ((h >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        np.minimum.at(sig, np.repeat(np.arange(len(lines)) * k, n) + bins.astype(np.int64), np.minimum(low, EMPTY - np.uint32(1)))
        sig = sig.reshape(len(lines), k)
        filled = (sig != EMPTY).sum(1)
        dense, sparse = np.flatnonzero(filled >= 0.6 * k), np.flatnonzero(filled <= 0.85 * k)
        got = [np.empty((0, self.bands), np.int64)] * 2
        if dense.size:  # an empty bin takes the value of the first filled one on its own fixed random path
            s = sig[dense]
            for t in range(self.jumps.shape[1]):
                r, c = np.nonzero(s == EMPTY)
                if not r.size:
                    break
                s[r, c] = sig[dense[r], self.jumps[c, t]]
            got[0] = self._hash(s, 0)
        if sparse.size:
            few = np.zeros(len(lines), dtype=bool)
            few[sparse] = True
            own = low[np.repeat(few, n)]
            start = np.concatenate([[0], np.cumsum(n[sparse])[:-1]])
            got[1] = self._hash(np.stack([np.minimum.reduceat(own * a + b, start) for a, b in zip(self.a, self.b, strict=True)], axis=1), 1)
        order = np.argsort(np.concatenate([dense, sparse]), kind="stable")
        count = np.bincount(dense, minlength=len(lines)) + np.bincount(sparse, minlength=len(lines))
        return np.concatenate(got)[order].ravel(), count * self.bands


def lines_of(docs: DataFrame, id_col: str, text_col: str, banding: Banding) -> DataFrame:
    """did, uid (a number for the row), th (hash of its text), line_no, lid, chars, bands of every non-blank line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in batch_slices(batch, 1):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows, fresh, seen = [], [], set()
                for doc, text in zip(ids, texts, strict=True):
                    if text:
                        th = line_id(text)
                        for k, line in enumerate(text.split("\n")):
                            if line.strip():
                                lid = line_id(line)
                                rows.append((LEAST if doc is None else doc, uid, th, k, lid, len(line), lid not in seen))
                                if lid not in seen:
                                    seen.add(lid)
                                    fresh.append(line)
                    uid += 1
                if rows:
                    hashes, count = banding(fresh)
                    did, uids, th, no, lid, chars, new = (np.array(c) for c in zip(*rows, strict=True))
                    sizes = np.zeros(len(rows), dtype=np.int64)
                    sizes[new] = count
                    bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(hashes))
                    yield pa.RecordBatch.from_arrays([pa.array(did, pa.int64()), pa.array(uids, pa.int64()), pa.array(th, pa.int64()), pa.array(no, pa.int32()), pa.array(lid, pa.int64()),
                                                      pa.array(chars, pa.int32()), bands], names=["did", "uid", "th", "line_no", "lid", "chars", "bands"])

    return docs_of(docs, id_col, text_col).mapInArrow(run, "did long, uid long, th long, line_no int, lid long, chars int, bands array<long>")


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (band, lid) rows to (group, lid): groups of two lines or more, named by their members."""
    for table, starts in whole_groups(batches, "band"):
        lid = table.column("lid").to_numpy()
        group = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(lid)]])))
        new = np.concatenate([[True], (lid[1:] != lid[:-1]) | (group[1:] != group[:-1])])
        lid, group = lid[new], group[new]
        keep = np.bincount(group)[group] >= 2
        lid, group = lid[keep], group[keep]
        if not lid.size:
            continue
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([first, [len(lid)]]))
        name = mix(np.add.reduceat(mix(lid.view(np.uint64)), first) + size.astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size).view(np.int64)), pa.array(lid)], names=["group", "lid"])


def dealt(own: DataFrame, chunk: int, chunk_chars: int) -> DataFrame:
    """(band, lid, chars) rows, repeats among them, to (group, lid): a band's lines are one group, or one group for each pair
    of their chunks. Bands with the same lines are taken once."""
    own = own.distinct()
    parts = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("chars") / chunk_chars)).cast("int")
    names = own.groupBy("band").agg(F.count("*").alias("n"), parts.alias("parts"), F.bit_xor(F.xxhash64("lid")).alias("x"), F.min("lid").alias("lo"), F.max("lid").alias("hi"))
    names = names.where("n >= 2").select("band", F.xxhash64("n", "x", "lo", "hi").alias("name"), F.least("parts", "n").cast("int").alias("parts"))
    held = own.join(names, "band").select("name", "parts", "lid").distinct().withColumn("c", F.pmod(F.xxhash64("lid"), F.col("parts")).cast("int"))
    others = F.when(F.col("parts") > 1, F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != F.col("c"))).otherwise(F.array(F.lit(0)))
    pairs = held.withColumn("other", F.explode(others))
    pair = F.xxhash64("name", F.least("c", "other"), F.greatest("c", "other"))
    return pairs.select(F.when(F.col("parts") > 1, pair).otherwise(F.col("name")).alias("group"), "lid")


def met_lines(lines: DataFrame, bands: int, chunk: int, chunk_chars: int) -> DataFrame:
    """(group, lid) of lines that share a band; lines: lid, chars, bands (at most twice ``bands`` each)."""
    total = lines.agg(F.count("*").alias("n"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")).first()
    # So many slots that one is over the bounds on account of a large band, hardly of many small ones.
    slots = max(1, math.ceil(4 * bands * max(total.n / chunk, total.chars / chunk_chars)))
    rows = lines.select(F.explode("bands").alias("band"), "lid", "chars").withColumn("slot", F.pmod("band", F.lit(slots)))
    over = (F.count("*") > chunk) | (F.sum("chars") > chunk_chars)
    busy, _ = write_shared(rows.groupBy("slot").agg(over.alias("over")).where("over").select("slot"), "slots")
    meet_in = lambda some: some.select("band", "lid").repartition("band").sortWithinPartitions("band", "lid").mapInArrow(meet, "group long, lid long").distinct()
    if not busy.take(1):
        return meet_in(rows)
    return meet_in(rows.join(busy, "slot", "left_anti")).unionAll(dealt(rows.join(busy, "slot", "left_semi").select("band", "lid", "chars"), chunk, chunk_chars))


def shingle_sets(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (40 bits) of each line, sorted, one line after another, and where each line's start."""
    parts = [_some_sets(lines[a:b], width) for a, b in line_runs(np.array([len(x) for x in lines], dtype=np.int64))]
    return np.concatenate([s for s, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))])


def _some_sets(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets, one after another, and their sizes."""
    h, n = char_shingles(lines, width)
    both = np.sort(np.repeat(np.arange(len(lines), dtype=np.uint64) << np.uint64(40), n) | (h >> np.uint64(24)))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    of = (both >> np.uint64(40)).astype(np.int64)
    return both & np.uint64((1 << 40) - 1), np.bincount(of, minlength=len(lines))


def similar(sets: np.ndarray, at: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (p, q) of sets reach the Jaccard threshold."""
    size = np.diff(at)
    out = np.zeros(len(p), dtype=bool)
    fit = np.flatnonzero(np.minimum(size[p], size[q]) >= threshold * np.maximum(size[p], size[q]) - 1e-9)
    for lo, hi in line_runs(size[p[fit]] + size[q[fit]]):
        some = fit[lo:hi]
        member = np.stack([p[some], q[some]], axis=1).ravel()
        n = size[member]
        index = np.repeat(at[member] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pair = np.repeat(np.arange(len(some), dtype=np.uint64), n.reshape(-1, 2).sum(1))
        both = np.sort((pair << np.uint64(40)) | sets[index])
        shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(40)).astype(np.int64), minlength=len(some))
        out[some] = shared >= threshold * (size[p[some]] + size[q[some]] - shared) - 1e-9
    return out


def group_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """As whole_groups, by runs of groups whose lines have together not much over BLOCK_BYTES."""
    for table, starts in whole_groups(batches, "group"):
        ends = np.concatenate([starts[1:], [len(table)]])
        upto = np.cumsum(pc.binary_length(table.column("line")).to_numpy().astype(np.int64))[ends - 1]
        block = upto // BLOCK_BYTES
        for k in np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])):
            last = np.searchsorted(block, block[k], "right")
            yield table.slice(starts[k], ends[last - 1] - starts[k]), starts[k:last] - starts[k]


def link(width: int, threshold: float):
    """Sorted (group, lid, line) rows to edges (a, b) that connect all similar lines of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in group_blocks(batches):
            lid = table.column("lid").to_numpy()
            sets, at = shingle_sets(table.column("line").to_pylist(), width)
            ends = np.concatenate([starts[1:], [len(lid)]])
            size = ends - starts
            root = np.arange(len(lid))  # of each line's part of its group so far
            group = np.repeat(np.arange(len(starts)), size)
            a, b = [], []
            for i in range(SMALL - 1):  # small groups together: their i-th lines with the later ones that are not connected
                own = np.flatnonzero((size <= SMALL) & (size > i + 1))
                later = size[own] - i - 1
                p = np.repeat(starts[own] + i, later)
                q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(later) - later, later)
                apart = root[p] != root[q]
                p, q = p[apart], q[apart]
                ok = similar(sets, at, p, q, threshold)
                for x, y in zip(p[ok], q[ok], strict=True):
                    if root[x] != root[y]:
                        a.append(lid[root[x]])
                        b.append(lid[root[y]])
                        part = root[starts[group[x]]:ends[group[x]]]
                        part[part == root[y]] = root[x]
            a, b = [np.array(a, dtype=np.int64)], [np.array(b, dtype=np.int64)]
            for g in np.flatnonzero(size > SMALL):
                lo, part = starts[g], np.arange(size[g])
                for i in range(size[g] - 1):
                    rest = np.flatnonzero(part[i + 1:] != part[i]) + i + 1
                    if not rest.size:
                        continue
                    hit = rest[similar(sets, at, np.full(len(rest), lo + i), lo + rest, threshold)]
                    if hit.size:
                        joined = np.unique(part[hit])
                        a.append(np.full(len(joined), lid[lo + part[i]]))
                        b.append(lid[lo + joined])
                        part[np.isin(part, joined)] = part[i]
            a, b = np.concatenate(a), np.concatenate(b)
            if a.size:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 8, threshold: float = 0.8, bands: int = 10, rows: int = 4,
            chunk: int = 4096, chunk_chars: int = 2_000_000) -> DataFrame:
    """One row per non-blank line: doc_id, line_no (from 0), uid and th of its row, the line kept for its class, and whether it is that line."""
    spark = docs.sparkSession
    lines, _ = write_shared(lines_of(docs, id_col, text_col, Banding(width, bands, rows)), "lines")
    met, met_path = write_shared(met_lines(lines, bands, chunk, chunk_chars), "met")
    # The first occurrence of each line that met, by number, then its text from the documents.
    first_at = lines.groupBy("lid").agg(F.min(F.struct("did", "line_no")).alias("at"))  # a common line shrinks before it is moved
    wanted = first_at.join(met.select("lid").distinct(), "lid", "left_semi").select("lid", "at.did", "at.line_no")
    texts = docs_of(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(LEAST)).alias("did"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # Rows with one id may differ in text: the hash tells which one is meant. Of repeated rows one gives the line.
    texts = texts.join(wanted, ["did", "line_no"]).where(F.xxhash64("line") == F.col("lid")).select("lid", "line").dropDuplicates(["lid"])
    together = met.join(texts, "lid").select("group", "lid", "line").repartition("group").sortWithinPartitions("group", "lid")
    edges = together.mapInArrow(link(width, threshold), "a long, b long")
    roots = components(edges)
    drop_shared(spark, met_path)
    named = lines.drop("chars", "bands").join(roots.withColumnRenamed("node", "lid"), "lid", "left").select("did", "uid", "th", "line_no", F.coalesce("root", "lid").alias("class"))
    # Classes of several lines only, as a table: a class of many lines can then be split over tasks by the join.
    first, _ = write_shared(named.groupBy("class").agg(F.min(F.struct("did", "line_no", "uid")).alias("kept_line"), F.count("*").alias("class_lines")).where("class_lines > 1"), "classes")
    back = lambda c: F.when(c != LEAST, c)
    own = F.struct("did", "line_no", "uid")
    return named.join(first, "class", "left").withColumns({"kept_line": F.coalesce("kept_line", own), "class_lines": F.coalesce("class_lines", F.lit(1))}).select(
        back(F.col("did")).alias("doc_id"), "line_no", "uid", "th", back(F.col("kept_line.did")).alias("class_doc_id"), F.col("kept_line.line_no").alias("class_line_no"),
        "class_lines", (own == F.col("kept_line")).alias("kept"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all their columns, without the lines whose class is kept elsewhere.

    A document of which no line stays goes; of rows with the same id and text one stays. Documents without a non-blank
    line are left as they are."""
    found = classes(docs.select(id_col, text_col), id_col, text_col, **options)
    did, th, kept, count = free_names(docs, "_did", "_th", "_stay", "_lines")
    stay = found.groupBy(F.coalesce("doc_id", F.lit(LEAST)).alias(did), F.col("th").alias(th)).agg(
        F.collect_set(F.when(F.col("kept"), F.col("line_no"))).alias(kept), F.countDistinct("line_no").alias(count))
    keyed = docs.withColumns({did: F.coalesce(F.col(id_col), F.lit(LEAST)), th: F.xxhash64(F.col(text_col))})
    joined = keyed.join(stay, [did, th], "left").where(F.col(kept).isNull() | (F.size(kept) > 0)).dropDuplicates([did, th])
    whole = F.col(kept).isNull() | (F.size(kept) == F.col(count))
    cut = F.pandas_udf(_keep_lines, "string")(F.when(~whole, F.col(text_col)), F.when(~whole, F.col(kept)))
    return joined.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(cut)).select(*docs.columns)


def _keep_lines(text: pd.Series, stay: pd.Series) -> pd.Series:
    def one(t, numbers):
        numbers = set(numbers)
        return "\n".join(x for k, x in enumerate(t.split("\n")) if k in numbers or not x.strip())

    return pd.Series([None if t is None else one(t, k) for t, k in zip(text, stay, strict=True)], dtype=object)
