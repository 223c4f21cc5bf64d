"""Jaccard self-join of documents on word n-grams by chosen paths.

1. Documents with equal shingle sets are one class; everything below is about classes.
2. For every run and level a set draws its shingles whose hash, under that run and level, is below ``branching`` over the size
   that the overlap of a similar pair has at least: about ``branching`` shingles, and two similar sets draw about as
   many in common. A set's paths are its draws of level 1, 2, ...: sets that share a path form a bucket. A bucket of up to
   ``small`` sets is done; a larger one is split by the next level's draws, unless that would leave it nearly whole.
3. In finished buckets every pair is compared exactly on its 64-bit shingle hashes (by blocks of a matrix product). A pair
   counts in the first bucket that both sets share. Buckets with the same members are taken once; one of more than
   ``chunk`` sets, or ``chunk_shingles`` shingles, is dealt out as pairs of its chunks.
4. Links between classes are counted with their documents, and joined to components by distributed union-find.

Two similar sets share a draw of one level with a chance of about ``1 - exp(-branching)``. ``runs`` follows from the
target recall for a pair that has to go through all ``levels``; a pair that meets in small buckets at once is missed far
less often.

Shingles are of ``width`` lower-cased words; a text of fewer words, one at least, is one shingle. Defined results: null,
empty or wordless texts have no links and are each their own class; repeated rows are copies of each other; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import batch_slices, docs_of, drop_shared, free_names, text_blocks, write_shared
from riskweave.llm.components import components
from riskweave.llm.grouped import mix, whole_groups
from riskweave.llm.linededup import LEAST, line_id
from riskweave.llm.shingles import word_hashes, word_shingles


BLOCK_CHARS = 8_000_000


def runs_needed(recall: float, branching: float, levels: int) -> int:
    survives = (1 - math.exp(-branching)) ** levels
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survives)))


def distinct_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each text's start.

    Words of one block of texts at a time are held as strings."""
    if sum(len(t) for t in texts if t) > BLOCK_CHARS and len(texts) > 1:
        parts = [distinct_sets(some, width) for some, _ in text_blocks(texts, texts, BLOCK_CHARS // 2)]
        return np.concatenate([s for s, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(at) for _, at in parts]))])
    flat, count = word_hashes(texts)
    h, n = word_shingles(flat, count, width, short=True)
    of = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])[:len(h)]
    return h[new], np.searchsorted(of[new], np.arange(len(texts) + 1))


def drawn(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float, branching: float, runs: int, levels: int) -> DataFrame:
    """did, th (hash of the text), cls (hash of the shingle set; null without words), size (its shingles), draws[run * levels + level]
    of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, runs * levels + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        overlap = 2 * threshold / (1 + threshold)  # of two sets of one size at the threshold
        for batch in batches:
            for part in batch_slices(batch, 1):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                sets, at = distinct_sets(texts, width)
                size = np.diff(at)
                some = np.flatnonzero(size)
                cls = np.zeros(len(ids), dtype=np.uint64)
                if len(sets):
                    cls[some] = mix(np.add.reduceat(mix(sets), at[some]) ^ size[some].astype(np.uint64))
                limit = np.minimum(branching / (overlap * np.maximum(size, 1)), 1.0) * float(1 << 32)
                cut = np.repeat(np.minimum(limit, float((1 << 32) - 1)).astype(np.uint32), size)
                of = np.repeat(np.arange(len(ids), dtype=np.int64), size)
                row, values = [], []
                for k, seed in enumerate(seeds):
                    x = (sets ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
                    hit = np.flatnonzero(((x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(32)).astype(np.uint32) <= cut)
                    row.append(of[hit] * len(seeds) + k)
                    values.append(mix(sets[hit] ^ seed).view(np.int64))
                row, values = np.concatenate(row), np.concatenate(values)
                order = np.argsort(row, kind="stable")
                inner = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(len(ids) * len(seeds) + 1)), pa.int32()), pa.array(values[order]))
                outer = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * len(seeds), pa.int32()), inner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([LEAST if i is None else i for i in ids], pa.int64()), pa.array([None if t is None else line_id(t) for t in texts], pa.int64()),
                     pa.array(cls.view(np.int64), mask=size == 0), pa.array(size, pa.int64()), outer], names=["did", "th", "cls", "size", "draws"])

    return docs_of(docs, id_col, text_col).mapInArrow(run, "did long, th long, cls long, size long, draws array<array<long>>")


def buckets(sets: DataFrame, runs: int, levels: int, small: int, whole: float = 0.8) -> DataFrame:
    """(bucket, cls, n) of finished buckets of n >= 2 sets; sets: cls, draws.

    A large bucket of which one child has nearly all sets is a group of near copies: further draws would only repeat it,
    so it is finished as it is and its children are left out."""
    spark = sets.sparkSession

    def at_level(level: int) -> DataFrame:
        drawn_here = sets.select("cls", F.posexplode("draws").alias("k", "tokens")).where(F.col("k") % levels == level - 1)
        return drawn_here.select("cls", (F.col("k") / levels).cast("int").alias("run"), F.explode("tokens").alias("token"))

    now, path = write_shared(at_level(1).withColumnRenamed("token", "path"), "paths")
    paths = [path]
    sizes = now.groupBy("path").agg(F.count("*").alias("n")).where("n >= 2")
    done, large = [now.join(sizes.where(F.col("n") <= small), "path")], now.join(sizes.where(F.col("n") > small), "path")
    for level in range(2, levels + 1):
        down = large.join(at_level(level), ["cls", "run"]).select("cls", "run", F.col("path").alias("up"), F.col("n").alias("above"), F.xxhash64("path", "token").alias("path"))
        down, path = write_shared(down, "paths")
        paths.append(path)
        sizes = down.groupBy("path").agg(F.count("*").alias("n"), F.max("up").alias("up"), F.max("above").alias("above")).where("n >= 2")
        stuck = sizes.where(F.col("n") >= whole * F.col("above")).select(F.col("up").alias("path")).distinct()
        done.append(large.join(stuck, "path"))
        sizes = sizes.join(stuck.select(F.col("path").alias("up")), "up", "left_anti").select("path", "n")
        down = down.select("cls", "run", "path")
        last = level == levels
        done.append(down.join(sizes if last else sizes.where(F.col("n") <= small), "path"))
        if last or not sizes.where(F.col("n") > small).take(1):
            break
        large = down.join(sizes.where(F.col("n") > small), "path")
    done = [d.select(F.col("path").alias("bucket"), "cls", "n") for d in ([*done, large] if levels == 1 else done)]
    found = reduce(DataFrame.unionAll, done)
    # The same members: the same bucket. Named by their number and a digest of them.
    names = found.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    names = names.select("bucket", F.xxhash64("n", "x", "lo", "hi").alias("name"), "n")
    out, out_path = write_shared(found.drop("n").join(names, "bucket").select(F.col("name").alias("bucket"), "cls", "n").distinct(), "buckets")
    for p in paths:
        drop_shared(spark, p)
    return out


def dealt(found: DataFrame, sizes: DataFrame, chunk: int, chunk_shingles: int) -> DataFrame:
    """(part, bucket, cls, side): a bucket is one part, or one part for each pair of its chunks; only sides 1 and 2 of a
    part of two chunks are compared with each other. sizes: cls, size."""
    parts = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("size") / chunk_shingles)).cast("int")
    several = found.join(sizes, "cls").groupBy("bucket").agg(parts.alias("parts")).where("parts > 1")
    found = found.drop("n").join(several, "bucket", "left")
    fits = found.where("parts is null").select(F.col("bucket").alias("part"), "bucket", "cls", F.lit(0).alias("side"))
    own = found.where("parts is not null").withColumn("c", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    name = F.xxhash64("bucket", F.least("c", "other"), F.greatest("c", "other"))
    return fits.unionAll(pairs.select(name.alias("part"), "bucket", "cls", F.when(F.col("c") == F.col("other"), 0).when(F.col("c") < F.col("other"), 1).otherwise(2).alias("side")))


def compare(width: int, threshold: float):
    """Sorted (part, bucket, cls, side, text, weight, all its buckets) rows to (cls, links, root): each set's links in
    the part, in documents of the linked classes, and a member of its group there."""

    def lower_shared(bucket: int, homes: list) -> list[np.ndarray]:
        """For each bucket before this one that two members share: those members."""
        lower: dict[int, list[int]] = {}
        for i, home in enumerate(homes):
            for b in home:
                if b < bucket:
                    lower.setdefault(b, []).append(i)
        return [np.array(x) for x in lower.values() if len(x) > 1]

    def many(size, row, token, side, weight, lower):
        """Links of each set of one part and a member of its group, from all its pairs."""
        m = len(size)
        shared = np.bincount(token) > 1  # a shingle of one set adds to no overlap
        row, token = row[shared[token]], (np.cumsum(shared) - 1)[token[shared[token]]]
        links, root = np.zeros(m, dtype=np.int64), np.arange(m)
        before = np.zeros((m, len(lower)), dtype=np.float32)
        for k, x in enumerate(lower):
            before[x, k] = 1
        across = bool(side.any())  # of a part of two chunks only pairs across them are new
        left, right = (np.flatnonzero(side == 1), np.flatnonzero(side == 2)) if across else (np.arange(m), np.arange(m))
        overlap = np.zeros((len(left), len(right)), dtype=np.float32)
        order = np.argsort(token, kind="stable")
        for lo in range(0, int(shared.sum()), 2048):  # a block of shingles at a time
            pick = order[np.searchsorted(token[order], lo):np.searchsorted(token[order], lo + 2048)]
            dense = np.zeros((m, 2048), dtype=np.float32)
            dense[row[pick], token[pick] - lo] = 1
            overlap += dense[left] @ dense[right].T
        for lo in range(0, len(left), 512):
            mine = left[lo:lo + 512]
            some = overlap[lo:lo + 512].astype(np.float64)
            ok = some >= threshold * (size[mine, None] + size[None, right] - some) - 1e-9
            if not across:
                ok[np.arange(len(mine)), lo + np.arange(len(mine))] = False
            for k in np.flatnonzero(ok.any(1)):  # groups of the part, whichever bucket counts the links
                near = np.append(root[right[ok[k]]], root[mine[k]])
                root[np.isin(root, near)] = near.min()
            if len(lower):
                ok &= ~((before[mine] @ before[right].T) > 0)
            links[mine] += (ok * weight[None, right]).sum(1)
            if across:
                links[right] += (ok * weight[mine, None]).sum(0)
        return links, root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, "part"):
            part, cls = table.column("part").to_numpy(), table.column("cls").to_numpy()
            order = np.lexsort((cls, part))
            part, cls = part[order], cls[order]
            bucket, side, weight = (table.column(c).to_numpy()[order] for c in ("bucket", "side", "weight"))
            homes = table.column("homes").take(pa.array(order)).to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            lower = [lower_shared(bucket[lo], homes[lo:hi]) for lo, hi in zip(starts, [*starts[1:], len(cls)], strict=True)]
            ends = np.concatenate([starts[1:], [len(cls)]])
            # Members that all share one bucket before are compared there.
            todo = [g for g in range(len(starts)) if ends[g] - starts[g] > 1 and not any(len(x) == ends[g] - starts[g] for x in lower[g])]
            wanted = np.concatenate([np.arange(starts[g], ends[g]) for g in todo]) if todo else np.empty(0, np.int64)
            links, root = np.zeros(len(cls), dtype=np.int64), np.arange(len(cls))
            if todo:
                texts = table.column("text").take(pa.array(order[wanted])).to_pylist()
                sets, at = distinct_sets(texts, width)
                token = np.unique(sets, return_inverse=True)[1]
                size, place = np.diff(at), np.full(len(cls), -1)
                place[wanted] = np.arange(len(wanted))
                pairs = np.array([starts[g] for g in todo if ends[g] - starts[g] == 2], dtype=np.int64)
                if pairs.size:
                    p, q = place[pairs], place[pairs + 1]
                    both = np.stack([p, q], axis=1).ravel()
                    index = np.repeat(at[both] - np.concatenate([[0], np.cumsum(size[both])[:-1]]), size[both]) + np.arange(size[both].sum())
                    of = np.repeat(np.arange(len(p)), size[p] + size[q])
                    key = np.sort((of << 32) | token[index])
                    shared = np.bincount(key[1:][key[1:] == key[:-1]] >> 32, minlength=len(p))
                    ok = (shared >= threshold * (size[p] + size[q] - shared) - 1e-9) & ~((side[pairs] == side[pairs + 1]) & (side[pairs] > 0))
                    links[pairs[ok]], links[pairs[ok] + 1] = weight[pairs[ok] + 1], weight[pairs[ok]]
                    root[pairs[ok] + 1] = pairs[ok]
                for g in todo:
                    lo, hi = starts[g], ends[g]
                    if hi - lo > 2:
                        a, b = at[place[lo]], at[place[hi - 1] + 1]
                        own = np.unique(token[a:b], return_inverse=True)[1]
                        row = np.repeat(np.arange(hi - lo), size[place[lo:hi]])
                        links[lo:hi], near = many(size[place[lo:hi]], row, own, side[lo:hi], weight[lo:hi], lower[g])
                        root[lo:hi] = lo + near
            kept = (links > 0) | (root != np.arange(len(cls)))
            if kept.any():
                yield pa.RecordBatch.from_arrays([pa.array(cls[kept]), pa.array(links[kept]), pa.array(cls[root[kept]])], names=["cls", "links", "root"])

    return run


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.999,
         branching: float = 3.0, levels: int = 4, small: int = 64, chunk: int = 2048, chunk_shingles: int = 8_000_000) -> DataFrame:
    """One row per document: doc_id, th (hash of its text), its class of equal shingle sets (null without words) and that
    class's documents, its component and the smallest id there (its own without words), and the number of documents that are linked to it."""
    spark = docs.sparkSession
    runs = runs_needed(recall, branching, levels)
    texts = docs_of(docs, id_col, text_col)
    draws, draws_path = write_shared(drawn(docs, id_col, text_col, width, threshold, branching, runs, levels), "draws")
    # One document of each class speaks for it; all draw the same, so any row's draws do.
    rows, _ = write_shared(draws.select("did", "th", "cls"), "documents")
    known = draws.where("cls is not null")
    speaker = known.groupBy("cls").agg(F.min(F.struct("did", "th")).alias("at"), F.count("*").alias("weight"), F.max("size").alias("size"))
    speaker, speaker_path = write_shared(speaker.select("cls", "at.did", "at.th", "weight", "size"), "classes")
    sets = known.join(speaker.select("cls", "did", "th"), ["cls", "did", "th"], "left_semi").dropDuplicates(["cls"]).select("cls", "draws")
    found = buckets(sets, runs, levels, small)
    drop_shared(spark, draws_path)  # before texts are moved
    homes = found.groupBy("cls").agg(F.collect_list("bucket").alias("homes"))  # some draws a run: bounded by the method
    met = homes.join(speaker, "cls").select("cls", "did", "th", "weight", "homes")
    # Repeated rows have the speaker's id and text too: one stays, before texts are copied to the parts.
    text_of = texts.select(F.coalesce("doc_id", F.lit(LEAST)).alias("did"), F.xxhash64("text").alias("th"), "text").join(met, ["did", "th"]).select("cls", "weight", "homes", "text").dropDuplicates(["cls"])
    parts = dealt(found, speaker.select("cls", "size"), chunk, chunk_shingles).join(text_of, "cls").select("part", "bucket", "cls", "side", "text", "weight", "homes")
    parts = parts.repartition("part").sortWithinPartitions("part")
    links, links_path = write_shared(parts.mapInArrow(compare(width, threshold), "cls long, links long, root long"), "links")
    roots = components(links, "cls", "root")
    per = links.groupBy("cls").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    per = speaker.select("cls", "weight", F.col("did").alias("first")).join(per, "cls", "left").select(
        "cls", "weight", "first", F.coalesce("root", "cls").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    low = per.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("weight").alias("class_size"))
    per, _ = write_shared(per.join(low, "root").select("cls", "root", "weight", "n_links", "class_id", "class_size"), "joined")
    drop_shared(spark, links_path)
    drop_shared(spark, speaker_path)
    back = lambda c: F.when(c != LEAST, c)
    return rows.select("did", "th", "cls").join(per, "cls", "left").select(
        back(F.col("did")).alias("doc_id"), "th", F.col("cls").alias("equal_set"), F.coalesce("weight", F.lit(1)).alias("equal_docs"),
        back(F.coalesce("class_id", "did")).alias("class_id"), F.col("root").alias("component"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all their columns, of which each component of similar ones keeps the first by id and text hash.

    Rows with the same id and text count as one."""
    found = join(docs.select(id_col, text_col), id_col, text_col, **options)
    own = F.coalesce("doc_id", F.lit(LEAST))
    did, th = free_names(docs, "_did", "_th")
    with_words = found.where("equal_set is not null").groupBy("component").agg(F.min(F.struct(own.alias(did), F.col("th").alias(th))).alias("at")).select(f"at.{did}", f"at.{th}")
    wordless = found.where("equal_set is null").select(own.alias(did), F.col("th").alias(th)).distinct()
    keys = with_words.unionAll(wordless).withColumn(th, F.coalesce(th, F.lit(0)))
    keyed = docs.withColumns({did: F.coalesce(F.col(id_col), F.lit(LEAST)), th: F.coalesce(F.when(F.col(text_col).isNotNull(), F.xxhash64(F.col(text_col))), F.lit(0))})
    return keyed.join(keys, [did, th], "left_semi").dropDuplicates([did, th]).select(*docs.columns)
