"""Alignment of two tokenizers' tokens of the same text by pointer jumping, and how common each aligned pair of ids is.

A byte-level BPE (A) encodes a space and the text, a sentencepiece BPE (B) the text to which it adds that space itself. Every
token points to the farthest-right token that overlaps it (on a tie to B's, itself if it is that one). The pointers of all
tokens are replaced by their pointer's pointer until nothing changes: each then holds its component's last token, and
tokens with the same last token form a group, cut where both tokenizers end a token.

1. Texts are read in blocks of about ``chars`` characters. Neither tokenizer's merges cross a single space between two other
   characters (the files are asked whether that holds, else a text stays whole), so each distinct stretch between such
   spaces is encoded and aligned once a block. A block becomes one row: its documents as numbers of stretches, the
   stretches as numbers of linked id pairs, and those pairs with the block's number of documents that hold them.
2. The pairs' numbers are summed over all blocks: one row per block and pair moves, not one per link.
3. Each block meets its own pairs' totals again (cogrouped by block) and sums them up for its documents. Texts never move.

A task holds a block; a text longer than one is a block of its own. No pair is more frequent than there are blocks.

Defined results: null and empty texts, and texts that one of the tokenizers does not give back byte by byte, have no
tokens: zeros and ''. Special tokens' strings are plain text. A null id stays null; repeated rows are documents each; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import docs_of, write_shared
from riskweave.llm.packing import ByteBpe

CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE = "▁"


def sizes_and_names(tokens: list[bytes]) -> tuple[np.ndarray, list[str]]:
    return np.array([len(t) for t in tokens], dtype=np.int64), [str(i) for i in range(len(tokens))]


class BytePair:
    """Tokenizer A, its tokens' bytes, and whether texts may be cut (its pattern starts a word at such a space)."""

    def __init__(self, path: str):
        self.bpe = ByteBpe(path)
        self.bpe.exact.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in byte_of for c in token):
                self.bytes[i] = bytes(byte_of[c] for c in token)
        self.sizes, self.names = sizes_and_names(self.bytes)
        self.cuts = self.bpe.fast is not None  # the file was found to have that plain pattern

    def encode(self, stretches: list[str]) -> list[list[int]]:
        return [self.bpe.ids(x) for x in stretches]


class Pieces:
    """Tokenizer B, its pieces' bytes, and whether texts may be cut (no normalising, no piece over such a space)."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            plain = not (self.model.is_unknown(i) or self.model.is_control(i) or self.model.is_unused(i))
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(SPACE, " ").encode() if plain else b"")
        self.sizes, self.names = sizes_and_names(self.bytes)
        rules = spec.normalizer_spec
        self.cuts = (rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
                     and not spec.trainer_spec.treat_whitespace_as_suffix and not any(p.type == p.USER_DEFINED for p in spec.pieces)
                     and not any(SPACE in p.piece.lstrip(SPACE) for p in spec.pieces))

    def encode(self, stretches: list[str]) -> list[list[int]]:
        """Of stretches that start with the space the model adds."""
        return self.model.encode([x[1:] for x in stretches], num_threads=1)


def last_tokens(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The last token of every token's component, A's tokens numbered first, then B's; both cover the same bytes."""
    n = len(ends_a)
    starts_a, starts_b = (np.concatenate([[0], e[:-1]]) for e in (ends_a, ends_b))
    to_b = np.searchsorted(starts_b, ends_a, "left") - 1  # the token with the last byte
    to_a = np.searchsorted(starts_a, ends_b, "left") - 1
    pointer = np.concatenate([n + to_b, np.where(ends_a[to_a] > ends_b, to_a, n + np.arange(len(ends_b)))]) if n else np.empty(0, np.int64)
    while True:
        ahead = pointer[pointer]
        if np.array_equal(ahead, pointer):
            return pointer
        pointer = ahead


def given_back(raw: list[bytes], size: np.ndarray, flat: np.ndarray, n: np.ndarray, side) -> np.ndarray:
    """Which stretches are the bytes of their tokens, one after another; flat: all ids, n: how many each has."""
    of = np.repeat(np.arange(len(raw)), n)
    own = side.sizes[flat]
    ok = np.bincount(of, own, minlength=len(raw)).astype(np.int64) == size
    ok[of[own == 0]] = False
    if not ok.any():
        return ok
    got = np.frombuffer(b"".join([side.bytes[i] for i in flat[ok[of]].tolist()]), dtype=np.uint8)
    want = np.frombuffer(b"".join([x for x, fit in zip(raw, ok.tolist(), strict=True) if fit]), dtype=np.uint8)
    fits = np.flatnonzero(ok)
    ok[fits[np.searchsorted(np.cumsum(size[fits]), np.flatnonzero(got != want), "right")]] = False
    return ok


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each number once."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[:len(x)]]


class Aligned:
    """The distinct stretches of a block, aligned: sizes, links and the groups written out, by stretch."""

    def __init__(self, stretches: list[str], a, b):
        raw = [x.encode() for x in stretches]
        size = np.array([len(x) for x in raw], dtype=np.int64)
        self.ok = np.ones(len(stretches), dtype=bool)
        many, flat = [], []
        for side in (a, b):
            own = side.encode(stretches)
            many.append(np.array([len(x) for x in own], dtype=np.int64))
            flat.append(np.array(list(chain.from_iterable(own)), dtype=np.int64))
            self.ok &= given_back(raw, size, flat[-1], many[-1], side)
        ends = []
        for k, side in enumerate((a, b)):
            flat[k] = flat[k][np.repeat(self.ok, many[k])]
            many[k] = many[k] * self.ok
            ends.append(np.cumsum(side.sizes[flat[k]]))
        self.names = (a.names, b.names)
        self.n_a, self.n_b = many
        last = last_tokens(*ends)
        n = len(flat[0])
        terminal = np.flatnonzero(last == np.arange(len(last)))
        group = np.searchsorted(terminal, last)
        upto = np.cumsum(size * self.ok)  # where each stretch ends
        stretch_of = np.searchsorted(upto, ends[1][terminal - n], "left")  # of each group
        self.n_groups = np.bincount(stretch_of, minlength=len(stretches))
        self.text = self._written(flat, group, n, len(terminal))
        # Links: each token of A with those of B over its bytes.
        start_a, start_b = (np.concatenate([[0], e[:-1]]) for e in ends)
        lo, hi = np.searchsorted(ends[1], start_a, "right"), np.searchsorted(start_b, ends[0], "left")
        count = hi - lo
        of_a = np.repeat(np.arange(n), count)
        of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        linked = (flat[0][of_a] << 32) | flat[1][of_b]
        code = distinct(linked)
        self.link = np.searchsorted(code, linked)
        self.a, self.b = code >> 32, code & 0xFFFFFFFF
        links_upto = np.concatenate([[0], np.cumsum(count)])
        self.link_at = links_upto[np.concatenate([[0], np.cumsum(self.n_a)])]

    def _written(self, flat, group, n, groups) -> list[str]:
        """Each stretch's groups, as ``a1,a2|b1;...``."""
        names = [[known[i] for i in x.tolist()] for known, x in zip(self.names, flat, strict=True)]
        cuts = [np.searchsorted(g, np.arange(groups + 1)).tolist() for g in (group[:n], group[n:])]
        each = [",".join(names[0][p:q]) + "|" + ",".join(names[1][r:s]) for p, q, r, s in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:], strict=False)]
        at = np.concatenate([[0], np.cumsum(self.n_groups)]).tolist()
        return [";".join(each[p:q]) for p, q in zip(at, at[1:], strict=False)]


RECORD = "block long, a array<int>, b array<int>, docs array<int>, body binary"


def packed(columns: dict[str, pa.Array]) -> bytes:
    """Arrays of any lengths as one compressed Arrow stream: Spark moves a block's numbers without reading them."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns.values()]
    sink = pa.BufferOutputStream()
    row = pa.RecordBatch.from_arrays(lists, names=list(columns))
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(row)
    return sink.getvalue().to_pybytes()


def unpacked(body: bytes) -> dict[str, pa.Array]:
    row = pa.ipc.open_stream(body).read_next_batch()
    return {name: column[0].values for name, column in zip(row.schema.names, row.columns, strict=True)}


def block_record(block: int, ids: list, texts: list, a, b) -> pa.RecordBatch:
    """One block's row: what its documents are made of."""
    cut = a.cuts and b.cuts
    parts = [[] if not t else CUT.split(t) if cut else [t] for t in texts]
    pieces = [np.array([len(p) for p in parts], dtype=np.int64)]
    coded = pa.array([" " + x for p in parts for x in p], pa.string()).dictionary_encode()
    stretch = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = Aligned(coded.dictionary.to_pylist(), a, b)
    doc_of = np.repeat(np.arange(len(ids)), pieces[0])
    void = np.zeros(len(ids), dtype=bool)
    void[doc_of[~known.ok[stretch]]] = True
    stretch, doc_of = stretch[~void[doc_of]], doc_of[~void[doc_of]]
    doc_at = np.searchsorted(doc_of, np.arange(len(ids) + 1))
    n_links = np.diff(known.link_at)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[stretch])])[doc_at])
    sha, listed = [], stretch.tolist()
    for lo, hi in zip(doc_at, doc_at[1:], strict=False):
        sha.append(hashlib.sha256(";".join([known.text[k] for k in listed[lo:hi]]).encode()).hexdigest() if hi > lo else "")
    # Documents that hold each pair: distinct stretches of a document first.
    once = distinct(doc_of * max(1, len(known.ok)) + stretch)
    doc, own = once // max(1, len(known.ok)), once % max(1, len(known.ok))
    n = n_links[own]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(known.link_at[own], n)
    held = distinct(np.repeat(doc, n) * max(1, len(known.a)) + known.link[at])
    docs = np.bincount(held % max(1, len(known.a)), minlength=len(known.a))
    body = {"doc_id": pa.array(ids, pa.int64()), "n_a": pa.array(total(known.n_a)), "n_b": pa.array(total(known.n_b)), "n_groups": pa.array(total(known.n_groups)),
            "n_links": pa.array(total(n_links)), "groups_sha256": pa.array(sha, pa.string()), "doc_at": pa.array(doc_at, pa.int32()), "stretch": pa.array(stretch, pa.int32()),
            "link_at": pa.array(known.link_at, pa.int32()), "link": pa.array(known.link, pa.int32())}
    pairs = [pa.array([x.tolist()], pa.list_(pa.int32())) for x in (known.a, known.b, docs)]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *pairs, pa.array([packed(body)], pa.binary())], names=[x.split()[0] for x in RECORD.split(", ")])


def blocks_of(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b, block = BytePair(a_path), Pieces(b_path), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):  # few texts as strings at once
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and size + len(text or "") > chars:
                    yield block_record(block, ids, texts, a, b)
                    ids, texts, size, block = [], [], 0, block + 1
                ids.append(doc)
                texts.append(text)
                size += len(text or "") + 1  # empty texts fill a block too
        if ids:
            yield block_record(block, ids, texts, a, b)

    return docs_of(docs, id_col, text_col).mapInArrow(run, RECORD)


def summed(record: pa.Table, totals: pa.Table) -> pa.Table:
    """A block's row and its pairs' totals (place, n, best) to its documents' rows."""
    body = unpacked(record.column("body")[0].as_py())
    num = lambda c: body[c].to_numpy(zero_copy_only=False)
    n = np.zeros(record.column("pairs")[0].as_py(), dtype=np.int64)
    best = np.zeros(len(n), dtype=np.int64)
    place = totals.column("place").to_numpy()
    n[place], best[place] = totals.column("n").to_numpy(), totals.column("best").to_numpy().astype(np.int64)
    cols = [body[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    for values in (best, n):
        stretch = np.diff(np.concatenate([[0], np.cumsum(values[num("link")])])[num("link_at")])
        cols.append(pa.array(np.diff(np.concatenate([[0], np.cumsum(stretch[num("stretch")])])[num("doc_at")])))
    return pa.table([*cols, body["groups_sha256"]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chars: int = 2_500_000) -> tuple[DataFrame, DataFrame]:
    """Per document: tokens of both, groups, links, links whose pair is its A id's most common one, the sum of the links' pair
    counts, and a digest of the groups. And the table (a, b, n, best) of all linked id pairs."""
    records, _ = write_shared(blocks_of(docs, a_path, b_path, id_col, text_col, chars), "aligned")
    pairs = records.select("block", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("place", "p")).select("block", "place", "p.a", "p.b", "p.docs").where("docs > 0")
    counts, _ = write_shared(pairs.groupBy("a", "b").agg(F.sum("docs").alias("n")), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    common, _ = write_shared(counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "common")
    totals = pairs.select("block", "place", "a", "b").join(common.hint("shuffle_hash"), ["a", "b"]).select(F.col("block").alias("of"), "place", "n", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return records.select("block", F.size("a").alias("pairs"), "body").groupBy("block").cogroup(totals.groupBy("of")).applyInArrow(summed, schema), common
