"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

A document's ids are cut into full sequences plus one rest. Rests of one task are packed together, a window of them
at a time: their cost is estimated as ``linear * n + quadratic * n**2`` (attention within the piece), the dearest comes
first, and each goes to the cheapest sequence that still has room for it. A window opens just enough sequences for
its tokens, so when a rest fits nowhere whole it is cut over the roomiest ones: at most ``seq_len - 1`` ids of padding
per window.

There is no shuffle: any mix of documents packs equally well, so each task packs what it reads, in memory bounded by
the window. ``sequence_id`` holds the task's partition in its upper bits. A task that is run again packs the same way.

Defined results: a null or empty text is the end id alone; repeated rows are packed once each; a null id stays null;
an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskweave.llm.common import docs_of, text_blocks

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "piece_cost double")
SPECIAL = "<|"
LONG_RUN = 5_000


class ByteBpe:
    """Ids of a byte-level BPE file as the ``tokenizers`` library gives them.

    ``tiktoken`` merges the same vocabulary several times faster; it is used where the file's own tables show that both
    must agree (plain byte-level split, ids in merge order), and never for a text that may hold a special token or a
    run without white space long enough to make its merging slow."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = self._ranks(spec)

    @staticmethod
    def _ranks(spec: dict):
        import tiktoken
        from public_tokenizers import PATTERN

        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                 and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("ignore_merges"))
        if not plain:
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        added = {x["content"] for x in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in model["vocab"].items() if t not in added}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if [vocab.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
            return None
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if not text:
            return []
        if self.fast is None or SPECIAL in text or (len(text) > LONG_RUN and max(map(len, text.split())) > LONG_RUN):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def place(lengths: np.ndarray, seq_len: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pack pieces of at most seq_len ids: rows (piece, its start, length, sequence, offset there) and the sequences used."""
    n_seq = -(-int(lengths.sum()) // seq_len)
    load, left = np.zeros(n_seq), np.full(n_seq, seq_len, dtype=np.int64)
    out = []
    for i in np.lexsort((np.arange(len(lengths)), -(linear * lengths + quadratic * lengths.astype(float) ** 2))):
        start, rest = 0, int(lengths[i])
        while rest:
            room = left >= rest
            j = int(np.argmin(np.where(room, load, np.inf))) if room.any() else int(np.argmax(left))
            n = min(rest, int(left[j]))
            out.append((int(i), start, n, j, seq_len - int(left[j])))
            load[j] += linear * n + quadratic * n * n
            left[j] -= n
            start, rest = start + n, rest - n
    return out, n_seq


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 1024, end_id: int = 0,
         linear: float = 1.0, quadratic: float = 1.0 / 1024, window: int = 4096) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in its sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, base, used = ByteBpe(tokenizer), TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []
        rests: list[tuple] = []  # doc_id, its ids before the rest, the rest's ids, all its ids

        def piece(doc, start, ids, total, seq, offset):
            n = len(ids)
            rows.append((doc, start, n, zlib.crc32(ids.tobytes()), total, base + seq, offset, linear * n + quadratic * n * n))

        def flush():
            nonlocal used, rests
            if rests:
                placed, n_seq = place(np.array([len(r[2]) for r in rests]), seq_len, linear, quadratic)
                for i, start, n, j, offset in placed:
                    doc, before, ids, total = rests[i]
                    piece(doc, before + start, ids[start:start + n], total, used + j, offset)
                used, rests = used + n_seq, []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 7 + [pa.float64()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                              names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "piece_cost"])

        for b in batches:
            for ids, texts in text_blocks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for doc, text in zip(ids, texts, strict=True):
                    got = np.array([*bpe.ids(text), end_id], dtype="<u4")
                    full = len(got) // seq_len * seq_len
                    for at in range(0, full, seq_len):
                        piece(doc, at, got[at:at + seq_len], len(got), used, 0)
                        used += 1
                    if full < len(got):
                        rests.append((doc, full, got[full:].copy(), len(got)))
                    if len(rests) >= window:
                        flush()
                if rows:
                    yield batch()
        flush()
        if rows:
            yield batch()

    return docs_of(docs, id_col, text_col).mapInArrow(run, SCHEMA)
