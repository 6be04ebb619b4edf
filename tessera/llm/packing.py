"""Cost-balanced packing of tokenized documents into sequences.

Whole multiples of the capacity become full sequences.  The rests of a task's documents, in
bounded groups, go longest first to the sequence with the lowest estimated cost (a * tokens + b * sum of squared piece
lengths, the attention's linear and quadratic share) among all that still have room for it; a rest that fits nowhere whole is
cut over the cheapest sequences with room.  A group opens just as many sequences as its tokens fill, so at most one
sequence of a group is padded; groups hold `group_tokens` tokens, so padding is under capacity / group_tokens.

No shuffle: groups are runs of rows of a partition.  A sequence's id is the partition's number and a running number.

Nulls: a null text is an empty document (its end id only).  Ties in length keep the order of rows.  A text of any
length is encoded whole; repeated rows are packed as often as they come; a null id is kept.  An empty table gives no rows.  Further
columns of the input, whatever their names, play no part.  A text that holds an added token of the vocabulary (as "<|endoftext|>")
is encoded as the tokenizers library does it: with that token's id, or as ordinary text with `special_as_text`.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import kept, texts_of

#: The word pattern of byte-level BPE (a fixed value of the vocabulary).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CONTROL = re.compile(r"[\x00-\x09\x0b-\x1f\x7f]")
#: What both libraries split alike whatever their Unicode version: printable Latin text and line breaks.
_PLAIN = re.compile(r"[\n\x20-\x7e\u00a1-\u024f]*")


class ByteBpe:
    """Ids of a text as little-endian uint32 bytes.

    With `ranks`, the same vocabulary as a rank file, plain Latin texts are encoded by tiktoken, several times as fast
    and with the same ids; every other text, those that hold an added token of the vocabulary, and all texts without `ranks`, by
    the tokenizers library.  In plain texts
    with single blanks a word with its blank is encoded alone (the word pattern looks ahead over white space only),
    and kept in a table of at most `table_size` words.
    """

    def __init__(self, path: str, ranks: str | None = None, table_size: int = 250_000, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.added = [a.content for a in self.tok.get_added_tokens_decoder().values()]
        self.fast = self._ranked(ranks)._core_bpe.encode_ordinary if ranks else None
        self.table, self.size = {}, table_size

    @staticmethod
    def _ranked(path: str):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(a in text for a in self.added) or not (_PLAIN.fullmatch(text) if not text.isascii() else not _CONTROL.search(text)):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "  " in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] == " ":
            return array("I", self.fast(text)).tobytes()
        first, *words = text.split(" ")
        if len(self.table) > self.size:
            self.table.clear()
        table, fast = self.table, self.fast
        try:
            body = b"".join([table[w] for w in words])
        except KeyError:
            for w in words:
                if w not in table:
                    table[w] = array("I", fast(" " + w)).tobytes()
            body = b"".join([table[w] for w in words])
        return array("I", fast(first)).tobytes() + body


def balance(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[list[tuple[int, int]]]:
    """Pieces (sequence, length) of every rest, in order; as few sequences as the tokens need.

    A rest goes whole to the sequence of the lowest cost among all that have room for it, and is cut over the cheapest with
    any room only if none has.  Equal costs: the lower number."""
    n_seq = -(-sum(lengths) // capacity)
    room, cost = np.full(n_seq, capacity), np.zeros(n_seq)
    heap = [(0.0, s) for s in range(n_seq)]  # the cheapest of all; entries of an earlier cost are stale
    out: list[list[tuple[int, int]]] = [[] for _ in lengths]

    def cheapest(need: int) -> int | None:
        while heap and (heap[0][0] != cost[heap[0][1]] or not room[heap[0][1]]):
            heapq.heappop(heap)
        if not heap:
            return None
        if room[heap[0][1]] >= need:
            return heap[0][1]
        open_ = np.flatnonzero(room >= need)
        return int(open_[cost[open_].argmin()]) if len(open_) else None

    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        left = lengths[k]
        while left:
            s = cheapest(left)
            if s is None:  # no room for all of it anywhere
                s = cheapest(1)
            put = min(left, int(room[s]))
            out[k].append((s, put))
            left -= put
            room[s] -= put
            cost[s] += linear * put + quadratic * put * put
            heapq.heappush(heap, (float(cost[s]), s))
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 1024, end_id: int = 0, group_tokens: int = 1 << 20, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    end = np.array([end_id], "<u4").tobytes()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept("bpe", (tokenizer, ranks, special_as_text), lambda: ByteBpe(tokenizer, ranks, special_as_text=special_as_text))
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 36
        rows: list[list] = [[] for _ in range(8)]
        rests: list[tuple[int | None, int, bytes, int]] = []
        held = 0

        def put(doc, start, ids, total, seq, offset) -> None:
            for c, v in zip(rows, (doc, start, len(ids) // 4, zlib.crc32(ids), total, seq, offset, ids), strict=True):
                c.append(v)

        def flush() -> None:
            nonlocal next_id, held
            plan = balance([len(r[2]) // 4 for r in rests], capacity)
            filled: dict[int, int] = {}
            for (doc, start, ids, total), pieces in zip(rests, plan, strict=True):
                at = 0
                for s, n in pieces:
                    put(doc, start + at, ids[4 * at : 4 * (at + n)], total, next_id + s, filled.get(s, 0))
                    filled[s] = filled.get(s, 0) + n
                    at += n
            next_id += len(filled)
            rests.clear()
            held = 0

        def batch() -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in rows[:7]]
            names = list(columns)
            if with_ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in rows[7]], pa.list_(pa.int32())))
                names.append("ids")
            for c in rows:
                c.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                for doc, text in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
                    ids = bpe(text) + end
                    total = len(ids) // 4
                    full = total // capacity * capacity
                    for at in range(0, full, capacity):
                        put(doc, at, ids[4 * at : 4 * (at + capacity)], total, next_id, 0)
                        next_id += 1
                    if full < total:
                        rests.append((doc, full, ids[4 * full :], total))
                        held += total - full
                        if held >= group_tokens:
                            flush()
                if len(rows[0]) > 4000:
                    yield batch()
        if rests:
            flush()
        yield batch()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
