"""Packing of tokenized documents into sequences of near-equal length, by Karmarkar-Karp differencing.

A document is cut into whole sequences first; what is left over of it (less than a sequence) waits in a
pool.  A pool of some hundred sequences' worth of tokens is dealt out by multiway differencing: partial
partitions, each a set of windows, are merged in the order of their imbalance, the fullest windows of one
with the emptiest of the other, until one partition is left, whose windows are nearly equal.  If its fullest
window is over the capacity, the pool is dealt out again over one window more.

Each task packs the documents that it reads: there is no shuffle, a task holds one pool, and a task that
runs again makes the same sequences.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
#: Leftovers are dealt out in cuts of at most so many tokens, and pools of so many sequences.
CUT = 256
POOL = 128
END = 0

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Texts of these characters alone are split alike by every regular-expression library and Unicode version.
_PLAIN = re.compile(r"[\t\n\r -~\u00a1-\u00ac\u00ae-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2010-\u2027\u20ac]*")
# Fixed value: how byte-level BPE splits a text before it merges.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids as bytes (unsigned, 32 bits, little-endian), as the tokenizer of the file at `path` gives them.

    The vocabulary is also loaded into a faster encoder.  As every token of a trained vocabulary is the result
    of one merge, it makes the same merges; it gets all texts of plain characters, and the tokenizer itself
    gets those with other characters or with one of its special tokens.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        moved = [b for b in range(256) if b not in own]
        byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(moved)}
        special = {x.content for x in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(map(byte.__getitem__, t)): k for t, k in self.tokenizer.get_vocab().items() if t not in special}
        self.fast = tiktoken.Encoding("plain", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and not self.special.search(text):
            return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        return self.whole(text)


@cache
def encoder_of(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def _merge(a: list, b: list, windows: int) -> list:
    """Two partitions, each a list of (tokens, items) with the fullest first and empty windows left out."""
    apart = windows - len(b)
    if len(a) <= apart:
        joined = a + b
    else:  # the emptiest windows of the one take the fullest of the other
        joined = a[:apart] + [(x + y, (i, j)) for (x, i), (y, j) in zip(a[apart:], reversed(b), strict=False)]
        joined += b[: len(b) - (len(a) - apart)]
    joined.sort(key=lambda x: -x[0])
    return joined


def _items(tree: object) -> list[int]:
    found, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo.extend(x)
        else:
            found.append(x)
    return found


def differencing(sizes: list[int], capacity: int) -> list[list[int]]:
    """The positions of `sizes` in each window: as few windows as differencing fills within the capacity."""
    if not sizes:
        return []
    windows = -(-sum(sizes) // capacity)
    while True:
        heap = [(-s if windows > 1 else 0, k, [(s, k)]) for k, s in enumerate(sizes)]
        heapq.heapify(heap)
        number = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
            joined = _merge(a, b, windows)
            spread = joined[0][0] - (joined[-1][0] if len(joined) == windows else 0)
            heapq.heappush(heap, (-spread, number, joined))
            number += 1
        if (last := heap[0][2])[0][0] <= capacity:
            return [_items(tree) for _, tree in last]
        windows += 1


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    cut: int = CUT,
    pool: int = POOL,
) -> DataFrame:
    """Pieces of documents, each with its place in a sequence of at most `capacity` tokens.

    `tokenizer` is a path that every executor can read.  A document is its ids and the id END; a null or
    empty text is that id alone.  Columns: the id, start (the document's ids before the piece), length,
    ids_crc32 (of the piece's ids, unsigned 32-bit little-endian), doc_tokens, sequence_id, offset in the
    sequence.  A repeated row is packed again; null ids stay null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(tokenizer).encode
        sequence = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []
        tokens = 0
        kind = None

        def piece(doc: tuple, start: int, length: int, offset: int) -> tuple:
            ids = doc[1][4 * start : 4 * (start + length)]
            return (doc[0], start, length, zlib.crc32(ids), len(doc[1]) // 4, sequence, offset)

        def dealt() -> Iterator[tuple]:
            nonlocal sequence, tokens
            for window in differencing([n for _, _, n in waiting], capacity):
                offset = 0
                for k in sorted(window):
                    doc, start, n = waiting[k]
                    yield piece(doc, start, n, offset)
                    offset += n
                sequence += 1
            waiting.clear()
            tokens = 0

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], kind), *(pa.array(x, pa.int64()) for x in columns[1:])]
            return pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            kind = b.column(0).type
            names = b.column(0).to_pylist()
            for k in range(0, len(names), 200):
                rows = []
                for name, text in zip(names[k : k + 200], b.column(1).slice(k, 200).to_pylist(), strict=True):
                    doc = (name, encode(text or "") + END.to_bytes(4, "little"))
                    n = len(doc[1]) // 4
                    whole = n - n % capacity
                    for start in range(0, whole, capacity):
                        rows.append(piece(doc, start, capacity, 0))
                        sequence += 1
                    for start in range(whole, n, cut):
                        waiting.append((doc, start, min(cut, n - start)))
                    tokens += n - whole
                    if tokens >= (pool - 1) * capacity:
                        rows.extend(dealt())
                if rows:
                    yield batch(rows)
        if waiting:
            yield batch(list(dealt()))

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    packed = chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, {SCHEMA}")
    return packed.withColumnRenamed("id", id_col)
