"""SimHash near-duplicate groups, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits.  If two fingerprints differ in at
most four bits, then some two of their segments differ in at most two bits together.  Each segment, padded
with zeros to 23 bits, is decoded with the perfect (23, 12, 7) Golay code: its keys are the 12-bit indices
of all codewords within four bits, which are one or six; two segments that differ in at most two bits always
share a codeword.  The join key is therefore (pair of segments, index, index), and each candidate is
verified on the whole fingerprint.

Equal fingerprints are collapsed before the keys are made, and each task reports only a spanning forest of
the links that it verifies, so that a large group of copies never turns into all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, joined_labels, saved

SHINGLE = 4
MAX_BITS = 4
#: A key with more fingerprints than this is compared in blocks of half the size, spread over tasks.
HOT_KEY = 4096

# Generator polynomial of the binary Golay code, and (lowest bit, bits) of the three segments.
GOLAY_POLYNOMIAL = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEGMENT_PAIRS = ((0, 1), (0, 2), (1, 2))


@cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 bits; for each syndrome the error patterns of at most four bits, and their number."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY_POLYNOMIAL << (bit - 11)
        return word

    upper = np.array([remainder(m << 11) for m in range(4096)], dtype=np.int64)
    single = [remainder(1 << b) for b in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]
    level = [(0, 0, 0)]  # pattern, syndrome, next bit
    for _ in range(5):
        for pattern, syndrome, _ in level:
            found[syndrome].append(pattern)
        level = [(p | 1 << b, s ^ single[b], b + 1) for p, s, at in level for b in range(at, 23)]
    most = max(map(len, found))
    patterns = np.array([x + [0] * (most - len(x)) for x in found], dtype=np.int64)
    return upper, patterns, np.array([len(x) for x in found])


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: the indices of all codewords within four bits, and which of the columns count."""
    upper, patterns, number = _code()
    syndrome = upper[words >> 11] ^ (words & 0x7FF)
    near = patterns[syndrome]
    return (words[:, None] ^ near) >> 11, np.arange(near.shape[1]) < number[syndrome][:, None]


def fingerprint_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All join keys of unsigned fingerprints: positions in `prints`, and keys."""
    parts = [segment_keys(((prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)) for low, bits in SEGMENTS]
    at, keys = [], []
    for kind, (x, y) in enumerate(SEGMENT_PAIRS):
        (kx, okx), (ky, oky) = parts[x], parts[y]
        i, p, q = np.nonzero(okx[:, :, None] & oky[:, None, :])
        at.append(i)
        keys.append(kind << 24 | kx[i, p] << 12 | ky[i, q])
    return np.concatenate(at), np.concatenate(keys)


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of one UTF-8 text, unsigned: A-Z in lower case, words between ASCII white space, XXH64
    (seed 42) of four-word shingles with repeats, bit set if it is in more than half of the hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
    hashed = xxhash.xxh64_intdigest
    hashes = np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print): a signed 64-bit fingerprint for every row.  Null and empty texts get zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(x.as_py()) for x in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["id", "print"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, print long")


def _forest(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of at most MAX_BITS between rows with equal keys (rows sorted by key): a star for each group of
    rows that such links join within a run of one key."""
    label = np.arange(len(keys))
    at, waiting, number = np.arange(len(keys)), [], 0
    for step in range(1, len(keys)):
        at = at[at < len(keys) - step]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        near = at[(label[at] != label[at + step]) & (np.bitwise_count(prints[at] ^ prints[at + step]) <= MAX_BITS)]
        waiting.append((near, near + step))
        number += len(near)
        if number > 200_000:
            label = joined_labels(label, *map(np.concatenate, zip(*waiting, strict=True)))
            waiting, number = [], 0
    if number:
        label = joined_labels(label, *map(np.concatenate, zip(*waiting, strict=True)))
    linked = np.nonzero(label != np.arange(len(keys)))[0]
    return prints[linked], prints[label[linked]]


def _linker(hot: int | None):
    """Works through (key, print) sorted by key; returns links (key null), and unchanged the rows of keys that
    have more than `hot` rows."""

    def batch(key: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([none if key is None else pa.array(key), pa.array(a.view(np.int64)), none if b is None else pa.array(b.view(np.int64))], names=["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints, passing = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for item in _and_end(batches):
            if item is None:
                done = len(keys)
            else:
                keys = np.concatenate([keys, item.column(0).to_numpy()])
                prints = np.concatenate([prints, item.column(1).to_numpy().view(np.uint64)])
                if not len(keys):
                    continue
                done = int(np.searchsorted(keys, keys[-1], "left"))
                if hot is not None and len(keys) - done > hot:  # the last key goes on and is hot already
                    passing, done = keys[-1], len(keys)
            now, rest = (keys[:done], prints[:done]), (keys[done:], prints[done:])
            if len(now[0]):
                if hot is not None:
                    values, first, sizes = np.unique(now[0], return_index=True, return_counts=True)
                    big = (sizes > hot) | (values == passing if passing is not None else False)
                    if big.any():
                        away = np.repeat(big, sizes)
                        yield batch(now[0][away], now[1][away], None)
                        now = (now[0][~away], now[1][~away])
                a, b = _forest(*now)
                if len(a):
                    yield batch(None, a, b)
            keys, prints = rest

    return run


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key")


def links(prints: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """Links (a, b) whose transitive closure is that of all pairs of distinct `print` at MAX_BITS or fewer."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(values), 1000):
                at, keys = fingerprint_keys(values[k : k + 1000])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[k + at].view(np.int64))], names=["key", "print"])

    schema = "key long, a long, b long"
    # A print makes up to 108 key rows, so that even a small table has to be dealt out.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = prints.select("print").repartition(parts, "print")
    found = saved(_by_key(dealt.mapInArrow(keyed, "key long, print long")).mapInArrow(_linker(hot_key), schema), "links")
    hot = found.where("key IS NOT NULL").select("key", F.col("a").alias("print"))
    sizes = saved(hot.groupBy("key").agg(F.ceil(F.count("*") / (hot_key // 2)).cast("int").alias("blocks")), "hot")
    if sizes.isEmpty():
        return found.select("a", "b")
    # Every block of a hot key meets every other one in a task of its own.
    spread = hot.join(sizes, "key").withColumn("own", F.expr("CAST(pmod(xxhash64(print), blocks) AS INT)"))
    spread = spread.select("key", "own", "print", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    spread = spread.select(F.expr("xxhash64(key, least(own, other), greatest(own, other))").alias("key"), "print")
    more = _by_key(spread).mapInArrow(_linker(None), schema)
    return found.where("key IS NULL").select("a", "b").unionAll(more.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_key: int = HOT_KEY) -> DataFrame:
    """Groups of near-duplicate documents.

    One row for every row of `docs`: the id, fingerprint (16 hex digits), component_id (the smallest id that
    links of MAX_BITS or fewer bits reach, the document's own included).  Null and empty texts, and texts of
    white space, have fingerprint zero and are linked like any other.  Repeated ids are rows of their own;
    a null id never becomes a component_id unless nothing else is reachable.  Other columns are ignored.
    """
    signed = saved(fingerprints(docs, id_col, text_col), "prints")
    classes = saved(signed.groupBy("print").agg(F.min("id").alias("first")), "classes")
    roots = saved(components(links(classes, hot_key)), "roots")
    linked = roots.selectExpr("u AS print", "v AS root").unionAll(roots.selectExpr("v AS print", "v AS root").distinct())
    lowest = saved(linked.join(classes, "print").groupBy("root").agg(F.min("first").alias("low")), "lowest")
    moved = saved(linked.join(lowest, "root").select("print", "low"), "moved")
    placed = saved(classes.join(moved, "print", "left").select("print", F.coalesce("low", "first").alias("component_id")), "placed")
    return signed.join(placed, "print").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each group the one with the smallest id stays, with all columns.

    Rows that repeat that id stay with it, and so do all rows with a null id, which nothing can tell apart.
    """
    kept = near_duplicates(docs, id_col, text_col).where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    return docs.join(kept, id_col, "left_semi").unionAll(docs.where(F.col(id_col).isNull()))
