"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors at cosine c are at distance sqrt(2 - 2 c).  The vectors are projected on their leading principal
directions, which never lengthens a distance, and sorted by the grid cells (as wide as the greatest distance
of a link) that the projections fall in.  The sequence is joined with itself by recursion: two intervals of it
are parted further only if the boxes around their projections are near enough.  The upper levels of the
recursion, down to blocks, are joins of a table of interval pairs with the table of boxes.  For two blocks that are
near, the boxes of their leaves are compared next, and only leaves that have a near one on the other side are sent to
the task that compares the two blocks, each once; the lowest levels are done there.

The principal directions are fitted on a bounded sample (`fit_rows`): they decide how much is skipped, never
what is found.  Cosines are computed in double precision, for all pairs that are not skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import components, joined_labels, saved

COSINE = 0.95
FIT_ROWS = 20_000
LEADING = 8
#: Vectors in a block, of which a task holds two; in a leaf; and in the intervals that are compared outright.
BLOCK = 16384
LEAF = 256
OUTRIGHT = 512
#: An interval has at most so many (a power of two) below it.
FAN_BITS = 4
#: Boxes this much further apart than a link may be are distant in spite of rounding.
SLACK = 1e-6

BOX = "lo array<double>, hi array<double>"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def directions(vectors: DataFrame, fit_rows: int) -> dict[int, np.ndarray]:
    """For each length of vectors in a sample of about `fit_rows`: the leading principal directions, as columns.
    The driver gets a few matrices of inner products, never vectors."""
    share, most = min(1.0, fit_rows / max(1, vectors.count())), 1 << 60
    sample = vectors.where(F.pmod(F.xxhash64("v"), F.lit(most)) < int(share * most)).select("v").limit(2 * fit_rows).repartition(4)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            sizes = np.asarray(b.column(0).value_lengths())
            for size in np.unique(sizes).tolist():
                x = unit(_matrix(b.column(0).filter(pa.array(sizes == size))).astype(np.float64))
                sums[size] = sums.get(size, 0) + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["size", "sums"])

    total: dict[int, np.ndarray] = {}
    for size, sums in sample.mapInArrow(products, "size int, sums binary").collect():
        total[size] = total.get(size, 0) + np.frombuffer(sums).reshape(size, size)
    return {size: np.linalg.eigh(m)[1][:, ::-1][:, :LEADING] for size, m in total.items()}


def grid_ordered(classes: DataFrame, width: float, leading: dict[int, np.ndarray], leaf: int) -> DataFrame:
    """Leaves of the sorted sequence: part, number, begin (vectors before it in the part), count, size (of a vector),
    nodes, copies, vectors (as bytes), box."""

    def project(x: np.ndarray) -> np.ndarray:
        size = x.shape[1]
        known = leading.get(size, np.eye(size)[:, :LEADING])
        return np.pad(unit(x) @ known, ((0, 0), (0, LEADING - known.shape[1])))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(b.column(2).value_lengths())
            for size in np.unique(sizes):
                own = b.filter(pa.array(sizes == size))
                at = np.floor(project(_matrix(own.column(2))) / width).astype(np.int32)
                cell = pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), LEADING).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(own), size, np.int32)), cell], names=["node", "copies", "v", "size", "cell"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, begin = TaskContext.get().partitionId(), 0, 0
        waiting: pa.Table | None = None

        def made(t: pa.Table) -> pa.RecordBatch:
            x = _matrix(t["v"].combine_chunks())
            p = project(x)
            columns = {
                "part": part, "number": number, "begin": begin, "count": len(t), "size": x.shape[1], "nodes": t["node"].to_numpy().tobytes(), "copies": t["copies"].to_numpy().tobytes(),
                "vectors": np.ascontiguousarray(x).tobytes(), "lo": p.min(0).tolist(), "hi": p.max(0).tolist(),
            }
            return pa.RecordBatch.from_pylist([columns], schema=kinds)

        for b in batches:
            waiting = pa.Table.from_batches([b]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([b])])
            while len(waiting):
                sizes = waiting["size"].to_numpy()
                own = min(int(np.searchsorted(sizes, sizes[0], "right")), leaf)
                if own == len(waiting) and own < leaf:
                    break
                yield made(waiting.slice(0, own))
                number, begin = number + 1, begin + own
                waiting = waiting.slice(own)
        if waiting is not None and len(waiting):
            yield made(waiting)

    kinds = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("begin", pa.int64()), ("count", pa.int64()), ("size", pa.int32()), ("nodes", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])
    kind = classes.schema["v"].dataType.simpleString()
    placed = classes.select("node", "copies", "v").mapInArrow(cells, f"node long, copies long, v {kind}, size int, cell array<int>")
    ordered = placed.orderBy("size", "cell", "node")
    return ordered.mapInArrow(blocks, f"part long, number long, begin long, count long, size int, nodes binary, copies binary, vectors binary, {BOX}")


def near_intervals(boxes: DataFrame, reach: float) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks whose boxes are within reach: from the whole sequence down, level by level."""
    bits = max(1, int(boxes.agg(F.max("block")).first()[0] or 0).bit_length())
    pairs = boxes.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).limit(1)
    near = F.expr(
        "aggregate(zip_with(zip_with(a_lo, b_hi, (x, y) -> x - y), zip_with(b_lo, a_hi, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D)),"
        f" 0D, (s, x) -> s + x * x) <= {reach**2!r}D"
    )
    for low in range((bits - 1) // FAN_BITS * FAN_BITS, -1, -FAN_BITS):
        level = boxes.groupBy(F.shiftright("block", low).alias("at"), "size").agg(
            *[F.min(F.col("lo")[k]).alias(f"lo{k}") for k in range(LEADING)], *[F.max(F.col("hi")[k]).alias(f"hi{k}") for k in range(LEADING)]
        )
        level = level.select("at", "size", *(F.array(*[f"{x}{k}" for k in range(LEADING)]).alias(x) for x in ("lo", "hi")))
        level = saved(level, "level")
        one = level.select(F.col("at").alias("a_at"), F.col("size").alias("a_size"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
        two = level.select(F.col("at").alias("b_at"), F.col("size").alias("b_size"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
        down = pairs.join(one, F.shiftright("a_at", FAN_BITS) == F.col("a")).join(two, (F.shiftright("b_at", FAN_BITS) == F.col("b")) & (F.col("a_at") <= F.col("b_at")) & (F.col("a_size") == F.col("b_size")) & near)
        pairs = saved(down.select(F.col("a_at").alias("a"), F.col("b_at").alias("b")).distinct(), "pairs")
    return pairs


def compare(x: np.ndarray, y: np.ndarray | None, p: np.ndarray, q: np.ndarray, weights: tuple[np.ndarray, np.ndarray], cosine: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins two intervals (y None: one with itself) of unit vectors with projections p and q.

    Returns for the rows of each the weight of their links, and labels of all rows (those of y after those of
    x) whose equal values mean that links connect them.
    """
    same, n = y is None, len(x)
    y = x if same else y
    degree = (np.zeros(n), np.zeros(len(y)))
    label = np.arange(n if same else n + len(y))

    def visit(a: int, b: int, c: int, d: int) -> None:
        nonlocal label
        if same and c < a:
            return
        gap = np.maximum(0, np.maximum(p[a:b].min(0) - q[c:d].max(0), q[c:d].min(0) - p[a:b].max(0)))
        if (gap * gap).sum() > reach * reach:
            return
        if b - a > OUTRIGHT or d - c > OUTRIGHT:
            ab = [(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > OUTRIGHT else [(a, b)]
            cd = [(c, (c + d) // 2), ((c + d) // 2, d)] if d - c > OUTRIGHT else [(c, d)]
            for s in ab:
                for t in cd:
                    visit(*s, *t)
            return
        linked = x[a:b] @ y[c:d].T >= cosine
        if same and a == c:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        degree[0][a:b] += linked @ weights[1][c:d]
        if not (same and a == c):
            degree[0 if same else 1][c:d] += weights[0][a:b] @ linked
        rows = np.nonzero(linked.any(1))[0]
        firsts = linked[rows].argmax(1)
        columns = np.nonzero(linked.any(0))[0]
        tops = linked[:, columns].argmax(0)
        shift = 0 if same else n
        i = np.concatenate([rows + a, tops + a])
        j = np.concatenate([firsts + c + shift, columns + c + shift])
        label = joined_labels(label, i, j)
        # Rows and columns that stars around first partners leave apart are joined by the links between them.
        apart = linked & (label[a:b][:, None] != label[c + shift : d + shift][None])
        if apart.any():
            i, j = np.nonzero(apart)
            label = joined_labels(label, i + a, j + c + shift)

    visit(0, n, 0, len(y))
    return degree[0], degree[1], label


def numbered(leaves: DataFrame, block: int) -> DataFrame:
    """`leaves` with their number in the whole sequence, and that of their block: runs of about `block` vectors."""
    parts = leaves.groupBy("part").agg(F.sum("count").alias("vectors"), F.count("*").alias("leaves"))  # a row for each partition of the sort
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("vectors", "leaves")])
    placed = leaves.join(F.broadcast(parts), "part")
    return placed.withColumns({"leaf": F.col("leaves_before") + F.col("number"), "block": F.floor((F.col("vectors_before") + F.col("begin")) / block).cast("long")})


def needed_leaves(pairs: DataFrame, leaves: DataFrame, reach: float) -> DataFrame:
    """For pairs (a, b) of blocks: (a, b, right, leaf) for the leaves of a, or (right) b, that a leaf of the other is near."""
    each = F.sort_array(F.collect_list(F.struct("leaf", "size", "lo", "hi")))
    boxes = leaves.groupBy("block").agg(each.alias("l")).select("block", *[F.expr(f"transform(l, x -> x.{c})").alias(c) for c in ("leaf", "size")], *[F.expr(f"flatten(transform(l, x -> x.{c}))").alias(c) for c in ("lo", "hi")])
    boxes = saved(boxes, "boxes")
    one, two = (boxes.select(F.col("block").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("leaf", "size", "lo", "hi")]) for s in "ab")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(len(batch)):
                r = {name: batch.column(name)[k] for name in batch.schema.names}
                a, b = r["a"].as_py(), r["b"].as_py()
                leaf, size = ([r[f"{s}_{c}"].values.to_numpy() for s in "ab"] for c in ("leaf", "size"))
                (a_lo, b_lo), (a_hi, b_hi) = ([r[f"{s}_{c}"].values.to_numpy().reshape(-1, LEADING) for s in "ab"] for c in ("lo", "hi"))
                gap = np.maximum(0, np.maximum(a_lo[:, None] - b_hi[None], b_lo[None] - a_hi[:, None]))
                near = ((gap * gap).sum(axis=2) <= reach * reach) & (size[0][:, None] == size[1][None])
                for right in range(1 if a == b else 2):
                    out.append((a, b, right, leaf[right][near.any(axis=1 - right)]))
            counts = [len(x[3]) for x in out]
            columns = [np.repeat(np.array([x[c] for x in out], np.int64), counts) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.concatenate([np.empty(0, np.int64), *(x[3] for x in out)]))], names=["a", "b", "right", "leaf"])

    return pairs.join(one, "a").join(two, "b").mapInArrow(needed, "a long, b long, right long, leaf long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, fit_rows: int = FIT_ROWS, block: int = BLOCK, leaf: int = LEAF
) -> DataFrame:
    """Links at `cosine` or more: one row for every row of `vectors`.

    Columns: the id, n_links (other rows linked directly), component_id (the smallest id that links reach, the
    row's own included), kept (whether that is the row's own).  Vectors that are null, empty or zero, or have a
    null or non-finite component, link with nothing, and vectors of different lengths don't link.  Equal vectors
    are compared once.  Repeated ids are rows of their own; a null id counts as no id.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    usable = F.coalesce(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0), F.lit(False))
    classes = rows.where(usable).groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    basis = directions(classes, fit_rows)
    leaves = saved(grid_ordered(classes, reach, basis, min(leaf, block)), "leaves")
    leaves = numbered(leaves, block)
    boxed = leaves.groupBy("block", "size").agg(*[f(F.col(c)[k]).alias(f"{c}{k}") for c, f in (("lo", F.min), ("hi", F.max)) for k in range(LEADING)])
    boxed = saved(boxed.select("block", "size", *(F.array(*[f"{c}{k}" for k in range(LEADING)]).alias(c) for c in ("lo", "hi"))), "blocks")
    needed = needed_leaves(near_intervals(boxed, reach), leaves.select("block", "leaf", "size", "lo", "hi"), reach)
    dtype = np.float32 if rows.schema["v"].dataType.elementType.simpleString() == "float" else np.float64

    def linked(key: tuple, table: pa.Table) -> pa.Table:
        same, found = key[0].as_py() == key[1].as_py(), []
        table = table.sort_by([("size", "ascending"), ("leaf", "ascending")])
        for size in np.unique(table["size"].to_numpy()).tolist():
            sides = []
            for right in range(1 if same else 2):
                own = table.filter((pc.field("size") == size) & (pc.field("right") == right))
                node, copies, flat = (np.frombuffer(b"".join(own[c].to_pylist()), kind) for c, kind in (("nodes", np.int64), ("copies", np.int64), ("vectors", dtype)))
                sides.append((node, copies.astype(np.float64), unit(flat.reshape(-1, size).astype(np.float64))))
            if min(len(side[0]) for side in sides) == 0:
                continue
            known = basis.get(size, np.eye(size)[:, :LEADING])
            (n, w, x), (m, v, y) = sides[0], sides[-1]
            left, right, label = compare(x, None if same else y, x @ known, y @ known, (w, v), cosine, reach)
            node, degree = (n, left) if same else (np.concatenate([n, m]), np.concatenate([left, right]))
            some = np.nonzero(degree)[0]
            found.append(pa.table([node[some], node[label[some]], degree[some].astype(np.int64)], names=["a", "b", "links"]))
        return pa.concat_tables([pa.table([pa.array([], pa.int64())] * 3, names=["a", "b", "links"]), *found])

    # A group holds the leaves of two blocks, at most.
    compared = needed.join(leaves.select("leaf", "size", "nodes", "copies", "vectors"), "leaf").groupBy("a", "b")
    found = saved(compared.applyInArrow(linked, "a long, b long, links long"), "found")
    degrees = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = saved(components(found.select("a", "b")), "roots")
    renamed = roots.select(F.col("u").alias("node"), F.col("v").alias("root"))
    placed = saved(classes.join(renamed, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    lowest = saved(placed.groupBy("root").agg(F.min("first").alias("low")), "lowest")
    known = placed.join(degrees, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    known = saved(known.select("v", "root", "links").join(lowest, "root").select("v", "links", "low"), "known")
    return rows.join(known, "v", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("low", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("low", "id")).alias("kept"),
    )
