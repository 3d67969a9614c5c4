"""Helpers that several training-data operators share: stored intermediates and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir; a local one only where that is unset and all
    executors are on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or os.path.join(tempfile.gettempdir(), "checkpoints")).rstrip("/")


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: this cuts the lineage, and what was
    written survives the loss of any executor."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like `name` that none of the frames has (names are the same whatever their case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name = f"_{name}"
    return name


def slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Texts without nulls in runs of about `size` bytes, at least one in each."""
    if not len(texts):
        return
    number = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // size
    starts = [0, *(np.nonzero(np.diff(number))[0] + 1).tolist(), len(texts)]
    for i, j in zip(starts, starts[1:], strict=False):
        yield texts.slice(i, j - i)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    `edges` has long columns a and b.  Returns (u, v): every node u that is not the smallest of its
    component, with v the smallest.  Alternating large-star and small-star rounds; only grouped minima and
    equi-joins, so no node's neighbours are ever gathered, and each round is stored before the next.  Both
    sides of every join are stored tables, so that adaptive execution can split the partition of a hub.
    Rows with a null end and loops count for nothing.
    """
    edges = saved(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    before = _digest(edges)
    while before[0]:
        both = edges.selectExpr("u AS x", "v AS y").unionAll(edges.selectExpr("v AS x", "u AS y"))
        lows = saved(both.groupBy("x").agg(F.min("y").alias("m")).selectExpr("x", "least(x, m) AS m"), "lows")
        upward = edges.selectExpr("v AS x", "u AS y")
        large = saved(
            upward.join(lows, "x").selectExpr("y AS u", "m AS v").distinct(),
            "large",
        )
        lows = saved(large.groupBy("u").agg(F.min("v").alias("m")), "lows")
        small = large.join(lows, "u").where("v <> m").selectExpr("v AS u", "m AS v").unionAll(lows.selectExpr("u", "m AS v"))
        edges = saved(small.distinct(), "small")
        after = _digest(edges)
        if after == before:
            break
        before = after
    return edges


def joined_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of positions (each the position of its group's root) after the groups of i[k] and j[k] are joined."""
    while True:
        low = np.minimum(label[i], label[j])
        if (label[i] == low).all() and (label[j] == low).all():
            return label
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while not np.array_equal(label, higher := label[label]):
            label = higher
