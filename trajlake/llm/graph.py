"""Connected components of links between 64-bit nodes, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import discard, not_broadcast, stored, trimmed

# A hub's neighbours are spread over this many keys where its smallest neighbour is joined back.
SALTS = 16


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _star(pairs: DataFrame, links: int) -> DataFrame:
    """(u, v) pairs with the smallest of u and all its v as ``m``; u and v are the ends of so many links."""
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    least = (pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    return not_broadcast(pairs.withColumn("salt", salt), 2 * links * SALTS).join(least, ["u", "salt"]).select("u", "v", "m")


def thinned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the smallest it reaches over the given links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[tied], nodes[label[tied]]


# Links that a task thins out at a time.
THIN_ROWS = 1 << 20


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of a task, a bounded number at a time, by links to the smallest node reached within them."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def done() -> pa.RecordBatch:
        a, b = thinned(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x[0]) for x in held) >= THIN_ROWS:
            yield done()
            held = []
    if held:
        yield done()


def _is_stars(edges: DataFrame, links: int) -> bool:
    """Whether every node links to one node, which links to none."""
    nodes = edges.agg(F.countDistinct("a")).first()[0]
    heads = not_broadcast(edges.select("b").distinct(), links)
    return links == nodes and not heads.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()


def components(edges: DataFrame, name: str = "components", thin: bool = True) -> DataFrame:
    """(node, label) of every node that has a link to another: label is the smallest node it reaches.

    Links are first thinned out within each task, unless ``thin`` is false: where a Python task makes them, it
    calls ``forest`` itself, as a second Python step in a task takes a second worker beside it. Each round links every node to the smallest node next
    to it, from both sides, and thins out again; written per round, the links end as stars. Nulls link
    nothing.
    """
    edges = edges.select("a", "b").dropna()
    current = stored(_directed(edges.mapInArrow(trimmed(forest), "a long, b long") if thin else edges), name)
    while not _is_stars(current, links := current.count()):
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, links).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct().select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _star(down, links)
        turned = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = stored(_directed(turned.filter("a <> b").mapInArrow(trimmed(forest), "a long, b long")), name)
        discard(current)
        current = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
