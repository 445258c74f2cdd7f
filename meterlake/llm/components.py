"""Connected components of an edge table, by contraction.

In each round every node moves to the neighbour of least hash, itself included, and the edges between places that are
left make the next, smaller graph: a star of any size is one place after two rounds, a chain of n nodes after some log n.
Edges and moves of a round are written to the shared folder, so lineage stays short and lost executors cost one round at
most. A node's least neighbour is summed before it moves, and the joins are between written tables, of which Spark splits
the side of a hot node.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.session import discard, written


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    """Edges with the larger end first, each once, none to itself."""
    return df.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def _rank(c: str) -> Column:
    return F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("node"))


def components(edges: DataFrame) -> DataFrame:
    """id and component (smallest id reachable) of every node of the edges a, b that is not alone."""
    edges = written(_ordered(edges, "a", "b"), "edges")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min(_rank("b")).alias("least"))
        moves.append(written(least.select(F.col("a").alias("id"), F.least("least", _rank("a"))["node"].alias("at")), "moves"))
        ends = edges.join(moves[-1].toDF("a", "x"), "a").join(moves[-1].toDF("b", "y"), "b")
        after = written(_ordered(ends, "x", "y"), "edges")
        discard(edges)
        edges = after
    discard(edges)
    if not moves:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    # Where a node ends: its move, then what became of that place.
    places = moves[-1]
    for step in reversed(moves[:-1]):
        places = step.toDF("id", "via").join(places.toDF("via", "end"), "via", "left").select("id", F.coalesce("end", "via").alias("at"))
    if len(moves) > 1:
        places = written(places, "places")
        for step in moves:
            discard(step)
    names = written(places.groupBy("at").agg(F.min("id").alias("component")), "names")
    return places.join(names, "at").select("id", "component")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the edges that connect what all of them connect: every node to the root of its group."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]
