"""Connected components by repeated joins; no edge list is ever collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, materialize, spread_join, tidily

#: Edges that a task turns into a forest at a time.
EDGES = 250_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the edges, and for each the least id that these edges connect it with."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(x):
        # each root is tied to its least neighbour, then all to their new roots
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while ((above := root[root]) != root).any():
            root = above
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return ids, ids[root]


def forests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From edges a, b: each EDGES of them, or more by a batch at most, as a forest of them: id (a), root (b)."""
    held: list[pd.DataFrame] = []

    def told() -> pd.DataFrame:
        return pd.DataFrame(dict(zip("ab", forest(*(np.concatenate([x[k].to_numpy(np.int64) for x in held]) for k in "ab")), strict=True)))

    for part in parts:
        held.append(part)
        if sum(map(len, held)) > EDGES:
            yield told()
            held = []
    if held:
        yield told()


def components(edges: DataFrame) -> DataFrame:
    """edges: long columns a, b. Returns id, root: for every id in an edge the least id that it is connected with.

    Up to EDGES edges are one forest. More become a forest each EDGES; then the large and the small star alternate: each
    node's larger (then smaller) neighbours are tied to the least id among its neighbours and itself, until nothing
    changes. Loops and repeated edges are fine, nulls are left out; without edges there are no rows. The edges of one node
    may be many: they do not meet in one task.
    """
    c = F.col
    given = materialize(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "given")
    whole = given.count() <= EDGES
    trees = (given.coalesce(1) if whole else given).mapInPandas(tidily(forests), "a long, b long")
    now = materialize(trees if whole else trees.distinct(), "edges")
    drop_tables(given)
    if whole:
        return now.select(c("a").alias("id"), c("b").alias("root"))
    while True:
        n = 2 * now.count()
        both = now.where("a <> b").select(c("a").alias("u"), c("b").alias("v")).unionByName(now.where("a <> b").select(c("b").alias("u"), c("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, least, ["u"], n).where("v > u").select(c("v").alias("a"), c("m").alias("b")).unionByName(now.where("a = b")).distinct()
        large = materialize(large, "stars")
        # the small star: of (a, b) with b <= a, tie a and all its b to the least b
        lowest = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        tied = spread_join(large, lowest, ["a"], n).select(c("b").alias("a"), c("m").alias("b"))
        small = tied.unionByName(lowest.select("a", c("m").alias("b"))).where("a <> b").unionByName(large.where("a = b")).distinct()
        after = materialize(small, "edges")
        # done when every node has one edge and no root is below another
        settled = after.where("a <> b").groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and after.where("a <> b").select("b").join(after.where("a <> b").select(c("a").alias("b")), "b", "left_semi").isEmpty()
        drop_tables(now, large)
        now = after
        if settled:
            break
    tied = now.where("a <> b")
    return tied.select(c("a").alias("id"), c("b").alias("root")).unionByName(tied.select(c("b").alias("id"), c("b").alias("root")).distinct())
