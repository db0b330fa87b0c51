"""Connected components by contraction, in DataFrame operations only.

Each round maps every node to the neighbour (or itself) of the smallest hash and rewrites the
edges between the images. Hash order makes the expected number of nodes fall by a constant
factor a round, so chains of any length take a logarithmic number of rounds. Every round is cut
by a checkpoint in the shared folder; the driver only learns how many edges are left. Edges of a
hub, however many, stay where they are and the hub's image is sent to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, cut


#: Edges that one task joins at the end of an Arrow run.
FINISH = 10_000


def _forest(batches):
    """(a, b) of all edges left → (node, to) with to the smallest node of the component."""
    import pyarrow as pa

    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in up], kind)], ["node", "to"])


def _images(edges: DataFrame, to: DataFrame) -> DataFrame:
    """edges between the images of their ends. Nodes of more than a ten-thousandth of all edges, and of
    1000, are sent to their edges; the others meet them by a shuffle."""
    total, most = to.agg(F.sum("degree"), F.max("degree")).first()
    hub = F.col("degree") > max(1000, total // HEAVY)
    for k in "ab":
        image = to.select(F.col("node").alias(k), F.col("to").alias(f"p{k}"))
        if most <= max(1000, total // HEAVY):
            edges = edges.join(image, k)
            continue
        hubs = to.where(hub).select(F.col("node").alias(k), F.col("to").alias(f"p{k}"))
        rest = edges.join(F.broadcast(hubs.select(k)), k, "left_anti").join(image, k)
        edges = edges.join(F.broadcast(hubs), k).unionByName(rest)
    return edges.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()


def components(edges: DataFrame, finish: int = 0) -> DataFrame:
    """edges(src, dst) → (node, root): nodes have the same root if and only if they are connected.

    Nulls, self-links and repeated links are ignored; nodes without a link do not appear; no
    edges give an empty table. finish: so many edges or fewer are joined by one Arrow task.
    """
    kind = dict(edges.dtypes)["src"]
    now = cut(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("src is not null and dst is not null and src <> dst").distinct())
    steps = []
    while left := now.count():
        if left <= finish:
            steps.append(cut(now.repartition(1).mapInArrow(_forest, f"node {kind}, to {kind}")))
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))).alias("m"), F.count(F.lit(1)).alias("degree"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n"))
        to = cut(least.select(F.col("a").alias("node"), F.least(own, "m")["n"].alias("to"), "degree"))
        steps.append(to.select("node", "to"))
        now = cut(_images(now, to))
    if not steps:
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    out = steps[0].select("node", F.col("to").alias("root"))
    for to in steps[1:]:
        nxt = to.select(F.col("node").alias("root"), "to")
        out = out.join(nxt, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out
