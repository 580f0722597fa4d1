"""Connected components of large graphs by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.plans.lineage import cut


def connected_components(edges: DataFrame, jumps: int = 2, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint); component is the smallest node of its component.

    Nodes are ranked by a hash that is different for different numbers (xxhash64 of one bigint), so that neighbours in
    a long chain are ranked at random and no run of falling ranks is long, in whatever order the nodes are numbered.
    Each round every node points to its lowest neighbour if that is lower, pointers jump over pointers, and the graph
    is contracted to the nodes pointed to; more than half of the nodes that still have edges are expected to vanish
    per round, so the rounds grow with the logarithm of the number of nodes.
    Hot nodes are no problem: the minimum is aggregated before the shuffle and no neighbour lists are built.
    Nodes without edges do not appear; null ends are ignored.
    """
    sound = edges.filter("a is not null and b is not null and a <> b").select(F.col("a").cast("bigint").alias("na"), F.col("b").cast("bigint").alias("nb"), F.xxhash64(F.col("a").cast("bigint")).alias("ra"), F.xxhash64(F.col("b").cast("bigint")).alias("rb"))
    sound = cut(sound.distinct())
    graph = sound.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct()
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        # higher ends hook to the lowest lower neighbour
        hook = graph.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        for _ in range(jumps):
            nxt = hook.select(F.col("node").alias("to"), F.col("to").alias("far"))
            hook = hook.join(nxt, "to", "left").select("node", F.coalesce("far", "to").alias("to"))
        hook = cut(hook)
        if hook.isEmpty():
            break
        maps.append(hook)
        ends = (
            graph.join(hook.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a", "left")
            .join(hook.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b", "left")
            .select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"))
        )
        graph = cut(ends.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        if graph.isEmpty():
            break
    else:
        raise RuntimeError("components did not converge")
    if not maps:
        return edges.select(F.col("a").cast("bigint").alias("node"), F.col("b").cast("bigint").alias("component")).limit(0)
    label = maps[0]
    for step in maps[1:]:
        nxt = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
        late = step.join(label.select("node"), "node", "left_anti")  # pointed to so far, pointing on only now
        label = label.join(nxt, "to", "left").select("node", F.coalesce("far", "to").alias("to")).unionByName(late)
    # back to the numbers of the nodes; each component is named by its smallest one
    nodes = sound.select(F.col("na").alias("n"), F.col("ra").alias("node")).unionByName(sound.select(F.col("nb").alias("n"), F.col("rb").alias("node"))).distinct()
    placed = cut(nodes.join(label, "node", "left").select("n", F.coalesce("to", "node").alias("root")))
    least = placed.groupBy("root").agg(F.min("n").alias("component"))
    return cut(placed.join(least, "root").select(F.col("n").alias("node"), "component"))
