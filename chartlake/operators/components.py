"""Connected components of a graph of any size, and chains of renamings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.runtime import materialize, never_broadcast


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, src: str, dst: str, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node that has an edge; the component is
    its least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each of
    which takes the least neighbour by a partial aggregation and joins it back,
    so that no neighbourhood is gathered in one task. The edges of each round
    are a written table; only their count and a checksum reach the driver.

    Edges with a null end, loops and repeated edges count as none. An empty
    table gives no rows. Raises if ``most_rounds`` do not suffice.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    state = _state(e)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(least.select("u", F.col("m").alias("v")))
        e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        e = materialize(e, "edges")
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    label = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def resolve_chains(moves: DataFrame, old: str, new: str, most_rounds: int = 60) -> DataFrame:
    """``(old, new)`` with every chain of renamings followed to its end, by
    pointer jumping: each round doubles the length that is followed.

    A key that is renamed twice takes its least target; nulls and moves to
    itself are none. A cycle is cut at its least key, which keeps its name.
    """
    m = moves.select(F.col(old).alias("a"), F.col(new).alias("b")).where("a <> b").groupBy("a").agg(F.min("b").alias("b"))
    m = materialize(m, "moves")
    for _ in range(most_rounds):
        nxt = m.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jumped = m.join(never_broadcast(nxt), "b", "left").select("a", F.coalesce("c", "b").alias("to"), (F.col("c").isNotNull() & (F.col("c") != F.col("b"))).alias("far"))
        jumped = materialize(jumped, "moves")
        far, cyclic = jumped.agg(F.count_if(F.col("far") & (F.col("a") != F.col("to"))), F.count_if(F.col("a") == F.col("to"))).first()
        if cyclic:
            break
        m = jumped.select("a", F.col("to").alias("b"))
        if not far:
            return m.select(F.col("a").alias(old), F.col("b").alias(new))
    # Cycles: components, whose least key keeps its name.
    c = connected_components(moves, old, new)
    return c.where("node <> component").select(F.col("node").alias(old), F.col("component").alias(new))
