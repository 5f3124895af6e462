"""Connected components of a graph of links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of each node in ``links(a, b)``: columns ``node``, ``root``.

    Each round, the smaller of two neighbours' roots goes to the other end and to its
    root, then each node jumps to its root's root.  This takes about as many rounds as the
    logarithm of the longest path.  A round is written to the shared folder, so that
    lineage stays short; only the count of changes comes to the driver.  Nodes without a
    link have no row; an empty table gives an empty one."""
    both = written(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "links",
    )
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "roots")
    for _ in range(rounds):
        at_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        at_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        met = both.join(at_a, "a").join(at_b, "b").where("root_a < root_b")
        offers = met.select(F.explode(F.array("b", "root_b")).alias("node"), F.col("root_a").alias("root"))
        hooked = written(roots.unionByName(offers).groupBy("node").agg(F.min("root").alias("root")), "hooked")
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        before = roots.select("node", F.col("root").alias("old"))
        after = written(
            hooked.join(jump, "root").select("node", F.col("next").alias("root")).join(before, "node").select("node", "root", (F.col("root") != F.col("old")).alias("moved")),
            "roots",
        )
        roots = after.select("node", "root")
        if after.where("moved").limit(1).count() == 0:
            return roots
    raise RuntimeError("the links didn't settle; raise the number of rounds")
