"""Graph operators by joins: reach, distance, components, coupling, propagation.

Edges are ``src``, ``dst``.  Loops write each round to the shared checkpoint folder, so that
lineage stays short and a lost executor costs one round; only counts come to the driver."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def saved(df: DataFrame) -> DataFrame:
    """Written to the folder that the session names for checkpoints, and read back."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:  # a session on one machine, as in tests
        folder = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _empty(df: DataFrame) -> bool:
    return not df.take(1)


def distances(edges: DataFrame, sources: DataFrame, most: int = 1000) -> DataFrame:
    """Least number of hops from any of ``sources`` (node): ``node``, ``distance``; sources have 0."""
    edges = saved(edges.select("src", "dst").distinct())
    seen = saved(sources.select("node").distinct().withColumn("distance", F.lit(0)))
    front = seen
    for hop in range(1, most + 1):
        found = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("distance", F.lit(hop))
        front = saved(found)
        if _empty(front):
            break
        seen = saved(seen.unionByName(front))
    return seen


def impact(edges: DataFrame, changed: DataFrame, most: int = 1000) -> DataFrame:
    """Nodes that reach a changed one, with their distance; the changed ones are left out."""
    return distances(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), changed, most).where("distance > 0")


def reach(edges: DataFrame, depth: int) -> DataFrame:
    """Distinct pairs of a node and another that it reaches in up to ``depth`` hops: ``src``, ``dst``."""
    step = saved(edges.select("src", "dst").where("src <> dst").distinct())
    pairs = front = step
    for _ in range(depth - 1):
        found = front.select("src", F.col("dst").alias("via")).join(step.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").where("src <> dst").distinct()
        front = saved(found.join(pairs, ["src", "dst"], "left_anti"))
        if _empty(front):
            break
        pairs = saved(pairs.unionByName(front))
    return pairs


def strong_components(edges: DataFrame, most: int = 1000) -> DataFrame:
    """Smallest node of each node's strongly connected component: ``node``, ``component``.

    In each round, the smallest label that reaches a node forwards is its color; the nodes of a
    color that the color's own node is reached from, backwards within the color, are a
    component.  They are taken off, and the rest goes on."""
    edges = saved(edges.select("src", "dst").where("src <> dst").distinct())
    nodes = saved(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    done = None
    for _ in range(most):
        color = _spread(nodes.withColumn("label", F.col("node")), edges, most)
        inside = edges.join(color.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(color.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        back = saved(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = color.where("node = label").select("node")
        found = distances(back, roots, most).select("node").join(color, "node").select("node", F.col("label").alias("component"))
        done = saved(found if done is None else done.unionByName(found))
        nodes = saved(nodes.join(done, "node", "left_anti"))
        if _empty(nodes):
            return done
        edges = saved(edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    raise RuntimeError("components did not settle")


def _spread(labels: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The smallest label that reaches each node along the edges."""
    labels = saved(labels)
    for _ in range(most):
        offers = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("offer"))
        after = saved(labels.join(offers, "node", "left").select("node", F.least("label", F.coalesce("offer", "label")).alias("label"), (F.col("offer") < F.col("label")).alias("moved")))
        labels = after.select("node", "label")
        if _empty(after.where("moved")):
            return labels
    raise RuntimeError("labels did not settle")


def cycles(edges: DataFrame) -> DataFrame:
    """Components of two nodes or more: ``component``, ``size``."""
    return strong_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")


def coupling(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node``, afferent and efferent counts of distinct neighbours, and instability; null of an isolated node."""
    step = edges.select("src", "dst").where("src <> dst").distinct()
    both = step.select(F.col("dst").alias("node"), F.lit(1).alias("a"), F.lit(0).alias("e")).unionByName(step.select(F.col("src").alias("node"), F.lit(0).alias("a"), F.lit(1).alias("e")))
    if nodes is not None:
        both = both.unionByName(nodes.select("node", F.lit(0).alias("a"), F.lit(0).alias("e")))
    sums = both.groupBy("node").agg(F.sum("a").alias("afferent"), F.sum("e").alias("efferent"))
    return sums.withColumn("instability", F.try_divide(F.col("efferent").cast("double"), (F.col("afferent") + F.col("efferent")).cast("double")))


def less_stable(edges: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Edges that point to a less stable node."""
    of = coupling(edges)
    at = lambda side: of.select(F.col("node").alias(side), F.col("instability").alias(f"{side}_instability"))
    rows = edges.select("src", "dst").where("src <> dst").distinct().join(at("src"), "src").join(at("dst"), "dst")
    return rows.where(F.col("dst_instability") > F.col("src_instability") + tolerance)


def packages(edges: DataFrame, package: Column, target: Column) -> DataFrame:
    """Module edges folded into package edges, without those inside one package."""
    return edges.select(package.alias("src"), target.alias("dst")).where("src <> dst").distinct()


def propagation_cost(edges: DataFrame, depth: int = 1000) -> float:
    """Mean share of all nodes that a node reaches, itself included."""
    step = edges.select("src", "dst")
    n = step.select(F.col("src").alias("n")).unionByName(step.select(F.col("dst").alias("n"))).distinct().count()
    return (reach(edges, depth).count() + n) / (n * n) if n else 0.0


def simulated(edges: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Edges after a proposed change."""
    out = edges.select("src", "dst")
    if removed is not None:
        out = out.join(removed.select("src", "dst"), ["src", "dst"], "left_anti")
    if added is not None:
        out = out.unionByName(added.select("src", "dst"))
    return out.distinct()


def ordered(edges: list[tuple[str, str]], components: dict[str, str]) -> list[str]:
    """Matrix order of a collected module graph: condensed, dependencies first, ties by name.

    For diagrams, whose size a reader bounds; use ``coupling`` for large graphs."""
    import heapq

    group = lambda n: components.get(n, n)
    nodes = sorted({n for e in edges for n in e} | set(components))
    after: dict[str, set[str]] = {group(n): set() for n in nodes}
    waits = dict.fromkeys(after, 0)
    for src, dst in edges:
        a, b = group(src), group(dst)
        if a != b and a not in after[b]:
            after[b].add(a)
            waits[a] += 1
    ready = [g for g, n in waits.items() if not n]
    heapq.heapify(ready)
    out: list[str] = []
    while ready:
        g = heapq.heappop(ready)
        out += [n for n in nodes if group(n) == g]
        for other in sorted(after[g]):
            waits[other] -= 1
            if not waits[other]:
                heapq.heappush(ready, other)
    return out
