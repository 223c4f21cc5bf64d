"""Connected components of a graph held as a table of edges: alternating large-star and small-star rounds.

Every round hooks each node's neighbours to the smallest node around; the edges shrink to one star a component in a
few rounds. Each round is written to the shared folder, so lineage stays short and a lost executor repeats little.
Nothing but two numbers of a round (edge count and checksum) comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import drop_shared, write_shared


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the smallest node of the component.

    Null ends and loops are left out. The result is a table in the shared folder."""
    spark = edges.sparkSession
    now, path = write_shared(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                             .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        new, new_path = write_shared(_small_star(_large_star(now)), "edges")
        digest = _digest(new)
        drop_shared(spark, path)
        now, path = new, new_path
        if digest == seen:
            break
        seen = digest
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
