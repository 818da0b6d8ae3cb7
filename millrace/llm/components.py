"""Connected components of a table of edges, by label passing with shortcuts.

All tables stay distributed; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that can be reached; only nodes with an edge.

    Each round joins every node to the smallest root next to it and then takes the root of that
    root, so paths shrink by half and rounds grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = materialize(spark, pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    # The smallest neighbour is a first root.
    roots = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root")).select(F.col("x").alias("node"), "root")
    roots = materialize(spark, roots, "roots")
    while True:
        seen = both.join(roots, both["y"] == roots["node"]).select(F.col("x").alias("node"), "root")
        # `old` comes along, so that a change is seen without another join.
        known = seen.withColumn("old", F.lit(None).cast(roots.schema["root"].dataType)).unionByName(roots.withColumn("old", F.col("root")))
        near = known.groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old"))
        up = roots.select(F.col("node").alias("via"), F.col("root").alias("higher"))
        step = near.join(up, near["root"] == up["via"], "left").select("node", F.least("root", F.coalesce("higher", "root")).alias("root"), "old")
        step = materialize(spark, step, "roots")
        moved = step.where("root <> old").limit(1).count()
        roots = step.drop("old")
        if not moved:
            return roots
