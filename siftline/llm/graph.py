"""Connected components of a link table on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.tables import stored


def _flat(hooks: DataFrame) -> DataFrame:
    """Follows ``node -> to`` to the end of each chain by doubling; every chain falls to a node that points at itself."""
    while True:
        further = hooks.select(F.col("node").alias("to"), F.col("to").alias("then"))
        hooks = stored(hooks.join(further, "to").select("node", F.col("then").alias("to"), (F.col("then") != F.col("to")).alias("moved")), "jump")
        if hooks.where("moved").isEmpty():
            return hooks.select("node", "to")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it is connected with, for every node of links (a, b).

    Each node hooks to its smallest neighbour, chains are flattened, and links
    are carried over to the ends of the chains until none is left between two
    of them.  Every round at least halves the nodes that still have links.
    """
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    found = None
    while True:
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        hooks = _flat(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("to")))
        if found is None:
            found = hooks
        else:
            later = hooks.select(F.col("node").alias("to"), F.col("to").alias("then"))
            found = found.join(later, "to", "left").select("node", F.coalesce("then", "to").alias("to"))
        of = lambda end: hooks.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}"))
        links = stored(
            links.join(of("a"), "a").join(of("b"), "b").where("to_a != to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(),
            "links",
        )
        if links.isEmpty():
            return found.select("node", F.col("to").alias("component"))
