"""Connected components with joins, by alternating stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _canonical(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, from its larger end ``u`` to its smaller end ``v``."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60, keep: Callable[..., DataFrame] = stored) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``links`` (src, dst longs).

    Large stars and small stars alternate (Kiveris et al., 2014): every round links neighbours of a node
    to the smallest of them, which leaves the components as they are, until each is one star. A round
    is aggregations and joins by node; a hot node's rows are split by adaptive skew joins. Each
    round is written to the shared folder by ``keep``, and only a count and a sum go to the driver.
    """
    edges = keep(_canonical(links.select(F.col("src").alias("u"), F.col("dst").alias("v"))))
    state = None
    for _ in range(max_rounds):
        seen = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state or not seen[0]:
            break
        state = seen
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = _canonical(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        edges = keep(_canonical(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))))
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
