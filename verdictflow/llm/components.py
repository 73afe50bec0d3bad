"""Connected components of an undirected graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictflow.llm.common import materialize, release

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v of one orderable type); root is the smallest node of its component.

    Alternating large-star and small-star rounds: each is one aggregation and one join of slim rows, the number of edges never grows
    and the rounds are logarithmic in the longest path. Every round is written to the shared folder; only counts reach the driver.
    Nulls and loops are left out; repeated edges count once; without edges the result is empty."""
    links = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = materialize(links, "links")
    state = None
    for _ in range(MAX_ROUNDS):
        # Large star: every node links its larger neighbours to the smallest node it sees.
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every node links its smaller neighbours, and itself, to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        release(links)
        links = after
        # The links are distinct, so their number and the exclusive or of their hashes stand for the set.
        last, state = state, links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == last:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
