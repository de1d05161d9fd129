"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the smallest node that the edges ``a`` - ``b`` reach, for every node that has an edge.

    Each round links every node's larger neighbours, then its smaller ones, to
    the smallest of them, until nothing changes.  The smallest neighbour is a
    partial sum, so a hot node costs one row a task; the join back to the edges
    splits skewed nodes.  Every round's edges are written, and those before them deleted.
    """
    e = stage(edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), name)
    while True:
        both = e.selectExpr("u AS n", "v AS m").unionByName(e.selectExpr("v AS n", "u AS m"))
        low = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("low", "n").alias("low"))
        large = both.join(low, "n").where("m > n").selectExpr("m AS u", "low AS v").where("u <> v")
        large = stage(large, name)
        discard(e)
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").selectExpr("explode(array(struct(v AS u, low AS v), struct(u AS u, low AS v))) AS s").select("s.u", "s.v").where("u <> v").distinct()
        small = stage(small, name)
        discard(large)
        # done when the edges are stars: every larger end has one edge, and no centre is a larger end
        ends = small.selectExpr("explode(array(struct(u AS n, 1 AS up, 0 AS centre), struct(v AS n, 0 AS up, 1 AS centre))) AS s").select("s.*")
        ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("centre").alias("centre"))
        if ends.where("up > 1 OR up = 1 AND centre = 1").limit(1).count() == 0:
            nodes = small.selectExpr("u AS node", "v AS label")
            return nodes.unionByName(small.selectExpr("v AS node", "v AS label").distinct())
        e = small
