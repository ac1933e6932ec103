"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum joined back to the edges.  Minima of few
vertices are broadcast, so the edges stay where they are; of many, hubs are
dealt out over salts, so a vertex with a third of all edges does not land in
one task.  The number of steps grows with the logarithm of the vertices, and
the edges after each pair of steps are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm import shared
from tidepool.llm.shared import Scratch, near

SALTS = 16


def _with_minimum(edges: DataFrame, few: bool) -> DataFrame:
    """(u, v, m): m is the smallest of u and all its neighbours in `edges`."""
    if few:
        return edges.join(F.broadcast(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))), "u").select("u", "v", "m")
    salted = edges.withColumn("s", F.pmod(F.hash("v"), F.lit(SALTS)))
    least = (
        salted.groupBy("u", "s").agg(F.min("v").alias("m")).groupBy("u").agg(F.least(F.min("m"), F.first("u")).alias("m"))
        .withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    return salted.join(least, ["u", "s"]).select("u", "v", "m")


def _edges(*pairs: tuple[str, str]) -> Column:
    """A row (u, v) for each of the pairs of columns."""
    return F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs]))


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every vertex has one edge to a smaller one, or is itself the smaller end of all its edges."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root) for every vertex of `edges` (src, dst): root is the smallest reachable vertex.

    Loops, repeated and reversed edges make no difference; rows with a null
    end are ignored; no edges give no rows.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = scratch.save(e, f"{name}-0")
    k = 0
    while not _is_star_forest(e):
        few = 2 * e.count() <= shared.BROADCAST_ROWS  # of vertices, and so of minima
        large = _with_minimum(e.select(_edges(("u", "v"), ("v", "u"))), few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        if not few:
            large = scratch.save(large.distinct(), f"{name}-{k + 1}")
        small = _with_minimum(large, few).select(_edges(("v", "m"), ("u", "m"))).where("u <> v").distinct()
        e = scratch.save(small, f"{name}-{k + 2}")
        scratch.drop(f"{name}-{k}", f"{name}-{k + 1}")
        k += 2
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def joined_components(roots: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The saved components `roots` (node, root) after saved `links` (src, dst), as a saved table.

    Only the roots of links between two components are joined; a vertex that
    is new to `roots` is its own.  Links within components change nothing.
    """
    ends = links
    for c in ("src", "dst"):
        ends = ends.join(near(roots).select(F.col("node").alias(c), F.col("root").alias("_root")), c, "left").withColumn(c, F.coalesce("_root", c)).drop("_root")
    ends = scratch.save(ends.where("src <> dst"), f"{name}-ends")
    if ends.isEmpty():
        return roots
    joined = scratch.save(connected_components(ends, scratch, name), f"{name}-joined")
    to = near(joined).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    moved = roots.join(to, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return scratch.save(moved.unionByName(joined.join(near(roots).select("node"), "node", "left_anti")), f"{name}-roots")
