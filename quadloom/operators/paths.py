"""Transitive closure by semi-naive rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def closure(edges: DataFrame, start: DataFrame | None = None, rounds: int = 10_000) -> DataFrame:
    """Pairs (s, o) joined by one edge or more; with `start` (one column, s), only those that begin there.

    Each round joins the newest pairs with all known ones, so the length of the paths doubles, and drops
    what is known, so cycles end it.  With `start` the newest pairs are joined with the edges instead, and the work follows
    what can be reached from there.  Raises if `rounds` don't suffice.
    """
    edges = cut(edges.toDF("s", "o").where("s is not null and o is not null").distinct())
    new = edges if start is None else cut(edges.join(start.toDF("s").distinct(), "s", "left_semi"))
    known = new
    for _ in range(rounds):
        if new.isEmpty():
            return known
        onward = known if start is None else edges
        step = new.withColumnRenamed("o", "m").join(onward.select(F.col("s").alias("m"), "o"), "m").select("s", "o").distinct()
        new = cut(step.join(known, ["s", "o"], "left_anti"))
        known = known.unionByName(new)
    raise RuntimeError(f"the closure did not settle in {rounds} rounds")
