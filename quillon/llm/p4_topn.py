"""Problem 4: the N highest items of every group, by descending score bands.

The scores are cut into bands at approximate quantiles. From the top band down, each band is pruned
to N per (group, block), groups already filled by higher bands are anti-joined away, and the band in
which a group fills up is cut by the exact order (score descending, then position ascending).

Defined results
* several rows of a (group, position): the latest counts; at equal times the higher score.
* latest row with a null or NaN score: the item is left out. +/-infinity is a score.
* null group or null position: left out, as it names no paragraph.
* a group with fewer than N items gives what it has; an empty table gives an empty result.

Rows are placed by (group, block of positions), so a group of any size spreads over many tasks, and
after that one exchange only N rows per (group, block, band) move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import checkpointed

BLOCK = 4096


def latest_scores(df: DataFrame, group: str, pos: str, score: str, at: str, block: int = BLOCK) -> DataFrame:
    """group, block, pos and score of the valid row of each (group, pos), only where it is scored.

    A timestamp and a score in one long each keep the aggregate in fixed-width buffers; the ordering
    key is the time, and a null score counts below any other at equal times."""
    rows = df.filter(F.col(group).isNotNull() & F.col(pos).isNotNull()).select(
        F.col(group).alias("grp"),
        F.floor(F.col(pos) / block).cast("long").alias("block"),
        F.col(pos).alias("pos"),
        F.col(score).cast("double").alias("score"),
        F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**62))).alias("at"),
    )
    placed = rows.repartition("grp", "block")
    newest = Window.partitionBy("grp", "block", "pos").orderBy(F.col("at").desc(), F.col("score").desc_nulls_last())
    valid = placed.withColumn("nth", F.row_number().over(newest)).filter("nth = 1").drop("nth", "at")
    return valid.filter(F.col("score").isNotNull() & ~F.isnan("score"))


def top_n_by_bands(
    df: DataFrame, group: str, pos: str, score: str, at: str, n: int = 3, cuts: tuple[float, ...] = (0.85, 0.5), block: int = BLOCK
) -> DataFrame:
    """group, pos, score and place (1..n) of the first n items of each group.

    ``cuts`` are the quantiles at which bands end; they move work between bands, never the result."""
    scored = latest_scores(df, group, pos, score, at, block)
    order = [F.col("score").desc(), F.col("pos").asc()]
    scored = checkpointed(scored)
    edges = scored.select(F.percentile_approx("score", [float(c) for c in cuts], 1000).alias("e")).first()["e"] or []
    edges = sorted(set(edges), reverse=True)
    local = Window.partitionBy("grp", "block").orderBy(*order)
    whole = Window.partitionBy("grp").orderBy(*order)

    taken: DataFrame | None = None
    for i in range(len(edges) + 1):
        band = scored
        if i < len(edges):
            band = band.filter(F.col("score") >= edges[i])
        if i:
            band = band.filter(F.col("score") < edges[i - 1])
        band = band.withColumn("nth", F.row_number().over(local)).filter(F.col("nth") <= n).drop("nth")
        if taken is None:
            placed = band.withColumn("place", F.row_number().over(whole)).filter(F.col("place") <= n)
            taken = checkpointed(placed.select("grp", "pos", "score", "place"))
            continue
        have = taken.groupBy("grp").agg(F.max("place").alias("have"))
        open_band = band.join(have.filter(F.col("have") >= n), "grp", "left_anti")
        placed = open_band.withColumn("nth", F.row_number().over(whole)).filter(F.col("nth") <= n)
        placed = placed.join(have.filter(F.col("have") < n), "grp", "left")
        placed = placed.withColumn("place", F.col("nth") + F.coalesce("have", F.lit(0))).filter(F.col("place") <= n)
        taken = taken.unionByName(placed.select("grp", "pos", "score", "place"))
        if i < len(edges):
            taken = checkpointed(taken)
    return taken.select(F.col("grp").alias(group), F.col("pos").alias(pos), F.col("score").alias(score), "place")
