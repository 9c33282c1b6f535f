"""Problem 1: one ranking from several scores on unlike scales, by robust rank aggregation.

Each score is turned into a normalised rank inside its group (1/n best, 1 worst, tied values share
their middle rank). The ranks of an item are sorted, the k-th smallest is held against the
Beta(k, m-k+1) order statistic of m uniform ranks, and the smallest of these probabilities, corrected
by m, is the significance the items are ranked by. Only ranks enter, so no range or tail counts more.

Defined results
* null or NaN score: not measured; it takes the mean of the item's own measured ranks, so it neither
  helps nor harms. An item without any measured score gets significance 1 and no place (rank null).
* several rows of an item: the one with the latest time is valid; at equal times the greatest row.
* null item id: the row is left out. A null group is a group of its own.
* ties in significance: by mean rank, then by item id.
* an empty table gives an empty result; columns other than those named are ignored.

A group may hold any share of the rows. Ranks come from distinct-value counts that are range
partitioned, with an offset per (group, score, slice); no task ever holds a whole group.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import checkpointed, default_parallelism

SCORES = ("choppiness", "closer_ratio", "doublets_per_1k", "parallel_per_1k")


def latest_rows(df: DataFrame, item: str, at: str, keep: list[str]) -> DataFrame:
    """One row per item: that with the latest ``at`` (null counts as oldest; equal times: the greatest row)."""
    best = F.max(F.struct(F.col(at).alias("at"), *[F.col(c) for c in keep])).alias("best")
    return df.filter(F.col(item).isNotNull()).groupBy(item).agg(best).select(item, *[F.col(f"best.{c}").alias(c) for c in keep])


def grouped_ranks(long: DataFrame, keys: list[str], value: str, partitions: int) -> DataFrame:
    """Normalised rank of every distinct ``value`` within ``keys``, highest first, ties at their middle.

    Returns keys, value, n (rows with that value) and norm_rank."""
    counts = long.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange(partitions, *[F.col(k) for k in keys], F.col(value).desc())
    sliced = checkpointed(ranged.withColumn("slice", F.spark_partition_id()))  # slices must not change on a retry
    per_slice = sliced.groupBy(*keys, "slice").agg(F.sum("n").alias("slice_n"))
    by_key = Window.partitionBy(*keys)
    offsets = per_slice.select(
        *keys,
        "slice",
        F.coalesce(F.sum("slice_n").over(by_key.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("slice_n").over(by_key).alias("total"),
    )
    within = Window.partitionBy(*keys, "slice").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    inner = sliced.withColumn("above", F.coalesce(F.sum("n").over(within), F.lit(0)))
    same = [inner[k].eqNullSafe(offsets[k]) for k in keys] + [inner["slice"] == offsets["slice"]]
    rank = (F.col("before") + F.col("above") + (F.col("n") + 1) / 2) / F.col("total")
    return inner.join(offsets, same).select(*[inner[k] for k in keys], inner[value], "n", rank.alias("norm_rank"))


def significance(ranks: Column, m: int) -> Column:
    """Corrected minimum of the beta order-statistic probabilities of ``m`` ranks sorted ascending."""
    probs = []
    for k in range(1, m + 1):
        x = F.element_at(ranks, k)
        terms = [F.lit(float(comb(m, j))) * F.pow(x, F.lit(j)) * F.pow(F.lit(1.0) - x, F.lit(m - j)) for j in range(k, m + 1)]
        probs.append(sum(terms[1:], terms[0]))
    least = F.least(*probs) if m > 1 else probs[0]
    return F.least(F.lit(1.0), least * m)


def aggregate_ranks(
    df: DataFrame, group: str, item: str, scores: tuple[str, ...] = SCORES, at: str | None = "analyzed_at", hot_share: int = 500
) -> DataFrame:
    """group, item, one normalised rank per score, mean_rank, significance and rank of every valid item."""
    spark = df.sparkSession
    keep = [group, *scores]
    valid = latest_rows(df, item, at, keep) if at else df.filter(F.col(item).isNotNull()).select(item, *keep)
    valid = checkpointed(valid)
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("value")) for s in scores]))
    long = valid.select(group, item, pairs.alias("p")).select(group, item, "p.score", "p.value")
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    parts = default_parallelism(spark)
    ranks = checkpointed(grouped_ranks(long, [group, "score"], "value", parts))

    # A value shared by so many rows that its join partition would be skewed goes by broadcast: at most
    # hot_share * len(scores) such values exist. All others hold too few rows each to matter.
    total = valid.count()
    hot = ranks.filter(F.col("n") * hot_share > max(total, hot_share))
    cold = ranks.filter(F.col("n") * hot_share <= max(total, hot_share))
    r = ["group", "score_", "value_", "norm_rank"]

    def renamed(x: DataFrame) -> DataFrame:
        return x.select(F.col(group).alias(r[0]), F.col("score").alias(r[1]), F.col("value").alias(r[2]), r[3])

    def on(left: DataFrame, right: DataFrame) -> Column:
        return left[group].eqNullSafe(right[r[0]]) & (left["score"] == right[r[1]]) & (left["value"] == right[r[2]])

    hot_r, cold_r = F.broadcast(renamed(hot)), renamed(cold)
    one = long.join(hot_r, on(long, hot_r)).select(long[group], long[item], long["score"], "norm_rank")
    rest = long.join(hot_r, on(long, hot_r), "left_anti")
    two = rest.join(cold_r, on(rest, cold_r)).select(rest[group], rest[item], rest["score"], "norm_rank")
    wide = one.unionByName(two).groupBy(item).agg(*[F.max(F.when(F.col("score") == s, F.col("norm_rank"))).alias(f"rank_{s}") for s in scores])

    all_ranks = F.array_compact(F.array(*[F.col(f"rank_{s}") for s in scores]))
    mean = F.aggregate(all_ranks, F.lit(0.0), lambda a, x: a + x) / F.size(all_ranks)
    ranked = wide.withColumn("mean_rank", mean)
    filled = F.array_sort(F.array(*[F.coalesce(F.col(f"rank_{s}"), F.col("mean_rank")) for s in scores]))
    ranked = ranked.withColumn("filled", filled).withColumn("significance", significance(F.col("filled"), len(scores))).drop("filled")
    out = valid.select(group, item).join(ranked, item, "left")
    return out.withColumn("significance", F.coalesce("significance", F.lit(1.0)))


def first_in_group(ranked: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """The ``n`` most significant items of each group; items without a measured score have no place.

    The filter on row_number lets Spark keep n rows per group before the exchange."""
    w = Window.partitionBy(group).orderBy("significance", "mean_rank", item)
    placed = ranked.filter(F.col("mean_rank").isNotNull()).withColumn("place", F.row_number().over(w))
    return placed.filter(F.col("place") <= n)
