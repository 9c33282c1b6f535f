"""Statistics over collections: rule enrichment, effect sizes, measured weights, an author's usual figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import patterns as pt
from quillon.session import checkpointed

MIN_DOCS, VOICE_MIN_DOCS, VOICE_MIN_WORDS = 5, 3, 150
VOICE_FEATURES = (
    "lexical_diversity", "entropy_norm", "lexical_density", "word_burstiness", "pct_punctuation",
    "pct_long_words", "mean_sentence_len", "gunning_fog", "contraction_rate", "opener_diversity",
)


def require_docs(docs: DataFrame, least: int = MIN_DOCS) -> None:
    """Both sides must have enough documents."""
    n = {r["side"]: r["count"] for r in docs.filter(F.col("side").isin("machine", "human")).groupBy("side").count().collect()}
    if min(n.get("machine", 0), n.get("human", 0)) < least:
        raise ValueError(f"at least {least} documents a side are needed; there are {n}")


def rule_rates(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """side, rule_id and the mean over documents of hits per 1000 words.

    docs: doc_id, side, n_words. counts: doc_id, rule_id, n with n > 0. Documents without a hit of a rule
    count as 0, by dividing through the number of documents instead of laying out every zero."""
    sides = docs.filter(F.col("side").isNotNull())
    of = sides.groupBy("side").agg(F.count(F.lit(1)).alias("docs"))
    rate = counts.join(sides, "doc_id").groupBy("side", "rule_id").agg(F.sum(F.col("n") / F.greatest(F.lit(1), "n_words") * 1000).alias("rates"))
    every = of.select("side", "docs", F.explode(F.array(*[F.lit(r) for r in pt.RULES])).alias("rule_id"))
    return every.join(rate, ["side", "rule_id"], "left").select("side", "rule_id", (F.coalesce("rates", F.lit(0.0)) / F.col("docs")).alias("per_1k"))


def rule_audit(rates: DataFrame) -> DataFrame:
    """rule_id, machine and human rates, enrichment and verdict."""
    wide = rates.groupBy("rule_id").agg(*[F.coalesce(F.max(F.when(F.col("side") == s, F.col("per_1k"))), F.lit(0.0)).alias(s) for s in ("machine", "human")])
    m, h = F.col("machine"), F.col("human")
    e = F.when((m == 0) & (h == 0), 1.0).when(h == 0, F.lit(float("inf"))).otherwise(m / F.nullif(h, F.lit(0.0)))
    verdict = F.when((m == 0) & (h == 0), "unobserved").when(h == 0, "machine-only").when(e < 0.8, "inverted").when(e <= 1.25, "dead").otherwise("live")
    return wide.select("rule_id", F.round(m, 3).alias("machine_per_1k"), F.round(h, 3).alias("human_per_1k"), F.round(e, 3).alias("enrichment"), verdict.alias("verdict"))


def not_discriminating(audit: DataFrame) -> DataFrame:
    return audit.filter(F.col("verdict").isin("dead", "inverted"))


def long_form(features: DataFrame, names: list[str] | tuple[str, ...], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, feature, value: one row a feature, nulls left out. An expand in place, no exchange."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names]))
    return features.select(*keep, pairs.alias("f")).select(*keep, "f.feature", "f.value").filter("value IS NOT NULL")


def feature_audit(values: DataFrame) -> DataFrame:
    """feature, both means and the effect size (machine less human over the pooled spread).

    values: side, feature, value."""
    agg = values.filter(F.col("side").isin("machine", "human")).groupBy("feature").agg(
        *[
            f(F.when(F.col("side") == s, F.col("value"))).alias(f"{s}_{n}")
            for s in ("machine", "human")
            for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))
        ]
    )
    agg = agg.filter("machine_n > 0 AND human_n > 0")
    pooled = F.sqrt((F.col("machine_var") + F.col("human_var")) / 2)
    d = F.when((F.col("machine_n") < 2) | (F.col("human_n") < 2) | (pooled < 1e-12), 0.0).otherwise((F.col("machine_mean") - F.col("human_mean")) / F.nullif(pooled, F.lit(0.0)))
    return agg.select("feature", F.round("machine_mean", 4).alias("machine_mean"), F.round("human_mean", 4).alias("human_mean"), F.round(d, 3).alias("cohens_d"))


def measured_weights(audit: DataFrame) -> DataFrame:
    """rule_id, weight, enrichment, verdict: how much a hit counts, from how well its rule tells the sides apart."""
    e = F.col("enrichment")
    w = F.when(e == float("inf"), F.when(F.col("machine_per_1k") >= 0.5, 5.0).otherwise(1.0)).when(e < 1.25, 0.0).otherwise(F.least(F.lit(5.0), F.round(F.log2(e), 3)))
    return audit.select("rule_id", w.alias("weight"), "enrichment", "verdict")


def pinned(weights: DataFrame, pins: dict[str, float]) -> DataFrame:
    """weights with pin and effective; a pin goes before the measured weight, and both before 1."""
    pin = F.coalesce(*[F.when(F.col("rule_id") == k, F.lit(float(v))) for k, v in pins.items()], F.lit(None).cast("double"))
    return weights.withColumn("pin", pin).withColumn("effective", F.coalesce("pin", "weight", F.lit(1.0)))


def disagreements(weights: DataFrame) -> DataFrame:
    """Rules whose pin is more than 0.5 from the measured weight."""
    return weights.filter(F.abs(F.col("pin") - F.col("weight")) > 0.5)


MOST_BROADCAST = 100_000


def _joined(values: DataFrame, per: DataFrame, group: list[str]) -> DataFrame:
    """values with the row of their group and feature; a null group is a group.

    There are few features, so the rows of a group are broadcast if they are at most ``MOST_BROADCAST``;
    beyond that the groups are many and the join spreads by them."""
    per = checkpointed(per)
    per = F.broadcast(per) if per.count() <= MOST_BROADCAST else per
    on = values["feature"] == per["feature"]
    for g in group:
        on = on & values[g].eqNullSafe(per[g])
    return values.join(per, on).drop(per["feature"], *[per[g] for g in group])


def voiceprint(style: DataFrame, by: str | None = None, strict: bool = True) -> DataFrame:
    """feature, center, scale, n_docs, n_words (per ``by``): exact medians and scaled median deviations.

    style: stylometry with the column ``by`` if given. Short documents are left out; groups with too few
    documents raise an error, or are left out if not ``strict``. Where deviations vanish the standard
    deviation stands in."""
    group = [by] if by else []
    usable = style.filter(F.col("words") >= VOICE_MIN_WORDS)
    keep = ("words", *group)
    values = long_form(usable, VOICE_FEATURES, keep)
    med = values.groupBy(*group, "feature").agg(F.median("value").alias("med"), F.count(F.lit(1)).alias("n_docs"), F.sum("words").alias("n_words"), F.stddev_pop("value").alias("sd"))
    if strict:
        least = med.agg(F.min("n_docs")).first()[0]
        if least is None or least < VOICE_MIN_DOCS:
            raise ValueError(f"at least {VOICE_MIN_DOCS} documents of {VOICE_MIN_WORDS} words are needed; there are {least or 0}")
    med = med.filter(F.col("n_docs") >= VOICE_MIN_DOCS)
    dev = _joined(values, med, group).groupBy(*group, "feature").agg(
        F.max("med").alias("med"), F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"), F.max("sd").alias("sd"), F.max("n_docs").alias("n_docs"), F.max("n_words").alias("n_words")
    )
    spread = F.col("mad") * 1.4826
    return dev.select(*group, "feature", F.round("med", 6).alias("center"), F.round(F.when(spread <= 1e-9, F.col("sd")).otherwise(spread), 6).alias("scale"), "n_docs", "n_words")


def deviations(style: DataFrame, voice: DataFrame, by: str | None = None) -> DataFrame:
    """doc_id, feature, z: how far a document is from the usual figures; features without spread are left out.

    ``voice`` has ten rows a group, so it is small if there is one group, and joins by group otherwise."""
    group = [by] if by else []
    values = long_form(style, VOICE_FEATURES, ("doc_id", *group))
    usual = voice.filter(F.col("scale") > 1e-9).select(*group, "feature", "center", "scale")
    j = _joined(values, usual if by else F.broadcast(usual), group)
    return j.select("doc_id", "feature", F.round((F.col("value") - F.col("center")) / F.col("scale"), 2).alias("z"))


def interpretation(z: DataFrame, threshold: float = 2.0) -> DataFrame:
    """doc_id and notes: low density, diversity and entropy high together, then others by size."""

    def of(name: str) -> Column:
        return F.max(F.when(F.col("feature") == name, F.col("z")))

    others = F.when((F.abs("z") >= threshold) & ~F.col("feature").isin("lexical_density", "lexical_diversity", "entropy_norm"), F.struct((-F.abs("z")).alias("o"), F.col("feature"), F.col("z")))
    wide = z.groupBy("doc_id").agg(of("lexical_density").alias("ld"), of("lexical_diversity").alias("div"), of("entropy_norm").alias("ent"), F.array_sort(F.collect_list(others)).alias("rest"))
    low = F.when(F.col("ld") <= -threshold, F.concat(F.lit("lexical density "), F.col("ld"), F.lit(" below the usual"), F.when(F.col("ent") < 0, " with entropy").otherwise("")))
    joint = F.when((F.col("div") >= threshold) & (F.col("ent") >= threshold), "lexical diversity and entropy above the usual together")
    notes = F.concat(F.array_compact(F.array(low, joint)), F.transform("rest", lambda r: F.concat(r["feature"], F.lit(" "), r["z"].cast("string"), F.lit(" from the usual"))))
    return wide.select("doc_id", notes.alias("notes"))
