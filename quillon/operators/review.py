"""Ranking and verdicts: weighted scores, worst paragraphs, review of a text, drift between revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import patterns as pt
from quillon.operators import corpus, features
from quillon.operators.parse import Parsed, parse
from quillon.operators.rules import Config, hits
from quillon.session import own


def with_weight(found: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Hits with the weight of their rule: a measured or pinned one if given (1 if missing), else its severity's.

    Rules are few, so their table is broadcast."""
    if weights is None:
        return found.withColumn("weight", severity_weight(F.col("rule_id")))
    w = weights.select("rule_id", F.col("effective" if "effective" in weights.columns else "weight").alias("weight"))
    return found.join(F.broadcast(w), "rule_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def severity_weight(rule: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for s, w in pt.SEVERITY_WEIGHT.items():
        out = out.when(rule.isin(*[r.id for r in pt.RULES.values() if r.severity == s]), w)
    return out.otherwise(1.0)


def scores(found: DataFrame, sizes: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, total, per_1k, score of every document; sizes: doc_id, n_words."""
    agg = with_weight(found, weights).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.sum("weight").alias("sum"))
    j = sizes.join(agg, "doc_id", "left")
    n = F.nullif(F.col("n_words"), F.lit(0))
    return j.select(
        "doc_id",
        F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.round(F.coalesce("total", F.lit(0)) / n * 1000, 2), F.lit(0.0)).alias("per_1k"),
        F.coalesce(F.round(F.coalesce("sum", F.lit(0.0)) / n * 1000, 2), F.lit(0.0)).alias("score"),
    )


def hits_in_paragraphs(found: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Hits with the paragraph their start lies in, by one ordered pass over both; hits outside are left out."""
    para = F.struct("para_no", F.col("start").alias("p_start"), F.col("end").alias("p_end"), "n_words")
    cols = [c for c in found.columns if c not in ("doc_id", "start")]
    a = paragraphs.select("doc_id", "start", F.lit(0).alias("kind"), para.alias("para"))
    b = found.select("doc_id", "start", F.lit(1).alias("kind"), *cols)
    w = Window.partitionBy("doc_id").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    j = a.unionByName(b, allowMissingColumns=True).withColumn("para", F.last("para", ignorenulls=True).over(w))
    return j.filter((F.col("kind") == 1) & (F.col("start") < F.col("para.p_end"))).select("doc_id", "start", *cols, "para.para_no", "para.p_start", "para.n_words")


def paragraph_scores(p: Parsed, found: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Every paragraph with a hit: index (from 1), line, words, hits, weighted density, rules in order, preview."""
    inside = hits_in_paragraphs(with_weight(found, weights).select("doc_id", "start", "end", "rule_id", "weight"), p.paragraphs)
    rules = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start", "rule_id"))), lambda x: x["rule_id"]))
    agg = inside.groupBy("doc_id", "para_no").agg(F.count(F.lit(1)).alias("hits"), F.sum("weight").alias("sum"), rules.alias("rules"))
    j = agg.join(p.paragraphs, ["doc_id", "para_no"])
    words = F.greatest(F.col("n_words"), F.lit(1))
    return j.select(
        "doc_id",
        (F.col("para_no") + 1).alias("para_index"),
        "line_no",
        words.alias("words"),
        "hits",
        F.round(F.col("sum") / words * 1000, 1).alias("weighted"),
        "rules",
        F.translate(F.substring("text", 1, 60), "\n", " ").alias("preview"),
    )


def worst_paragraphs(scored: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` paragraphs of each document with the greatest weighted density, the earlier first among equals."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("weighted"), "para_index")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def punch(p: Parsed) -> DataFrame:
    """The staccato score of every document out of choppiness, closers, balanced pairs and parallel runs."""
    from quillon.operators import parallelism
    from quillon.operators.rules import closers, rateable

    p = p.settled
    per = p.sizes
    for name, df in (("closers", closers(p)), ("rateable", rateable(p)), ("doublets", parallelism.doublets(p)), ("runs", parallelism.runs(p))):
        per = per.join(df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name)), "doc_id", "left")
    per = per.fillna(0, ["closers", "rateable", "doublets", "runs"]).join(features.cadence(p).select("doc_id", "choppiness"), "doc_id")
    words = F.greatest(F.col("n_words"), F.lit(1))
    ratio = F.when(F.col("rateable") == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.col("closers") / F.nullif(F.col("rateable"), F.lit(0))), 3))
    per = per.withColumns({"ratio": ratio, "d": F.col("doublets") / words * 1000, "r": F.col("runs") / words * 1000})
    one = F.lit(1.0)
    score = 0.40 * F.least(one, F.col("choppiness") / 0.6) + 0.30 * F.least(one, F.col("ratio") / 0.60) + 0.20 * F.least(one, F.col("d") / 20.0) + 0.10 * F.least(one, F.col("r") / 8.0)
    out = per.select(
        "doc_id",
        F.round(score, 3).alias("punch"),
        F.round("choppiness", 3).alias("choppiness"),
        F.col("ratio").alias("closer_ratio"),
        F.round("d", 2).alias("doublets_per_1k"),
        F.round("r", 2).alias("parallel_per_1k"),
        F.when(score >= 0.20, "punchy").otherwise("ok").alias("verdict"),
    )
    return own(out)


def notes(p: Parsed, c: Config = Config(), voice: DataFrame | None = None) -> DataFrame:
    """doc_id and what its punch, cadence, metrics, reader signals (given an audience) and voice (given one) call for, in this order.

    A document without words has no notes."""
    pun = punch(p).select("doc_id", F.array_compact(F.array(F.when(F.col("verdict") == "punchy", F.format_string("punch %.2f: staccato register", "punch")))).alias("punchy"))
    choppy = F.format_string("choppiness %.2f: short sentences and sentences without verb", "choppiness")
    cad = features.cadence(p).select("doc_id", F.array_compact(F.array(F.when(F.col("verdict") == "choppy", choppy))).alias("choppy"))
    j = p.sizes.join(pun, "doc_id").join(cad, "doc_id").join(features.metric_warnings(features.metrics(p)), "doc_id")
    parts = ["punchy", "choppy", "warnings"]
    if c.audience:
        j = j.join(features.reader_notes(features.reader_signals(p, c.audience)).withColumnRenamed("notes", "reader"), "doc_id")
        parts.append("reader")
    if voice is not None:
        said = corpus.interpretation(corpus.deviations(features.stylometry(p), voice), c.z_threshold)
        j = j.join(said.withColumnRenamed("notes", "voice"), "doc_id", "left")
        parts.append("voice")
    none = F.array().cast("array<string>")
    return j.select("doc_id", F.when(F.col("n_words") > 0, F.concat(*[F.coalesce(k, none) for k in parts])).otherwise(none).alias("notes"))


def review(p: Parsed, c: Config = Config(), found: DataFrame | None = None, weights: DataFrame | None = None, voice: DataFrame | None = None) -> DataFrame:
    """doc_id, passed, total, over, instructions, worst and notes.

    instructions: groups by rule, the severest first, six spans shown in each; worst: the paragraph of the greatest
    weighted density, null without hits in paragraphs; notes: see ``notes``."""
    p = p.settled
    found = hits(p, c) if found is None else found
    # hits meet their line and paragraph in one pass over the line breaks, the paragraphs and the hits
    breaks = p.docs.select("doc_id", F.split("text", "\n", -1).alias("lines"))
    breaks = breaks.select("doc_id", F.posexplode(F.transform("lines", lambda x: F.length(x) + 1)).alias("line0", "len"))
    before = Window.partitionBy("doc_id").orderBy("line0").rowsBetween(Window.unboundedPreceding, -1)
    lines = breaks.select("doc_id", F.coalesce(F.sum("len").over(before), F.lit(0)).cast("int").alias("start"), F.lit(0).alias("kind"), (F.col("line0") + 1).alias("line"))
    paras = p.paragraphs.select("doc_id", "start", F.lit(1).alias("kind"), "para_no", F.col("end").alias("p_end"), F.col("n_words").alias("p_words"))
    marked = with_weight(found, weights).withColumn("kind", F.lit(2))
    w = Window.partitionBy("doc_id").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    events = lines.unionByName(paras, allowMissingColumns=True).unionByName(marked, allowMissingColumns=True).withColumn("line", F.last("line", ignorenulls=True).over(w))
    para = F.when(F.col("kind") == 1, F.struct("para_no", "p_end", "p_words", F.col("line").alias("p_line")))
    events = events.withColumn("para", F.last(para, ignorenulls=True).over(w)).filter("kind = 2")
    events = events.withColumn("para", F.when(F.col("start") < F.col("para.p_end"), F.col("para")))
    in_para = Window.partitionBy("doc_id", "para.para_no").orderBy("start", "rule_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words = F.greatest(F.col("para.p_words"), F.lit(1))
    density = F.round(F.sum("weight").over(in_para) / words * 1000, 1)
    rules = F.array_join(F.array_distinct(F.collect_list("rule_id").over(in_para)), ", ")
    shape = F.format_string("P%d (L%d, %dw): %d hits, weight %d [%s]", F.col("para.para_no") + 1, "para.p_line", words, F.count(F.lit(1)).over(in_para), F.bround(density, 0).cast("long"), rules)
    events = events.withColumn("worst", F.when(F.col("para").isNotNull(), F.struct(density.alias("density"), (-F.col("para.para_no")).alias("o"), shape.alias("s"))))
    events = events.withColumn("worst", F.max("worst").over(Window.partitionBy("doc_id")))
    by_rule = Window.partitionBy("doc_id", "rule_id").orderBy("start", "end")
    shown = events.withColumn("nth", F.row_number().over(by_rule)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "rule_id"))).filter("nth <= 6")
    span = F.when(F.length("text") <= 70, F.col("text")).otherwise(F.concat(F.substring("text", 1, 67), F.lit("...")))
    spans = F.transform(F.array_sort(F.collect_list(F.struct("nth", F.concat(F.lit("L"), "line", F.lit(" "), span).alias("s")))), lambda x: x["s"])
    groups = shown.groupBy("doc_id", "rule_id").agg(F.max("of").alias("n"), spans.alias("spans"), F.min("start").alias("first"), F.max("worst.s").alias("worst"))
    group = F.struct((-severity_weight(F.col("rule_id"))).alias("o"), "first", "rule_id", "n", "spans")
    ordered = F.transform(F.array_sort(F.collect_list(group)), lambda g: F.struct(g["rule_id"].alias("rule_id"), g["n"].alias("n"), g["spans"].alias("spans")))
    per = groups.groupBy("doc_id").agg(F.sum("n").alias("total"), ordered.alias("instructions"), F.max("worst").alias("worst"))
    j = p.sizes.join(per, "doc_id", "left").join(notes(p, c, voice), "doc_id")
    total = F.coalesce("total", F.lit(0))
    over = F.lit(False)
    if c.max_hits is not None:
        over = over | (total > c.max_hits)
    if c.max_per_1k is not None:
        over = over | (F.coalesce(total / F.nullif(F.col("n_words"), F.lit(0)) * 1000, F.lit(0.0)) > c.max_per_1k)
    if c.max_choppiness is not None:
        j = j.join(features.cadence(p).select("doc_id", "choppiness"), "doc_id")
        over = over | (F.col("choppiness") > c.max_choppiness)
    return own(j.select("doc_id", (total <= (c.max_hits or 0)).alias("passed"), total.cast("long").alias("total"), over.alias("over"), "instructions", "worst", "notes"))


def drift(pairs: DataFrame, c: Config = Config(), found=hits) -> DataFrame:
    """pair_id, figures of both sides and the verdict on the revision. pairs: pair_id, side (before or after), text.

    A pair without one of its sides is left out. Checked in this order: choppy, overfit, churned, traded, improved."""
    keyed = pairs.select(F.concat_ws(":", F.col("pair_id").cast("string"), "side").alias("doc_id"), F.col("pair_id").alias("pair"), "side", "text")
    p = parse(keyed, path=None, skip_code=c.skip_code_blocks)
    style = features.stylometry(p).select("doc_id", "lexical_density", "entropy_norm")
    total = scores(found(p, c), p.sizes).select("doc_id", "total")
    figures = features.cadence(p).select("doc_id", "choppiness", F.col("verdict").alias("cadence")).join(style, "doc_id").join(total, "doc_id")
    sides = keyed.select("doc_id", "pair", "side").join(figures, "doc_id")
    names = {"total": "hits", "choppiness": "choppiness", "lexical_density": "density", "entropy_norm": "entropy", "cadence": "cadence"}
    wide = sides.groupBy("pair").agg(*[F.max(F.when(F.col("side") == s, F.col(k))).alias(f"{v}_{s}") for k, v in names.items() for s in ("before", "after")])
    wide = wide.filter("hits_before IS NOT NULL AND hits_after IS NOT NULL")
    chop = F.col("choppiness_after") - F.col("choppiness_before")
    fewer = F.col("hits_before") - F.col("hits_after")
    verdict = (
        F.when((chop >= 0.03) | ((F.col("cadence_after") == "choppy") & (chop > 0)), "choppy")
        .when((fewer <= 0) & (F.col("hits_after") == 0), "overfit")
        .when(fewer < 1, "churned")
        .when((F.col("density_after") - F.col("density_before") <= -0.015) & (F.abs(chop) < 0.02), "traded")
        .otherwise("improved")
    )
    note = F.when(F.abs(chop) >= 0.02, "density and burstiness move with choppiness")
    return wide.select(F.col("pair").alias("pair_id"), *[c for c in wide.columns if c != "pair" and not c.startswith("cadence")], verdict.alias("verdict"), note.alias("note"))


def contract(c: Config = Config(), audience: str | None = None, voice: dict[str, float] | None = None, profile: str | None = None) -> str:
    """The enabled rules as instructions for a writer; under a profile, the limits that will judge the text."""
    lines = [f"[{r.id}] {r.why} {r.fix}" for r in pt.RULES.values() if r.id not in c.disabled]
    if audience == "expert":
        lines += ["Let the tone move; do not keep it even.", "Do not repeat the words of the sentence before.", "Use several devices once each."]
    elif audience == "general":
        lines += ["Keep sentences easy to follow and words concrete.", "Vary the words within that."]
    if profile:
        lines.append(f"At most {c.parallel_budget_per_1k:g} parallel runs and {c.doublet_budget_per_1k:g} balanced pairs in 1000 words; at most {c.closer_budget_ratio:.0%} of paragraphs end on a short sentence.")
        lines += [f"No sentence without a verb under {c.min_sentence_words} words."] if c.min_sentence_words else []
        lines += [f"Choppiness at most {c.max_choppiness:g}."] if c.max_choppiness is not None else []
        lines += [f"At most {c.person_budget_per_1k:g} sentences in 1000 words with a 'you' for anyone."] if c.person_budget_per_1k is not None else []
    lines += [f"Usual {k}: {v:g}" for k, v in sorted((voice or {}).items())]
    return "\n".join(lines)
