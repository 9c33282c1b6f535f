"""Features of every document, one row each; documents without words have the values of an empty text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import lexicons as lx
from quillon.functions import patterns as pt
from quillon.functions import text as tx
from quillon.operators.parse import Parsed

SHORT_WORDS, LONG_WORDS = 7, 25


def by_doc():
    return Window.partitionBy("doc_id")



def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def _zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def _exact(c: Column, digits: int) -> Column:
    """Rounded half up on the decimal value, so that the last bits of a sum decide nothing."""
    return F.round(c.cast("decimal(20,9)"), digits).cast("double")


def _on_all(p: Parsed, part: DataFrame) -> DataFrame:
    """part on every document, nulls where it has no row."""
    return p.docs.select("doc_id").join(part, "doc_id", "left")


def metrics(p: Parsed) -> DataFrame:
    """Sentence lengths: mean, spread, shares of short and long ones, longest run of like lengths; first-person footprint."""
    order = by_doc().orderBy("sent_no")
    s = p.sentences.select("doc_id", "sent_no", "n_words")
    s = s.withColumn("step", F.abs(F.col("n_words") - F.lag("n_words").over(order)))
    s = s.withColumn("island", F.sum(F.when(F.col("step") <= 4, 0).otherwise(1)).over(order))
    s = s.withColumn("run", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "island")))
    n = F.col("n_words")
    agg = s.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sentences"),
        F.avg(n).alias("mean"),
        F.stddev_pop(n).alias("sd"),
        F.avg((n <= SHORT_WORDS).cast("int")).alias("short"),
        F.avg((n >= LONG_WORDS).cast("int")).alias("long"),
        F.max("run").alias("flat"),
    )
    marks = sum((tx.count(F.col("text"), q) for q in pt.FOOTPRINT[1:]), tx.count(F.col("text"), pt.FOOTPRINT[0]))
    per_doc = p.docs.select("doc_id", F.size(tx.words(F.col("text"))).alias("words"), marks.alias("footprint"))
    j = per_doc.join(agg, "doc_id", "left")
    return j.select(
        "doc_id",
        _zero("sentences").cast("long").alias("sentences"),
        F.col("words").cast("long").alias("words"),
        F.round(_zero("mean"), 1).alias("mean_len"),
        F.round(_zero("sd"), 1).alias("stdev_len"),
        F.round(_ratio(_zero("sd"), _zero("mean")), 3).alias("cv"),
        F.round(F.coalesce("short", F.lit(1.0)), 3).alias("pct_short"),
        F.round(_zero("long"), 3).cast("double").alias("pct_long"),
        F.coalesce("flat", F.lit(1)).cast("long").alias("longest_flat_run"),
        F.col("footprint").cast("long").alias("footprint"),
        F.round(_ratio(F.col("footprint") * 1000, F.col("words")), 2).alias("footprint_per_1k"),
    )


def metric_warnings(m: DataFrame) -> DataFrame:
    """doc_id and the warnings its metrics give rise to."""
    return m.select(
        "doc_id",
        F.array_compact(
            F.array(
                F.when(F.col("cv") < 0.45, "flat sentence length"),
                F.when(F.col("longest_flat_run") > 6, "long run of like sentences"),
                F.when((F.col("words") > 400) & (F.col("footprint") == 0), "no first-person footprint"),
            )
        ).alias("warnings"),
    )


def cadence(p: Parsed) -> DataFrame:
    """Choppiness out of short sentences, sentences without verb, and runs of short ones."""
    order = by_doc().orderBy("sent_no")
    s = p.sentences.select("doc_id", "sent_no", "n_words", "finite").withColumn("is_short", F.col("n_words") <= SHORT_WORDS)
    s = s.withColumn("island", F.sum((~F.col("is_short")).cast("int")).over(order))
    s = s.withColumn("run", F.sum(F.col("is_short").cast("int")).over(Window.partitionBy("doc_id", "island")))
    n = F.col("n_words")
    agg = s.groupBy("doc_id").agg(
        F.sum(n).alias("total"),
        F.sum(F.when(F.col("is_short"), n).otherwise(0)).alias("short"),
        F.avg((~F.col("finite")).cast("int")).alias("verbless"),
        F.sum(F.when(F.col("is_short") & (F.col("run") >= 3), n).otherwise(0)).alias("in_runs"),
        F.avg(n).alias("mean"),
    )
    short, run = _ratio(F.col("short"), F.col("total")), _ratio(F.col("in_runs"), F.col("total"))
    score = 0.45 * short + 0.35 * F.col("verbless") + 0.20 * run
    out = agg.select("doc_id", score.alias("score"), short.alias("s"), F.col("verbless").alias("v"), run.alias("r"), "mean")
    j = _on_all(p, out)
    verdict = F.when(F.col("score").isNull(), "n/a").when(F.col("score") >= 0.17, "choppy").otherwise("ok")
    return j.select(
        "doc_id",
        _exact(_zero("score"), 4).alias("choppiness"),
        _exact(_zero("s"), 4).alias("short_share"),
        _exact(_zero("v"), 4).alias("verbless_share"),
        _exact(_zero("r"), 4).alias("run_mass"),
        _exact(_zero("mean"), 2).alias("mean_sentence_len"),
        verdict.alias("verdict"),
    )


def word_frequencies(p: Parsed) -> DataFrame:
    """doc_id, lword, n: how often each word occurs in a document."""
    return p.docs.select("doc_id", F.explode(tx.words(F.lower("text"))).alias("lword")).groupBy("doc_id", "lword").agg(F.count(F.lit(1)).alias("n"))


def mattr(p: Parsed, window: int = 50) -> DataFrame:
    """Mean share of distinct words over all windows of ``window`` words; over the text if it is shorter.

    In closed form: a word adds one to every window in which it is the first of its kind, and the
    previous occurrence says how many those are. No window is ever laid out."""
    toks = p.tokens.select("doc_id", "pos", "lword")
    toks = toks.withColumn("prev", F.lag("pos").over(Window.partitionBy("doc_id", "lword").orderBy("pos")))
    toks = toks.withColumn("n", F.count(F.lit(1)).over(by_doc()))
    first = F.least("pos", F.col("n") - window) - F.greatest(F.coalesce(F.col("prev"), F.lit(-1)) + 1, F.col("pos") - (window - 1), F.lit(0)) + 1
    agg = toks.groupBy("doc_id").agg(F.max("n").alias("n"), F.sum(F.greatest(F.lit(0), first)).alias("firsts"), F.sum(F.col("prev").isNull().cast("int")).alias("types"))
    value = F.when(F.col("n") < window, F.col("types") / F.col("n")).otherwise(F.col("firsts") / (F.col("n") - window + 1) / window)
    return _on_all(p, agg.select("doc_id", value.alias("mattr"))).select("doc_id", F.round(_zero("mattr"), 4).cast("double").alias("lexical_diversity"))


def stylometry(p: Parsed) -> DataFrame:
    """Vocabulary, punctuation, readability and opener figures of every document."""
    w = F.col("lword")
    f = word_frequencies(p).withColumn("content", ~w.isin(*sorted(lx.FUNCTION_WORDS))).withColumn("beats", tx.syllables(w))
    f = f.withColumn("total", F.sum("n").over(by_doc()))
    q = F.col("n") / F.col("total")
    freq = f.groupBy("doc_id").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("types"),
        F.sum(-q * F.log2(q)).alias("bits"),
        F.stddev_pop("n").alias("sd"),
        F.avg("n").alias("mean"),
        F.sum(F.when(F.col("content"), F.col("n")).otherwise(0)).alias("content"),
        F.sum(F.when(F.length("lword") > 6, F.col("n")).otherwise(0)).alias("long"),
        F.sum(F.when(F.col("beats") >= 3, F.col("n")).otherwise(0)).alias("complex"),
    )
    sent = p.sentences.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sentences"), F.avg("n_words").alias("asl"), F.countDistinct("first_word").alias("openers"), F.count("first_word").alias("opened")
    )
    para = p.paragraphs.groupBy("doc_id").agg(F.stddev_pop("n_words").alias("para_sd"), F.avg("n_words").alias("para_mean"))
    t = F.col("text")
    marks = F.length(t) - F.length(F.regexp_replace(t, r"\p{Punct}", ""))
    base = p.docs.select("doc_id", F.length(t).alias("chars"), marks.alias("marks"), tx.count(t, pt.CONTRACTION).alias("contractions"))
    j = base.join(freq, "doc_id", "left").join(sent, "doc_id", "left").join(para, "doc_id", "left").join(mattr(p), "doc_id")
    n = F.greatest(_zero("n"), F.lit(1))
    return j.select(
        "doc_id",
        _zero("n").cast("long").alias("words"),
        _zero("sentences").cast("long").alias("sentences"),
        "lexical_diversity",
        F.round(F.when(F.col("types") > 1, F.col("bits") / F.log2("types")).otherwise(0.0), 4).alias("entropy_norm"),
        F.round(_zero("bits"), 3).cast("double").alias("entropy_bits"),
        F.round(_ratio(_zero("sd"), _zero("mean")), 4).alias("word_burstiness"),
        F.round(_zero("content") / n, 4).alias("lexical_density"),
        F.round(F.col("marks") / F.greatest(F.lit(1), "chars"), 4).alias("pct_punctuation"),
        F.round(_zero("long") / n, 4).alias("pct_long_words"),
        F.round(_zero("asl"), 2).cast("double").alias("mean_sentence_len"),
        F.round(0.4 * (_zero("asl") + 100 * _zero("complex") / n), 2).alias("gunning_fog"),
        F.round(F.col("contractions") / n * 1000, 2).alias("contraction_rate"),
        F.round(_ratio(_zero("openers"), _zero("opened")), 4).alias("opener_diversity"),
        F.round(_ratio(_zero("para_sd"), _zero("para_mean")), 4).alias("para_len_cv"),
    )


def adjacent_overlap(p: Parsed) -> DataFrame:
    """Mean overlap of the content words of neighbouring sentences; pairs without any are left out."""
    content = F.array_distinct(F.filter(F.transform("words", F.lower), lambda w: ~w.isin(*sorted(lx.FUNCTION_WORDS))))
    s = p.sentences.select("doc_id", "sent_no", content.alias("c"))
    s = s.withColumn("before", F.lag("c").over(by_doc().orderBy("sent_no"))).filter("before IS NOT NULL")
    s = s.withColumn("all", F.size(F.array_union("before", "c"))).filter("all > 0")
    agg = s.groupBy("doc_id").agg(F.avg(F.size(F.array_intersect("before", "c")) / F.col("all")).alias("o"))
    return _on_all(p, agg).select("doc_id", F.round(_zero("o"), 4).cast("double").alias("adjacent_overlap"))


def chunk_signals(p: Parsed, chunks: int = 8) -> DataFrame:
    """Valence of eight equal chunks (null where too few words carry any) and how few words all chunks share."""
    toks = p.tokens.select("doc_id", "pos", "lword").withColumn("n", F.count(F.lit(1)).over(by_doc()))
    w = F.col("lword")
    toks = toks.withColumns({"pos_w": w.isin(*sorted(lx.POSITIVE)).cast("int"), "neg_w": w.isin(*sorted(lx.NEGATIVE)).cast("int")})
    toks = toks.withColumn("chunk", F.when(F.col("n") < chunks * 4, 0).otherwise(F.floor(F.col("pos") / F.floor(F.col("n") / chunks)))).withColumn("of", F.when(F.col("n") < chunks * 4, 1).otherwise(chunks))
    matched = toks.groupBy("doc_id").agg(F.sum(F.col("pos_w") + F.col("neg_w")).alias("matched"), F.max("of").alias("of"))
    inside = toks.filter("chunk < of")
    per = inside.groupBy("doc_id", "chunk").agg(F.sum("pos_w").alias("a"), F.sum("neg_w").alias("b"))
    per = per.withColumn("v", _ratio(F.col("a") - F.col("b"), F.col("a") + F.col("b")))
    valence = per.groupBy("doc_id").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    themes = inside.filter(~w.isin(*sorted(lx.FUNCTION_WORDS)) & (F.length("lword") > 3)).groupBy("doc_id", "lword").agg(F.countDistinct("chunk").alias("in"))
    themes = themes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("all"), F.sum((F.col("in") == chunks).cast("int")).alias("shared"))
    j = _on_all(p, matched).join(valence, "doc_id", "left").join(themes, "doc_id", "left")
    enough = (_zero("matched") >= 15) & (F.col("of") > 1)
    spread = F.when((F.col("of") > 1) & (_zero("all") > 0), 1 - F.col("shared") / F.col("all")).otherwise(0.0)
    return j.select(
        "doc_id",
        F.when(enough, F.round("mean", 3)).alias("mean_sentiment"),
        F.when(enough, F.round("var", 4)).alias("sentiment_variance"),
        _zero("matched").cast("long").alias("valence_tokens"),
        F.round(spread, 4).alias("topic_spread"),
    )


def devices(p: Parsed) -> DataFrame:
    """How many rhetorical devices occur, and the share of the commonest."""
    counts = [tx.count(F.col("text"), q).cast("long").alias(k) for k, q in pt.DEVICES.items()]
    d = p.docs.select("doc_id", *counts)
    total = sum((F.col(k) for k in list(pt.DEVICES)[1:]), F.col(next(iter(pt.DEVICES))))
    variety = sum(((F.col(k) > 0).cast("int") for k in list(pt.DEVICES)[1:]), (F.col(next(iter(pt.DEVICES))) > 0).cast("int"))
    return d.select("doc_id", *pt.DEVICES, variety.cast("long").alias("device_variety"), F.round(_ratio(F.greatest(*pt.DEVICES), total), 3).alias("device_concentration"))


def readability(p: Parsed) -> DataFrame:
    """Rhythm, subordination, SMOG and plain type-token ratio."""
    w = F.col("lword")
    freq = word_frequencies(p).withColumn("poly", tx.syllables(w) >= 3)
    freq = freq.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"), F.sum(F.when(F.col("poly"), F.col("n")).otherwise(0)).alias("poly"))
    sent = p.sentences.groupBy("doc_id").agg(F.count(F.lit(1)).alias("s"), F.stddev_pop("n_words").alias("sd"), F.avg("n_words").alias("mean"))
    base = p.docs.select("doc_id", tx.count(F.col("text"), pt.SUBORDINATORS).alias("subs"))
    j = base.join(freq, "doc_id", "left").join(sent, "doc_id", "left")
    s = F.greatest(_zero("s"), F.lit(1))
    return j.select(
        "doc_id",
        F.round(_zero("sd"), 2).cast("double").alias("sentence_rhythm"),
        F.round(F.col("subs") / s, 2).alias("subordination"),
        F.round(_zero("mean"), 2).cast("double").alias("mean_sentence_len"),
        F.round(_ratio(_zero("types"), _zero("n")), 4).alias("lexical_diversity"),
        F.round(1.0430 * F.sqrt(_zero("poly") * 30 / s) + 3.1291, 2).alias("smog"),
    )


def reader_signals(p: Parsed, audience: str = "expert") -> DataFrame:
    """All reader signals of every document."""
    if audience not in ("expert", "general"):
        raise ValueError("audience is 'expert' or 'general'")
    j = readability(p).join(adjacent_overlap(p), "doc_id").join(chunk_signals(p), "doc_id").join(devices(p).select("doc_id", "device_variety", "device_concentration"), "doc_id")
    return j.withColumn("audience", F.lit(audience))


def audited(p: Parsed, sides: DataFrame, audience: str = "expert") -> DataFrame:
    """side, feature and value of all stylometry and reader figures; a figure of both is that of the reader layer."""
    from quillon.operators.corpus import long_form

    reader = reader_signals(p, audience).drop("audience")
    style = stylometry(p).drop(*[c for c in reader.columns if c != "doc_id"])
    j = style.join(reader, "doc_id").join(sides, "doc_id")
    names = [c for c, t in j.dtypes if t in ("double", "bigint", "int") and c != "doc_id"]
    return long_form(j, names, ("side",))


def reader_notes(signals: DataFrame) -> DataFrame:
    """doc_id and the notes that hold for its audience."""
    e, g = F.col("audience") == "expert", F.col("audience") == "general"
    rules = [
        (e & F.col("mean_sentiment").isNull(), "too few valence words to judge sentiment"),
        (e & (F.col("mean_sentiment") > 0.35), "even positive tone"),
        (e & (F.col("sentiment_variance") < 0.05) & (F.col("device_variety") > 0), "flat affect"),
        (e & (F.col("adjacent_overlap") > 0.22), "neighbouring sentences share their words"),
        (e & (F.col("device_variety") <= 2) & (F.col("device_concentration") > 0.6), "one device carries the rhetoric"),
        (e & (F.col("topic_spread") != 0) & (F.col("topic_spread") < 0.55), "the same words in every part"),
        (g & (F.col("smog") > 14), "hard to read"),
        (g & (F.col("lexical_diversity") < 0.40), "few different words"),
        (g & (F.col("subordination") < 0.8), "few subordinate clauses"),
    ]
    return signals.select("doc_id", F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules])).alias("notes"))


def person_mix(p: Parsed) -> DataFrame:
    """Counts of first persons, and of 'you' addressed or meant for anyone."""
    s = p.sentences.select("doc_id", tx.count(F.regexp_replace("text", "(?i)" + pt.java(pt.THANKS), " "), pt.SECOND).alias("you"), is_address(F.col("text")).alias("address"))
    agg = s.groupBy("doc_id").agg(F.sum(F.when(F.col("address"), 0).otherwise(F.col("you"))).alias("generic"), F.sum(F.when(F.col("address"), F.col("you")).otherwise(0)).alias("addressed"))
    t = F.col("text")
    base = p.docs.select("doc_id", F.size(tx.words(t)).alias("n"), tx.count(t, pt.FIRST_PLURAL).alias("we"), tx.count(t, pt.FIRST_SINGULAR).alias("i"))
    j = base.join(agg, "doc_id", "left")
    words = F.greatest(F.col("n"), F.lit(1))
    return j.select(
        "doc_id",
        words.cast("long").alias("words"),
        F.col("we").cast("long").alias("first_plural"),
        F.col("i").cast("long").alias("first_singular"),
        _zero("generic").cast("long").alias("second_generic"),
        _zero("addressed").cast("long").alias("second_address"),
        F.round(_zero("generic") / words * 1000, 2).alias("generic_per_1k"),
    )


def is_address(sentence: Column) -> Column:
    """Whether 'you' in this sentence means those present."""
    t = tx.strip(sentence)
    return t.endswith("?") | tx.has(t, pt.APPEAL) | tx.has(t, pt.FIRST_SINGULAR)
