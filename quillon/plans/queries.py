"""The registered queries: each applies one operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import patterns as pt
from quillon.functions import text as tx
from quillon.operators import corpus, features, parallelism, review, rules
from quillon.operators.parse import Parsed, parse
from quillon.plans.seeds import TRIGGERS
from quillon.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _parsed(spark: SparkSession, d: str) -> Parsed:
    return parse(_docs(spark, d))


def seeded(df: DataFrame) -> DataFrame:
    """Documents with a trigger text as a paragraph of its own at the end."""
    text = F.coalesce("text", F.lit(""))
    trigger = F.element_at(F.array(*[F.lit(t) for t in TRIGGERS]), (F.length(text) % len(TRIGGERS) + 1).cast("int"))
    return df.withColumn("text", F.concat(text, F.lit("\n\n"), trigger))


def _seeded(spark: SparkSession, d: str) -> Parsed:
    """Documents with their trigger, masked as the operators have it."""
    return parse(seeded(_docs(spark, d)))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def document_profile(spark, d):
    p = _parsed(spark, d)
    m = features.metrics(p).select("doc_id", "sentences", "words", "mean_len", "stdev_len", "cv", "pct_short", "pct_long")
    return m.join(features.stylometry(p).select("doc_id", "lexical_density"), "doc_id")


def masked_documents(spark, d):
    p = _parsed(spark, d)
    return p.docs.select("doc_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def word_counts(spark, d):
    return _parsed(spark, d).sizes.select("doc_id", F.col("n_words").cast("long").alias("n_words"))


def word_frequencies(spark, d):
    return features.word_frequencies(_parsed(spark, d))


def paragraph_spans(spark, d):
    return _parsed(spark, d).paragraphs.select("doc_id", "para_no", "start", "end", "n_words")


def sentence_spans(spark, d):
    return _parsed(spark, d).sentences.select("doc_id", "sent_no", "para_no", "start", "end", "n_words", "first_word", "finite")


def token_spans(spark, d):
    return _parsed(spark, d).tokens.select("doc_id", "pos", "start", "end", "lword")


def segment_spans(spark, d):
    return _parsed(spark, d).segments


def sentence_metrics(spark, d):
    return features.metrics(_parsed(spark, d))


def metric_warnings(spark, d):
    w = features.metric_warnings(features.metrics(_parsed(spark, d)))
    return w.select("doc_id", F.array_join("warnings", "; ").alias("warnings"))


def cadence(spark, d):
    return features.cadence(_parsed(spark, d))


def stylometry(spark, d):
    return features.stylometry(_parsed(spark, d))


def adjacent_overlap(spark, d):
    return features.adjacent_overlap(_parsed(spark, d))


def chunk_signals(spark, d):
    return features.chunk_signals(_parsed(spark, d))


def device_counts(spark, d):
    return features.devices(_seeded(spark, d)).drop("repetition", "device_variety", "device_concentration")


def device_mix(spark, d):
    return features.devices(_seeded(spark, d)).select("doc_id", "device_variety", "device_concentration")


def readability(spark, d):
    return features.readability(_parsed(spark, d))


def reader_notes(spark, d):
    n = features.reader_notes(features.reader_signals(_parsed(spark, d)))
    return n.select("doc_id", F.array_join("notes", "; ").alias("notes"))


def person_mix(spark, d):
    return features.person_mix(_seeded(spark, d))


def punch_scores(spark, d):
    return review.punch(_parsed(spark, d))


PATTERN_RULES = [r.id for r in pt.RULES.values() if r.patterns]


def pattern_rule_counts(spark, d):
    p = _seeded(spark, d)
    found = rules.pattern_hits(p, PATTERN_RULES)
    return rules.counts(found, p.docs, spark).filter(F.col("rule_id").isin(*PATTERN_RULES))


def pattern_rule_hits(spark, d):
    return rules.pattern_hits(_seeded(spark, d), PATTERN_RULES)


def _rule(name):
    def run(spark, d):
        c = rules.Config(min_sentence_words=5, person_budget_per_1k=0.0)
        return rules.BUILT[name](_seeded(spark, d), c)

    return run


def vocab_hits(spark, d):
    return _rule("vocab")(spark, d).select("doc_id", "start", "end", "text")


def fragment_runs(spark, d):
    return _rule("fragments")(spark, d).select("doc_id", "start", "end", "note")


def opener_runs(spark, d):
    return _rule("opener")(spark, d).select("doc_id", "start", "end", "text")


def question_openers(spark, d):
    return _rule("question")(spark, d).select("doc_id", "start", "end", "text")


def template_hits(spark, d):
    return _rule("template")(spark, d).select("doc_id", "start", "end", "text", "note")


def runt_sentences(spark, d):
    return _rule("runt")(spark, d).select("doc_id", "start", "end", "text", "note")


def closers_over_budget(spark, d):
    return _rule("closer")(spark, d).select("doc_id", "start", "end", "text", "note")


def vague_paragraphs(spark, d):
    return _rule("vague")(spark, d).select("doc_id", "start", "end", "note")


def specifics_counts(spark, d):
    p = _seeded(spark, d)
    return p.docs.select("doc_id", rules.specifics(F.col("text")).cast("long").alias("specifics"))


def generic_you(spark, d):
    return _rule("person")(spark, d).select("doc_id", "start", "end", "text")


def parallel_runs(spark, d):
    return parallelism.runs(_parsed(spark, d))


def parallel_over_budget(spark, d):
    return _rule("parallel")(spark, d)


def doublet_pairs(spark, d):
    return parallelism.doublets(_parsed(spark, d))


def doublets_over_budget(spark, d):
    return _rule("doublet")(spark, d)


def all_rule_counts(spark, d):
    p = _seeded(spark, d)
    return rules.counts(rules.hits(p, rules.Config(min_sentence_words=5)), p.docs, spark)


def _templates():
    from quillon.operators import templates  # brings pandas in, which other queries need not have

    return templates


def tag_ngram_repeat(spark, d):
    return _templates().repeat_mass(_parsed(spark, d), 4)


def template_rates(spark, d):
    return _templates().template_rates(_parsed(spark, d))


def top_templates(spark, d):
    return _templates().top_templates(_parsed(spark, d))


def compression_ratio(spark, d):
    return _templates().compression_ratio(_parsed(spark, d))


def structure_against_chance(spark, d):
    return _templates().against_chance(_parsed(spark, d))


def _noted(spark, d):
    """The delivered hits once each, with the rule names of the rule table, and the results they are of."""
    found = table(spark, d, "hits").dropDuplicates(["hit_id"])
    found = found.withColumn("rule_id", F.regexp_replace(F.lower("rule_id"), r"[^a-z]", ""))
    found = found.select(F.col("result_id").alias("doc_id"), "rule_id", F.col("start_off").alias("start"), F.col("end_off").alias("end"), "text", "note")
    docs = table(spark, d, "results").select(F.col("result_id").alias("doc_id"), "side", F.size(tx.words(F.coalesce("text", F.lit("")))).alias("n_words"))
    return found, docs


def _audit(spark, d):
    found, docs = _noted(spark, d)
    counts = found.filter(F.col("rule_id").isin(*pt.RULES)).groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    return corpus.rule_audit(corpus.rule_rates(docs.filter(F.col("side").isin("machine", "human")), counts))


def rule_audit(spark, d):
    return _audit(spark, d)


def measured_weights(spark, d):
    return corpus.measured_weights(_audit(spark, d))


def pinned_weights(spark, d):
    w = corpus.pinned(corpus.measured_weights(_audit(spark, d)), {"vocab": 3.0, "doublet": 5.0, "closer": 0.0})
    return w.select("rule_id", "weight", "pin", "effective", F.coalesce(F.abs(F.col("pin") - F.col("weight")) > 0.5, F.lit(False)).alias("disagrees"))


def weighted_scores(spark, d):
    found, docs = _noted(spark, d)
    return review.scores(found, docs.select("doc_id", "n_words"))


def feature_audit(spark, d):
    docs = _docs(spark, d)
    style = features.stylometry(parse(docs, mask=False)).join(docs.select("doc_id", "side"), "doc_id")
    names = [c for c, t in style.dtypes if t in ("double", "bigint") and c != "doc_id"]
    return corpus.feature_audit(corpus.long_form(style, names, ("side",)))


def voiceprint(spark, d):
    docs = _docs(spark, d)
    style = features.stylometry(parse(docs, mask=False)).join(docs.select("doc_id", "genre"), "doc_id")
    return corpus.voiceprint(style, by="genre", strict=False)


def voice_deviations(spark, d):
    style = features.stylometry(parse(_docs(spark, d), mask=False))
    return corpus.deviations(style, corpus.voiceprint(style))


def voice_notes(spark, d):
    style = features.stylometry(parse(_docs(spark, d), mask=False))
    n = corpus.interpretation(corpus.deviations(style, corpus.voiceprint(style)))
    return n.select("doc_id", F.array_join("notes", "; ").alias("notes"))


def worst_paragraphs(spark, d):
    p = _seeded(spark, d)
    found = rules.pattern_hits(p, PATTERN_RULES)
    worst = review.worst_paragraphs(review.paragraph_scores(p, found))
    return worst.select("doc_id", "para_index", "line_no", "words", "hits", "weighted", F.array_join(F.array_sort("rules"), ",").alias("rules"), "place")


def review_documents(spark, d):
    p = _seeded(spark, d)
    r = review.review(p, rules.Config(max_hits=3))
    return r.select("doc_id", "passed", "total", "over", F.to_json("instructions").alias("instructions"), "worst", F.array_join("notes", "; ").alias("notes"))


def _revisions(spark, d) -> DataFrame:
    docs = _docs(spark, d)
    after = docs.select(F.col("doc_id").alias("pair_id"), F.lit("after").alias("side"), F.coalesce("text", F.lit("")).alias("text"))
    before = seeded(docs).select(F.col("doc_id").alias("pair_id"), F.lit("before").alias("side"), "text")
    return before.unionByName(after)


def drift_verdicts(spark, d):
    """Documents with and without the trigger text, judged by the rules that are patterns."""
    return review.drift(_revisions(spark, d), found=lambda p, c: rules.pattern_hits(p, PATTERN_RULES))


def drift_all_rules(spark, d):
    return review.drift(_revisions(spark, d))


def alignment_scores(spark, d):
    """Every pair of neighbouring sentences, by their word classes."""
    from pyspark.sql import Window

    from quillon.functions import lexicons as lx
    from quillon.operators import sequence

    functional = sorted(lx.FUNCTION_WORDS)
    cls = F.transform(F.transform("words", F.lower), lambda w: F.when(w.isin(*functional), w).otherwise("#"))
    s = _parsed(spark, d).sentences.select("doc_id", "sent_no", cls.alias("a"))
    s = s.withColumn("b", F.lead("a").over(Window.partitionBy("doc_id").orderBy("sent_no"))).filter("b IS NOT NULL")
    return s.select("doc_id", "sent_no", sequence.alignment(F.col("a"), F.col("b")).alias("r")).select("doc_id", "sent_no", "r.*")


def perplexity_windows(spark, d):
    from quillon.operators import sequence

    return sequence.own_perplexity(_parsed(spark, d))


def reader_audit(spark, d):
    """Effect sizes of the reader layer beside those of stylometry, between the two sides."""
    docs = _docs(spark, d)
    return corpus.feature_audit(features.audited(parse(docs, mask=False), docs.select("doc_id", "side")))


def profile_scores(spark, d):
    """Scores of the delivered hits under the weights that each profile pins."""
    from quillon.sources import config

    found, docs = _noted(spark, d)
    parts = [review.scores(found, docs.select("doc_id", "n_words"), config.profile_weights(spark, n)).select(F.lit(n).alias("profile"), "*") for n in config.PROFILES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_NAMES = """document_profile masked_documents word_counts word_frequencies paragraph_spans sentence_spans token_spans segment_spans sentence_metrics metric_warnings cadence
stylometry adjacent_overlap chunk_signals device_counts device_mix readability reader_notes person_mix punch_scores pattern_rule_counts pattern_rule_hits vocab_hits fragment_runs
opener_runs question_openers template_hits runt_sentences closers_over_budget vague_paragraphs specifics_counts generic_you parallel_runs parallel_over_budget doublet_pairs
doublets_over_budget all_rule_counts tag_ngram_repeat template_rates top_templates compression_ratio structure_against_chance rule_audit measured_weights pinned_weights
weighted_scores feature_audit voiceprint voice_deviations voice_notes worst_paragraphs review_documents drift_verdicts drift_all_rules alignment_scores perplexity_windows
reader_audit profile_scores""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
