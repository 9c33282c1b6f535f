"""Rules: each gives hits (doc_id, rule_id, start, end, text, note) over parsed documents.

A disabled rule is not built at all. Rules that only match patterns share one scan of the text; rules
on sentences, paragraphs and words are windows over ``doc_id``. A budget forgives the mildest hits:
they are ranked inside the document and those within the allowance are dropped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import lexicons as lx
from quillon.functions import patterns as pt
from quillon.functions import text as tx
from quillon.operators import parallelism
from quillon.operators.features import is_address
from quillon.operators.parse import Parsed
from quillon.session import own

HITS = ["doc_id", "rule_id", "start", "end", "text", "note"]


@dataclass(frozen=True)
class Config:
    """What an analysis is to do; None turns a threshold or budget off."""

    disabled: tuple[str, ...] = ()
    allow: frozenset[str] = frozenset()
    min_sentence_words: int = 0
    runt_mode: str = "verbless"
    allow_runts: frozenset[str] = frozenset()
    parallel_budget_per_1k: float = 1.0
    closer_budget_ratio: float = 0.25
    doublet_budget_per_1k: float = 2.0
    vague_min_words: int = 40
    person_budget_per_1k: float | None = None
    max_choppiness: float | None = None
    max_hits: int | None = None
    max_per_1k: float | None = None
    skip_code_blocks: bool = True
    z_threshold: float = 2.0
    audience: str | None = None

    def __post_init__(self) -> None:
        unknown = set(self.disabled) - set(pt.RULES)
        if unknown:
            raise ValueError(f"unknown rules: {', '.join(sorted(unknown))}")


#: added by register_rule: id -> function of (Parsed, Config) giving hits
EXTRA: dict[str, Callable[[Parsed, Config], DataFrame]] = {}


def register_rule(rule: pt.Rule, hits: Callable[[Parsed, Config], DataFrame] | None = None) -> None:
    """Add a rule: by its patterns, or by a function that gives doc_id, start, end, text and note."""
    if not rule.patterns and hits is None:
        raise ValueError("a rule needs patterns or a function")
    pt.RULES[rule.id] = rule
    if hits is not None:
        EXTRA[rule.id] = hits


def _hits(df: DataFrame, rule: str | Column, text: Column, note: Column | str = "") -> DataFrame:
    return df.select(
        "doc_id",
        (F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"),
        F.col("start").cast("int").alias("start"),
        F.col("end").cast("int").alias("end"),
        text.alias("text"),
        (F.lit(note) if isinstance(note, str) else note).alias("note"),
    )


def pattern_hits(p: Parsed, rules: list[str]) -> DataFrame:
    """Every match of every pattern of the rules; patterns of one rule may overlap and all count."""
    found = tx.matches(p.docs, [(r, pt.java(q), r not in pt.CASE_SENSITIVE) for r in rules for q in pt.RULES[r].patterns])
    shown = F.when(F.col("name").isin(*pt.CASE_SENSITIVE), F.col("text")).otherwise(tx.strip(F.col("text")))
    return _hits(found, F.col("name"), shown)


def vocab(p: Parsed, c: Config) -> DataFrame:
    """Words of the list in their exact form, unless quoted or allowed."""
    wanted = sorted(lx.EXCESS_VOCABULARY - set(c.allow))
    t = p.tokens.withColumn("w", F.translate("lword", "’", "'")).filter(F.col("w").isin(*wanted) if wanted else F.lit(False))
    # quotations do not overlap, so a word is in one exactly if the last one begun before it has not ended
    quoted = tx.matches(p.docs, [("", pt.java(pt.QUOTED_SPAN), True)])
    events = quoted.select("doc_id", "start", F.lit(0).alias("kind"), F.col("end").alias("until")).unionByName(t.select("doc_id", "start", F.lit(1).alias("kind"), "end", "word"), allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("until", F.last("until", ignorenulls=True).over(w))
    return _hits(events.filter("kind = 1 AND coalesce(until <= start, true)"), "vocab", F.col("word"))


def fragments(p: Parsed, c: Config) -> DataFrame:
    """Three or more short sentences in a row, across paragraphs."""
    by_doc = Window.partitionBy("doc_id").orderBy("sent_no")
    s = p.sentences.withColumn("is_short", F.col("n_words") <= 7)
    s = s.withColumn("island", F.sum((~F.col("is_short")).cast("int")).over(by_doc)).filter("is_short")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("sent_no", "text"))), lambda x: x["text"])
    runs = s.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), texts.alias("texts")).filter("n >= 3")
    return _hits(runs, "fragments", F.array_join("texts", " / "), F.concat("n", F.lit(" in a row")))


def question(p: Parsed, c: Config) -> DataFrame:
    """Paragraphs whose first sentence asks."""
    first = Window.partitionBy("doc_id", "para_no").orderBy("sent_no")
    s = p.sentences.withColumn("nth", F.row_number().over(first)).filter((F.col("nth") == 1) & F.col("text").endswith("?"))
    return _hits(s, "question", F.col("text"))


def opener(p: Parsed, c: Config) -> DataFrame:
    """Three or more sentences in a row with one first word, common ones apart."""
    by_doc = Window.partitionBy("doc_id").orderBy("sent_no")
    w = F.col("first_word")
    s = p.sentences.withColumn("same", w.isNotNull() & F.coalesce(F.lag("first_word").over(by_doc) == w, F.lit(False)))
    s = s.withColumn("island", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(by_doc)).filter(w.isNotNull() & ~w.isin(*sorted(lx.PLAIN_OPENERS)))
    first = F.min(F.struct("sent_no", "text", F.get("words", F.lit(0)).alias("word"))).alias("first")
    runs = s.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), first).filter("n >= 3")
    shown = F.concat(F.substring("first.text", 1, 34), F.when(F.length("first.text") > 34, "...").otherwise(""))
    return _hits(runs, "opener", F.concat("n", F.lit("x '"), F.col("first.word"), F.lit("' from \""), shown, F.lit('"')))


def template_grams(p: Parsed, widths: tuple[tuple[int, int], ...] = ((4, 3), (6, 2))) -> DataFrame:
    """Word n-grams of each width that occur as often in a document as asked: gram, n and the place of the first.

    All widths come out of one pass over the words."""
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    most = max(n for n, _ in widths)
    t = p.tokens.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).filter("total >= 12")
    content = (~F.col("lword").isin(*sorted(lx.FUNCTION_WORDS))).cast("int")
    ahead = {f"w{i}": F.lead("lword", i).over(by_doc) for i in range(1, most)}
    t = t.withColumn("content", content)
    t = t.withColumns(ahead | {f"e{n}": F.lead("end", n - 1).over(by_doc) for n, _ in widths} | {f"c{n}": F.max("content").over(by_doc.rowsBetween(0, n - 1)) for n, _ in widths})
    grams = [F.struct(F.lit(n).alias("width"), F.lit(least).alias("least"), F.col(f"e{n}").alias("end"), F.col(f"c{n}").alias("content"), F.concat_ws(" ", "lword", *[f"w{i}" for i in range(1, n)]).alias("gram")) for n, least in widths]
    t = t.select("doc_id", "start", F.explode(F.array(*grams)).alias("g")).filter("g.end IS NOT NULL AND g.content = 1")
    found = t.groupBy("doc_id", "g.width", "g.least", "g.gram").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.min_by("g.end", "start").alias("end"))
    return found.filter("n >= least").select("doc_id", "gram", "n", "start", "end", "width")


def template(p: Parsed, c: Config) -> DataFrame:
    """Phrases used again: four words three times, six words twice; contained ones go."""
    w = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "width").rowsBetween(Window.unboundedPreceding, -1)
    g = template_grams(p).withColumn("before", F.max("end").over(w)).filter(F.col("before").isNull() | (F.col("end") > F.col("before")))
    return _hits(g, "template", F.col("gram"), F.concat("n", F.lit("x, "), "width", F.lit("-gram")))


def runt(p: Parsed, c: Config) -> DataFrame | None:
    """Sentences under the floor; in verbless mode only those without a finite verb."""
    if c.min_sentence_words < 2:
        return None
    s = p.sentences.filter(F.col("n_words") < c.min_sentence_words)
    if c.allow_runts:
        s = s.filter(~F.col("text").isin(*sorted(c.allow_runts)))
    if c.runt_mode == "verbless":
        s = s.filter(~F.col("finite"))
    return _hits(s, "runt", F.col("text"), F.concat("n_words", F.lit(f"w, floor {c.min_sentence_words}")))


def rateable(p: Parsed) -> DataFrame:
    return p.paragraphs.filter(F.col("n_words") >= 15)


def closers(p: Parsed) -> DataFrame:
    """Paragraphs of 15 words and two sentences or more that end on one of at most 8 words."""
    last = Window.partitionBy("doc_id", "para_no").orderBy(F.desc("sent_no"))
    s = p.sentences.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "para_no"))).withColumn("nth", F.row_number().over(last))
    s = s.filter("nth = 1 AND of >= 2 AND n_words <= 8")
    return s.join(rateable(p).select("doc_id", "para_no"), ["doc_id", "para_no"]).select("doc_id", "start", "end", "text", F.col("n_words").alias("words"), (~F.col("finite")).alias("verbless"))


def closer(p: Parsed, c: Config) -> DataFrame:
    """Closers beyond the share of paragraphs allowed; verbed and longer ones are forgiven first."""
    allowed = rateable(p).groupBy("doc_id").agg(F.floor(F.count(F.lit(1)) * c.closer_budget_ratio).alias("allowance"))
    w = Window.partitionBy("doc_id").orderBy("verbless", F.desc("words"), "start")
    over = closers(p).withColumn("nth", F.row_number().over(w)).join(allowed, "doc_id").filter("nth > allowance")
    note = F.concat("words", F.lit("w closer"), F.when(F.col("verbless"), ", verbless").otherwise(""))
    return _hits(over, "closer", F.col("text"), note)


def specifics(text: Column) -> Column:
    """How many numbers, units, quoted or code terms, number words and names a text has."""
    named = sum((tx.count(text, q) for q in (pt.UNIT, pt.QUOTED_TERM, pt.CODE_TERM, pt.NUMBER_WORD)), tx.count(text, pt.YEAR))
    plain = F.when(~tx.has(text, "|".join((pt.YEAR, pt.UNIT, pt.QUOTED_TERM, pt.CODE_TERM, pt.NUMBER_WORD))), tx.count(text, pt.NUMERAL)).otherwise(0)
    inside = rf"(?<![.!?]{pt.WS}{{0,20}})(?<!\A{pt.WS}{{0,20}})" + pt.PROPER
    return named + plain + tx.count(text, inside, ignore_case=False)


def vague(p: Parsed, c: Config) -> DataFrame:
    """Paragraphs long enough to owe something specific that have nothing."""
    s = p.paragraphs.filter(F.col("n_words") >= c.vague_min_words).withColumn("specifics", specifics(F.col("text"))).filter("specifics = 0")
    return _hits(s, "vague", F.substring("text", 1, 70), F.concat("n_words", F.lit("w paragraph")))


def _over_budget(found: DataFrame, p: Parsed, per_1k: float, order: list) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(*order)
    ranked = found.withColumn("nth", F.row_number().over(w)).join(p.sizes.withColumnRenamed("n_words", "doc_words"), "doc_id")
    return ranked.filter(F.col("nth") > F.floor(F.col("doc_words") / 1000 * per_1k))


def parallel(p: Parsed, c: Config) -> DataFrame:
    """Parallel runs beyond the budget; narrow and early ones are forgiven first."""
    over = _over_budget(parallelism.runs(p), p, c.parallel_budget_per_1k, ["arity", "start", "end"])
    return _hits(over, "parallel", F.col("preview"), F.concat("arity", F.lit(" units, "), "level"))


def doublet(p: Parsed, c: Config) -> DataFrame:
    """Balanced pairs beyond the budget; repeated openings are forgiven first, antitheses last."""
    r = F.col("reason")
    rank = F.when(r.contains("repeated opening"), 0).when(r.contains("anaphora"), 1).when(r.contains("negated pair"), 2).when(r.contains("antithesis"), 3).otherwise(1)
    over = _over_budget(parallelism.doublets(p), p, c.doublet_budget_per_1k, [rank, "start", "end"])
    return _hits(over, "doublet", F.col("preview"), F.concat(F.lit("doublet, "), r))


def person(p: Parsed, c: Config) -> DataFrame | None:
    """Sentences with a 'you' for anyone, beyond the budget; off without one."""
    if c.person_budget_per_1k is None:
        return None
    s = p.sentences.filter(tx.has(F.regexp_replace("text", "(?i)" + pt.java(pt.THANKS), " "), pt.SECOND) & ~is_address(F.col("text")))
    over = _over_budget(s.select("doc_id", "sent_no", "start", "end", "text"), p, c.person_budget_per_1k, ["sent_no"])
    return _hits(over, "person", F.substring("text", 1, 70), "generic 'you'")


BUILT = {
    "vocab": vocab,
    "fragments": fragments,
    "question": question,
    "opener": opener,
    "template": template,
    "runt": runt,
    "closer": closer,
    "vague": vague,
    "parallel": parallel,
    "doublet": doublet,
    "person": person,
}


def hits(p: Parsed, c: Config = Config()) -> DataFrame:
    """All hits of the enabled rules."""
    p = p.settled
    on = [r for r in pt.RULES if r not in c.disabled]
    parts = []
    by_pattern = [r for r in on if pt.RULES[r].patterns and r not in EXTRA]
    if by_pattern:
        parts.append(pattern_hits(p, by_pattern))
    for r in on:
        build = EXTRA.get(r) or BUILT.get(r)
        got = build(p, c) if build else None
        if got is not None:
            parts.append(got.select("doc_id", F.lit(r).alias("rule_id"), "start", "end", "text", "note"))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return own(every)


def rule_table(spark) -> DataFrame:
    """rule_id, severity, title, why, fix."""
    return spark.createDataFrame([(r.id, r.severity, r.title, r.why, r.fix) for r in pt.RULES.values()], "rule_id string, severity string, title string, why string, fix string")


def counts(found: DataFrame, docs: DataFrame, spark) -> DataFrame:
    """doc_id, rule_id, n for every document and every rule, zeros kept. 24 rows a document, by an expand, not a join."""
    per = found.groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    every = docs.select("doc_id", F.explode(F.array(*[F.lit(r) for r in pt.RULES])).alias("rule_id"))
    return every.join(per, ["doc_id", "rule_id"], "left").select("doc_id", "rule_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
