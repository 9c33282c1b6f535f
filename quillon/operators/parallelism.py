"""Runs of parallel units, and balanced pairs.

Units are clause segments, sentences and paragraphs. A run is a maximal island of three or more units
of one skeleton, or with one opening word; a pair is two neighbours of near-equal length that share an
opening or an antithesis. Runs contained in others go: sorted by start, longest first, one is contained
exactly if it ends no later than the furthest end before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import lexicons as lx
from quillon.functions import patterns as pt
from quillon.functions import text as tx
from quillon.operators.parse import Parsed

MIN_RUN, LONGEST_UNIT = 3, 14


def _skeleton(ws: Column) -> Column:
    """Classes of the first two words and a coarse length; null for empty and long units."""
    functional = sorted(lx.FUNCTION_WORDS)

    def cls(i: int) -> Column:
        w = F.lower(F.get(ws, F.lit(i)))
        return F.when(w.isNull(), "").when(w.isin(*functional), w).otherwise("#")

    n = F.size(ws)
    return F.when((n > 0) & (n <= LONGEST_UNIT), F.concat_ws("|", cls(0), cls(1), F.floor(n / 3).cast("string")))


def _islands(units: DataFrame, keys: list[str], order: str, kinds: tuple[str, ...]) -> DataFrame:
    """Maximal islands of three or more equal non-null values of each kind: keys, kind_rank, start, end, arity, proper, texts in order.

    All kinds share one pass; a unit alone or in a pair goes before anything is gathered."""
    w = Window.partitionBy(*keys).orderBy(order)
    u = units
    for k, value in enumerate(kinds):
        u = u.withColumn(f"same{k}", F.col(value).isNotNull() & F.coalesce(F.lag(value).over(w) == F.col(value), F.lit(False)))
    near = {}
    for k in range(len(kinds)):
        same, after, later = F.col(f"same{k}"), F.coalesce(F.lead(f"same{k}").over(w), F.lit(False)), F.coalesce(F.lead(f"same{k}", 2).over(w), F.lit(False))
        near |= {f"in{k}": (same & F.coalesce(F.lag(f"same{k}").over(w), F.lit(False))) | (same & after) | (after & later), f"island{k}": F.sum(F.when(same, 0).otherwise(1)).over(w)}
    u = u.withColumns(near)
    each = F.filter(F.array(*[F.when(F.col(f"in{k}"), F.struct(F.lit(k).alias("kind_rank"), F.col(f"island{k}").alias("island"))) for k in range(len(kinds))]), lambda x: x.isNotNull())
    u = u.filter(F.greatest(F.lit(False), *[F.col(f"in{k}") for k in range(len(kinds))])).select(*keys, order, "start", "end", "text", "proper", F.explode(each).alias("i"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("text")))), lambda x: x["text"])
    return (
        u.groupBy(*keys, "i.kind_rank", "i.island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("arity"), F.min(F.coalesce("proper", F.lit(False))).alias("proper"), texts.alias("texts"))
        .filter(F.col("arity") >= MIN_RUN)
    )


def _contained_dropped(runs: DataFrame) -> DataFrame:
    """Greedy removal of contained runs; of equal ones the first by arity, then by level stays."""
    w = Window.partitionBy("doc_id").orderBy("start", F.desc(F.col("end") - F.col("start")), F.desc("arity"), "level_rank", "kind_rank")
    furthest = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("before", furthest).filter(F.col("before").isNull() | (F.col("end") > F.col("before"))).drop("before", "level_rank", "kind_rank")


def _units(df: DataFrame, order: str) -> DataFrame:
    ws = F.col("ws")  # a column of its own, so that it is worked out once a unit
    d = df.withColumn("ws", tx.words(tx.lead_stripped(F.col("text"))))
    own = F.regexp_extract("text", pt.WORD, 0)
    return d.select("*", _skeleton(ws).alias("skeleton"), F.lower(F.get(ws, F.lit(0))).alias("lead"), own.rlike("^[A-Z]").alias("proper")).drop("ws")


def _carriers_cut(segs: DataFrame) -> DataFrame:
    """skeleton of every segment, its first one without the stem and the last without the tail of the sentence.

    The length that counts is the upper median of the segments between."""
    whole = Window.partitionBy("doc_id", "sent_no")
    s = segs.withColumn("of", F.count(F.lit(1)).over(whole)).filter(F.col("of") >= MIN_RUN).withColumn("n", F.size(tx.words(F.col("text"))))
    middle = (F.col("seg_no") > 0) & (F.col("seg_no") < F.col("of") - 1)
    s = s.withColumn("lens", F.array_sort(F.collect_list(F.when(middle, F.col("n"))).over(whole)))
    s = s.withColumn("keep", F.get("lens", F.floor(F.size("lens") / 2).cast("int")))
    s = s.withColumn("own", tx.words(F.regexp_replace("text", "(?i)" + pt.java(pt.LEAD), "")))
    own = F.col("own")
    cut = F.col("keep") >= 1
    first = cut & (F.col("seg_no") == 0) & (F.size(own) > F.col("keep"))
    last = cut & (F.col("seg_no") == F.col("of") - 1) & (F.size(own) > F.col("keep"))
    trimmed = F.when(first, F.array_join(F.slice(own, F.size(own) - F.col("keep") + 1, F.col("keep")), " ")).when(last, F.array_join(F.slice(own, 1, F.col("keep")), " ")).otherwise(F.col("text"))
    s = _units(s.withColumn("trimmed", trimmed), "seg_no").withColumn("ws", tx.words(tx.lead_stripped(F.col("trimmed"))))
    return s.withColumn("skeleton", _skeleton(F.col("ws"))).drop("ws", "own", "n")


def runs(p: Parsed) -> DataFrame:
    """doc_id, start, end, level, arity, preview of the parallel runs."""
    parts = []

    def add(units: DataFrame, keys: list[str], order: str, level: str, rank: int, kinds: tuple[str, ...], width: int | None = None) -> None:
        got = _islands(units, keys, order, kinds)
        if level == "in-sentence":
            got = got.filter(~F.col("proper"))  # a list of names is no device
        texts = F.transform("texts", lambda t: F.substring(t, 1, width)) if width else F.col("texts")
        joined = F.array_join(texts, " | ")
        parts.append(got.select("doc_id", "start", "end", F.lit(level).alias("level"), "arity", (joined if width else F.substring(joined, 1, 70)).alias("preview"), F.lit(rank).alias("level_rank"), "kind_rank"))

    add(_carriers_cut(p.segments), ["doc_id", "sent_no"], "seg_no", "in-sentence", 0, ("skeleton", "lead"))
    add(_units(p.sentences.select("doc_id", "sent_no", "start", "end", "text"), "sent_no"), ["doc_id"], "sent_no", "cross-sentence", 1, ("skeleton", "lead"))
    add(_units(p.paragraphs.select("doc_id", "para_no", "start", "end", "text"), "para_no"), ["doc_id"], "para_no", "paragraph", 2, ("lead",), 22)
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return _contained_dropped(every)


def _paired(pairs: DataFrame) -> DataFrame:
    """Pairs (left, right) that are balanced, with the reason. What a test needs is a column first, worked out once."""
    functional, pronouns, negators = sorted(lx.FUNCTION_WORDS), sorted(lx.PRONOUNS), sorted(lx.NEGATORS)
    na, nb = F.size("a"), F.size("b")
    d = pairs.withColumns({"a": tx.words(tx.lead_stripped(F.col("left"))), "b": tx.words(tx.lead_stripped(F.col("right")))})
    d = d.filter(na.between(2, LONGEST_UNIT) & nb.between(2, LONGEST_UNIT) & (F.abs(na - nb) <= 3))
    d = d.withColumns({"la": F.transform("a", F.lower), "lb": F.transform("b", F.lower), "neg_a": tx.has(F.col("left"), pt.NEGATOR), "neg_b": tx.has(F.col("right"), pt.NEGATOR)})
    d = d.withColumn("anchor", F.array_min(F.filter(F.array_intersect("la", "lb"), lambda w: ~w.isin(*pronouns) & (~w.isin(*functional) | w.isin(*negators)))))
    strong = tx.has(F.col("left"), pt.STRONG_NEGATOR) != tx.has(F.col("right"), pt.STRONG_NEGATOR)
    a0, a1 = F.get("la", F.lit(0)), F.get("la", F.lit(1))
    same, anchor = a0 == F.get("lb", F.lit(0)), F.col("anchor")
    reason = (
        F.when(same & ~a0.isin(*pronouns), F.concat(F.lit("anaphora on '"), a0, F.lit("'")))
        .when(same & (a1 == F.get("lb", F.lit(1))), F.concat(F.lit("repeated opening '"), F.get("a", F.lit(0)), F.lit(" "), F.get("a", F.lit(1)), F.lit("'")))
        .when(same & (F.abs(na - nb) <= 2) & strong, F.lit("antithesis, same opening"))
        .when((F.col("neg_a") != F.col("neg_b")) & anchor.isNotNull(), F.concat(F.lit("antithesis on '"), anchor, F.lit("'")))
        .when(F.col("neg_a") & F.col("neg_b") & anchor.isin(*negators), F.concat(F.lit("negated pair on '"), anchor, F.lit("'")))
    )
    return d.withColumn("reason", reason).filter("reason IS NOT NULL")


def doublets(p: Parsed) -> DataFrame:
    """doc_id, start, end, reason, preview of the balanced pairs."""
    parts = []
    for df, keys, order, rank in ((p.segments, ["doc_id", "sent_no"], "seg_no", 0), (p.sentences, ["doc_id"], "sent_no", 1)):
        w = Window.partitionBy(*keys).orderBy(order)
        u = df.select(*dict.fromkeys(["doc_id", *keys, order]), "start", F.col("text").alias("left"), F.lead("text").over(w).alias("right"), F.lead("end").over(w).alias("end"))
        u = _paired(u.filter("right IS NOT NULL"))
        shown = F.substring(F.concat(tx.strip(F.col("left")), F.lit(" | "), tx.strip(F.col("right"))), 1, 70)
        parts.append(u.select("doc_id", "start", "end", "reason", shown.alias("preview"), F.lit(2).alias("arity"), F.lit(rank).alias("level_rank"), F.lit(0).alias("kind_rank")))
    return _contained_dropped(parts[0].unionByName(parts[1])).drop("arity")
