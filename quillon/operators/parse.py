"""Texts to paragraphs, sentences, tokens and clause segments, each with offsets into the text.

Documents are placed by ``doc_id`` once. Everything below is cut out of a document by expressions and
numbered by windows over ``doc_id``, which keep that placement, so no further exchange is needed.
What asks for units many times works on ``Parsed.settled``, whose units are written once.

Offsets are code points from 0, end exclusive. A null or empty text has no units.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import patterns as pt
from quillon.functions import text as tx
from quillon.functions.patterns import WS, java
from quillon.session import default_parallelism, placed


def prepare(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "path", mask: bool = True, marker: str = "prose", skip_code: bool = True) -> DataFrame:
    """doc_id and text, masked, placed by doc_id. Other columns are left out."""
    wanted = [F.col(key).alias("doc_id"), tx.prepared(F.col(text).cast("string")).alias("text")]
    out = df.select(*wanted, *([F.col(path).cast("string").alias("path")] if mask and path else []))
    if mask:
        out = tx.mask(out, "path" if path else None, marker, skip_code)
    # the number is given, as parsing costs far more a byte than adaptive planning reckons with when it merges partitions
    return out.select("doc_id", "text").repartition(default_parallelism(df.sparkSession), "doc_id")


def _starts(order: list[str], length: Column) -> Column:
    w = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(length).over(w), F.lit(0)).cast("int")


def _trimmed(df: DataFrame, piece: str, start: str) -> DataFrame:
    """start, end and text without the blanks around; empty pieces go."""
    out = df.withColumn("t", tx.strip(F.col(piece))).filter("t <> ''")
    out = out.withColumn("start", (F.col(start) + tx.lead_blanks(F.col(piece))).cast("int"))
    return out.withColumn("end", (F.col("start") + F.length("t")).cast("int")).drop(piece, start).withColumnRenamed("t", "text")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, para_no, line_no, start, end, text, n_words."""
    cut = docs.select("doc_id", F.posexplode(tx.paragraph_pieces(F.col("text"))).alias("i", "piece"))
    lead = F.length(F.regexp_extract("piece", f"^{WS}*", 0)) - F.length(F.translate(F.regexp_extract("piece", f"^{WS}*", 0), "\n", ""))
    breaks = F.length("piece") - F.length(F.translate(F.col("piece"), "\n", ""))
    cut = cut.withColumns({"at": _starts(["i"], F.length("piece")), "line_no": _starts(["i"], breaks) + lead + 1})
    cut = _trimmed(cut, "piece", "at")
    order = Window.partitionBy("doc_id").orderBy("i")
    return cut.select("doc_id", (F.row_number().over(order) - 1).alias("para_no"), "line_no", "start", "end", "text", F.size(tx.words(F.col("text"))).alias("n_words"))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sent_no, para_no, start, end, text, words, n_words, first_word, finite.

    A blank line ends a sentence, so each lies in one paragraph and is cut out of it."""
    cut = docs.select("doc_id", F.posexplode(tx.paragraph_pieces(F.col("text"))).alias("i", "para"))
    cut = cut.select("doc_id", "i", F.posexplode(tx.sentence_pieces(F.col("para"))).alias("j", "piece"))
    cut = _trimmed(cut.withColumn("at", _starts(["i", "j"], F.length("piece"))), "piece", "at")
    order = Window.partitionBy("doc_id").orderBy("i", "j")
    ws = tx.words(F.col("text"))
    out = cut.withColumn("sent_no", F.row_number().over(order) - 1).withColumn("para_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("i")) - 1)
    out = out.withColumn("words", ws)
    return out.select(
        "doc_id",
        "sent_no",
        "para_no",
        "start",
        "end",
        "text",
        "words",
        F.size("words").alias("n_words"),
        F.lower(F.get("words", F.lit(0))).alias("first_word"),
        tx.has_finite_verb(F.col("words")).alias("finite"),
    )


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pos, start, end, word, lword."""
    zipped = F.arrays_zip(F.split(F.col("text"), java(pt.WORD), -1).alias("gap"), tx.words(F.col("text")).alias("word"))
    cut = docs.select("doc_id", F.posexplode(zipped).alias("pos", "z")).select("doc_id", "pos", F.length("z.gap").alias("gap"), "z.word")
    cut = cut.withColumn("at", _starts(["pos"], F.col("gap") + F.coalesce(F.length("word"), F.lit(0))))
    cut = cut.filter("word IS NOT NULL").withColumn("start", (F.col("at") + F.col("gap")).cast("int"))
    return cut.select("doc_id", "pos", "start", (F.col("start") + F.length("word")).cast("int").alias("end"), "word", F.lower("word").alias("lword"))


def segments(sents: DataFrame) -> DataFrame:
    """doc_id, sent_no, seg_no, start, end, text: clauses between , ; : outside brackets and quotes.

    Sentences are cut after every separator, bracket and double quote. Running counts over the pieces tell
    how deep in brackets each ends (a closing one too many counts for nothing) and whether in quotes; what
    no separator outside both parts is put together again. With two or more segments, a coordination in
    the last one is cut at its first conjunction."""
    sep = rf"[,;:]{WS}+"
    pieces = F.split(F.regexp_replace(F.translate(F.col("text"), tx.SEP, " "), rf"[(\[{{)\]}}\"“”]|{sep}", "$0" + tx.SEP), tx.SEP)
    cut = sents.select("doc_id", "sent_no", F.col("start").alias("base"), F.posexplode(pieces).alias("j", "piece"))
    w = Window.partitionBy("doc_id", "sent_no").orderBy("j")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.substring("piece", -1, 1)
    cut = cut.withColumns({"at": F.col("base") + F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)), "sum": F.sum(last.isin("(", "[", "{").cast("int") - last.isin(")", "]", "}").cast("int")).over(so_far), "quotes": F.sum(last.isin('"', "“", "”").cast("int")).over(so_far)})
    deep = F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far))
    ends = F.col("piece").rlike(f"{sep}$") & (deep == 0) & (F.col("quotes") % 2 == 0)
    cut = cut.withColumn("ends", ends.cast("int")).withColumn("seg", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "piece"))), lambda x: x["piece"]), "")
    cut = cut.groupBy("doc_id", "sent_no", "seg").agg(F.min("at").alias("at"), F.max("ends").alias("ends"), joined.alias("piece"))
    cut = cut.withColumn("t", F.when(F.col("ends") == 1, F.regexp_replace("piece", f"{sep}$", "")).otherwise(F.col("piece"))).filter(tx.strip(F.col("t")) != "")
    w = Window.partitionBy("doc_id", "sent_no").orderBy("seg")
    whole = Window.partitionBy("doc_id", "sent_no")
    cut = cut.withColumn("of", F.count(F.lit(1)).over(whole)).withColumn("nth", F.row_number().over(w))
    coordination = "(?iu)" + java(pt.COORDINATION)
    arms = F.split("t", coordination, 2)
    split = (F.col("of") >= 2) & (F.col("nth") == F.col("of")) & F.col("t").rlike(coordination)
    first = F.struct(F.lit(0).alias("k"), F.lit(0).alias("off"), F.get(arms, F.lit(0)).alias("t"))
    second = F.struct(F.lit(1).alias("k"), (F.length("t") - F.length(F.get(arms, F.lit(1)))).alias("off"), F.get(arms, F.lit(1)).alias("t"))
    only = F.struct(F.lit(0).alias("k"), F.lit(0).alias("off"), F.col("t").alias("t"))
    cut = cut.select("doc_id", "sent_no", "seg", "at", F.explode(F.when(split, F.array(first, second)).otherwise(F.array(only))).alias("a"))
    order = Window.partitionBy("doc_id", "sent_no").orderBy("seg", "a.k")
    cut = cut.withColumn("seg_no", F.row_number().over(order) - 1).withColumn("start", (F.col("at") + F.col("a.off")).cast("int"))
    return cut.select("doc_id", "sent_no", "seg_no", "start", (F.col("start") + F.length("a.t")).cast("int").alias("end"), F.col("a.t").alias("text"))


@dataclass
class Parsed:
    """The units of a set of documents, each built when first asked for."""

    docs: DataFrame
    kept: bool = False

    def _kept(self, units: DataFrame) -> DataFrame:
        return placed(units) if self.kept else units

    @cached_property
    def settled(self) -> Parsed:
        """The same with its texts, sentences and segments written once, for what asks for them many times."""
        return self if self.kept else Parsed(placed(self.docs), kept=True)

    @cached_property
    def paragraphs(self) -> DataFrame:
        return self._kept(paragraphs(self.docs))

    @cached_property
    def sentences(self) -> DataFrame:
        return self._kept(sentences(self.docs))

    @cached_property
    def tokens(self) -> DataFrame:
        return tokens(self.docs)

    @cached_property
    def segments(self) -> DataFrame:
        return self._kept(segments(self.sentences))

    @cached_property
    def sizes(self) -> DataFrame:
        """doc_id and its number of words."""
        return self._kept(self.docs.select("doc_id", F.size(tx.words(F.col("text"))).alias("n_words")))


def parse(df: DataFrame, **options) -> Parsed:
    return Parsed(prepare(df, **options))
