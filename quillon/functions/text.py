"""Column functions over text: words, masks, spans, syllables, word classes, verbs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import lexicons as lx
from quillon.functions import patterns as pt
from quillon.functions.patterns import WS, java

SEP = "\u0001"  # cut mark; taken out of texts before cutting


def prepared(text: Column) -> Column:
    """A text without the cut mark; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SEP, " ")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(pt.WORD), F.lit(0))


def count(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Matches of a pattern."""
    return F.regexp_count(text, F.lit(("(?i)" if ignore_case else "") + java(pattern)))


def has(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + java(pattern))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def lead_blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"^{WS}+", ""))


def paragraph_pieces(text: Column) -> Column:
    """The text cut before every blank line; pieces add up to the text."""
    return F.split(F.regexp_replace(text, rf"\n(?={WS}*\n)", SEP + "\n"), SEP)


def sentence_pieces(text: Column) -> Column:
    """The text cut after every end of a sentence; pieces add up to the text.

    An end is a run of . ! ? with blanks or the end behind it, closing quotes and brackets between
    allowed; but not behind a listed abbreviation or a single capital initial."""
    cut = F.regexp_replace(text, rf"([.!?]+)(?=[\"')\]]*(?:{WS}|\z))", "$1" + SEP)
    abbreviations = "|".join(a.replace(".", r"\.") for a in lx.ABBREVIATIONS)
    cut = F.regexp_replace(cut, rf"\b((?i:{abbreviations})\.){SEP}", "$1")
    cut = F.regexp_replace(cut, rf"\b([A-Z]\.){SEP}", "$1")
    return F.split(cut, SEP)


def matches(docs: DataFrame, patterns: list[tuple[str, str, bool]]) -> DataFrame:
    """doc_id, name, start, end, text of every match of every pattern (name, pattern, whether case is ignored).

    One pass cuts each text by the patterns it has; running sums of the lengths of matches and of what lies
    between tell where they stand, so the work grows with their number and no row carries more than its match."""
    cuts = []
    for i, (name, q, ignore_case) in enumerate(patterns):
        q = ("(?i)" if ignore_case else "") + q
        found = F.regexp_extract_all("text", F.lit(q), F.lit(0))
        gaps = F.transform(F.split("text", q, -1), F.length)
        cuts.append(F.when(F.col("text").rlike(q), F.struct(F.lit(i).alias("q"), F.lit(name).alias("name"), F.arrays_zip(gaps.alias("gap"), found.alias("found")).alias("z"))))
    per = docs.select("doc_id", F.explode(F.array(*cuts)).alias("c")).filter("c IS NOT NULL")
    per = per.select("doc_id", "c.q", "c.name", F.posexplode("c.z").alias("i", "z")).select("doc_id", "q", "name", "i", F.col("z.gap").alias("gap"), F.col("z.found").alias("text")).filter("text IS NOT NULL")
    before = Window.partitionBy("doc_id", "q").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("end", F.sum(F.col("gap") + F.length("text")).over(before).cast("int"))
    return per.select("doc_id", "name", (F.col("end") - F.length("text")).alias("start"), "end", "text")


def masked_by(text: Column, pattern: str) -> Column:
    """The text with every match blanked, line breaks kept, so that all offsets stay."""
    gaps = F.split(text, pattern, -1)
    blank = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.regexp_replace(m, r"[^\n]", " "))
    joined = F.array_join(F.zip_with(gaps, blank, lambda g, b: F.concat(g, F.coalesce(b, F.lit("")))), "")
    return joined


def suppression_pattern(marker: str) -> str:
    """From a line that switches checking off to the line that switches it on, or to the end."""
    m = rf"\b{marker}:{WS}*"
    return rf"(?i)[^\n]*{m}off\b[^\n]*(?:\n(?:[^\n]*\n)*?[^\n]*{m}on\b[^\n]*|(?:\n[^\n]*)*\z)"


FENCE = r"(?ms)^```.*?^```"
FURNITURE = (
    r"(?m)^#{1,6} [^\n]*$",
    r"(?m)^[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]+",
    r"(?m)^[ \t]*!\[[^\]]*\]\([^)]*\)[ \t]*$",
)


def mask(df: DataFrame, path: str | None = "path", marker: str = "prose", skip_code: bool = True) -> DataFrame:
    """The column ``text`` with suppressed regions blanked; code blocks and furniture too in Markdown files.

    One column step per pattern: as one nested expression each would be worked out many times over."""
    md = F.coalesce(F.col(path).rlike(r"\.(md|markdown)\z"), F.lit(False)) if path else F.lit(False)
    off = suppression_pattern(marker)
    steps = [(off, F.lower("text").contains(f"{marker.lower()}:"))]
    if path:
        steps += [(FENCE, md & F.col("text").contains("```"))] if skip_code else []
        steps += [(q, md & F.col("text").rlike(q)) for q in FURNITURE]
    for pattern, where in steps:
        df = df.withColumn("text", F.when(where, masked_by(F.col("text"), pattern)).otherwise(F.col("text")))
    return df


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent e at the end; at least one for a word."""
    w = F.regexp_replace(F.lower(word), "^'+|'+$", "")
    n = F.regexp_count(w, F.lit(pt.VOWELS))
    silent = w.endswith("e") & ~w.rlike("(le|ee|ye)$") & (n > 1)
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), n - silent.cast("int")))


def word_class(word: Column) -> Column:
    """A stand-in for the part of speech: function words as themselves, others by shape and ending."""
    w = F.translate(F.lower(word), "’", "'")
    out = F.when(word.rlike("[0-9]"), "9").when(w.isin(*sorted(lx.FUNCTION_WORDS)), w).when(word.rlike("^[A-Z]"), "^")
    for name, endings in pt.CLASS_SUFFIXES:
        out = out.when(w.rlike(f"({'|'.join(endings)})$"), name)
    return out.when(w.rlike("(^|[^s])s$"), "~pl").otherwise("~n")


def has_finite_verb(ws: Column) -> Column:
    """Whether any of the words is, or contracts, a finite form, or ends like a verb."""
    finite = sorted(lx.FINITE_FORMS)

    def verb(word: Column) -> Column:
        w = F.translate(F.lower(word), "’", "'")
        stem = F.regexp_replace(w, "(?<=.)n't$", "")
        return w.isin(*finite) | w.rlike(".'(s|re|ve|ll|d|m)$") | stem.isin(*finite) | w.rlike(r"^\w{3,}ed$|^\w{2,}ing$")

    return F.exists(ws, verb)


def lead_stripped(text: Column) -> Column:
    """The text without blanks around it and without a conjunction in front."""
    return F.regexp_replace(strip(text), "(?i)" + java(pt.LEAD), "")
