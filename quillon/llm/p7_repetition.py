"""Problem 7: the share of repeated content inside each text, judged by weak supervision.

Rules that each see one sign of repetition vote on every text or abstain: how many of its short word
runs, sentences and paragraphs are not new, how far it compresses, how few different words it has, and
what the hits noted for it say. Expectation-maximisation over the counts of all vote patterns
estimates how far each rule is to be trusted, and the posterior of a text's pattern takes the place of
a filter that all rules must pass: only texts that more likely than not repeat themselves are found.
An exact check of them follows, of the share of words in repeated phrases, sentences and paragraphs
together, each word once. The share itself is no voter.

Words are compared without case, width, look-alikes, punctuation and counting numbers; Chinese and
Japanese by characters, Thai too, as it writes no spaces. A phrase is six words, twelve Chinese or
Japanese and twenty Thai characters; in a mixed text each has its part of the width.

Defined results: null, empty and blank texts have share 0, as have texts of one word; repeated rows
count each; texts without hits have an abstaining voter; null ids are kept. Empty tables give empty
results. The patterns are at most 3**voters, whatever the number of texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.lookalikes import unit
from quillon.session import checkpointed

WORDS_IN_PHRASE = 6
SIGNS_IN_PHRASE = 12
THAI_SIGNS_IN_PHRASE = 20
THRESHOLD = 0.4
_SIGN = r"\p{Han}\p{Hiragana}\p{Katakana}"
_TOKEN = regex.compile(rf"[{_SIGN}\p{{Thai}}]|[\p{{L}}\p{{M}}]+(?:['’][\p{{L}}\p{{M}}]+)*|\p{{N}}+(?:[.,]\p{{N}}+)*|[.!?。！？।؟…]|\n\s*\n|\n")
_ASCII_TOKEN = re.compile(r"[a-z]+(?:'[a-z]+)*|[0-9]+(?:[.,][0-9]+)*|[.!?]|\n\s*\n|\n")
_IS_SIGN, _IS_THAI = regex.compile(f"[{_SIGN}]"), regex.compile(r"\p{Thai}")


def parts(text: str) -> tuple[list[list[str]], list[list[str]]]:
    """The words of each sentence and of each paragraph, as compared: folded, without numbers."""
    if text.isascii():
        found = _ASCII_TOKEN.findall(text.lower())
    else:
        found = _TOKEN.findall("".join(map(unit, text)).casefold())
    sentences: list[list[str]] = [[]]
    paragraphs: list[list[str]] = [[]]
    for w in found:
        c = w[0]
        if c == "\n" or c in ".!?。！？।؟…":
            if sentences[-1]:
                sentences.append([])
            if c == "\n" and len(w) > 1 and paragraphs[-1]:
                paragraphs.append([])
        elif not c.isnumeric():
            sentences[-1].append(w)
            paragraphs[-1].append(w)
    return [x for x in sentences if x], [x for x in paragraphs if x]


def width(words: list[str]) -> int:
    """Words in a phrase, by the shares of the scripts in the text."""
    signs = thai = 0
    for w in words:
        if len(w) == 1 and w > "\u0e00":
            signs += bool(_IS_SIGN.match(w))
            thai += bool(_IS_THAI.match(w))
    n = max(1, len(words))
    return round(WORDS_IN_PHRASE + (SIGNS_IN_PHRASE - WORDS_IN_PHRASE) * signs / n + (THAI_SIGNS_IN_PHRASE - WORDS_IN_PHRASE) * thai / n)


def _phrases(words: list[str], n: int, marks: bytearray) -> None:
    """Marks the words that stand in a run of at least ``n`` words which occurred earlier."""
    if len(words) < 2:
        return
    n = min(n, max(1, len(words) // 2))  # what a text says twice cannot be longer than half of it
    seen: set[tuple[str, ...]] = set()
    for i in range(len(words) - n + 1):
        gram = tuple(words[i : i + n])
        if gram in seen:
            marks[i : i + n] = b"\x01" * n
        else:
            seen.add(gram)


def _units(parts: list[list[str]], marks: bytearray) -> None:
    """Marks the words of the parts (sentences, paragraphs) that occurred whole before; the parts make up the text."""
    seen: set[tuple[str, ...]] = set()
    at = 0
    for part in parts:
        words = tuple(part)
        if words in seen:
            marks[at : at + len(words)] = b"\x01" * len(words)
        seen.add(words)
        at += len(words)


def phrase_share(words: list[str], n: int) -> float:
    """Share of the words that stand in a run of at least ``n`` words which occurred earlier."""
    marks = bytearray(len(words))
    _phrases(words, n, marks)
    return sum(marks) / max(1, len(words))


def unit_share(parts: list[list[str]]) -> float:
    """Share of the words in parts (sentences, paragraphs) that occurred whole before."""
    marks = bytearray(sum(map(len, parts)))
    _units(parts, marks)
    return sum(marks) / max(1, len(marks))


def repeated_share(sentences: list[list[str]], paragraphs: list[list[str]], n: int) -> float:
    """Share of the words in a phrase of ``n`` words or more, a sentence or a paragraph that occurred earlier."""
    words = [w for s in sentences for w in s]
    marks = bytearray(len(words))
    _phrases(words, n, marks)
    _units(sentences, marks)
    _units(paragraphs, marks)
    return sum(marks) / max(1, len(words))


def gram_share(words: list[str], n: int) -> float:
    """Share of the runs of ``n`` words that are not new."""
    runs = len(words) - n + 1
    return 1 - len(set(zip(*(words[i:] for i in range(n)), strict=False))) / runs if runs > 0 else 0.0


SIGNS = ("share", "gram_share", "sentence_share", "paragraph_share", "squeezed", "variety")


def measures(text: str | None) -> tuple[float, ...]:
    """The share, and what the rules see: the values named in ``SIGNS``."""
    sentences, paragraphs = parts(text or "")
    words = [w for x in sentences for w in x]
    if not words:
        return 0.0, 0.0, 0.0, 0.0, 1.0, 1.0
    n = width(words)
    raw = " ".join(words).encode("utf-8", "surrogatepass")
    squeezed = len(zlib.compress(raw, 1)) / len(raw)
    return repeated_share(sentences, paragraphs, n), gram_share(words, max(2, n // 2)), unit_share(sentences), unit_share(paragraphs), squeezed, len(set(words)) / len(words)


def measured(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and the measures of every text."""
    names = SIGNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(measures(t) for t in b.column(1).to_pylist()), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.float64()) for c in cols]], names=[key, *names])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names)
    return df.select(F.col(key), F.col(text).cast("string").alias("text_")).mapInArrow(run, schema)


def noted(hits: DataFrame, key: str) -> DataFrame:
    """key and the greatest number of repetitions that a note of a repetition rule speaks of.

    Fixed values: the rules that notice repetition, and the ways a note counts it."""
    rule = F.regexp_replace(F.lower("rule_id"), r"[^a-z]", "")
    times = F.coalesce(*[F.nullif(F.regexp_extract(F.lower("note"), p, 1), F.lit("")) for p in (r"^n\s*=\s*(\d+)", r"seen (\d+) times", r"repeats:\s*(\d+)", r"words x\s*(\d+)")])
    counted = hits.filter(F.col(key).isNotNull() & rule.isin("template", "fragments", "opener", "recap", "parallel", "doublet"))
    return counted.select(F.col(key), times.cast("long").alias("times")).filter("times IS NOT NULL").groupBy(key).agg(F.max("times").alias("times"))


def votes(rows: DataFrame) -> DataFrame:
    """One vote per rule: 1 for repetition, 0 against, -1 abstaining."""

    def vote(value, yes, no):
        return F.when(yes(F.col(value)), 1).when(no(F.col(value)), 0).otherwise(-1)

    rules = {
        "v_grams": vote("gram_share", lambda c: c >= 0.35, lambda c: c < 0.2),
        "v_sentence": vote("sentence_share", lambda c: c >= 0.3, lambda c: c < 0.15),
        "v_paragraph": vote("paragraph_share", lambda c: c >= 0.3, lambda c: F.lit(False)),
        "v_squeezed": vote("squeezed", lambda c: c < 0.3, lambda c: c >= 0.36),
        "v_variety": vote("variety", lambda c: c < 0.35, lambda c: c >= 0.45),
        "v_noted": vote("times", lambda c: c >= 3, lambda c: F.lit(False)),
    }
    return rows.withColumns({k: v.cast("int") for k, v in rules.items()})


VOTERS = ("v_grams", "v_sentence", "v_paragraph", "v_squeezed", "v_variety", "v_noted")


def trust(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> dict[tuple[int, ...], float]:
    """Posterior probability of repetition for each vote pattern, by expectation-maximisation.

    patterns: (votes, number of texts). Voters are independent given the class; each has its own
    chance of saying yes, no or nothing in either class. Starts from the majority of the votes."""
    if not patterns:
        return {}
    m = len(patterns[0][0])
    post = []
    for v, _ in patterns:
        yes, no = sum(x == 1 for x in v), sum(x == 0 for x in v)
        post.append(0.9 if yes > no else 0.5 if yes == no else 0.05)
    for _ in range(rounds):
        table = [[[1e-2] * 3 for _ in range(m)] for _ in range(2)]
        mass = [1.0, 1.0]
        for (v, n), p in zip(patterns, post, strict=True):
            for c, w in ((1, p * n), (0, (1 - p) * n)):
                mass[c] += w
                for j, x in enumerate(v):
                    table[c][j][x] += w
        for c in range(2):
            for j in range(m):
                s = sum(table[c][j])
                table[c][j] = [x / s for x in table[c][j]]
        new = []
        for v, _ in patterns:
            log = [math.log(mass[c] / sum(mass)) + sum(math.log(table[c][j][x]) for j, x in enumerate(v)) for c in range(2)]
            new.append(1 / (1 + math.exp(min(700, max(-700, log[0] - log[1])))))
        if max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-9:
            break
        post = new
    return {v: p for (v, _), p in zip(patterns, post, strict=True)}


def judged(results: DataFrame, hits: DataFrame, key: str, text: str) -> DataFrame:
    """key, share and the posterior probability that the text repeats itself."""
    rows = measured(results, key, text).join(noted(hits, key), key, "left")
    rows = checkpointed(votes(rows).select(key, "share", *VOTERS))
    counted = rows.groupBy(*VOTERS).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** voters rows
    found = trust(sorted((tuple(r[v] for v in VOTERS), r["n"]) for r in counted))
    schema = ", ".join(f"{v} int" for v in VOTERS) + ", posterior double"
    table = results.sparkSession.createDataFrame([(*v, p) for v, p in found.items()], schema)
    return rows.join(F.broadcast(table), list(VOTERS)).select(key, "share", "posterior")
