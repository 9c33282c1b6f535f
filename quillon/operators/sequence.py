"""Alignment of unit pairs, and surprise under a language model in tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx

MATCH, WILD, MISMATCH, GAP, LONGEST = 2.0, 1.0, -1.0, -1.5, 20


def align_units(a: list[str], b: list[str]) -> tuple[float, int, float, float]:
    """Best local alignment of two class sequences: score, length, identity, normalised score.

    '#' stands for any content word; two of them match for less. Both units are cut at 20 classes,
    which is part of the measure."""
    a, b = list(a)[:LONGEST], list(b)[:LONGEST]
    if not a or not b:
        return 0.0, 0, 0.0, 0.0
    # each cell: best score, and how many pairs its path has aligned; ties prefer pairs, then gaps in b
    above = [(0.0, 0)] * (len(b) + 1)
    best = (0.0, 0)
    for x in a:
        row = [(0.0, 0)]
        for j, y in enumerate(b, 1):
            pair = (WILD if x == "#" else MATCH) if x == y else MISMATCH
            options = ((above[j - 1][0] + pair, above[j - 1][1] + 1), (above[j][0] + GAP, above[j][1]), (row[j - 1][0] + GAP, row[j - 1][1]))
            top = max(o[0] for o in options)
            cell = (0.0, 0) if top <= 0 else next(o for o in options if o[0] == top)
            row.append(cell)
            if cell[0] > best[0]:
                best = cell
        above = row
    shorter = min(len(a), len(b))
    return round(best[0], 2), best[1], round(best[1] / shorter, 3), round(best[0] / (shorter * MATCH), 3)


def alignment(a: Column, b: Column) -> Column:
    """struct<score, length, identity, normalized> of two array columns; dynamic programming has no built-in form."""

    @F.pandas_udf("score double, length int, identity double, normalized double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [align_units([] if p is None else p, [] if q is None else q) for p, q in zip(x, y, strict=True)]
        return pd.DataFrame(rows, columns=["score", "length", "identity", "normalized"])

    return run(a, b)


def logprobs(text: Column, scorer: Callable[[], object]) -> Column:
    """Log probabilities of the tokens of a text under a model.

    ``scorer`` makes, once in each worker, an object with ``logprobs(text) -> list[float]``."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = scorer()
        for texts in batches:
            yield texts.map(lambda t: [float(x) for x in model.logprobs(t or "")])

    return run(text)


def perplexity_windows(df: DataFrame, key: str, lps: str, window: int = 32) -> DataFrame:
    """key, token_count, mean_logprob, perplexity and window_cv: how evenly a text surprises, tile by tile.

    Tiles of fewer than a quarter of ``window`` (at least 4) tokens do not count; without any other the
    whole text is the one tile. Texts without tokens are left out."""
    return _tiled(df.select(key, F.posexplode(lps).alias("i", "lp")), key, window)


def _tiled(tokens: DataFrame, key: str, window: int = 32) -> DataFrame:
    """What ``perplexity_windows`` gives, from a row for each token: key, i (from 0) and lp."""
    t = tokens.withColumn("tile", F.floor(F.col("i") / window))
    tiles = t.groupBy(key, "tile").agg(F.avg("lp").alias("mean"), F.count(F.lit(1)).alias("n"), F.sum("lp").alias("sum"))
    ok = F.col("n") >= max(4, window // 4)
    ppl = F.when(ok, F.exp(-F.col("mean")))
    per = tiles.groupBy(key).agg(F.sum("n").alias("token_count"), (F.sum("sum") / F.sum("n")).alias("m"), F.stddev_pop(ppl).alias("sd"), F.avg(ppl).alias("mean"), F.count(ppl).alias("tiles"))
    cv = F.when((F.col("tiles") > 1) & (F.col("mean") != 0), F.col("sd") / F.col("mean")).otherwise(0.0)
    return per.select(key, F.col("token_count").cast("long").alias("token_count"), F.round("m", 4).alias("mean_logprob"), F.round(F.exp(-F.col("m")), 3).alias("perplexity"), F.round(cv, 4).alias("window_cv"))


def own_perplexity(p) -> DataFrame:
    """Perplexity windows under the word frequencies of each document itself, in place of a language model.

    Words are counted by windows over ``doc_id``, which keep the placement: a join of words with their frequencies
    would move every word twice, or be broadcast, as words are planned at the size of the files that hold their
    texts. Texts of one ``doc_id`` are one, those without are left out."""
    from pyspark.sql import Window

    doc = Window.partitionBy("doc_id")
    t = p.docs.filter("doc_id IS NOT NULL").select("doc_id", F.posexplode(tx.words(F.col("text"))).alias("pos", "word"))
    t = t.select("doc_id", "pos", F.lower("word").alias("lword"))
    t = t.select("doc_id", "pos", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "lword")).alias("n"))
    i = F.row_number().over(doc.orderBy("pos", "n")) - 1
    return _tiled(t.select("doc_id", i.alias("i"), F.log(F.col("n") / F.count(F.lit(1)).over(doc)).alias("lp")), "doc_id")
