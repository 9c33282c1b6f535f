"""Problem 6: the reading level of each text, from the surprisal of n-gram models.

Reference texts of known levels train one interpolated n-gram model per level. Words that several
reference texts know enter as themselves, others by what makes them easy or learned (ending and
syllables), and a sentence's end by how long the sentence was, so that vocabulary, clauses and length
all cost surprise. Of a text, the surprisal of every sentence under every model gives a distribution;
the score of the text is the word-weighted median of how much better the most demanding model explains
its sentences than the models of the levels below. Isotonic regression, fitted on scores of reference
texts by models of the other folds, maps scores monotonically to levels.

Measured indices (fog, smog, subordination) of a text are evidence of uneven trust: each is mapped to a
level by an isotonic fit of its own, values outside what texts can have are dropped, and their median
counts as much as ``EVIDENCE_WORDS`` words of text, at every length.

Defined results: null, empty and blank texts, and texts without words, have no level (null); texts in
other languages none either; repeated rows are graded each; the latest measured row counts; an empty
table gives an empty result. At most ``most`` reference texts, drawn by hash, train the models, in
time that grows with their number; the models stay as small as they are, whatever is graded.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.lookalikes import unit
from quillon.llm.p3_sentences import language, split
from quillon.session import checkpointed

ORDER = 3
EVIDENCE_WORDS = 6
KNOWN_TEXTS = 4
# Function words that keep their own identity, and endings of learned words
_FUNCTION = set(
    "a an the this that these those any every no each some which who whose whom what it its he his she her they their them we our us i my me you your one"
    " of in on at by with from to for as than into over under beside behind near between through against among across despite throughout within without"
    " and or but so because although though while when whenever where whereas unless until since before after if notwithstanding regardless"
    " is are was were be been being has have had do does did not never nobody rather".split()
)
_ENDINGS = (
    "ization", "ification", "ation", "tion", "sion", "ality", "icity", "ibility", "ability", "ity", "ness", "ment", "ology", "graphy", "ism", "ance", "ence", "ency", "ancy",
    "atical", "ological", "ational", "tional", "ical", "ial", "ual", "al", "ous", "ive", "ic", "able", "ible", "ary", "ory", "ant", "ent", "izes", "ifies", "ates", "ize", "ify", "ate", "ly", "ing", "ed", "er", "est", "s",
)
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’-]*")
_PART = regex.compile(r"\p{L}[\p{L}\p{M}'’-]*|\p{N}+(?:[.,]\p{N}+)*|[,;:()\"“”‘’—–]")
_VOWELS = regex.compile(r"[aeiouyàâäéèêëíìîïóòôöúùûü]+")


def kind(part: str) -> str:
    """The symbol a word or mark enters the models by."""
    w = part.lower()
    if w in _FUNCTION:
        return w
    if w[0].isnumeric():
        return "0"
    if not w[0].isalpha():
        return w
    beats = min(5, len(_VOWELS.findall(w)))
    end = next((e for e in _ENDINGS if w.endswith(e) and len(w) > len(e) + 2), "")
    return f"{beats}~{end}"


class Symbols(dict):
    """Symbol of a word or mark: itself if the reference texts know it, else its class. Kept up to a bound."""

    def __init__(self, known: frozenset[str] = frozenset()):
        super().__init__()
        self.known = known

    def __missing__(self, part: str) -> str:
        if len(self) > 300_000:
            self.clear()
        got = self[part] = part.lower() if part.lower() in self.known else kind(part)
        return got

    def __reduce__(self):
        return Symbols, (self.known,)


Sentences = list[tuple[list[str], int]]


def well_known(texts: list[str], least: int = KNOWN_TEXTS) -> frozenset[str]:
    """The words that stand in ``least`` or more of the reference texts."""
    times = Counter(w for t in texts for w in set(_WORD.findall(t.lower())))
    return frozenset(w for w, n in times.items() if n >= least)


def sentences_of(text: str, symbols: Symbols) -> Sentences:
    """Symbols and number of words of every sentence."""
    if not text.isascii():
        text = "".join(map(unit, text))
    out = []
    for a, b in split(text, "en"):
        parts = _PART.findall(text[a:b])
        n = sum(p[0].isalpha() for p in parts)
        if n:
            out.append(([*map(symbols.__getitem__, parts), f"</{min(8, n // 5)}>"], n))
    return out


class Model:
    """Interpolated n-gram model with Witten-Bell weights, down to the even chance of a symbol."""

    def __init__(self, order: int = ORDER, symbols: int = 400):
        self.order, self.symbols = order, symbols
        self.next: dict[tuple[str, ...], Counter] = {}
        self.sizes: dict[tuple[str, ...], tuple[int, int]] = {}  # of the contexts asked for: uses and different followers

    def add(self, seq: list[str]) -> None:
        self.sizes.clear()
        padded = ["<s>"] * (self.order - 1) + seq
        for i in range(self.order - 1, len(padded)):
            for n in range(self.order):
                self.next.setdefault(tuple(padded[i - n : i]), Counter())[padded[i]] += 1

    def p(self, context: tuple[str, ...], symbol: str) -> float:
        got = 1.0 / self.symbols
        for n in range(len(context) + 1):
            behind = context[len(context) - n :]
            seen = self.next.get(behind)
            if seen:
                size = self.sizes.get(behind)
                if size is None:
                    size = self.sizes[behind] = seen.total(), len(seen)
                got = (seen[symbol] + size[1] * got) / (size[0] + size[1])
        return got


class Grams(dict):
    """Row in ``bits`` of each n-gram met so far, up to a bound."""

    def __init__(self, models: list[Model], most: int = 400_000):
        super().__init__()
        self.models, self.most, self.rows = models, most, []

    def __missing__(self, gram: tuple[str, ...]) -> int:
        got = self[gram] = len(self.rows)
        self.rows.append([-math.log2(m.p(gram[:-1], gram[-1])) for m in self.models])
        return got


class Models:
    """One model a level, and the surprisal of texts under all of them at once."""

    def __init__(self, models: dict[int, Model], symbols: Symbols):
        self.levels = sorted(models)
        self.models = [models[k] for k in self.levels]
        self.symbols = symbols
        self.grams = Grams(self.models)

    def __reduce__(self):
        return Models, (dict(zip(self.levels, self.models, strict=True)), self.symbols)

    def surprisal(self, sents: Sentences) -> np.ndarray:
        """Bits of each sentence under each level's model, the levels in order."""
        if len(self.grams.rows) > self.grams.most:
            self.grams = Grams(self.models)
        pad, order, ids, starts = ["<s>"] * (self.models[0].order - 1), self.models[0].order, [], []
        for seq, _ in sents:
            starts.append(len(ids))
            padded = pad + seq
            ids.extend(map(self.grams.__getitem__, zip(*(padded[i:] for i in range(order)), strict=False)))
        return np.add.reduceat(np.array([self.grams.rows[i] for i in ids]), starts, axis=0)


def train(samples: list[tuple[Sentences, int]], symbols: Symbols) -> Models:
    models: dict[int, Model] = {}
    for sents, level in samples:
        m = models.setdefault(level, Model())
        for seq, _ in sents:
            m.add(seq)
    return Models(models, symbols)


def score(models: Models, sents: Sentences) -> float | None:
    """Word-weighted median, over sentences, of the bits a symbol that the top level's model saves."""
    if not sents:
        return None
    bits = models.surprisal(sents)
    gains = (bits[:, :-1].min(axis=1) - bits[:, -1]) / np.array([len(seq) for seq, _ in sents])
    order = np.argsort(gains, kind="stable")
    run = np.cumsum(np.array([n for _, n in sents])[order])
    return float(gains[order][np.searchsorted(run, run[-1] / 2)])


Blocks = list[tuple[float, float, float]]


def isotonic(points: list[tuple[float, float, float]]) -> Blocks:
    """Pool-adjacent-violators over (x, y, weight): blocks of (first x, last x, level), never falling."""
    blocks: list[list[float]] = []  # first, last, sum, weight
    for x, y, w in sorted(points):
        blocks.append([x, x, y * w, w])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            _, last, total, weight = blocks.pop()
            blocks[-1][1] = last
            blocks[-1][2] += total
            blocks[-1][3] += weight
    return [(f, l, t / w) for f, l, t, w in blocks]


def mapped(blocks: Blocks, x: float) -> float:
    """The fitted level at x: that of its block, and straight from block to block between them."""
    i = bisect_right([f for f, _, _ in blocks], x) - 1
    if i < 0:
        return blocks[0][2]
    _, last, level = blocks[i]
    if x <= last or i + 1 == len(blocks):
        return level
    start, _, above = blocks[i + 1]
    return level + (above - level) * (x - last) / (start - last)


def fit(rows: list[tuple[str, int]], folds: int = 10) -> tuple[Models, Blocks, list[tuple[float, int]]]:
    """Models of all reference texts, the isotonic map, and the left-out scores it was fitted on.

    Each text is scored by models of the other folds; the texts of each level are dealt over the folds in turn."""
    rows = sorted(((t, int(y)) for t, y in rows if t and y is not None), key=lambda r: r[1])
    symbols = Symbols(well_known([t for t, _ in rows]))
    samples = [s for s in ((sentences_of(t, symbols), y) for t, y in rows) if s[0]]
    levels = {y for _, y in samples}
    if len(levels) < 2:
        raise ValueError("reference texts of at least two levels are needed")
    left_out = []
    for f in range(folds):
        rest = [s for i, s in enumerate(samples) if i % folds != f]
        if {y for _, y in rest} == levels:
            models = train(rest, symbols)
            left_out += [(score(models, sents), y) for sents, y in samples[f::folds]]
    return train(samples, symbols), isotonic([(s, float(y), 1.0) for s, y in left_out]), left_out


#: What an index of a text can be at most; above or below zero it is a mistake
PLAUSIBLE = {"gunning_fog": (40.0, 1.0), "smog": (30.0, 1.0), "subordination": (8.0, 0.25)}  # greatest value, width of a bucket


def latest(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The latest row of each key; at equal times the greatest."""
    best = F.max(F.struct(F.col(at).alias("at"), *columns)).alias("best")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"best.{c}").alias(c) for c in columns])


def text_levels(results: DataFrame, samples: DataFrame, key: str, text: str, lang: str, most: int = 5000) -> DataFrame:
    """key, words, score, text_level and the least and greatest level of every English text."""
    rows = samples.filter("text IS NOT NULL AND reading_level IS NOT NULL").orderBy(F.xxhash64("sample_id", "text")).limit(most).collect()
    models, blocks, _ = fit([(r["text"], r["reading_level"]) for r in rows])
    shared = results.sparkSession.sparkContext.broadcast((models, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, blocks = shared.value
        for b in batches:
            words, scores, levels = [], [], []
            for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                sents = sentences_of(t, models.symbols) if t and not t.isspace() and language(t, g) == "en" else []
                s = score(models, sents)
                words.append(sum(n for _, n in sents)), scores.append(s), levels.append(None if s is None else mapped(blocks, s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int32()), pa.array(scores, pa.float64()), pa.array(levels, pa.float64())], names=[key, "words", "score", "text_level"])

    src = results.select(F.col(key), F.col(text).cast("string").alias("text_"), F.col(lang).cast("string").alias("lang_"))
    return src.mapInArrow(run, f"`{key}` {results.schema[key].dataType.simpleString()}, words int, score double, text_level double").withColumns({"least_": F.lit(models.levels[0]), "most_": F.lit(models.levels[-1])})


def graded(results: DataFrame, samples: DataFrame, stylometry: DataFrame, signals: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """key, score, text_level, evidence_level and level of every English text with words."""
    levels = checkpointed(text_levels(results, samples, key, text, lang).filter("text_level IS NOT NULL"))
    fog = latest(stylometry, key, "analyzed_at", ["gunning_fog"])
    other = latest(signals, key, "analyzed_at", ["smog", "subordination"])
    joined = levels.join(fog, key, "left").join(other, key, "left")
    buckets = {}
    for name, (most, width) in PLAUSIBLE.items():
        ok = (F.col(name) >= 0) & (F.col(name) <= most) & ~F.isnan(name)
        buckets[f"b_{name}"] = F.when(ok, F.floor(F.col(name) / width).cast("int"))
    joined = checkpointed(joined.select(key, "words", "score", "text_level", "least_", "most_", *[v.alias(k) for k, v in buckets.items()]))
    for name, (most, width) in PLAUSIBLE.items():
        b = f"b_{name}"
        means = joined.filter(F.col(b).isNotNull()).groupBy(b).agg(F.avg("text_level").alias("y"), F.count(F.lit(1)).alias("n")).collect()
        blocks = isotonic([(float(r[b]), r["y"], float(r["n"])) for r in means])  # at most most / width buckets
        table = results.sparkSession.createDataFrame([(i, mapped(blocks, float(i))) for i in range(int(most / width) + 1)] if blocks else [], f"{b} int, e_{name} double")
        joined = joined.join(F.broadcast(table), b, "left")
    evidence = F.array_sort(F.array_compact(F.array(*[F.col(f"e_{n}") for n in PLAUSIBLE])))
    n = F.size(evidence)
    median = F.when(n > 0, (F.element_at(evidence, F.floor((n + 1) / 2).cast("int")) + F.element_at(evidence, F.ceil((n + 1) / 2).cast("int"))) / 2)
    out = joined.withColumn("evidence_level", median)
    evidence_words = F.when(F.col("evidence_level").isNull(), 0).otherwise(EVIDENCE_WORDS)
    judged = (F.col("words") * F.col("text_level") + evidence_words * F.coalesce("evidence_level", F.lit(0.0))) / (F.col("words") + evidence_words)
    return out.select(key, "words", "score", "text_level", "evidence_level", F.greatest("least_", F.least("most_", F.floor(judged + 0.5))).cast("int").alias("level"))
