"""Problem 10: records that hold template residue, filler or error pages in place of content.

A regularised linear classifier over hashed n-grams with length and title features decides. Its
training labels are weak: response-status lines, phrases of error and script pages, filler and
unfilled fields vote for residue where they are a text's own words and not quoted or shown as code;
texts without any such sign, or with few for their length, vote against; the rest abstain. None of
these patterns is a feature: the classifier sees words, marks and letters only, so it also finds
what no pattern names, and its score alone decides.

Features of a text's own words (all but what it quotes or shows as code): hashed word 1-, 2- and
3-grams, those of letters scaled by the number of different words and those with unusual marks taken
as they are, as one unfilled field in a long text is a case; hashed letter 3-grams by their share;
length, lines and title.

It is fitted on a bounded sample: of about ``candidates`` rows drawn by hash (no texts beyond
``longest`` characters, equal rows once) at most ``sample`` of each label, from four fifths of the
hosts, and validated on the hosts left out. Every row is scored on its whole text.

Defined results: null, empty and blank texts are no cases (score null); repeated rows and null ids
are scored like others; with under 20 labels of either kind the weak labels decide alone; an empty
table gives an empty result. Broadcast: the weights, 2**18 + 2**16 numbers, at every scale.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.lookalikes import SAME_LENGTH
from quillon.llm.p3_sentences import COMMON_WORDS
from quillon.session import checkpointed

DIMS = 1 << 18
LETTER_DIMS = 1 << 16
LETTER_SCALE = 10.0
MARK_VALUE = 0.5
CANDIDATES = 40_000
SAMPLE = (9000, 3000)  # without residue, with
LONGEST = 50_000
LEAST_LABELS = 20  # of each kind; with fewer nothing can be learned
SLICE = 2_000_000  # characters worked on at once
SIGN_EACH = 160  # own characters a sign speaks for: texts with a sign in so many are residue
PASSING = 600  # with fewer than one in so many, signs are said in passing

# ---------------------------------------------------------------- what is quoted or shown

_CODE = regex.compile(r"(?ms)^[ \t]*(`{3,}|~{3,}).*?(?:^[ \t]*\1|\Z)|<pre\b.*?(?:</pre>|\Z)|<code\b.*?(?:</code>|\Z)|\\begin\{(verbatim|lstlisting)\}.*?(?:\\end\{\2\}|\Z)|(`+)[^`\n][^`]*?\3")
_QUOTED = regex.compile(r"\"[^\"\n]{1,200}\"|“[^“”\n]{1,200}”|„[^„“”\n]{1,200}[“”]|«[^«»\n]{1,200}»|「[^「」\n]{1,200}」|(?<![\p{L}\p{N}])'[^'\n]{2,200}'(?!\p{L})|‘[^‘’\n]{2,200}’")
_TAGS = regex.compile(r"</?(?:div|p|span|br|b|i|em|strong|html|body|head|title|h[1-6]|ul|ol|li|a|hr|center|table|tr|td|section|main|article|footer|header|nav|script|style|noscript)\b[^<>]*>", regex.I)


#: full-width and look-alike letters to ASCII, kinds of blank to a blank, unseen characters away
_FLAT = SAME_LENGTH | {o: " " for o in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)} | {o: "" for o in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_GONE = 0x110000
_FLAT_CODES = np.arange(_GONE, dtype=np.uint32)
_FLAT_CODES[list(_FLAT)] = [ord(c) if c else _GONE for c in _FLAT.values()]
_BETWEEN = "\x1e"


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def flattened(texts: list[str]) -> list[str]:
    """The texts by the table, in one step for all of them."""
    joined = _BETWEEN.join(t.replace(_BETWEEN, " ") for t in texts)
    if joined.isascii():
        return joined.split(_BETWEEN)
    flat = _FLAT_CODES[codes(joined)]
    return flat[flat != _GONE].tobytes().decode("utf-32-le", "surrogatepass").split(_BETWEEN)


def own_words(text: str) -> str:
    """The text without what it quotes or shows as code, and without layout tags; merge fields in guillemets stay."""
    if "`" in text or "~~~" in text or "<" in text or "\\begin" in text:
        text = _TAGS.sub(" ", _CODE.sub(" ", text))
    if "«" in text:
        text = _MERGE.sub(r"{{\1}}", text)
    return _QUOTED.sub(" ", text)


# ---------------------------------------------------------------- weak labels

_NAME = r"(?:your[ _])?(?:first|last|full|user|company)?[ _]?(?:name|city|date|title|author|speaker|venue|editor|chapter|deadline|summary|draft[ _]no|draft|number|address|email|phone|place|topic|body|text|link|url)"
_FIELD = regex.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,80}%\}|<%[^%\n]{0,80}%>|\$\{[^{}\n]{1,60}\}|#\{[^{}\n]{1,60}\}|%%\p{L}[\p{L}_ ]*%%|@@\p{L}[\p{L}_ ]*@@|##?\p{L}[\p{L}_]*##?(?!\p{L})"
    r"|%\(\p{L}\w*\)[sdSD]|\[\[\p{L}[\p{L}_ ]*\]\]|<<\p{L}[\p{L}_ ]*>>|__\p{L}[\p{L}_ ]*__|\*\|\p{L}[\p{L}_:]*\|\*"
    r"|\[\p{Lu}[\p{Lu}_ ]{2,40}\](?!\()|<\p{Lu}[\p{Lu}_ ]{2,40}>|&lt;\p{Lu}[\p{Lu}_ ]{2,40}&gt;|(?<![\p{L}\p{N}$#])\{\p{Lu}[\p{Lu}_ ]{2,40}\}"
    rf"|(?i:[<\[{{]{_NAME}[>\]}}](?!\()|&lt;{_NAME}&gt;|[\[<(](?:insert|enter|type|add|replace)\b[^\[\]<>()\n]{{3,60}}[\])>])"
)
_MERGE = regex.compile(rf"(?i)«({_NAME})»")
_MAY_HOLD_FIELD = regex.compile(r"[{<%@#\[$&*«]|__|\((?i:insert|enter|type|add|replace)")
_RENDERED = regex.compile(r"(?i)\b(?:undefined|NaN|null|None|Invalid Date|00/00/0000|\[object Object\])(?![\p{L}\p{N}])|\(unknown\)")
#: places in a stack trace: signs, not words
_FRAMES = r"\bline \d+, in \S[^\n]*|(?m:^[ \t]*at [\w.$<>/]+\([^()\n]*\)[ \t]*$)"
# Phrases of error pages, of script and access demands, and of filler
_STATUS = regex.compile(
    r"(?i)\b(?:error|http(?: status)?|status|code)\b\W{0,4}[45]\d\d\b|\b[45]\d\d\b\W{1,4}(?:error|not found|bad|forbidden|internal|unavailable|gateway|too many|service)|\b(?:page|file|essay|text|article|document|address) (?:was |were |could |can)?(?:not|n't)(?: be)? (?:found|exist|shown|loaded|opened|displayed)"
    r"|something went wrong|could not load|did not answer|too many requests|no permission|not have permission|access denied|forbidden|has been (?:removed|deleted|moved)|no longer (?:exists|available)|down for maintenance|not available|unavailable|temporarily unavailable|closed the connection|try again (?:later|in a)|bad gateway|internal server error"
    r"|traceback \(most recent|(?:fatal|parse|syntax|key|type|value|name)\s?error\b|\w+exception\b|stack trace|on line \d+\s*$|cannot open include|page body is empty|segmentation fault|\boops\b"
    rf"|{_FRAMES}"
)
_DEMAND = regex.compile(
    r"(?i)javascript|\bscripts?\b[^.\n]{0,40}\b(?:off|blocked|disabled|switched|needed|required)\b|needs? scripts|we use cookies|(?:accept|reject) all|\bcookies\b[^.\n]{0,30}\b(?:enable|on|accept|allow)|not a robot|you are human|verify (?:that )?you|checking your browser|complete the check|captcha|session has (?:ended|expired)|(?:sign|log) in (?:again )?to|from your region|ad ?blocker|subscribe to (?:read|continue)|unusual traffic|^\s*loading(?:\.\.\.|…)?\s*$"
)
_FILLER = regex.compile(
    r"(?i)lorem ipsum|dolor sit amet|text goes here|(?:goes|comes) here|click to (?:add|edit)|fill (?:me |this )?in later|\btbd\b|\btodo\b|placeholder|add your|enter (?:a|your)|replace this|type the|(?:write|put) (?:two|three|your|a few|some)\b|caption for|dummy (?:copy|text)|\basdf\b|(?:\bblah\b\W*){3}|\bqwerty\b|dd/mm/yyyy|mm/dd/yyyy|_{6,}|(?:\bxxx+\b)|sample text|coming soon|under construction|untitled (?:document|page)|the quick brown fox"
)
_SIGNS = (_STATUS, _DEMAND, _FILLER)
#: someone speaks of such things, so a phrase is no sure sign
_TOLD = regex.compile(r"(?i)\b(?:taught|joked|laughed|asked us|told (?:us|me)|remembered|explained (?:that|why|how))\b")
#: a number like a status with nothing that says so: undecided in a short text
_BARE_STATUS = regex.compile(r"(?m)^\W*[45]\d\d\W*$|^\W*[45]\d\d - |\[[45]\d\d\]\s*$")


def fields(own: str) -> int:
    """Unfilled fields among a text's own words."""
    return len(_FIELD.findall(own)) if _MAY_HOLD_FIELD.search(own) else 0


# Words of the usual mock Latin
_MOCK = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud"
    " exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur"
    " excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)


def is_filler(words: list[str]) -> bool:
    """A few words over and over, or mock Latin, at any length."""
    if len(words) < 8:
        return False
    kinds = set(words)
    return len(kinds) <= max(3, min(6, len(words) // 8)) or len(words) < 4 * sum(w in _MOCK for w in words) / 3


_LATIN_WORD = regex.compile(r"[\p{Latin}\p{M}]+")


def is_nonce(own: str) -> bool:
    """A text of many Latin-script words with hardly any of those that no running text does without."""
    words = _LATIN_WORD.findall(own.lower())
    return len(words) >= 25 and sum(map(len, words)) * 2 > len(own) and sum(w in COMMON_WORDS for w in words) * 20 < len(words)


def weak_label(text: str) -> int:
    """1 residue, 0 content, -1 undecided."""
    flat = flattened([text])[0]
    own = own_words(flat).strip()
    if fields(own) or is_filler(regex.findall(r"\p{L}+", own.lower())) or is_nonce(own):
        return 1
    signs = sum(len(p.findall(own)) for p in _SIGNS) + (2 if len(_RENDERED.findall(own)) > 1 else 0)
    if signs * SIGN_EACH >= len(own) and signs and not _TOLD.search(own):
        return 1
    if len(own) < SIGN_EACH and _BARE_STATUS.search(own):
        return -1
    if not signs and own != flat.strip():
        signs = sum(len(p.findall(flat)) for p in _SIGNS)  # quoted or shown
    return -1 if signs and signs * PASSING >= len(own) else 0


# ---------------------------------------------------------------- features


_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{N}]")
_ASCII_TOKEN = re.compile(r"[a-z]+|[0-9]+|[^\sa-z0-9]")
_USUAL = frozenset(".,;:!?'\"()-")
_CLOSED = regex.compile(r"[.!?。！？।؟…][\"'”’»」)]*\s*$")
_LAYOUT = 9


class _Hashes(dict):
    """Hash of a token over whether it is an unusual mark; kept up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        shown = "0" if token[0].isnumeric() else token
        mark = not (token[0].isalnum() or token in _USUAL)
        got = self[token] = zlib.crc32(shown.encode("utf-8", "surrogatepass")) << 1 | mark
        return got


_HASHES = _Hashes()
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def layout(own: str, whole: int) -> list[float]:
    """Length, lines and title of a text's own words; ``whole``: characters with what is quoted or shown."""
    text = own.strip()
    n = max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    title = lines[0].strip()
    headed = len(lines) > 1 and len(title) < 60 and not _CLOSED.search(title)
    return [1.0, min(1.5, math.log(n) / 6), float(n < 80), float(n < 160), float(n < 400), min(1.0, len(lines) / 6), sum(not _CLOSED.search(x) for x in lines) / len(lines), float(headed), float(n * 2 < whole)]


def _hashed(x: np.ndarray, dims: int) -> np.ndarray:
    return ((x * _MIX >> np.uint64(40)) % np.uint64(dims)).astype(np.int64)


def _word_grams(raw: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, text and whether it has an unusual mark, of all 1-, 2- and 3-grams of tokens within a text."""
    mark, gram = (raw & np.uint64(1)).astype(bool), (raw >> np.uint64(1)) * _MIX
    single, parts = gram, [(gram, doc, mark)]
    for width in (1, 2):
        if len(raw) > width:
            gram = gram[:-1] * _MIX2 + single[width:]
            mark = mark[:-1] | parts[0][2][width:]
            same = doc[:-width] == doc[width:]
            parts.append((gram[same], doc[:-width][same], mark[same]))
    gram, of, mark = (np.concatenate(x) for x in zip(*parts, strict=True))
    return _hashed(gram, DIMS), of, mark


def features(texts: list[str], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, column and value of every hashed feature that is not 0, and the layout of each text.

    Word n-grams have the columns from 0, letter n-grams those from DIMS. ``known``: the columns that matter."""
    own = [own_words(t).lower() for t in flattened(texts)]
    found, sizes, kinds = [], [], []
    for t in own:
        tokens = (_ASCII_TOKEN if t.isascii() else _TOKEN).findall(t)
        found.extend(map(_HASHES.__getitem__, tokens))
        sizes.append(len(tokens)), kinds.append(len(set(tokens)))
    column, doc, mark = _word_grams(np.array(found, dtype=np.uint64), np.repeat(np.arange(len(own)), sizes))
    if known is not None:
        on = known[column]
        column, doc, mark = column[on], doc[on], mark[on]
    key, first = np.unique(doc * DIMS + column, return_index=True)
    doc, column = key // DIMS, key % DIMS
    value = np.where(mark[first], MARK_VALUE, 1 / np.sqrt(np.maximum(1, np.array(kinds))[doc]))
    letters = codes(_BETWEEN.join(own)).astype(np.uint64)
    at = np.cumsum(letters == ord(_BETWEEN))  # the text each character is of
    if len(letters) > 2:
        gram = _hashed((letters[:-2] * _MIX2 + letters[1:-1]) * _MIX2 + letters[2:], LETTER_DIMS) + DIMS
        same = at[:-2] == at[2:]
        gram, at = gram[same], at[:-2][same]
        if known is not None:
            gram, at = gram[known[gram]], at[known[gram]]
        key, times = np.unique(at * (DIMS + LETTER_DIMS) + gram, return_counts=True)
        at, gram = key // (DIMS + LETTER_DIMS), key % (DIMS + LETTER_DIMS)
        share = LETTER_SCALE * times / np.maximum(1, np.array([len(t) for t in own]))[at]
        doc, column, value = np.concatenate([doc, at]), np.concatenate([column, gram]), np.concatenate([value, share])
    shape = np.array([layout(t, len(w.strip())) for t, w in zip(own, texts, strict=True)]).reshape(-1, _LAYOUT)
    return doc, column, value, shape


# ---------------------------------------------------------------- model


class Model:
    """Weights of the columns and of the layout."""

    def __init__(self, weights: np.ndarray, layout_weights: np.ndarray):
        self.weights, self.layout = weights.astype(np.float32), layout_weights
        self.known = self.weights != 0

    def margins(self, texts: list[str]) -> np.ndarray:
        doc, column, value, shape = features(texts, self.known)
        return np.bincount(doc, weights=value * self.weights[column], minlength=len(texts)) + shape @ self.layout

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -30, 30)))


def fit(texts: list[str], labels: list[int], penalty: float = 0.1, least: int = 3, rounds: int = 100) -> Model:
    """Logistic regression with an L2 penalty and both labels of equal weight, by L-BFGS; features of fewer than ``least`` texts are left out."""
    doc, column, value, shape = features(texts)
    uses = np.bincount(column, minlength=DIMS + LETTER_DIMS)
    on = uses[column] >= least
    doc, value = doc[on], value[on]
    columns, at = np.unique(column[on], return_inverse=True)
    y, k, n = np.array(labels, dtype=float), len(columns), len(labels)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    sign = np.where(y == 1, 1.0, -1.0)
    cost = np.r_[np.full(k, penalty), np.full(_LAYOUT, penalty / 100)]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        m = sign * (np.bincount(doc, weights=value * x[at], minlength=n) + shape @ x[k:])
        slope = -weight * sign / (1 + np.exp(np.clip(m, -500, 500)))
        gradient = np.r_[np.bincount(at, weights=value * slope[doc], minlength=k), shape.T @ slope] + cost * x
        return float(weight @ np.logaddexp(0, -m) + (cost * x) @ x / 2), gradient

    x = np.zeros(k + _LAYOUT)
    now, slope = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, parts = slope.copy(), []
        for s, g in reversed(steps):
            parts.append((s @ way) / (g @ s))
            way -= parts[-1] * g
        way *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.linalg.norm(slope)))
        for (s, g), a in zip(steps, reversed(parts), strict=True):
            way += (a - (g @ way) / (g @ s)) * s
        length, down = 1.0, float(slope @ way)
        while True:
            after, turned = loss(x - length * way)
            if after <= now - 1e-4 * length * down or length < 1e-8:
                break
            length /= 2
        s, g = -length * way, turned - slope
        if s @ g > 1e-12:
            steps = [*steps[-7:], (s, g)]
        done = now - after < 1e-6 * now
        x, now, slope = x + s, after, turned
        if done:
            break
    weights = np.zeros(DIMS + LETTER_DIMS)
    weights[columns] = x[:k]
    return Model(weights, x[k:])


def slices(texts: list[str], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together; a longer text is one of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def labelled(df: DataFrame, key: str, text: str, host: str, candidates: int = CANDIDATES, longest: int = LONGEST) -> DataFrame:
    """order, host, label and text of the rows drawn that the weak rules decide on, equal rows once."""
    src = df.select(F.col(text).cast("string").alias("text_"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(F.lit(11), F.col(key), F.col(text)).alias("order"))
    src = src.filter(r"text_ RLIKE '\\S'")
    rows = src.count()
    drawn = src.filter(F.pmod("order", F.lit(1 << 30)) < int(min(1.0, candidates / max(1, rows)) * (1 << 30))).filter(F.length("text_") <= longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = pa.array([weak_label(t) for t in b.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, label], names=["text_", "host", "order", "label"])

    found = drawn.dropDuplicates(["order"]).mapInArrow(run, "text_ string, host string, order bigint, label int")
    return checkpointed(found.filter("label >= 0"))


def train(df: DataFrame, key: str, text: str, host: str, sample: tuple[int, int] = SAMPLE, candidates: int = CANDIDATES) -> tuple[Model | None, dict[str, float]]:
    """The model (None with too few labels) and its figures on hosts the training never saw, against their weak labels."""
    found = labelled(df, key, text, host, candidates)
    rows = [r for y in (0, 1) for r in found.filter(F.col("label") == y).orderBy("order").limit(sample[y]).collect()]
    held = [r for r in rows if zlib.crc32(r["host"].encode()) % 5 == 0]
    rows = [r for r in rows if zlib.crc32(r["host"].encode()) % 5]
    figures = {"train_rows": len(rows), "held_rows": len(held), "precision": math.nan, "recall": math.nan, "accuracy": math.nan}
    if min(sum(r["label"] == y for r in rows) for y in (0, 1)) < LEAST_LABELS:
        return None, figures
    model = fit([r["text_"] for r in rows], [r["label"] for r in rows])
    if held:
        said = model.margins([r["text_"] for r in held]) > 0
        true = np.array([r["label"] == 1 for r in held])
        both = int((said & true).sum())
        figures |= {"precision": both / max(1, int(said.sum())), "recall": both / max(1, int(true.sum())), "accuracy": float((said == true).mean())}
    return model, figures


def scored(df: DataFrame, key: str, text: str, host: str, sample: tuple[int, int] = SAMPLE, candidates: int = CANDIDATES) -> DataFrame:
    """key, score and residue (boolean) of every row; null for texts without characters."""
    shared = df.sparkSession.sparkContext.broadcast(train(df, key, text, host, sample, candidates)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            at = [i for i, t in enumerate(texts) if t and not t.isspace()]
            held = [texts[i] for i in at]
            ps: list[float | None] = [None] * len(texts)
            for lo, hi in slices(held):
                got = [float(weak_label(t) == 1) for t in held[lo:hi]] if model is None else model.scores(held[lo:hi]).tolist()
                for i, p in zip(at[lo:hi], got, strict=True):
                    ps[i] = p
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ps, pa.float64()), pa.array([p is not None and p >= 0.5 for p in ps], pa.bool_())], names=[key, "score", "residue"])

    src = df.select(F.col(key), F.col(text).cast("string").alias("text_"))
    return src.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, score double, residue boolean")
