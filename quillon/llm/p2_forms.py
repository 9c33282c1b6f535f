"""Problem 2: one form for texts that look the same but differ in characters.

The vocabulary is every plain word of the corpus with its count: composed, in one alphabet, of ordinary
widths, nothing unseen. Words that can look alike share a skeleton; by skeletons the vocabulary is
dealt over the cluster, and of the words of each skeleton a trie is built. Every spelling of the
corpus walks the trie of its skeleton with a weighted edit automaton over its raw characters: a
look-alike costs nothing, nor does skipping what shows nothing, nor undoing a joined letter; a letter
that has the shape of several others takes all their edges at once, and the vocabulary decides which
was meant; every visible change costs one, beyond the budget of 0. Its canonical spelling is the
commonest word reached. Spellings that reach none, and all that is not a word, go through the table.

So texts get the same form if they look alike. Widths and compositions of a letter, unseen characters,
kinds of blank, joined letters and same-shaped letters of other alphabets look alike; case, accents,
quotation marks, punctuation, numbers of blanks and line breaks do not.

Defined results: a null text has a null form and is in no pair; an empty text has the empty form; a
text of unseen characters only looks like the empty text. Repeated rows are one. Ties between
spellings: the smaller in code-point order. Empty tables give empty results. Texts and the vocabulary
are never cut.

Only spellings whose canonical one is not what the table gives are kept. If they are at most
``BROADCAST`` they go to the executors as they are, otherwise they are joined to the texts they occur in.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.lookalikes import STROKES, is_unseen, readings, unit
from quillon.session import checkpointed

BROADCAST = 100_000
_WORD = r"[\p{L}\p{M}\p{N}\p{Cf}]+"
_TOKEN = regex.compile(_WORD)
_SCRIPTS = [regex.compile(p) for p in (r"\p{Latin}", r"\p{Greek}", r"\p{Cyrillic}", r"\p{Armenian}")]


def look(text: str) -> str:
    """What a text looks like, by table alone."""
    return unicodedata.normalize("NFD", "".join(map(unit, unicodedata.normalize("NFC", text))))


def tabled(word: str) -> str:
    """The spelling the table gives."""
    return unicodedata.normalize("NFC", look(word))


def skeleton(word: str) -> str:
    """The same for all words that any reading can make look alike."""
    return "".join("l" if c == "I" or c in STROKES else c for c in look(word))


def is_plain(word: str) -> bool:
    """Whether a word is fit as a canonical spelling: composed, nothing unseen, one alphabet, ordinary widths."""
    if word.isascii():
        return True
    if unicodedata.normalize("NFKC", word) != word or any(map(is_unseen, word)):
        return False
    return sum(bool(p.search(word)) for p in _SCRIPTS) <= 1


class Trie:
    """Vocabulary words by the shapes of their letters."""

    __slots__ = ("next", "word")

    def __init__(self) -> None:
        self.next: dict[str, Trie] = {}
        self.word: tuple[int, str] | None = None  # least is best: minus the count, spelling

    @classmethod
    def of(cls, counted: list[tuple[str, int]]) -> Trie:
        root = cls()
        for word, n in counted:
            root.add(word, n)
        return root

    def add(self, word: str, n: int) -> None:
        node = self
        for c in look(word):
            node = node.next.setdefault(c, Trie())
        node.word = min(node.word or (1, ""), (-n, word))

    def spell(self, word: str, budget: int = 0) -> str | None:
        """The vocabulary word nearest in looks, within ``budget`` visible changes; of equals the commonest; None without any."""
        states: dict[int, tuple[Trie, int]] = {id(self): (self, 0)}

        def reach(into: dict, node: Trie, cost: int) -> None:
            if cost <= budget and (id(node) not in into or into[id(node)][1] > cost):
                into[id(node)] = (node, cost)

        for c in unicodedata.normalize("NFD", word):
            if is_unseen(c):
                continue  # skipped at no cost
            after: dict[int, tuple[Trie, int]] = {}
            for node, cost in states.values():
                free = set()
                for shown in readings(c):
                    to: Trie | None = node
                    for x in unicodedata.normalize("NFD", shown):
                        to = to.next.get(x) if to else None
                    if to is not None:
                        reach(after, to, cost)
                        free.add(id(to))
                if cost < budget:
                    reach(after, node, cost + 1)  # a letter too many
                    for child in node.next.values():
                        if id(child) not in free:
                            reach(after, child, cost + 1)  # another letter
                        for shown in readings(c):
                            if (further := child.next.get(shown)) is not None:
                                reach(after, further, cost + 1)  # a letter missing
            states = after
            if not states:
                return None
        ends = [(cost, *node.word) for node, cost in states.values() if node.word is not None]
        return min(ends)[2] if ends else None


class Normaliser:
    """Texts to forms; ``known`` has the spellings whose canonical one the table does not give."""

    def __init__(self, known: dict[str, str], memo_limit: int = 300_000):
        self.known, self.memo, self.memo_limit = known, {}, memo_limit

    @classmethod
    def of(cls, counted: list[tuple[str, int]], words: list[str] = ()) -> Normaliser:
        """For a small vocabulary at hand: what its trie says of the given words."""
        trie = Trie.of([(w, n) for w, n in counted if is_plain(w)])
        found = ((w, trie.spell(w)) for w in {*words, *(w for w, _ in counted)})
        return cls({w: c for w, c in found if c and c != tabled(w)})

    def word(self, m: regex.Match) -> str:
        w = m.group()
        got = self.memo.get(w)
        if got is None:
            got = self.known.get(w) or tabled(w)
            if len(self.memo) > self.memo_limit:
                self.memo.clear()
            self.memo[w] = got
        return got

    def form(self, text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for m in _TOKEN.finditer(text):
            if m.start() > at:
                out.append("".join(map(unit, text[at : m.start()])))
            out.append(self.word(m))
            at = m.end()
        out.append("".join(map(unit, text[at:])))
        return unicodedata.normalize("NFC", "".join(out))


def vocabulary(*columns: tuple[DataFrame, str]) -> DataFrame:
    """word and n of all spellings over all rows of all given columns."""
    words = None
    for df, text in columns:
        w = df.select(F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(_WORD), F.lit(0))).alias("word"))
        words = w if words is None else words.unionByName(w)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def canonical(counted: DataFrame) -> DataFrame:
    """word and canonical: the spellings whose canonical one is not what the table gives."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(skeleton, words), pa.string()), pa.array([not is_plain(w) for w in words], pa.bool_())], names=["word", "n", "skeleton", "odd"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trie, plain = None, Trie(), []
        out: list[tuple[str, str]] = []

        def said(w: str) -> None:
            c = trie.spell(w)
            if c is not None and c != tabled(w):
                out.append((w, c))

        for b in batches:
            for w, n, s, odd in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if s != at:
                    for x in plain:
                        said(x)
                    at, trie, plain = s, Trie(), []
                if odd:
                    said(w)  # the words of its skeleton have all come before it
                else:
                    trie.add(w, n)
                    plain.append(w)
            yield _pairs(out)
            out = []
        for x in plain:
            said(x)
        yield _pairs(out)

    rows = counted.mapInArrow(keyed, "word string, n bigint, skeleton string, odd boolean")
    # a skeleton lies whole in one partition: it has the spellings of one look, each once
    return rows.repartition("skeleton").sortWithinPartitions("skeleton", "odd").mapInArrow(walked, "word string, canonical string")


def _pairs(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["word", "canonical"])


def _mapped(df: DataFrame, keys: list[str], text: str, known: DataFrame, outputs: list[str], fn, most: int) -> DataFrame:
    """keys and what ``fn`` makes of the normaliser and each text."""
    src = df.select(*keys, F.col(text).cast("string").alias("text_"))
    n = len(keys)
    kept = known.limit(most + 1).collect()
    apart = len(kept) > most
    if apart:  # each text brings along the spellings it has
        by = F.xxhash64("text_"), F.md5("text_")
        src = src.withColumns({"h_": by[0], "m_": by[1]})
        used = src.select("h_", "m_", F.explode(F.array_distinct(F.regexp_extract_all("text_", F.lit(_WORD), F.lit(0)))).alias("word")).distinct()
        own = used.join(known, "word").groupBy("h_", "m_").agg(F.map_from_entries(F.collect_list(F.struct("word", "canonical"))).alias("own_"))
        src = src.join(own, ["h_", "m_"], "left").select(*keys, "text_", "own_")
    shared = df.sparkSession.sparkContext.broadcast(None if apart else {r["word"]: r["canonical"] for r in kept})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = None if apart else Normaliser(shared.value)
        for b in batches:
            owns = b.column(n + 1).to_pylist() if apart else [None] * b.num_rows
            found = [fn(Normaliser(dict(o or ())) if apart else norm, t) for t, o in zip(b.column(n).to_pylist(), owns, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *[pa.array([r[i] for r in found], pa.string()) for i in range(len(outputs))]], names=[*keys, *outputs])

    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"{o} string" for o in outputs])
    return src.mapInArrow(run, schema)


def forms(df: DataFrame, keys: list[str], text: str, known: DataFrame, most: int = BROADCAST) -> DataFrame:
    """keys and the form of every row."""
    return _mapped(df, keys, text, known, ["form"], lambda norm, t: (norm.form(t),), most)


def fingerprints(df: DataFrame, keys: list[str], text: str, known: DataFrame, most: int = BROADCAST) -> DataFrame:
    """keys with a 128-bit fingerprint of form and of text, so that joins move no texts; null texts are left out."""

    def both(norm: Normaliser, t: str) -> tuple[str, str]:
        return tuple(hashlib.md5(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (norm.form(t), t))

    return _mapped(df.filter(F.col(text).isNotNull()), keys, text, known, ["form_fp", "text_fp"], both, most)


def look_alike_classes(prints: DataFrame, key: str, within: list[str] | None = None) -> DataFrame:
    """within, form_fp, text_fp, id and links of every row in a class of two or more different texts.

    A row's links are the rows of its class with another text. Rows are counted by text first, so no
    class is ever gathered."""
    by = [*(within or []), "form_fp"]
    rows = prints.filter(F.col(key).isNotNull()).select(*by, "text_fp", F.col(key).alias("id")).distinct()
    texts = rows.groupBy(*by, "text_fp").agg(F.count(F.lit(1)).alias("copies"))
    classes = texts.groupBy(*by).agg(F.sum("copies").alias("of"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    sized = texts.join(classes, by).withColumn("links", F.col("of") - F.col("copies")).select(*by, "text_fp", "links")
    return rows.join(sized, [*by, "text_fp"])


def look_alike_pairs(prints: DataFrame, key: str, within: list[str] | None = None) -> DataFrame:
    """id_a < id_b with the same form (and the same ``within``) but other characters.

    Pairs are made between the different texts of a class; their rows come in afterwards, so copies of
    one text never meet each other and nothing is made that is not returned."""
    by = [*(within or []), "form_fp"]
    rows = checkpointed(look_alike_classes(prints, key, within).drop("links"))
    texts = rows.select(*by, "text_fp").distinct()
    other = texts.select(*by, F.col("text_fp").alias("other_fp"))
    pairs = texts.join(other, by).filter("text_fp < other_fp")
    a = rows.select(*by, "text_fp", F.col("id").alias("a"))
    b = rows.select(*by, F.col("text_fp").alias("other_fp"), F.col("id").alias("b"))
    met = pairs.join(a, [*by, "text_fp"]).join(b, [*by, "other_fp"]).filter("a <> b")
    return met.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
