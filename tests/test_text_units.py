"""Units, masks and offsets against plain restatements."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import lexicons as lx
from quillon.functions import text as tx
from quillon.operators.parse import parse, prepare, segments

BITS = ["Dr. Ames", "A. Orr", "went home", "etc.", "No. 5", "3.14", "why?!", '"Yes."', "(so.)", "...", "\n", "\n\n", "\n \n", " ", "\u00a0", "e.g. this", "end.", "vs. none", "🙂 x", "café", "a, b; c: d", "[x, y]", "“p, q”", "and", "or more", "  "]


def _texts(n=250, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) + rng.choice(["", " ", ". "]) for _ in range(rng.randint(0, 14))) for _ in range(n)] + ["", " \n ", "x" * 20000, "word. " * 3000]


def _trim(text, a, b):
    piece = text[a:b]
    return a + len(piece) - len(piece.lstrip()), a + len(piece.rstrip())


def plain_sentences(text):
    """Every candidate end is judged by what stands before it; then pieces are trimmed."""
    cuts = {len(text)}
    for m in re.finditer(r"[.!?]+", text):
        if not re.match(r"[\"')\]]*(?:\s|\Z)", text[m.end() :]):
            continue
        before = text[max(0, m.end() - 24) : m.end()]
        listed = "|".join(map(re.escape, lx.ABBREVIATIONS))
        if re.search(rf"\b(?:{listed})\.\Z", before, re.I) or re.search(r"\b[A-Z]\.\Z", before):
            continue
        cuts.add(m.end())
    cuts |= {m.start() for m in re.finditer(r"\n\s*\n", text)}
    out, at = [], 0
    for c in sorted(cuts):
        a, b = _trim(text, at, c)
        if a < b:
            out.append((a, b))
        at = c
    return out


def plain_segments(sentence):
    out, depth, quoted, start, i = [], 0, False, 0, 0
    while i < len(sentence):
        c = sentence[i]
        depth = depth + 1 if c in "([{" else max(0, depth - 1) if c in ")]}" else depth
        quoted = not quoted if c in '"“”' else quoted
        if c in ",;:" and not depth and not quoted and sentence[i + 1 : i + 2].isspace():
            out.append((start, i))
            i += 1
            while i < len(sentence) and sentence[i].isspace():
                i += 1
            start = i
        else:
            i += 1
    out.append((start, len(sentence)))
    out = [(a, b) for a, b in out if sentence[a:b].strip()]
    if len(out) >= 2:
        a, b = out[-1]
        m = re.search(r"\s+(?:and|or|nor)\s+", sentence[a:b], re.I)
        if m:
            out[-1:] = [(a, a + m.start()), (a + m.end(), b)]
    return out


@pytest.fixture(scope="module")
def texts():
    return _texts()


@pytest.fixture(scope="module")
def parsed(spark, texts):
    return parse(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path=None)


def _by_doc(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in cols))
    return {k: sorted(v) for k, v in out.items()}


def test_sentences(parsed, texts):
    got = _by_doc(parsed.sentences, "start", "end", "text", "sent_no", "n_words")
    for i, t in enumerate(texts):
        want = plain_sentences(t)
        assert [g[:2] for g in got.get(i, [])] == want, repr(t)
        for k, (a, b, s, no, n) in enumerate(got.get(i, [])):
            assert s == t[a:b] and no == k and n == len(re.findall(r"[A-Za-z][A-Za-z'’-]*", s))


def test_paragraphs_and_tokens(parsed, texts):
    paras, toks = _by_doc(parsed.paragraphs, "start", "end"), _by_doc(parsed.tokens, "pos", "start", "end", "word")
    for i, t in enumerate(texts):
        want, at = [], 0
        for m in [*re.finditer(r"\n\s*\n", t), None]:
            a, b = _trim(t, at, m.start() if m else len(t))
            want += [(a, b)] if a < b else []
            at = m.end() if m else 0
        assert paras.get(i, []) == want, repr(t)
        assert toks.get(i, []) == [(k, m.start(), m.end(), m.group()) for k, m in enumerate(re.finditer(r"[A-Za-z][A-Za-z'’-]*", t))]


def test_segments(parsed, texts):
    got = _by_doc(parsed.segments, "start", "end", "text")
    for i, t in enumerate(texts):
        want = [(a + x, a + y, t[a + x : a + y]) for a, b in plain_sentences(t) for x, y in plain_segments(t[a:b])]
        assert got.get(i, []) == sorted(want), repr(t)


def test_mask_keeps_offsets(spark):
    md = "# Head\n\n- item one\n12. two\n```\ncode # x\n```\ntext\n![f](a.png)\nin ![x](y) line\n"
    off = "a\nb PROSE: off b\nc\nd prose: on d\ne\nf prose: off\ng"
    rows = [(1, md, "a.md"), (2, md, "a.txt"), (3, off, "a.txt"), (4, None, "a.md"), (5, "```\nopen", "b.markdown"), (6, md, None)]
    got = {r["doc_id"]: r["text"] for r in prepare(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got[2] == got[6] == md and got[4] == "" and got[5] == "```\nopen"
    assert len(got[1]) == len(md) and [i for i, c in enumerate(got[1]) if c == "\n"] == [i for i, c in enumerate(md) if c == "\n"]
    assert got[1].split() == "item one two text in ![x](y) line".split()
    assert got[3].split() == ["a", "e"] and len(got[3]) == len(off)


def test_small_functions(spark):
    def value(c, v):
        return spark.createDataFrame([(v,)], "x string").select(c(F.col("x")).alias("y")).first()["y"]

    for w, n in {"made": 1, "table": 2, "free": 1, "the": 1, "beautiful": 3, "": 0, "hmm": 1, "'tis": 1}.items():
        assert value(tx.syllables, w) == n, w
    for w, c in {"the": "the", "running": "~ing", "Ames": "^", "quickly": "~adv", "nation": "~nom", "useful": "~adj", "cats": "~pl", "glass": "~n", "isn’t": "isn't"}.items():
        assert value(tx.word_class, w) == c, w
    for s, v in {"It worked.": True, "One plot.": False, "He doesn't.": True, "It's late.": True, "No bed.": False, "Nothing here.": True, "Walked home.": True}.items():
        assert value(lambda x: tx.has_finite_verb(tx.words(x)), s) is v, s


def test_matches_stand_where_they_are(spark):
    t = "Indeed, thus, 🙂 indeed, x THUS, y"
    df = spark.createDataFrame([(1, t), (2, ""), (3, "none"), (4, "thus,")], "doc_id long, text string")
    got = {(r["doc_id"], r["name"], r["start"], r["end"], r["text"]) for r in tx.matches(df, [("a", r"\b(?:indeed|thus),", True), ("b", "[xy]", False)]).collect()}
    every = {(k, n, m.start(), m.end(), m.group()) for k, x in ((1, t), (4, "thus,")) for n, p, f in (("a", r"\b(?:indeed|thus),", re.I), ("b", "[xy]", 0)) for m in re.finditer(p, x, f)}
    assert got == every


def test_many_matches_in_one_text(spark):
    """Work and memory grow with the matches: 100,000 of them in one text take seconds."""
    n = 100_000
    df = spark.createDataFrame([(1, "ab - " * n)], "doc_id long, text string")
    got = tx.matches(df, [("dash", "-", False)]).agg(F.count("*").alias("n"), F.max("end").alias("last"), F.sum("start").alias("sum")).first()
    assert (got["n"], got["last"], got["sum"]) == (n, 5 * n - 1, sum(5 * i + 3 for i in range(n)))
    brackets = spark.createDataFrame([(1, 0, 0, "(a, b) " * 20_000 + ", c")], "doc_id long, sent_no int, start int, text string")
    assert segments(brackets).count() == 2
