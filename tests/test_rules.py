"""Rules: fire and no-fire texts, budgets, runs and pairs against plain restatements."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.functions import lexicons as lx
from quillon.functions import patterns as pt
from quillon.operators import parallelism, rules
from quillon.operators.parse import parse
from quillon.plans import oracle, queries
from tests.test_text_units import plain_segments, plain_sentences

FIRES = [
    ("We delve into it.", "vocab"), ("So — it went.", "emdash"), ("So -- it went.", "emdash"), ("It is not just old but dear.", "negation"), ("This isn't a pan, it's a pot.", "negation"),
    ("The lamp is not loss. Rather, it gains.", "negation"), ("It was not a small one.", "litotes"), ("That is not unusual.", "litotes"), ("It serves as a guide.", "copula"), ("Rain is linked to mud.", "assoc"),
    ("Moreover, it rained.", "transitions"), ("Here's the thing about it.", "narrator"), ("It rained, highlighting the mud.", "participial"), ("In short it rained.", "recap"), ("That said, it rained.", "hedge"),
    ("From hill to dale, it rained.", "fromto"), ("They had one aim: money for the mill.", "colon"), ("It rained 🙂 here.", "emoji"), ("Why did it rain? Nobody knows it.", "question"), ("One. Two. Three pans.", "fragments"),
    ("They saw rain. They saw mud. They saw sun.", "opener"),
]
QUIET = [
    ('The word "delve" is quoted.', "vocab"), ("It was not a single one.", "litotes"), ("It ran until 5: 30 and on.", "colon"), ("One. Two.", "fragments"), ("The pan. The pot. The cup.", "opener"), ("A range from one to two it is", "fromto"),
    ("It--went.", "emdash"), ("The mill stands in rain.", "copula"),
]


def _parse(spark, texts):
    return parse(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), path=None)


def test_fire_and_quiet(spark):
    cases = FIRES + QUIET
    p = _parse(spark, [t for t, _ in cases])
    got = {(r["doc_id"], r["rule_id"]) for r in rules.hits(p).collect()}
    for i, (t, r) in enumerate(cases):
        assert ((i, r) in got) == (i < len(FIRES)), (t, r)


def test_pattern_hits_are_all_matches(spark):
    texts = [" ".join(t for t, _ in random.Random(i).sample(FIRES + QUIET, 6)) for i in range(30)]
    on = [r.id for r in pt.RULES.values() if r.patterns]
    got = sorted((r["doc_id"], r["rule_id"], r["start"], r["end"]) for r in rules.pattern_hits(_parse(spark, texts), on).collect())
    want = []
    for i, t in enumerate(texts):
        for r in on:
            for q in pt.RULES[r].patterns:
                q = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), q)
                want += [(i, r, m.start(), m.end()) for m in re.finditer(q, t, 0 if r in pt.CASE_SENSITIVE else re.I)]
    assert got == sorted(want)


def _words(t):
    return re.findall(r"[A-Za-z][A-Za-z'’-]*", t)


def _bare(t):
    return _words(re.sub(r"(?i)^(?:and|or|but|nor|then|so)\s+", "", t.strip()))


def _shape(t):
    w = _bare(t)
    if not w or len(w) > 14:
        return None
    cls = [x.lower() if x.lower() in lx.FUNCTION_WORDS else "#" for x in w[:2]] + [""]
    return cls[0], cls[1], len(w) // 3


def _streaks(values):
    """(first, last) of maximal stretches of one value, None apart, three or more."""
    i = 0
    while i < len(values):
        j = i
        while j + 1 < len(values) and values[j + 1] is not None and values[j + 1] == values[i]:
            j += 1
        if values[i] is not None and j - i >= 2:
            yield i, j
        i = j + 1


def _uncontained(found):
    kept = []
    for r in sorted(found, key=lambda r: (r[0], -(r[1] - r[0]), -r[3], r[4])):
        if not any(k[0] <= r[0] and r[1] <= k[1] for k in kept):
            kept.append(r)
    return {(r[0], r[1], r[2], r[3]) for r in kept}


def plain_runs(text):
    found, sents = [], plain_sentences(text)
    for a, b in sents:
        segs = [(a + x, a + y, text[a + x : a + y]) for x, y in plain_segments(text[a:b])]
        if len(segs) < 3:
            continue
        cut = [s[2] for s in segs]
        n = sorted(len(_words(s)) for s in cut[1:-1])[len(cut[1:-1]) // 2]
        if n >= 1:
            first, last = (_words(re.sub(r"(?i)^(?:and|or|but|nor|then|so)\s+", "", cut[k])) for k in (0, -1))
            cut[0] = " ".join(first[-n:]) if len(first) > n else cut[0]
            cut[-1] = " ".join(last[:n]) if len(last) > n else cut[-1]
        for rank, values in enumerate(([_shape(s) for s in cut], [(_bare(s[2]) or [None])[0] and _bare(s[2])[0].lower() for s in segs])):
            for i, j in _streaks(values):
                if not all(_words(s[2]) and _words(s[2])[0][0].isupper() for s in segs[i : j + 1]):
                    found.append((segs[i][0], segs[j][1], "in-sentence", j - i + 1, rank))
    for rank, values in enumerate(([_shape(text[a:b]) for a, b in sents], [(_bare(text[a:b]) or [None])[0] and _bare(text[a:b])[0].lower() for a, b in sents])):
        found += [(sents[i][0], sents[j][1], "cross-sentence", j - i + 1, 2 + rank) for i, j in _streaks(values)]
    paras, at = [], 0
    for m in [*re.finditer(r"\n\s*\n", text), None]:
        piece = text[at : m.start() if m else len(text)]
        a, b = at + len(piece) - len(piece.lstrip()), at + len(piece.rstrip())
        paras += [(a, b)] if a < b else []
        at = m.end() if m else 0
    leads = [(_bare(text[a:b]) or [None])[0] and _bare(text[a:b])[0].lower() for a, b in paras]
    found += [(paras[i][0], paras[j][1], "paragraph", j - i + 1, 4) for i, j in _streaks(leads)]
    return _uncontained(found)


def plain_pairs(text):
    def reason(left, right):
        a, b = _bare(left), _bare(right)
        if not (2 <= len(a) <= 14 and 2 <= len(b) <= 14 and abs(len(a) - len(b)) <= 3):
            return None
        la, lb = [w.lower() for w in a], [w.lower() for w in b]
        shared = [w for w in sorted(set(la) & set(lb)) if w not in lx.PRONOUNS and (w not in lx.FUNCTION_WORDS or w in lx.NEGATORS)]
        no = [bool(re.search(pt.NEGATOR, x, re.I)) for x in (left, right)]
        strong = [bool(re.search(pt.STRONG_NEGATOR, x, re.I)) for x in (left, right)]
        if la[0] == lb[0] and la[0] not in lx.PRONOUNS:
            return f"anaphora on '{la[0]}'"
        if la[:2] == lb[:2]:
            return f"repeated opening '{a[0]} {a[1]}'"
        if strong[0] != strong[1] and la[0] == lb[0] and abs(len(a) - len(b)) <= 2:
            return "antithesis, same opening"
        if no[0] != no[1] and shared:
            return f"antithesis on '{shared[0]}'"
        if all(no) and shared and shared[0] in lx.NEGATORS:
            return f"negated pair on '{shared[0]}'"

    sents, found = plain_sentences(text), []
    for rank, units in [(0, [(a + x, a + y) for x, y in plain_segments(text[a:b])]) for a, b in sents] + [(1, sents)]:
        for (a, b), (c, d) in zip(units, units[1:]):
            why = reason(text[a:b], text[c:d])
            if why:
                found.append((a, d, why, 2, rank))
    return {r[:3] for r in _uncontained(found)}


UNITS = ["the old pan fell", "the wet pot broke", "the red cup stood", "We saw rain", "we saw no mud", "it was not late", "it was late", "never a word", "never a sign", "Ames", "Orr", "Lee", "nothing came", "so it fell", "and it broke", "rain", "a long and slow road to the far side of the hill by the mill"]


def _random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(UNITS) + rng.choice([", ", "; ", ". ", ". ", ".\n\n", ", and "]) for _ in range(rng.randint(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_and_pairs(spark, seed):
    texts = _random_texts(120, seed)
    p = _parse(spark, texts)
    runs, pairs = {}, {}
    for r in parallelism.runs(p).collect():
        runs.setdefault(r["doc_id"], set()).add((r["start"], r["end"], r["level"], r["arity"]))
    for r in parallelism.doublets(p).collect():
        pairs.setdefault(r["doc_id"], set()).add((r["start"], r["end"], r["reason"]))
    for i, t in enumerate(texts):
        assert runs.get(i, set()) == plain_runs(t), t
        assert pairs.get(i, set()) == plain_pairs(t), t


def test_budgets_forgive_the_mild(spark):
    long = "The mill by the road was old and the people there kept lamps in it for years on end. "
    text = long * 30 + "We saw the pan, we saw the pot, we saw the cup, we saw the jar. They went far. They went late. They went home. "
    p = _parse(spark, [text])
    none, one = (rules.parallel(p, rules.Config(parallel_budget_per_1k=b)).count() for b in (0.0, 2.0))
    assert none - one == int(p.sizes.first()["n_words"] / 1000 * 2.0)
    assert rules.person(p, rules.Config()) is None and rules.runt(p, rules.Config()) is None


def test_runts_closers_vague_person(spark):
    para = "The people of the place kept to the old way of doing things all the time. "
    texts = ["One plot. It worked. We saw rain here.", para * 2 + "Rain fell.\n\n" + para * 2 + "No lamp.", para * 4, "You walk the road and you see the mill. I thank you. Thank you.", para * 4 + "It was 1987."]
    p = _parse(spark, texts)
    c = rules.Config(min_sentence_words=5, person_budget_per_1k=0.0, closer_budget_ratio=0.5)
    assert [(r["doc_id"], r["text"]) for r in rules.runt(p, c).filter("doc_id = 0").collect()] == [(0, "One plot.")]
    assert {r["text"] for r in rules.runt(p, rules.Config(min_sentence_words=5, runt_mode="all", allow_runts=frozenset({"It worked."}))).filter("doc_id = 0").collect()} == {"One plot.", "We saw rain here."}
    assert [r["text"] for r in rules.closer(p, c).filter("doc_id = 1").collect()] == ["No lamp."]
    assert [r["doc_id"] for r in rules.vague(p, c).collect()] == [2]
    assert [r["doc_id"] for r in rules.person(p, c).collect()] == [3]


def test_config_and_registration(spark):
    with pytest.raises(ValueError):
        rules.Config(disabled=("nosuch",))
    p = _parse(spark, ["Moreover, we delve. A zebra ran."])
    assert {r["rule_id"] for r in rules.hits(p, rules.Config(disabled=("transitions",))).collect()} == {"vocab"}
    assert rules.hits(p, rules.Config(allow=frozenset({"delve"}))).filter("rule_id = 'vocab'").count() == 0
    with pytest.raises(ValueError):
        rules.register_rule(pt.Rule("zebra", "L", "t", "w", "f"))
    rules.register_rule(pt.Rule("zebra", "L", "t", "w", "f", (r"\bzebra\b",)))
    try:
        assert rules.hits(p).filter("rule_id = 'zebra'").count() == 1
    finally:
        del pt.RULES["zebra"]
    counts = rules.counts(rules.hits(p), p.docs, spark)
    assert counts.count() == len(pt.RULES) and counts.agg(F.sum("n")).first()[0] == 2


def test_nothing_to_find(spark):
    empty = parse(spark.createDataFrame([], "doc_id long, text string"), path=None)
    assert rules.hits(empty).count() == 0 and parallelism.runs(empty).count() == 0
    blank = _parse(spark, ["", None, " \n\n "])
    assert rules.hits(blank, rules.Config(min_sentence_words=5, person_budget_per_1k=0.0)).count() == 0


def test_registered_queries_and_their_sql_mask(spark, tmp_path):
    body = "We walked by the mill for 20 minutes.\n\n# Moreover, a crucial nuance of 1999\n\n```\nMoreover, x delves into 1984\n```\n\nWe came home."
    off = "We walked home.\n\n<!-- prose: off -->\nMoreover, 1999.\n<!-- prose: on -->\n\nWe came home."
    spark.createDataFrame([(1, "a.md", body), (2, "a.txt", body), (3, "b.txt", off)], "doc_id long, path string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    d = str(tmp_path)
    hits = [(r["doc_id"], r["start"]) for r in queries.pattern_rule_hits(spark, d).filter("rule_id = 'transitions'").collect()]
    shown, hidden = body.index("Moreover, a"), body.index("Moreover, x")
    assert {(2, shown), (2, hidden)} <= set(hits) and not {(1, shown), (1, hidden), (3, off.index("Moreover"))} & set(hits)
    n = {r["doc_id"]: r["specifics"] for r in queries.specifics_counts(spark, d).collect()}
    assert n[1] < n[2]
    # the SQL masks as well
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    for name in ("masked_documents", "specifics_counts", "pattern_rule_counts", "fragment_runs", "runt_sentences", "segment_spans"):
        got = queries.QUERIES[name](spark, d)
        sql = con.execute(oracle.ORACLE[name])
        names = [c[0] for c in sql.description]
        assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, sql.fetchall())), name
