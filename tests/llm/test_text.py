"""Forms (2), sentences (3), markup (5), levels (6), repetition (7) and residue (10)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import p2_forms, p3_sentences, p5_markup, p6_level, p7_repetition, p10_residue

# ------------------------------------------------------------------ 2


def test_look_alikes_share_a_form():
    norm = p2_forms.Normaliser.of([("café", 5), ("place", 9), ("рlace", 1), ("окно", 4), ("oкнo", 1)])
    same = ["the café place", "the cafe\u0301 place", "ｔhe café place", "the\u00a0caf\u00e9\u2009place", "th\u200be café pla\u00adce", "the café \u0440lac\u0435"]
    assert {norm.form(t) for t in same} == {"the café place"}
    for other in ("The café place", "the cafe place", "the café place.", "the café  place", "the café\nplace"):
        assert norm.form(other) != "the café place"
    assert norm.form("окно") == norm.form("oкнo") == "окно"
    assert norm.form("ﬁne") == norm.form("fine") == "fine"
    assert norm.form(None) is None and norm.form("") == "" and norm.form("\u200b") == ""
    assert norm.form("“a”") != norm.form('"a"') and norm.form("x²") != norm.form("x2")


def test_forms_are_equal_exactly_if_looks_are():
    rng = random.Random(4)
    words = ["lamp", "lаmp", "Lamp", "fi", "ﬁ", "é", "e\u0301", "e", "ｌamp", "la\u00admp", "сор", "cop", "!", "！", " ", "\u00a0", "\n"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(600)]
    counted = {}
    for t in texts:
        for w in p2_forms._TOKEN.findall(t):
            counted[w] = counted.get(w, 0) + 1
    counted["сор"] = 1000
    norm = p2_forms.Normaliser.of(list(counted.items()))
    assert norm.known  # Cyrillic spellings are kept, where the table gives Latin ones
    form, look = {}, {}
    for t in texts:
        form.setdefault(norm.form(t), set()).add(t)
        look.setdefault(p2_forms.look(t), set()).add(t)
    assert sorted(map(sorted, form.values())) == sorted(map(sorted, look.values()))


def test_vocabulary_decides_what_a_stroke_stands_for(spark):
    """The table gives a stroke one letter; only the vocabulary tells whether it is an i or an L."""
    rows = [(1, "The Iron gate and the long lamp"), (2, "The \u04cfron gate and the \u04cfong \ua4f2amp"), (3, "The lron gate and the long lamp"), (4, "The Ir\u043en\u200b gate and the long lamp")]
    df = spark.createDataFrame(rows, "id long, text string")
    known = p2_forms.canonical(p2_forms.vocabulary((df.filter("id <> 3"), "text")))
    for most in (100, 0):  # broadcast, and joined
        prints = p2_forms.fingerprints(df, ["id"], "text", known, most)
        assert {tuple(r) for r in p2_forms.look_alike_pairs(prints, "id").collect()} == {(1, 2), (1, 4), (2, 4)}
    # without a vocabulary the table makes the stroke an L everywhere
    prints = p2_forms.fingerprints(df, ["id"], "text", known.limit(0))
    assert {tuple(r) for r in p2_forms.look_alike_pairs(prints, "id").collect()} == {(1, 4)}


def test_vocabulary_over_the_cluster_is_that_at_hand(spark):
    rng = random.Random(5)
    letters = "lIao\u0430\u043e\u04cf\u200be\u0301"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    df = spark.createDataFrame([(i, " ".join(words[i::20])) for i in range(20)], "id long, text string")
    counted = [tuple(r) for r in p2_forms.vocabulary((df, "text")).collect()]
    got = {r["word"]: r["canonical"] for r in p2_forms.canonical(p2_forms.vocabulary((df, "text"))).collect()}
    assert got and got == p2_forms.Normaliser.of(counted).known


def test_automaton_counts_visible_changes():
    trie = p2_forms.Trie.of([("lantern", 4), ("lectern", 2)])
    assert trie.spell("lаntern") == "lantern" and trie.spell("lantirn") is None
    assert trie.spell("lantirn", 1) == "lantern" and trie.spell("lanternn", 1) == "lantern" and trie.spell("latern", 1) == "lantern"


def test_pairs_of_look_alikes(spark):
    rows = [(1, "a b", 0), (2, "a\u00a0b", 0), (3, "a b", 0), (4, None, 0), (5, "A b", 0), (6, "", 0), (7, "\u200b", 0), (2, "a\u00a0b", 0), (None, "a b", 0)]
    df = spark.createDataFrame(rows, "result_id long, text string, form int")
    known = p2_forms.canonical(p2_forms.vocabulary((df, "text")))
    prints = p2_forms.fingerprints(df, ["result_id"], "text", known)
    assert {tuple(r) for r in p2_forms.look_alike_pairs(prints, "result_id").collect()} == {(1, 2), (2, 3), (6, 7)}
    classes = p2_forms.look_alike_classes(prints, "result_id").collect()
    assert {(r["id"], r["links"]) for r in classes} == {(1, 1), (3, 1), (2, 2), (6, 1), (7, 1)} and len({r["form_fp"] for r in classes}) == 2
    assert {r["word"]: r["n"] for r in p2_forms.vocabulary((df, "text")).collect()}["b"] == 6
    assert p2_forms.forms(df.limit(0), ["result_id"], "text", known).count() == 0


# ------------------------------------------------------------------ 3


@pytest.mark.parametrize(
    ("lang", "parts"),
    [
        ("en", ["Dr. Ames paid 3.50 to Orr & Co. for No. 5.", "It was late.", "See pp. 3-4 (cf. Fig. 2) at noon, e.g. here."]),
        ("en", ['"Is it dry?" said Orr.', '"No," she wrote, "it is wet."', "Nobody came!", "(They had left.)", "We knew."]),
        ("en", ["The pan was old ... or new, to be fair.", "J. K. Orr lost it.", "They sold pens, ink, etc.", "He left at 6.30 a.m.", "And she stayed"]),
        ("en", ["Version 1.2.3 of notes.txt is here.", "The U.K. pan of Oct. 3 broke?!", "Yes."]),
        ("de", ["Am 8. Mai kam Dr. Roth z. B. spät, d. h. ca. 4,5 Stunden.", "„Wo ist er?“, fragte sie.", "Gut."]),
        ("fr", ["« Où est la clé ? » demanda M. Paul.", "Mme Roux l'a vue (cf. p. 3).", "Quelle idée !"]),
        ("es", ["¿Dónde está el Sr. Paz?", "«¿Por qué?», preguntó la Dra. Gil.", "Fue, p. ej. en mayo."]),
        ("ru", ["В 1958 г. повар ушёл, т. е. пропал.", "«Кто там?» — спросил он.", "Никто."]),
        ("ar", ["قال د. المعلم: «القدر هنا»، ثم مضى.", "لماذا؟", "لا أحد يعرف."]),
        ("hi", ["डॉ. वैद्य ने 3.5 किलो खरीदी।", "क्या वह आया?", "हाँ।"]),
    ],
)
def test_sentences(lang, parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in p3_sentences.split(text, lang)] == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["“手稿在哪里？”编辑问。", "船长重3.5公斤。", "谁来了？"],
        ["「窓はどこですか。」と船長は言った。", "なぜ直したのか？", "誰も知らない（たぶん）。"],
    ],
)
def test_sentences_without_spaces(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in p3_sentences.split(text, None)] == parts


def test_thai_blank_lines_and_nothing():
    text = "ครูซื้อกระทะ หมอวัดบันได\nยามตรวจ"
    assert [text[a:b] for a, b in p3_sentences.split(text, "th")] == ["ครูซื้อกระทะ", "หมอวัดบันได", "ยามตรวจ"]
    text = "One line\nruns on. Next\n \n no end\n\nlast"
    assert [text[a:b] for a, b in p3_sentences.split(text, "en-XX")] == ["One line\nruns on.", "Next", "no end", "last"]
    assert p3_sentences.split(None) == p3_sentences.split("") == p3_sentences.split(" \n ") == []


def test_sentences_of_a_table(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "en", 1), (2, None, "en", 1), (3, "", None, 1), (1, "A b. C d.", "en", 1), (4, "x. " * 30000, "en", 1)], "span_id long, text string, lang string, start_off int")
    got = p3_sentences.sentences(df, "span_id", "text", "lang")
    assert got.filter("span_id = 1").distinct().count() == 2 and got.filter("span_id in (2, 3)").count() == 0 and got.count() > 4


def test_thai_sentences_end_at_any_run_of_blanks():
    for gap in (" ", "  ", "\n", "\r\n", " \n", "\n ", "\t \u00a0"):
        assert [("แมวนอน" + gap + "ฝนตกหนัก")[a:b] for a, b in p3_sentences.split("แมวนอน" + gap + "ฝนตกหนัก", "th")] == ["แมวนอน", "ฝนตกหนัก"], gap
    assert len(p3_sentences.split("มี 5  6 ตัว", "th")) == len(p3_sentences.split("มี 5 6 ตัว", "th"))


# ------------------------------------------------------------------ 5

MD = "# The *old* [mill](http://x.example/1) #\n\nIt cost $3 in May and $4 in June, so $a + b$ stays.\n\n```py\n# not a heading\nx = 1\n```\n\n1. First & **last**\n2. snake_case_name\n\nTitle\n-----\n\n$$\nE = 1\n$$\n\n> quoted\n"
HTML = "<H2 class=x>A &amp; <b>B</b></H2><!-- no --><ul><li>one <a href='u'>two</a>\n<li>three</li></ul><pre><code>a &lt; b\n c</code></pre><p>so \\(x &lt; y\\) it is<div>\\[z\\]</div><script>var h='<h1>no</h1>'</script>"
WIKI = "== Old '''mill''' ==\n* One [[a page|link]]<ref>p. 1</ref>\n# Two [http://x.example/1 words]\n<pre>\n== no ==\n</pre>\n:<math>a_1</math>\n[[Category:x]]\nText {{stub}} <math>b</math>."
TEX = "\\documentclass{article}\n\\begin{document}\n\\section*{A \\& \\emph{B \\textbf{C}}}\n\\begin{itemize}\n  \\item one \\href{u}{two}\n  \\item \\$3 % note\n\\end{itemize}\n\\begin{verbatim}\n\\section{no}\n\\end{verbatim}\nSo $p_1$ costs \\$4 and \\$5.\n\\[ q \\]\n\\begin{equation}\nr\n\\end{equation}\n\\end{document}"


@pytest.mark.parametrize(
    ("text", "path", "want"),
    [
        (MD, "a.md", [("heading", "The old mill"), ("formula", "a + b"), ("code", "# not a heading x = 1"), ("list_item", "First & last"), ("list_item", "snake_case_name"), ("heading", "Title"), ("formula", "E = 1")]),
        (HTML, "a.html", [("heading", "A & B"), ("list_item", "one two"), ("list_item", "three"), ("code", "a < b c"), ("formula", "x < y"), ("formula", "z")]),
        (WIKI, "a.wiki", [("heading", "Old mill"), ("list_item", "One link"), ("list_item", "Two words"), ("code", "== no =="), ("formula", "a_1"), ("formula", "b")]),
        (TEX, "a.tex", [("heading", "A & B C"), ("list_item", "one two"), ("list_item", "$3"), ("code", "\\section{no}"), ("formula", "p_1"), ("formula", "q"), ("formula", "r")]),
    ],
)
def test_elements(text, path, want):
    for p in (path, None, "b.text"):
        assert p5_markup.read(text, p).elements == want
    assert p5_markup.read(text, "a.txt").elements == []


def test_elements_at_the_edge(spark):
    rows = [(1, None, "a.md", 1), (2, "", "a.md", 1), (3, "plain words.", "a.md", 1), (4, "```\ncut off", "a.md", 1), (5, "<ul><li>cut", None, 1)]
    df = spark.createDataFrame(rows, "result_id long, text string, path string, kind int")
    assert {tuple(r) for r in p5_markup.elements(df, "result_id", "text", "path").collect()} == {(4, "code", "cut off"), (5, "list_item", "cut")}
    clean = {r["result_id"]: r["clean"] for r in p5_markup.clean_texts(df, "result_id", "text", "path").collect()}
    assert clean[1] is None and clean[2] == "" and clean[3] == "plain words." and len(clean) == 5


def test_template_classes(spark):
    from pyspark.sql import functions as F

    rows = [(1, "<ul><li>a</li></ul>", "h"), (2, "<ul><li>a</li><li>b</li></ul>", "h"), (3, None, "h")]
    df = spark.createDataFrame(rows, "id long, text string, host string")
    got = {r["marks"] for r in p5_markup.template_classes(df, "id", "text", F.col("host")).collect()}
    assert got == {"</ul <ul", "</li <li"}


def test_template_of_texts_without_path(spark, tmp_path):
    from quillon.llm import queries

    rows = [(i, p, "<b>one</b> and <i>two</i>") for i, p in enumerate(["a/x.html", "a/y.html", None, None])]
    spark.createDataFrame(rows, "result_id long, path string, text string").write.parquet(str(tmp_path / "results.parquet"))
    got = {r["host"]: r["pages"] for r in queries.p5_template(spark, str(tmp_path)).collect()}
    assert got == {"a html": 2, None: 2}


def test_braces_of_any_depth():
    assert p5_markup.tex_text(r"\emph{a {b {c {d {e}}}}} \textbf{\emph{x}}") == "a {b {c {d {e}}}} x"
    assert p5_markup.read(r"\section{One {two {three {four}}}}\begin{itemize}\item it\end{itemize}", "a.tex").elements[0] == ("heading", "One {two {three {four}}}")
    assert p5_markup.tex_text("\\emph{" + "{" * 3000) == "\\emph" + "{" * 3001  # never closed


def test_template_slots(spark):
    pages = [(f"p{i}", f"<h1>Head {i}</h1><ul>" + "".join(f"<li>item {i} {j}</li>" for j in range(i + 1)) + "</ul>$x_" + str(i) + "$", "h", 0) for i in range(5)]
    df = spark.createDataFrame([*pages, (None, None, "h", 0), ("q", "", None, 0), ("r", "$a$ and $b$", None, 0)], "k string, text string, host string, body int")
    classes = {tuple(r["marks"]) for r in p5_markup.ordered_classes(df, "k", "text", F.col("host")).filter("host = 'h'").collect()}
    assert classes == {("<h1", "</h1", "<ul", "</ul"), ("<li", "</li"), ("$",)}
    got = {(r["k"], r["body"]) for r in p5_markup.template_slots(df, "k", "text", F.col("host")).collect()}
    assert {("p2", "Head 2"), ("p2", "item 2 1"), ("p4", "x_4"), ("r", "a"), ("r", "b")} <= got
    assert p5_markup.template_slots(df.limit(0), "k", "text", F.col("host")).count() == 0


# ------------------------------------------------------------------ 6

EASY = ["The cat sat on the mat. We saw a dog. It was red and wet.", "He ran to the pond. A fish swam by. It was big.", "I have a hat. The hat is blue. We like it."]
HARD = [
    "Any interpretation that presupposes institutional legitimacy, although the epistemological stratification complicates differentiation, requires a methodological reconstruction whose authenticity is provisional.",
    "The historical transformation, which problematizes administrative configuration notwithstanding experimental refutation, consolidates the dissemination that comparative materiality undermines.",
    "Whereas the quantitative determination of sociological correspondence destabilizes hierarchical argumentation, the conceptualization which it necessitates accommodates every representation.",
]


def test_isotonic_never_falls():
    rng = random.Random(1)
    points = [(x, x / 10 + rng.uniform(-2, 2), 1.0) for x in range(50)]
    blocks = p6_level.isotonic(points)
    levels = [p6_level.mapped(blocks, x / 2) for x in range(-5, 120)]
    assert levels == sorted(levels)
    assert sum(y for _, y, _ in points) == pytest.approx(sum(p6_level.mapped(blocks, x) for x, _, _ in points))


def test_models_are_distributions():
    m = p6_level.Model(symbols=5)
    for s in (["a", "b"], ["a", "c"], ["b"]):
        m.add(s)
    assert sum(m.p(("<s>", "a"), x) for x in "abcde") == pytest.approx(1, abs=1e-9)


def test_surprisal_of_sentences_is_that_of_their_grams():
    rows = [(t, 1) for t in EASY] + [(t, 3) for t in HARD]
    models, blocks, left_out = p6_level.fit(rows)
    sents = p6_level.sentences_of(EASY[0], models.symbols)
    bits = models.surprisal(sents)
    for (seq, _), row in zip(sents, bits, strict=True):
        padded = ["<s>", "<s>", *seq]
        for m, x in zip(models.models, row, strict=True):
            assert x == pytest.approx(-sum(math.log2(m.p(tuple(padded[i : i + 2]), padded[i + 2])) for i in range(len(seq))))
    assert models.levels == [1, 3] and len(left_out) == len(rows)
    assert p6_level.score(models, []) is None and p6_level.score(models, p6_level.sentences_of(HARD[0], models.symbols)) > p6_level.score(models, sents)


def test_fit_trains_once_a_fold(monkeypatch):
    """The work grows with the number of reference texts, not with its square."""
    times = []
    train = p6_level.train
    monkeypatch.setattr(p6_level, "train", lambda samples, symbols: times.append(len(samples)) or train(samples, symbols))
    rows = [(t, 1) for t in EASY] * 20 + [(t, 3) for t in HARD] * 20
    p6_level.fit(rows)
    assert len(times) == 11 and sum(times) == 10 * len(rows)


def test_known_words_stand_for_themselves():
    symbols = p6_level.Symbols(p6_level.well_known(["the pan was hot"] * 4 + ["a rare kettle"]))
    assert symbols["Pan"] == "pan" and symbols["kettle"] == p6_level.kind("kettle") and symbols["42"] == "0"


def test_levels_of_left_out_texts(spark):
    samples = spark.createDataFrame([(i, t, 1) for i, t in enumerate(EASY)] + [(9 + i, t, 3) for i, t in enumerate(HARD)] + [(99, None, 2)], "sample_id long, text string, reading_level int")
    rows = [(1, EASY[0] + " She has a pan. It is hot.", "en"), (2, HARD[0] + " " + HARD[2], "EN"), (3, None, "en"), (4, " ", "en"), (5, "Der Hund und die Katze sind nicht auf dem Tisch.", "de"), (6, "42!", "en")]
    results = spark.createDataFrame(rows, "result_id long, text string, lang string")
    sty = spark.createDataFrame([(1, 5.0, None), (2, float("nan"), None), (2, 900.0, None)], "result_id long, gunning_fog double, analyzed_at timestamp")
    sig = spark.createDataFrame([], "result_id long, smog double, subordination double, analyzed_at timestamp")
    got = {r["result_id"]: r["level"] for r in p6_level.graded(results, samples, sty, sig, "result_id", "text", "lang").collect()}
    assert got == {1: 1, 2: 3}


# ------------------------------------------------------------------ 7


def test_phrase_share_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randint(2, 40))]
        n = min(4, max(1, len(words) // 2))
        cov, seen = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in seen:
                cov |= set(range(i, i + n))
            seen.add(g)
        assert p7_repetition.phrase_share(words, 4) == pytest.approx(len(cov) / len(words))


def test_measures():
    once = "The early lamp was warm and the old road was long. Nobody came to the mill before the frost."
    assert p7_repetition.measures(once)[0] < 0.1
    assert p7_repetition.measures(once + "\n\n1) " + once.upper() + " 2) " + once.replace(".", "!"))[0] > 0.6
    assert p7_repetition.measures(None)[:3] == p7_repetition.measures("")[:3] == (0.0, 0.0, 0.0)
    assert p7_repetition.measures("船长在桥下修好了字典，后来又忘了。" * 4)[0] > 0.7


def test_repeated_short_sentences_count(spark):
    nouns = "mill road pan lake barn gate lamp hill shed door".split()
    text = " ".join(f"Orr{'abcdefghij'[i]} held {w} {w[::-1]}. Come and buy it today." for i, w in enumerate(nouns))
    words = [w for s in text.replace(".", "").split(". ") for w in s.split()]
    share = p7_repetition.measures(text)[0]
    assert len(words) == 90 and share == pytest.approx(9 * 5 / 90)
    # a word in a repeated phrase and a repeated sentence counts once
    said = "The early lamp was warm and the old road was long."
    assert p7_repetition.measures(f"{said} {said}")[0] == pytest.approx(0.5)
    hits = spark.createDataFrame([], "result_id long, rule_id string, note string")
    got = p7_repetition.judged(spark.createDataFrame([(1, text)], "result_id long, text string"), hits, "result_id", "text").first()
    assert got["share"] >= p7_repetition.THRESHOLD


def test_trust_follows_the_better_voters():
    rng = random.Random(3)
    counts, truth = {}, {}
    for _ in range(4000):
        y = rng.random() < 0.1
        v = (*((int(y) if rng.random() < 0.95 else 1 - int(y)) for _ in range(3)), rng.choice([-1, 0, 1]))
        counts[v] = counts.get(v, 0) + 1
        truth.setdefault(v, []).append(y)
    post = p7_repetition.trust(sorted(counts.items()))
    right = sum(sum(y == (post[v] >= 0.5) for y in ys) for v, ys in truth.items())
    assert right / 4000 > 0.97
    assert p7_repetition.trust([]) == {}


def test_judged_table(spark):
    said = "The early lamp was warm and the old road was long. "
    rows = [(1, said * 6, 0), (2, None, 0), (3, "", 0)] + [(10 + i, f"Number {i} walked from the {w} to the shed and kept a {w} there until winter came.", 0) for i, w in enumerate("mill road pan lake barn gate".split())]
    results = spark.createDataFrame(rows, "result_id long, text string, share int")
    hits = spark.createDataFrame([(1, "Template ", "seen 6 times"), (1, "template", "seen 6 times"), (2, None, None), (None, "template", "n=3")], "result_id long, rule_id string, note string")
    got = {r["result_id"]: r for r in p7_repetition.judged(results, hits, "result_id", "text").collect()}
    assert len(got) == len(rows) and got[1]["share"] > 0.8 and got[1]["posterior"] > 0.5 and got[2]["share"] == 0.0
    assert p7_repetition.judged(results.limit(0), hits, "result_id", "text").count() == 0


def test_posterior_takes_the_place_of_passing_all(spark):
    rng = random.Random(12)
    nouns = [a + b for a in "ba re mi lo tu sa ke do".split() for b in "lan ter mos vin gal pet rud".split()]
    said = lambda n: " ".join(rng.choice(nouns) for _ in range(n))
    plain = [(i, " ".join(f"{said(9)}." for _ in range(12))) for i in range(300)]
    whole = [(1000 + i, f"{said(9)}. " * 14) for i in range(20)]  # the same sentence
    phrases = []
    for i in range(8):  # the same phrase in sentences that all differ
        phrase = said(8)
        phrases.append((2000 + i, " ".join(f"{w} {phrase}." for w in rng.sample(nouns, 14))))
    results = spark.createDataFrame(plain + whole + phrases, "result_id long, text string")
    hits = spark.createDataFrame([], "result_id long, rule_id string, note string")
    got = {r["result_id"]: r["posterior"] for r in p7_repetition.judged(results, hits, "result_id", "text").collect()}
    assert {k for k, v in got.items() if v >= 0.5} == {k for k, _ in whole + phrases}
    voted = p7_repetition.votes(p7_repetition.measured(results, "result_id", "text").withColumn("times", F.lit(None).cast("long")))
    # they do not pass all rules: without the posterior they would be lost
    assert {r["result_id"] for r in voted.filter("v_sentence = 0 AND v_grams = 1").collect()} == {k for k, _ in phrases}


def test_widths_and_parts():
    assert p7_repetition.width(["a"] * 9) == 6 and p7_repetition.width(["字"] * 9) == 12 and p7_repetition.width(["ก"] * 9) == 20 and p7_repetition.width(["字", "a"]) == 9
    sentences, paragraphs = p7_repetition.parts("It's 3.5 pans. Wet!\n\nA pan\nand more")
    assert sentences == [["it's", "pans"], ["wet"], ["a", "pan"], ["and", "more"]] and paragraphs == [["it's", "pans", "wet"], ["a", "pan", "and", "more"]]
    assert p7_repetition.gram_share(["a"] * 5, 2) == 0.75 and p7_repetition.gram_share(["a"], 2) == 0.0


# ------------------------------------------------------------------ 10

RESIDUE = ["Error 404 - page not found.", "Dear {{name}},\n\nthank you for {{title}}.", "Please enable JavaScript to read this page.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Your text goes here\nTBD", "The talk by %%speaker%% began late. " + "It rained on the old mill all day. " * 30]
PROSE = ["We walked to the mill and saw the old lamp.", 'The sign said "page not found" and we laughed at it for a while by the road.', "The letter used `{{name}}` as its example, and Orr explained it.", "In class Orr taught JavaScript and asked us to enable it only for the lesson on lamps, roads and mills of the county."]


def test_weak_labels():
    assert all(p10_residue.weak_label(t) == 1 for t in RESIDUE)
    assert all(p10_residue.weak_label(t) in (0, -1) for t in PROSE)
    assert p10_residue.fields("see [1] and [sic] in {2, 18}, a < b, $5") == 0


def test_residue_table(spark):
    rng = random.Random(6)
    nouns, rows = "mill road pan lake barn gate lamp hill shed door".split(), []
    for i in range(120):
        rows.append((i, " ".join(f"We {rng.choice(['saw', 'held', 'moved'])} the {rng.choice(nouns)} by the {rng.choice(nouns)}." for _ in range(rng.randint(1, 9))), f"host{i % 20}", 1))
    rows += [(200 + i, RESIDUE[i % 6].replace("404", str(400 + i)), f"host{i % 20}", 1) for i in range(60)]
    rows += [(300, None, "h", 1), (301, " \n", "h", 1), (302, "", None, 1), (None, RESIDUE[0], "h", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    got = {r["doc_id"]: r["residue"] for r in p10_residue.scored(df, "doc_id", "text", "source").collect()}
    assert len(got) == len(rows)
    assert {k for k, v in got.items() if v} == {200 + i for i in range(60)} | {None}
    _, figures = p10_residue.train(df, "doc_id", "text", "source")
    assert figures["accuracy"] > 0.95
    assert p10_residue.scored(df.limit(0), "doc_id", "text", "source").count() == 0


_STEPS = "load read open find join send close fetch parse check apply write merge build start route serve".split()
LONG_RESIDUE = [
    "Traceback (most recent call last):\n" + "".join(f'  File "/srv/app/{s}.py", line {20 + i}, in {s}_page\n    return self.{s}(request, depth={i})\n' for i, s in enumerate(_STEPS)) + "KeyError: 'title'",
    "java.lang.NullPointerException: null\n" + "".join(f"\tat com.site.pages.{s.title()}Step.{s}({s.title()}Step.java:{40 + i})\n" for i, s in enumerate(_STEPS)) + "Caused by: java.io.IOException: stream closed",
    "502 Bad Gateway\n\nThe proxy server received an invalid response: the host behind it closed the connection. The page could not be loaded and is temporarily unavailable.\n\n"
    "Error code: 502. Service unavailable. Please try again later, or ask the owner of the site whether it is down for maintenance.\n\nWhat happened? Something went wrong between the proxy and the host, which did not answer.\n"
    "What can I do? If you have no permission to see the page, access denied is shown in its place; the file was not found if it has been removed or has been moved.\n\n"
    "HTTP status 504 - internal server error - too many requests. Oops, that page no longer exists. This address is not available from the gateway. Forbidden for now.",
    "We use cookies\n\nThis site needs scripts and cookies. Please enable JavaScript and allow cookies, then sign in again to read on. Accept all cookies or choose which cookies to accept below.\n\n"
    "Strictly needed: cookies on, always allow. Figures: cookies that count visits, accept or refuse. Offers: cookies of our partners, accept or refuse.\n\n"
    "Before you go on, verify that you are human: complete the check below, as there was unusual traffic from your network. If the captcha does not show, scripts are blocked in your browser; turn off any ad blocker.\n\n"
    "Your session has expired. Log in to your account or subscribe to read without limits. This offer cannot be shown from your region. Checking your browser. Accept all. Enable JavaScript.",
    "Untitled document\n\nYour headline goes here. Click to add a subtitle, or replace this text with your own. Put two or three lines about yourself here, then add your picture and a caption for it.\n\n"
    "Section one: your text goes here. Enter a short introduction; write three sentences on what the reader will learn. TBD\n\nSection two: sample text. Type the body of the article here and add your links below. This is placeholder copy: click to edit. TODO\n\n"
    "Section three: dummy text, fill in later. Enter your name, put a few words about the author and add your address. Coming soon.\n\nFooter: placeholder. Replace this line; the date comes here as dd/mm/yyyy. Write your motto here, or type the name of the town. TBD",
]


def test_residue_of_any_length(spark):
    assert all(len(p10_residue.own_words(t).strip()) > 600 for t in LONG_RESIDUE) and all(p10_residue.weak_label(t) == 1 for t in LONG_RESIDUE)
    rng = random.Random(8)
    nouns = "mill road pan lake barn gate lamp hill shed door".split()
    said = lambda n: " ".join(f"We {rng.choice(['saw', 'held', 'moved'])} the {rng.choice(nouns)} by the {rng.choice(nouns)}." for _ in range(n))
    told = [f"{said(20)} {p} {said(20)}" for p in ("The server was forbidden and showed an error 404.", "In class Orr taught JavaScript.", "Once the page could not be found.", "\n```\n" + LONG_RESIDUE[0] + "\n```\n")]
    assert all(p10_residue.weak_label(t) in (0, -1) for t in told)
    rows = [(i, said(rng.randint(1, 40)), f"host{i % 20}") for i in range(120)] + [(200 + i, RESIDUE[i % 6].replace("404", str(400 + i)), f"host{i % 20}") for i in range(60)]
    rows += [(300 + i, t, "far") for i, t in enumerate(LONG_RESIDUE)] + [(400 + i, t, "far") for i, t in enumerate(told)]
    got = p10_residue.scored(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").filter("residue").collect()
    assert {r["doc_id"] for r in got} == {200 + i for i in range(60)} | {300 + i for i in range(len(LONG_RESIDUE))}


def test_classifier_finds_what_no_label_names(spark):
    rng = random.Random(9)
    nouns = "mill road pan lake barn gate lamp hill shed door".split()
    ends = ["Go back to the start page.", "If this keeps happening, tell the webmaster.", "Reference: 5402317"]
    rows = [(i, " ".join(f"We {rng.choice(['saw', 'held', 'moved'])} the {rng.choice(nouns)} by the {rng.choice(nouns)}." for _ in range(rng.randint(1, 9))), f"host{i % 20}") for i in range(200)]
    rows += [(300 + i, f"Error {400 + i % 12}\n\nThe page could not be found.\n{ends[i % 3]}", f"host{i % 20}") for i in range(60)]
    unseen = [f"{500 + i}\n\nStranica nije pronadena.\n{e}" for i, e in enumerate(ends)]
    rows += [(400 + i, t, "far") for i, t in enumerate(unseen)]
    assert all(p10_residue.weak_label(t) != 1 for t in unseen)  # the labels alone would lose them
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"] for r in p10_residue.scored(df, "doc_id", "text", "source").filter("residue").collect()}
    assert got == {300 + i for i in range(60)} | {400 + i for i in range(3)}


def test_nonce_filler_is_labelled():
    assert p10_residue.weak_label("Tu corne tuoresne atdaumlo velum umbiquami. " * 6) == 1
    assert p10_residue.weak_label("Il y avait un moulin sous le pont et la rivière est dans le pré. " * 4) == 0


def test_slices_and_flattening():
    assert list(p10_residue.slices(["aa", "bbb", "c" * 9, "d"], 5)) == [(0, 2), (2, 3), (3, 4)] and list(p10_residue.slices([])) == []
    assert p10_residue.flattened(["ｅｒｒ​or", "a\x1eb", ""]) == ["error", "a b", ""]
    doc, column, value, shape = p10_residue.features(["", "one two", "one two"])
    assert set(doc.tolist()) == {1, 2} and sorted(column[doc == 1]) == sorted(column[doc == 2]) and shape.shape == (3, 9)
