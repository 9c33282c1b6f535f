"""Features, corpus statistics, reviews, stores, streams and the command line."""

import json
import math
import random
import re
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon import cli
from quillon.functions import lexicons as lx
from quillon.operators import corpus, features, review, rules, sequence, templates
from quillon.operators.parse import parse
from quillon.sources import config, reports, stores
from quillon.sources import corpus as files
from quillon.streaming import batches

WORDS = "the mill road lamp old wet of and rain fell good lost cold warm beautiful interesting we saw it".split()


def _text(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", ".", ".\n\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    return [_text(n, n) for n in (3, 20, 31, 32, 49, 50, 51, 120, 300)] + ["", None, "42!"]


@pytest.fixture(scope="module")
def parsed(spark, texts):
    return parse(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path=None)


def _rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def _words(t):
    import re

    return [w.lower() for w in re.findall(r"[A-Za-z][A-Za-z'’-]*", t or "")]


def test_stylometry(parsed, texts):
    got = _rows(features.stylometry(parsed))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = _words(t)
        windows = [len(set(w[k : k + 50])) / 50 for k in range(len(w) - 49)] or ([len(set(w)) / len(w)] if w else [0])
        assert got[i]["lexical_diversity"] == pytest.approx(statistics.mean(windows), abs=6e-5)
        c = Counter(w)
        bits = -sum(n / len(w) * math.log2(n / len(w)) for n in c.values())
        assert got[i]["entropy_bits"] == pytest.approx(bits, abs=6e-4)
        assert got[i]["lexical_density"] == pytest.approx(sum(x not in lx.FUNCTION_WORDS for x in w) / max(1, len(w)), abs=6e-5)
        assert got[i]["word_burstiness"] == pytest.approx(statistics.pstdev(c.values()) / statistics.mean(c.values()) if c else 0, abs=6e-5)


def test_metrics_and_cadence(parsed, texts):
    lens = {}
    for r in parsed.sentences.collect():
        lens.setdefault(r["doc_id"], []).append((r["sent_no"], r["n_words"]))
    m, c = _rows(features.metrics(parsed)), _rows(features.cadence(parsed))
    for i in range(len(texts)):
        n = [x for _, x in sorted(lens.get(i, []))] or [0]
        run = best = 1
        for a, b in zip(n, n[1:]):
            run = run + 1 if abs(a - b) <= 4 else 1
            best = max(best, run)
        assert m[i]["longest_flat_run"] == best
        assert m[i]["stdev_len"] == pytest.approx(statistics.pstdev(n), abs=0.06)
        islands = "".join("s" if x <= 7 else "L" for x in n) if i in lens else ""
        mass, at = 0, 0
        for part in islands.split("L"):
            mass += sum(n[at : at + len(part)]) if len(part) >= 3 else 0
            at += len(part) + 1
        assert c[i]["run_mass"] == pytest.approx(mass / max(1, sum(n)), abs=6e-5)
        assert (c[i]["verdict"] == "n/a") == (i not in lens)
    assert c[10]["choppiness"] == 0.0 and m[10]["sentences"] == 0 and m[10]["pct_short"] == 1.0


def test_chunks_abstain_and_measure(parsed, texts):
    got = _rows(features.chunk_signals(parsed))
    for i, t in enumerate(texts):
        w = _words(t)
        matched = sum(x in lx.POSITIVE or x in lx.NEGATIVE for x in w)
        assert got[i]["valence_tokens"] == matched
        if matched < 15 or len(w) < 32:
            assert got[i]["mean_sentiment"] is None and got[i]["sentiment_variance"] is None
            continue
        size = len(w) // 8
        v = []
        for k in range(8):
            part = w[k * size : (k + 1) * size]
            a, b = sum(x in lx.POSITIVE for x in part), sum(x in lx.NEGATIVE for x in part)
            v.append((a - b) / (a + b) if a + b else 0)
        assert got[i]["mean_sentiment"] == pytest.approx(statistics.mean(v), abs=6e-4)
        assert got[i]["sentiment_variance"] == pytest.approx(statistics.pvariance(v), abs=6e-5)


def test_reader_and_punch_have_every_document(parsed, texts):
    for df in (features.reader_signals(parsed), features.reader_notes(features.reader_signals(parsed, "general")), features.person_mix(parsed), review.punch(parsed), templates.template_rates(parsed)):
        assert df.count() == len(texts)
    with pytest.raises(ValueError):
        features.reader_signals(parsed, "nobody")


def test_structure_against_chance(spark):
    loop = "The old mill stood by the wet road and the red lamp hung in the dark hall. " * 8
    p = parse(spark.createDataFrame([(0, loop), (1, _text(200, 5)), (2, "Short text.")], "doc_id long, text string"), path=None)
    got = _rows(templates.against_chance(p))
    assert got[0]["structure"] > 1 and got[2]["structure"] is None
    cr = _rows(templates.compression_ratio(p))
    assert cr[0]["cr_pos"] > cr[1]["cr_pos"] and cr[2]["cr_pos"] == 1.0
    assert _rows(templates.template_rates(p))[0]["template_rate"] == 1.0


def test_audit_to_weights_and_back(spark, tmp_path):
    docs = spark.createDataFrame([(i, "machine" if i < 5 else "human" if i < 10 else None, 100) for i in range(11)], "doc_id long, side string, n_words int")
    corpus.require_docs(docs)
    with pytest.raises(ValueError):
        corpus.require_docs(docs.filter("doc_id > 0"))
    n = [(i, "vocab", 4 if i < 5 else 1) for i in range(10)] + [(i, "emdash", 1) for i in range(10)] + [(0, "colon", 1), (9, "hedge", 2), (1, "hedge", 1)]
    audit = corpus.rule_audit(corpus.rule_rates(docs, spark.createDataFrame(n, "doc_id long, rule_id string, n long")))
    got = {r["rule_id"]: r for r in audit.collect()}
    assert len(got) == 24 and got["vocab"]["enrichment"] == 4.0 and got["vocab"]["verdict"] == "live" and got["emdash"]["verdict"] == "dead"
    assert got["colon"]["verdict"] == "machine-only" and got["hedge"]["verdict"] == "inverted" and got["recap"]["verdict"] == "unobserved"
    assert {r["rule_id"] for r in corpus.not_discriminating(audit).collect()} == {"emdash", "hedge"}
    weights = corpus.measured_weights(audit)
    w = {r["rule_id"]: r["weight"] for r in weights.collect()}
    assert w["vocab"] == 2.0 and w["emdash"] == 0.0 and w["colon"] == 5.0
    pins = corpus.pinned(weights, {"vocab": 5.0, "emdash": 0.2})
    assert [r["rule_id"] for r in corpus.disagreements(pins).collect()] == ["vocab"]
    path = str(tmp_path / "w.json")
    stores.write_weights(pins, path)
    back = {r["rule_id"]: r for r in stores.read_weights(spark, path).collect()}
    assert back["colon"]["enrichment"] == math.inf and back["vocab"]["effective"] == 5.0 and back["recap"]["effective"] == 0.0
    (tmp_path / "v2.json").write_text(json.dumps({"version": 2}))
    with pytest.raises(ValueError):
        stores.read_weights(spark, str(tmp_path / "v2.json"))


def test_effect_sizes(spark):
    v = [("machine", "a", 1.0), ("machine", "a", 3.0), ("human", "a", 0.0), ("human", "a", 2.0), ("machine", "b", 1.0), ("machine", "b", 1.0), ("human", "b", 1.0), ("human", "b", 1.0), ("machine", "c", 1.0), (None, "a", 99.0)]
    got = {r["feature"]: r["cohens_d"] for r in corpus.feature_audit(spark.createDataFrame(v, "side string, feature string, value double")).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_voice(spark, tmp_path):
    p = parse(spark.createDataFrame([(i, _text(200 + 10 * i, i)) for i in range(7)] + [(9, "Too short.")], "doc_id long, text string"), path=None)
    style = features.stylometry(p)
    voice = corpus.voiceprint(style)
    rows = {r["feature"]: r for r in voice.collect()}
    vals = [r["gunning_fog"] for r in style.filter("words >= 150").collect()]
    med = statistics.median(vals)
    assert rows["gunning_fog"]["center"] == pytest.approx(med) and rows["gunning_fog"]["n_docs"] == 7
    assert rows["gunning_fog"]["scale"] == pytest.approx(1.4826 * statistics.median(abs(x - med) for x in vals), abs=1e-5)
    assert rows["contraction_rate"]["scale"] == 0.0
    z = corpus.deviations(style, voice)
    assert z.filter("feature = 'contraction_rate'").count() == 0
    assert corpus.interpretation(z, 0.5).filter("size(notes) > 0").count() > 0
    path = str(tmp_path / "v.json")
    stores.write_voiceprint(voice, path, ["b", "a"])
    assert {(r["feature"], r["center"], r["scale"]) for r in stores.read_voiceprint(spark, path).collect()} == {(k, r["center"], r["scale"]) for k, r in rows.items()}
    with pytest.raises(ValueError):
        corpus.voiceprint(style.limit(0))


def test_worst_paragraphs_and_scores(spark):
    text = "We delve into it here.\n\nMoreover, the plan is crucial and vital, thus, it goes.\n\nThe pan fell over the mill."
    p = parse(spark.createDataFrame([(0, text), (1, "")], "doc_id long, text string"), path=None)
    found = rules.hits(p, rules.Config(vague_min_words=99))
    scored = review.paragraph_scores(p, found)
    worst = review.worst_paragraphs(scored, 1).first()
    assert worst["para_index"] == 2 and worst["line_no"] == 3 and set(worst["rules"]) == {"transitions", "vocab"} and worst["hits"] == 4
    s = _rows(review.scores(found, p.sizes))
    n = len(_words(text))
    assert s[0]["total"] == 5 and s[0]["score"] == pytest.approx((3 * 3 + 2 * 2) / n * 1000, abs=0.01) and s[1]["score"] == 0.0
    r = _rows(review.review(p, rules.Config(max_hits=2, vague_min_words=99), found))
    assert not r[0]["passed"] and r[0]["over"] and r[0]["instructions"][0]["rule_id"] == "vocab" and r[1]["passed"]
    assert "L3 crucial" in reports.render_agent(r[0]) and reports.render_agent(r[1]) == "PASS"


def test_review_notes_and_worst(spark):
    flat = "The people by the mill kept an old lamp there. " * 8
    choppy = "Rain. Mud. Sun. Then nothing. A quiet end. We walked home, and it rained."
    bad = "We delve into it here, by the mill.\n\nMoreover, the plan is crucial and vital, thus, it goes.\n\nThe pan fell over the mill, which had stood for longer than anyone could say. Moreover, it rained."
    p = parse(spark.createDataFrame([(0, flat), (1, choppy), (2, bad), (3, "")], "doc_id long, text string"), path=None)
    c = rules.Config(vague_min_words=999, disabled=("fragments", "opener", "template", "closer", "runt", "doublet", "parallel"))
    r = _rows(review.review(p, c))
    assert r[0]["passed"] and r[0]["notes"][-2:] == ["flat sentence length", "long run of like sentences"] and r[0]["worst"] is None
    assert reports.render_agent(r[0]) == "PASS\n" + "\n".join(f"! {n}" for n in r[0]["notes"])
    assert [n.split()[0] for n in r[1]["notes"][:2]] == ["punch", "choppiness"]
    assert r[3]["notes"] == [] and reports.render_agent(r[3]) == "PASS"
    w = {x["doc_id"]: x for x in review.worst_paragraphs(review.paragraph_scores(p, rules.hits(p, c)), 1).collect()}
    assert set(w) == {i for i in r if r[i]["worst"]} and w[2]["para_index"] == 2
    for i, x in w.items():
        assert r[i]["worst"] == f"P{x['para_index']} (L{x['line_no']}, {x['words']}w): {x['hits']} hits, weight {x['weighted']:.0f} [{', '.join(x['rules'])}]"
    assert f"worst: {r[2]['worst']}" in reports.render_agent(r[2])
    heard = _rows(review.notes(p, rules.Config(audience="expert")))
    assert "too few valence words to judge sentiment" in heard[0]["notes"]
    voice = spark.createDataFrame([("mean_sentence_len", 40.0, 1.0, 3, 900)], "feature string, center double, scale double, n_docs long, n_words long")
    assert any(n.startswith("mean_sentence_len") for n in _rows(review.notes(p, voice=voice))[0]["notes"])


def test_drift_verdicts(spark):
    plain = "The people by the mill kept an old lamp in the hall and they lit it when the rain fell on the road to town. "
    rows = [
        (1, plain + "Moreover, we delve into it while the rain goes on and on.", plain + "We look at it while the rain goes on and on over there."),
        (2, plain, "Rain. Mud. " + plain),
        (6, plain + "Moreover, we delve into it.", plain + "Rain soaked bright copper lamps near stone walls."),
        (3, plain, plain),
        (4, plain, plain + "Moreover, the rain kept on falling over all of the road and the mill."),
    ]
    df = spark.createDataFrame([(i, s, t) for i, b, a in rows for s, t in (("before", b), ("after", a))] + [(5, "before", plain)], "pair_id long, side string, text string")
    got = {r["pair_id"]: r["verdict"] for r in review.drift(df, rules.Config(vague_min_words=999)).collect()}
    assert got == {1: "traded", 6: "improved", 2: "choppy", 3: "overfit", 4: "churned"}


def test_alignment_and_surprise(spark):
    assert sequence.align_units(["the", "#", "of"], ["the", "#", "of"]) == (5.0, 3, 1.0, 0.833)
    assert sequence.align_units([], ["a"]) == (0.0, 0, 0.0, 0.0)
    assert sequence.align_units(["a", "b"], ["x", "a", "y", "b"])[0] == 2.5

    class Flat:
        def logprobs(self, text):
            return [-1.0] * len(text.split())

    df = spark.createDataFrame([(0, "x " * 70), (1, "x y"), (2, "")], "doc_id long, text string").withColumn("lps", sequence.logprobs(F.col("text"), Flat))
    got = _rows(sequence.perplexity_windows(df, "doc_id", "lps"))
    assert got[0]["token_count"] == 70 and got[0]["perplexity"] == pytest.approx(math.e, abs=1e-3) and got[0]["window_cv"] == 0.0 and 2 not in got


def test_surprise_under_own_words(spark, texts, parsed):
    # the first two hold letters that become ASCII, and so parts of words, only when the whole text is lowered
    odd = ["İstanbul road road", "\u212aelvin", " ".join(["w"] * 31 + ["v", "u", "t"])]
    own = parse(spark.createDataFrame([*enumerate([*texts, *odd]), (None, "a b a")], "doc_id long, text string"), path=None)
    want = {}
    for i, text in enumerate([*texts, *odd]):
        ws = [w.lower() for w in re.findall(r"[A-Za-z][A-Za-z'\u2019-]*", text or "")]
        if not ws:
            continue
        n = Counter(ws)
        lps = [math.log(n[w] / len(ws)) for w in ws]
        tiles = [math.exp(-statistics.fmean(t)) for k in range(0, len(lps), 32) if len(t := lps[k : k + 32]) >= 8]
        mean = statistics.fmean(lps)
        want[i] = (len(ws), mean, math.exp(-mean), statistics.pstdev(tiles) / statistics.fmean(tiles) if len(tiles) > 1 else 0.0)
    got = {i: tuple(r)[1:] for i, r in _rows(sequence.own_perplexity(own)).items()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i] == pytest.approx(w, abs=6e-4), i
    plan = sequence.own_perplexity(parsed)._jdf.queryExecution().executedPlan().toString()
    # words are many times the size they are planned with: no join of them that can be broadcast, no second exchange
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("Exchange") == 1


def test_files_and_settings(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in {"a.TXT": "one", "sub/b.md": "two", "c.pdf": "no", "sub/bad.rst": b"\xff x"}.items():
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    got = files.read_texts(spark, str(tmp_path))
    assert got.count() == 3 and {r["text"] for r in got.collect()} >= {"one", "two"}
    (tmp_path / "quillon.toml").write_text('[quillon]\ndisable = ["vocab"]\nmax_hits = 3\nallow = ["robust"]\n')
    c = config.load(tmp_path / "sub")
    assert c.disabled == ("vocab",) and c.max_hits == 3 and "robust" in c.allow
    assert config.with_profile(c, "talk").min_sentence_words == 5 and config.with_profile(c, "talk").max_hits == 3
    with pytest.raises(ValueError):
        config.from_table({"nosuch": 1})


def test_stream_of_documents(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "Moreover, we delve."), (2, "Rain fell.")], "doc_id long, text string").write.parquet(src)
    stream = spark.readStream.schema("doc_id long, text string").parquet(src)
    out = str(tmp_path / "out")
    batches.each_batch(stream, lambda p: rules.hits(p), out, str(tmp_path / "ck"), once=True, path=None).awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
    live = batches.live_counts(stream, {"more": r"\bmoreover\b"})
    q = live.writeStream.format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["doc_id"], r["n_words"], r["more"]) for r in spark.table("live").collect()} == {(1, 3, 1), (2, 2, 0)}


def test_command_line(spark, tmp_path, capsys):
    bad, good = tmp_path / "bad.txt", tmp_path / "good.txt"
    bad.write_text("Moreover, we delve into the vital landscape of the mill.")
    good.write_text("The people by the mill kept an old lamp, and it was lit in 1987.")
    assert cli.main(["rules"]) == 0 and "vocab" in capsys.readouterr().out
    assert cli.main(["prompt"]) == 0 and "[vocab]" in capsys.readouterr().out
    assert cli.main(["check", str(bad), "--max-hits", "1", "--format", "json"]) == 1
    assert json.loads(capsys.readouterr().out)[0]["hits"]
    assert cli.main(["check", str(good), "--max-hits", "1", "--format", "agent"]) == 0 and "PASS" in capsys.readouterr().out
    assert cli.main(["drift", str(bad), str(good)]) == 0 and "IMPROVED" in capsys.readouterr().out
    assert cli.main(["check", str(tmp_path / "none.txt")]) == 2


def test_profiles_pin_weights(spark):
    found = spark.createDataFrame([(1, r) for r in ("fragments", "emoji", "vague", "vocab")], "doc_id long, rule_id string")
    sizes = spark.createDataFrame([(1, 1000)], "doc_id long, n_words int")
    score = lambda w: review.scores(found, sizes, w).first()["score"]
    assert score(config.profile_weights(spark, "talk")) == 5 + 1 + 1 + 1
    assert score(config.profile_weights(spark, "essay")) == 1 + 1 + 4 + 1
    assert config.profile_weights(spark, "docs") is None and config.profile_weights(spark, None) is None
    measured = spark.createDataFrame([("fragments", 0.5, 1.4, "live"), ("vocab", 2.0, 4.0, "live")], "rule_id string, weight double, enrichment double, verdict string")
    assert score(config.profile_weights(spark, "talk", corpus.pinned(measured, {"vocab": 9.0}))) == 5 + 1 + 1 + 2  # the pins of the profile take the place of those measured
    assert "10% of paragraphs" in review.contract(config.with_profile(rules.Config(), "talk"), profile="talk") and "paragraphs end" not in review.contract()


def test_reader_layer_is_audited(spark):
    docs = spark.createDataFrame([(i, "The pan was hot because the lamp was on. " * (2 + i % 3) + "It rained a bit. " * (i % 4) if i % 2 else "Go. Stop. Run now. " + "It ran because it was hot. " * (i % 3 == 0), "machine" if i % 2 else "human") for i in range(12)], "doc_id long, text string, side string")
    got = {r["feature"]: r["cohens_d"] for r in corpus.feature_audit(features.audited(parse(docs, mask=False, path=None), docs.select("doc_id", "side"))).collect()}
    assert {"smog", "subordination", "adjacent_overlap", "topic_spread", "gunning_fog", "words"} <= set(got) and got["subordination"] > 1


def test_settled_units_are_the_same(parsed):
    kept = parsed.settled
    assert kept.settled is kept and parsed.settled is kept
    for name in ("sentences", "segments", "paragraphs", "sizes"):
        a, b = getattr(parsed, name), getattr(kept, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert "Exchange" not in rules.fragments(kept, rules.Config())._jdf.queryExecution().executedPlan().toString()  # still placed by document


def test_flags_of_the_command_line(spark, tmp_path, capsys):
    bad = tmp_path / "bad.txt"
    bad.write_text("Moreover, it is crucial. Short one. Short two. Short three.", encoding="utf-8")
    assert cli.main(["check", str(bad), "--json", "--lm", "--profile", "essay", "--parallel-budget", "3", "--check-code-blocks"]) == 0
    told = json.loads(capsys.readouterr().out)[0]
    assert told["counts"]["fragments"] == 1 and {"warnings", "structure", "templates", "worst", "notes"} <= set(told)
    assert cli.main(["prompt", "--profile", "essay", "--disable", "vocab"]) == 0
    out = capsys.readouterr().out
    assert "[vocab]" not in out and "25% of paragraphs" in out


def test_entry_registers_queries_with_sql(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50
    df = entry.entry(spark)
    assert df.count() > 0 and "lexical_density" in df.columns
