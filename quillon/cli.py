"""Command line: check, voice, rules, prompt, drift, audit. Exit codes: 0 fine, 1 over a limit, 2 an error, 130 interrupted."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

from quillon.functions import lexicons as lx
from quillon.functions import patterns as pt


def _parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="quillon", description=__doc__)
    sub = ap.add_subparsers(dest="command", required=True)
    check = sub.add_parser("check", help="hits and figures of texts")
    check.add_argument("paths", nargs="+")
    check.add_argument("--format", choices=("text", "json", "agent"), default="text")
    check.add_argument("--disable", action="append", default=[])
    check.add_argument("--allow", action="append", default=[])
    check.add_argument("--allow-domain-words", action="store_true")
    check.add_argument("--profile", choices=("talk", "essay", "docs"))
    check.add_argument("--calibration")
    check.add_argument("--audience", choices=("expert", "general"))
    check.add_argument("--min-sentence-words", type=int)
    check.add_argument("--strict-runts", action="store_true")
    for flag, kind in (("--max-hits", int), ("--max-per-1k", float), ("--max-choppiness", float)):
        check.add_argument(flag, type=kind)
    check.add_argument("--verbose", action="store_true")
    check.add_argument("-q", "--quiet", action="store_true", help="counts only")
    check.add_argument("--json", action="store_true", help="as --format json")
    check.add_argument("--voice", help="a voiceprint; figures are told as distances from it")
    check.add_argument("--z-threshold", type=float)
    check.add_argument("--check-code-blocks", action="store_true")
    check.add_argument("--parallel-budget", type=float)
    check.add_argument("--closer-budget", type=float)
    check.add_argument("--lm", action="store_true", help="perplexity windows under the word frequencies of the text itself")
    voice = sub.add_parser("voice", help="an author's usual figures")
    voice.add_argument("action", choices=("build", "show"))
    voice.add_argument("paths", nargs="+")
    voice.add_argument("--out", default="voice.json")
    sub.add_parser("rules", help="the rules")
    prompt = sub.add_parser("prompt", help="the rules as instructions")
    prompt.add_argument("--audience", choices=("expert", "general"))
    prompt.add_argument("--disable", action="append", default=[])
    prompt.add_argument("--voice")
    prompt.add_argument("--profile", choices=("talk", "essay", "docs"))
    drift = sub.add_parser("drift", help="judge a revision")
    drift.add_argument("before")
    drift.add_argument("after")
    drift.add_argument("--fail-on", default="churned,overfit,traded")
    drift.add_argument("--json", action="store_true")
    drift.add_argument("--profile", choices=("talk", "essay", "docs"))
    audit = sub.add_parser("audit", help="compare two corpora")
    audit.add_argument("machine")
    audit.add_argument("human")
    audit.add_argument("--out")
    audit.add_argument("--audience", choices=("expert", "general"), default="expert")
    audit.add_argument("--json", action="store_true")
    audit.add_argument("--corpus-note", default="")
    return ap


def _check(a: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from quillon.operators import corpus as stats
    from quillon.operators import features, review, rules, sequence
    from quillon.operators.parse import parse
    from quillon.session import local_session
    from quillon.sources import config, corpus, reports, stores

    c = config.load()
    allow = set(c.allow) | set(a.allow) | (lx.DOMAIN_WORDS if a.allow_domain_words else set())
    c = replace(c, disabled=(*c.disabled, *a.disable), allow=frozenset(allow))
    named = ("max_hits", "max_per_1k", "max_choppiness", "audience", "min_sentence_words", "z_threshold")
    given = {n: getattr(a, n) for n in named} | {"parallel_budget_per_1k": a.parallel_budget, "closer_budget_ratio": a.closer_budget}
    c = replace(c, **{k: v for k, v in given.items() if v is not None}, skip_code_blocks=c.skip_code_blocks and not a.check_code_blocks)
    if a.strict_runts:
        c = replace(c, runt_mode="all", min_sentence_words=c.min_sentence_words or 5)
    if a.profile:
        c = config.with_profile(c, a.profile)
    spark = local_session()
    texts = [("<stdin>", sys.stdin.read()) if p == "-" else (p, Path(p).read_text(encoding="utf-8")) for p in a.paths]
    p = parse(corpus.from_texts(spark, texts), skip_code=c.skip_code_blocks)
    weights = config.profile_weights(spark, a.profile, stores.read_weights(spark, a.calibration) if a.calibration else None)
    voice = stores.read_voiceprint(spark, a.voice) if a.voice else None
    p = p.settled
    found = rules.hits(p, c)
    by_doc: dict[int, list] = {}
    for h in found.orderBy("doc_id", "start").collect():  # the texts named on the command line
        by_doc.setdefault(h["doc_id"], []).append(h)
    layers = {"metrics": features.metrics(p), "cadence": features.cadence(p), "style": features.stylometry(p), "punch": review.punch(p), "score": review.scores(found, p.sizes, weights)}
    if a.format == "json" or a.json:
        from quillon.operators import templates

        layers |= {"structure": templates.repeat_mass(p, 4), "templates": templates.template_rates(p), "warnings": features.metric_warnings(features.metrics(p))}
    if c.audience:
        layers["reader"] = features.reader_signals(p, c.audience)
    if a.lm:
        layers["perplexity"] = sequence.own_perplexity(p)
    if voice is not None:
        z = stats.deviations(features.stylometry(p), voice).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "z"))).alias("z"))
        layers["deviations"] = p.sizes.select("doc_id").join(z, "doc_id", "left")
    figures = {k: {r["doc_id"]: r.asDict() for r in v.collect()} for k, v in layers.items()}
    verdicts = {r["doc_id"]: r for r in review.review(p, c, found, weights, voice).collect()}
    results = []
    for i, (path, _) in enumerate(texts):
        own = {k: v[i] for k, v in figures.items() if i in v}
        mine = by_doc.get(i, [])
        counts = {r: sum(h["rule_id"] == r for h in mine) for r in pt.RULES}
        if a.json or a.format == "json":
            results.append({"path": path, "counts": counts, "worst": verdicts[i]["worst"], "notes": verdicts[i]["notes"], "hits": [h.asDict() for h in mine], **own})
        elif a.quiet:
            print(f"{path}: " + (", ".join(f"{r} {n}" for r, n in counts.items() if n) or "no hits"))
        elif a.format == "agent":
            print(reports.render_agent(verdicts[i], path))
        else:
            print(reports.render_text(path, mine, own, a.verbose))
    if results:
        print(reports.render_json(results))
    return int(any(v["over"] for v in verdicts.values()))


def _voice(a: argparse.Namespace) -> int:
    from quillon.operators import corpus as stats
    from quillon.operators import features
    from quillon.operators.parse import parse
    from quillon.session import local_session
    from quillon.sources import corpus, stores

    spark = local_session()
    if a.action == "show":
        stores.read_voiceprint(spark, a.paths[0]).orderBy("feature").show(truncate=False)
        return 0
    docs = corpus.read_texts(spark, a.paths)
    stores.write_voiceprint(stats.voiceprint(features.stylometry(parse(docs, mask=False))), a.out, [r["path"] for r in docs.select("path").collect()])
    print(a.out)
    return 0


def _drift(a: argparse.Namespace) -> int:
    from quillon.operators import review
    from quillon.session import local_session
    from quillon.sources import config

    spark = local_session()
    rows = [(0, s, Path(getattr(a, s)).read_text(encoding="utf-8")) for s in ("before", "after")]
    c = config.with_profile(config.load(), a.profile) if a.profile else config.load()
    row = review.drift(spark.createDataFrame(rows, "pair_id long, side string, text string"), c).first()
    if a.json:
        print(json.dumps(row.asDict(), indent=2))
        return int(row["verdict"] in a.fail_on.split(","))
    print(f"{row['verdict'].upper()} hits {row['hits_before']}->{row['hits_after']} choppiness {row['choppiness_before']:.2f}->{row['choppiness_after']:.2f}")
    return int(row["verdict"] in a.fail_on.split(","))


def _audit(a: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from quillon.operators import corpus as stats
    from quillon.operators import features, rules
    from quillon.operators.parse import parse
    from quillon.session import local_session
    from quillon.sources import corpus, stores

    spark = local_session()
    sides = {s: corpus.read_texts(spark, getattr(a, s)).withColumn("side", F.lit(s)) for s in ("machine", "human")}
    docs = sides["machine"].unionByName(sides["human"])
    stats.require_docs(docs)
    p = parse(docs).settled
    counts = rules.hits(p).groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    audit = stats.rule_audit(stats.rule_rates(docs.select("doc_id", "side").join(p.sizes, "doc_id"), counts))
    effects = stats.feature_audit(features.audited(p, docs.select("doc_id", "side"), a.audience))
    told = {"rules": audit.orderBy(F.desc("enrichment")), "features": effects.orderBy(F.desc(F.abs("cohens_d")))}
    if a.json:
        print(json.dumps({k: [r.asDict() for r in v.collect()] for k, v in told.items()} | {"note": a.corpus_note}, indent=2))
    else:
        for v in told.values():
            v.show(100, truncate=False)
    if a.out:
        n = {r["side"]: r["count"] for r in docs.groupBy("side").count().collect()}
        stores.write_weights(stats.measured_weights(audit), a.out, n["machine"], n["human"], a.corpus_note)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        if a.command == "rules":
            print("\n".join(f"{r.id:<12} {r.severity} {r.title}" for r in pt.RULES.values()))
            return 0
        if a.command == "prompt":
            from quillon.operators.review import contract
            from quillon.operators.rules import Config
            from quillon.sources import config, stores

            c = Config(disabled=tuple(a.disable))
            print(contract(config.with_profile(c, a.profile) if a.profile else c, a.audience, stores.voice_centers(a.voice) if a.voice else None, a.profile))
            return 0
        return {"check": _check, "voice": _voice, "drift": _drift, "audit": _audit}[a.command](a)
    except KeyboardInterrupt:
        return 130
    except (OSError, ValueError) as e:
        print(f"quillon: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
