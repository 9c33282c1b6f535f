"""Measured weights and voiceprints as JSON files of version 1. Both are small: a row a rule, a row a feature."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

WEIGHTS = "rule_id string, weight double, enrichment double, verdict string, pin double"
VOICE = "feature string, center double, scale double"


def write_weights(weights: DataFrame, path: str, n_machine: int = 0, n_human: int = 0, note: str = "") -> None:
    rows = [r.asDict() for r in weights.collect()]  # one a rule
    data = {
        "version": 1,
        "n_machine": n_machine,
        "n_human": n_human,
        "note": note,
        "weights": {r["rule_id"]: r["weight"] for r in rows},
        "enrichment": {r["rule_id"]: "inf" if math.isinf(r["enrichment"]) else r["enrichment"] for r in rows},
        "verdicts": {r["rule_id"]: r["verdict"] for r in rows},
        "pins": {r["rule_id"]: r["pin"] for r in rows if r.get("pin") is not None},
    }
    Path(path).write_text(json.dumps(data, indent=2, sort_keys=True), encoding="utf-8")


def _read(path: str) -> dict:
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if data.get("version") != 1:
        raise ValueError(f"version {data.get('version')} can't be read")
    return data


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """rule_id, weight, enrichment, verdict, pin, effective."""
    from quillon.operators.corpus import pinned

    d = _read(path)
    rules = sorted({*d["weights"], *d.get("pins", {})})
    pins = d.get("pins", {})
    rows = [(r, d["weights"].get(r), float(d["enrichment"][r]) if r in d.get("enrichment", {}) else None, d.get("verdicts", {}).get(r), pins.get(r)) for r in rules]
    return pinned(spark.createDataFrame(rows, WEIGHTS).drop("pin"), pins)


def write_voiceprint(voice: DataFrame, path: str, sources: list[str] | None = None) -> None:
    rows = voice.collect()  # one a feature
    data = {
        "version": 1,
        "n_docs": max((r["n_docs"] for r in rows), default=0),
        "n_words": max((r["n_words"] for r in rows), default=0),
        "sources": sorted(sources or []),
        "center": {r["feature"]: r["center"] for r in rows},
        "scale": {r["feature"]: r["scale"] for r in rows},
    }
    Path(path).write_text(json.dumps(data, indent=2, sort_keys=True), encoding="utf-8")


def voice_centers(path: str) -> dict[str, float]:
    """The usual figures alone, without a session."""
    return {k: float(v) for k, v in _read(path)["center"].items()}


def read_voiceprint(spark: SparkSession, path: str) -> DataFrame:
    d = _read(path)
    missing = [k for k in ("center", "scale", "n_docs", "n_words") if k not in d]
    if missing:
        raise ValueError(f"the voiceprint lacks {', '.join(missing)}")
    return spark.createDataFrame([(f, float(c), float(d["scale"][f])) for f, c in d["center"].items()], VOICE)
