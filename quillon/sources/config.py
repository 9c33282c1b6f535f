"""Settings from a TOML file, and the built-in profiles."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quillon.functions import patterns as pt
from quillon.operators.corpus import pinned
from quillon.operators.rules import Config

FILES = ("quillon.toml", ".quillon.toml", "pyproject.toml")


@dataclass(frozen=True)
class Profile:
    name: str
    settings: dict = field(default_factory=dict)
    pins: dict[str, float] = field(default_factory=dict)


# What each profile sets, and the weights it pins
PROFILES = {
    "talk": Profile(
        "talk",
        {"doublet_budget_per_1k": 0.0, "parallel_budget_per_1k": 0.0, "closer_budget_ratio": 0.10, "min_sentence_words": 5, "max_choppiness": 0.12, "person_budget_per_1k": 1.0},
        {"fragments": 5.0, "doublet": 5.0, "parallel": 5.0, "runt": 4.0, "closer": 4.0, "opener": 3.0, "person": 3.0},
    ),
    "essay": Profile("essay", {"doublet_budget_per_1k": 2.0, "parallel_budget_per_1k": 1.0, "closer_budget_ratio": 0.25, "min_sentence_words": 0}, {"vague": 4.0, "template": 4.0}),
    "docs": Profile("docs", {"doublet_budget_per_1k": 3.0, "parallel_budget_per_1k": 3.0, "closer_budget_ratio": 0.35, "min_sentence_words": 0}, {}),
}


def with_profile(c: Config, name: str) -> Config:
    return replace(c, **PROFILES[name].settings)


def profile_weights(spark: SparkSession, name: str | None, weights: DataFrame | None = None) -> DataFrame | None:
    """The weights under a profile: its pins take the place of those of the measured weights; None if neither is there.

    With pins alone, rules that are not pinned weigh 1."""
    pins = PROFILES[name].pins if name else {}
    if not pins:
        return weights
    bare = [(r, None, None, None) for r in pt.RULES]
    if weights is None:
        return pinned(spark.createDataFrame(bare, "rule_id string, weight double, enrichment double, verdict string"), pins)
    every = spark.createDataFrame([(r,) for r in pt.RULES], "rule_id string").join(weights.drop("pin", "effective"), "rule_id", "left")  # a row a rule
    return pinned(every, pins)


def from_table(values: dict) -> Config:
    """A config of a TOML table; unknown keys and rules are errors."""
    known = {f.name for f in fields(Config)}
    unknown = set(values) - known - {"disable"}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = {k: v for k, v in values.items() if k != "disable"}
    if "disable" in values:
        out["disabled"] = tuple(values["disable"])
    for k in ("allow", "allow_runts"):
        if k in out:
            out[k] = frozenset(out[k])
    if "disabled" in out:
        out["disabled"] = tuple(out["disabled"])
    return Config(**out)


def load(start: str | Path = ".") -> Config:
    """The nearest settings from a folder upward; in pyproject.toml those under [tool.quillon]."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        for name in FILES:
            f = folder / name
            if not f.is_file():
                continue
            data = tomllib.loads(f.read_text(encoding="utf-8"))
            if name != "pyproject.toml":
                return from_table(data.get("quillon", data))
            if "quillon" in data.get("tool", {}):
                return from_table(data["tool"]["quillon"])
    return Config()
