"""Results of single documents as text and JSON; for many documents write the DataFrames instead."""

from __future__ import annotations

import json
from itertools import groupby

from pyspark.sql import DataFrame

from quillon.functions import patterns as pt

_ORDER = {"H": 0, "M": 1, "L": 2}


def render_text(path: str, found: list, figures: dict, verbose: bool = False, most: int = 6, width: int = 76) -> str:
    """Hits of one document by rule, then its figures. found: rows with rule_id, start, text and note."""
    lines = [f"{path}: {len(found)} hits"]
    for rule, rows in groupby(sorted(found, key=lambda h: (h["rule_id"], h["start"])), key=lambda h: h["rule_id"]):
        rows = list(rows)
        r = pt.RULES[rule]
        lines.append(f"[{r.severity}] {rule} x{len(rows)}: {r.title}")
        shown = rows if verbose else rows[:most]
        lines += [f"    @{h['start']} {h['text'][:width]!r}" + (f" ({h['note']})" if h["note"] else "") for h in shown]
        if len(rows) > len(shown):
            lines.append(f"    and {len(rows) - len(shown)} more")
    for layer, values in figures.items():
        lines.append(f"{layer}: " + ", ".join(f"{k} {v}" for k, v in values.items() if k != "doc_id"))
    return "\n".join(lines)


def render_json(results: list[dict]) -> str:
    return json.dumps(results, indent=2, default=str, ensure_ascii=False)


def render_agent(review_row, path: str = "") -> str:
    """A review in few words: PASS alone if there is nothing to say, else the worst paragraph, the groups with their fix, the severest first, and the notes."""
    if review_row["passed"] and not review_row["instructions"] and not review_row["notes"]:
        return "PASS"
    lines = ["PASS" if review_row["passed"] else f"FAIL {review_row['total']}"]
    if review_row["worst"]:
        lines.append(f"worst: {review_row['worst']}")
    for g in sorted(review_row["instructions"] or [], key=lambda g: _ORDER[pt.RULES[g["rule_id"]].severity]):
        lines.append(f"[{g['rule_id']}] x{g['n']}: {pt.RULES[g['rule_id']].fix}")
        lines += [f"  {s}" for s in g["spans"]]
        if g["n"] > len(g["spans"]):
            lines.append(f"  ... {g['n'] - len(g['spans'])} more")
    lines += [f"! {n}" for n in review_row["notes"] or []]
    return "\n".join(lines)


def write_json(df: DataFrame, folder: str) -> None:
    """Any result as JSON lines, in parallel."""
    df.write.mode("overwrite").json(folder)
