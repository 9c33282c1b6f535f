"""Rank aggregation (1) and top-N by bands (4) against brute force."""

import datetime as dt
import math
import random
from math import comb

import pytest

from quillon.llm.p1_rank import SCORES, aggregate_ranks, first_in_group
from quillon.llm.p4_topn import top_n_by_bands

PUNCH = "result_id long, batch_id long, choppiness double, closer_ratio double, doublets_per_1k double, parallel_per_1k double, analyzed_at timestamp, score string, rank int, value double"
T0 = dt.datetime(2024, 1, 1)


def _rho(r):
    r = sorted(r)
    return min(1, 4 * min(sum(comb(4, j) * x**j * (1 - x) ** (4 - j) for j in range(k, 5)) for k, x in enumerate(r, 1)))


def _brute(rows):
    newest = {}
    for r in rows:
        if r[0] is not None and (r[0] not in newest or (r[6], r[1:6]) > (newest[r[0]][6], newest[r[0]][1:6])):
            newest[r[0]] = r
    out = {}
    for b in {r[1] for r in newest.values()}:
        items = [r for r in newest.values() if r[1] == b]
        ranks = {r[0]: [] for r in items}
        for j in range(2, 6):
            vals = [r[j] for r in items if r[j] is not None and not math.isnan(r[j])]
            for r in items:
                if r[j] is not None and not math.isnan(r[j]):
                    above, same = sum(v > r[j] for v in vals), sum(v == r[j] for v in vals)
                    ranks[r[0]].append((above + (same + 1) / 2) / len(vals))
        for i, got in ranks.items():
            if got:
                mean = sum(got) / len(got)
                out[i] = (b, _rho(got + [mean] * (4 - len(got))), mean)
    return out


def _rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        b = 1 if rng.random() < 0.4 else rng.randint(2, 5)
        v = [rng.choice([None, float("nan"), 0.0, 0.0, rng.random(), rng.random() * 900]) for _ in range(4)]
        rows.append((i, b, *v, T0 + dt.timedelta(days=rng.randint(0, 9)), "x", 7, 1.0))
        if rng.random() < 0.2:
            rows.append(rows[-1])
        if rng.random() < 0.2:
            rows.append((i, b, *[x and x + 1 for x in v], T0 + dt.timedelta(days=20), "y", 7, 1.0))
    return rows


def test_ranks_agree_with_brute_force(spark):
    rows = _rows(300, 3)
    got = aggregate_ranks(spark.createDataFrame(rows, PUNCH), "batch_id", "result_id").collect()
    want = _brute(rows)
    assert len(got) == 300
    for r in got:
        if r["result_id"] in want:
            b, rho, mean = want[r["result_id"]]
            assert r["batch_id"] == b and r["significance"] == pytest.approx(rho, abs=1e-9) and r["mean_rank"] == pytest.approx(mean)
        else:
            assert r["mean_rank"] is None and r["significance"] == 1.0


def test_hot_values_take_the_other_join(spark):
    rows = [(i, 1, 0.0, float(i), 0.0, None, T0, "", 0, 0.0) for i in range(50)] + [(99, None, 1.0, 1.0, 1.0, 1.0, T0, "", 0, 0.0)]
    ranked = aggregate_ranks(spark.createDataFrame(rows, PUNCH), "batch_id", "result_id", hot_share=3)
    assert ranked.count() == 51
    top = first_in_group(ranked, "batch_id", "result_id", 3).collect()
    assert {r["result_id"] for r in top} == {49, 48, 47, 99}


def test_no_range_dominates(spark):
    rows = [(1, 1, 0.9, 0.9, 2.0, 2.0, T0, "", 0, 0.0), (2, 1, 0.1, 0.1, 900.0, 1.0, T0, "", 0, 0.0), (3, 1, 0.2, 0.2, 1.0, 1.5, T0, "", 0, 0.0)]
    ranked = aggregate_ranks(spark.createDataFrame(rows, PUNCH), "batch_id", "result_id")
    best = first_in_group(ranked, "batch_id", "result_id", 1).collect()
    assert [r["result_id"] for r in best] == [1]


def test_empty_and_null_items(spark):
    assert aggregate_ranks(spark.createDataFrame([], PUNCH), "batch_id", "result_id").count() == 0
    one = spark.createDataFrame([(None, 1, 1.0, 1.0, 1.0, 1.0, T0, "", 0, 0.0)], PUNCH)
    assert aggregate_ranks(one, "batch_id", "result_id").count() == 0
    assert SCORES[0] == "choppiness"


PARA = "path string, para_index int, weighted double, scored_at timestamp, place int, grp string, block long"


def _top(rows, n):
    newest = {}
    for p, i, w, at, *_ in rows:
        if p is None or i is None:
            continue
        key = (at is not None, at or T0, w is not None, w if w is not None and not math.isnan(w) else math.inf if w is not None else 0)
        if (p, i) not in newest or key > newest[p, i][0]:
            newest[p, i] = (key, w)
    by = {}
    for (p, i), (_, w) in newest.items():
        if w is not None and not math.isnan(w):
            by.setdefault(p, []).append((-w, i))
    return {(p, i) for p, v in by.items() for _, i in sorted(v)[:n]}


@pytest.mark.parametrize("block", [4096, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_top_n_agrees_with_brute_force(spark, seed, block):
    rng = random.Random(seed)
    rows = []
    for _ in range(1500):
        p = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None] + [f"p{k}" for k in range(60)])
        w = rng.choice([None, float("nan"), 0.0, 0.0, 5.0, 5.0, rng.random() * 10, float("inf"), -1.0])
        rows.append((p, rng.choice([None, *range(80)]), w, T0 + dt.timedelta(hours=rng.randint(0, 9**4)), 1, "g", 2))
    rows += rows[:100]
    df = spark.createDataFrame(rows, PARA)
    got = top_n_by_bands(df, "path", "para_index", "weighted", "scored_at", 3, block=block)
    found = [(r["path"], r["para_index"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == _top(rows, 3)


def test_top_n_of_all_ties_and_empty(spark):
    rows = [("a", i, 1.0, T0, 1, "g", 2) for i in range(20)]
    got = top_n_by_bands(spark.createDataFrame(rows, PARA), "path", "para_index", "weighted", "scored_at", 3)
    assert sorted((r["para_index"], r["place"]) for r in got.collect()) == [(0, 1), (1, 2), (2, 3)]
    assert top_n_by_bands(spark.createDataFrame([], PARA), "path", "para_index", "weighted", "scored_at").count() == 0
