"""SQL for the queries that SQL can state on whole tables."""

from __future__ import annotations

_SCORES = ("choppiness", "closer_ratio", "doublets_per_1k", "parallel_per_1k")

_LATEST = """
valid AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY analyzed_at DESC NULLS LAST, batch_id DESC,
      choppiness DESC, closer_ratio DESC, doublets_per_1k DESC, parallel_per_1k DESC) AS nth
    FROM punch WHERE result_id IS NOT NULL)
  WHERE nth = 1)"""

_LONG = "long AS (" + " UNION ALL ".join(f"SELECT batch_id, result_id, '{s}' AS score, {s} AS v FROM valid WHERE {s} IS NOT NULL AND NOT isnan({s})" for s in _SCORES) + ")"

_RANKS = """
ranks AS (
  SELECT batch_id, result_id, score,
    (rank() OVER (PARTITION BY batch_id, score ORDER BY v DESC) - 1 + (count(*) OVER (PARTITION BY batch_id, score, v) + 1) / 2.0)
    / count(*) OVER (PARTITION BY batch_id, score) AS r
  FROM long),
wide AS (
  SELECT result_id, """ + ", ".join(f"max(CASE WHEN score = '{s}' THEN r END) AS rank_{s}" for s in _SCORES) + """, avg(r) AS mean_rank
  FROM ranks GROUP BY result_id),
sorted AS (
  SELECT *, list_sort([""" + ", ".join(f"coalesce(rank_{s}, mean_rank)" for s in _SCORES) + """]) AS f FROM wide),
scored AS (
  SELECT valid.batch_id, valid.result_id, """ + ", ".join(f"rank_{s}" for s in _SCORES) + """, mean_rank, coalesce(least(1.0, 4 * least(
    1 - pow(1 - f[1], 4),
    6 * pow(f[2], 2) * pow(1 - f[2], 2) + 4 * pow(f[2], 3) * (1 - f[2]) + pow(f[2], 4),
    4 * pow(f[3], 3) * (1 - f[3]) + pow(f[3], 4),
    pow(f[4], 4))), 1.0) AS significance
  FROM valid LEFT JOIN sorted USING (result_id))"""

_RANKING = f"WITH {_LATEST}, {_LONG}, {_RANKS}"

ORACLE = {
    "p1_ranking": _RANKING
    + " SELECT batch_id, result_id, " + ", ".join(f"round(rank_{s}, 6) AS rank_{s}" for s in _SCORES)
    + ", round(mean_rank, 6) AS mean_rank, round(significance, 6) AS significance FROM scored",
    "p1_found": _RANKING
    + """ SELECT batch_id, result_id FROM (
      SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY significance, mean_rank, result_id) AS place
      FROM scored WHERE mean_rank IS NOT NULL) WHERE place <= 3""",
    "p4_found": """
      WITH valid AS (
        SELECT path, para_index, weighted FROM (
          SELECT *, row_number() OVER (PARTITION BY path, para_index ORDER BY scored_at DESC NULLS LAST, weighted DESC NULLS LAST) AS nth
          FROM paragraph_scores WHERE path IS NOT NULL AND para_index IS NOT NULL)
        WHERE nth = 1 AND weighted IS NOT NULL AND NOT isnan(weighted))
      SELECT path, para_index FROM (
        SELECT *, row_number() OVER (PARTITION BY path ORDER BY weighted DESC, para_index) AS place FROM valid)
      WHERE place <= 3""",
}
