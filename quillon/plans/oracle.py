"""SQL for the registered queries, for an engine with RE2 patterns: no lookaround, so ends are captured and put back."""

from __future__ import annotations

from quillon.functions import lexicons as lx
from quillon.functions import patterns as pt
from quillon.functions import text as tx
from quillon.functions.patterns import WS, re2
from quillon.plans.seeds import TRIGGERS


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def inlist(words) -> str:
    return "(" + ", ".join(q(w) for w in sorted(words)) + ")"


def n_of(col: str, pattern: str, ignore_case: bool = True) -> str:
    return f"len(regexp_extract_all({col}, {q(('(?i)' if ignore_case else '') + re2(pattern))}))"


WORD = q(pt.WORD)


def words(col: str) -> str:
    return f"regexp_extract_all({col}, {WORD})"


RAW = "raw AS (SELECT *, replace(coalesce(text, ''), chr(1), ' ') AS body FROM documents)"


def _mask_step(name: str, source: str, pattern: str, where: str) -> str:
    return f"""{name} AS (
  SELECT doc_id, path, CASE WHEN {where} THEN masked ELSE body END AS body FROM {source} LEFT JOIN (
    SELECT doc_id AS id, string_agg(gap || coalesce(regexp_replace(m, '[^\\n]', ' ', 'g'), ''), '' ORDER BY i) AS masked FROM (
      SELECT doc_id, unnest(string_split_regex(body, {q(pattern)})) AS gap, unnest(regexp_extract_all(body, {q(pattern)})) AS m, unnest(range(len(string_split_regex(body, {q(pattern)})))) AS i
      FROM {source} WHERE {where}) GROUP BY doc_id) ON id = doc_id)"""


_MD = r"coalesce(regexp_matches(path, '\.(md|markdown)\z'), false)"
DOCS = ",\n".join(
    [
        RAW,
        _mask_step("m0", "raw", tx.suppression_pattern("prose"), "contains(lower(body), 'prose:')"),
        _mask_step("m1", "m0", tx.FENCE, f"{_MD} AND contains(body, '```')"),
        *[_mask_step(f"m{i}", f"m{i - 1}", p, f"{_MD} AND regexp_matches(body, {q(p)})") for i, p in enumerate(tx.FURNITURE, 2)],
        "docs AS (SELECT doc_id, body AS text FROM m4)",
    ]
)
PLAIN = RAW + ", docs AS (SELECT doc_id, body AS text FROM raw)"
_CASE = "CASE length(coalesce(text, '')) % " + str(len(TRIGGERS)) + " " + " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(TRIGGERS)) + " END"
SEEDED_TEXT = f"coalesce(text, '') || chr(10) || chr(10) || {_CASE}"
SEEDED = ",\n".join(
    [
        f"raw AS (SELECT doc_id, path, replace({SEEDED_TEXT}, chr(1), ' ') AS body FROM documents)",
        _mask_step("m0", "raw", tx.suppression_pattern("prose"), "contains(lower(body), 'prose:')"),
        _mask_step("m1", "m0", tx.FENCE, f"{_MD} AND contains(body, '```')"),
        *[_mask_step(f"m{i}", f"m{i - 1}", p, f"{_MD} AND regexp_matches(body, {q(p)})") for i, p in enumerate(tx.FURNITURE, 2)],
        "docs AS (SELECT doc_id, body AS text FROM m4)",
    ]
)

_ABBR = "|".join(a.replace(".", r"\.") for a in lx.ABBREVIATIONS)
_CUT = f"regexp_replace(para, {q(rf'([.!?]+)([\"' + chr(39) + rf')\]]*(?:{WS}|\z))')}, '\\1' || chr(1) || '\\2', 'g')"
_CUT = f"regexp_replace({_CUT}, {q(rf'\b((?i:{_ABBR})\.)' + chr(1))}, '\\1', 'g')"
_CUT = f"regexp_replace({_CUT}, {q(r'\b([A-Z]\.)' + chr(1))}, '\\1', 'g')"
_STRIP = q(f"^{WS}+|{WS}+$")
_LEAD = q(f"^{WS}+")

PARAS = f"""
para_pieces AS (
  SELECT doc_id, unnest(string_split(p, chr(1))) AS para, unnest(range(len(string_split(p, chr(1))))) AS i
  FROM (SELECT doc_id, regexp_replace(text, {q(rf'\n({WS}*\n)')}, chr(1) || chr(10) || '\\1', 'g') AS p FROM docs)),
paras AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS para_no, i, ofs + length(para) - length(regexp_replace(para, {_LEAD}, '')) AS "start",
    ofs + length(para) - length(regexp_replace(para, {_LEAD}, '')) + length(t) AS "end", t AS text, len({words('t')}) AS n_words
  FROM (SELECT *, coalesce(sum(length(para)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs,
          regexp_replace(para, {_STRIP}, '', 'g') AS t FROM para_pieces)
  WHERE t <> '')"""

SENTS = PARAS + f""",
sent_pieces AS (
  SELECT doc_id, i, unnest(string_split(c, chr(1))) AS piece, unnest(range(len(string_split(c, chr(1))))) AS j
  FROM (SELECT doc_id, i, {_CUT} AS c FROM para_pieces)),
sents0 AS (
  SELECT doc_id, i, j, ofs + length(piece) - length(regexp_replace(piece, {_LEAD}, '')) AS "start",
    ofs + length(piece) - length(regexp_replace(piece, {_LEAD}, '')) + length(t) AS "end", t AS text, {words('t')} AS ws
  FROM (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs,
          regexp_replace(piece, {_STRIP}, '', 'g') AS t FROM sent_pieces)
  WHERE t <> ''),
sents AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS sent_no, dense_rank() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS para_no,
    "start", "end", text, ws, len(ws) AS n_words, lower(ws[1]) AS first_word FROM sents0)"""

FINITE = f""",
verbs AS (
  SELECT doc_id, sent_no, bool_or(w IN {inlist(lx.FINITE_FORMS)} OR regexp_matches(w, '.''(s|re|ve|ll|d|m)$') OR regexp_replace(w, '(.)n''t$', '\\1') IN {inlist(lx.FINITE_FORMS)}
    OR regexp_matches(w, '^\\w{{3,}}ed$|^\\w{{2,}}ing$')) AS finite
  FROM (SELECT doc_id, sent_no, replace(lower(unnest(ws)), '’', '''') AS w FROM sents) GROUP BY ALL),
fsents AS (SELECT s.*, coalesce(finite, false) AS finite FROM sents s LEFT JOIN verbs USING (doc_id, sent_no))"""

FREQ = f"""
freq AS (SELECT doc_id, lword, count(*) AS n FROM (SELECT doc_id, unnest({words('lower(text)')}) AS lword FROM docs) GROUP BY ALL)"""

TOKENS = f"""
token_gaps AS (
  SELECT doc_id, unnest(string_split_regex(text, {WORD})) AS gap, unnest({words('text')}) AS word, unnest(range(len(string_split_regex(text, {WORD})))) AS pos FROM docs),
tokens AS (
  SELECT doc_id, pos, ofs + length(gap) AS "start", ofs + length(gap) + length(word) AS "end", word, lower(word) AS lword
  FROM (SELECT *, coalesce(sum(length(gap) + coalesce(length(word), 0)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM token_gaps)
  WHERE word IS NOT NULL)"""


def beats(w: str) -> str:
    """Syllables of a lower-case word."""
    s = f"regexp_replace({w}, '^''+|''+$', '', 'g')"
    n = f"len(regexp_extract_all({s}, '[aeiouy]+'))"
    return f"(CASE WHEN {s} = '' THEN 0 ELSE greatest(1, {n} - CASE WHEN {s} LIKE '%e' AND NOT regexp_matches({s}, '(le|ee|ye)$') AND {n} > 1 THEN 1 ELSE 0 END) END)"


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0), 0)"


_FOOTPRINT = " + ".join(n_of("text", p) for p in pt.FOOTPRINT)
METRICS = f"""
lens AS (SELECT *, sum(CASE WHEN abs(n_words - before) <= 4 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY sent_no) AS island
  FROM (SELECT doc_id, sent_no, n_words, lag(n_words) OVER (PARTITION BY doc_id ORDER BY sent_no) AS before FROM sents)),
agg AS (SELECT doc_id, count(*) AS sentences, avg(n_words) AS mean, stddev_pop(n_words) AS sd, avg((n_words <= 7)::int) AS short, avg((n_words >= 25)::int) AS long, max(run) AS flat
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS run FROM lens) GROUP BY doc_id),
metrics AS (SELECT d.doc_id, coalesce(sentences, 0)::BIGINT AS sentences, words::BIGINT AS words, round(coalesce(mean, 0), 1) AS mean_len, round(coalesce(sd, 0), 1) AS stdev_len,
  round({ratio('sd', 'mean')}, 3) AS cv, round(coalesce(short, 1), 3) AS pct_short, round(coalesce(long, 0), 3) AS pct_long, coalesce(flat, 1)::BIGINT AS longest_flat_run,
  footprint::BIGINT AS footprint, round({ratio('footprint * 1000', 'words')}, 2) AS footprint_per_1k
  FROM (SELECT doc_id, len({words('text')}) AS words, {_FOOTPRINT} AS footprint FROM docs) d LEFT JOIN agg USING (doc_id))"""

CADENCE = f"""
short AS (SELECT *, sum((NOT is_short)::int) OVER (PARTITION BY doc_id ORDER BY sent_no) AS island FROM (SELECT *, n_words <= 7 AS is_short FROM fsents)),
cad AS (SELECT doc_id, {ratio('sum(CASE WHEN is_short THEN n_words ELSE 0 END)', 'sum(n_words)')} AS s, avg((NOT finite)::int) AS v,
  {ratio('sum(CASE WHEN is_short AND run >= 3 THEN n_words ELSE 0 END)', 'sum(n_words)')} AS r, avg(n_words) AS mean
  FROM (SELECT *, sum(is_short::int) OVER (PARTITION BY doc_id, island) AS run FROM short) GROUP BY doc_id),
cadence AS (SELECT doc_id, round(coalesce(0.45 * s + 0.35 * v + 0.20 * r, 0)::DECIMAL(20,9), 4)::DOUBLE AS choppiness, round(coalesce(s, 0)::DECIMAL(20,9), 4)::DOUBLE AS short_share, round(coalesce(v, 0)::DECIMAL(20,9), 4)::DOUBLE AS verbless_share,
  round(coalesce(r, 0)::DECIMAL(20,9), 4)::DOUBLE AS run_mass, round(coalesce(mean, 0)::DECIMAL(20,9), 2)::DOUBLE AS mean_sentence_len,
  CASE WHEN s IS NULL THEN 'n/a' WHEN 0.45 * s + 0.35 * v + 0.20 * r >= 0.17 THEN 'choppy' ELSE 'ok' END AS verdict FROM docs LEFT JOIN cad USING (doc_id))"""

_CONTENT = f"lword NOT IN {inlist(lx.FUNCTION_WORDS)}"
_PUNCT = r"[!-/:-@\[-`{-~]"
STYLE = FREQ + "," + TOKENS + f""",
fagg AS (SELECT doc_id, sum(n) AS n, count(*) AS types, sum(-(n / total) * log2(n / total)) AS bits, stddev_pop(n) AS sd, avg(n) AS mean,
  sum(CASE WHEN {_CONTENT} THEN n ELSE 0 END) AS content, sum(CASE WHEN length(lword) > 6 THEN n ELSE 0 END) AS long, sum(CASE WHEN {beats('lword')} >= 3 THEN n ELSE 0 END) AS hard
  FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM freq) GROUP BY doc_id),
sagg AS (SELECT doc_id, count(*) AS sentences, avg(n_words) AS asl, count(DISTINCT first_word) AS openers, count(first_word) AS opened FROM sents GROUP BY doc_id),
pagg AS (SELECT doc_id, stddev_pop(n_words) AS psd, avg(n_words) AS pmean FROM paras GROUP BY doc_id),
occ AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id, lword ORDER BY pos) AS prev, count(*) OVER (PARTITION BY doc_id) AS n FROM tokens),
mattr AS (SELECT doc_id, CASE WHEN max(n) < 50 THEN sum((prev IS NULL)::int) / max(n) ELSE
  sum(greatest(0, least(pos, n - 50) - greatest(coalesce(prev, -1) + 1, pos - 49, 0) + 1)) / (max(n) - 49) / 50 END AS m FROM occ GROUP BY doc_id),
style AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS words, coalesce(sentences, 0)::BIGINT AS sentences, round(coalesce(m, 0), 4) AS lexical_diversity,
  round(CASE WHEN types > 1 THEN bits / log2(types) ELSE 0 END, 4) AS entropy_norm, round(coalesce(bits, 0), 3) AS entropy_bits, round({ratio('sd', 'mean')}, 4) AS word_burstiness,
  round(coalesce(content, 0) / greatest(1, coalesce(n, 0)), 4) AS lexical_density, round(marks / greatest(1, chars), 4) AS pct_punctuation,
  round(coalesce(long, 0) / greatest(1, coalesce(n, 0)), 4) AS pct_long_words, round(coalesce(asl, 0), 2) AS mean_sentence_len,
  round(0.4 * (coalesce(asl, 0) + 100 * coalesce(hard, 0) / greatest(1, coalesce(n, 0))), 2) AS gunning_fog, round(contractions / greatest(1, coalesce(n, 0)) * 1000, 2) AS contraction_rate,
  round({ratio('openers', 'opened')}, 4) AS opener_diversity, round({ratio('psd', 'pmean')}, 4) AS para_len_cv
  FROM (SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, {q(_PUNCT)})) AS marks, {n_of('text', pt.CONTRACTION)} AS contractions FROM docs) d
  LEFT JOIN fagg USING (doc_id) LEFT JOIN sagg USING (doc_id) LEFT JOIN pagg USING (doc_id) LEFT JOIN mattr USING (doc_id))"""

_STYLE_COLS = "words, sentences, lexical_diversity, entropy_norm, entropy_bits, word_burstiness, lexical_density, pct_punctuation, pct_long_words, mean_sentence_len, gunning_fog, contraction_rate, opener_diversity, para_len_cv"

OVERLAP = f"""
content AS (SELECT doc_id, sent_no, list_distinct(list(w) FILTER (w NOT IN {inlist(lx.FUNCTION_WORDS)})) AS c
  FROM (SELECT doc_id, sent_no, unnest(CASE WHEN n_words = 0 THEN ['the'] ELSE ws END) AS w0, lower(w0) AS w FROM sents) GROUP BY ALL),
near AS (SELECT doc_id, coalesce(c, []::VARCHAR[]) AS c, coalesce(lag(c) OVER o, []::VARCHAR[]) AS b, lag(sent_no) OVER o AS p FROM content WINDOW o AS (PARTITION BY doc_id ORDER BY sent_no)),
overlap AS (SELECT doc_id, avg(len(list_intersect(b, c)) / len(list_distinct(list_concat(b, c)))) AS o FROM near WHERE p IS NOT NULL AND len(list_concat(b, c)) > 0 GROUP BY doc_id)"""

CHUNKS = f"""
chunked AS (SELECT *, CASE WHEN n < 32 THEN 0 ELSE pos // (n // 8) END AS chunk, CASE WHEN n < 32 THEN 1 ELSE 8 END AS of
  FROM (SELECT doc_id, pos, lword, (lword IN {inlist(lx.POSITIVE)})::int AS a, (lword IN {inlist(lx.NEGATIVE)})::int AS b, count(*) OVER (PARTITION BY doc_id) AS n FROM tokens)),
matched AS (SELECT doc_id, sum(a + b) AS matched, max(of) AS of FROM chunked GROUP BY doc_id),
valence AS (SELECT doc_id, avg(v) AS mean, var_pop(v) AS var FROM (SELECT doc_id, chunk, {ratio('sum(a) - sum(b)', 'sum(a) + sum(b)')} AS v FROM chunked WHERE chunk < of GROUP BY ALL) GROUP BY doc_id),
themes AS (SELECT doc_id, count(*) AS every, sum((k = 8)::int) AS shared FROM (SELECT doc_id, lword, count(DISTINCT chunk) AS k FROM chunked WHERE chunk < of AND length(lword) > 3 AND {_CONTENT} GROUP BY ALL) GROUP BY doc_id),
signals AS (SELECT doc_id, CASE WHEN matched >= 15 AND of > 1 THEN round(mean, 3) END AS mean_sentiment, CASE WHEN matched >= 15 AND of > 1 THEN round(var, 4) END AS sentiment_variance,
  coalesce(matched, 0)::BIGINT AS valence_tokens, round(CASE WHEN of > 1 AND every > 0 THEN 1 - shared / every ELSE 0 END, 4) AS topic_spread
  FROM docs LEFT JOIN matched USING (doc_id) LEFT JOIN valence USING (doc_id) LEFT JOIN themes USING (doc_id))"""

READABLE = f"""
ragg AS (SELECT doc_id, sum(n) AS n, count(*) AS types, sum(CASE WHEN {beats('lword')} >= 3 THEN n ELSE 0 END) AS poly FROM freq GROUP BY doc_id),
rsent AS (SELECT doc_id, count(*) AS s, stddev_pop(n_words) AS sd, avg(n_words) AS mean FROM sents GROUP BY doc_id),
readable AS (SELECT doc_id, round(coalesce(sd, 0), 2) AS sentence_rhythm, round(subs / greatest(1, coalesce(s, 0)), 2) AS subordination, round(coalesce(mean, 0), 2) AS mean_sentence_len,
  round({ratio('types', 'n')}, 4) AS lexical_diversity, round(1.0430 * sqrt(coalesce(poly, 0) * 30 / greatest(1, coalesce(s, 0))) + 3.1291, 2) AS smog
  FROM (SELECT doc_id, {n_of('text', pt.SUBORDINATORS)} AS subs FROM docs) LEFT JOIN ragg USING (doc_id) LEFT JOIN rsent USING (doc_id))"""


# a pattern in RE2 that finds as many matches, where the rule's own looks around
def rule_count(rule: str, col: str) -> str:
    r = pt.RULES[rule]
    if rule == "emdash":
        doubled = f"regexp_replace({col}, {q(f'({WS})')}, '\\1\\1', 'g')"
        return f"({n_of(col, r.patterns[0])} + {n_of(doubled, r'\s-{2,}\s')})"
    if rule == "litotes":
        return f"({n_of(col, r'\bnot\s+an?\s+\w+\s+one\b')} - {n_of(col, r'\bnot\s+an?\s+single\s+one\b')} + {n_of(col, r.patterns[1])} + {n_of(col, r.patterns[2])})"
    if rule == "colon":
        return n_of(col, r"[a-z]{3,}:[ \t]+[A-Za-z](?:[^.\n]{0,69}[^.\n0-9])?\.", ignore_case=False)
    if rule == "fromto":
        return n_of(col, r"\bfrom\s+[\w-]+(?:\s+[\w-]+){0,2}\s+to\s+[\w-]+(?:\s+[\w-]+){0,2}\b[,.;]")
    return "(" + " + ".join(n_of(col, p, rule not in pt.CASE_SENSITIVE) for p in r.patterns) + ")"


PATTERN_RULES = [r.id for r in pt.RULES.values() if r.patterns]
COUNTS = "counts AS (" + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule_id, {rule_count(r, 'text')}::BIGINT AS n FROM docs" for r in PATTERN_RULES) + ")"

_ADDRESS = f"(text LIKE '%?' OR regexp_matches(text, {q('(?i)' + re2(pt.APPEAL))}) OR regexp_matches(text, {q('(?i)' + re2(pt.FIRST_SINGULAR))}))"
_UNTHANKED = f"regexp_replace(text, {q('(?i)' + re2(pt.THANKS))}, ' ', 'g')"

_TAG_CASES = " ".join(f"WHEN regexp_matches(w, '({'|'.join(e)})$') THEN '{n}'" for n, e in pt.CLASS_SUFFIXES)
TAGS = f"""
tagged AS (SELECT doc_id, sent_no, row_number() OVER (PARTITION BY doc_id ORDER BY sent_no, k) - 1 AS pos,
  CASE WHEN w IN {inlist(lx.FUNCTION_WORDS)} THEN w WHEN regexp_matches(word, '^[A-Z]') THEN '^' {_TAG_CASES} WHEN regexp_matches(w, '(^|[^s])s$') THEN '~pl' ELSE '~n' END AS tag
  FROM (SELECT doc_id, sent_no, unnest(ws) AS word, unnest(range(len(ws))) AS k, replace(lower(word), '’', '''') AS w FROM sents))"""


def grams(width: int) -> str:
    ahead = " || ' ' || ".join(f"lead(tag, {i}) OVER o" for i in range(1, width))
    return f"grams AS (SELECT * FROM (SELECT doc_id, pos, CASE WHEN lead(sent_no, {width - 1}) OVER o = sent_no THEN sent_no END AS sent_no, tag || ' ' || {ahead} AS gram FROM tagged WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE gram IS NOT NULL)"


def word_grams(width: int, repeats: int) -> str:
    ahead = " || ' ' || ".join(f"lead(lword, {i}) OVER o" for i in range(1, width))
    content = " OR ".join(f"lead(lword, {i}) OVER o NOT IN {inlist(lx.FUNCTION_WORDS)}" for i in range(width))
    return f"""SELECT doc_id, gram, count(*) AS n, min("start") AS "start", min_by("end", "start") AS "end", {width} AS width FROM (
      SELECT doc_id, "start", lead("end", {width - 1}) OVER o AS "end", lword || ' ' || {ahead} AS gram, ({content}) AS content FROM ts WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
      WHERE gram IS NOT NULL AND content GROUP BY doc_id, gram HAVING count(*) >= {repeats}"""


_SEV = "CASE " + " ".join(f"WHEN rule_id IN {inlist(r.id for r in pt.RULES.values() if r.severity == s)} THEN {w}" for s, w in pt.SEVERITY_WEIGHT.items()) + " ELSE 1.0 END"
NOTED = f"""
found AS (SELECT result_id AS doc_id, regexp_replace(lower(rule_id), '[^a-z]', '', 'g') AS rule_id FROM (SELECT DISTINCT ON (hit_id) * FROM hits)),
rdocs AS (SELECT result_id AS doc_id, side, len({words("coalesce(text, '')")}) AS n_words FROM results)"""
AUDIT = NOTED + f""",
sides AS (SELECT side, count(*) AS docs FROM rdocs WHERE side IN ('machine', 'human') GROUP BY side),
rates AS (SELECT side, rule_id, sum(n / greatest(1, n_words) * 1000) AS rate FROM (SELECT doc_id, rule_id, count(*) AS n FROM found GROUP BY ALL) JOIN rdocs USING (doc_id) GROUP BY ALL),
wide AS (SELECT rule_id, coalesce(max(CASE WHEN side = 'machine' THEN rate / docs END), 0) AS m, coalesce(max(CASE WHEN side = 'human' THEN rate / docs END), 0) AS h
  FROM (SELECT unnest([{', '.join(q(r) for r in pt.RULES)}]) AS rule_id) LEFT JOIN rates USING (rule_id) LEFT JOIN sides USING (side) GROUP BY rule_id),
audit AS (SELECT rule_id, round(m, 3) AS machine_per_1k, round(h, 3) AS human_per_1k, CASE WHEN m = 0 AND h = 0 THEN 1.0 WHEN h = 0 THEN 'inf'::DOUBLE ELSE round(m / h, 3) END AS enrichment,
  CASE WHEN m = 0 AND h = 0 THEN 'unobserved' WHEN h = 0 THEN 'machine-only' WHEN m / h < 0.8 THEN 'inverted' WHEN m / h <= 1.25 THEN 'dead' ELSE 'live' END AS verdict FROM wide),
weights AS (SELECT rule_id, CASE WHEN isinf(enrichment) THEN CASE WHEN machine_per_1k >= 0.5 THEN 5.0 ELSE 1.0 END WHEN enrichment < 1.25 THEN 0.0 ELSE least(5.0, round(log2(enrichment), 3)) END::DOUBLE AS weight, enrichment, verdict FROM audit)"""

_VOICE = ("lexical_diversity", "entropy_norm", "lexical_density", "word_burstiness", "pct_punctuation", "pct_long_words", "mean_sentence_len", "gunning_fog", "contraction_rate", "opener_diversity")


def long(source: str, names, keep: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{n}' AS feature, {n}::DOUBLE AS value FROM {source}" for n in names)


def voice(by: str) -> str:
    k = f"{by}, " if by else ""
    on = f"{by} IS NOT DISTINCT FROM v_{by} AND " if by else ""
    return f"""
vals AS ({long(f"(SELECT style.*{', genre' if by else ''} FROM style JOIN documents USING (doc_id) WHERE style.words >= 150)", _VOICE, k + 'words')}),
med AS (SELECT {by + ' AS v_' + by + ', ' if by else ''}feature AS f, median(value) AS med, count(*) AS n_docs, sum(words) AS n_words, stddev_pop(value) AS sd FROM vals GROUP BY ALL HAVING count(*) >= 3),
voice AS (SELECT {k}feature, round(max(med), 6) AS center, round(CASE WHEN median(abs(value - med)) * 1.4826 <= 1e-9 THEN max(sd) ELSE median(abs(value - med)) * 1.4826 END, 6) AS scale,
  max(n_docs)::BIGINT AS n_docs, max(n_words)::BIGINT AS n_words FROM vals JOIN med ON {on}feature = f GROUP BY ALL)"""


_DEVICES = ", ".join(f"{n_of('text', p)} AS {k}" for k, p in pt.DEVICES.items() if k != "repetition")
_QUOTES = f"""quoted AS (
  SELECT doc_id, ofs + length(gap) AS qs, ofs + length(gap) + length(m) AS qe FROM (
    SELECT *, coalesce(sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM (
      SELECT doc_id, unnest(string_split_regex(text, {q(pt.QUOTED_SPAN)})) AS gap, unnest(regexp_extract_all(text, {q(pt.QUOTED_SPAN)})) AS m, unnest(range(len(string_split_regex(text, {q(pt.QUOTED_SPAN)})))) AS i FROM docs))
  WHERE m IS NOT NULL)"""

_SPANS = '"start"::INT AS "start", "end"::INT AS "end"'
# letters beyond ASCII made one ASCII letter, as word boundaries are those of ASCII here
def ascii_letters(col: str) -> str:
    letters = r"[\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2ff}\x{370}-\x{167f}\x{1681}-\x{1fff}\x{2c00}-\x{2dff}\x{3040}-\x{d7ff}\x{f900}-\x{fdff}\x{ff10}-\x{ffdc}]"
    return f"regexp_replace({col}, {q(letters)}, 'q', 'g')"


_REVISED = f"""docs AS (SELECT doc_id || ':before' AS doc_id, replace({SEEDED_TEXT}, chr(1), ' ') AS text FROM documents
  UNION ALL SELECT doc_id || ':after', replace(coalesce(text, ''), chr(1), ' ') FROM documents)"""

ORACLE: dict[str, str] = {
    "document_profile": f"WITH {DOCS}, {SENTS}, {METRICS}, {STYLE} SELECT metrics.doc_id, metrics.sentences, metrics.words, mean_len, stdev_len, cv, pct_short, pct_long, lexical_density FROM metrics JOIN style USING (doc_id)",
    "masked_documents": f"WITH {DOCS} SELECT doc_id, length(text)::BIGINT AS chars, md5(text) AS digest FROM docs",
    "word_counts": f"WITH {DOCS} SELECT doc_id, len({words('text')})::BIGINT AS n_words FROM docs",
    "word_frequencies": f"WITH {DOCS}, {FREQ} SELECT * FROM freq",
    "paragraph_spans": f"WITH {DOCS}, {PARAS} SELECT doc_id, para_no::INT AS para_no, {_SPANS}, n_words::INT AS n_words FROM paras",
    "sentence_spans": f"WITH {DOCS}, {SENTS} {FINITE} SELECT doc_id, sent_no::INT AS sent_no, para_no::INT AS para_no, {_SPANS}, n_words::INT AS n_words, first_word, finite FROM fsents",
    "token_spans": f"WITH {DOCS}, {TOKENS} SELECT doc_id, pos::INT AS pos, {_SPANS}, lword FROM tokens",
    "sentence_metrics": f"WITH {DOCS}, {SENTS}, {METRICS} SELECT * FROM metrics",
    "metric_warnings": f"""WITH {DOCS}, {SENTS}, {METRICS} SELECT doc_id, concat_ws('; ', CASE WHEN cv < 0.45 THEN 'flat sentence length' END, CASE WHEN longest_flat_run > 6 THEN 'long run of like sentences' END,
      CASE WHEN words > 400 AND footprint = 0 THEN 'no first-person footprint' END) AS warnings FROM metrics""",
    "cadence": f"WITH {DOCS}, {SENTS} {FINITE}, {CADENCE} SELECT * FROM cadence",
    "stylometry": f"WITH {DOCS}, {SENTS}, {STYLE} SELECT doc_id, {_STYLE_COLS} FROM style",
    "adjacent_overlap": f"WITH {DOCS}, {SENTS}, {OVERLAP} SELECT doc_id, round(coalesce(o, 0), 4) AS adjacent_overlap FROM docs LEFT JOIN overlap USING (doc_id)",
    "chunk_signals": f"WITH {DOCS}, {TOKENS}, {CHUNKS} SELECT * FROM signals",
    "device_counts": f"WITH {SEEDED} SELECT doc_id, {_DEVICES} FROM docs",
    "readability": f"WITH {DOCS}, {SENTS}, {FREQ}, {READABLE} SELECT * FROM readable",
    "person_mix": f"""WITH {SEEDED}, {SENTS}, you AS (SELECT doc_id, sum(CASE WHEN {_ADDRESS} THEN 0 ELSE n END) AS g, sum(CASE WHEN {_ADDRESS} THEN n ELSE 0 END) AS a
      FROM (SELECT doc_id, text, {n_of(_UNTHANKED, pt.SECOND)} AS n FROM sents) GROUP BY doc_id)
      SELECT doc_id, greatest(1, len({words('text')}))::BIGINT AS words, {n_of(ascii_letters('text'), pt.FIRST_PLURAL)}::BIGINT AS first_plural, {n_of(ascii_letters('text'), pt.FIRST_SINGULAR)}::BIGINT AS first_singular,
      coalesce(g, 0)::BIGINT AS second_generic, coalesce(a, 0)::BIGINT AS second_address, round(coalesce(g, 0) / greatest(1, len({words('text')})) * 1000, 2) AS generic_per_1k FROM docs LEFT JOIN you USING (doc_id)""",
    "pattern_rule_counts": f"WITH {SEEDED}, {COUNTS} SELECT * FROM counts",
    "vocab_hits": f"""WITH {SEEDED}, {TOKENS}, {_QUOTES} SELECT doc_id, {_SPANS}, word AS text FROM tokens t WHERE replace(lword, '’', '''') IN {inlist(lx.EXCESS_VOCABULARY)}
      AND NOT EXISTS (SELECT 1 FROM quoted q WHERE q.doc_id = t.doc_id AND qs <= t."start" AND t."start" < qe)""",
    "fragment_runs": f"""WITH {SEEDED}, {SENTS} SELECT doc_id, min("start")::INT AS "start", max("end")::INT AS "end", count(*) || ' in a row' AS note FROM (
      SELECT *, sum((n_words > 7)::int) OVER (PARTITION BY doc_id ORDER BY sent_no) AS island FROM sents) WHERE n_words <= 7 GROUP BY doc_id, island HAVING count(*) >= 3""",
    "opener_runs": f"""WITH {SEEDED}, {SENTS}, o AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY sent_no) AS island FROM (
        SELECT *, coalesce(first_word = lag(first_word) OVER (PARTITION BY doc_id ORDER BY sent_no), false) AS same FROM sents)),
      g AS (SELECT doc_id, min("start") AS "start", max("end") AS "end", count(*) AS n, min_by(text, sent_no) AS t, min_by(ws[1], sent_no) AS w FROM o WHERE first_word NOT IN {inlist(lx.PLAIN_OPENERS)} GROUP BY doc_id, island)
      SELECT doc_id, {_SPANS}, n || 'x ''' || w || ''' from "' || substring(t, 1, 34) || CASE WHEN length(t) > 34 THEN '...' ELSE '' END || '"' AS text FROM g WHERE n >= 3""",
    "question_openers": f"""WITH {SEEDED}, {SENTS} SELECT doc_id, {_SPANS}, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, para_no ORDER BY sent_no) AS nth FROM sents) WHERE nth = 1 AND text LIKE '%?'""",
    "template_hits": f"""WITH {SEEDED}, {TOKENS}, ts AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM tokens) WHERE total >= 12),
      g AS ({word_grams(4, 3)} UNION ALL {word_grams(6, 2)}),
      k AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, width ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g)
      SELECT doc_id, {_SPANS}, gram AS text, n || 'x, ' || width || '-gram' AS note FROM k WHERE before IS NULL OR "end" > before""",
    "runt_sentences": f"""WITH {SEEDED}, {SENTS} {FINITE} SELECT doc_id, {_SPANS}, text, n_words || 'w, floor 5' AS note FROM fsents WHERE n_words < 5 AND NOT finite""",
    "closers_over_budget": f"""WITH {SEEDED}, {SENTS} {FINITE},
      last AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, para_no) AS of, row_number() OVER (PARTITION BY doc_id, para_no ORDER BY sent_no DESC) AS nth FROM fsents) WHERE nth = 1 AND of >= 2 AND n_words <= 8),
      rate AS (SELECT doc_id, para_no FROM paras WHERE n_words >= 15), allowed AS (SELECT doc_id, floor(count(*) * 0.25) AS allowance FROM rate GROUP BY doc_id)
      SELECT doc_id, {_SPANS}, text, n_words || 'w closer' || CASE WHEN finite THEN '' ELSE ', verbless' END AS note FROM (
        SELECT last.*, row_number() OVER (PARTITION BY doc_id ORDER BY NOT finite, n_words DESC, "start") AS k FROM last JOIN rate USING (doc_id, para_no)) JOIN allowed USING (doc_id) WHERE k > allowance""",
    "generic_you": f"""WITH {SEEDED}, {SENTS} SELECT doc_id, {_SPANS}, substring(text, 1, 70) AS text FROM sents WHERE regexp_matches({_UNTHANKED}, {q('(?i)' + re2(pt.SECOND))}) AND NOT {_ADDRESS}""",
    "tag_ngram_repeat": f"WITH {DOCS}, {SENTS}, {TAGS}, {grams(4)} SELECT doc_id, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 4) AS repeat_mass FROM (SELECT doc_id, gram, count(*) AS n FROM grams GROUP BY ALL) GROUP BY doc_id",
    "template_rates": f"""WITH {DOCS}, {SENTS}, {TAGS}, {grams(6)}, hit AS (SELECT doc_id, count(DISTINCT sent_no) AS hit, count(*) AS mass FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n >= 2 GROUP BY doc_id),
      size AS (SELECT doc_id, count(*) AS s, sum(n_words) AS t FROM sents GROUP BY doc_id)
      SELECT doc_id, coalesce(t, 0)::BIGINT AS tokens, CASE WHEN t >= 24 THEN round(coalesce(hit, 0) / s, 3) ELSE 0.0 END AS template_rate, CASE WHEN t >= 24 THEN round(coalesce(mass, 0) / t * 1000, 2) ELSE 0.0 END AS templates_per_1k
      FROM docs LEFT JOIN size USING (doc_id) LEFT JOIN hit USING (doc_id)""",
    "top_templates": f"""WITH {DOCS}, {SENTS}, {TAGS}, {grams(6)} SELECT doc_id, place::INT AS place, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS place FROM (
      SELECT doc_id, gram, count(*) AS n, min(pos) AS first FROM grams GROUP BY ALL) WHERE n >= 2) WHERE place <= 5""",
    "rule_audit": f"WITH {AUDIT} SELECT * FROM audit",
    "measured_weights": f"WITH {AUDIT} SELECT * FROM weights",
    "pinned_weights": f"""WITH {AUDIT} SELECT rule_id, weight, pin, coalesce(pin, weight, 1.0) AS effective, coalesce(abs(pin - weight) > 0.5, false) AS disagrees FROM (
      SELECT *, CASE rule_id WHEN 'vocab' THEN 3.0::DOUBLE WHEN 'doublet' THEN 5.0::DOUBLE WHEN 'closer' THEN 0.0::DOUBLE END AS pin FROM weights)""",
    "weighted_scores": f"""WITH {NOTED} SELECT doc_id, coalesce(total, 0)::BIGINT AS total, coalesce(round(coalesce(total, 0) / nullif(n_words, 0) * 1000, 2), 0.0) AS per_1k, coalesce(round(coalesce(w, 0) / nullif(n_words, 0) * 1000, 2), 0.0) AS score
      FROM rdocs LEFT JOIN (SELECT doc_id, count(*) AS total, sum({_SEV})::DOUBLE AS w FROM found GROUP BY doc_id) USING (doc_id)""",
    "feature_audit": f"""WITH {PLAIN}, {SENTS}, {STYLE}, vals AS ({long("(SELECT style.*, side FROM style JOIN documents USING (doc_id) WHERE side IN ('machine', 'human'))", [c.strip() for c in _STYLE_COLS.split(',')], 'side')}),
      g AS (SELECT feature, avg(value) FILTER (side = 'machine') AS mm, avg(value) FILTER (side = 'human') AS hm, var_pop(value) FILTER (side = 'machine') AS mv, var_pop(value) FILTER (side = 'human') AS hv FROM vals GROUP BY feature)
      SELECT feature, round(mm, 4) AS machine_mean, round(hm, 4) AS human_mean, round(CASE WHEN sqrt((mv + hv) / 2) < 1e-12 THEN 0 ELSE (mm - hm) / sqrt((mv + hv) / 2) END, 3) AS cohens_d FROM g""",
    "voiceprint": f"WITH {PLAIN}, {SENTS}, {STYLE}, {voice('genre')} SELECT * FROM voice",
    "voice_deviations": f"""WITH {PLAIN}, {SENTS}, {STYLE}, {voice('')}, every AS ({long('style', _VOICE, 'doc_id')})
      SELECT doc_id, feature, round((value - center) / scale, 2) + 0.0 AS z FROM every JOIN voice USING (feature) WHERE scale > 1e-9""",
    "drift_verdicts": f"""WITH {_REVISED}, {SENTS} {FINITE}, {CADENCE}, {STYLE}, {COUNTS}, hits AS (SELECT doc_id, sum(n) AS n FROM counts GROUP BY doc_id),
      sided AS (SELECT string_split(doc_id, ':')[1]::BIGINT AS pair_id, string_split(doc_id, ':')[2] AS side, hits.n AS h, choppiness AS c, lexical_density AS d, entropy_norm AS e, verdict AS v
        FROM cadence JOIN style USING (doc_id) JOIN hits USING (doc_id)),
      j AS (SELECT b.pair_id, b.h::BIGINT AS hits_before, a.h::BIGINT AS hits_after, b.c AS choppiness_before, a.c AS choppiness_after, b.d AS density_before, a.d AS density_after,
        b.e AS entropy_before, a.e AS entropy_after, a.v AS va FROM sided b JOIN sided a USING (pair_id) WHERE b.side = 'before' AND a.side = 'after')
      SELECT pair_id, hits_before, hits_after, choppiness_before, choppiness_after, density_before, density_after, entropy_before, entropy_after,
        CASE WHEN choppiness_after - choppiness_before >= 0.03::DOUBLE OR (va = 'choppy' AND choppiness_after > choppiness_before) THEN 'choppy' WHEN hits_before <= hits_after AND hits_after = 0 THEN 'overfit'
          WHEN hits_before - hits_after < 1 THEN 'churned' WHEN density_after - density_before <= -0.015::DOUBLE AND abs(choppiness_after - choppiness_before) < 0.02::DOUBLE THEN 'traded' ELSE 'improved' END AS verdict,
        CASE WHEN abs(choppiness_after - choppiness_before) >= 0.02::DOUBLE THEN 'density and burstiness move with choppiness' END AS note FROM j""",
}

# ---------------------------------------------------------------- segments, runs, pairs and budgets

_SEP = rf"[,;:]{WS}+"
_WITHIN = "PARTITION BY doc_id, sent_no ORDER BY j"
_ARMS = q(rf"(?is)^(.*?){re2(pt.COORDINATION)}(.*)$")
SEGMENTS = f""",
seg_pieces AS (
  SELECT doc_id, sent_no, base, unnest(string_split(c, chr(1))) AS piece, unnest(range(len(string_split(c, chr(1))))) AS j
  FROM (SELECT doc_id, sent_no, "start" AS base, regexp_replace(text, {q(rf'([(\[{{)\]}}"“”]|{_SEP})')}, '\\1' || chr(1), 'g') AS c FROM sents)),
seg_sums AS (
  SELECT *, base + coalesce(sum(length(piece)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
    sum(CASE WHEN right(piece, 1) IN ('(', '[', '{{') THEN 1 WHEN right(piece, 1) IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS deep,
    sum((right(piece, 1) IN ('"', '“', '”'))::int) OVER (w ROWS UNBOUNDED PRECEDING) AS quotes FROM seg_pieces WINDOW w AS ({_WITHIN})),
seg_ends AS (
  SELECT *, (regexp_matches(piece, {q(_SEP + '$')}) AND deep - least(0, min(deep) OVER ({_WITHIN} ROWS UNBOUNDED PRECEDING)) = 0 AND quotes % 2 = 0)::int AS ends FROM seg_sums),
seg_whole AS (
  SELECT doc_id, sent_no, seg, min(place) AS place, CASE WHEN max(ends) = 1 THEN regexp_replace(string_agg(piece, '' ORDER BY j), {q(_SEP + '$')}, '') ELSE string_agg(piece, '' ORDER BY j) END AS t
  FROM (SELECT *, coalesce(sum(ends) OVER ({_WITHIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM seg_ends) GROUP BY ALL),
seg_seen AS (SELECT *, count(*) OVER (PARTITION BY doc_id, sent_no) AS of, row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY seg) AS nth FROM seg_whole WHERE regexp_replace(t, {_STRIP}, '', 'g') <> ''),
seg_arms AS (SELECT *, of >= 2 AND nth = of AND regexp_matches(t, {_ARMS}) AS two FROM seg_seen),
segs AS (
  SELECT doc_id, sent_no, row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY seg, k) - 1 AS seg_no, place + off AS "start", place + off + length(t) AS "end", t AS text FROM (
    SELECT doc_id, sent_no, seg, place, 0 AS k, 0 AS off, CASE WHEN two THEN regexp_extract(t, {_ARMS}, 1) ELSE t END AS t FROM seg_arms
    UNION ALL SELECT doc_id, sent_no, seg, place, 1, length(t) - length(regexp_extract(t, {_ARMS}, 2)), regexp_extract(t, {_ARMS}, 2) FROM seg_arms WHERE two))"""


def stripped(col: str) -> str:
    return f"regexp_replace({col}, {_STRIP}, '', 'g')"


def lead_words(col: str) -> str:
    """Words behind a conjunction in front."""
    return words(f"regexp_replace({stripped(col)}, {q('(?i)' + re2(pt.LEAD))}, '')")


def _cls(i: int) -> str:
    w = f"lower(ws[{i}])"
    return f"CASE WHEN {w} IS NULL THEN '' WHEN {w} IN {inlist(lx.FUNCTION_WORDS)} THEN {w} ELSE '#' END"


def _skeleton(source: str) -> str:
    return f"SELECT *, CASE WHEN len(ws) BETWEEN 1 AND 14 THEN ({_cls(1)}) || '|' || ({_cls(2)}) || '|' || (len(ws) // 3) END AS skeleton, lower(ws[1]) AS lead FROM ({source})"


def _islands(units: str, keys: str, order: str, value: str, level: str, rank: int, kind: int, where: str = "", preview: str = "substring(string_agg(text, ' | ' ORDER BY o), 1, 70)") -> str:
    w = f"PARTITION BY {keys} ORDER BY {order}"
    return f"""SELECT doc_id, min("start") AS "start", max("end") AS "end", '{level}' AS level, count(*) AS arity, {preview} AS preview, {rank} AS level_rank, {kind} AS kind_rank
  FROM (SELECT *, {order} AS o, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER ({w}) AS island FROM (SELECT *, coalesce({value} = lag({value}) OVER ({w}), false) AS same FROM {units}))
  WHERE {value} IS NOT NULL GROUP BY {keys}, island HAVING count(*) >= 3 {where}"""


def _uncontained(source: str) -> str:
    """Without what ends no later than something before it."""
    return f"""SELECT * EXCLUDE (before) FROM (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" - "start" DESC, arity DESC, level_rank, kind_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {source}) WHERE before IS NULL OR "end" > before"""


_PROPER = f"coalesce(regexp_matches(regexp_extract(text, {WORD}), '^[A-Z]'), false) AS proper"
_OWN = words(f"regexp_replace(text, {q('(?i)' + re2(pt.LEAD))}, '')")
_TRIMMED = "CASE WHEN keep >= 1 AND seg_no = 0 AND len(own) > keep THEN array_to_string(own[len(own) - keep + 1:len(own)], ' ') WHEN keep >= 1 AND seg_no = of - 1 AND len(own) > keep THEN array_to_string(own[1:keep], ' ') ELSE text END"
RUNS = f""",
seg_sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, sent_no) AS of, len({words('text')}) AS n, {_OWN} AS own FROM segs),
seg_middle AS (SELECT doc_id, sent_no, list_sort(list(n)) AS lens FROM seg_sized WHERE seg_no > 0 AND seg_no < of - 1 GROUP BY ALL),
seg_kept AS (SELECT seg_sized.*, lens[len(lens) // 2 + 1] AS keep, {_PROPER} FROM seg_sized JOIN seg_middle USING (doc_id, sent_no) WHERE of >= 3),
seg_units AS (SELECT * REPLACE (lower(({lead_words('text')})[1]) AS lead) FROM ({_skeleton(f"SELECT *, {lead_words(_TRIMMED)} AS ws FROM seg_kept")})),
sent_units AS ({_skeleton(f'SELECT doc_id, sent_no, "start", "end", text, {lead_words("text")} AS ws FROM sents')}),
para_units AS ({_skeleton(f'SELECT doc_id, para_no, "start", "end", text, {lead_words("text")} AS ws FROM paras')}),
all_runs AS ({" UNION ALL ".join([
    _islands("seg_units", "doc_id, sent_no", "seg_no", "skeleton", "in-sentence", 0, 0, "AND NOT bool_and(proper)"),
    _islands("seg_units", "doc_id, sent_no", "seg_no", "lead", "in-sentence", 0, 1, "AND NOT bool_and(proper)"),
    _islands("sent_units", "doc_id", "sent_no", "skeleton", "cross-sentence", 1, 0),
    _islands("sent_units", "doc_id", "sent_no", "lead", "cross-sentence", 1, 1),
    _islands("para_units", "doc_id", "para_no", "lead", "paragraph", 2, 0, "", "string_agg(substring(text, 1, 22), ' | ' ORDER BY o)"),
])}),
runs AS ({_uncontained('all_runs')})"""

_HAS = lambda col, p: f"regexp_matches({col}, {q('(?i)' + re2(p))})"
_PRON, _NEG = inlist(lx.PRONOUNS), inlist(lx.NEGATORS)
PAIRS = f""",
neighbours AS (
  SELECT doc_id, "start", lead("end") OVER w AS "end", text AS l, lead(text) OVER w AS r, 0 AS level_rank FROM segs WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY seg_no)
  UNION ALL SELECT doc_id, "start", lead("end") OVER w, text, lead(text) OVER w, 1 FROM sents WINDOW w AS (PARTITION BY doc_id ORDER BY sent_no)),
near_pairs AS (SELECT *, row_number() OVER () AS id, [lower(x) for x in a] AS la, [lower(x) for x in b] AS lb FROM (SELECT *, {lead_words('l')} AS a, {lead_words('r')} AS b FROM neighbours WHERE r IS NOT NULL)
  WHERE len(a) BETWEEN 2 AND 14 AND len(b) BETWEEN 2 AND 14 AND abs(len(a) - len(b)) <= 3),
anchors AS (SELECT id, min(w) AS anchor FROM (SELECT id, unnest(list_intersect(la, lb)) AS w FROM near_pairs) WHERE w NOT IN {_PRON} AND (w NOT IN {inlist(lx.FUNCTION_WORDS)} OR w IN {_NEG}) GROUP BY id),
reasoned AS (SELECT *, CASE WHEN la[1] = lb[1] AND la[1] NOT IN {_PRON} THEN 'anaphora on ''' || la[1] || ''''
    WHEN la[1] = lb[1] AND la[2] = lb[2] THEN 'repeated opening ''' || a[1] || ' ' || a[2] || ''''
    WHEN la[1] = lb[1] AND abs(len(a) - len(b)) <= 2 AND {_HAS('l', pt.STRONG_NEGATOR)} <> {_HAS('r', pt.STRONG_NEGATOR)} THEN 'antithesis, same opening'
    WHEN {_HAS('l', pt.NEGATOR)} <> {_HAS('r', pt.NEGATOR)} AND anchor IS NOT NULL THEN 'antithesis on ''' || anchor || ''''
    WHEN {_HAS('l', pt.NEGATOR)} AND {_HAS('r', pt.NEGATOR)} AND anchor IN {_NEG} THEN 'negated pair on ''' || anchor || '''' END AS reason FROM near_pairs LEFT JOIN anchors USING (id)),
all_pairs AS (SELECT doc_id, "start", "end", reason, substring({stripped('l')} || ' | ' || {stripped('r')}, 1, 70) AS preview, 2 AS arity, level_rank, 0 AS kind_rank FROM reasoned WHERE reason IS NOT NULL),
pairs AS ({_uncontained('all_pairs')})"""

SIZES = f", sizes AS (SELECT doc_id, len({words('text')}) AS n_words FROM docs)"


def _over(source: str, order: str, per_1k: float) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS place FROM {source}) JOIN sizes USING (doc_id) WHERE place > floor(n_words / 1000 * {per_1k})"


_PAIR_RANK = "CASE WHEN contains(reason, 'repeated opening') THEN 0 WHEN contains(reason, 'anaphora') THEN 1 WHEN contains(reason, 'negated pair') THEN 2 WHEN contains(reason, 'antithesis') THEN 3 ELSE 1 END"
OVER = SIZES + f", over_runs AS ({_over('runs', 'arity, \"start\", \"end\"', 1.0)}), over_pairs AS ({_over('pairs', _PAIR_RANK + ', \"start\", \"end\"', 2.0)})"

_NAMED = (pt.YEAR, pt.UNIT, pt.QUOTED_TERM, pt.CODE_TERM, pt.NUMBER_WORD)
_NAME = r"\b[A-Z][a-zA-Z'\x{2019}-]{1,}"


def specifics(col: str) -> str:
    """Names count unless they open the text or follow an end mark; the marks before them are taken along, as nothing looks behind here."""
    plain = ascii_letters(col)
    named = " + ".join(n_of(plain, p) for p in _NAMED)
    inside = n_of(col, rf"[a-z,;:)\"'{pt.SPACE}]{_NAME}", ignore_case=False)
    opening = n_of(col, rf"[.!?]\s{{1,20}}{_NAME}", ignore_case=False)
    first = f"regexp_matches({col}, {q(re2(rf'\A\s{{1,20}}{_NAME}'))})::int"
    numerals = f"CASE WHEN {named} = 0 THEN {n_of(plain, pt.NUMERAL)} ELSE 0 END"
    return f"({named} + {numerals} + {inside} - {opening} - {first})"


CLOSERS = """,
last_sents AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, para_no) AS of, row_number() OVER (PARTITION BY doc_id, para_no ORDER BY sent_no DESC) AS nth FROM fsents) WHERE nth = 1 AND of >= 2 AND n_words <= 8),
rate AS (SELECT doc_id, para_no FROM paras WHERE n_words >= 15),
closers AS (SELECT last_sents.* FROM last_sents JOIN rate USING (doc_id, para_no))"""
PUNCH = CLOSERS + """,
counted AS (SELECT doc_id, n_words, coalesce(c, 0) AS c, coalesce(p, 0) AS p, coalesce(d, 0) AS d, coalesce(r, 0) AS r, choppiness FROM sizes JOIN cadence USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS c FROM closers GROUP BY ALL) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS p FROM rate GROUP BY ALL) USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS d FROM pairs GROUP BY ALL) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS r FROM runs GROUP BY ALL) USING (doc_id)),
rated AS (SELECT *, CASE WHEN p = 0 THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, c / p), 3) END AS ratio, d / greatest(1, n_words) * 1000 AS dk, r / greatest(1, n_words) * 1000 AS rk FROM counted),
punch AS (SELECT *, 0.4::DOUBLE * least(1.0::DOUBLE, choppiness / 0.6::DOUBLE) + 0.3::DOUBLE * least(1.0::DOUBLE, ratio / 0.6::DOUBLE) + 0.2::DOUBLE * least(1.0::DOUBLE, dk / 20.0::DOUBLE) + 0.1::DOUBLE * least(1.0::DOUBLE, rk / 8.0::DOUBLE) AS score FROM rated)"""


def all_counts(runts: bool) -> str:
    """One row a hit of every rule but those off by default."""
    every = [f"SELECT doc_id, rule_id, n FROM counts", "SELECT doc_id, 'parallel', count(*) FROM over_runs GROUP BY ALL", "SELECT doc_id, 'doublet', count(*) FROM over_pairs GROUP BY ALL"]
    one = "SELECT doc_id, '{}', count(*) FROM ({}) GROUP BY ALL"
    every += [
        one.format("vocab", f"""SELECT doc_id FROM tokens t WHERE replace(lword, '’', '''') IN {inlist(lx.EXCESS_VOCABULARY)} AND NOT EXISTS (SELECT 1 FROM quoted q WHERE q.doc_id = t.doc_id AND qs <= t."start" AND t."start" < qe)"""),
        one.format("fragments", "SELECT doc_id, island FROM (SELECT *, sum((n_words > 7)::int) OVER (PARTITION BY doc_id ORDER BY sent_no) AS island FROM sents) WHERE n_words <= 7 GROUP BY ALL HAVING count(*) >= 3"),
        one.format("question", "SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, para_no ORDER BY sent_no) AS nth FROM sents) WHERE nth = 1 AND text LIKE '%?'"),
        one.format("opener", f"SELECT doc_id, island FROM (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY sent_no) AS island FROM (SELECT *, coalesce(first_word = lag(first_word) OVER (PARTITION BY doc_id ORDER BY sent_no), false) AS same FROM sents)) WHERE first_word NOT IN {inlist(lx.PLAIN_OPENERS)} GROUP BY ALL HAVING count(*) >= 3"),
        one.format("template", f"""SELECT doc_id FROM (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, width ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({word_grams(4, 3)} UNION ALL {word_grams(6, 2)})) WHERE before IS NULL OR "end" > before"""),
        one.format("closer", "SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY NOT finite, n_words DESC, \"start\") AS k FROM closers) JOIN (SELECT doc_id, floor(count(*) * 0.25) AS allowance FROM rate GROUP BY doc_id) USING (doc_id) WHERE k > allowance"),
        one.format("vague", f"SELECT doc_id FROM paras WHERE n_words >= 40 AND {specifics('text')} = 0"),
    ]
    if runts:
        every.append(one.format("runt", "SELECT doc_id FROM fsents WHERE n_words < 5 AND NOT finite"))
    return f", ts AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM tokens) WHERE total >= 12), every_count AS ({' UNION ALL '.join(every)})"


_ALL = f"{SENTS} {FINITE} {SEGMENTS} {RUNS} {PAIRS} {OVER} {CLOSERS}, {TOKENS}, {_QUOTES}, {COUNTS}"
ORACLE |= {
    "segment_spans": f"WITH {DOCS}, {SENTS} {SEGMENTS} SELECT doc_id, sent_no::INT AS sent_no, seg_no::INT AS seg_no, {_SPANS}, text FROM segs",
    "specifics_counts": f"WITH {SEEDED} SELECT doc_id, {specifics('text')}::BIGINT AS specifics FROM docs",
    "vague_paragraphs": f"""WITH {SEEDED}, {PARAS} SELECT doc_id, {_SPANS}, n_words || 'w paragraph' AS note FROM paras WHERE n_words >= 40 AND {specifics('text')} = 0""",
    "parallel_runs": f"""WITH {DOCS}, {SENTS} {SEGMENTS} {RUNS} SELECT doc_id, {_SPANS}, level, arity, preview FROM runs""",
    "doublet_pairs": f"""WITH {DOCS}, {SENTS} {SEGMENTS} {PAIRS} SELECT doc_id, {_SPANS}, reason, preview FROM pairs""",
    "parallel_over_budget": f"""WITH {SEEDED}, {SENTS} {SEGMENTS} {RUNS} {PAIRS} {OVER} SELECT doc_id, 'parallel' AS rule_id, {_SPANS}, preview AS text, arity || ' units, ' || level AS note FROM over_runs""",
    "doublets_over_budget": f"""WITH {SEEDED}, {SENTS} {SEGMENTS} {RUNS} {PAIRS} {OVER} SELECT doc_id, 'doublet' AS rule_id, {_SPANS}, preview AS text, 'doublet, ' || reason AS note FROM over_pairs""",
    "punch_scores": f"""WITH {DOCS}, {SENTS} {FINITE} {SEGMENTS} {RUNS} {PAIRS} {SIZES}, {CADENCE} {PUNCH}
      SELECT doc_id, round(score, 3) AS punch, round(choppiness, 3) AS choppiness, ratio AS closer_ratio, round(dk, 2) AS doublets_per_1k, round(rk, 2) AS parallel_per_1k, CASE WHEN score >= 0.2::DOUBLE THEN 'punchy' ELSE 'ok' END AS verdict FROM punch""",
    "all_rule_counts": f"""WITH {SEEDED}, {_ALL} {all_counts(True)} SELECT doc_id, rule_id, coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT doc_id, unnest([{', '.join(q(r) for r in pt.RULES)}]) AS rule_id FROM docs) LEFT JOIN every_count USING (doc_id, rule_id) GROUP BY ALL""",
    "drift_all_rules": f"""WITH {_REVISED}, {SENTS} {FINITE} {SEGMENTS} {RUNS} {PAIRS} {OVER} {CLOSERS}, {CADENCE}, {STYLE}, {_QUOTES}, {COUNTS} {all_counts(False)},
      hits AS (SELECT doc_id, coalesce(sum(n), 0) AS n FROM docs LEFT JOIN every_count USING (doc_id) GROUP BY doc_id),"""
    + ORACLE["drift_verdicts"].split("FROM counts GROUP BY doc_id),")[1],
    "voice_notes": f"""WITH {PLAIN}, {SENTS}, {STYLE}, {voice('')}, every AS ({long('style', _VOICE, 'doc_id')}), z AS (SELECT doc_id, feature, round((value - center) / scale, 2) + 0.0 AS z FROM every JOIN voice USING (feature) WHERE scale > 1e-9),
      wide AS (SELECT doc_id, max(z) FILTER (feature = 'lexical_density') AS ld, max(z) FILTER (feature = 'lexical_diversity') AS dv, max(z) FILTER (feature = 'entropy_norm') AS en,
        string_agg(feature || ' ' || z || ' from the usual', '; ' ORDER BY abs(z) DESC, feature) FILTER (abs(z) >= 2 AND feature NOT IN ('lexical_density', 'lexical_diversity', 'entropy_norm')) AS rest FROM z GROUP BY doc_id)
      SELECT doc_id, concat_ws('; ', CASE WHEN ld <= -2 THEN 'lexical density ' || ld || ' below the usual' || CASE WHEN en < 0 THEN ' with entropy' ELSE '' END END,
        CASE WHEN dv >= 2 AND en >= 2 THEN 'lexical diversity and entropy above the usual together' END, rest) AS notes FROM wide""",
}

_PINS = {"talk": {"fragments": 5.0, "doublet": 5.0, "parallel": 5.0, "runt": 4.0, "closer": 4.0, "opener": 3.0, "person": 3.0}, "essay": {"vague": 4.0, "template": 4.0}}


def _pinned(name: str) -> str:
    """Weight of a hit: the pin, and 1 for others; by severity where a profile pins nothing."""
    return "CASE rule_id " + " ".join(f"WHEN '{r}' THEN {w}::DOUBLE" for r, w in _PINS[name].items()) + " ELSE 1.0::DOUBLE END" if name in _PINS else f"({_SEV})::DOUBLE"


ORACLE["profile_scores"] = f"WITH {NOTED} " + " UNION ALL ".join(
    f"""SELECT '{n}' AS profile, doc_id, coalesce(total, 0)::BIGINT AS total, coalesce(round(coalesce(total, 0) / nullif(n_words, 0) * 1000, 2), 0.0) AS per_1k, coalesce(round(coalesce(w, 0) / nullif(n_words, 0) * 1000, 2), 0.0) AS score
      FROM rdocs LEFT JOIN (SELECT doc_id, count(*) AS total, sum({_pinned(n)})::DOUBLE AS w FROM found GROUP BY doc_id) USING (doc_id)"""
    for n in ("talk", "essay", "docs")
)
