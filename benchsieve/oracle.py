"""Checking SQL: the same results as the registered queries, over the given tables."""

from __future__ import annotations

from benchsieve import policy
from benchsieve.functions.text import ACCENTED, PLAIN, SPACE, WORD
from benchsieve.sources.adapters import TABLES, VIEWS, view_sql


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def norm(x: str) -> str:
    return strip(f"regexp_replace(lower({x}), '{SPACE}+', ' ', 'g')")


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{WORD}'))"


def any_of(x: str, tokens: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in tokens) + ")"


def names(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def number(x: str) -> str:
    return f"TRY_CAST({x} AS DOUBLE)"


COMPLEXITY = f"""CASE
  WHEN {words('lower(prompt)')} <= 10 AND NOT {any_of('lower(prompt)', policy.NOT_LOW_TOKENS)} THEN 'low'
  WHEN {words('lower(prompt)')} >= 45 OR {any_of('lower(prompt)', policy.HIGH_TOKENS)} THEN 'high'
  ELSE 'mid' END"""
CLARITY = f"""CASE
  WHEN {words('prompt')} <= 3 OR {any_of('lower(prompt)', policy.AMBIGUOUS_MARKERS)} THEN 'UNCLEAR'
  WHEN {any_of('lower(prompt)', policy.TASK_VERBS)}
   AND ({words('prompt')} >= 8 OR {any_of('lower(prompt)', policy.CONSTRAINT_MARKERS)}) THEN 'CLEAR'
  WHEN {any_of('lower(prompt)', policy.TASK_VERBS)} OR {words('prompt')} >= 6 THEN 'PARTIAL'
  ELSE 'UNCLEAR' END"""

NORMALISED = f"""{strip('model_id')} AS model_id, coalesce({strip('provider')}, '') AS provider,
  lower({strip('use_case')}) AS use_case, lower({strip('prompt_complexity')}) AS prompt_complexity,
  upper({strip('clarity')}) AS clarity, {number('accuracy_score')} AS accuracy_score,
  {number('cost')} AS cost, {number('latency_ms')} AS latency_ms, {number('tokens')} AS tokens"""

SUMMARY = """count(*) AS sample_count, avg(accuracy_score) AS avg_accuracy,
  median(accuracy_score) AS median_accuracy, median(cost) AS median_cost, median(latency_ms) AS median_latency_ms"""
ORDER = "avg_accuracy DESC, sample_count DESC, median_cost, median_latency_ms, model_id, provider"
TIER = "tier, use_case, slice_complexity, slice_clarity"


def close(a: str, b: str) -> str:
    return f"abs({a} - {b}) <= 1e-9 * greatest(abs({a}), abs({b}))"


def _scaled(c: str) -> str:
    low = f"min(CASE WHEN in_shortlist THEN {c} END) OVER s"
    high = f"max(CASE WHEN in_shortlist THEN {c} END) OVER s"
    return f"CASE WHEN {close(low, high)} THEN 1e0 ELSE 1e0 - ({c} - {low}) / ({high} - {low}) END"


def ranked(source: str, keys: str) -> str:
    return f"""
SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {ORDER}) AS summary_rank,
  row_number() OVER (PARTITION BY {keys} ORDER BY value_score DESC NULLS LAST, {ORDER}) AS value_rank
FROM (SELECT *, CASE WHEN in_shortlist THEN 0.75e0 * {_scaled('median_cost')} + 0.25e0 * {_scaled('median_latency_ms')} END AS value_score
  FROM (SELECT *, avg_accuracy >= max(avg_accuracy) OVER (PARTITION BY {keys}) - 2e0 AS in_shortlist FROM {source}) a
  WINDOW s AS (PARTITION BY {keys})) b"""


def vote(keys: str, source: str) -> str:
    return f"""
SELECT {keys}, label AS clarity FROM (
  SELECT {keys}, label, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, label) AS r
  FROM (SELECT {keys}, upper({strip('clarity')}) AS label, count(*) AS n FROM {source}
        WHERE upper({strip('clarity')}) IN {names(policy.CLARITIES)} GROUP BY ALL) c) d WHERE r = 1"""


def _each_tier(source: str) -> str:
    return f"""
SELECT 0 AS tier, prompt_complexity AS slice_complexity, clarity AS slice_clarity, * FROM {source}
UNION ALL SELECT 1, prompt_complexity, '*', * FROM {source}
UNION ALL SELECT 2, '*', '*', * FROM {source}"""


DELTAS = """round(r_acc - c_acc, 2) + 0e0 AS accuracy_delta,
  CASE WHEN c_acc <> 0 THEN round((r_acc - c_acc) / c_acc * 100, 1) + 0e0 END AS accuracy_delta_pct,
  CASE WHEN c_cost <> 0 THEN round((r_cost - c_cost) / c_cost * 100, 1) + 0e0 END AS cost_delta_pct,
  CASE WHEN c_lat <> 0 THEN round((r_lat - c_lat) / c_lat * 100, 1) + 0e0 END AS latency_delta_pct"""

POLICY_REASON = f"""CASE WHEN c_acc IS NULL THEN '{policy.REASON_NO_CURRENT}'
  WHEN accuracy_delta >= 2 THEN '{policy.REASON_ACCURACY}'
  WHEN cost_delta_pct <= -15 AND accuracy_delta >= -1 THEN '{policy.REASON_COST}'
  WHEN latency_delta_pct <= -20 AND accuracy_delta >= -1 THEN '{policy.REASON_LATENCY}'
  ELSE '{policy.REASON_STAY}' END"""

# Common table expressions, in an order where each uses only earlier ones.
CTES: dict[str, str] = {v: view_sql(v, {t: t for t in TABLES}) for v in VIEWS}
CTES |= {
    "bench": f"""
SELECT * FROM (SELECT src_id, {NORMALISED} FROM bench_raw) c
WHERE model_id <> '' AND use_case <> '' AND prompt_complexity IN {names(policy.COMPLEXITIES)}
  AND clarity IN {names(policy.CLARITIES)}
  AND accuracy_score IS NOT NULL AND cost IS NOT NULL AND latency_ms IS NOT NULL""",
    "bench_loose": f"""
SELECT * FROM (SELECT src_id, {NORMALISED} FROM bench_raw) c
WHERE model_id IS NOT NULL AND use_case IS NOT NULL AND prompt_complexity IS NOT NULL
  AND clarity IS NOT NULL AND accuracy_score IS NOT NULL AND cost IS NOT NULL AND latency_ms IS NOT NULL""",
    "all_phases": """
SELECT model_id, provider, prompt_complexity, accuracy_score, cost, latency_ms, tokens FROM bench_raw
UNION ALL SELECT model_id, provider, prompt_complexity, accuracy_score, cost, latency_ms, tokens FROM bench_phase""",
    "profile_rows": f"""
SELECT * FROM (SELECT model_id, provider, lower({strip('prompt_complexity')}) AS prompt_complexity,
  {number('accuracy_score')} AS accuracy_score, {number('cost')} AS cost,
  {number('latency_ms')} AS latency_ms, {number('tokens')} AS tokens FROM all_phases) c
WHERE model_id IS NOT NULL AND prompt_complexity IS NOT NULL AND accuracy_score IS NOT NULL""",
    "profiles": """
SELECT provider, model_id, prompt_complexity, avg(accuracy_score) AS avg_accuracy, avg(cost) AS avg_cost,
  avg(latency_ms) AS avg_latency_ms, avg(tokens) AS avg_tokens, count(accuracy_score) AS sample_count,
  median(accuracy_score) AS median_accuracy, coalesce(stddev_samp(accuracy_score), 0e0) AS std_accuracy
FROM profile_rows WHERE provider IS NOT NULL GROUP BY ALL""",
    "profiles_overall": """
SELECT provider, model_id, avg(accuracy_score) AS avg_accuracy, avg(cost) AS avg_cost,
  avg(latency_ms) AS avg_latency_ms, count(accuracy_score) AS sample_count
FROM profile_rows WHERE provider IS NOT NULL GROUP BY ALL""",
    "profiles_round": """
SELECT provider, model_id, prompt_complexity, round(avg_accuracy, 2) AS avg_accuracy, round(avg_cost, 6) AS avg_cost,
  round(avg_latency_ms, 1) AS avg_latency_ms, round(avg_tokens, 1) AS avg_tokens, sample_count,
  round(median_accuracy, 2) AS median_accuracy, round(std_accuracy, 2) AS std_accuracy FROM profiles""",
    "profiles_flat": """
SELECT d.model_id, f.provider, d.prompt_complexity, d.avg_accuracy, d.avg_cost, d.avg_latency_ms, d.avg_tokens,
  d.sample_count, d.median_accuracy, d.std_accuracy
FROM (SELECT *, row_number() OVER (PARTITION BY model_id, prompt_complexity ORDER BY provider DESC) AS r FROM profiles_round) d
JOIN (SELECT model_id, min(provider) AS provider FROM profiles_overall GROUP BY model_id) f ON f.model_id = d.model_id
WHERE d.r = 1""",
    "composite": """
SELECT *, row_number() OVER (PARTITION BY prompt_complexity ORDER BY score DESC, model_id, provider) AS rank,
  row_number() OVER (PARTITION BY prompt_complexity ORDER BY score, model_id DESC, provider DESC) AS rank_from_last,
  count(*) OVER (PARTITION BY prompt_complexity) AS n
FROM (SELECT *, 0.5e0 * ((avg_accuracy - min(avg_accuracy) OVER s) / greatest(max(avg_accuracy) OVER s - min(avg_accuracy) OVER s, 1e-9))
  + 0.25e0 * (1 - (avg_cost - min(avg_cost) OVER s) / greatest(max(avg_cost) OVER s - min(avg_cost) OVER s, 1e-9))
  + 0.25e0 * (1 - (avg_latency_ms - min(avg_latency_ms) OVER s) / greatest(max(avg_latency_ms) OVER s - min(avg_latency_ms) OVER s, 1e-9)) AS score
  FROM profiles_flat WHERE sample_count >= 3 WINDOW s AS (PARTITION BY prompt_complexity)) c""",
    "means": """
SELECT use_case, prompt_complexity, model_id, min(provider) AS provider, avg(accuracy_score) AS avg_accuracy,
  avg(cost) AS avg_cost, avg(latency_ms) AS avg_latency FROM bench GROUP BY ALL""",
    "means_ranked": """
SELECT *, row_number() OVER (PARTITION BY use_case, prompt_complexity ORDER BY score DESC, model_id, provider) AS rank
FROM (SELECT *,
  0.6e0 * (CASE WHEN max(avg_accuracy) OVER s = min(avg_accuracy) OVER s THEN 1e0 ELSE (avg_accuracy - min(avg_accuracy) OVER s) / (max(avg_accuracy) OVER s - min(avg_accuracy) OVER s) END)
  + 0.3e0 * (CASE WHEN max(avg_cost) OVER s = min(avg_cost) OVER s THEN 1e0 ELSE 1 - (avg_cost - min(avg_cost) OVER s) / (max(avg_cost) OVER s - min(avg_cost) OVER s) END)
  + 0.1e0 * (CASE WHEN max(avg_latency) OVER s = min(avg_latency) OVER s THEN 1e0 ELSE 1 - (avg_latency - min(avg_latency) OVER s) / (max(avg_latency) OVER s - min(avg_latency) OVER s) END) AS score
  FROM means WINDOW s AS (PARTITION BY use_case, prompt_complexity)) c""",
    "tier_rows": _each_tier("bench"),
    "tier_summary": f"""
SELECT *, sum(sample_count) OVER (PARTITION BY {TIER}) AS slice_row_count
FROM (SELECT {TIER}, model_id, provider, {SUMMARY} FROM tier_rows GROUP BY ALL) t""",
    "supported_5": "SELECT * FROM tier_summary WHERE sample_count >= 5",
    "supported_40": "SELECT * FROM tier_summary WHERE sample_count >= 40",
    "supported_100": "SELECT * FROM tier_summary WHERE sample_count >= 100",
    "ranked_5": ranked("supported_5", TIER),
    "ranked_40": ranked("supported_40", TIER),
    "ranked_100": ranked("supported_100", TIER),
    "votes_exact": vote("use_case, prompt", "prompt_logs"),
    "votes_norm": vote(
        "use_case, normalized_prompt",
        f"(SELECT lower({strip('use_case')}) AS use_case, {norm('prompt')} AS normalized_prompt, clarity FROM prompt_logs) k",
    ),
    "signals": f"""
SELECT p.prompt_id, p.use_case, p.current_model, {COMPLEXITY.replace('prompt', 'p.prompt')} AS complexity,
  coalesce(e.clarity, n.clarity, {CLARITY.replace('prompt', 'p.prompt')}) AS clarity,
  CASE WHEN e.clarity IS NOT NULL THEN 'prompt_logs_exact' WHEN n.clarity IS NOT NULL THEN 'prompt_logs_local_exact'
       ELSE 'heuristic' END AS clarity_source
FROM prompts p
LEFT JOIN votes_exact e ON e.use_case = p.use_case AND e.prompt = p.prompt
LEFT JOIN votes_norm n ON n.use_case = p.use_case AND n.normalized_prompt = {norm('p.prompt')}""",
}


_PRICES = ", ".join(f"('{m}', {i:.9f}e0, {o:.9f}e0)" for m, (i, o) in policy.PRICES.items())
_ESTIMATE = "CASE WHEN length({0}) > 0 THEN greatest(length({0}) // 4, 1) ELSE 0 END"
CTES |= {
    "counted_tokens": f"""
SELECT *, input_tokens + output_tokens AS tokens FROM (
  SELECT *, CAST(CASE WHEN fmt <> 'messages' OR conv_id % 3 > 0 THEN conv_id % 90
      ELSE {_ESTIMATE.format('prompt')} END AS BIGINT) AS input_tokens,
    CAST(CASE WHEN fmt = 'meta' THEN turn * 31 WHEN fmt = 'nova' THEN turn * 17 WHEN fmt = 'gemini' THEN turn * 19
      WHEN conv_id % 3 = 1 THEN turn * 13 WHEN conv_id % 3 = 2 THEN turn * 11
      ELSE (length(response) + 8) // 4 END AS BIGINT) AS output_tokens
  FROM response_parts) c""",
    "priced": f"""
SELECT c.*, round(input_tokens / 1000e0 * coalesce(p.price_in, CASE fmt WHEN 'gemini' THEN 0.0001e0 ELSE 0.000002e0 END)
  + output_tokens / 1000e0 * coalesce(p.price_out, CASE fmt WHEN 'gemini' THEN 0.0004e0 ELSE 0.000002e0 END), 6) AS cost
FROM counted_tokens c LEFT JOIN (VALUES {_PRICES}) p(short_id, price_in, price_out) ON p.short_id = c.short_id""",
    "successful": f"SELECT * FROM priced WHERE {strip('response')} <> ''",
    "batched": """
SELECT prompt_id, resp_id, short_id AS model_id, tokens, batch, response FROM (
  WITH RECURSIVE ordered AS (
    SELECT prompt_id, resp_id, short_id, response, CAST(length(response) // 4 AS BIGINT) AS tokens,
      row_number() OVER (PARTITION BY prompt_id ORDER BY length(response), short_id, resp_id) AS nth FROM successful),
  fold AS (
    SELECT prompt_id, nth, tokens AS used, CAST(1 AS BIGINT) AS batch FROM ordered WHERE nth = 1
    UNION ALL
    SELECT o.prompt_id, o.nth, CASE WHEN f.used + o.tokens > 3000 THEN o.tokens ELSE f.used + o.tokens END,
      CASE WHEN f.used + o.tokens > 3000 THEN f.batch + 1 ELSE f.batch END
    FROM fold f JOIN ordered o ON o.prompt_id = f.prompt_id AND o.nth = f.nth + 1)
  SELECT o.*, f.batch FROM ordered o JOIN fold f ON f.prompt_id = o.prompt_id AND f.nth = o.nth) b""",
    "doc_chunks": """
SELECT doc_id, text, lang, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 5 + 1 AS BIGINT) AS chunk FROM documents""",
    "rated": """
SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS label, CASE toxic WHEN 1 THEN 'bad' ELSE 'good' END AS predicted FROM labels""",
    "report": """
SELECT class, support, predicted_count, hits, coalesce(hits / nullif(predicted_count, 0), 0e0) AS precision,
  coalesce(hits / nullif(support, 0), 0e0) AS recall, coalesce(2 * hits / nullif(predicted_count + support, 0), 0e0) AS f1
FROM (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (predicted = class) AS predicted_count,
    count(*) FILTER (label = class AND predicted = class) AS hits
  FROM rated, (SELECT unnest(['good', 'bad']) AS class) k GROUP BY class) c""",
    "drawn": """
SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('42:', doc_id)), doc_id) AS position,
  count(*) OVER (PARTITION BY lang) AS size FROM documents""",
    "doc_terms": f"""
SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
  FROM (SELECT doc_id, regexp_extract_all(regexp_replace(translate(lower(text), '{ACCENTED}', '{PLAIN}'), '\\p{{Mn}}+', '', 'g'), '{WORD}') AS w
        FROM documents) a) b GROUP BY ALL""",
    "vocab": """
SELECT *, row_number() OVER (ORDER BY term) - 1 AS term_index FROM (
  SELECT term, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS term_freq,
    ln((1e0 + (SELECT count(*) FROM documents)) / (1e0 + count(*))) + 1e0 AS idf
  FROM doc_terms GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= 0.95e0 * (SELECT count(*) FROM documents)
  ) v""",
}


def with_ctes(body: str) -> str:
    """Prefix ``body`` with the common table expressions it needs."""
    needed: list[str] = []
    pending = body
    for name in reversed(list(CTES)):
        if any(
            token == name
            for token in pending.replace("(", " ").replace(")", " ").replace(",", " ").split()
        ):
            needed.insert(0, name)
            pending += " " + CTES[name]
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + body


def recommend_sql(m: int) -> str:
    return f"""
SELECT prompt_id, use_case, complexity, clarity, clarity_source,
  CASE WHEN rec IS NULL THEN 'none' ELSE CASE tier WHEN 0 THEN 'exact' WHEN 1 THEN 'use_case_plus_complexity' ELSE 'use_case_only' END END AS filter_level,
  current_model, CASE WHEN rec IS NOT NULL THEN c_acc IS NOT NULL END AS current_model_found,
  rec AS recommended_model, rec_provider AS recommended_provider,
  r_acc AS expected_accuracy, r_cost AS expected_cost, r_lat AS expected_latency,
  accuracy_delta, accuracy_delta_pct, cost_delta_pct, latency_delta_pct,
  sample_size, slice_row_count, models_considered, distinct_models_considered,
  CASE WHEN rec IS NOT NULL THEN policy_reason <> '{policy.REASON_STAY}' END AS switch_recommended,
  CASE WHEN rec IS NOT NULL THEN CASE WHEN policy_reason <> '{policy.REASON_STAY}' THEN rec ELSE current_model END END AS final_suggestion_model,
  CASE WHEN rec IS NOT NULL THEN policy_reason END AS policy_reason,
  CASE WHEN rec IS NULL THEN NULL
    WHEN c_acc IS NULL THEN concat(rec_provider, '/', rec, ' is the best value option in the ', level, ' benchmark slice. ', policy_reason)
    WHEN policy_reason <> '{policy.REASON_STAY}' THEN concat('Switch from ', current_model, ' to ', rec, '. ', policy_reason)
    ELSE concat('Stay on ', current_model, '. ', policy_reason, ' The best alternative in the ', level, ' slice was ', rec_provider, '/', rec, '.') END AS reason,
  top_models,
  CASE WHEN rec IS NOT NULL AND c_acc IS NULL THEN concat('Current model ''', current_model, ''' was not found in the matched benchmark slice, so comparison deltas were skipped.') END AS warning,
  CASE WHEN rec IS NULL THEN '{policy.ERROR_NO_SLICE}' END AS error
FROM (SELECT *, {POLICY_REASON} AS policy_reason,
    CASE tier WHEN 0 THEN 'exact' WHEN 1 THEN 'use_case_plus_complexity' ELSE 'use_case_only' END AS level
  FROM (SELECT *, {DELTAS} FROM (
    SELECT g.*, t.tier, w.model_id AS rec, w.provider AS rec_provider, w.sample_count AS sample_size,
      round(w.avg_accuracy, 2) AS r_acc, round(w.median_cost, 6) AS r_cost, round(w.median_latency_ms, 1) AS r_lat,
      round(c.avg_accuracy, 2) AS c_acc, round(c.median_cost, 6) AS c_cost, round(c.median_latency_ms, 1) AS c_lat,
      CAST(w.slice_row_count AS BIGINT) AS slice_row_count, k.models_considered, k.distinct_models_considered, k.top_models
    FROM signals g
    LEFT JOIN (SELECT q.prompt_id, min(s.tier) AS tier FROM signals q JOIN supported_{m} s
        ON s.use_case = q.use_case AND s.slice_complexity IN (q.complexity, '*') AND s.slice_clarity IN (q.clarity, '*')
        GROUP BY q.prompt_id) t ON t.prompt_id = g.prompt_id
    LEFT JOIN ranked_{m} w ON w.value_rank = 1 AND w.tier = t.tier AND w.use_case = g.use_case
      AND w.slice_complexity IN (g.complexity, '*') AND w.slice_clarity IN (g.clarity, '*')
    LEFT JOIN (SELECT {TIER}, model_id, min_by(provider, summary_rank) AS provider,
        min_by(avg_accuracy, summary_rank) AS avg_accuracy, min_by(median_cost, summary_rank) AS median_cost,
        min_by(median_latency_ms, summary_rank) AS median_latency_ms FROM ranked_{m} GROUP BY ALL) c
      ON c.tier = t.tier AND c.use_case = g.use_case AND c.slice_complexity IN (g.complexity, '*')
      AND c.slice_clarity IN (g.clarity, '*') AND c.model_id = g.current_model
    LEFT JOIN (SELECT {TIER}, count(*) AS models_considered, count(DISTINCT model_id) AS distinct_models_considered,
        string_agg(CASE WHEN summary_rank <= 5 THEN concat(provider, '/', model_id) END, ' ' ORDER BY summary_rank) AS top_models
      FROM ranked_{m} GROUP BY ALL) k
      ON k.tier = t.tier AND k.use_case = g.use_case AND k.slice_complexity IN (g.complexity, '*') AND k.slice_clarity IN (g.clarity, '*')
  ) a) b) d"""


SUMMARY_COLUMNS = "sample_count, avg_accuracy, median_accuracy, median_cost, median_latency_ms"
PROFILE_COLUMNS = """provider, model_id, prompt_complexity, avg_accuracy, avg_cost, avg_latency_ms, avg_tokens,
  sample_count, median_accuracy, round(std_accuracy, 6) AS std_accuracy"""

SQL: dict[str, str] = {
    "clean_bench": "SELECT * FROM bench",
    "clean_bench_loose": "SELECT * FROM bench_loose",
    "dq_violations": f"""
SELECT count(*) AS row_count,
  count(*) FILTER (prompt_complexity IS NULL OR lower({strip('prompt_complexity')}) NOT IN {names(policy.COMPLEXITIES)}) AS bad_complexity,
  count(*) FILTER ({number('accuracy_score')} IS NULL) AS bad_score_format,
  count(*) FILTER ({number('accuracy_score')} < 0 OR {number('accuracy_score')} > 100) AS score_out_of_range
FROM bench_raw""",
    "prompt_norm": f"SELECT prompt_id, {norm('prompt')} AS normalized_prompt FROM prompts",
    "clean_logs": f"""
SELECT {norm('prompt')} AS normalized_prompt, lower({strip('use_case')}) AS use_case, upper({strip('clarity')}) AS clarity FROM prompt_logs""",
    "complexity_heuristic": f"SELECT prompt_id, {COMPLEXITY} AS complexity FROM prompts",
    "clarity_heuristic": f"SELECT prompt_id, {CLARITY} AS clarity FROM prompts",
    "clarity_vote_exact": "SELECT use_case, prompt, clarity FROM votes_exact",
    "clarity_vote_norm": "SELECT use_case, normalized_prompt, clarity FROM votes_norm",
    "signals": "SELECT prompt_id, use_case, complexity, clarity, clarity_source FROM signals",
    "model_summary": f"""
SELECT model_id, provider, {SUMMARY} FROM bench GROUP BY ALL HAVING count(*) >= 5""",
    "slice_proto": f"""
SELECT {TIER}, model_id, provider, {SUMMARY_COLUMNS}, avg_cost, avg_latency_ms,
  CAST(sum(sample_count) OVER (PARTITION BY {TIER}) AS BIGINT) AS slice_row_count
FROM (SELECT *, sum(sample_count) OVER (PARTITION BY {TIER}, model_id) AS support
  FROM (SELECT {TIER}, model_id, provider, {SUMMARY}, avg(cost) AS avg_cost, avg(latency_ms) AS avg_latency_ms
    FROM tier_loose GROUP BY ALL) u) t
WHERE support >= 40""",
    "profiles": f"SELECT {PROFILE_COLUMNS} FROM profiles",
    "profiles_overall": "SELECT * FROM profiles_overall",
    "profiles_nested": """
SELECT f.*, round(o.avg_accuracy, 2) AS overall_accuracy, round(o.avg_cost, 6) AS overall_cost,
  round(o.avg_latency_ms, 1) AS overall_latency_ms, o.sample_count AS overall_count
FROM profiles_flat f JOIN profiles_overall o ON o.model_id = f.model_id AND o.provider = f.provider""",
    "top5_by_complexity": f"""
SELECT {PROFILE_COLUMNS}, rank FROM (SELECT *, row_number() OVER (PARTITION BY prompt_complexity
  ORDER BY avg_accuracy DESC, provider, model_id) AS rank FROM profiles) p WHERE rank <= 5""",
    "options_catalog": f"""
SELECT s.model_id, s.provider, round(avg_accuracy, 2) AS avg_accuracy, round(median_cost, 6) AS median_cost,
  round(median_latency_ms, 1) AS median_latency_ms, sample_count, u.use_cases
FROM (SELECT model_id, provider, {SUMMARY} FROM bench GROUP BY ALL HAVING count(*) >= 5) s
JOIN (SELECT model_id, string_agg(use_case, ' ' ORDER BY use_case) AS use_cases
      FROM (SELECT DISTINCT model_id, use_case FROM bench) d GROUP BY model_id) u ON u.model_id = s.model_id""",
    "class_distribution": "SELECT prompt_complexity, count(*) AS row_count FROM bench GROUP BY ALL",
    "smallest_class": "SELECT min(n) AS min_class_count FROM (SELECT count(*) AS n FROM bench GROUP BY prompt_complexity) c",
    "dataset_counts": """
SELECT count(*) AS row_count, count(DISTINCT model_id) AS model_count, count(DISTINCT provider) AS provider_count FROM profile_rows""",
    "shortlist": f"SELECT {TIER}, model_id, provider, avg_accuracy, value_score FROM ranked_5 WHERE in_shortlist",
    "best_value": f"SELECT {TIER}, model_id, provider, {SUMMARY_COLUMNS}, value_score FROM ranked_5 WHERE value_rank = 1",
    "top_candidates": f"""
SELECT {TIER}, summary_rank, model_id, provider, {SUMMARY_COLUMNS} FROM ranked_40 WHERE summary_rank <= 5""",
    "composite_v1": """
SELECT prompt_complexity, rank, model_id, provider, avg_accuracy, avg_cost, avg_latency_ms, sample_count,
  round(score, 4) AS composite_score FROM composite WHERE rank <= 3""",
    "composite_v0": """
SELECT use_case, prompt_complexity, model_id, provider, avg_accuracy, avg_cost, avg_latency, round(score, 9) AS composite_score, rank FROM means_ranked""",
    "current_deltas": f"""
SELECT {TIER}, current_model, recommended_model, {DELTAS} FROM (
  SELECT c.tier, c.use_case, c.slice_complexity, c.slice_clarity, c.model_id AS current_model, w.model_id AS recommended_model,
    round(w.avg_accuracy, 2) AS r_acc, round(w.median_cost, 6) AS r_cost, round(w.median_latency_ms, 1) AS r_lat,
    round(c.avg_accuracy, 2) AS c_acc, round(c.median_cost, 6) AS c_cost, round(c.median_latency_ms, 1) AS c_lat
  FROM ranked_5 w JOIN (SELECT *, row_number() OVER (PARTITION BY {TIER}, model_id ORDER BY summary_rank) AS nth FROM ranked_5) c
    ON c.nth = 1 AND w.value_rank = 1 AND w.tier = c.tier AND w.use_case = c.use_case
    AND w.slice_complexity = c.slice_complexity AND w.slice_clarity = c.slice_clarity) a""",
    "deltas_v1": """
SELECT g.prompt_id, g.complexity, g.current_model, b.n AS all_models_count, o.model_id AS from_model,
  CASE WHEN o.model_id IS NOT NULL THEN b.model_id END AS to_model,
  round(b.avg_accuracy - o.avg_accuracy, 2) + 0e0 AS accuracy_delta, round(b.avg_cost - o.avg_cost, 6) + 0e0 AS cost_delta,
  round((b.avg_cost - o.avg_cost) / greatest(o.avg_cost, 1e-9) * 100, 1) + 0e0 AS cost_delta_pct,
  round(b.avg_latency_ms - o.avg_latency_ms, 1) + 0e0 AS latency_delta_ms,
  round((b.avg_latency_ms - o.avg_latency_ms) / greatest(o.avg_latency_ms, 1e-9) * 100, 1) + 0e0 AS latency_delta_pct
FROM (SELECT s.prompt_id, s.complexity, s.current_model, coalesce(f.model_id, l.model_id) AS old
      FROM signals s LEFT JOIN profiles_flat f ON f.prompt_complexity = s.complexity AND f.model_id = s.current_model
      LEFT JOIN composite l ON l.prompt_complexity = s.complexity AND l.rank_from_last = 1 AND l.n > 1) g
JOIN composite b ON b.prompt_complexity = g.complexity AND b.rank = 1
LEFT JOIN profiles_flat o ON o.prompt_complexity = g.complexity AND o.model_id = g.old""",
    "deltas_v0": """
SELECT g.prompt_id, g.use_case, g.complexity, g.current_model, b.model_id AS recommended_model,
  round(b.avg_accuracy - coalesce(c.avg_accuracy, 0e0), 1) + 0e0 AS accuracy_delta,
  round((b.avg_cost - coalesce(c.avg_cost, 0e0)) / greatest(coalesce(c.avg_cost, 0e0), 0.0001e0) * 100, 1) + 0e0 AS cost_delta,
  CAST(trunc(b.avg_latency - coalesce(c.avg_latency, 0e0)) AS BIGINT) AS latency_delta,
  concat(upper(substr(g.complexity, 1, 1)), substr(g.complexity, 2), '-complexity ', g.use_case, ' prompt. ', b.model_id,
    ' outperforms ', g.current_model, ' on this task type in our benchmark data.') AS reason
FROM signals g
JOIN means_ranked b ON b.use_case = g.use_case AND b.prompt_complexity = g.complexity AND b.rank = 1
LEFT JOIN means_ranked c ON c.use_case = g.use_case AND c.prompt_complexity = g.complexity AND c.model_id = g.current_model""",
}
CTES["tier_loose"] = _each_tier("bench_loose")
for _m in (5, 40, 100):
    SQL[f"slice_summary_{_m}"] = f"""
SELECT {TIER}, model_id, provider, {SUMMARY_COLUMNS}, CAST(slice_row_count AS BIGINT) AS slice_row_count FROM supported_{_m}"""
    SQL[f"recommend_{_m}"] = recommend_sql(_m)
SQL["switch_policy"] = f"""
SELECT policy_reason, count(*) AS row_count FROM (
  SELECT *, {POLICY_REASON} AS policy_reason FROM (
    SELECT c_acc, {DELTAS} FROM (
      SELECT round(w.avg_accuracy, 2) AS r_acc, round(w.median_cost, 6) AS r_cost, round(w.median_latency_ms, 1) AS r_lat,
        round(c.avg_accuracy, 2) AS c_acc, round(c.median_cost, 6) AS c_cost, round(c.median_latency_ms, 1) AS c_lat
      FROM ranked_5 w JOIN ranked_5 c ON w.value_rank = 1 AND w.tier = c.tier AND w.use_case = c.use_case
        AND w.slice_complexity = c.slice_complexity AND w.slice_clarity = c.slice_clarity) a) b) d GROUP BY ALL"""


SQL |= {
    "text_extract": "SELECT resp_id, response FROM response_parts",
    "tokens": "SELECT resp_id, input_tokens, output_tokens, tokens FROM counted_tokens",
    "cost": "SELECT resp_id, short_id, cost FROM priced",
    "failed_responses": f"""
SELECT resp_id, CAST(0 AS BIGINT) AS accuracy_score, 0e0 AS cost, CAST(0 AS BIGINT) AS tokens,
  'Model returned null/empty response' AS reason FROM response_parts WHERE {strip('response')} = ''""",
    "bench_rows": f"""
SELECT s.prompt_id, s.fmt AS provider, s.short_id AS model_id, a.prompt_complexity, 'reasoning' AS use_case, a.clarity, s.response,
  coalesce(j.accuracy_score, 0e0) AS accuracy_score, s.cost, s.tokens, s.latency_ms
FROM successful s
JOIN (SELECT prompt_id, {COMPLEXITY} AS prompt_complexity, {CLARITY} AS clarity
      FROM (SELECT conv_id AS prompt_id, max_by(text, turn) AS prompt FROM conversations GROUP BY conv_id) q) a ON a.prompt_id = s.prompt_id
LEFT JOIN (SELECT prompt_id, short_id, CAST(max(length(response) % 101) AS DOUBLE) AS accuracy_score
           FROM priced GROUP BY ALL) j ON j.prompt_id = s.prompt_id AND j.short_id = s.short_id""",
    "allowed_models": f"""
SELECT r.use_case, r.short_id, r.resp_id FROM (SELECT resp_id, short_id, CASE WHEN turn < 3 THEN 'text-generation' WHEN turn < 5 THEN 'code-generation'
  ELSE 'reasoning' END AS use_case FROM response_parts) r
WHERE {" OR ".join(f"(use_case = '{u}' AND short_id IN {names(m)})" for u, m in policy.USE_CASE_MODELS.items())}""",
    "use_case_default": "SELECT prompt_id, 'text-generation' AS from_model, use_case AS from_use_case FROM prompts",
    "request_errors": """
SELECT doc_id, CASE lang WHEN 'es' THEN 'poetry' ELSE 'reasoning' END AS use_case,
  CASE lang WHEN 'fr' THEN 'extreme' ELSE 'low' END AS complexity_override,
  CASE lang WHEN 'de' THEN NULL ELSE 'CLEAR' END AS clarity_override,
  CASE lang WHEN 'es' THEN 'Unsupported use_case ''poetry''.' WHEN 'fr' THEN 'Unsupported complexity ''extreme''.' END AS error
FROM documents""",
    "token_batches": "SELECT prompt_id, resp_id, model_id, tokens, batch FROM batched",
    "judge_requests": """
SELECT r.prompt_id, r.batch, r.response_count, concat('Score each response.', chr(10), chr(10), 'USER-SELECTED USE CASE:', chr(10), 'reasoning',
  chr(10), chr(10), 'PROMPT:', chr(10), q.text, chr(10), chr(10), 'MODEL RESPONSES (', r.response_count, ' total):', chr(10), chr(10), r.body) AS request
FROM (SELECT prompt_id, batch, count(*) AS response_count,
    string_agg(concat('[Response ', nth, '] model_id: ', model_id, chr(10), response),
      concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY nth) AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, batch ORDER BY tokens, model_id, resp_id) AS nth FROM batched) n
  GROUP BY prompt_id, batch) r
JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0) q ON q.conv_id = r.prompt_id""",
    "judge_messages": """
SELECT prompt_id, batch, part, substr(request, CAST(part * 1000 + 1 AS BIGINT), 1000) AS text FROM (
  SELECT *, unnest(range((length(request) + 999) // 1000)) AS part FROM (
    SELECT r.prompt_id, r.batch, concat('Score each response.', chr(10), chr(10), 'USER-SELECTED USE CASE:', chr(10), 'reasoning',
      chr(10), chr(10), 'PROMPT:', chr(10), coalesce(q.text, ''), chr(10), chr(10), 'MODEL RESPONSES (', r.response_count, ' total):', chr(10), chr(10), r.body) AS request
    FROM (SELECT prompt_id, batch, count(*) AS response_count,
        string_agg(concat('[Response ', nth, '] model_id: ', model_id, chr(10), response),
          concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY nth) AS body
      FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, batch ORDER BY tokens, model_id, resp_id) AS nth FROM batched) n
      GROUP BY prompt_id, batch) r
    LEFT JOIN (SELECT conv_id, min_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id) q ON q.conv_id = r.prompt_id) w) p""",
    "chunks": "SELECT prompt_id, CAST((row_number() OVER (ORDER BY prompt_id) - 1) // 5 + 1 AS BIGINT) AS chunk FROM prompts",
    "chunks_relabel": "SELECT prompt_id, CAST((row_number() OVER (ORDER BY prompt_id) - 1) // 12 + 1 AS BIGINT) AS chunk FROM prompts",
    "label_requests": """
SELECT chunk, concat('Classify the prompts.', chr(10), chr(10), string_agg(concat('prompt_id: "', doc_id, '"', chr(10), 'lang: "', lang, '"',
  chr(10), 'prompt: ', repeat('"', 3), text, repeat('"', 3)), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY doc_id)) AS request
FROM doc_chunks GROUP BY chunk""",
    "judge_merge": """
SELECT batch_id, model_id, CAST(CASE batch_id % 7
  WHEN 0 THEN CASE which WHEN 'a' THEN s ELSE 77 END WHEN 1 THEN CASE which WHEN 'a' THEN s ELSE 12 END
  WHEN 2 THEN CASE which WHEN 'a' THEN s ELSE 50 END WHEN 3 THEN 0 WHEN 4 THEN 50
  WHEN 5 THEN CASE which WHEN 'a' THEN s ELSE 8 END
  ELSE CASE which WHEN 'a' THEN 5 ELSE 0 END END AS DOUBLE) AS accuracy_score
FROM (SELECT batch_id, 'a' AS which, model_a AS model_id, 50 + batch_id % 50 AS s FROM judge_outputs
      UNION ALL SELECT batch_id, 'b', model_b, 50 + batch_id % 50 FROM judge_outputs) j""",
    "judge_merge_prompts": """
SELECT * FROM (WITH entries AS (
  SELECT batch_id, batch_id % 19 AS prompt_id, model_a AS model_id, 1 AS pos,
    CASE batch_id % 7 WHEN 3 THEN 0 WHEN 4 THEN 50 WHEN 6 THEN 5 ELSE 50 + batch_id % 50 END AS score FROM judge_outputs
  UNION ALL
  SELECT batch_id, batch_id % 19, model_b, 2,
    CASE batch_id % 7 WHEN 0 THEN 77 WHEN 1 THEN 12 WHEN 2 THEN 50 WHEN 3 THEN 0 WHEN 4 THEN 50 WHEN 5 THEN 8 END FROM judge_outputs)
SELECT prompt_id, model_id, CAST(coalesce(last(score ORDER BY batch_id, pos) FILTER (score IS NOT NULL), 0) AS DOUBLE) AS accuracy_score
FROM entries GROUP BY prompt_id, model_id) x""",
    "label_missing": """
SELECT * FROM (WITH missing AS (
  SELECT e.chunk, e.doc_id, row_number() OVER (PARTITION BY e.chunk ORDER BY e.doc_id) AS place, count(*) OVER (PARTITION BY e.chunk) AS n
  FROM doc_chunks e WHERE NOT EXISTS (
    SELECT 1 FROM label_returns l JOIN doc_chunks c ON c.doc_id = l.sent_id WHERE c.chunk = e.chunk AND l.prompt_id = e.doc_id)),
listed AS (
  SELECT chunk, any_value(n) AS missing_count, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (place <= 3) AS missing_ids
  FROM missing GROUP BY chunk)
SELECT *, concat('Missing clarity labels for prompt_ids: ', replace(missing_ids, ',', ', '), CASE WHEN missing_count > 3 THEN ', ...' ELSE '' END) AS error
FROM listed) x""",
    "label_errors": f"""
SELECT e.chunk, e.expected_count, coalesce(r.returned_count, 0) AS returned_count, e.expected_count - coalesce(r.matched, 0) AS missing_count,
  CASE WHEN e.expected_count <> coalesce(r.returned_count, 0)
    THEN concat('Expected ', e.expected_count, ' clarity labels, got ', coalesce(r.returned_count, 0)) ELSE r.problem END AS error
FROM (SELECT chunk, count(*) AS expected_count FROM doc_chunks GROUP BY chunk) e
LEFT JOIN (SELECT chunk, count(*) AS returned_count, count(*) FILTER (is_known) AS matched,
    first(CASE WHEN NOT is_known THEN concat('Unexpected prompt_id returned: ', prompt_id)
               ELSE concat('Invalid clarity label returned: ', label) END ORDER BY sent_id)
      FILTER (NOT is_known OR label NOT IN {names(policy.CLARITIES)}) AS problem
  FROM (SELECT c.chunk, l.sent_id, l.prompt_id, upper(l.clarity) AS label, k.doc_id IS NOT NULL AS is_known FROM label_returns l
        JOIN doc_chunks c ON c.doc_id = l.sent_id LEFT JOIN doc_chunks k ON k.doc_id = l.prompt_id AND k.chunk = c.chunk) x
  GROUP BY chunk) r ON r.chunk = e.chunk""",
    "label_attach": """
SELECT d.doc_id AS prompt_id, d.text, upper(l.clarity) AS clarity FROM documents d JOIN label_returns l ON l.prompt_id = d.doc_id""",
    "pending": f"""
SELECT p.prompt_id, p.use_case FROM prompts p WHERE NOT EXISTS (
  SELECT 1 FROM labelled l WHERE {strip('l.prompt')} = p.prompt AND l.use_case = p.use_case)""",
    "pending_first": f"""
SELECT p.prompt_id, p.use_case FROM prompts p WHERE NOT EXISTS (
  SELECT 1 FROM labelled l WHERE {strip('l.prompt')} = p.prompt AND l.use_case = p.use_case) ORDER BY p.prompt_id LIMIT 100""",
    "labeller": "SELECT prompt_id, CASE WHEN length(prompt) > 500 THEN 'CLEAR' ELSE 'PARTIAL' END AS clarity FROM prompts",
    "enriched_prompts": f"""
SELECT prompt_id, concat(prompt, chr(10), chr(10), '[Prompt complexity: ', {COMPLEXITY}, ' | Prompt quality: ', prompt_id % 101, '/100]') AS enriched
FROM prompts""",
    "ingest_report": f"""
SELECT *, CASE WHEN bad_clarity_count > 0 THEN 'rejected' WHEN prompt_count = 0 THEN 'empty' ELSE 'accepted' END AS status FROM (
  SELECT file_name, count(*) AS row_count, count(*) FILTER (kept) AS prompt_count, count(*) FILTER (kept AND NOT known) AS bad_clarity_count
  FROM (SELECT file_name, coalesce({strip('prompt')}, '') <> '' AS kept,
      upper({strip('clarity')}) IN {names(policy.CLARITIES)} AS known FROM prompt_files) f GROUP BY file_name) g""",
    "ingest_total": f"""
SELECT count(*) AS file_count, count(*) FILTER (prompt_count > 0) AS used_count, CAST(coalesce(sum(prompt_count), 0) AS BIGINT) AS total_prompts,
  CAST(coalesce(sum(bad_clarity_count), 0) AS BIGINT) AS bad_clarity_count,
  CASE WHEN coalesce(sum(bad_clarity_count), 0) > 0 THEN 'rejected' WHEN coalesce(sum(prompt_count), 0) = 0 THEN 'empty' ELSE 'accepted' END AS status
FROM (
  SELECT file_name, count(*) FILTER (kept) AS prompt_count, count(*) FILTER (kept AND NOT known) AS bad_clarity_count
  FROM (SELECT file_name, coalesce({strip('prompt')}, '') <> '' AS kept,
      upper({strip('clarity')}) IN {names(policy.CLARITIES)} AS known FROM prompt_files) f GROUP BY file_name) g""",
    "benchmark_csv": """
SELECT CAST(doc_id AS VARCHAR) AS id, concat('m', doc_id % 26) AS model_id, concat('"', text, ' ') AS response,
  CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS VARCHAR) END AS tokens, CAST(NULL AS VARCHAR) AS provider FROM documents""",
    "models_used": f"""
SELECT r.short_id, m.source, m.model_id, count(*) AS row_count FROM response_parts r
JOIN (VALUES {", ".join(f"('{m}', '{'vertex' if f == 'gemini' else 'bedrock'}', '{'profile/' * (f == 'meta')}{policy.MODEL_IDS[m]}')" for m, _, f in policy.MODELS)}) m(short_id, source, model_id)
  ON m.short_id = r.short_id GROUP BY ALL""",
    "ingest_prompts": f"""
SELECT file_name, row_pos, {strip('prompt')} AS prompt, upper({strip('clarity')}) AS clarity, 'mid' AS prompt_complexity, 'reasoning' AS use_case
FROM prompt_files WHERE coalesce({strip('prompt')}, '') <> '' AND file_name NOT IN (
  SELECT file_name FROM prompt_files WHERE coalesce({strip('prompt')}, '') <> '' AND upper({strip('clarity')}) NOT IN {names(policy.CLARITIES)})""",
    "clarity_input": f"""
SELECT file_name, CAST(n AS VARCHAR) AS prompt_id, {strip('prompt')} AS prompt
FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY row_pos) AS n FROM prompt_files) f
WHERE coalesce({strip('prompt')}, '') <> ''""",
    "relabel_input": f"""
SELECT CAST(prompt_id AS VARCHAR) AS prompt_id, {strip('prompt')} AS prompt, use_case, 'CLEAR' AS clarity, 'high' AS old_prompt_complexity
FROM prompts WHERE current_model <> 'absent-model' AND {strip('prompt')} <> ''""",
    "distinct_prompts": f"""
SELECT DISTINCT {strip('text')} AS prompt, CASE lang WHEN 'en' THEN 'low' ELSE 'mid' END AS prompt_complexity
FROM documents WHERE lang IN ('en', 'de') AND {strip('text')} <> ''""",
    "source_fallback": """
SELECT use_case, CASE use_case WHEN 'reasoning' THEN 'primary' ELSE 'local_csv' END AS data_source, count(*) AS row_count FROM bench GROUP BY ALL""",
    "scan_filtered": """
SELECT src_id, model_id, accuracy_score FROM bench WHERE use_case = 'reasoning' AND prompt_complexity = 'mid' AND clarity = 'CLEAR'""",
    "logs_filtered": f"""
SELECT prompt, use_case, upper({strip('clarity')}) AS clarity FROM prompt_logs WHERE use_case = 'reasoning'""",
    "provider_checks": """
SELECT fmt AS source, count(*) FILTER (response <> '') AS passed, count(*) AS total FROM response_parts GROUP BY fmt""",
    "provider_order": f"""
SELECT provider, row_count, CAST(coalesce(list_position([{", ".join(f"'{p}'" for p in policy.PROVIDER_ORDER)}], provider) - 1, 99) AS BIGINT) AS provider_rank
FROM (SELECT m.provider, count(*) AS row_count FROM response_parts r
  LEFT JOIN (VALUES {", ".join(f"('{m}', '{p}')" for m, p, _ in policy.MODELS)}) m(short_id, provider) ON m.short_id = r.short_id GROUP BY ALL) c""",
    "catalog_by_use_case": """
SELECT s.model_id, s.provider, s.sample_count FROM (SELECT model_id, provider, count(*) AS sample_count FROM bench GROUP BY ALL HAVING count(*) >= 5) s
WHERE s.model_id IN (SELECT model_id FROM bench WHERE use_case = 'reasoning')""",
    "benchmark_written": "SELECT * FROM bench",
    "logs_written": f"""
SELECT prompt, lower({strip('use_case')}) AS use_case, upper({strip('clarity')}) AS clarity FROM prompt_logs
WHERE prompt IS NOT NULL AND use_case IS NOT NULL AND clarity IS NOT NULL""",
    "chunks_written": """
SELECT chunk, concat(' ', text, chr(10), '"') AS prompt, CASE lang WHEN 'en' THEN 'CLEAR' ELSE 'PARTIAL' END AS clarity FROM doc_chunks""",
    "profiles_written": "SELECT * FROM profiles_flat",
    "relabelled_written": f"""
SELECT prompt, use_case, {COMPLEXITY} AS prompt_complexity, {CLARITY} AS clarity, 'mid' AS old_prompt_complexity,
  concat('words and markers: ', {COMPLEXITY}) AS complexity_reason, 'rules:1' AS label_source FROM prompts""",
    "prompt_csv": """
SELECT CAST(doc_id AS VARCHAR) AS id, concat(' ', text, chr(13), chr(10), '"') AS prompt, CASE lang WHEN 'en' THEN 'clear' ELSE 'partial' END AS clarity,
  CASE WHEN doc_id % 2 <> 0 THEN source END AS source FROM documents""",
    "tfidf_vocabulary": "SELECT term, doc_freq, term_freq, round(idf, 9) AS idf, term_index FROM vocab",
    "tfidf_weights": """
SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight
FROM (SELECT t.doc_id, t.term, (ln(CAST(t.tf AS DOUBLE)) + 1e0) * v.idf AS raw FROM doc_terms t JOIN vocab v ON v.term = t.term) r""",
    "fold_vocabularies": """
SELECT *, row_number() OVER (PARTITION BY fold ORDER BY term) - 1 AS term_index FROM (
  SELECT f.fold, t.term, count(*) AS doc_freq, CAST(sum(t.tf) AS BIGINT) AS term_freq,
    round(ln((1e0 + any_value(f.documents)) / (1e0 + count(*))) + 1e0, 9) AS idf
  FROM doc_terms t
  JOIN (SELECT doc_id, (position - 1) % 5 AS fold FROM drawn) d ON d.doc_id = t.doc_id
  JOIN (SELECT k.fold, count(*) AS documents FROM (SELECT unnest(range(5)) AS fold) k
        JOIN (SELECT (position - 1) % 5 AS fold FROM drawn) o ON o.fold <> k.fold GROUP BY k.fold) f ON f.fold <> d.fold
  GROUP BY f.fold, t.term HAVING count(*) >= 2 AND count(*) <= 0.95e0 * any_value(f.documents)) v""",
    "linear_scores": """
SELECT doc_id, first(class ORDER BY score DESC, class) AS predicted, round(1e0 / sum(exp(score - top)), 6) AS confidence
FROM (
  SELECT d.doc_id, k.class, ln(k.n / CAST(k.total AS DOUBLE)) + coalesce(s.score, 0e0) AS score,
    max(ln(k.n / CAST(k.total AS DOUBLE)) + coalesce(s.score, 0e0)) OVER (PARTITION BY d.doc_id) AS top
  FROM documents d
  JOIN (SELECT lang AS class, count(*) AS n, (SELECT count(*) FROM documents) AS total FROM documents GROUP BY lang) k ON true
  LEFT JOIN (
    SELECT w.doc_id, c.class, sum(w.weight * ln(c.n + 1e0)) AS score
    FROM (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight
          FROM (SELECT t.doc_id, t.term, (ln(CAST(t.tf AS DOUBLE)) + 1e0) * v.idf AS raw FROM doc_terms t JOIN vocab v ON v.term = t.term) r) w
    JOIN (SELECT t.term, o.lang AS class, count(*) AS n FROM doc_terms t JOIN documents o ON o.doc_id = t.doc_id GROUP BY ALL) c ON c.term = w.term
    GROUP BY ALL) s ON s.doc_id = d.doc_id AND s.class = k.class) x
GROUP BY doc_id""",
    "confusion": "SELECT label, predicted, count(*) AS row_count FROM rated GROUP BY ALL",
    "class_report": "SELECT * FROM report",
    "overall_report": """
SELECT CAST(sum(support) AS BIGINT) AS row_count, sum(hits) / sum(support) AS accuracy, sum(f1 * support) / sum(support) AS weighted_f1 FROM report""",
    "stratified_folds": "SELECT doc_id, lang, (position - 1) % 5 AS fold FROM drawn",
    "stratified_split": """
SELECT doc_id, lang, position <= round(size * 0.1e0) AS is_validation, dense_rank() OVER (ORDER BY lang) - 1 AS label_index FROM drawn""",
    "job_progress": """
SELECT *, coalesce(CAST(round(current * 100e0 / total) AS BIGINT), 0) AS percent FROM (
  SELECT job_id, last(CASE type WHEN 'progress' THEN prompt_index ELSE processed_prompts END ORDER BY ts, event_id)
      FILTER (type IN ('progress', 'file_started', 'file_done', 'file_delay')) AS current,
    last(total ORDER BY ts, event_id) FILTER (type IN ('progress', 'file_started', 'file_done', 'file_delay')) AS total,
    count(*) FILTER (type = 'progress') AS result_count, count(*) FILTER (type = 'model_failed') AS failed_count
  FROM job_events GROUP BY job_id) j""",
    "job_status": """
SELECT job_id, coalesce(first(type ORDER BY ts, event_id) FILTER (type IN ('done', 'error')), 'running') AS status, count(*) AS event_count
FROM job_events GROUP BY job_id""",
    "job_failures": "SELECT event_id, job_id, model_id, prompt_index FROM job_events WHERE type = 'model_failed'",
    "file_lifecycle": """
SELECT job_id, file_index, CASE last(type ORDER BY ts, event_id) WHEN 'file_started' THEN 'processing' WHEN 'file_done' THEN 'completed' ELSE 'waiting' END AS status,
  last(processed_prompts ORDER BY ts, event_id) AS processed_prompts, last(total ORDER BY ts, event_id) AS total,
  last(delay_ms ORDER BY ts, event_id) AS delay_ms, last(next_file_index ORDER BY ts, event_id) AS next_file_index,
  last(file_name ORDER BY ts, event_id) FILTER (file_name IS NOT NULL) AS file_name,
  last(total_files ORDER BY ts, event_id) FILTER (total_files IS NOT NULL) AS total_files
FROM job_events WHERE type IN ('file_started', 'file_done', 'file_delay') GROUP BY job_id, file_index""",
    "chunk_lifecycle": """
SELECT job_id, chunk_index, CASE last(type ORDER BY ts, event_id) WHEN 'chunk_ready' THEN 'ready' WHEN 'chunk_forwarding' THEN 'forwarding'
    WHEN 'chunk_forwarded' THEN 'forwarded' ELSE 'failed' END AS status, count(*) FILTER (type = 'chunk_ready') AS ready_count,
  last(file_name ORDER BY ts, event_id) FILTER (file_name IS NOT NULL) AS file_name,
  last(chunk_size ORDER BY ts, event_id) FILTER (chunk_size IS NOT NULL) AS chunk_size,
  last(forward_status ORDER BY ts, event_id) FILTER (forward_status IS NOT NULL) AS forward_status,
  last(training_job_id ORDER BY ts, event_id) FILTER (training_job_id IS NOT NULL) AS training_job_id,
  last(message ORDER BY ts, event_id) FILTER (message IS NOT NULL) AS message
FROM job_events WHERE type LIKE 'chunk%' GROUP BY job_id, chunk_index""",
    "job_starts": """
SELECT job_id, first(total ORDER BY ts, event_id) AS total, first(total_chunks ORDER BY ts, event_id) AS total_chunks,
  first(auto_forward ORDER BY ts, event_id) AS auto_forward, first(prompt_complexity ORDER BY ts, event_id) AS prompt_complexity,
  first(use_case ORDER BY ts, event_id) AS use_case
FROM job_events WHERE type = 'started' GROUP BY job_id""",
    "events_until_end": """
SELECT e.event_id, e.job_id, e.type FROM job_events e
LEFT JOIN (SELECT job_id, first(ts ORDER BY ts, event_id) AS end_ts, first(event_id ORDER BY ts, event_id) AS end_id
           FROM job_events WHERE type IN ('done', 'error') GROUP BY job_id) t ON t.job_id = e.job_id
WHERE t.end_ts IS NULL OR e.ts < t.end_ts OR (e.ts = t.end_ts AND e.event_id <= t.end_id)""",
    "events_by_complexity": "SELECT event_id, job_id, type FROM job_events WHERE prompt_complexity = 'mid'",
    "chunks_forwarded": """
SELECT d.doc_id, CASE d.lang WHEN 'en' THEN 'CLEAR' ELSE 'PARTIAL' END AS clarity, concat('m', CAST(d.doc_id % 26 AS VARCHAR)) AS model_id,
  CAST(l.quality * 100 AS DOUBLE) AS accuracy_score
FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
WHERE d.lang IS DISTINCT FROM 'fr' AND regexp_matches(d.text, '\\S')""",
}
# A stream that takes the same events in deliveries, with repeated and late ones, gives the same rows.
SQL |= {f"{name}_bounded": SQL[name] for name in ("job_progress", "job_status", "file_lifecycle", "chunk_lifecycle")}
SQL["linear_report"] = f"""
SELECT class, support, predicted_count, hits, coalesce(hits / nullif(predicted_count, 0), 0e0) AS precision,
  coalesce(hits / nullif(support, 0), 0e0) AS recall, coalesce(2 * hits / nullif(predicted_count + support, 0), 0e0) AS f1
FROM (
  SELECT class, count(*) FILTER (lang = class) AS support, count(*) FILTER (predicted = class) AS predicted_count,
    count(*) FILTER (lang = class AND predicted = class) AS hits
  FROM (SELECT d.lang, p.predicted FROM documents d JOIN ({SQL["linear_scores"]}) p ON p.doc_id = d.doc_id) s
  JOIN (SELECT DISTINCT lang AS class FROM documents) k ON true GROUP BY class) c"""
SQL["requests_without_data"] = f"""
SELECT prompt_id, use_case, CAST(NULL AS VARCHAR) AS recommended_model, '{policy.ERROR_NO_DATA}' AS error FROM prompts
WHERE use_case = 'reasoning'"""
SQL["bench_rows_asked"] = SQL["bench_rows"].replace(
    "max_by(text, turn) AS prompt FROM conversations", "min_by(text, turn) AS prompt FROM conversations WHERE role = 'user'"
)
SQL["answers_resumed"] = SQL["labeller"]
SQL["scan_stored"] = SQL["scan_filtered"]
SQL["events_until_end_stream"] = SQL["events_until_end"]


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(body) for name, body in SQL.items()}
