"""Views that give the generated test tables the shapes of benchmark data.

Each view is plain SQL over the given tables and other views, and reads whole
tables and whole texts. The same text runs in Spark and in a checking engine.
``{name}`` stands for a table or view.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchsieve import policy
from benchsieve.functions.columns import spread_scan

TABLES = (
    "lineitem",
    "orders",
    "events",
    "documents",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

LEADS = (
    "Explain ", "fix this ", "Write code in Python ", "Design a system ", "Summarize ", "",
    "Optimize ", "something ", "Calculate step by step ", "Multi-tenant ", "hello ", "Compare ",
)


def _choose(key: str, values: tuple[str, ...], otherwise: str | None = None) -> str:
    """A CASE that picks a value by ``key`` modulo the number of values."""
    size = len(values) + (otherwise is not None)
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1] if otherwise is None else values))
    last = values[-1] if otherwise is None else otherwise
    return f"CASE {key} % {size} {cases} ELSE '{last}' END"



VIEWS = {
    "bench_raw": r"""
SELECT l_orderkey * 10 + l_linenumber AS src_id,
  CASE WHEN l_orderkey % 89 = 0 THEN '' ELSE concat(' m', CAST(l_suppkey % 26 AS STRING), ' ') END AS model_id,
  CASE WHEN l_orderkey % 83 = 0 THEN NULL WHEN l_orderkey % 10 = 0 THEN 'alt'
       ELSE concat('p', CAST((l_suppkey % 26) % 6 AS STRING)) END AS provider,
  CASE l_returnflag WHEN 'A' THEN 'Text-Generation ' WHEN 'N' THEN 'code-generation' ELSE ' reasoning' END AS use_case,
  CASE WHEN l_orderkey % 79 = 0 THEN 'extreme' WHEN l_quantity <= 5 THEN 'LOW'
       WHEN l_quantity <= 20 THEN 'mid ' ELSE 'high' END AS prompt_complexity,
  CASE WHEN l_linenumber <= 3 THEN 'clear' WHEN l_linenumber <= 6 THEN ' PARTIAL' ELSE 'Unclear' END AS clarity,
  CASE WHEN l_orderkey % 97 = 0 THEN 'n/a'
       ELSE CAST(60 + (l_suppkey % 26) + (l_partkey % 11) - (l_linenumber % 9) AS STRING) END AS accuracy_score,
  CASE WHEN l_orderkey % 101 = 0 THEN NULL
       ELSE concat(CAST(CAST(floor(l_extendedprice) AS BIGINT) * (1 + (l_suppkey % 26) % 4) AS STRING), '.25') END AS cost,
  CAST(CAST(l_quantity AS INT) * 100 * (1 + (l_suppkey % 26) % 5) AS STRING) AS latency_ms,
  CAST(l_partkey % 2000 AS STRING) AS tokens
FROM {lineitem}""",
    # A second phase of benchmark rows, without use case and clarity.
    "bench_phase": r"""
SELECT concat('m', CAST(o_custkey % 26 AS STRING)) AS model_id,
  CASE o_orderstatus WHEN 'P' THEN NULL ELSE concat('p', CAST((o_custkey % 26) % 6 AS STRING)) END AS provider,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN ' high' WHEN '3-MEDIUM' THEN 'mid'
       WHEN '5-LOW' THEN 'low' ELSE NULL END AS prompt_complexity,
  CAST(50 + o_orderkey % 50 AS STRING) AS accuracy_score,
  concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '.5') AS cost,
  CASE o_orderstatus WHEN 'O' THEN '-' ELSE CAST(100 + o_custkey % 900 AS STRING) END AS latency_ms,
  CAST(o_orderkey % 700 AS STRING) AS tokens
FROM {orders}""",
    "prompts": f"""
SELECT prompt_id, concat({_choose('k', LEADS)}, text) AS prompt,
  {_choose('k', policy.USE_CASES)} AS use_case,
  CASE WHEN k % 17 = 0 THEN 'absent-model' ELSE concat('m', CAST(k % 26 AS STRING)) END AS current_model
FROM (
  SELECT doc_id * 2 AS prompt_id, doc_id AS k, text FROM {{documents}}
  UNION ALL
  SELECT (conv_id * 1000 + turn) * 2 + 1 AS prompt_id, conv_id + turn AS k, text
  FROM {{conversations}} WHERE role = 'user'
) q""",
    # Two raters on labelled documents, one rater on conversation prompts.
    "prompt_logs": r"""
SELECT p.prompt, p.use_case, CASE l.quality WHEN 1 THEN 'clear' ELSE 'UNCLEAR' END AS clarity
FROM {prompts} p JOIN {labels} l ON p.prompt_id = l.doc_id * 2
UNION ALL
SELECT concat('  ', translate(p.prompt, 'abcde', 'ABCDE'), ' ') AS prompt, p.use_case,
  CASE l.toxic WHEN 1 THEN 'bogus' ELSE ' Partial' END AS clarity
FROM {prompts} p JOIN {labels} l ON p.prompt_id = l.doc_id * 2
UNION ALL
SELECT concat('  ', translate(p.prompt, 'abcde', 'ABCDE'), ' ') AS prompt, p.use_case,
  CASE (c.conv_id + c.turn) % 4 WHEN 0 THEN 'clear' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'UNCLEAR' ELSE 'bogus' END AS clarity
FROM {prompts} p JOIN {conversations} c ON p.prompt_id = (c.conv_id * 1000 + c.turn) * 2 + 1""",
    "job_events": r"""
SELECT j.*,
  CASE WHEN type IN ('file_started', 'file_done') OR type LIKE 'chunk%' THEN concat('part-', CAST(file_index AS STRING), '.csv') END AS file_name,
  CASE WHEN type IN ('file_started', 'file_done') THEN CAST(4 AS BIGINT) END AS total_files,
  CASE WHEN type = 'file_delay' THEN event_id % 2000 END AS delay_ms,
  CASE WHEN type = 'file_delay' THEN file_index + 1 END AS next_file_index,
  CASE WHEN type = 'chunk_ready' THEN event_id % 25 + 1 END AS chunk_size,
  CASE type WHEN 'chunk_ready' THEN CASE WHEN event_id % 8 = 0 THEN 'manual_only' ELSE 'pending' END
       WHEN 'chunk_forwarded' THEN 'forwarded' WHEN 'chunk_forward_failed' THEN 'failed' END AS forward_status,
  CASE WHEN type = 'chunk_forwarded' THEN concat('run-', CAST(event_id AS STRING)) END AS training_job_id,
  CASE WHEN type IN ('chunk_forward_failed', 'error') THEN concat('failed at ', CAST(event_id AS STRING)) END AS message,
  CASE WHEN type = 'started' THEN event_id % 9 + 1 END AS total_chunks,
  CASE WHEN type = 'started' THEN event_id % 2 = 0 END AS auto_forward,
  CASE WHEN type = 'started' THEN 'reasoning' END AS use_case
FROM (SELECT event_id, ts, concat('job-', CAST(user_id AS STRING)) AS job_id,
  CASE WHEN event_type = 'view' AND value > 150 THEN 'done'
       WHEN event_type = 'click' AND value > 200 THEN 'error'
       WHEN event_type = 'error' THEN 'model_failed'
       WHEN event_type = 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'file_started' WHEN 1 THEN 'file_done' ELSE 'file_delay' END
       WHEN event_type = 'purchase' THEN CASE event_id % 5 WHEN 0 THEN 'chunk_ready' WHEN 1 THEN 'chunk_forwarding'
            WHEN 2 THEN 'chunk_forwarded' WHEN 3 THEN 'chunk_forward_failed' ELSE 'started' END
       ELSE 'progress' END AS type,
  CAST(event_id % 50 + 1 AS BIGINT) AS prompt_index, CAST(50 AS BIGINT) AS total,
  concat('m', CAST(event_id % 26 AS STRING)) AS model_id,
  CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS prompt_complexity,
  value AS cost,
  CAST(event_id % 4 + 1 AS BIGINT) AS file_index,
  CAST(event_id % 7 + 1 AS BIGINT) AS chunk_index,
  CAST(event_id % 50 AS BIGINT) AS processed_prompts
FROM {events}) j""",
    # Assistant turns as model responses; the prompt is the turn before. Empty responses are added.
    "response_parts": f"""
SELECT resp_id, conv_id AS prompt_id, conv_id, turn,
  {_choose('(conv_id + turn)', tuple(m[0] for m in policy.MODELS), 'unlisted-model')} AS short_id,
  {_choose('(conv_id + turn)', tuple(m[2] for m in policy.MODELS), 'messages')} AS fmt,
  prompt, response, CAST(100 + turn * 37 AS BIGINT) AS latency_ms
FROM (
  SELECT (a.conv_id * 1000 + a.turn) * 2 AS resp_id, a.conv_id, a.turn, coalesce(u.text, '') AS prompt, a.text AS response
  FROM {{conversations}} a
  LEFT JOIN {{conversations}} u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'
  WHERE a.role = 'assistant'
  UNION ALL
  SELECT (conv_id * 1000 + turn) * 2 + 1 AS resp_id, conv_id, turn, '' AS prompt, '' AS response
  FROM {{conversations}} WHERE role = 'assistant' AND conv_id % 13 = 0
) q""",
    "judge_outputs": r"""
SELECT batch_id, model_a, model_b,
 CASE batch_id % 7
  WHEN 0 THEN concat('[{left}"model_id":"', model_a, '","accuracy_score":', s, '{right},{left}"model_id":"', model_b, '","accuracy_score":77{right}]')
  WHEN 1 THEN concat('```json', chr(10), '[{left}"model_id":"', model_a, '","accuracy_score":', s, '{right},{left}"model_id":"', model_b, '","accuracy_score":12{right}]', chr(10), '```')
  WHEN 2 THEN concat('[{left}"model_id":"', model_a, '","accuracy_score":', s, '{right}]')
  WHEN 3 THEN 'not json'
  WHEN 4 THEN concat('{left}"model_id":"', model_a, '","accuracy_score":', s, '{right}')
  WHEN 5 THEN concat('[{left}"model_id":"', model_a, '","accuracy_score":', s, '{right},{left}"model_id":"', model_b, '","accuracy_score":8{right},{left}"model_id":"', model_a, '","accuracy_score":3{right}]')
  ELSE concat('[{left}"model_id":"', model_a, '","accuracy_score":', s, '{right},{left}"model_id":"', model_a, '","accuracy_score":5{right},{left}"model_id":"', model_b, '","accuracy_score":9{right}]') END AS judge_text
FROM (SELECT conv_id AS batch_id, concat('m', CAST(conv_id % 26 AS STRING)) AS model_a,
        concat('m', CAST((conv_id + 7) % 26 AS STRING)) AS model_b, CAST(50 + conv_id % 50 AS STRING) AS s
      FROM {conversations} GROUP BY conv_id) q""",
    # Labels that came back for the documents; short ones and one source under unknown ids.
    "label_returns": r"""
SELECT CASE WHEN d.n_chars < 60 OR d.source = 'src7' THEN d.doc_id + 100000000 ELSE d.doc_id END AS prompt_id, d.doc_id AS sent_id,
  CASE WHEN l.toxic = 1 THEN 'maybe' WHEN l.quality = 1 THEN 'clear' WHEN l.quality = 0 THEN 'UNCLEAR' ELSE 'PARTIAL' END AS clarity
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    # Prompts whose documents have a label are done.
    "labelled": r"""
SELECT DISTINCT p.prompt, p.use_case FROM {prompts} p JOIN {labels} l ON p.prompt_id = l.doc_id * 2""",
    # One prompt file per source and language, with all texts; blank and missing prompts are added.
    "prompt_files": r"""
SELECT concat(d.source, '-', d.lang, '.csv') AS file_name, d.doc_id * 2 AS row_pos, concat('  ', d.text, ' ') AS prompt,
  CASE WHEN l.toxic = 1 AND l.quality = 0 THEN 'unknown' WHEN l.quality = 1 THEN 'clear'
       WHEN l.quality = 0 THEN ' Partial ' ELSE 'UNCLEAR' END AS clarity
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
UNION ALL
SELECT concat(source, '-', lang, '.csv') AS file_name, doc_id * 2 + 1 AS row_pos,
  CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE NULL END AS prompt, 'unknown' AS clarity
FROM {documents} WHERE n_chars < 80""",
}
VIEWS["judge_outputs"] = VIEWS["judge_outputs"].replace("{left}", "{{").replace("{right}", "}}")


def view_sql(name: str, table: dict[str, str]) -> str:
    """The SQL of a view, with other views in place; ``table`` names the given tables."""
    inner = {
        **table,
        **{
            other: f"({view_sql(other, table)})"
            for other in VIEWS
            if f"{{{other}}}" in VIEWS[name]
        },
    }
    return VIEWS[name].format(**inner)


def with_raw_body(parts: DataFrame) -> DataFrame:
    """Response parts with the JSON body a provider of their format would send."""
    response, conv_id, turn = F.col("response"), F.col("conv_id"), F.col("turn")

    def usage(in_name: str, out_name: str, tokens_in: Column, tokens_out: Column) -> Column:
        return F.struct(tokens_in.alias(in_name), tokens_out.alias(out_name))

    message = F.struct(response.alias("content"))
    reasoned = F.struct(response.alias("content"), F.lit("abcdefgh").alias("reasoning_content"))
    body = (
        F.when(
            F.col("fmt") == "meta",
            F.to_json(
                F.struct(
                    response.alias("generation"),
                    (conv_id % 90).alias("prompt_token_count"),
                    (turn * 31).alias("generation_token_count"),
                )
            ),
        )
        .when(
            F.col("fmt") == "nova",
            F.to_json(
                F.struct(
                    F.struct(
                        F.struct(F.array(F.struct(response.alias("text"))).alias("content")).alias("message")
                    ).alias("output"),
                    usage("inputTokens", "outputTokens", conv_id % 90, turn * 17).alias("usage"),
                )
            ),
        )
        .when(
            F.col("fmt") == "gemini",
            F.to_json(
                F.struct(
                    response.alias("text"),
                    usage(
                        "prompt_token_count", "candidates_token_count", conv_id % 90, turn * 19
                    ).alias("usage_metadata"),
                )
            ),
        )
        .when(
            conv_id % 3 == 0,
            F.to_json(F.struct(F.array(F.struct(reasoned.alias("message"))).alias("choices"))),
        )
        .when(
            conv_id % 3 == 1,
            F.to_json(
                F.struct(
                    F.array(F.struct(message.alias("message"))).alias("choices"),
                    usage("prompt_tokens", "completion_tokens", conv_id % 90, turn * 13).alias("usage"),
                )
            ),
        )
        .otherwise(
            F.to_json(
                F.struct(
                    F.array(F.struct(response.alias("text"))).alias("content"),
                    usage("input_tokens", "output_tokens", conv_id % 90, turn * 11).alias("usage"),
                )
            )
        )
    )
    return parts.withColumn("raw_body", body).drop("response")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_scan(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    folder = hashlib.md5(sf_dir.encode()).hexdigest()
    names = {t: f"{t}_{folder}" for t in TABLES}
    sql = view_sql(name, names)
    for t, registered in names.items():
        if registered in sql:
            table(spark, sf_dir, t).createOrReplaceTempView(registered)
    return spark.sql(sql)
