"""Batches for judges and labellers, their answers, and the labels that result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchsieve import policy
from benchsieve.functions.durable import settle
from benchsieve.functions.numbering import number_rows, running_sums
from benchsieve.functions.text import strip
from benchsieve.operators.clean import default_use_case
from benchsieve.sources.schemas import JUDGE_SCORES

SEPARATOR = "\n\n---\n\n"


def _plan_runs(runs: Column, budget: int) -> Column:
    """Fill batches greedily over runs of responses with equal token counts.

    A run may close the open batch and fill many more, so each step is plain
    arithmetic. The result tells, per token count, the open batch, how many
    responses still fit into it, and how many a new batch holds.
    """
    whole = "bigint"
    number = F.lit(0).cast(whole)
    start = F.struct(
        number.alias("batch"),
        number.alias("used"),
        F.array()
        .cast("array<struct<tokens:bigint,batch:bigint,fits:bigint,per_batch:bigint>>")
        .alias("plan"),
    )

    def step(state: Column, run: Column) -> Column:
        tokens, count = run["tokens"], run["count"]
        everything = count + 1
        per_batch = F.when(tokens == 0, everything).otherwise(
            F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(tokens, F.lit(1))))
        )
        room = F.floor((F.lit(budget) - state["used"]) / F.greatest(tokens, F.lit(1)))
        fits = (
            F.when(state["batch"] == 0, 0)
            .when(tokens == 0, count)
            .otherwise(F.least(count, F.greatest(room, F.lit(0))))
        )
        rest = count - fits
        opened = F.ceil(rest / per_batch)
        used = F.when(rest == 0, state["used"] + fits * tokens).otherwise(
            (rest - (opened - 1) * per_batch) * tokens
        )
        entry = F.struct(
            tokens.alias("tokens"),
            state["batch"].alias("batch"),
            fits.cast(whole).alias("fits"),
            per_batch.cast(whole).alias("per_batch"),
        )
        return F.struct(
            (state["batch"] + opened).cast(whole).alias("batch"),
            used.cast(whole).alias("used"),
            F.concat(state["plan"], F.array(entry)).alias("plan"),
        )

    return F.aggregate(runs, start, step, lambda state: state["plan"])


def token_batches(
    responses: DataFrame,
    budget: int = policy.JUDGE_TOKEN_BUDGET,
    excerpt_chars: int | None = None,
) -> DataFrame:
    """(prompt_id, resp_id, model_id, tokens, batch): batches within a token budget.

    Responses are taken by length. Tokens are a quarter of the characters that the
    judge reads: the whole response, or an excerpt where ``excerpt_chars`` is given.
    Counts above the budget all fill a batch of their own, so the greedy fold runs
    over at most ``budget`` + 2 counts per prompt, and rows find their batch by their
    position in a run of equal counts.
    """
    whole_length = F.char_length("response").cast("bigint")
    read_length = F.col("_length")
    if excerpt_chars is not None:
        read_length = F.least(read_length, F.lit(excerpt_chars))
    sized = settle(
        responses.select("prompt_id", "resp_id", "model_id", whole_length.alias("_length"))
        .withColumn("tokens", F.floor(read_length / 4).cast("bigint"))
        .withColumn("_units", F.least(F.col("tokens"), F.lit(budget + 1).cast("bigint")))
    )
    numbered = number_rows(
        sized, ["_length", "model_id", "resp_id"], ["prompt_id", "_units"], "_nth"
    )
    runs = (
        sized.groupBy("prompt_id", "_units")
        .agg(F.count(F.lit(1)).alias("count"))
        .groupBy("prompt_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct(F.col("_units").alias("tokens"), "count"))
            ).alias("runs")
        )
    )
    plan = runs.select("prompt_id", F.inline(_plan_runs(F.col("runs"), budget))).withColumnRenamed(
        "batch", "_open"
    ).withColumnRenamed("tokens", "_units")
    beyond = F.col("_nth") - F.col("fits") - 1
    return numbered.join(plan, ["prompt_id", "_units"]).select(
        "prompt_id",
        "resp_id",
        "model_id",
        "tokens",
        F.when(F.col("_nth") <= F.col("fits"), F.col("_open"))
        .otherwise(F.col("_open") + 1 + F.floor(beyond / F.col("per_batch")))
        .cast("bigint")
        .alias("batch"),
    )


def fixed_chunks(rows: DataFrame, order: list[str], size: int = policy.CLARITY_CHUNK) -> DataFrame:
    """Add ``chunk``: every ``size`` rows in order, counted from 1."""
    return number_rows(rows, order, name="_nth").withColumn(
        "chunk", (F.floor((F.col("_nth") - 1) / size) + 1).cast("bigint")
    ).drop("_nth")


def _numbered_text(order: str, text: Column) -> Column:
    """Texts of a batch in order, as an array; a batch is one message."""
    return F.transform(
        F.sort_array(F.collect_list(F.struct(F.col(order), text.alias("text")))),
        lambda item: item["text"],
    )


def judge_requests(
    batches: DataFrame,
    responses: DataFrame,
    prompts: DataFrame,
    rubric: str,
    excerpt_chars: int | None = None,
) -> DataFrame:
    """One request text per judge batch, with whole responses.

    ``excerpt_chars`` cuts each response, as it must for batches planned that way.
    """
    text = F.col("response")
    if excerpt_chars is not None:
        text = F.substring(text, 1, excerpt_chars)
    excerpts = responses.select("resp_id", text.alias("_excerpt"))
    member = batches.join(excerpts, ["resp_id"]).withColumn(
        "_order", F.struct("tokens", "model_id", "resp_id")
    )
    merged = member.groupBy("prompt_id", "batch").agg(
        F.count(F.lit(1)).alias("response_count"),
        _numbered_text("_order", F.struct("model_id", "_excerpt")).alias("_members"),
    )
    numbered = F.transform(
        "_members",
        lambda m, i: F.concat(
            F.lit("[Response "),
            (i + 1).cast("string"),
            F.lit("] model_id: "),
            m["model_id"],
            F.lit("\n"),
            m["_excerpt"],
        ),
    )
    asked = merged.join(prompts.select("prompt_id", "prompt", "use_case"), ["prompt_id"])
    return asked.select(
        "prompt_id",
        "batch",
        "response_count",
        F.concat(
            F.lit(f"{rubric}\n\nUSER-SELECTED USE CASE:\n"),
            default_use_case(F.col("use_case")),
            F.lit("\n\nPROMPT:\n"),
            "prompt",
            F.lit("\n\nMODEL RESPONSES ("),
            F.col("response_count").cast("string"),
            F.lit(" total):\n\n"),
            F.array_join(numbered, SEPARATOR),
        ).alias("request"),
    )


def judge_messages(
    batches: DataFrame,
    responses: DataFrame,
    prompts: DataFrame,
    rubric: str,
    most_chars: int = 100_000,
) -> DataFrame:
    """(prompt_id, batch, part, text): the requests of judge batches in numbered parts.

    A part has at most ``most_chars`` characters, and the parts of a batch in order are the
    text that ``judge_requests`` gives. Responses know their place from the running sum of
    lengths, so a batch of any number of them is never one value. Batches whose prompt is
    not known have an empty one.
    """
    group = ["prompt_id", "batch"]
    texts = responses.select("resp_id", F.coalesce("response", F.lit("")).alias("_text"))
    lengths = texts.select("resp_id", F.char_length("_text").cast("bigint").alias("_chars"))
    numbered = number_rows(batches.join(lengths, "resp_id"), ["tokens", "model_id", "resp_id"], group, "_nth")

    def lead() -> Column:
        opened = F.concat(F.lit("[Response "), F.col("_nth").cast("string"), F.lit("] model_id: "), "model_id", F.lit("\n"))
        return F.when(F.col("_nth") > 1, F.concat(F.lit(SEPARATOR), opened)).otherwise(opened)

    sized = numbered.withColumn("_size", F.char_length(lead()) + F.col("_chars"))
    placed = running_sums(sized, ["_nth"], group, "_size", "_start")
    asked = prompts.select("prompt_id", "prompt", "use_case")
    heads = (
        batches.groupBy(*group)
        .agg(F.count(F.lit(1)).cast("string").alias("_count"))
        .join(asked, "prompt_id", "left")
        .select(
            *group,
            F.concat(
                F.lit(f"{rubric}\n\nUSER-SELECTED USE CASE:\n"),
                default_use_case(F.col("use_case")),
                F.lit("\n\nPROMPT:\n"),
                F.coalesce("prompt", F.lit("")),
                F.lit("\n\nMODEL RESPONSES ("),
                "_count",
                F.lit(" total):\n\n"),
            ).alias("_piece"),
        )
    )
    heads = settle(heads.withColumn("_head", F.char_length("_piece").cast("bigint")))
    members = placed.join(heads.select(*group, "_head"), group).join(texts, "resp_id")
    pieces = members.select(*group, "_nth", (F.col("_head") + F.col("_start")).alias("_start"), F.concat(lead(), "_text").alias("_piece"))
    whole = pieces.unionByName(
        heads.select(*group, F.lit(0).cast("bigint").alias("_nth"), F.lit(0).cast("bigint").alias("_start"), "_piece")
    )
    first = F.floor(F.col("_start") / most_chars)
    last = F.floor((F.col("_start") + F.char_length("_piece") - 1) / most_chars)
    cut = whole.withColumn("part", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("part") * most_chars - F.col("_start"), F.lit(0))
    end = (F.col("part") + 1) * most_chars - F.col("_start")
    text = F.substring("_piece", (begin + 1).cast("int"), (end - begin).cast("int"))
    # A part has no more pieces than characters.
    held = F.array_sort(F.collect_list(F.struct("_nth", text.alias("text"))))
    return cut.groupBy(*group, "part").agg(held.alias("_held")).select(
        *group, "part", F.array_join(F.transform("_held", lambda p: p["text"]), "").alias("text")
    )


def label_requests(
    chunked: DataFrame,
    instruction: str,
    fields: tuple[str, ...] = (),
    order: str = "prompt_id",
) -> DataFrame:
    """One request text per label chunk; ``fields`` are shown between id and prompt."""

    def quoted(name: str) -> Column:
        return F.concat(F.lit(f'{name}: "'), F.col(name), F.lit('"'))

    item = F.concat_ws(
        "\n",
        *[quoted(name) for name in ("prompt_id", *fields)],
        F.concat(F.lit('prompt: """'), F.col("prompt"), F.lit('"""')),
    )
    return chunked.groupBy("chunk").agg(
        F.concat(
            F.lit(f"{instruction}\n\n"),
            F.array_join(_numbered_text(order, item), SEPARATOR),
        ).alias("request")
    )


def clean_judge_text(text: Column) -> Column:
    """Answer text without surrounding code fences."""
    opened = F.regexp_replace(strip(text), r"^(?:```json)?(?:```)?", "")
    return strip(F.regexp_replace(opened, r"```$", ""))


def parse_judge(answers: DataFrame) -> DataFrame:
    """Add ``kind`` (list, other, unusable) and the parsed ``scores`` of ``judge_text``."""
    return (
        answers.withColumn("_clean", clean_judge_text(F.col("judge_text")))
        .withColumn("_is_json", F.try_parse_json("_clean").isNotNull())
        .withColumn(
            "kind",
            F.when(~F.col("_is_json"), "unusable")
            .when(F.startswith(F.col("_clean"), F.lit("[")), "list")
            .otherwise("other"),
        )
        .withColumn("scores", F.when(F.col("kind") == "list", F.from_json("_clean", JUDGE_SCORES)))
        .drop("_clean", "_is_json")
    )


def merge_scores(members: DataFrame, answers: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The score of every response of every batch.

    A list at least as long as the batch is cut to the batch. Otherwise a model
    it does not name has 50. Without a usable answer all have 0. The last score of
    a model counts, and a model that a full list does not name has 0.
    """
    given = F.col("_score.accuracy_score").try_cast("double")  # a number, or one in quotes
    sizes = members.groupBy(batch).agg(F.count(F.lit(1)).alias("_size"))
    judged = (
        parse_judge(answers)
        .withColumn("_answers", F.coalesce(F.size("scores"), F.lit(0)))
        .join(sizes, [batch])
        .withColumn("_is_full", F.col("_answers") >= F.col("_size"))
    )
    named = (
        judged.where(F.col("kind") == "list")
        .select(batch, "_size", "_is_full", F.posexplode("scores").alias("_pos", "_score"))
        .where(~F.col("_is_full") | (F.col("_pos") < F.col("_size")))
        .groupBy(batch, F.col("_score.model_id").alias("model_id"))
        .agg(F.max_by(given, "_pos").alias("_given"))
    )
    status = judged.select(batch, "kind", "_is_full")
    known = members.join(status, [batch], "left").join(named, [batch, "model_id"], "left")
    absent = (
        F.when((F.col("kind") == "list") & F.col("_is_full"), policy.UNUSABLE_SCORE)
        .when(F.col("kind").isin("list", "other"), policy.MISSING_SCORE)
        .otherwise(policy.UNUSABLE_SCORE)
    )
    return known.withColumn(
        "accuracy_score", F.coalesce("_given", absent.cast("double"))
    ).drop("kind", "_is_full", "_given")


def merge_prompt_scores(
    members: DataFrame, answers: DataFrame, prompt: str = "prompt_id", batch: str = "batch_id"
) -> DataFrame:
    """The score of every response of a prompt (``prompt``, ``model_id``) over all its batches.

    ``members`` has the prompt, the batch and the model of each response. Each batch gives
    scores as in ``merge_scores``; those that its members get without being named stand
    behind its list. The last score of a model counts, in whatever batch it was named, and a
    model that no batch scores has 0.
    """
    given = F.col("_score.accuracy_score").try_cast("double")
    sizes = members.groupBy(batch).agg(F.count(F.lit(1)).alias("_size"), F.first(prompt).alias(prompt))
    judged = (
        parse_judge(answers)
        .withColumn("_answers", F.coalesce(F.size("scores"), F.lit(0)))
        .join(sizes, [batch])
        .withColumn("_is_full", (F.col("kind") == "list") & (F.col("_answers") >= F.col("_size")))
    )
    named = (
        judged.where(F.col("kind") == "list")
        .select(batch, prompt, "_size", "_is_full", F.posexplode("scores").alias("_pos", "_score"))
        .where(~F.col("_is_full") | (F.col("_pos") < F.col("_size")))
        .select(batch, prompt, F.col("_score.model_id").alias("model_id"), F.struct(batch, "_pos").alias("_at"), given.alias("_given"))
    )
    # Members without a list that is long enough get a fixed score, behind what the list gives.
    filled = (
        members.join(judged.select(batch, "kind", "_is_full"), [batch], "left")
        .where(~F.coalesce("_is_full", F.lit(False)))
        .join(named.select(batch, "model_id").distinct(), [batch, "model_id"], "left_anti")
        .select(
            batch,
            prompt,
            "model_id",
            F.struct(batch, F.lit(2**31 - 1).alias("_pos")).alias("_at"),
            F.when(F.col("kind").isin("list", "other"), policy.MISSING_SCORE)
            .otherwise(policy.UNUSABLE_SCORE)
            .cast("double")
            .alias("_given"),
        )
    )
    last = named.unionByName(filled).groupBy(prompt, "model_id").agg(F.max_by("_given", "_at").alias("_given"))
    unusable = F.lit(policy.UNUSABLE_SCORE).cast("double")
    return (
        members.select(prompt, "model_id").distinct().join(last, [prompt, "model_id"], "left")
        .select(prompt, "model_id", F.coalesce("_given", unusable).alias("accuracy_score"))
    )


def label_missing(
    expected: DataFrame, returned: DataFrame, label: str = "clarity", most: int = 20
) -> DataFrame:
    """Batches that lack labels: how many, the first ``most`` ids in order, and the error text.

    ``expected`` has ``chunk``, ``prompt_id`` and ``position``; ``returned`` has the first two.
    The text of a batch that lacks more says so by dots.
    """
    got = returned.select("chunk", "prompt_id").distinct()
    missing = expected.join(got, ["chunk", "prompt_id"], "left_anti")
    # The limit by rank is taken in each task before rows of a batch meet.
    rank = F.row_number().over(Window.partitionBy("chunk").orderBy("position", "prompt_id"))
    first = missing.select("chunk", "prompt_id", "position", rank.alias("_rank")).where(F.col("_rank") <= most)
    named = first.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("_rank", "prompt_id"))).alias("_ids"))
    ids = F.transform("_ids", lambda i: i["prompt_id"].cast("string"))
    counts = missing.groupBy("chunk").agg(F.count(F.lit(1)).alias("missing_count"))
    text = F.concat(
        F.lit(f"Missing {label} labels for prompt_ids: "),
        F.array_join("missing_ids", ", "),
        F.when(F.col("missing_count") > most, ", ...").otherwise(""),
    )
    return (
        counts.join(named, "chunk")
        .select("chunk", "missing_count", ids.alias("missing_ids"))
        .withColumn("error", text)
    )


def label_errors(
    expected: DataFrame,
    returned: DataFrame,
    label: str = "clarity",
    domain: tuple[str, ...] = policy.CLARITIES,
) -> DataFrame:
    """One row per batch with the first problem of the returned labels, or null.

    ``expected`` has ``chunk`` and ``prompt_id``; ``returned`` also ``position`` and
    the label. Counts are compared first, then each label in order, then what is
    missing. Only counts and first problems are kept per batch.
    """
    name = F.upper(strip(F.col(label)))
    asked = expected.select(
        "chunk",
        "prompt_id",
        F.lit(1).alias("_asked"),
        F.lit(None).cast("bigint").alias("_at"),
        F.lit(None).cast("string").alias("_label"),
    )
    got = returned.select(
        "chunk",
        "prompt_id",
        F.lit(0).alias("_asked"),
        F.col("position").cast("bigint").alias("_at"),
        F.coalesce(name, F.lit("")).alias("_label"),
    )
    invalid = F.col("_at").isNotNull() & ~F.col("_label").isin(*domain)
    per_id = (
        asked.unionByName(got)
        .groupBy("chunk", "prompt_id")
        .agg(
            F.sum("_asked").alias("_asked"),
            F.count("_at").alias("_got"),
            F.min("_at").alias("_first"),
            F.min(F.when(invalid, F.struct("_at", "_label"))).alias("_invalid"),
        )
    )
    problem = F.when(
        (F.col("_asked") == 0) & (F.col("_got") > 0),
        F.struct(
            F.col("_first").alias("at"),
            F.concat(F.lit("Unexpected prompt_id returned: "), F.col("prompt_id")).alias("text"),
        ),
    ).when(
        F.col("_invalid").isNotNull(),
        F.struct(
            F.col("_invalid._at").alias("at"),
            F.concat(
                F.lit(f"Invalid {label} label returned: "), F.col("_invalid._label")
            ).alias("text"),
        ),
    )
    per_batch = per_id.groupBy("chunk").agg(
        F.sum("_asked").alias("expected_count"),
        F.sum("_got").alias("returned_count"),
        F.min(problem).alias("_problem"),
        F.count_if((F.col("_asked") > 0) & (F.col("_got") == 0)).alias("missing_count"),
    )
    error = (
        F.when(
            F.col("expected_count") != F.col("returned_count"),
            F.concat(
                F.lit("Expected "),
                F.col("expected_count").cast("string"),
                F.lit(f" {label} labels, got "),
                F.col("returned_count").cast("string"),
            ),
        )
        .when(F.col("_problem").isNotNull(), F.col("_problem.text"))
        .when(
            F.col("missing_count") > 0,
            F.concat(
                F.lit(f"Missing {label} labels: "), F.col("missing_count").cast("string")
            ),
        )
    )
    return per_batch.select(
        "chunk", "expected_count", "returned_count", "missing_count", error.alias("error")
    )


def attach_labels(
    rows: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("clarity",)
) -> DataFrame:
    """Rows with the labels returned for their ``prompt_id``."""
    return rows.drop(*columns).join(labels.select("prompt_id", *columns), ["prompt_id"])


def pending(
    rows: DataFrame, done: DataFrame, first: int | None = None, order: str = "prompt_id"
) -> DataFrame:
    """Rows whose (prompt, use case) is not labelled yet; optionally only the first ones."""
    finished = done.select(
        strip(F.col("prompt")).alias("prompt"), F.lower(strip(F.col("use_case"))).alias("use_case")
    ).withColumn("_hash", F.xxhash64("prompt", "use_case"))
    keyed = rows.withColumn("_hash", F.xxhash64("prompt", "use_case"))
    left = keyed.join(finished, ["_hash", "prompt", "use_case"], "left_anti").drop("_hash")
    return left if first is None else left.orderBy(order).limit(first)


def label_with(
    rows: DataFrame, labeller: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Rows labelled or scored by a user function over pandas batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield labeller(batch)

    return rows.mapInPandas(run, schema)


def enriched_prompt(prompt: Column, complexity: Column, quality: Column) -> Column:
    """The prompt followed by its complexity and quality."""
    return F.concat(
        prompt,
        F.lit("\n\n[Prompt complexity: "),
        complexity,
        F.lit(" | Prompt quality: "),
        quality.cast("string"),
        F.lit("/100]"),
    )
