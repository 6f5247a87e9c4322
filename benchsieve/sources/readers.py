"""Sources: benchmark CSV and tables, prompt files, profiles, with fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchsieve import policy
from benchsieve.functions.durable import settle
from benchsieve.functions.numbering import number_rows
from benchsieve.functions.text import is_blank, strip
from benchsieve.sources import schemas


def _quoted_csv(spark: SparkSession, schema):
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"')
    return reader.schema(schema) if schema is not None else reader


def _first_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line) of every file: its first line that is not blank, or null."""
    listed = spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("file"))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seen"),
        F.col("value").alias("line"),
    )
    # Lines of one block are read in their order.
    first = lines.where((F.col("_block") == 0) & ~is_blank(F.col("line")))
    first = first.groupBy("file").agg(F.min_by("line", "_seen").alias("line"))
    return listed.join(first, "file", "left").select("path", "line")


def files_by_header(
    spark: SparkSession, path: str | list[str]
) -> dict[tuple[str, ...], list[str]]:
    """The CSV files under ``path``, grouped by their header lines.

    Spark gives all files of one read the columns of the first, so files are grouped by their
    first lines in one job, and one file of each group tells its columns. A header whose
    quotes do not close in its line goes on in the next, so such a file is read apart. Only
    names and first lines come to the driver.
    """
    by_line: dict[str, list[str]] = {}
    for row in _first_lines(spark, path).orderBy("path").collect():
        line = row["line"] or ""
        by_line.setdefault(line if line.count('"') % 2 == 0 else row["path"], []).append(row["path"])
    groups: dict[tuple[str, ...], list[str]] = {}
    for line, files in by_line.items():
        header = tuple(_quoted_csv(spark, None).csv(files[0]).columns) if line else ()
        groups.setdefault(header, []).extend(files)
    return {header: sorted(files) for header, files in groups.items()}


def _all_files(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def read_benchmark_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Benchmark rows from CSV whose quoted responses may hold line breaks.

    Columns are matched by the header of each file; a column a file lacks is null.
    """
    parts = []
    for header, files in files_by_header(spark, path).items():
        raw = _quoted_csv(spark, None).csv(files)
        parts.append(
            raw.select(
                *[
                    F.col(f.name) if f.name in header else F.lit(None).cast("string").alias(f.name)
                    for f in schemas.BENCHMARK_CSV
                ]
            )
        )
    if not parts:
        raise FileNotFoundError(f"no CSV file in {path}")
    return _all_files(parts)


def read_benchmark_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``append_benchmark`` has written, with all labels as text."""
    schema = spark.read.parquet(path).schema
    labels = ("use_case", "prompt_complexity")
    fields = [T.StructField(f.name, T.StringType()) if f.name in labels else f for f in schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def scan_benchmark(
    table: DataFrame,
    use_case: str | None = None,
    complexity: str | None = None,
    clarity: str | None = None,
) -> DataFrame:
    """Equality filters on a benchmark table.

    On ``read_benchmark_table`` they choose folders and are pushed to the files. On rows that
    are cleaned on the way they stand above the cleaning.
    """
    wanted = {"use_case": use_case, "prompt_complexity": complexity, "clarity": clarity}
    for column, value in wanted.items():
        if value:
            table = table.where(F.col(column) == value)
    return table


def scan_prompt_logs(
    logs: DataFrame, use_case: str | None = None, prompt: str | None = None
) -> DataFrame:
    for column, value in {"use_case": use_case, "prompt": prompt}.items():
        if value:
            logs = logs.where(F.col(column) == value)
    return logs


def with_fallback(
    primary: DataFrame,
    local: DataFrame,
    primary_name: str = "primary",
    local_name: str = "local_csv",
) -> DataFrame:
    """Per use case, rows of ``primary`` when it has any, else rows of ``local``.

    Both sides are cleaned rows. ``data_source`` tells which side was used.
    """
    covered = settle(primary.select("use_case").distinct())
    rest = local.join(covered, "use_case", "left_anti")
    return primary.withColumn("data_source", F.lit(primary_name)).unionByName(
        rest.withColumn("data_source", F.lit(local_name))
    )


def combine_phases(phases: list[DataFrame]) -> DataFrame:
    """Union of benchmark phases by column name; absent columns become null."""
    combined = phases[0]
    for phase in phases[1:]:
        combined = combined.unionByName(phase, allowMissingColumns=True)
    return combined


def existing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist, so that missing phase files are skipped."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        if hadoop_path.getFileSystem(conf).exists(hadoop_path):
            found.append(path)
    return found


def read_phases(spark: SparkSession, paths: list[str]) -> DataFrame:
    found = existing_paths(spark, paths)
    if not found:
        raise FileNotFoundError("no benchmark phase file was found")
    return combine_phases([read_benchmark_csv(spark, p) for p in found])


class InputRejected(ValueError):
    """A prompt file cannot be used."""


def lacking_columns(
    spark: SparkSession, path: str | list[str], required: tuple[str, ...] = ("prompt", "clarity")
) -> list[tuple[str, str]]:
    """(file name, first column it lacks) for the files that cannot be read."""
    found = []
    for header, files in files_by_header(spark, path).items():
        absent = [c for c in required if c not in header]
        found += [(f.rpartition("/")[2], absent[0]) for f in files if absent]
    return found


def read_prompt_files(
    spark: SparkSession,
    path: str | list[str],
    required: tuple[str, ...] = ("prompt", "clarity"),
    skip_rejected: bool = False,
) -> DataFrame:
    """Rows of prompt CSV files with ``file_name`` and the 1-based ``row_pos`` per file.

    Each file is read by its own header. A file that lacks a column rejects the input, or
    with ``skip_rejected`` is left out; ``lacking_columns`` reports such files.
    """
    parts = []
    for header, files in files_by_header(spark, path).items():
        absent = [c for c in required if c not in header]
        if absent and not skip_rejected:
            name = files[0].rpartition("/")[2]
            raise InputRejected(f"CSV must have a '{absent[0]}' column ('{name}')")
        if not absent:
            raw = _quoted_csv(spark, None).csv(files)
            parts.append(
                raw.select(
                    *header,
                    F.col("_metadata.file_name").alias("file_name"),
                    F.col("_metadata.file_block_start").alias("_block"),
                    F.monotonically_increasing_id().alias("_seen"),
                )
            )
    if not parts:
        raise InputRejected("no prompt file can be read")
    rows = _all_files(parts)
    return number_rows(rows, ["_block", "_seen"], ["file_name"], "row_pos").drop("_block", "_seen")


def _clarity() -> Column:
    return F.upper(strip(F.col("clarity")))


def check_prompt_rows(rows: DataFrame) -> DataFrame:
    """Non-blank prompts with clean prompt and clarity; ``is_valid`` marks a known clarity."""
    return (
        rows.where(~is_blank(F.col("prompt")))
        .withColumn("prompt", strip(F.col("prompt")))
        .withColumn("clarity", _clarity())
        .withColumn("is_valid", F.coalesce(F.col("clarity").isin(*policy.CLARITIES), F.lit(False)))
    )


def prompt_file_report(rows: DataFrame) -> DataFrame:
    """Per file: prompts, bad clarity values and whether the file is used, empty or rejected."""
    kept = ~is_blank(F.col("prompt"))
    known = F.coalesce(_clarity().isin(*policy.CLARITIES), F.lit(False))
    counted = rows.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(kept).alias("prompt_count"),
        F.count_if(kept & ~known).alias("bad_clarity_count"),
    )
    return counted.withColumn(
        "status",
        F.when(F.col("bad_clarity_count") > 0, "rejected")
        .when(F.col("prompt_count") == 0, "empty")
        .otherwise("accepted"),
    )


def job_total(report: DataFrame) -> DataFrame:
    """One row for a job over the files of ``prompt_file_report``: files, prompts and status.

    One file with a bad value rejects the job, and a job without prompts has nothing to do.
    """
    prompts = F.coalesce(F.sum("prompt_count"), F.lit(0))
    bad = F.coalesce(F.sum("bad_clarity_count"), F.lit(0))
    status = F.when(bad > 0, "rejected").when(prompts == 0, "empty").otherwise("accepted")
    return report.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.count_if(F.col("prompt_count") > 0).alias("used_count"),
        prompts.alias("total_prompts"),
        bad.alias("bad_clarity_count"),
        status.alias("status"),
    )


def ingest_prompts(
    rows: DataFrame, use_case: str, complexity: str, strict: bool = True
) -> DataFrame:
    """Prompts stamped with the job's labels.

    One bad clarity value rejects the whole input, as does an input without any prompt.
    Without ``strict`` only the files that hold a bad value are left out.
    """
    if use_case not in policy.USE_CASES:
        raise InputRejected(f"Invalid use_case '{use_case}'")
    if complexity not in policy.COMPLEXITIES:
        raise InputRejected(f"Invalid prompt_complexity '{complexity}'")
    checked = check_prompt_rows(rows)
    if strict:
        bad = checked.where(~F.col("is_valid")).select("file_name", "clarity").head()
        if bad is not None:
            raise InputRejected(f"Invalid clarity value '{bad.clarity}' in '{bad.file_name}'")
        if checked.isEmpty():
            raise InputRejected("No valid prompts found in CSV")
    rejected = settle(checked.where(~F.col("is_valid")).select("file_name").distinct())
    return (
        checked.join(rejected, "file_name", "left_anti")
        .drop("is_valid")
        .withColumn("prompt_complexity", F.lit(complexity))
        .withColumn("use_case", F.lit(use_case))
    )


def ingest_clarity_input(rows: DataFrame) -> DataFrame:
    """Prompts to label; ``prompt_id`` is the source position, so blanks leave gaps."""
    return rows.where(~is_blank(F.col("prompt"))).select(
        "file_name",
        F.col("row_pos").cast("string").alias("prompt_id"),
        strip(F.col("prompt")).alias("prompt"),
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Exported chunks as (chunk, prompt, clarity)."""
    return _quoted_csv(spark, "chunk bigint, prompt string, clarity string").csv(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PROFILE).json(path)


def model_catalogue(spark: SparkSession, profile_prefix: str = "") -> DataFrame:
    """All known models with provider, response format, registry of origin and full model id.

    ``profile_prefix`` is the prefix of an account, which stands before ids of Meta models.
    """
    def full_id(short_id: str, fmt: str) -> str:
        return (profile_prefix if fmt == "meta" else "") + policy.MODEL_IDS[short_id]

    rows = [
        (short_id, provider, fmt, "vertex" if fmt == "gemini" else "bedrock", full_id(short_id, fmt))
        for short_id, provider, fmt in policy.MODELS
    ]
    return spark.createDataFrame(
        rows, "short_id string, provider string, fmt string, source string, model_id string"
    )


def price_table(spark: SparkSession) -> DataFrame:
    rows = [(name, cost_in, cost_out) for name, (cost_in, cost_out) in policy.PRICES.items()]
    return spark.createDataFrame(rows, "short_id string, price_in double, price_out double")


def allowed_models(spark: SparkSession) -> DataFrame:
    rows = [(uc, m) for uc, models in policy.USE_CASE_MODELS.items() for m in models]
    return spark.createDataFrame(rows, "use_case string, short_id string")
