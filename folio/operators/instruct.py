"""Question/answer datasets -> instruction rows ``(instruction, input, output, id)``.

Pure column expressions (no UDF): each conversion is one projection. Merging is a
``unionByName`` of any number of sets (duplicates kept); an empty list is an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The instruction texts of the two conversions.
OPEN_INSTRUCTION = "Given the following context create me open ended question-answer pair"
MCQ_INSTRUCTION = "Given the following context create me MCQ questions with options and answer pair"

INSTRUCTION_COLUMNS = ["instruction", "input", "output", "id"]


def load_split(spark: SparkSession, path: str | list[str], split: str | None = None, split_col: str = "split") -> DataFrame:
    """A dataset split stored as one or several Parquet files: ``split`` selects rows by ``split_col`` (or pass the split's own path)."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.where(F.col(split_col) == split) if split is not None else df


def _output(question, answer):
    return F.concat(F.lit("\nquestion: "), question, F.lit(" \n\nanswer: "), answer, F.lit("\n"))


def instruct_open(rows: DataFrame, instruction: str = OPEN_INSTRUCTION) -> tuple[DataFrame, DataFrame]:
    """SQuAD-shaped rows -> instruction rows; the first answer is taken. Rows without an
    answer go to quarantine (the conversion has nothing to put in ``output``)."""
    # null answers, a null list and a null first answer are no answer either
    has = F.coalesce(F.size("answers.text") > 0, F.lit(False)) & F.get(F.col("answers.text"), 0).isNotNull()
    good = rows.where(has).select(
        F.lit(instruction).alias("instruction"),
        F.concat(F.lit("Title: "), F.col("title"), F.lit("\nContext: "), F.col("context")).alias("input"),
        _output(F.col("question"), F.get(F.col("answers.text"), 0)).alias("output"),
        F.col("id"))
    bad = rows.where(~has).select("id", F.lit("no answer").alias("reason"))
    return good, bad


def instruct_mcq(rows: DataFrame, instruction: str = MCQ_INSTRUCTION) -> DataFrame:
    """QASC-shaped rows -> instruction rows (``choices`` and the facts are dropped)."""
    return rows.select(
        F.lit(instruction).alias("instruction"),
        F.col("combinedfact").alias("input"),
        _output(F.col("formatted_question"), F.col("answerKey")).alias("output"),
        F.col("id"))


def preview(rows: DataFrame, m: int = 5) -> DataFrame:
    """The first ``m`` rows by id (the order makes the preview deterministic)."""
    return rows.orderBy("id").limit(m)


def merge(sets: list[DataFrame], output_path: str | None = None) -> DataFrame:
    """Concatenate instruction sets vertically; duplicates kept; optional Parquet save."""
    if not sets:
        raise ValueError("No instruction sets to concatenate.")
    out = reduce(lambda a, b: a.unionByName(b), [s.select(*INSTRUCTION_COLUMNS) for s in sets])
    if output_path:
        out.write.mode("overwrite").parquet(output_path)
        return out.sparkSession.read.parquet(output_path)
    return out
