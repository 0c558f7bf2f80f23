"""Lexical judge, per-version aggregates and version deltas as table jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


CASE_SCHEMA = """id string, account struct<domain:string, opportunity_score:double, exposure_score:double, vulnerability_score:double,
  technology_score:double, recency_score:double, unique_ip_count:bigint, unique_port_count:bigint, unique_service_count:bigint,
  cloud_observation_count:bigint, exposed_database_count:bigint, exposed_remote_access_count:bigint, eol_observation_count:bigint,
  vulnerability_count:bigint, critical_vulnerability_observations:bigint, high_vulnerability_observations:bigint,
  score_reasons:array<string>>, signals array<struct<signal_type:string, signal_name:string, severity:string, description:string,
  confidence:double>>, expected struct<must_mention:array<string>, must_not_mention:array<string>>, fixture_output string"""


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON-lines file, as :func:`judge` takes them: case_id, account, signals,
    text (the kept output, empty where there is none), must_mention and must_not_mention."""
    rows = spark.read.schema(CASE_SCHEMA).option("mode", "FAILFAST").json(path)
    return rows.select(F.col("id").alias("case_id"), "account", "signals", F.coalesce("fixture_output", F.lit("")).alias("text"),
                       "expected.must_mention", "expected.must_not_mention")


def judge(cases: DataFrame, text_col: str = "text", must: str = "must_mention",
          must_not: str = "must_not_mention") -> DataFrame:
    """Per case: true positives, false negatives, false positives, precision/recall
    (1.0 when the denominator is 0, rounded to 4) and ``passed``. Whole texts are
    searched; phrases match case-insensitively as substrings."""
    none = F.array().cast("array<string>")
    given = cases.withColumn("_hay", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    hits = lambda c: F.transform(F.coalesce(F.col(c), none), lambda x: F.struct(
        x.alias("phrase"), F.col("_hay").contains(F.lower(x)).alias("hit")))
    phrases = lambda c, hit: F.transform(
        F.filter(c, lambda x: x["hit"] if hit else ~x["hit"]), lambda x: x["phrase"])
    found = given.withColumns({"_must": hits(must), "_not": hits(must_not)})
    out = found.withColumns({
        "true_positives": phrases("_must", True), "false_negatives": phrases("_must", False),
        "false_positives": phrases("_not", True)}).drop("_must", "_not", "_hay")
    tp, fn, fp = F.size("true_positives"), F.size("false_negatives"), F.size("false_positives")
    nonblank = F.length(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"^\s+|\s+$", "")) > 0
    return out.select(
        "*",
        F.round(F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0), 4).alias("precision"),
        F.round(F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0), 4).alias("recall"),
        ((fn == 0) & (fp == 0) & nonblank).alias("passed"),
    )


def summarize(judged: DataFrame, by: str | list[str] = "prompt_version") -> DataFrame:
    """Micro-averaged precision/recall and pass rate per version or (run, version); 0.0 on empty sums."""
    by = [by] if isinstance(by, str) else by
    s = judged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        F.sum(F.size("true_positives")).cast("bigint").alias("true_positives"),
        F.sum(F.size("false_positives")).cast("bigint").alias("false_positives"),
        F.sum(F.size("false_negatives")).cast("bigint").alias("false_negatives"),
        F.count_if("passed").alias("passed_cases"),
    )
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return s.select(
        *by, "cases",
        F.round(F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), 4).alias("precision"),
        F.round(F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0), 4).alias("recall"),
        F.round(F.when(F.col("cases") > 0, F.col("passed_cases") / F.col("cases")).otherwise(0.0), 4)
         .alias("pass_rate"),
        "true_positives", "false_positives", "false_negatives",
        (F.col("cases") - F.col("passed_cases")).alias("failures"),
    )


def deltas(summary: DataFrame, run: str = "run_id", by: str = "prompt_version") -> DataFrame:
    """Each (run, version) against the previous run of the same version, and each run's winner.

    Metric deltas are null for a version's first run. The winner has the highest (pass_rate,
    recall) of its run; ties go to the later version."""
    previous = Window.partitionBy(by).orderBy(run)
    change = lambda c: F.round(F.col(c) - F.lag(c).over(previous), 4).alias(f"{c}_delta")
    best = summary.groupBy(run).agg(F.max_by(F.col(by), F.struct("pass_rate", "recall", by)).alias("winner"))
    moved = summary.select(run, by, change("precision"), change("recall"), change("pass_rate"))
    return moved.join(best, run).withColumn("is_winner", F.col(by) == F.col("winner")).drop("winner")


def failing_cases(judged: DataFrame, case: str = "case_id", run: str = "run_id", by: str = "prompt_version") -> DataFrame:
    """(run, version, case) of the cases that failed: a long table instead of a list per version."""
    return judged.filter(~F.col("passed")).select(run, by, case)
