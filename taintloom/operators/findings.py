"""Findings: severity, gate, counters, order and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taintloom.functions.domains import BUILTIN_VALIDATORS, SARIF_LEVEL, SEVERITY_RANK, severity_matrix
from taintloom.functions.lattice import lookup


def with_severity(hits: DataFrame) -> DataFrame:
    """Hits (rule_id, taint_state) with severity and exceptionability; a hit without a cell is an error."""
    # 72 rows of fixed values
    out = hits.join(F.broadcast(severity_matrix(hits.sparkSession)), ["rule_id", "taint_state"], "left")
    known = F.when(F.col("severity").isNull(), F.raise_error(F.concat(F.lit("no cell for "), F.coalesce("rule_id", F.lit("null")), F.lit(" at "), F.coalesce("taint_state", F.lit("null"))))).otherwise(F.col("severity"))
    return out.withColumn("severity", known)


def breakdown(findings: DataFrame, *by: str) -> DataFrame:
    """Counts by severity and of what blocks: errors that no exception covers."""
    s = F.col("severity")
    return findings.groupBy(*by).agg(
        F.count_if(s == "ERROR").alias("n_error"),
        F.count_if(s == "WARNING").alias("n_warning"),
        F.count_if(s == "SUPPRESS").alias("n_suppress"),
        F.count_if((s == "ERROR") & F.col("exception_id").isNotNull()).alias("n_excepted"),
        F.count_if((s == "ERROR") & F.col("exception_id").isNull()).alias("n_blocking"),
    )


def worst_by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.max_by("severity", lookup(SEVERITY_RANK, "severity")).alias("worst"))


def disable_rules(findings: DataFrame, disabled: DataFrame) -> DataFrame:
    return findings.join(disabled.select("rule_id"), "rule_id", "left_anti")


def governance_of_disabled(disabled: DataFrame) -> DataFrame:
    """A row for each disabled rule: an error where all its cells are unconditional."""
    hard = F.col("rule_id").isin("PY-WL-008", "PY-WL-009")
    return disabled.select(F.lit("GOVERNANCE-RULE-DISABLED").alias("rule_id"), F.col("rule_id").alias("disabled_rule"), F.when(hard, "ERROR").otherwise("WARNING").alias("severity"))


def unknown_share(findings: DataFrame, files_scanned: int) -> DataFrame:
    """Findings at UNKNOWN_RAW for each hundred files; counts findings, so it may exceed 100."""
    n = F.count_if(F.col("taint_state") == "UNKNOWN_RAW")
    return findings.agg(n.alias("n_unknown"), F.when(F.lit(files_scanned) > 0, F.round(n / F.lit(max(files_scanned, 1)) * 100, 3)).otherwise(F.lit(0.0)).alias("pct"))


def report_rows(findings: DataFrame) -> DataFrame:
    """Rows of the report in its order, with levels, one-based columns and UNKNOWN for a null taint."""
    w = Window.partitionBy("file_path").orderBy("line", "col", "rule_id", "ordinal")
    return findings.select(
        "file_path", F.row_number().over(w).alias("place"), "ordinal", "rule_id", lookup(SARIF_LEVEL, "severity").alias("level"), "line", (F.col("col") + 1).alias("start_column"), F.coalesce("taint_state", F.lit("UNKNOWN")).alias("taint"),
    )


def exit_code(config_error: bool, tool_errors: int, blocking: int) -> int:
    """2 for a faulty configuration, 3 for a tool error, 1 for findings that block, else 0."""
    return 2 if config_error else 3 if tool_errors else 1 if blocking else 0


def effective_validators(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """(name): the builtin validators and those that the settings add, each once."""
    own = spark.createDataFrame([(v,) for v in BUILTIN_VALIDATORS], "name string")
    return own if extra is None else own.unionByName(extra.select("name")).distinct()


def unless_declared(hits: DataFrame, declared: DataFrame, key: list[str]) -> DataFrame:
    """Hits of functions that no declaration (key) covers."""
    return hits.join(declared.select(*key), key, "left_anti")


def preview(findings: DataFrame) -> DataFrame:
    """For each exception how many findings it covers, and which, in their order."""
    reasons = F.array_sort(F.collect_list(F.struct("ordinal", F.concat_ws("@", "rule_id", F.col("ordinal").cast("string")).alias("r"))))
    return findings.filter("exception_id is not null").groupBy("exception_id").agg(F.count("*").alias("n"), F.array_join(F.transform(reasons, lambda x: x["r"]), ";").alias("reasons"))


def exit_codes(findings: DataFrame, failed: Column, *by: str) -> DataFrame:
    """The exit code of each part of the findings: 3 after a failure of the tool, 1 where an error blocks, else 0."""
    blocks = F.count_if((F.col("severity") == "ERROR") & F.col("exception_id").isNull())
    return findings.groupBy(*by).agg(F.when(F.count_if(failed) > 0, 3).when(blocks > 0, 1).otherwise(0).alias("exit_code"))


def literal_counts(literals: DataFrame, value: str, n: Column | None = None) -> DataFrame:
    """(value, n): how often each string occurs; empty ones are left out."""
    total = F.count("*") if n is None else F.sum(n)
    return literals.filter(F.col(value) != "").groupBy(F.col(value).alias("value")).agg(total.alias("n"))


def run_properties(findings: DataFrame) -> DataFrame:
    """The counters of a report: one row."""
    s = F.col("severity")
    return findings.agg(
        F.count_if(s == "ERROR").alias("errorFindingCount"),
        F.count("exception_id").alias("exceptedFindingCount"),
        F.count_if((s == "ERROR") & F.col("exception_id").isNull()).alias("gateBlockingCount"),
        F.count_if(s == "SUPPRESS").alias("suppressedCellFindingCount"),
        F.count_if(s == "WARNING").alias("warningFindingCount"),
        F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("implementedRules"),
    )
