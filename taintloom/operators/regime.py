"""Checks of the governance regime: a row for each check, and metrics of its parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintloom.functions.domains import MATRIX
from taintloom.operators import exceptions as X

# The checks and what a failure counts as
SEVERITY = {
    "manifest_loads": "ERROR", "coherence_checks": "ERROR", "no_disabled_unconditional": "ERROR", "exception_register_valid": "ERROR", "expedited_ratio": "WARNING",
    "fingerprint_baseline_exists": "WARNING", "fingerprint_baseline_fresh": "WARNING", "no_expired_exceptions": "WARNING", "ratification_current": "WARNING",
    "ratification_metadata_present": "ERROR", "temporal_separation_declared": "WARNING", "annotation_change_tracking": "WARNING",
}
EXPEDITED_LIMIT = 0.15
HARD = sorted({r for r, _, _, x in MATRIX if x == "UNCONDITIONAL" and all(c == "UNCONDITIONAL" for rr, _, _, c in MATRIX if rr == r)})


def check(df: DataFrame, name: str, passed: Column, assurance: bool = False) -> DataFrame:
    """One row of a check from an aggregate; the declared separation is an error under the assurance profile."""
    severity = "ERROR" if assurance and name == "temporal_separation_declared" else SEVERITY[name]
    return df.agg(F.coalesce(passed, F.lit(True)).alias("passed")).select(F.lit(name).alias("check"), "passed", F.lit(severity).alias("severity"))


def verify(register: DataFrame, disabled: DataFrame, issues: DataFrame, fingerprints: DataFrame, ratification: DataFrame, now: str, longest: int = 180, assurance: bool = False, manifest_loads: bool = True) -> DataFrame:
    """All twelve checks. issues has severity; fingerprints last_changed; ratification one row of last_ratified,
    authority, interval and separation."""
    age = lambda c: F.datediff(F.lit(now).cast("date"), F.try_to_date(c))
    bad_cell = register.join(F.broadcast(register.sparkSession.createDataFrame([m[:2] for m in MATRIX if m[3] == "UNCONDITIONAL"], "rule_id string, taint_state string")), ["rule_id", "taint_state"], "left_semi")
    expired, expedited = X.expired(F.col("expires"), now), F.count_if(F.col("governance_path") == "expedited")
    rows = [
        check(ratification, "manifest_loads", F.lit(manifest_loads)),
        check(issues, "coherence_checks", F.count_if(F.col("severity") == "ERROR") == 0),
        check(disabled.filter(F.col("rule_id").isin(*HARD)), "no_disabled_unconditional", F.count("*") == 0),
        check(bad_cell, "exception_register_valid", F.count("*") == 0),
        check(register, "expedited_ratio", expedited / F.nullif(F.count("*"), F.lit(0)) < EXPEDITED_LIMIT),
        check(fingerprints, "fingerprint_baseline_exists", F.count("*") > 0),
        check(fingerprints, "fingerprint_baseline_fresh", F.min(age("last_changed")) < longest),
        check(register, "no_expired_exceptions", F.count_if(expired) == 0),
        check(ratification, "ratification_current", F.bool_and(age("last_ratified") <= F.col("interval"))),
        check(ratification, "ratification_metadata_present", F.bool_and(F.col("last_ratified").isNotNull() & F.col("authority").isNotNull())),
        check(ratification, "temporal_separation_declared", F.bool_and(F.col("separation").isNotNull()), assurance),
        check(fingerprints, "annotation_change_tracking", F.count(F.col("last_changed")) > 0),
    ]
    return reduce(DataFrame.unionByName, rows)


def gate(checks: DataFrame, strict: bool = False) -> DataFrame:
    """Failed checks that block: errors, with strict warnings too."""
    return checks.filter(~F.col("passed") & (F.lit(strict) | (F.col("severity") == "ERROR")))


def fingerprint_metrics(fingerprints: DataFrame, now: str) -> DataFrame:
    return fingerprints.agg(F.count("*").alias("total"), F.max("last_changed").alias("latest"), F.datediff(F.lit(now).cast("date"), F.try_to_date(F.max("last_changed"))).alias("age_days"), F.count_if(F.col("last_changed").isNull()).alias("undated"))


def rule_metrics(rules: DataFrame, disabled: DataFrame) -> DataFrame:
    off = disabled.select("rule_id", F.lit(True).alias("__off"))
    return rules.join(off, "rule_id", "left").agg(F.count("*").alias("total"), F.count("__off").alias("disabled"), F.count_if(F.col("__off") & F.col("rule_id").isin(*HARD)).alias("disabled_unconditional"))


def governance_events(findings: DataFrame) -> DataFrame:
    """Events of a scan: governance rows by kind, with the first and last place they occur at."""
    g = findings.filter(F.startswith("rule_id", F.lit("GOVERNANCE-")) | (F.col("rule_id") == "TOOL-ERROR"))
    return g.groupBy("rule_id").agg(F.count("*").alias("n"), F.min("file_path").alias("first_file"), F.max("file_path").alias("last_file"))


def explain(qualname: str, taints: DataFrame, annotations: DataFrame, findings: DataFrame, register: DataFrame) -> DataFrame:
    """What is known of one function, in the first file that has it: rows (topic, detail)."""
    own = taints.filter(F.col("qualname") == qualname)
    first = own.agg(F.min("file_path").alias("file_path"))
    own = own.join(first, "file_path")
    facts = own.select(F.explode(F.array(*[F.struct(F.lit(c).alias("topic"), F.col(c).cast("string").alias("detail")) for c in ("file_path", "body_taint", "return_taint", "taint_source")])).alias("x")).select("x.*")
    here = lambda df: df.filter(F.col("qualname") == qualname).join(first, "file_path", "left_semi")
    decorators = here(annotations).select(F.lit("decorator").alias("topic"), F.concat_ws(":", F.col("pos").cast("string"), "name").alias("detail"))
    hits = here(findings).select(F.lit("finding").alias("topic"), F.concat_ws(" ", "rule_id", "severity", F.col("line").cast("string")).alias("detail"))
    covers = register.withColumn("qualname", F.element_at(F.split("location", "::", 2), 2)).filter(F.col("qualname") == qualname).select(F.lit("exception").alias("topic"), F.col("id").alias("detail"))
    return reduce(DataFrame.unionByName, [facts, decorators, hits, covers])


def control_law(degradations: DataFrame, manifest_available: bool = True) -> DataFrame:
    """One row: the sorted kinds of degradation (kind), and the law: normal without any, alternate with some, direct
    where no manifest can be had."""
    if not manifest_available:
        return degradations.sparkSession.createDataFrame([("manifest_unavailable", "direct")], "degradations string, law string")
    return degradations.agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("degradations"), F.when(F.count("*") == 0, "normal").otherwise("alternate").alias("law"))
