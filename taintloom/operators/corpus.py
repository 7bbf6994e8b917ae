"""Scores of rules over labelled specimens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintloom.functions.domains import severity_matrix


def confusion(results: DataFrame) -> DataFrame:
    """Counts for each rule and taint from (rule_id, taint_state, verdict, fired); known misses are never scored."""
    v, fired = F.col("verdict"), F.col("fired")
    return results.groupBy("rule_id", "taint_state").agg(
        F.count_if((v == "true_positive") & fired).alias("tp"),
        F.count_if((v == "true_negative") & fired).alias("fp"),
        F.count_if((v == "true_negative") & ~fired).alias("tn"),
        F.count_if((v == "true_positive") & ~fired).alias("fn"),
        F.count_if(v == "known_false_negative").alias("kfn"),
    )


def cell_verdicts(results: DataFrame) -> DataFrame:
    """Every cell of the matrix with its scores against its floors: PASS, FAIL or NO_DATA."""
    # 72 rows of fixed values
    cells = F.broadcast(severity_matrix(results.sparkSession)).join(confusion(results), ["rule_id", "taint_state"], "left")
    cells = cells.fillna(0, ["tp", "fp", "tn", "fn", "kfn"])
    ratio = lambda a, b: F.when(a + b > 0, F.round(a / (a + b), 4))
    cells = cells.withColumns({"precision": ratio(F.col("tp"), F.col("fp")), "recall": ratio(F.col("tp"), F.col("fn"))})
    p_floor = F.when(F.col("taint_state") == "MIXED_RAW", 0.65).otherwise(0.80)
    r_floor = F.when(F.col("exceptionability") == "UNCONDITIONAL", 0.90).when(F.col("exceptionability").isin("STANDARD", "RELAXED"), 0.70)
    silent = F.col("severity") == "SUPPRESS"
    r_floor = F.when(~silent, r_floor)
    enough = F.coalesce(F.col("precision") >= p_floor, F.lit(True)) & F.coalesce(F.col("recall") >= r_floor, F.lit(True))
    scored = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    verdict = F.when(scored == 0, "NO_DATA").when(silent, F.when(F.col("fp") == 0, "PASS").otherwise("FAIL")).otherwise(F.when(enough, "PASS").otherwise("FAIL"))
    return cells.withColumn("verdict", verdict)


def category_coverage(specimens: DataFrame, floors: DataFrame) -> DataFrame:
    """Rules seen in each category against its floor."""
    seen = specimens.groupBy("category").agg(F.count_distinct("rule_id").alias("n_rules"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))
    out = floors.join(seen, "category", "left").fillna(0, ["n_rules"]).fillna("", ["rules"])
    return out.withColumn("met", F.col("n_rules") >= F.col("floor"))


def conformance_gaps(cells: DataFrame, findings: DataFrame, specimens: DataFrame, floors: dict[str, int]) -> DataFrame:
    """Rows (gap): cells below their floor, errors that no exception covers, rules without adversarial specimens of
    either kind, and categories with fewer specimens than their floor."""
    spark = cells.sparkSession
    failing = cells.agg(F.count_if(F.col("verdict") == "FAIL").alias("n")).filter("n > 0").select(F.concat(F.col("n").cast("string"), F.lit(" cells below floor")).alias("gap"))
    errors = findings.agg(F.count_if((F.col("severity") == "ERROR") & F.col("exception_id").isNull()).alias("n")).filter("n > 0").select(F.concat(F.col("n").cast("string"), F.lit(" errors without exception")).alias("gap"))
    rules = findings.filter(F.startswith("rule_id", F.lit("PY-WL-"))).select("rule_id").distinct()
    kinds = F.explode(F.array(F.lit("adversarial_false_positive"), F.lit("adversarial_false_negative")))
    missing = rules.select("rule_id", kinds.alias("category")).join(specimens.select("rule_id", "category").distinct(), ["rule_id", "category"], "left_anti")
    missing = missing.groupBy("category").agg(F.concat(F.col("category"), F.lit(": missing for "), F.array_join(F.array_sort(F.collect_set("rule_id")), ",")).alias("gap")).select("gap")
    least = spark.createDataFrame(list(floors.items()), "category string, floor int")
    counts = least.join(specimens.groupBy("category").agg(F.count("*").alias("n")), "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    few = counts.filter("n < floor").select(F.concat(F.col("category"), F.lit(": "), F.col("n").cast("string"), F.lit("/"), F.col("floor").cast("string")).alias("gap"))
    return failing.unionByName(errors).unionByName(missing).unionByName(few)


def stale_inputs(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(input): inputs (name, value) of a conformance status that are known now and differ from what was recorded."""
    now = current.filter("value is not null").select(F.col("name").alias("input"), F.col("value").alias("now"))
    return now.join(recorded.select(F.col("name").alias("input"), "value"), "input", "left").filter(~F.col("value").eqNullSafe(F.col("now"))).select("input")
