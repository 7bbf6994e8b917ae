"""Taints of functions from their decorators, restoration evidence and module defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taintloom.functions.domains import DECORATOR_TAINTS
from taintloom.functions.lattice import evidence_ceiling, lookup

BODY = {d: b for d, (b, _) in DECORATOR_TAINTS.items()}
RETURN = {d: r for d, (_, r) in DECORATOR_TAINTS.items()}


def first_decorator(annotations: DataFrame, key: list[str], name: str = "name", pos: str = "pos") -> DataFrame:
    """For each key the body and return taint of its first taint-giving decorator."""
    known = annotations.withColumns({"body": lookup(BODY, name), "ret": lookup(RETURN, name)}).filter("body is not null")
    first = known.groupBy(*key).agg(F.min_by(F.struct("body", "ret"), pos).alias("x"))
    return first.select(*key, F.col("x.body").alias("body_taint"), F.col("x.ret").alias("return_taint"))


def decorator_conflicts(annotations: DataFrame, key: list[str], name: str = "name", pos: str = "pos") -> DataFrame:
    """A row for each later decorator that disagrees with the first, for the body and for the return map."""
    known = annotations.withColumns({"body": lookup(BODY, name), "ret": lookup(RETURN, name)}).filter("body is not null")
    w = Window.partitionBy(*key).orderBy(pos)
    seen = known.withColumns({"first": F.first(F.struct(F.col(name).alias("name"), "body", "ret")).over(w)})
    both = F.array(F.struct(F.lit("body").alias("map"), F.col("first.body").alias("used"), F.col("body").alias("ignored")), F.struct(F.lit("return").alias("map"), F.col("first.ret").alias("used"), F.col("ret").alias("ignored")))
    return seen.select(*key, pos, F.col("first.name").alias("used_decorator"), F.col(name).alias("ignored_decorator"), F.explode(both).alias("x")).select("*", "x.*").drop("x").filter("used != ignored")


def assign_taints(functions: DataFrame, decorated: DataFrame, restored: DataFrame, defaults: DataFrame, key: list[str], file: str) -> DataFrame:
    """Precedence: decorator, restoration evidence, module default, UNKNOWN_RAW."""
    r = restored.select(*key, evidence_ceiling(F.col("structural"), F.col("semantic"), F.col("integrity"), F.col("institutional")).alias("__restored"))
    out = functions.join(decorated, key, "left").join(r, key, "left").join(defaults.select(file, F.col("default_taint").alias("__default")), file, "left")
    source = F.when(F.col("body_taint").isNotNull() | F.col("__restored").isNotNull(), "decorator").when(F.col("__default").isNotNull(), "module_default").otherwise("fallback")
    return out.withColumns({
        "taint_source": source,
        "body_taint": F.coalesce("body_taint", "__restored", "__default", F.lit("UNKNOWN_RAW")),
        "return_taint": F.coalesce("return_taint", "__restored", "__default", F.lit("UNKNOWN_RAW")),
    }).drop("__restored", "__default")
