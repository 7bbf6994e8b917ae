"""Matching of paths against policy paths.

A path's prefixes are few, policy paths may be many: each path is exploded into its ancestors, which are
joined by equality. That is a hash join instead of a nested loop, whatever the size of the policy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_scope(path: Column, scope: Column) -> Column:
    """Component-wise prefix; an empty scope holds nothing."""
    bare = F.rtrim(scope, F.lit("/"))
    return (scope != "") & ((path == bare) | F.startswith(path, F.concat(bare, F.lit("/"))))


def ancestors(path: Column) -> Column:
    """The path itself and every leading part of its components."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def longest_prefix(left: DataFrame, path: str, policy: DataFrame, policy_path: str, value: str, ordinal: str, by_parts: bool = False) -> DataFrame:
    """left with the `value` of the longest policy path that holds it, null where none does.

    Longest by characters, or by components with by_parts; ties go to the smallest ordinal. Whether the
    winner's value is valid is for the caller: an invalid winner still hides shorter ones.
    """
    p = policy.select(F.rtrim(F.col(policy_path), F.lit("/")).alias("__prefix"), F.col(policy_path).alias("__raw"), F.col(value).alias(value), F.col(ordinal).alias("__ordinal")).filter("__prefix != ''")
    size = F.size(F.split("__raw", "/")) if by_parts else F.char_length("__raw")
    # one row for each policy path: its first
    best = p.groupBy("__prefix").agg(F.min_by(F.struct(size.alias("size"), F.col(value).alias("value"), F.col("__ordinal").alias("ordinal")), F.struct(-size, F.col("__ordinal"))).alias("__best"))
    paths = left.select(path).distinct()
    hits = paths.withColumn("__prefix", F.explode(ancestors(F.col(path)))).join(best, "__prefix")
    won = hits.groupBy(path).agg(F.max_by("__best.value", F.struct(F.col("__best.size"), -F.col("__best.ordinal"))).alias(value))
    return left.join(won, path, "left")


def ends_with_component(scope: Column, path: Column) -> Column:
    """Whether the path is a trailing part of the scope."""
    return F.endswith(scope, F.concat(F.lit("/"), path))


def module_name(path: Column) -> Column:
    """Dotted name of a source file; that of a package for its __init__, null for a root one."""
    dotted = F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))
    return F.when(dotted == "__init__", F.lit(None)).otherwise(F.regexp_replace(dotted, r"\.__init__$", ""))


def scope_suffix(left: DataFrame, key: str, scope: str, policy: DataFrame, policy_path: str, ordinal: str) -> DataFrame:
    """(key, ordinal): the first policy path that is a trailing part of each row's scope, null where none is.

    A scope's trailing parts are few: they are joined by equality.
    """
    parts = F.split(scope, "/")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    hits = left.select(key, F.explode(tails).alias("__path")).join(policy.select(F.col(policy_path).alias("__path"), ordinal), "__path")
    return left.select(key).join(hits.groupBy(key).agg(F.min(ordinal).alias(ordinal)), key, "left")
