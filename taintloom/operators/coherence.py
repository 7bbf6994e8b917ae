"""Coherence of policy and code: anti-joins between inventories, and checks of policy rows.

Every check gives rows (kind, function, file_path, detail).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintloom.functions.domains import COHERENCE_ERRORS, COHERENCE_POLICY, OVERRIDE_RANK, PAIRS
from taintloom.functions.lattice import evidence_ceiling, lookup, rank


def issues(df: DataFrame, kind: str, function: Column, file_path: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), function.alias("function"), file_path.alias("file_path"), detail.alias("detail"))


def orphaned_annotations(annotations: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Annotated functions that no boundary declares."""
    left = annotations.join(boundaries.select(F.col("function").alias("qualname")), "qualname", "left_anti")
    left = left.groupBy("file_path", "qualname").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return issues(left, "orphaned_annotation", F.col("qualname"), F.col("file_path"), F.col("names"))


def undeclared_boundaries(boundaries: DataFrame, annotations: DataFrame) -> DataFrame:
    """Declared boundaries that no annotation carries."""
    left = boundaries.join(annotations.select(F.col("qualname").alias("function")), "function", "left_anti")
    return issues(left, "undeclared_boundary", F.col("function"), F.col("overlay_path"), F.col("transition"))


def unmatched_contracts(bindings: DataFrame, annotations: DataFrame) -> DataFrame:
    """Contracts of which no bound function is annotated; bindings (contract, functions)."""
    bound = bindings.select("contract", F.explode_outer("functions").alias("qualname"))
    met = bound.join(annotations.select("qualname"), "qualname", "left_semi").select("contract")
    left = bindings.select("contract").distinct().join(met, "contract", "left_anti")
    return issues(left, "unmatched_contract", F.col("contract"), F.lit(""), F.lit("no bound function"))


def stale_bindings(bindings: DataFrame, functions: DataFrame) -> DataFrame:
    """Bound functions that do not exist."""
    bound = bindings.select("contract", F.explode("functions").alias("qualname"))
    left = bound.join(functions.select("qualname"), "qualname", "left_anti")
    return issues(left, "stale_contract_binding", F.col("qualname"), F.lit(""), F.col("contract"))


def tier_changes(current: DataFrame, baseline: DataFrame, evidenced: DataFrame) -> DataFrame:
    """Paths whose tier grew (a downgrade), or shrank without evidence (an upgrade); both have path and tier."""
    both = current.select("path", F.col("tier").alias("new")).join(baseline.select("path", F.col("tier").alias("old")), "path")
    detail = F.concat_ws("->", F.col("old").cast("string"), F.col("new").cast("string"))
    down = issues(both.filter("new > old"), "tier_downgrade", F.lit(""), F.col("path"), detail)
    up = both.filter("new < old").join(evidenced.select("path"), "path", "left_anti")
    return down.unionByName(issues(up, "tier_upgrade_without_evidence", F.lit(""), F.col("path"), detail))


def evidence_divergence(boundaries: DataFrame, annotations: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence that boundary and annotation state differently, one row for each key; null is absence."""
    b = boundaries.select(F.col("function").alias("qualname"), F.struct(*[F.col(k).cast("string").alias(k) for k in keys]).alias("b"))
    a = annotations.groupBy("qualname").agg(F.min_by(F.struct(*[F.col(k).cast("string").alias(k) for k in keys]), "pos").alias("a"))
    rows = b.join(a, "qualname").select("qualname", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"b.{k}").alias("declared"), F.col(f"a.{k}").alias("found")) for k in keys])).alias("x")).select("qualname", "x.*")
    differs = rows.filter(~F.col("declared").eqNullSafe(F.col("found")))
    detail = F.concat(F.col("key"), F.lit(":"), F.coalesce("declared", F.lit("-")), F.lit("/"), F.coalesce("found", F.lit("-")))
    return issues(differs, "restoration_evidence_divergence", F.col("qualname"), F.lit(""), detail)


def permissive_distribution(modules: DataFrame, limit: float = 60.0) -> DataFrame:
    """Whether more than the limit of module tiers, in percent, are 3 or 4."""
    share = F.count_if(F.col("tier") >= 3) * 100.0 / F.count("*")
    return modules.agg(F.count("*").alias("n"), F.round(share, 3).alias("pct")).withColumn("permissive", F.coalesce(F.col("pct") > limit, F.lit(False)))


def tier_topology(boundaries: DataFrame, modules: DataFrame) -> DataFrame:
    """Boundaries with a tier outside 1 to 4, and such whose from_tier is not that of their module."""
    tier_ok = lambda c: F.col(c).isNull() | F.col(c).between(1, 4)
    bad = boundaries.filter(~tier_ok("from_tier") | ~tier_ok("to_tier"))
    off = boundaries.filter(tier_ok("from_tier")).join(modules.select(F.col("path").alias("overlay_path"), "tier"), "overlay_path").filter("from_tier != tier")
    one = issues(bad, "tier_topology_inconsistency", F.col("function"), F.col("overlay_path"), F.lit("invalid tier"))
    return one.unionByName(issues(off, "tier_topology_inconsistency", F.col("function"), F.col("overlay_path"), F.concat_ws("!=", F.col("from_tier").cast("string"), F.col("tier").cast("string"))))


def missing_scope(boundaries: DataFrame) -> DataFrame:
    """Validation boundaries without a validation scope."""
    need = F.col("transition").isin("semantic_validation", "combined_validation", "external_validation")
    return issues(boundaries.filter(need & F.col("validation_scope").isNull()), "missing_validation_scope", F.col("function"), F.col("overlay_path"), F.col("transition"))


def weak_restoration(restored: DataFrame) -> DataFrame:
    """Restorations that claim a more trusted tier than their evidence supports."""
    from taintloom.functions.lattice import tier

    ceiling = tier(evidence_ceiling(F.col("structural"), F.col("semantic"), F.col("integrity"), F.col("institutional")))
    claimed = restored.withColumn("ceiling", ceiling).filter("restored_tier < ceiling")
    return issues(claimed, "insufficient_restoration_evidence", F.col("function"), F.col("overlay_path"), F.concat_ws("<", F.col("restored_tier").cast("string"), F.col("ceiling").cast("string")))


def with_policy(all_issues: DataFrame) -> DataFrame:
    """Issues with severity and category."""
    k = F.col("kind")
    return all_issues.withColumns({"severity": F.when(k.isin(*COHERENCE_ERRORS), "ERROR").otherwise("WARNING"), "category": F.when(k.isin(*COHERENCE_POLICY), "policy").otherwise("enforcement")})


def union(*checks: DataFrame) -> DataFrame:
    return with_policy(reduce(DataFrame.unionByName, checks))


def contradictions(annotations: DataFrame) -> DataFrame:
    """Contradictory pairs on one function: its set of names against each fixed pair."""
    names = annotations.groupBy("file_path", "qualname").agg(F.collect_set("name").alias("names"))
    known = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.lit(s).alias("severity")) for a, b, s in PAIRS])
    hit = F.filter(known, lambda p: F.array_contains(F.col("names"), p["left"]) & F.array_contains(F.col("names"), p["right"]))
    return names.select("file_path", "qualname", F.explode(hit).alias("p")).select("file_path", "qualname", "p.left", "p.right", "p.severity")


def incomplete_fields(declared: DataFrame, accessed: DataFrame) -> DataFrame:
    """Declared fields of a class that a function mapping all of them does not access; a missing class is one row."""
    left = declared.join(accessed, ["qualname"], "left").withColumn("missing", F.array_sort(F.array_except("fields", F.coalesce("attributes", F.array().cast("array<string>")))))
    return left.filter(F.col("fields").isNull() | (F.size("missing") > 0)).select("qualname", F.coalesce(F.array_join("missing", ","), F.lit("no such class")).alias("detail"))


def merge_overrides(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Rule overrides after an overlay, with what is wrong with each of its rows: it may only narrow, name known
    rules and not switch off a rule with an unconditional cell. Its last row for a rule counts."""
    last = overlay.groupBy("rule_id").agg(F.max_by("severity", "ordinal").alias("wanted"))
    both = base.join(last, "rule_id", "full")
    have, want = F.coalesce(lookup(OVERRIDE_RANK, "severity"), F.lit(-1)), F.coalesce(lookup(OVERRIDE_RANK, "wanted"), F.lit(-1))
    wrong = (
        F.when(F.col("wanted").isNull(), "")
        .when(F.col("severity").isNull(), "new rule")
        .when((F.col("wanted") == "OFF") & F.col("unconditional"), "cannot switch off")
        .when(want < have, "widens")
        .otherwise("")
    )
    return both.select("rule_id", F.coalesce("wanted", "severity").alias("severity"), wrong.alias("wrong"))


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def governing(fields: DataFrame, boundaries: DataFrame, transitions: list[str]) -> DataFrame:
    """Fields governed by a boundary: same function and scope, a transition of the list, path within the scope."""
    from taintloom.operators.paths import in_scope

    b = boundaries.filter(F.col("transition").isin(*transitions)).select(F.col("function").alias("qualname"), F.col("overlay_scope").alias("scope"))
    return fields.filter(in_scope(F.col("path"), F.col("scope"))).join(b, ["qualname", "scope"], "left_semi")


def overclaimed(functions: DataFrame) -> DataFrame:
    """Restored functions whose claimed taint has a lower rank than their evidence allows."""
    ceiling = evidence_ceiling(F.col("structural"), F.col("semantic"), F.col("integrity"), F.col("institutional"))
    return functions.withColumn("ceiling", ceiling).filter(rank("claimed") < rank("ceiling"))


def test_only_imports(imports: DataFrame, modules: DataFrame, only: DataFrame) -> DataFrame:
    """Imports (name, module, ...) of names that a module (module, provider) marks test-only (provider, name)."""
    return imports.join(modules, "module").join(only.select("provider", "name"), ["provider", "name"], "left_semi")


test_only_imports.__test__ = False


def multi_tier_classes(methods: DataFrame, *by: str) -> DataFrame:
    """Classes whose methods have more than one tier."""
    return methods.groupBy(*by).agg(F.count_distinct("tier").alias("n_tiers")).filter("n_tiers > 1")


def dependency_taints(calls: DataFrame, declared: DataFrame, full_name: str = "full_name") -> DataFrame:
    """calls with the taint that the manifest declares for the dependency they call; declared (package, function, taint).

    A call of a declared package to another function than its declared ones is UNKNOWN_RAW; calls elsewhere have null.
    """
    exact = declared.select(F.concat_ws(".", "package", "function").alias(full_name), F.col("taint").alias("__taint")).dropDuplicates([full_name])
    packages = declared.select(F.col("package").alias("__package")).distinct().withColumn("__known", F.lit(True))
    package = F.substring_index(full_name, ".", 1)
    out = calls.join(exact, full_name, "left").withColumn("__package", package).join(packages, "__package", "left")
    return out.withColumn("taint", F.coalesce("__taint", F.when(F.col("__known"), "UNKNOWN_RAW"))).drop("__taint", "__package", "__known")


def tier_distribution(modules: DataFrame, limit: float = 60.0) -> DataFrame:
    """An issue where more than the limit of module tiers are permissive."""
    share = permissive_distribution(modules, limit).filter("permissive")
    return issues(share, "tier_distribution", F.lit(""), F.lit(""), F.col("pct").cast("string"))


def agent_provenance(register: DataFrame) -> DataFrame:
    """Exceptions of which it is not known whether an agent asked for them."""
    return issues(register.filter("agent_originated is null"), "agent_originated_exception", F.lit(""), F.col("location"), F.col("id"))


def exception_ages(register: DataFrame, now: str, longest: int = 365) -> DataFrame:
    """Exceptions that have ended, end too late, or have no date that can be read."""
    ends, today = F.try_to_date("expires"), F.lit(now).cast("date")
    what = F.when(F.col("expires").isNotNull() & ends.isNull(), "unreadable").when(ends < today, "expired").when(F.datediff(ends, today) > longest, "too far")
    return issues(register.withColumn("what", what).filter("what is not null"), "expired_exception", F.lit(""), F.col("location"), F.concat_ws(" ", "id", "what"))


def first_scan(spark, perimeter: str | None) -> DataFrame:
    """An issue where no baseline of the perimeter exists."""
    rows = [] if perimeter else [("first_scan_perimeter", "", "", "no baseline of the perimeter")]
    return spark.createDataFrame(rows, "kind string, function string, file_path string, detail string")


def every_check(
    annotations: DataFrame, boundaries: DataFrame, modules: DataFrame, modules_then: DataFrame, evidenced: DataFrame, register: DataFrame,
    bindings: DataFrame, functions: DataFrame, stated: DataFrame, keys: list[str], now: str, perimeter: str | None,
) -> DataFrame:
    """The issues of all fourteen checks, with severity and category."""
    return union(
        orphaned_annotations(annotations, boundaries),
        undeclared_boundaries(boundaries, annotations),
        tier_distribution(modules),
        tier_changes(modules, modules_then, evidenced),  # two checks: downgrades, and upgrades without evidence
        agent_provenance(register),
        exception_ages(register, now),
        first_scan(annotations.sparkSession, perimeter),
        unmatched_contracts(bindings, annotations),
        stale_bindings(bindings, functions),
        tier_topology(boundaries, modules),
        missing_scope(boundaries),
        weak_restoration(boundaries),
        evidence_divergence(boundaries, stated, keys),
    )


def suppressing_overrides(overrides: DataFrame) -> DataFrame:
    """Overrides that silence a rule."""
    return overrides.filter(F.upper("severity").isin("SUPPRESS", "OFF")).select("rule_id", F.upper("severity").alias("severity"))


def widening_boundaries(boundaries: DataFrame) -> DataFrame:
    """Boundaries to a less trusted tier."""
    return boundaries.filter("to_tier > from_tier").select("function", "from_tier", "to_tier")
