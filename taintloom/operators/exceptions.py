"""The register of exceptions: matching with fallthrough, drift, health, metrics and lifecycle.

`now` is always an argument, as an ISO date, so results do not depend on the day of the run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expired(expires: Column, now: str) -> Column:
    """Today is not yet expired; null never expires; an unreadable date is not expired here."""
    return F.coalesce(F.try_to_date(expires) < F.lit(now).cast("date"), F.lit(False))


def unreadable(expires: Column) -> Column:
    return expires.isNotNull() & F.try_to_date(expires).isNull()


def match(findings: DataFrame, register: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(findings with exception_id and severity after matching, governance rows for stale fingerprints).

    Candidates share rule, taint and location. In register order, level-stale, drifted, expired and unreadable
    ones are passed over; one with another fingerprint gives a stale row and the next is tried; the first left
    covers the finding. Unconditional findings, those without qualname and those without a current fingerprint
    are left as they are, without rows.
    """
    open_ = (F.col("exceptionability") != "UNCONDITIONAL") & F.col("qualname").isNotNull() & F.col("fingerprint").isNotNull()
    key = F.concat_ws("::", "file_path", "qualname")
    f = findings.withColumn("__location", F.when(open_, key))
    r = register.select(
        F.col("rule_id"), F.col("taint_state"), F.col("location").alias("__location"), F.col("id").alias("__id"), F.col("ordinal").alias("__at"), F.col("ast_fingerprint").alias("__print"), F.col("expires").alias("__expires"), F.col("analysis_level").alias("__level"), F.col("drifted").alias("__drifted")
    )
    passed = (F.col("__level") < F.col("analysis_level")) | F.col("__drifted") | expired(F.col("__expires"), now) | unreadable(F.col("__expires"))
    c = f.join(r, ["rule_id", "taint_state", "__location"]).filter(~F.coalesce(passed, F.lit(False)))
    good = F.coalesce(F.col("__print"), F.lit("")) == F.col("fingerprint")
    first = F.min_by(F.when(good, F.col("__id")), F.when(good, F.col("__at")))
    at = F.min(F.when(good, F.col("__at")))
    best = c.groupBy("ordinal").agg(first.alias("__match"), at.alias("__match_at"))
    done = f.join(best.select("ordinal", "__match"), "ordinal", "left")
    done = done.withColumns({"exception_id": F.coalesce("__match", "exception_id"), "severity": F.when(F.col("__match").isNotNull(), "SUPPRESS").otherwise(F.col("severity"))}).drop("__location", "__match")
    stale = c.filter(~good).join(best.select("ordinal", "__match_at"), "ordinal").filter(F.col("__match_at").isNull() | (F.col("__at") < F.col("__match_at")))
    # once for each finding: its first stale candidate
    rows = stale.groupBy("ordinal").agg(F.min_by("__id", "__at").alias("exception_id")).withColumn("rule_id", F.lit("GOVERNANCE-STALE-EXCEPTION"))
    return done, rows


def drift(register: DataFrame, functions: DataFrame) -> DataFrame:
    """Exceptions whose function now has another taint; functions are found by qualified name alone."""
    q = F.element_at(F.split("location", "::", 2), 2)
    f = functions.select("qualname", F.col("taint_state").alias("taint_now"))
    return register.withColumn("qualname", q).join(f, "qualname").filter("taint_now != taint_state").select("id", "qualname", F.col("taint_state").alias("taint_then"), "taint_now")


def health(register: DataFrame) -> DataFrame:
    """Rows for unknown provenance, recurrence of two or more, and no expiry."""
    rows = lambda condition, kind: register.filter(condition).select(F.lit(kind).alias("rule_id"), F.col("id").alias("exception_id"))
    checks = [
        rows(F.col("provenance").isNull() | (F.col("provenance") == "unknown"), "GOVERNANCE-UNKNOWN-PROVENANCE"),
        rows(F.col("recurrence_count") >= 2, "GOVERNANCE-RECURRING-EXCEPTION"),
        rows(F.col("expires").isNull(), "GOVERNANCE-NO-EXPIRY-EXCEPTION"),
    ]
    return reduce(DataFrame.unionByName, checks)


def level_stale(register: DataFrame, level: int) -> DataFrame:
    """Exceptions granted at a lower level of analysis than the scan's."""
    return register.filter(F.col("analysis_level") < level).select(F.lit("GOVERNANCE-EXCEPTION-LEVEL-STALE").alias("rule_id"), F.col("id").alias("exception_id"))


def metrics(register: DataFrame, now: str) -> DataFrame:
    """One row of counts; an unreadable date counts as active and is left out of the other counts."""
    bad = unreadable(F.col("expires"))
    active = ~expired(F.col("expires"), now)
    rest = active & ~bad
    expedited = F.count_if(rest & (F.col("governance_path") == "expedited"))
    return register.agg(
        F.count("*").alias("total"),
        F.count_if(active).alias("active"),
        F.count_if(~active).alias("expired"),
        F.count_if(rest & F.coalesce("agent_originated", F.lit(False))).alias("agent"),
        expedited.alias("expedited"),
        F.round(F.coalesce(expedited / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 4).alias("expedited_ratio"),
        F.count_distinct("governance_path").alias("n_paths"),
    )


def review(register: DataFrame, now: str, soon: int = 30) -> DataFrame:
    """One row: what a reviewer should look at."""
    due = F.datediff(F.try_to_date("expires"), F.lit(now).cast("date"))
    active = F.count_if(~expired(F.col("expires"), now))
    return register.agg(
        F.count_if(expired(F.col("expires"), now)).alias("expired"),
        F.count_if(due.between(0, soon)).alias("expiring"),
        F.count_if(F.col("provenance").isNull() | (F.col("provenance") == "unknown")).alias("unknown_provenance"),
        F.count_if(F.col("recurrence_count") >= 2).alias("recurring"),
        F.round(F.count_if(~expired(F.col("expires"), now) & (F.col("governance_path") == "expedited")) / F.nullif(active, F.lit(0)), 3).alias("expedited_ratio"),
    )


def next_recurrence(register: DataFrame, wanted: DataFrame) -> DataFrame:
    """The recurrence count of new exceptions: one more than the highest of their rule and location, else 0."""
    have = register.groupBy("rule_id", "location").agg(F.max("recurrence_count").alias("most"))
    return wanted.join(have, ["rule_id", "location"], "left").withColumn("recurrence_count", F.coalesce(F.col("most") + 1, F.lit(0))).drop("most")


def age_issues(register: DataFrame, now: str, longest: int = 365) -> DataFrame:
    """Expired exceptions, and those granted for longer than the limit."""
    ends = F.try_to_date("expires")
    today = F.lit(now).cast("date")
    detail = F.when(ends < today, "expired").when(F.datediff(ends, today) > longest, "too far")
    return register.select("id", detail.alias("detail")).filter("detail is not null")


def refresh(register: DataFrame, ids: list[str], by: str, why: str, now: str, expires: str) -> DataFrame:
    """A new version of the register with some exceptions renewed."""
    hit = F.col("id").isin(*ids)
    new = {"last_refreshed_by": by, "last_refresh_rationale": why, "last_refreshed_at": now, "expires": expires}
    return register.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k) if k in register.columns else F.lit(None)) for k, v in new.items()})


def expire(register: DataFrame, ids: list[str], yesterday: str) -> DataFrame:
    """A new version of the register with some exceptions ended the day before."""
    return register.withColumn("expires", F.when(F.col("id").isin(*ids), F.lit(yesterday)).otherwise(F.col("expires")))


def migrate(register: DataFrame, drifted: DataFrame, matrix: DataFrame) -> DataFrame:
    """A new version of the register with drifted exceptions moved to the taint of now, where that is not unconditional."""
    cell = matrix.select("rule_id", F.col("taint_state").alias("taint_now"), F.col("exceptionability").alias("__to"))
    moves = register.select("id", "rule_id").join(drifted.select("id", "taint_now"), "id").join(cell, ["rule_id", "taint_now"]).filter("__to != 'UNCONDITIONAL'").groupBy("id").agg(F.min("taint_now").alias("taint_now"))
    moved = register.join(moves, "id", "left")
    return moved.withColumns({"migrated_from": F.when(F.col("taint_now").isNotNull(), F.col("taint_state")), "taint_state": F.coalesce("taint_now", "taint_state")}).drop("taint_now")


def ranked(register: DataFrame) -> DataFrame:
    """The register with its order within each key, as matching uses it."""
    return register.withColumn("candidate", F.row_number().over(Window.partitionBy("rule_id", "taint_state", "location").orderBy("ordinal")))


def scan_stats(register: DataFrame, now: str) -> DataFrame:
    """One row: active exceptions and the share of expedited ones among them."""
    live = ~expired(F.col("expires"), now)
    ratio = F.count_if(live & (F.col("governance_path") == "expedited")) / F.nullif(F.count_if(live), F.lit(0))
    return register.agg(F.count_if(live).alias("active"), F.round(F.coalesce(ratio, F.lit(0.0)), 4).alias("ratio"))


def grant(register: DataFrame, wanted: DataFrame, matrix: DataFrame) -> DataFrame:
    """wanted (id, rule_id, taint_state, location, expires, agent_originated, ast_fingerprint, ...) with what a register
    row needs: exceptionability, severity_at_grant, recurrence_count and provenance; and `refused`, the first reason
    against each, or null. Granted rows are those without a reason."""
    cell = matrix.select("rule_id", "taint_state", "exceptionability", F.col("severity").alias("severity_at_grant"))
    known = wanted.join(F.broadcast(cell), ["rule_id", "taint_state"], "left")
    reason = (
        F.when(F.col("exceptionability").isNull(), "no such rule or taint")
        .when(F.col("exceptionability") == "UNCONDITIONAL", "unconditional")
        .when(F.coalesce(~F.contains("location", F.lit("::")), F.lit(True)), "location is not path::name")
        .when(F.col("agent_originated") & F.col("expires").isNull(), "an agent's exception must end")
        .when(unreadable(F.col("expires")), "unreadable date")
        .when(F.trim(F.coalesce("ast_fingerprint", F.lit(""))) == "", "no fingerprint")
    )
    return next_recurrence(register, known.withColumns({"refused": reason, "provenance": F.lit("cli")}))


def preview_drift(register: DataFrame, functions: DataFrame, matrix: DataFrame) -> DataFrame:
    """Exceptions whose function has another taint now, with the cell that they would move to and whether they may."""
    cell = matrix.select("rule_id", F.col("taint_state").alias("taint_now"), F.col("exceptionability").alias("would_be"))
    moved = drift(register, functions).join(register.select("id", "rule_id"), "id")
    return moved.join(F.broadcast(cell), ["rule_id", "taint_now"], "left").select("id", "taint_then", "taint_now", "would_be", F.coalesce(F.col("would_be") != "UNCONDITIONAL", F.lit(False)).alias("may_move"))
