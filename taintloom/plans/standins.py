"""Relations of the analysis, made from the driver's tables by SQL that Spark and DuckDB both read.

The tables hold no source code; each relation has the shape that an operator works on.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from taintloom.functions.domains import MATRIX, PAIRS, RANK, TAINTS, TIER

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark")
NOW = "1999-06-30"


def values(rows, *names: str) -> str:
    """A VALUES relation."""
    show = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") AS {names[0]}({', '.join(names[1:])})"


TAINT_AT = values([(i, t[0]) for i, t in enumerate(TAINTS)], "tv", "i", "taint")
MATRIX_SQL = values(MATRIX, "mx", "rule_id", "taint_state", "severity", "exceptionability")
RANK_SQL = values(list(RANK.items()), "rk", "taint", "rank")
TIER_SQL = values(list(TIER.items()), "tr", "taint", "tier")
PAIRS_SQL = values(PAIRS, "pr", "a", "b", "severity")
NAMES = ("external_boundary", "validates_shape", "validates_semantic", "integral_read", "fail_open", "fail_closed", "idempotent", "compensatable", "deterministic", "time_dependent", "int_data", "test_only")
NAME_AT = values(list(enumerate(NAMES)), "nv", "i", "name")

MODULES = (
    (0, "mod", "EXTERNAL_RAW"), (1, "mod/en", "GUARDED"), (2, "mod/en/1", "ASSURED"), (3, "mod/fr/", "INTEGRAL"), (4, "mod/de", "BOGUS"),
    (5, "mod/es", "ASSURED"), (6, "mod/en/2", "INTEGRAL"), (7, "mod/en/2", "MIXED_RAW"), (8, "mod/e", "GUARDED"), (9, "mod/fr/9/", "UNKNOWN_RAW"),
)

RELATIONS: dict[str, str] = {}
RELATIONS["findings"] = f"""
    SELECT e.event_id AS ordinal, 'PY-WL-00' || CAST(1 + e.event_id % 9 AS STRING) AS rule_id, tv.taint AS taint_state,
           'src/p' || CAST(e.user_id % 7 AS STRING) || '/m' || CAST(e.user_id % 40 AS STRING) || '.py' AS file_path,
           CAST(1 + e.event_id % 400 AS INT) AS line, CAST(e.event_id % 80 AS INT) AS col,
           CASE WHEN e.event_id % 17 <> 0 THEN e.event_type || CAST(e.user_id % 11 AS STRING) END AS qualname,
           CASE WHEN e.event_id % 13 = 0 THEN 'EXC-' || CAST(e.user_id % 50 AS STRING) END AS exception_id,
           CASE WHEN e.event_id % 19 <> 0 THEN 'f' || CAST(e.event_id % 3 AS STRING) END AS fingerprint,
           CAST(1 + e.event_id % 3 AS INT) AS analysis_level
    FROM events e JOIN {TAINT_AT} ON tv.i = CAST(floor(abs(e.value)) AS BIGINT) % 8"""
RELATIONS["module_tiers"] = "SELECT * FROM " + values(MODULES, "mt", "ordinal", "path", "default_taint")
# page addresses without scheme, host and query as paths: mod/<language>/<number>/<page>.py
RELATIONS["files"] = """
    SELECT page_id, 'mod/' || CASE page_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' WHEN 3 THEN 'es' ELSE 'english' END || '/'
           || CAST(page_id % 12 AS STRING) || '/p' || CAST(page_id AS STRING) || '.py' AS path, length(html) AS size FROM pages"""
RELATIONS["annotations"] = f"""
    SELECT 'src/f' || CAST(l.l_suppkey % 50 AS STRING) || '.py' AS file_path, 'fn' || CAST(l.l_orderkey % 3000 AS STRING) AS qualname,
           nv.name AS name, min(CAST(l.l_partkey * 10 + l.l_linenumber AS BIGINT)) AS pos
    FROM lineitem l JOIN {NAME_AT} ON nv.i = l.l_partkey % 12
    GROUP BY 'src/f' || CAST(l.l_suppkey % 50 AS STRING) || '.py', 'fn' || CAST(l.l_orderkey % 3000 AS STRING), nv.name"""
RELATIONS["functions"] = """
    SELECT DISTINCT 'src/f' || CAST(c_custkey % 50 AS STRING) || '.py' AS file_path, 'fn' || CAST(c_custkey AS STRING) AS qualname,
           CAST(c_custkey AS BIGINT) AS pos, CAST(1 + c_nationkey % 4 AS INT) AS tier FROM customer"""
RELATIONS["boundaries"] = """
    SELECT 'fn' || CAST(c_custkey * 3 AS STRING) AS function,
           CASE c_custkey % 5 WHEN 0 THEN 'shape_validation' WHEN 1 THEN 'semantic_validation' WHEN 2 THEN 'combined_validation' WHEN 3 THEN 'external_validation' ELSE 'restoration' END AS transition,
           'mod/' || CASE c_custkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'es' ELSE 'de' END AS overlay_path,
           CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 6 AS INT) END AS from_tier, CAST(1 + c_custkey % 4 AS INT) AS to_tier,
           CASE WHEN c_custkey % 3 = 0 THEN 'scope' END AS validation_scope,
           c_nationkey % 2 = 0 AS structural, c_nationkey % 3 = 0 AS semantic, c_nationkey % 5 = 0 AS integrity, c_acctbal > 3000 AS institutional,
           CAST(1 + c_nationkey % 4 AS INT) AS restored_tier
    FROM customer"""
RELATIONS["register"] = f"""
    SELECT 'EX' || CAST(o.o_orderkey AS STRING) AS id, CAST(o.o_orderkey AS BIGINT) AS ordinal, 'PY-WL-00' || CAST(1 + o.o_custkey % 9 AS STRING) AS rule_id,
           tv.taint AS taint_state,
           'src/p' || CAST(o.o_orderkey % 7 AS STRING) || '/m' || CAST(o.o_orderkey % 40 AS STRING) || '.py::' ||
           CASE o.o_custkey % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'signup' WHEN 2 THEN 'click' WHEN 3 THEN 'error' ELSE 'purchase' END || CAST(o.o_orderkey % 11 AS STRING) AS location,
           CASE WHEN o.o_orderkey % 10 = 0 THEN NULL WHEN o.o_orderkey % 23 = 0 THEN 'soon' ELSE CAST(CAST(o.o_orderdate AS DATE) AS STRING) END AS expires,
           CASE WHEN o.o_orderkey % 6 = 0 THEN 'expedited' ELSE 'standard' END AS governance_path,
           CASE WHEN o.o_orderkey % 8 = 0 THEN NULL WHEN o.o_orderkey % 9 = 0 THEN 'unknown' ELSE 'human' END AS provenance,
           CASE WHEN o.o_orderkey % 13 <> 0 THEN o.o_orderkey % 11 = 0 END AS agent_originated, CAST(o.o_orderkey % 4 AS INT) AS recurrence_count,
           'f' || CAST(o.o_orderkey % 3 AS STRING) AS ast_fingerprint, CAST(1 + o.o_custkey % 3 AS INT) AS analysis_level, o.o_orderkey % 29 = 0 AS drifted
    FROM orders o JOIN {TAINT_AT} ON tv.i = o.o_orderkey % 8"""
# one node for each order line, calls to the next line; every fifth order calls back, so cycles exist
RELATIONS["nodes"] = """
    SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS name, CAST(min(l_partkey % 8) AS INT) AS rank,
           CAST(max(l_suppkey % 8) AS INT) AS return_rank, min(l_returnflag) = 'A' AS anchored FROM lineitem GROUP BY l_orderkey, l_linenumber"""
RELATIONS["edges"] = """
    SELECT DISTINCT CAST(a.l_orderkey AS STRING) || '-' || CAST(a.l_linenumber AS STRING) AS src, CAST(b.l_orderkey AS STRING) || '-' || CAST(b.l_linenumber AS STRING) AS dst
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND (b.l_linenumber = a.l_linenumber + 1 OR (a.l_orderkey % 5 = 0 AND b.l_linenumber = a.l_linenumber - 2))"""
RELATIONS["baseline"] = """
    SELECT 'fn' || CAST(c_custkey AS STRING) AS qualname, CAST(c_nationkey AS STRING) || c_mktsegment AS annotation_hash, '1999-0' || CAST(1 + c_custkey % 9 AS STRING) || '-01' AS last_changed,
           CAST(c_custkey AS BIGINT) AS ordinal FROM customer WHERE c_custkey % 5 <> 0"""
RELATIONS["current"] = """
    SELECT 'fn' || CAST(c_custkey AS STRING) AS qualname, CAST(CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS STRING) || c_mktsegment AS annotation_hash,
           CASE WHEN c_custkey % 3 <> 0 THEN '1999-0' || CAST(1 + c_custkey % 8 AS STRING) || '-15' END AS last_changed, CAST(c_custkey AS BIGINT) AS ordinal FROM customer WHERE c_custkey % 7 <> 0"""
RELATIONS["specimens"] = f"""
    SELECT 'PY-WL-00' || CAST(1 + d.doc_id % 9 AS STRING) AS rule_id, tv.taint AS taint_state, d.lang AS category,
           CASE WHEN l.doc_id % 20 = 0 THEN 'known_false_negative' WHEN l.quality = 1 THEN 'true_positive' ELSE 'true_negative' END AS verdict, (l.toxic = 0) = (l.quality = 1) AS fired
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN {TAINT_AT} ON tv.i = d.n_chars % 8"""
# names of functions go up to fn2999: the later contracts have none
RELATIONS["bindings"] = "SELECT 'c' || CAST(s_suppkey AS STRING) AS contract, 'fn' || CAST(s_suppkey * 3 + 2900 AS STRING) AS f1, 'fn' || CAST(s_suppkey * 400 + 1000 AS STRING) AS f2 FROM supplier"
RELATIONS["base_rules"] = """
    SELECT 'R' || CAST(k AS STRING) AS rule_id, CASE k % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'INFO' ELSE 'CRITICAL' END AS severity, k % 3 = 0 AS unconditional
    FROM (SELECT DISTINCT p_size AS k FROM part) p"""
RELATIONS["overrides"] = """
    SELECT 'R' || CAST(s_suppkey % 60 AS STRING) AS rule_id, CASE s_nationkey % 5 WHEN 0 THEN 'OFF' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARNING' WHEN 3 THEN 'ERROR' ELSE 'CRITICAL' END AS severity,
           CAST(s_suppkey AS BIGINT) AS ordinal FROM supplier"""
RELATIONS["dependencies"] = """
    SELECT 'lib' || CAST(n_nationkey % 9 AS STRING) AS package, 'f' || CAST(n_nationkey AS STRING) AS function, CASE n_nationkey % 3 WHEN 0 THEN 'GUARDED' WHEN 1 THEN 'ASSURED' ELSE 'EXTERNAL_RAW' END AS taint FROM nation"""
RELATIONS["calls"] = """
    SELECT l_orderkey AS call_order, l_linenumber AS call_line, l_partkey AS call_part, 'lib' || CAST(l_suppkey % 14 AS STRING) || '.f' || CAST(l_partkey % 30 AS STRING) AS full_name FROM lineitem"""
RELATIONS["tiers_now"] = "SELECT 'm' || CAST(s_suppkey AS STRING) AS path, CAST(1 + s_nationkey % 4 AS INT) AS tier FROM supplier"
RELATIONS["tiers_then"] = "SELECT 'm' || CAST(s_suppkey AS STRING) AS path, CAST(1 + (s_nationkey + s_suppkey) % 4 AS INT) AS tier FROM supplier WHERE s_suppkey % 6 <> 0"


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation as a DataFrame over the tables of sf_dir."""
    words = set(re.findall(r"\w+", RELATIONS[name]))
    for t in words.intersection(TABLES):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(RELATIONS[name])


def with_relations(*names: str, then: str) -> str:
    """Oracle SQL: the relations as named subqueries before a statement."""
    return "WITH " + ", ".join(f"{n} AS ({RELATIONS[n]})" for n in names) + "\n" + then
