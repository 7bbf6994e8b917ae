"""The registered queries: an operator over stand-in relations, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintloom.functions import domains as D
from taintloom.functions import lattice as L
from taintloom.operators import coherence as C
from taintloom.operators import corpus as K
from taintloom.operators import exceptions as X
from taintloom.operators import findings as R
from taintloom.operators import fingerprints as P
from taintloom.operators import functions_level as T
from taintloom.operators import graph as G
from taintloom.operators import local_graph as LG
from taintloom.operators import paths as W
from taintloom.operators import regime as M
from taintloom.plans import samples as S
from taintloom.plans.standins import MATRIX_SQL, NOW, PAIRS_SQL, RANK_SQL, TIER_SQL, relation, values, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The statement of each query without its relations.
STATEMENTS: dict[str, str] = {}


def query(name: str, relations: str, sql: str | None):
    """Register f(*relations) under a name, with the SQL that gives its rows."""
    names = relations.split()

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[relation(spark, sf_dir, n) for n in names])
        if sql is not None:
            STATEMENTS[name] = sql
            ORACLES[name] = with_relations(*names, then=sql)
        return f

    return register


def nested(name: str) -> str:
    """A query's statement, to stand within another that has its relations."""
    sql = STATEMENTS[name]
    return "(WITH" + sql[1:] + ")" if sql.startswith(",") else f"({sql})"


def literal(df: DataFrame, rows, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


JOINED = "CASE WHEN min({0}) = max({0}) THEN min({0}) WHEN bool_and({0} LIKE 'UNKNOWN\\_%' ESCAPE '\\') THEN arg_max({0}, {1}) ELSE 'MIXED_RAW' END"
SEVERE = f"severe AS (SELECT f.*, mx.severity, mx.exceptionability FROM findings f JOIN {MATRIX_SQL} ON mx.rule_id = f.rule_id AND mx.taint_state = f.taint_state)"
BREAKDOWN = """count_if(severity = 'ERROR')::BIGINT AS n_error, count_if(severity = 'WARNING')::BIGINT AS n_warning, count_if(severity = 'SUPPRESS')::BIGINT AS n_suppress,
    count_if(severity = 'ERROR' AND exception_id IS NOT NULL)::BIGINT AS n_excepted, count_if(severity = 'ERROR' AND exception_id IS NULL)::BIGINT AS n_blocking"""


# findings ---------------------------------------------------------------------------------------------


@query("j1_severity_lookup", "findings", f", {SEVERE} SELECT ordinal, rule_id, taint_state, severity, exceptionability FROM severe")
def _(findings):
    return R.with_severity(findings).select("ordinal", "rule_id", "taint_state", "severity", "exceptionability")


@query("a1_taint_join", "findings", f"SELECT file_path, {JOINED.format('f.taint_state', 'rk.rank')} AS taint, arg_max(f.taint_state, rk.rank) AS least_trusted FROM findings f JOIN {RANK_SQL} ON rk.taint = f.taint_state GROUP BY file_path")
def _(findings):
    return findings.groupBy("file_path").agg(L.taint_join("taint_state").alias("taint"), L.least_trusted("taint_state").alias("least_trusted"))


@query("a1_taint_join_of_callers", "findings", f"SELECT qualname, line, {JOINED.format('f.taint_state', 'rk.rank')} AS taint FROM findings f JOIN {RANK_SQL} ON rk.taint = f.taint_state GROUP BY qualname, line")
def _(findings):
    return findings.groupBy("qualname", "line").agg(L.taint_join("taint_state").alias("taint"))


@query("a2_p10_gate", "findings", f", {SEVERE} SELECT rule_id, {BREAKDOWN} FROM severe GROUP BY rule_id")
def _(findings):
    return R.breakdown(R.with_severity(findings), "rule_id")


@query("a3_run_counters", "findings", f", {SEVERE} SELECT {BREAKDOWN} FROM severe")
def _(findings):
    return R.breakdown(R.with_severity(findings))


@query("a4_worst_severity", "findings", f", {SEVERE} SELECT rule_id, arg_max(severity, CASE severity WHEN 'ERROR' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) AS worst FROM severe GROUP BY rule_id")
def _(findings):
    return R.worst_by_rule(R.with_severity(findings))


@query("a5_unknown_share", "findings", "SELECT count_if(taint_state = 'UNKNOWN_RAW')::BIGINT AS n_unknown, round(count_if(taint_state = 'UNKNOWN_RAW') / 500::DOUBLE * 100, 3) AS pct FROM findings")
def _(findings):
    return R.unknown_share(findings, 500)


@query("k1_report_order", "findings", f""", {SEVERE} SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY line, col, rule_id, ordinal)::INT AS place, ordinal, rule_id,
    CASE severity WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'note' END AS level, line, col + 1 AS start_column, coalesce(taint_state, 'UNKNOWN') AS taint FROM severe""")
def _(findings):
    return R.report_rows(R.with_severity(findings))


DISABLED = [("PY-WL-002",), ("PY-WL-008",)]


@query("p5_disabled_rules", "findings", "SELECT rule_id, count(*)::BIGINT AS n FROM findings WHERE rule_id NOT IN ('PY-WL-002', 'PY-WL-008') GROUP BY rule_id UNION ALL SELECT 'GOVERNANCE-RULE-DISABLED:ERROR', 1 UNION ALL SELECT 'GOVERNANCE-RULE-DISABLED:WARNING', 1")
def _(findings):
    disabled = literal(findings, DISABLED, "rule_id string")
    notes = R.governance_of_disabled(disabled).select(F.concat_ws(":", "rule_id", "severity").alias("rule_id"), F.lit(1).cast("long").alias("n"))
    return R.disable_rules(findings, disabled).groupBy("rule_id").agg(F.count("*").alias("n")).unionByName(notes)


@query("a15_preview_report", "findings", "SELECT exception_id, count(*)::BIGINT AS n, string_agg(rule_id || '@' || ordinal, ';' ORDER BY ordinal) AS reasons FROM findings WHERE exception_id IS NOT NULL GROUP BY exception_id")
def _(findings):
    return R.preview(findings)


@query("a19_control_law", "findings", "SELECT string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS degradations, CASE WHEN count(*) = 0 THEN 'normal' ELSE 'alternate' END AS law FROM findings WHERE rule_id IN ('PY-WL-008', 'PY-WL-009')")
def _(findings):
    return M.control_law(findings.filter(F.col("rule_id").isin("PY-WL-008", "PY-WL-009")).select(F.col("rule_id").alias("kind")))


@query("v17_exit_codes", "findings", f", {SEVERE} SELECT file_path, CASE WHEN count_if(rule_id = 'PY-WL-003' AND line = 7) > 0 THEN 3 WHEN count_if(severity = 'ERROR' AND exception_id IS NULL) > 0 THEN 1 ELSE 0 END AS exit_code FROM severe GROUP BY file_path")
def _(findings):
    return R.exit_codes(R.with_severity(findings), (F.col("rule_id") == "PY-WL-003") & (F.col("line") == 7), "file_path")


# paths ------------------------------------------------------------------------------------------------

VALID = "('INTEGRAL','ASSURED','GUARDED','EXTERNAL_RAW','UNKNOWN_RAW','UNKNOWN_GUARDED','UNKNOWN_ASSURED','MIXED_RAW')"
LONGEST = """, won AS (SELECT f.path, m.default_taint, row_number() OVER (PARTITION BY f.path ORDER BY {size} DESC, m.ordinal) AS n
    FROM (SELECT DISTINCT path FROM files) f JOIN module_tiers m ON f.path = rtrim(m.path, '/') OR starts_with(f.path, rtrim(m.path, '/') || '/'))"""
BY_CHARS = LONGEST.format(size="length(m.path)")


def _module_default(files, module_tiers):
    return W.longest_prefix(files, "path", module_tiers, "path", "default_taint", "ordinal")


@query("j2_module_default", "files module_tiers", BY_CHARS + f" SELECT f.page_id, f.path, CASE WHEN w.default_taint IN {VALID} THEN w.default_taint END AS taint FROM files f LEFT JOIN won w ON w.path = f.path AND w.n = 1")
def _(files, module_tiers):
    return _module_default(files, module_tiers).select("page_id", "path", F.when(L.rank("default_taint").isNotNull(), F.col("default_taint")).alias("taint"))


@query("j3_file_tier", "files module_tiers", BY_CHARS + f" SELECT f.page_id, coalesce(tr.tier, 4) AS tier FROM files f LEFT JOIN won w ON w.path = f.path AND w.n = 1 LEFT JOIN {TIER_SQL} ON tr.taint = w.default_taint")
def _(files, module_tiers):
    return _module_default(files, module_tiers).select("page_id", F.coalesce(L.tier("default_taint"), F.lit(4)).alias("tier"))


TIER_IDS = [("GUARDED", 2), ("ASSURED", 1), ("INTEGRAL", 1), ("MIXED_RAW", 4), ("UNKNOWN_RAW", 4)]


@query("j4_fingerprint_tier", "files module_tiers", f""", known AS (SELECT m.*, ti.tier FROM module_tiers m JOIN {values(TIER_IDS, 'ti', 'id', 'tier')} ON ti.id = m.default_taint),
    best AS (SELECT f.path, k.tier, row_number() OVER (PARTITION BY f.path ORDER BY length(k.path) DESC, k.ordinal) AS n FROM (SELECT DISTINCT path FROM files) f JOIN known k ON f.path = rtrim(k.path, '/') OR starts_with(f.path, rtrim(k.path, '/') || '/'))
    SELECT f.page_id, coalesce(b.tier, 4) AS tier FROM files f LEFT JOIN best b ON b.path = f.path AND b.n = 1""")
def _(files, module_tiers):
    known = module_tiers.join(F.broadcast(literal(files, TIER_IDS, "default_taint string, tier int")), "default_taint")
    return W.longest_prefix(files, "path", known, "path", "tier", "ordinal").select("page_id", F.coalesce("tier", F.lit(4)).alias("tier"))


@query("j5_overlay_tier", "files module_tiers", f""", best AS (SELECT f.path, tr.tier, row_number() OVER (PARTITION BY f.path ORDER BY length(m.path) DESC, m.ordinal) AS n
    FROM (SELECT DISTINCT path FROM files) f JOIN module_tiers m ON f.path = m.path OR starts_with(f.path, m.path || '/') JOIN {TIER_SQL} ON tr.taint = m.default_taint)
    SELECT f.page_id, b.tier FROM files f LEFT JOIN best b ON b.path = f.path AND b.n = 1""")
def _(files, module_tiers):
    # here a trailing slash in the policy path prevents the match
    known = module_tiers.withColumn("tier", L.tier("default_taint")).filter("tier is not null and not endswith(path, '/')")
    return W.longest_prefix(files, "path", known, "path", "tier", "ordinal").select("page_id", "tier")


@query("j7_field_scope", "files module_tiers", LONGEST.format(size="len(string_split(m.path, '/'))") + " SELECT f.page_id, w.default_taint AS value FROM files f LEFT JOIN won w ON w.path = f.path AND w.n = 1")
def _(files, module_tiers):
    return W.longest_prefix(files, "path", module_tiers, "path", "default_taint", "ordinal", by_parts=True).select("page_id", F.col("default_taint").alias("value"))


@query("j6_scope_suffix", "files module_tiers", """, hit AS (SELECT f.page_id, m.ordinal, row_number() OVER (PARTITION BY f.page_id ORDER BY m.ordinal) AS n FROM files f JOIN module_tiers m ON ends_with('root/' || regexp_replace(f.path, '/p[0-9]+\\.py$', ''), '/' || m.path))
    SELECT f.page_id, h.ordinal FROM files f LEFT JOIN hit h ON h.page_id = f.page_id AND h.n = 1""")
def _(files, module_tiers):
    f = files.withColumn("scope", F.concat(F.lit("root/"), F.regexp_replace("path", r"/p[0-9]+\.py$", "")))
    return W.scope_suffix(f, "page_id", "scope", module_tiers, "path", "ordinal")


@query("p7_path_in_scope", "files", "SELECT page_id, path = 'mod/en' OR starts_with(path, 'mod/en/') AS in_en, false AS in_none FROM files")
def _(files):
    return files.select("page_id", W.in_scope(F.col("path"), F.lit("mod/en/")).alias("in_en"), W.in_scope(F.col("path"), F.lit("")).alias("in_none"))


@query("s4_module_names", "files", "SELECT page_id, replace(regexp_replace(CASE WHEN page_id % 6 = 0 THEN regexp_replace(path, 'p[0-9]+', '__init__') ELSE path END, '(/__init__)?\\.py$', ''), '/', '.') AS module FROM files")
def _(files):
    path = F.when(F.col("page_id") % 6 == 0, F.regexp_replace("path", "p[0-9]+", "__init__")).otherwise(F.col("path"))
    return files.select("page_id", W.module_name(path).alias("module"))


# taints of functions ----------------------------------------------------------------------------------

DECO_SQL = values([(d, b, r) for d, (b, r) in D.DECORATOR_TAINTS.items()], "dt", "name", "body", "ret")
CEILING = """CASE WHEN NOT structural THEN 'UNKNOWN_RAW' WHEN NOT institutional THEN CASE WHEN semantic THEN 'UNKNOWN_ASSURED' ELSE 'UNKNOWN_GUARDED' END
    WHEN semantic AND integrity THEN 'INTEGRAL' WHEN semantic THEN 'ASSURED' ELSE 'GUARDED' END"""
FIRST = f""", first AS (SELECT file_path, qualname, arg_min(dt.body, a.pos) AS body_taint, arg_min(dt.ret, a.pos) AS return_taint FROM annotations a JOIN {DECO_SQL} ON dt.name = a.name GROUP BY file_path, qualname)"""
DEFAULTS = [("src/f1.py", "GUARDED"), ("src/f2.py", "ASSURED"), ("src/f7.py", "EXTERNAL_RAW")]


@query("p1_function_taints", "functions annotations boundaries", FIRST + f""", restored AS (SELECT f.file_path, f.qualname, {CEILING} AS r FROM functions f JOIN boundaries b ON b.function = f.qualname WHERE b.transition = 'restoration')
    SELECT f.file_path, f.qualname, coalesce(first.body_taint, r.r, md.t, 'UNKNOWN_RAW') AS body_taint, coalesce(first.return_taint, r.r, md.t, 'UNKNOWN_RAW') AS return_taint,
    CASE WHEN first.body_taint IS NOT NULL OR r.r IS NOT NULL THEN 'decorator' WHEN md.t IS NOT NULL THEN 'module_default' ELSE 'fallback' END AS taint_source
    FROM functions f LEFT JOIN first USING (file_path, qualname) LEFT JOIN restored r USING (file_path, qualname) LEFT JOIN {values(DEFAULTS, 'md', 'f', 't')} ON md.f = f.file_path""")
def _(functions, annotations, boundaries):
    key = ["file_path", "qualname"]
    restored = functions.select(*key).join(boundaries.filter("transition = 'restoration'").withColumnRenamed("function", "qualname"), "qualname")
    out = T.assign_taints(functions, T.first_decorator(annotations, key), restored, literal(functions, DEFAULTS, "file_path string, default_taint string"), key, "file_path")
    return out.select(*key, "body_taint", "return_taint", "taint_source")


@query("p2_decorator_conflicts", "annotations", f""", known AS (SELECT a.*, dt.body, dt.ret, row_number() OVER w AS n, first_value(a.name) OVER w AS used, first_value(dt.body) OVER w AS b0, first_value(dt.ret) OVER w AS r0
    FROM annotations a JOIN {DECO_SQL} ON dt.name = a.name WINDOW w AS (PARTITION BY file_path, qualname ORDER BY pos))
    SELECT file_path, qualname, 'body' AS map, used AS used_decorator, name AS ignored_decorator, b0 AS used, body AS ignored FROM known WHERE n > 1 AND b0 <> body
    UNION ALL SELECT file_path, qualname, 'return', used, name, r0, ret FROM known WHERE n > 1 AND r0 <> ret""")
def _(annotations):
    return T.decorator_conflicts(annotations, ["file_path", "qualname"]).drop("pos")


@query("p3_evidence_tier", "boundaries", f"SELECT function, {CEILING} AS ceiling FROM boundaries")
def _(boundaries):
    return boundaries.select("function", L.evidence_ceiling(F.col("structural"), F.col("semantic"), F.col("integrity"), F.col("institutional")).alias("ceiling"))


@query("p4_overclaims", "boundaries", f""", c AS (SELECT function, {CEILING} AS ceiling, CASE restored_tier WHEN 1 THEN 'INTEGRAL' WHEN 2 THEN 'ASSURED' WHEN 3 THEN 'GUARDED' ELSE 'UNKNOWN_RAW' END AS claimed FROM boundaries)
    SELECT function, claimed, ceiling FROM c JOIN {RANK_SQL} ON rk.taint = claimed JOIN {RANK_SQL.replace('AS rk', 'AS r2')} ON r2.taint = ceiling WHERE rk.rank < r2.rank""")
def _(boundaries):
    tiers = {1: "INTEGRAL", 2: "ASSURED", 3: "GUARDED", 4: "UNKNOWN_RAW"}
    return C.overclaimed(boundaries.withColumn("claimed", L.lookup(tiers, "restored_tier"))).select("function", "claimed", "ceiling")


# graphs -----------------------------------------------------------------------------------------------

G2 = with_relations("nodes", "edges", then="").replace("WITH ", "WITH RECURSIVE ", 1) + """, sends AS (SELECT name, anchored, CASE WHEN anchored THEN return_rank ELSE rank END AS s FROM nodes),
    reach AS (SELECT n.name AS origin, e.dst AS at FROM nodes n JOIN edges e ON e.src = n.name WHERE NOT n.anchored
              UNION SELECT r.origin, e.dst FROM reach r JOIN nodes n ON n.name = r.at AND NOT n.anchored JOIN edges e ON e.src = r.at),
    best AS (SELECT r.origin, max(s.s) AS m FROM reach r JOIN sends s ON s.name = r.at GROUP BY r.origin)
"""


def _grouped(df, name):
    """With the order that a node belongs to, as its file."""
    return df.withColumn("group", F.substring_index(name, "-", 1))


def _solved(spark: SparkSession, sf_dir: str, acyclic: bool = False):
    nodes, edges = _grouped(relation(spark, sf_dir, "nodes"), "name"), _grouped(relation(spark, sf_dir, "edges"), "src")
    return nodes.join(LG.solve(nodes, _acyclic(edges) if acyclic else edges).drop("group"), "name")


QUERIES["g2_rank_fixpoint"] = lambda spark, d: _solved(spark, d).select("name", "rank", "refined", F.when(F.col("refined") != F.col("rank"), "callgraph").otherwise("own").alias("source"))
ORACLES["g2_rank_fixpoint"] = G2 + "SELECT n.name, n.rank, greatest(n.rank, coalesce(b.m, 0))::INT AS refined, CASE WHEN greatest(n.rank, coalesce(b.m, 0)) <> n.rank THEN 'callgraph' ELSE 'own' END AS source FROM nodes n LEFT JOIN best b ON b.origin = n.name"


def _acyclic(edges):
    """Without the calls back."""
    line = lambda c: F.element_at(F.split(c, "-"), 2).cast("int")
    return edges.filter(line("src") < line("dst"))


QUERIES["g3_via_callee"] = lambda spark, d: _solved(spark, d, acyclic=True).select("name", "refined", "via")
QUERIES["g3_via_callee_on_cycles"] = lambda spark, d: _solved(spark, d).select("name", "refined", "via")
ORACLES["g3_via_callee"] = G2.replace(
    "b.l_linenumber = a.l_linenumber + 1 OR (a.l_orderkey % 5 = 0 AND b.l_linenumber = a.l_linenumber - 2)", "b.l_linenumber = a.l_linenumber + 1"
) + """, refined AS (SELECT n.*, greatest(n.rank, coalesce(b.m, 0))::INT AS refined FROM nodes n LEFT JOIN best b ON b.origin = n.name),
    offers AS (SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.src ORDER BY CASE WHEN r.anchored THEN r.return_rank ELSE r.refined END DESC, e.dst) AS k FROM edges e JOIN refined r ON r.name = e.dst)
    SELECT r.name, r.refined, CASE WHEN NOT r.anchored AND r.refined > r.rank THEN o.dst END AS via FROM refined r LEFT JOIN offers o ON o.src = r.name AND o.k = 1"""


@query("g4_low_resolution", "edges", ", c AS (SELECT src AS name, count_if(dst LIKE '%-1' OR dst LIKE '%-2') AS resolved, count_if(NOT (dst LIKE '%-1' OR dst LIKE '%-2')) AS unresolved FROM edges GROUP BY src) SELECT name, resolved::BIGINT AS resolved, unresolved::BIGINT AS unresolved FROM c WHERE unresolved / (resolved + unresolved)::DOUBLE > 0.7::DOUBLE")
def _(edges):
    known = F.col("dst").endswith("-1") | F.col("dst").endswith("-2")
    return G.low_resolution(edges.groupBy(F.col("src").alias("name")).agg(F.count_if(known).alias("resolved"), F.count_if(~known).alias("unresolved")))


@query("g5_rejection_index", "nodes edges", """, r0 AS (SELECT name FROM nodes WHERE rank = 7), r1 AS (SELECT DISTINCT src AS name FROM edges WHERE dst IN (SELECT name FROM r0) AND src NOT IN (SELECT name FROM r0)),
    r2 AS (SELECT DISTINCT src AS name FROM edges WHERE dst IN (SELECT name FROM r1) AND src NOT IN (SELECT name FROM r0) AND src NOT IN (SELECT name FROM r1))
    SELECT name, 0 AS round FROM r0 UNION ALL SELECT name, 1 FROM r1 UNION ALL SELECT name, 2 FROM r2""")
def _(nodes, edges):
    return G.bounded_expand(nodes.filter("rank = 7"), edges, 2)


def _components(spark: SparkSession, sf_dir: str):
    edges = _grouped(relation(spark, sf_dir, "edges"), "src")
    return LG.solve(LG.nodes_of(edges), edges)


QUERIES["g6_call_cycles"] = lambda spark, d: _components(spark, d).filter("cyclic").select("name")
ORACLES["g6_call_cycles"] = with_relations("edges", then="").replace("WITH ", "WITH RECURSIVE ", 1) + ", reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON e.src = r.dst) SELECT src AS name FROM reach WHERE src = dst"

QUERIES["g1_components"] = lambda spark, d: _components(spark, d).select("name", "component", "cyclic")
ORACLES["g1_components"] = with_relations("edges", then="").replace("WITH ", "WITH RECURSIVE ", 1) + """, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON e.src = r.dst),
    names AS (SELECT src AS name FROM edges UNION SELECT dst FROM edges), both_ AS (SELECT a.src AS name, a.dst AS other FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src)
    SELECT n.name, least(n.name, coalesce(min(b.other), n.name)) AS component, count(b.other) > 0 AS cyclic FROM names n LEFT JOIN both_ b ON b.name = n.name GROUP BY n.name"""


# coherence --------------------------------------------------------------------------------------------


@query("j12_orphaned_annotations", "annotations boundaries", "SELECT 'orphaned_annotation' AS kind, qualname AS function, file_path, string_agg(DISTINCT name, ',' ORDER BY name) AS detail FROM annotations WHERE qualname NOT IN (SELECT function FROM boundaries) GROUP BY file_path, qualname")
def _(annotations, boundaries):
    return C.orphaned_annotations(annotations, boundaries)


@query("j13_undeclared_boundaries", "annotations boundaries", "SELECT 'undeclared_boundary' AS kind, function, overlay_path AS file_path, transition AS detail FROM boundaries WHERE function NOT IN (SELECT qualname FROM annotations)")
def _(annotations, boundaries):
    return C.undeclared_boundaries(boundaries, annotations)


def _bound(bindings):
    return bindings.select("contract", F.array("f1", "f2").alias("functions"))


@query("j14_unmatched_contracts", "bindings annotations", "SELECT 'unmatched_contract' AS kind, contract AS function, '' AS file_path, 'no bound function' AS detail FROM bindings b WHERE NOT EXISTS (SELECT 1 FROM annotations a WHERE a.qualname IN (b.f1, b.f2))")
def _(bindings, annotations):
    return C.unmatched_contracts(_bound(bindings), annotations)


@query("j15_stale_bindings", "bindings functions", ", e AS (SELECT contract, f1 AS q FROM bindings UNION ALL SELECT contract, f2 FROM bindings) SELECT 'stale_contract_binding' AS kind, q AS function, '' AS file_path, contract AS detail FROM e WHERE q NOT IN (SELECT qualname FROM functions)")
def _(bindings, functions):
    return C.stale_bindings(_bound(bindings), functions)


@query("j16_tier_changes", "tiers_now tiers_then", """, both_ AS (SELECT n.path, n.tier AS new, t.tier AS old FROM tiers_now n JOIN tiers_then t ON t.path = n.path)
    SELECT 'tier_downgrade' AS kind, '' AS function, path AS file_path, old || '->' || new AS detail FROM both_ WHERE new > old
    UNION ALL SELECT 'tier_upgrade_without_evidence', '', path, old || '->' || new FROM both_ WHERE new < old AND path NOT LIKE '%3'""")
def _(now, then):
    return C.tier_changes(now, then, now.filter("path like '%3'").select("path"))


KEYS = ["structural", "semantic", "integrity", "institutional"]


@query("j17_evidence_divergence", "boundaries annotations", """, a AS (SELECT qualname, arg_min(struct_pack(structural := CAST(pos % 2 = 0 AS STRING), semantic := CASE WHEN pos % 3 <> 0 THEN 'true' END, integrity := CAST(pos % 5 = 0 AS STRING), institutional := 'true'), pos) AS s FROM annotations GROUP BY qualname),
    r AS (SELECT b.function, unnest([{'k': 'structural', 'd': CAST(b.structural AS STRING), 'f': a.s.structural}, {'k': 'semantic', 'd': CAST(b.semantic AS STRING), 'f': a.s.semantic}, {'k': 'integrity', 'd': CAST(b.integrity AS STRING), 'f': a.s.integrity}, {'k': 'institutional', 'd': CAST(b.institutional AS STRING), 'f': a.s.institutional}]) AS x FROM boundaries b JOIN a ON a.qualname = b.function)
    SELECT 'restoration_evidence_divergence' AS kind, function, '' AS file_path, x.k || ':' || coalesce(x.d, '-') || '/' || coalesce(x.f, '-') AS detail FROM r WHERE x.d IS DISTINCT FROM x.f""")
def _(boundaries, annotations):
    stated = annotations.withColumns({"structural": F.col("pos") % 2 == 0, "semantic": F.when(F.col("pos") % 3 != 0, True), "integrity": F.col("pos") % 5 == 0, "institutional": F.lit(True)})
    return C.evidence_divergence(boundaries, stated, KEYS)


@query("a9_tier_distribution", "tiers_now", "SELECT count(*)::BIGINT AS n, round(count_if(tier >= 3) * 100.0::DOUBLE / count(*), 3) AS pct, round(count_if(tier >= 3) * 100.0::DOUBLE / count(*), 3) > 60 AS permissive FROM tiers_now")
def _(tiers_now):
    return C.permissive_distribution(tiers_now)


V3 = """SELECT 'tier_topology_inconsistency' AS kind, function, overlay_path AS file_path, 'invalid tier' AS detail FROM boundaries WHERE NOT coalesce(from_tier BETWEEN 1 AND 4, true) OR NOT coalesce(to_tier BETWEEN 1 AND 4, true)
    UNION ALL SELECT 'tier_topology_inconsistency', function, overlay_path, from_tier || '!=' || tr.tier FROM boundaries b JOIN module_tiers m ON m.path = b.overlay_path JOIN """ + TIER_SQL + """ ON tr.taint = m.default_taint WHERE from_tier BETWEEN 1 AND 4 AND from_tier <> tr.tier"""
V4 = """SELECT 'missing_validation_scope' AS kind, function, overlay_path AS file_path, transition AS detail FROM boundaries WHERE transition IN ('semantic_validation', 'combined_validation', 'external_validation') AND validation_scope IS NULL"""
V4B = f"""SELECT 'insufficient_restoration_evidence' AS kind, function, overlay_path AS file_path, restored_tier || '<' || tr.tier AS detail FROM (SELECT *, {CEILING} AS ceiling FROM boundaries) b JOIN {TIER_SQL} ON tr.taint = b.ceiling WHERE restored_tier < tr.tier"""


def _tiers(module_tiers):
    return module_tiers.select("path", L.tier("default_taint").alias("tier")).filter("tier is not null")


@query("v3_tier_topology", "boundaries module_tiers", V3)
def _(boundaries, module_tiers):
    return C.tier_topology(boundaries, _tiers(module_tiers))


@query("v4_validation_scope", "boundaries", V4)
def _(boundaries):
    return C.missing_scope(boundaries)


@query("v4_restoration_evidence", "boundaries", V4B)
def _(boundaries):
    return C.weak_restoration(boundaries)


@query("j21_contradictory_decorators", "annotations", f"SELECT x.file_path, x.qualname, pr.a AS \"left\", pr.b AS \"right\", pr.severity FROM {PAIRS_SQL} JOIN annotations x ON x.name = pr.a JOIN annotations y ON y.name = pr.b AND y.file_path = x.file_path AND y.qualname = x.qualname")
def _(annotations):
    return C.contradictions(annotations)


@query("j22_field_completeness", "annotations", """, d AS (SELECT qualname, list_sort(list(DISTINCT name)) AS f FROM annotations GROUP BY qualname), a AS (SELECT qualname, list(DISTINCT name) AS f FROM annotations WHERE pos % 2 = 0 GROUP BY qualname),
    m AS (SELECT d.qualname, list_filter(d.f, lambda x: NOT list_contains(coalesce(a.f, []), x)) AS missing FROM d LEFT JOIN a USING (qualname)) SELECT qualname, array_to_string(missing, ',') AS detail FROM m WHERE len(missing) > 0""")
def _(annotations):
    declared = annotations.groupBy("qualname").agg(F.collect_set("name").alias("fields"))
    return C.incomplete_fields(declared, annotations.filter("pos % 2 = 0").groupBy("qualname").agg(F.collect_set("name").alias("attributes")))


@query("j8_governing_boundary", "functions boundaries", """SELECT DISTINCT f.qualname, f.file_path FROM functions f JOIN boundaries b ON b.function = f.qualname
    WHERE b.transition IN ('shape_validation', 'external_validation', 'combined_validation') AND b.overlay_path = 'mod/en' AND starts_with('mod/en/' || f.file_path, 'mod/en/')""")
def _(functions, boundaries):
    fields = functions.select("qualname", "file_path", F.lit("mod/en").alias("scope"), F.concat(F.lit("mod/en/"), F.col("file_path")).alias("path"))
    out = C.governing(fields, boundaries.withColumn("overlay_scope", F.col("overlay_path")), ["shape_validation", "external_validation", "combined_validation"])
    return out.select("qualname", "file_path")


@query("j9_boundary_suppression", "findings boundaries", """SELECT ordinal FROM findings f WHERE rule_id = 'PY-WL-003' AND NOT EXISTS (SELECT 1 FROM boundaries b WHERE b.function = 'fn' || (f.ordinal % 500)::STRING AND b.transition = 'shape_validation')""")
def _(findings, boundaries):
    f = findings.filter("rule_id = 'PY-WL-003'").withColumn("function", F.concat(F.lit("fn"), (F.col("ordinal") % 500).cast("string")))
    return R.unless_declared(f, boundaries.filter("transition = 'shape_validation'"), ["function"]).select("ordinal")


@query("j11_dependency_taint", "calls dependencies", """SELECT c.call_order, c.call_line, c.call_part, c.full_name, coalesce(d.taint, CASE WHEN p.package IS NOT NULL THEN 'UNKNOWN_RAW' END) AS taint
    FROM calls c LEFT JOIN dependencies d ON d.package || '.' || d.function = c.full_name LEFT JOIN (SELECT DISTINCT package FROM dependencies) p ON p.package = split_part(c.full_name, '.', 1)""")
def _(calls, dependencies):
    return C.dependency_taints(calls, dependencies)


@query("j19_test_only_imports", "annotations functions", "SELECT DISTINCT f.file_path AS importer, a.qualname AS imported FROM annotations a JOIN functions f ON 'fn' || (f.pos * 2)::STRING = a.qualname WHERE a.name = 'test_only'")
def _(annotations, functions):
    imports = functions.select(F.col("file_path").alias("importer"), F.lit("all").alias("module"), F.concat(F.lit("fn"), (F.col("pos") * 2).cast("string")).alias("name"))
    only = annotations.filter("name = 'test_only'").select(F.lit("src").alias("provider"), F.col("qualname").alias("name"))
    modules = only.select(F.lit("all").alias("module"), "provider").distinct()
    return C.test_only_imports(imports, modules, only).select("importer", F.col("name").alias("imported")).distinct()


OVERRIDE_SQL = values(list(D.OVERRIDE_RANK.items()), "{0}", "s", "r")


@query("v1_overlay_merge", "base_rules overrides", f"""SELECT coalesce(b.rule_id, o.rule_id) AS rule_id, coalesce(o.s, b.severity) AS severity, CASE WHEN o.s IS NULL THEN '' WHEN b.severity IS NULL THEN 'new rule'
    WHEN o.s = 'OFF' AND b.unconditional THEN 'cannot switch off' WHEN wr.r < br.r THEN 'widens' ELSE '' END AS wrong
    FROM base_rules b FULL JOIN (SELECT rule_id, arg_max(severity, ordinal) AS s FROM overrides GROUP BY rule_id) o ON o.rule_id = b.rule_id
    LEFT JOIN {OVERRIDE_SQL.format('wr')} ON wr.s = o.s LEFT JOIN {OVERRIDE_SQL.format('br')} ON br.s = b.severity""")
def _(base_rules, overrides):
    return C.merge_overrides(base_rules, overrides)


@query("v1_silenced_rules", "overrides", "SELECT rule_id, severity FROM overrides WHERE severity = 'OFF'")
def _(overrides):
    return C.suppressing_overrides(overrides)


@query("v3_widening_boundaries", "boundaries", "SELECT function, from_tier, to_tier FROM boundaries WHERE to_tier > from_tier")
def _(boundaries):
    return C.widening_boundaries(boundaries)


@query("v2_duplicate_boundaries", "boundaries", "SELECT overlay_path, from_tier, count(*)::BIGINT AS n FROM boundaries GROUP BY overlay_path, from_tier HAVING count(*) > 1")
def _(boundaries):
    return C.duplicates(boundaries, "overlay_path", "from_tier")


# exceptions -------------------------------------------------------------------------------------------

EXPIRED = f"coalesce(TRY_CAST(expires AS DATE) < DATE '{NOW}', false)"
BAD = "(expires IS NOT NULL AND TRY_CAST(expires AS DATE) IS NULL)"


@query("p8_p9_expiry_and_location", "register", f"SELECT id, {EXPIRED} AS expired, {BAD} AS unreadable, split_part(location, '::', 1) AS path, split_part(location, '::', 2) AS qualname FROM register")
def _(register):
    place = F.split("location", "::", 2)
    return register.select("id", X.expired(F.col("expires"), NOW).alias("expired"), X.unreadable(F.col("expires")).alias("unreadable"), place[0].alias("path"), place[1].alias("qualname"))


J10 = f""", {SEVERE}, cand AS (SELECT f.ordinal, r.id, r.ordinal AS place, r.ast_fingerprint = f.fingerprint AS good FROM severe f JOIN register r ON r.rule_id = f.rule_id AND r.taint_state = f.taint_state AND r.location = f.file_path || '::' || f.qualname
    WHERE f.exceptionability <> 'UNCONDITIONAL' AND f.qualname IS NOT NULL AND f.fingerprint IS NOT NULL AND NOT (r.analysis_level < f.analysis_level OR r.drifted OR {EXPIRED.replace('expires', 'r.expires')} OR {BAD.replace('expires', 'r.expires')})),
    best AS (SELECT ordinal, arg_min(id, place) FILTER (good) AS m, min(place) FILTER (good) AS m_at FROM cand GROUP BY ordinal)"""


@query("j10_exception_match", "findings register", J10 + " SELECT f.ordinal, CASE WHEN b.m IS NOT NULL THEN 'SUPPRESS' ELSE f.severity END AS severity, coalesce(b.m, f.exception_id) AS exception_id FROM severe f LEFT JOIN best b ON b.ordinal = f.ordinal")
def _(findings, register):
    return X.match(R.with_severity(findings), register, NOW)[0].select("ordinal", "severity", "exception_id")


@query("j10_stale_exceptions", "findings register", J10 + " SELECT c.ordinal, arg_min(c.id, c.place) AS exception_id, 'GOVERNANCE-STALE-EXCEPTION' AS rule_id FROM cand c JOIN best b ON b.ordinal = c.ordinal WHERE NOT c.good AND (b.m_at IS NULL OR c.place < b.m_at) GROUP BY c.ordinal")
def _(findings, register):
    return X.match(R.with_severity(findings), register, NOW)[1]


@query("j20_drift", "findings register", """, now_ AS (SELECT qualname, min(taint_state) AS t FROM findings WHERE qualname IS NOT NULL GROUP BY qualname)
    SELECT r.id, n.qualname, r.taint_state AS taint_then, n.t AS taint_now FROM register r JOIN now_ n ON n.qualname = split_part(r.location, '::', 2) WHERE n.t <> r.taint_state""")
def _(findings, register):
    now = findings.filter("qualname is not null").groupBy("qualname").agg(F.min("taint_state").alias("taint_state"))
    return X.drift(register, now)


@query("v15_register_health", "register", """SELECT 'GOVERNANCE-UNKNOWN-PROVENANCE' AS rule_id, id AS exception_id FROM register WHERE provenance IS NULL OR provenance = 'unknown'
    UNION ALL SELECT 'GOVERNANCE-RECURRING-EXCEPTION', id FROM register WHERE recurrence_count >= 2 UNION ALL SELECT 'GOVERNANCE-NO-EXPIRY-EXCEPTION', id FROM register WHERE expires IS NULL""")
def _(register):
    return X.health(register)


@query("v15_level_stale", "register", "SELECT 'GOVERNANCE-EXCEPTION-LEVEL-STALE' AS rule_id, id AS exception_id FROM register WHERE analysis_level < 3")
def _(register):
    return X.level_stale(register, 3)


@query("a7_exception_metrics", "register", f"""SELECT count(*)::BIGINT AS total, count_if(NOT {EXPIRED})::BIGINT AS active, count_if({EXPIRED})::BIGINT AS expired, count_if(NOT {EXPIRED} AND NOT {BAD} AND agent_originated)::BIGINT AS agent,
    count_if(NOT {EXPIRED} AND NOT {BAD} AND governance_path = 'expedited')::BIGINT AS expedited, round(count_if(NOT {EXPIRED} AND NOT {BAD} AND governance_path = 'expedited') / count(*)::DOUBLE, 4) AS expedited_ratio, count(DISTINCT governance_path)::BIGINT AS n_paths FROM register""")
def _(register):
    return X.metrics(register, NOW)


@query("a8_review", "register", f"""SELECT count_if({EXPIRED})::BIGINT AS expired, count_if(date_diff('day', DATE '{NOW}', TRY_CAST(expires AS DATE)) BETWEEN 0 AND 30)::BIGINT AS expiring, count_if(provenance IS NULL OR provenance = 'unknown')::BIGINT AS unknown_provenance,
    count_if(recurrence_count >= 2)::BIGINT AS recurring, round(count_if(NOT {EXPIRED} AND governance_path = 'expedited') / count_if(NOT {EXPIRED})::DOUBLE, 3) AS expedited_ratio FROM register""")
def _(register):
    return X.review(register, NOW)


@query("a6_scan_exception_stats", "register", f"SELECT count_if(NOT {EXPIRED})::BIGINT AS active, round(count_if(NOT {EXPIRED} AND governance_path = 'expedited') / count_if(NOT {EXPIRED})::DOUBLE, 4) AS ratio FROM register")
def _(register):
    return X.scan_stats(register, NOW)


@query("a17_recurrence", "register findings", """, w AS (SELECT DISTINCT rule_id, file_path || '::' || qualname AS location FROM findings WHERE qualname IS NOT NULL)
    SELECT w.rule_id, w.location, (coalesce(max(r.recurrence_count) + 1, 0))::INT AS recurrence_count FROM w LEFT JOIN register r ON r.rule_id = w.rule_id AND r.location = w.location GROUP BY w.rule_id, w.location""")
def _(register, findings):
    wanted = findings.filter("qualname is not null").select("rule_id", F.concat_ws("::", "file_path", "qualname").alias("location")).distinct()
    return X.next_recurrence(register, wanted)


@query("v5_exception_age", "register", f"SELECT id, CASE WHEN TRY_CAST(expires AS DATE) < DATE '{NOW}' THEN 'expired' ELSE 'too far' END AS detail FROM register WHERE TRY_CAST(expires AS DATE) < DATE '{NOW}' OR date_diff('day', DATE '{NOW}', TRY_CAST(expires AS DATE)) > 365")
def _(register):
    return X.age_issues(register, NOW)


@query("v12_migrate", "register", f""", moved AS (SELECT r.*, mx.exceptionability AS to_ FROM register r LEFT JOIN {MATRIX_SQL} ON r.drifted AND mx.rule_id = r.rule_id AND mx.taint_state = 'GUARDED' AND r.taint_state <> 'GUARDED')
    SELECT id, CASE WHEN to_ IS NOT NULL AND to_ <> 'UNCONDITIONAL' THEN 'GUARDED' ELSE taint_state END AS taint_state, CASE WHEN to_ IS NOT NULL AND to_ <> 'UNCONDITIONAL' THEN taint_state END AS migrated_from FROM moved""")
def _(register):
    drifted = register.filter("drifted and taint_state != 'GUARDED'").select("id", F.lit("GUARDED").alias("taint_now"))
    return X.migrate(register, drifted, D.severity_matrix(register.sparkSession)).select("id", "taint_state", "migrated_from")


@query("v5_agent_provenance", "register", "SELECT 'agent_originated_exception' AS kind, '' AS function, location AS file_path, id AS detail FROM register WHERE agent_originated IS NULL")
def _(register):
    return C.agent_provenance(register)


@query("v5_exception_dates", "register", f"""SELECT 'expired_exception' AS kind, '' AS function, location AS file_path, id || ' ' || CASE WHEN TRY_CAST(expires AS DATE) IS NULL THEN 'unreadable' WHEN TRY_CAST(expires AS DATE) < DATE '{NOW}' THEN 'expired' ELSE 'too far' END AS detail
    FROM register WHERE expires IS NOT NULL AND (TRY_CAST(expires AS DATE) IS NULL OR TRY_CAST(expires AS DATE) < DATE '{NOW}' OR date_diff('day', DATE '{NOW}', TRY_CAST(expires AS DATE)) > 365)""")
def _(register):
    return C.exception_ages(register, NOW)


ALL_MODULES = f", modules AS (SELECT m.path, tr.tier FROM module_tiers m JOIN {TIER_SQL} ON tr.taint = m.default_taint UNION ALL SELECT path, tier FROM tiers_now)"
CHECKS = ["j12_orphaned_annotations", "j13_undeclared_boundaries", "j16_tier_changes", "v5_agent_provenance", "v5_exception_dates", "j14_unmatched_contracts", "j15_stale_bindings", "v3_tier_topology", "v4_validation_scope", "v4_restoration_evidence", "j17_evidence_divergence"]


@query("v6_every_check", "annotations boundaries module_tiers tiers_now tiers_then register bindings functions", ALL_MODULES + f""", i AS ({' UNION ALL '.join('SELECT kind, function, file_path, detail FROM ' + nested(c) for c in CHECKS)}
    UNION ALL SELECT 'tier_distribution', '', '', NULL FROM (SELECT round(count_if(tier >= 3) * 100.0::DOUBLE / count(*), 3) AS pct FROM modules) WHERE pct > 60
    UNION ALL SELECT 'first_scan_perimeter', '', '', 'no baseline of the perimeter')
    SELECT kind, CASE WHEN kind IN ({', '.join(f"'{k}'" for k in D.COHERENCE_ERRORS)}) THEN 'ERROR' ELSE 'WARNING' END AS severity, CASE WHEN kind IN ({', '.join(f"'{k}'" for k in D.COHERENCE_POLICY)}) THEN 'policy' ELSE 'enforcement' END AS category,
    count(*)::BIGINT AS n, count(DISTINCT function || '|' || file_path)::BIGINT AS n_places FROM i GROUP BY kind""")
def _(annotations, boundaries, module_tiers, now, then, register, bindings, functions):
    modules = _tiers(module_tiers).unionByName(now)
    stated = annotations.withColumns({"structural": F.col("pos") % 2 == 0, "semantic": F.when(F.col("pos") % 3 != 0, True), "integrity": F.col("pos") % 5 == 0, "institutional": F.lit(True)})
    every = C.every_check(annotations, boundaries, modules, then, now.filter("path like '%3'").select("path"), register, _bound(bindings), functions, stated, KEYS, NOW, None)
    return every.groupBy("kind", "severity", "category").agg(F.count("*").alias("n"), F.count_distinct(F.concat("function", F.lit("|"), "file_path")).alias("n_places"))


@query("v12_grant", "findings register", f""", w AS (SELECT ordinal, rule_id, taint_state, CASE WHEN ordinal % 31 = 0 THEN file_path ELSE file_path || '::' || coalesce(qualname, 'f') END AS location,
        CASE WHEN ordinal % 37 = 0 THEN 'soon' WHEN ordinal % 3 = 0 THEN '2000-01-01' END AS expires, ordinal % 5 = 0 AS agent, CASE WHEN fingerprint IS NULL THEN '' ELSE fingerprint END AS fp FROM findings),
    most AS (SELECT rule_id, location, max(recurrence_count) AS m FROM register GROUP BY rule_id, location)
    SELECT w.ordinal, CASE WHEN mx.exceptionability = 'UNCONDITIONAL' THEN 'unconditional' WHEN NOT contains(w.location, '::') THEN 'location is not path::name' WHEN w.agent AND w.expires IS NULL THEN 'an agent''s exception must end'
        WHEN w.expires = 'soon' THEN 'unreadable date' WHEN w.fp = '' THEN 'no fingerprint' END AS refused, mx.exceptionability, mx.severity AS severity_at_grant, (coalesce(most.m + 1, 0))::INT AS recurrence_count
    FROM w JOIN {MATRIX_SQL} ON mx.rule_id = w.rule_id AND mx.taint_state = w.taint_state LEFT JOIN most ON most.rule_id = w.rule_id AND most.location = w.location""")
def _(findings, register):
    nth = F.col("ordinal")
    wanted = findings.select(
        "ordinal", "rule_id", "taint_state", F.when(nth % 31 == 0, F.col("file_path")).otherwise(F.concat_ws("::", "file_path", F.coalesce("qualname", F.lit("f")))).alias("location"),
        F.when(nth % 37 == 0, "soon").when(nth % 3 == 0, "2000-01-01").alias("expires"), (nth % 5 == 0).alias("agent_originated"), F.coalesce("fingerprint", F.lit("")).alias("ast_fingerprint"),
    )
    return X.grant(register, wanted, D.severity_matrix(register.sparkSession)).select("ordinal", "refused", "exceptionability", "severity_at_grant", "recurrence_count")


@query("v12_preview_drift", "findings register", f""", now_ AS (SELECT qualname, min(taint_state) AS t FROM findings WHERE qualname IS NOT NULL GROUP BY qualname)
    SELECT r.id, r.taint_state AS taint_then, n.t AS taint_now, mx.exceptionability AS would_be, mx.exceptionability <> 'UNCONDITIONAL' AS may_move
    FROM register r JOIN now_ n ON n.qualname = split_part(r.location, '::', 2) JOIN {MATRIX_SQL} ON mx.rule_id = r.rule_id AND mx.taint_state = n.t WHERE n.t <> r.taint_state""")
def _(findings, register):
    now = findings.filter("qualname is not null").groupBy("qualname").agg(F.min("taint_state").alias("taint_state"))
    return X.preview_drift(register, now, D.severity_matrix(register.sparkSession))


@query("k1_run_properties", "findings", f""", {SEVERE} SELECT count_if(severity = 'ERROR')::BIGINT AS "errorFindingCount", count(exception_id)::BIGINT AS "exceptedFindingCount", count_if(severity = 'ERROR' AND exception_id IS NULL)::BIGINT AS "gateBlockingCount",
    count_if(severity = 'SUPPRESS')::BIGINT AS "suppressedCellFindingCount", count_if(severity = 'WARNING')::BIGINT AS "warningFindingCount", string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS "implementedRules" FROM severe""")
def _(findings):
    return R.run_properties(R.with_severity(findings))


# fingerprints -----------------------------------------------------------------------------------------

J18 = """SELECT coalesce(b.qualname, c.qualname) AS qualname, CASE WHEN b.qualname IS NULL THEN 'ADDED' WHEN c.qualname IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change, coalesce(c.last_changed, b.last_changed) AS last_changed
    FROM baseline b FULL JOIN current_ c ON c.qualname = b.qualname WHERE b.qualname IS NULL OR c.qualname IS NULL OR b.annotation_hash <> c.annotation_hash"""


@query("j18_fingerprint_diff", "baseline current", ", current_ AS (SELECT * FROM current) " + J18)
def _(baseline, current):
    return P.diff(baseline, current)


@query("j18_fingerprint_diff_since", "baseline current", ", current_ AS (SELECT * FROM current), d AS (" + J18 + ") SELECT * FROM d WHERE last_changed >= '1999-05-01'")
def _(baseline, current):
    return P.diff(baseline, current, since="1999-05-01")


@query("a11_annotation_coverage", "functions annotations", """, f AS (SELECT *, qualname IN (SELECT qualname FROM annotations) AS yes FROM functions)
    SELECT count_if(yes)::BIGINT AS annotated, count(*)::BIGINT AS total, round(count_if(yes) / count(*)::DOUBLE, 4) AS ratio, count_if(yes AND tier = 1)::BIGINT AS tier1_annotated, count_if(tier = 1)::BIGINT AS tier1_total FROM f""")
def _(functions, annotations):
    return P.coverage(functions, annotations)


QUERIES["a16_input_hash"] = lambda spark, d: P.input_hash(spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text"), "path", "text")
ORACLES["a16_input_hash"] = "WITH r AS (SELECT DISTINCT 'd' || doc_id || chr(0) || sha256(text) || chr(10) AS record FROM documents) SELECT 'sha256:' || sha256(string_agg(record, '' ORDER BY record)) AS input_hash, count(*)::BIGINT AS n_files FROM r"


@query("v10_annotation_hash", "annotations", "SELECT qualname, substr(sha256('3.13|' || qualname || '|' || string_agg(DISTINCT name, ',' ORDER BY name) || '|'), 1, 16) AS annotation_hash FROM annotations GROUP BY qualname")
def _(annotations):
    return annotations.groupBy("qualname").agg(F.collect_set("name").alias("names")).select("qualname", P.annotation_hash("3.13", F.col("qualname"), F.col("names")).alias("annotation_hash"))


@query("v9_source_hash", "functions", "SELECT qualname, file_path, substr(sha256('3.13|' || file_path || '|' || qualname || '|' || tier), 1, 16) AS source_hash FROM functions")
def _(functions):
    return functions.select("qualname", "file_path", P.source_hash("3.13", F.col("file_path"), F.col("qualname"), F.col("tier").cast("string")).alias("source_hash"))


POLICY = ", ".join(f"'{n}'" for n, g in D.GROUP.items() if g <= 4)


@query("v11_artefact_class", "annotations", f"""SELECT qualname, CASE WHEN bool_or(name IN ({POLICY})) THEN 'policy' ELSE 'enforcement' END AS artefact_class, arg_min(t.t, a.pos) FILTER (t.t IS NOT NULL) AS boundary_transition
    FROM annotations a LEFT JOIN {values(list(D.TRANSITIONS.items()), 't', 'n', 't')} ON t.n = a.name GROUP BY qualname""")
def _(annotations):
    return P.artefact_class(annotations)


@query("a10_blanket_files", "functions annotations", """, f AS (SELECT *, CASE WHEN pos % 13 <> 0 OR file_path LIKE '%1.py' THEN 'module_default' ELSE 'decorator' END AS s, CASE WHEN tier = 1 THEN 'INTEGRAL' WHEN tier = 2 THEN 'ASSURED' ELSE 'GUARDED' END AS t FROM functions),
    g AS (SELECT file_path, count(*) >= 5 AND count_if(s = 'module_default') / count(*)::DOUBLE > 0.8::DOUBLE AS blanket, file_path NOT IN (SELECT file_path FROM annotations WHERE name = 'fail_open' AND pos % 7 = 0) AND count_if(s = 'module_default') > 0 AND arg_min(t, pos) IN ('INTEGRAL', 'ASSURED') AS undecorated FROM f GROUP BY file_path)
    SELECT * FROM g WHERE blanket OR undecorated""")
def _(functions, annotations):
    f = functions.withColumns({
        "taint_source": F.when((F.col("pos") % 13 != 0) | F.col("file_path").endswith("1.py"), "module_default").otherwise("decorator"),
        "taint": F.when(F.col("tier") == 1, "INTEGRAL").when(F.col("tier") == 2, "ASSURED").otherwise("GUARDED"),
    })
    return P.blanket_files(f, annotations.filter("name = 'fail_open' and pos % 7 = 0"))


@query("a18_multi_tier_classes", "functions", "SELECT file_path, 'C' || (pos % 5)::STRING AS class, count(DISTINCT tier)::BIGINT AS n_tiers FROM functions GROUP BY ALL HAVING count(DISTINCT tier) > 1")
def _(functions):
    return C.multi_tier_classes(functions.withColumn("class", F.concat(F.lit("C"), (F.col("pos") % 5).cast("string"))), "file_path", "class")


@query("a20_decorator_gate", "functions annotations", """, f AS (SELECT *, qualname IN (SELECT qualname FROM annotations) AS yes FROM functions WHERE tier IN (1, 4))
    SELECT tier, round(count_if(yes) * 100.0::DOUBLE / count(*), 3) AS pct, round(count_if(yes) * 100.0::DOUBLE / count(*), 3) >= 80 AS met FROM f GROUP BY tier""")
def _(functions, annotations):
    return P.decorator_gate(functions, annotations)


# corpus -----------------------------------------------------------------------------------------------

A12 = """SELECT rule_id, taint_state, count_if(verdict = 'true_positive' AND fired)::BIGINT AS tp, count_if(verdict = 'true_negative' AND fired)::BIGINT AS fp, count_if(verdict = 'true_negative' AND NOT fired)::BIGINT AS tn,
    count_if(verdict = 'true_positive' AND NOT fired)::BIGINT AS fn, count_if(verdict = 'known_false_negative')::BIGINT AS kfn FROM specimens GROUP BY rule_id, taint_state"""


@query("a12_confusion", "specimens", A12)
def _(specimens):
    return K.confusion(specimens)


@query("a13_cell_verdicts", "specimens", f""", c AS ({A12}), m AS (SELECT mx.*, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(tn, 0) AS tn, coalesce(fn, 0) AS fn, coalesce(kfn, 0) AS kfn FROM {MATRIX_SQL} LEFT JOIN c ON c.rule_id = mx.rule_id AND c.taint_state = mx.taint_state),
    s AS (SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp)::DOUBLE, 4) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 4) END AS recall FROM m)
    SELECT *, CASE WHEN tp + fp + tn + fn = 0 THEN 'NO_DATA' WHEN severity = 'SUPPRESS' THEN CASE WHEN fp = 0 THEN 'PASS' ELSE 'FAIL' END
    WHEN coalesce(precision >= CASE WHEN taint_state = 'MIXED_RAW' THEN 0.65::DOUBLE ELSE 0.8::DOUBLE END, true) AND coalesce(recall >= CASE WHEN exceptionability = 'UNCONDITIONAL' THEN 0.9::DOUBLE WHEN exceptionability IN ('STANDARD', 'RELAXED') THEN 0.7::DOUBLE END, true) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s""")
def _(specimens):
    return K.cell_verdicts(specimens)


FLOORS = [("en", 8), ("fr", 3), ("xx", 1)]


@query("a14_category_coverage", "specimens", f"""SELECT fl.category, fl.floor, count(DISTINCT s.rule_id)::BIGINT AS n_rules, coalesce(string_agg(DISTINCT s.rule_id, ',' ORDER BY s.rule_id), '') AS rules, count(DISTINCT s.rule_id) >= fl.floor AS met
    FROM {values(FLOORS, 'fl', 'category', 'floor')} LEFT JOIN specimens s ON s.category = fl.category GROUP BY fl.category, fl.floor""")
def _(specimens):
    return K.category_coverage(specimens, literal(specimens, FLOORS, "category string, floor int"))


ADVERSARIAL = "CASE category WHEN 'en' THEN 'adversarial_false_positive' WHEN 'fr' THEN 'adversarial_false_negative' ELSE 'taint_flow' END"


@query("v14_conformance_gaps", "specimens findings", f""", {SEVERE}, sp AS (SELECT rule_id, {ADVERSARIAL} AS category FROM specimens WHERE rule_id <> 'PY-WL-004' OR category <> 'fr'), c AS (SELECT count_if(verdict = 'FAIL') AS n FROM {nested("a13_cell_verdicts")}),
    e AS (SELECT count_if(severity = 'ERROR' AND exception_id IS NULL) AS n FROM severe), r AS (SELECT DISTINCT rule_id FROM findings),
    k AS (SELECT unnest(['adversarial_false_positive', 'adversarial_false_negative']) AS category),
    m AS (SELECT k.category, r.rule_id FROM r, k WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.rule_id = r.rule_id AND sp.category = k.category)),
    f AS (SELECT fl.category, fl.floor, count(sp.rule_id) AS n FROM {values(list(D.CATEGORY_FLOORS.items()), 'fl', 'category', 'floor')} LEFT JOIN sp ON sp.category = fl.category GROUP BY ALL)
    SELECT n || ' cells below floor' AS gap FROM c WHERE n > 0 UNION ALL SELECT n || ' errors without exception' FROM e WHERE n > 0
    UNION ALL SELECT category || ': missing for ' || string_agg(rule_id, ',' ORDER BY rule_id) FROM m GROUP BY category UNION ALL SELECT category || ': ' || n || '/' || floor FROM f WHERE n < floor""")
def _(specimens, findings):
    kind = F.when(F.col("category") == "en", "adversarial_false_positive").when(F.col("category") == "fr", "adversarial_false_negative").otherwise("taint_flow")
    some = specimens.filter("rule_id != 'PY-WL-004' or category != 'fr'").select("rule_id", kind.alias("category"))
    return K.conformance_gaps(K.cell_verdicts(specimens), R.with_severity(findings), some, D.CATEGORY_FLOORS)


@query("v14_stale_inputs", "baseline current", "SELECT c.qualname AS input FROM current c LEFT JOIN baseline b ON b.qualname = c.qualname WHERE b.annotation_hash IS DISTINCT FROM c.annotation_hash")
def _(baseline, current):
    pair = lambda df: df.select(F.col("qualname").alias("name"), F.col("annotation_hash").alias("value"))
    return K.stale_inputs(pair(baseline), pair(current))


# literals, sets ---------------------------------------------------------------------------------------

QUERIES["t9_string_literals"] = lambda spark, d: R.literal_counts(spark.read.parquet(f"{d}/conversations.parquet").select(F.explode(F.split("text", " ")).alias("value")), "value")
ORACLES["t9_string_literals"] = "WITH w AS (SELECT unnest(string_split(text, ' ')) AS value FROM conversations) SELECT value, count(*)::BIGINT AS n FROM w WHERE value <> '' GROUP BY value"


@query("p6_effective_validators", "annotations", f"SELECT v.name FROM {values([(v,) for v in D.BUILTIN_VALIDATORS], 'v', 'name')} UNION SELECT 'own.' || name FROM annotations")
def _(annotations):
    return R.effective_validators(annotations.sparkSession, annotations.select(F.concat(F.lit("own."), F.col("name")).alias("name")))


@query("setops_registry_sync", "annotations", f"SELECT name, 'missing' AS side FROM (SELECT n.name FROM {values([(n,) for n in D.GROUP], 'n', 'name')} EXCEPT SELECT name FROM annotations) UNION ALL SELECT name, 'shared' FROM (SELECT n.name FROM {values([(n,) for n in D.GROUP], 'n', 'name')} INTERSECT SELECT name FROM annotations)")
def _(annotations):
    known, used = D.registry(annotations.sparkSession).select("name"), annotations.select("name")
    return known.subtract(used).withColumn("side", F.lit("missing")).unionByName(known.intersect(used).withColumn("side", F.lit("shared")))


# regime -----------------------------------------------------------------------------------------------

HARD_CELLS = values([m[:2] for m in D.MATRIX if m[3] == "UNCONDITIONAL"], "hc", "r", "t")


V7 = f""", i AS ({V4})
    SELECT 'coherence_checks' AS "check", count(*) = 0 AS passed, 'ERROR' AS severity FROM i
    UNION ALL SELECT 'no_disabled_unconditional', false, 'ERROR'
    UNION ALL SELECT 'exception_register_valid', count(*) = 0, 'ERROR' FROM register r JOIN {HARD_CELLS} ON hc.r = r.rule_id AND hc.t = r.taint_state
    UNION ALL SELECT 'expedited_ratio', count_if(governance_path = 'expedited') / count(*)::DOUBLE < 0.15::DOUBLE, 'WARNING' FROM register
    UNION ALL SELECT 'fingerprint_baseline_exists', count(*) > 0, 'WARNING' FROM baseline
    UNION ALL SELECT 'fingerprint_baseline_fresh', min(date_diff('day', CAST(last_changed AS DATE), DATE '{NOW}')) < 180, 'WARNING' FROM baseline
    UNION ALL SELECT 'no_expired_exceptions', count_if({EXPIRED}) = 0, 'WARNING' FROM register
    UNION ALL SELECT 'ratification_current', date_diff('day', DATE '1999-01-01', DATE '{NOW}') <= 90, 'WARNING'
    UNION ALL SELECT 'manifest_loads', true, 'ERROR' UNION ALL SELECT 'ratification_metadata_present', true, 'ERROR' UNION ALL SELECT 'temporal_separation_declared', false, 'ERROR'
    UNION ALL SELECT 'annotation_change_tracking', count(last_changed) > 0, 'WARNING' FROM baseline"""


def _regime(register, baseline, boundaries):
    ratified = literal(register, [("1999-01-01", "board", 90, None)], "last_ratified string, authority string, interval int, separation string")
    return M.verify(register, literal(register, DISABLED, "rule_id string"), C.with_policy(C.missing_scope(boundaries)), baseline, ratified, NOW, assurance=True)


@query("v7_regime_verify", "register baseline boundaries", V7)
def _(register, baseline, boundaries):
    return _regime(register, baseline, boundaries)


@query("p10_regime_gate", "register baseline boundaries", V7.replace("SELECT 'coherence_checks' AS", "SELECT * FROM (SELECT 'coherence_checks' AS", 1) + ") WHERE NOT passed AND severity = 'ERROR'")
def _(register, baseline, boundaries):
    return M.gate(_regime(register, baseline, boundaries))


@query("v8_fingerprint_metrics", "current", f"SELECT count(*)::BIGINT AS total, max(last_changed) AS latest, date_diff('day', CAST(max(last_changed) AS DATE), DATE '{NOW}')::INT AS age_days, count_if(last_changed IS NULL)::BIGINT AS undated FROM current")
def _(current):
    return M.fingerprint_metrics(current, NOW)


@query("v8_rule_metrics", "findings", "SELECT count(DISTINCT rule_id)::BIGINT AS total, 2::BIGINT AS disabled, 1::BIGINT AS disabled_unconditional FROM findings")
def _(findings):
    return M.rule_metrics(findings.select("rule_id").distinct(), literal(findings, DISABLED, "rule_id string"))


@query("v16_governance_events", "findings", """, g AS (SELECT CASE WHEN ordinal % 50 = 0 THEN 'GOVERNANCE-STALE-EXCEPTION' WHEN ordinal % 70 = 0 THEN 'TOOL-ERROR' ELSE rule_id END AS rule_id, file_path FROM findings)
    SELECT rule_id, count(*)::BIGINT AS n, min(file_path) AS first_file, max(file_path) AS last_file FROM g WHERE rule_id LIKE 'GOVERNANCE-%' OR rule_id = 'TOOL-ERROR' GROUP BY rule_id""")
def _(findings):
    return M.governance_events(findings.withColumn("rule_id", F.when(F.col("ordinal") % 50 == 0, "GOVERNANCE-STALE-EXCEPTION").when(F.col("ordinal") % 70 == 0, "TOOL-ERROR").otherwise(F.col("rule_id"))))


@query("v13_explain", "findings annotations register", f""", t AS (SELECT file_path, qualname, min(taint_state) AS body_taint, max(taint_state) AS return_taint, 'decorator' AS taint_source FROM findings GROUP BY file_path, qualname),
    f AS (SELECT min(file_path) AS file_path FROM t WHERE qualname = 'click5'), o AS (SELECT t.* FROM t JOIN f USING (file_path) WHERE qualname = 'click5'), {SEVERE}
    SELECT 'file_path' AS topic, file_path AS detail FROM o UNION ALL SELECT 'body_taint', body_taint FROM o UNION ALL SELECT 'return_taint', return_taint FROM o UNION ALL SELECT 'taint_source', taint_source FROM o
    UNION ALL SELECT 'decorator', pos || ':' || name FROM annotations JOIN f USING (file_path) WHERE qualname = 'click5'
    UNION ALL SELECT 'finding', rule_id || ' ' || severity || ' ' || line FROM severe JOIN f USING (file_path) WHERE qualname = 'click5' UNION ALL SELECT 'exception', id FROM register WHERE split_part(location, '::', 2) = 'click5'""")
def _(findings, annotations, register):
    taints = findings.groupBy("file_path", "qualname").agg(F.min("taint_state").alias("body_taint"), F.max("taint_state").alias("return_taint"), F.lit("decorator").alias("taint_source"))
    return M.explain("click5", taints, annotations, R.with_severity(findings), register)


# sources ----------------------------------------------------------------------------------------------

PACKAGES = ("trust",)


def source_table(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Sources as bytes, as a source tree gives them."""
    return literal(spark.range(0), [(p, bytearray(t.encode())) for p, t in files.items()], "path string, content binary")


def _facts(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    from taintloom.facts.extract import facts

    return facts(source_table(spark, files), packages=PACKAGES)


def sample_query(name: str, source: str, f: Callable[[DataFrame], DataFrame], columns: str, rows) -> None:
    """Register a query over the facts of one source of samples.py, with the rows written there."""
    QUERIES[name] = lambda spark, _: f(_facts(spark, {"sample/m.py": source}))
    ORACLES[name] = f"SELECT {columns} FROM {values(rows, 'v', *columns.split(', '))}"


def _hits(rule: str) -> Callable[[DataFrame], DataFrame]:
    return lambda facts: facts.filter((F.col("kind") == "hit") & (F.col("name") == rule)).select("qualname", "line")


for _rule, _source in S.RULES.items():
    sample_query(f"r{_rule[-1]}_{_rule.replace('-', '_').lower()}", _source, _hits(_rule), "qualname, line", S.expected(_source))
sample_query("r14_advisory_lint", S.LINT, lambda facts: facts.filter("kind = 'advice'").select(F.col("name").alias("rule"), "line"), "rule, line", S.expected(S.LINT))
sample_query("t1_t2_functions", S.NAMES, lambda facts: facts.filter("kind = 'function'").select("qualname", "line"), "qualname, line", S.FUNCTIONS)
sample_query("t4_import_aliases", S.NAMES, lambda facts: facts.filter("kind = 'import'").select("name", "target"), "name, target", S.ALIASES)
sample_query("t5_full_names_of_calls", S.NAMES, lambda facts: facts.filter("kind = 'reaches'").select("qualname", "target"), "qualname, target", S.CALLS)
sample_query("t6_annotations", S.NAMES, lambda facts: facts.filter("kind = 'annotation'").select("qualname", "name", "value"), "qualname, name, value", S.ANNOTATIONS)
sample_query("t7_dynamic_imports", S.NAMES, lambda facts: facts.filter("kind = 'dynamic_import'").select("name"), "name", [(n,) for n in S.DYNAMIC])
sample_query("t8_call_edges", S.NAMES, lambda facts: facts.filter("kind = 'edge'").select("qualname", "target"), "qualname, target", S.EDGES)


def _variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taintloom.facts.flow import variable_taints

    sources = source_table(spark, {"m.py": S.FLOW})
    taints = literal(sources, [("m.py", *t) for t in S.FLOW_TAINTS], "file_path string, qualname string, body_taint string")
    return variable_taints(sources, taints, literal(sources, [("lib.safe", "ASSURED")], "name string, taint string")).select("qualname", "variable", "taint")


QUERIES["g7_variable_taints"] = _variables
ORACLES["g7_variable_taints"] = f"SELECT qualname, variable, taint FROM {values([('f', *v) for v in S.VARIABLES], 'v', 'qualname', 'variable', 'taint')}"


def _scan_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from taintloom.plans import scan

    found = _facts(spark, S.PROJECT).cache()
    tiers = literal(found, S.PROJECT_TIERS, "ordinal int, path string, default_taint string")
    declared = literal(found, S.PROJECT_BOUNDARIES, "function string, transition string, overlay_scope string")
    fields = literal(found, S.PROJECT_FIELDS, "field string, approved_default string, scope string")
    return scan.findings(found, scan.function_taints(found, tiers, level=3), declared, fields, module_tiers=tiers)


QUERIES["scan_sample_sources"] = _scan_sample
ORACLES["scan_sample_sources"] = f"SELECT * FROM {values(S.PROJECT_FINDINGS, 'v', *S.PROJECT_COLUMNS)}"


def _own_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fragments for each cell through the whole scan, scored against the floors."""
    from taintloom.plans import scan

    schema = "specimen_id string, rule_id string, fragment string, taint_state string, verdict string, boundaries array<struct<function:string,transition:string>>"
    return K.cell_verdicts(scan.verify_corpus(literal(spark.range(0), S.specimens(D.MATRIX), schema)))


QUERIES["s13_own_corpus"] = _own_corpus
ORACLES["s13_own_corpus"] = f"""SELECT rule_id, taint_state, severity, exceptionability, CASE WHEN severity = 'SUPPRESS' THEN 0 ELSE 1 END::BIGINT AS tp, 0::BIGINT AS fp, CASE WHEN severity = 'SUPPRESS' THEN 2 ELSE 1 END::BIGINT AS tn, 0::BIGINT AS fn,
    0::BIGINT AS kfn, CASE WHEN severity <> 'SUPPRESS' THEN 1.0::DOUBLE END AS precision, CASE WHEN severity <> 'SUPPRESS' THEN 1.0::DOUBLE END AS recall, 'PASS' AS verdict FROM {MATRIX_SQL}"""
