"""The scan: facts of sources, joined with policy into findings."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintloom.functions import domains as D
from taintloom.functions.lattice import lookup
from taintloom.operators import coherence as C
from taintloom.operators import findings as R
from taintloom.operators import fingerprints as P
from taintloom.operators import functions_level as T
from taintloom.operators import graph as G
from taintloom.operators import local_graph as LG
from taintloom.operators import paths as W

FINDING = ["rule_id", "file_path", "qualname", "line", "col", "end_line", "end_col", "message", "taint_state", "severity", "exceptionability"]
SHAPE = ["shape_validation", "external_validation", "combined_validation", "validates_shape", "validates_external"]
CHECKED = ["shape_validation", "semantic_validation", "external_validation", "combined_validation", "restoration"]


def of_kind(facts: DataFrame, kind: str) -> DataFrame:
    return facts.filter(F.col("kind") == kind)


def function_taints(facts: DataFrame, module_tiers: DataFrame, level: int = 1) -> DataFrame:
    """Every function with body and return taint, and, from level 3 on, refined over the calls within its file."""
    key = ["file_path", "qualname"]
    functions = of_kind(facts, "function").select(*key, "pos", F.col("value").alias("fingerprint"), "flag")
    files = functions.select(F.col("file_path")).distinct()
    defaults = W.longest_prefix(files, "file_path", module_tiers, "path", "default_taint", "ordinal")
    defaults = defaults.withColumn("default_taint", F.when(lookup(D.RANK, "default_taint").isNotNull(), F.col("default_taint")))
    decorated = T.first_decorator(of_kind(facts, "annotation").select(*key, "name", "pos"), key)
    none = functions.select(*key).limit(0).withColumns({c: F.lit(True) for c in ("structural", "semantic", "integrity", "institutional")})
    out = T.assign_taints(functions, decorated, _restored(facts, none), defaults, key, "file_path")
    if level < 3:
        return out
    nodes = out.filter("flag").select(F.col("file_path").alias("group"), F.col("qualname").alias("name"), lookup(D.RANK, "body_taint").alias("rank"), lookup(D.RANK, "return_taint").alias("return_rank"), (F.col("taint_source") == "decorator").alias("anchored"))
    edges = of_kind(facts, "edge").select(F.col("file_path").alias("group"), F.col("qualname").alias("src"), F.col("target").alias("dst"))
    refined = LG.solve(nodes, edges).select(F.col("group").alias("file_path"), F.col("name").alias("qualname"), "refined", F.col("via").alias("via_callee"))
    back = lookup({r: t for t, r in D.RANK.items()}, "refined")
    joined = out.join(refined, key, "left")
    changed = F.coalesce(back != F.col("body_taint"), F.lit(False))
    return joined.withColumns({"taint_source": F.when(changed, "callgraph").otherwise(F.col("taint_source")), "body_taint": F.coalesce(back, "body_taint")}).drop("refined")


def _restored(facts: DataFrame, none: DataFrame) -> DataFrame:
    """Evidence that restoration decorators state: attributes are rendered as key=value, comma-joined."""
    marks = of_kind(facts, "annotation").filter("name = 'restoration_boundary'")
    said = lambda k: F.coalesce(F.regexp_extract("value", rf"(?:^|,){k}=([^,]*)", 1), F.lit(""))
    given = {k: ~said(f"{k}_evidence" if k != "institutional" else "institutional_provenance").isin("", "False", "None") for k in ("structural", "semantic", "integrity", "institutional")}
    return none.unionByName(marks.select("file_path", "qualname", *[v.alias(k) for k, v in given.items()]).dropDuplicates(["file_path", "qualname"]))


def rejection_index(facts: DataFrame, validators: DataFrame, rounds: int = 1) -> DataFrame:
    """Full names of functions that reject, themselves or by calls up to `rounds` steps away."""
    seed = of_kind(facts, "rejects").filter("flag").select(F.col("target").alias("name")).unionByName(validators.select("name"))
    edges = of_kind(facts, "reaches").select(F.col("name").alias("src"), F.col("target").alias("dst"))
    return G.bounded_expand(seed, edges, rounds)


def findings(
    facts: DataFrame, taints: DataFrame, boundaries: DataFrame, optional_fields: DataFrame, rounds: int = 1, level: int = 3,
    validators: DataFrame | None = None, module_tiers: DataFrame | None = None, one_project: bool = True,
) -> DataFrame:
    """All findings of the rules. boundaries (function, transition, overlay_scope); optional_fields (field,
    approved_default as source text, scope); validators (name): functions that reject besides the builtin ones;
    module_tiers (ordinal, path, default_taint): files of tier 1 that are skipped are errors. A boundary of any scope
    lets its function test types; unless the files are one project, only one of the file's own scope does."""
    key = ["file_path", "qualname"]
    spark = facts.sparkSession
    hits = of_kind(facts, "hit").select("file_path", "qualname", F.col("name").alias("rule_id"), F.col("value").alias("message"), "line", "col", "end_line", "end_col", "flag")
    b = boundaries.select(F.col("function").alias("qualname"), "transition", "overlay_scope")
    scoped = hits.select(*key).distinct().join(b, "qualname").withColumn("in", W.in_scope(F.col("file_path"), F.col("overlay_scope")))
    has = lambda kinds, any_scope=False: scoped.filter(F.lit(any_scope) | F.col("in")).filter(F.col("transition").isin(*kinds) if kinds else F.lit(True)).select(*key).distinct()
    rule = lambda *ids: hits.filter(F.col("rule_id").isin(*ids))
    plain = rule("PY-WL-001", "PY-WL-002", "PY-WL-004", "PY-WL-005", "PY-WL-006")
    gated = R.unless_declared(rule("PY-WL-003"), has(SHAPE), key)
    typed = rule("PY-WL-007").filter("message != 'isinstance'").unionByName(R.unless_declared(rule("PY-WL-007").filter("message = 'isinstance'"), has([], any_scope=one_project), key))
    declared = lambda kinds: has(kinds).withColumn("__declared", F.lit(True))
    either = lambda df, kinds: df.join(declared(kinds), key, "left").filter("flag or __declared is not null").drop("__declared")
    index = rejection_index(facts, R.effective_validators(spark, validators), rounds)
    delegated = of_kind(facts, "reaches").join(index.select(F.col("name").alias("target")), "target", "left_semi").select(*key).distinct()
    unrejected = R.unless_declared(either(rule("PY-WL-008"), CHECKED), delegated, key)
    semantic = R.unless_declared(either(rule("PY-WL-009"), ["semantic_validation"]), has(["combined_validation", "external_validation"]), key)
    judged = reduce(DataFrame.unionByName, [plain, gated, typed, unrejected, semantic]).drop("flag")
    state = taints.select(*key, F.col("body_taint").alias("taint_state"))
    out = R.with_severity(judged.join(state.distinct(), key)).select(*FINDING)
    more = [_governed(rule("PY-WL-001-SCHEMA-DEFAULT").join(state, key), b, optional_fields), _breaches(facts), _pairs(facts), _gates(facts), _test_only(facts), _fields(facts), _governance(facts, taints, level, module_tiers)]
    return reduce(DataFrame.unionByName, [out, *more])


def _shown(df: DataFrame, rule_id: str, message, severity, exceptionability: str = "STANDARD") -> DataFrame:
    first = {"line": 1, "col": 0}  # rows about a whole file
    place = [c if c in df.columns else F.lit(first.get(c)).cast("int").alias(c) for c in ("line", "col", "end_line", "end_col")]
    return df.select(F.lit(rule_id).alias("rule_id"), "file_path", "qualname", *place, message.alias("message"), F.lit(None).cast("string").alias("taint_state"), severity.alias("severity"), F.lit(exceptionability).alias("exceptionability"))


def _governed(hits: DataFrame, b: DataFrame, fields: DataFrame) -> DataFrame:
    """Defaults of declared optional fields: silent where the approved default is used under a shape boundary."""
    h = hits.withColumns({"field": F.regexp_extract("message", r"^['\"](.*?)['\"]=", 1), "used": F.substring_index("message", "=", -1)})
    f = fields.select("field", "approved_default", F.col("scope").alias("field_scope"))
    near = h.join(f, "field", "left").filter(F.col("field_scope").isNull() | W.in_scope(F.col("file_path"), F.col("field_scope")))
    place = ["file_path", "qualname", "line", "col", "end_line", "end_col", "message", "used", "taint_state"]
    best = near.groupBy(*place).agg(F.max_by(F.struct("approved_default", "field_scope"), F.size(F.split("field_scope", "/"))).alias("best"))
    best = h.select(*place).distinct().join(best, place, "left").select(*place, "best.*")
    shape = b.filter(F.col("transition").isin(*SHAPE)).select("qualname", F.col("overlay_scope").alias("field_scope")).distinct().withColumn("__governed", F.lit(True))
    both = best.join(shape, ["qualname", "field_scope"], "left")
    same = F.coalesce(F.col("approved_default") == F.col("used"), F.lit(False))
    good = same & F.col("__governed").isNotNull()
    return both.select(
        F.when(good, "PY-WL-001-GOVERNED-DEFAULT").otherwise("PY-WL-001-UNGOVERNED-DEFAULT").alias("rule_id"), "file_path", "qualname", "line", "col", "end_line", "end_col", "message", "taint_state",
        F.when(good, "SUPPRESS").otherwise("ERROR").alias("severity"), F.when(good, "TRANSPARENT").when(same, "STANDARD").otherwise("UNCONDITIONAL").alias("exceptionability"),
    )


def _breaches(facts: DataFrame) -> DataFrame:
    return _shown(of_kind(facts, "breach"), "SUP-001", F.col("value"), F.col("name"))


def _pairs(facts: DataFrame) -> DataFrame:
    pairs = C.contradictions(of_kind(facts, "annotation").select("file_path", "qualname", "name"))
    at = of_kind(facts, "function").select("file_path", "qualname", "line", "col", "end_line", "end_col")
    return _shown(pairs.join(at, ["file_path", "qualname"]), "SCN-021", F.concat_ws("+", "left", "right"), F.col("severity"), "UNCONDITIONAL")


def _gates(facts: DataFrame) -> DataFrame:
    """Feature flags that nothing but their decorator names."""
    counts = R.literal_counts(of_kind(facts, "literal"), "value", F.col("n")).withColumnRenamed("n", "total")
    g = of_kind(facts, "gate").drop("n").join(counts, "value", "left")
    stale = g.filter(F.col("value").isNull() | (F.trim("value") == "") | (~F.col("flag") & (F.coalesce("total", F.lit(0)) <= 1)))
    return _shown(stale, "SUP-001", F.concat(F.lit("stale feature flag "), F.coalesce("value", F.lit(""))), F.lit("WARNING"))


def _test_only(facts: DataFrame) -> DataFrame:
    """Imports of test_only functions by files that are no tests."""
    test = F.exists(F.split("file_path", "/"), lambda p: p.isin("test", "tests", "testing")) | F.regexp_like("file_path", F.lit(r"(^|/)test_[^/]*$|_test\.py$"))
    imports = of_kind(facts, "from_import").filter(~test).select("file_path", "name", F.col("target").alias("module"), "line", "col", "end_line", "end_col")
    modules = of_kind(facts, "file").select(F.col("name").alias("module"), F.col("file_path").alias("provider"))
    only = of_kind(facts, "annotation").filter("name = 'test_only'").select(F.col("file_path").alias("provider"), F.col("qualname").alias("name"))
    hit = C.test_only_imports(imports, modules, only).withColumn("qualname", F.lit(None).cast("string"))
    return _shown(hit, "SUP-001", F.concat(F.lit("imports test-only "), F.col("name")), F.lit("ERROR"))


def _fields(facts: DataFrame) -> DataFrame:
    """Fields of a class that a function declared to map all of them does not touch; classes of the same file."""
    m = of_kind(facts, "mapped").select("file_path", "qualname", F.col("target").alias("name"), F.split("value", ",").alias("attributes"), "line", "col", "end_line", "end_col")
    c = of_kind(facts, "class").select("file_path", "name", F.filter(F.split("value", ","), lambda x: x != "").alias("fields"))
    both = m.join(c, ["file_path", "name"], "left").withColumn("missing", F.array_except("fields", "attributes"))
    bad = both.filter("fields is null or size(missing) > 0")
    return _shown(bad, "SCN-022", F.coalesce(F.array_join(F.array_sort("missing"), ","), F.lit("no such class")), F.lit("ERROR"))


def _governance(facts: DataFrame, taints: DataFrame, level: int, module_tiers: DataFrame | None) -> DataFrame:
    """Rows about the scan itself: what was skipped or failed, and where its taints rest on little. A skipped file of
    tier 1 and a failed call graph are errors."""
    key = ["file_path", "qualname"]
    warn = F.lit("WARNING")
    notes = facts.filter(F.col("kind").isin("skipped", "tool_error", "dynamic_import"))
    if module_tiers is not None:
        notes = W.longest_prefix(notes, "file_path", module_tiers, "path", "default_taint", "ordinal")
        notes = notes.withColumn("tier", lookup(D.TIER, "default_taint"))
    else:
        notes = notes.withColumn("tier", F.lit(None).cast("int"))
    grave = (F.col("kind") == "skipped") & (F.col("tier") <= 1) | (F.col("kind") == "tool_error") & (F.col("name") == "calls")
    graver = F.when(F.coalesce(grave, F.lit(False)), "ERROR").otherwise("WARNING")
    kinds = {"skipped": "GOVERNANCE-FILE-SKIPPED", "tool_error": "TOOL-ERROR", "dynamic_import": "DYNAMIC-IMPORT"}
    about = [_shown(of_kind(notes, k), rule, F.coalesce("value", "name"), graver, "UNCONDITIONAL") for k, rule in kinds.items()]
    at = of_kind(facts, "function").select(*key, "line", "col", "end_line", "end_col")
    marks = of_kind(facts, "annotation").select(*key, "name", "pos", "value")
    conflicts = T.decorator_conflicts(marks, key).join(at, key)
    about.append(_shown(conflicts, "GOVERNANCE-TAINT-CONFLICT", F.concat_ws(" ", "map", "used_decorator", "ignored_decorator"), warn))
    files = P.blanket_files(taints.select(*key, "pos", "taint_source", F.col("body_taint").alias("taint")), marks).withColumn("qualname", F.lit(None).cast("string"))
    about.append(_shown(files.filter("blanket"), "GOVERNANCE-MODULE-TIERS-BLANKET", F.lit("most functions rest on the module's tier"), warn))
    about.append(_shown(files.filter("undecorated"), "GOVERNANCE-MODULE-TIERS-UNDECORATED", F.lit("trusted module without decorators"), warn))
    if level < 3:
        return reduce(DataFrame.unionByName, about)
    sites = of_kind(facts, "call_sites").select(*key, F.col("n").alias("resolved"), F.col("pos").alias("unresolved"))
    about.append(_shown(G.low_resolution(sites).join(at, key), "L3-LOW-RESOLUTION", F.concat_ws("/", F.col("unresolved").cast("string"), (F.col("resolved") + F.col("unresolved")).cast("string")), warn))
    return reduce(DataFrame.unionByName, about)


def verify_corpus(specimens: DataFrame) -> DataFrame:
    """Results of labelled fragments (specimen_id, rule_id, taint_state, verdict, fragment, boundaries): whether the
    rule fires with a severity above SUPPRESS when every function has the specimen's taint."""
    from taintloom.facts.extract import facts as extract

    sources = specimens.select(F.concat(F.col("specimen_id"), F.lit(".py")).alias("path"), F.col("fragment").cast("binary").alias("content"))
    found = extract(sources)
    one = specimens.select(F.concat(F.col("specimen_id"), F.lit(".py")).alias("file_path"), "specimen_id", "rule_id", F.col("taint_state").alias("body_taint"), "verdict")
    taints = of_kind(found, "function").select("file_path", "qualname", "pos").join(one, "file_path").select("file_path", "qualname", "pos", "body_taint", F.lit("decorator").alias("taint_source"))
    b = specimens.select(F.concat(F.col("specimen_id"), F.lit(".py")).alias("overlay_scope"), F.explode("boundaries").alias("x")).select("x.function", "x.transition", "overlay_scope")
    fields = specimens.sparkSession.createDataFrame([], "field string, approved_default string, scope string")
    if "optional_fields" in specimens.columns:
        fields = specimens.select(F.explode("optional_fields").alias("x"), F.concat(F.col("specimen_id"), F.lit(".py")).alias("scope")).select("x.field", "x.approved_default", "scope")
    hits = findings(found, taints, b, fields, one_project=False).filter("severity != 'SUPPRESS'").select("file_path", "rule_id").distinct().withColumn("fired", F.lit(True))
    return one.join(hits, ["file_path", "rule_id"], "left").select("specimen_id", "rule_id", F.col("body_taint").alias("taint_state"), "verdict", F.coalesce("fired", F.lit(False)).alias("fired"))


def unreadable(paths: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of kind skipped for listed files of which nothing could be read."""
    gone = paths.select(F.col("path").alias("file_path")).join(facts.select("file_path").distinct(), "file_path", "left_anti")
    given = {"kind": F.lit("skipped"), "file_path": F.col("file_path"), "name": F.lit("Unreadable"), "line": F.lit(1), "col": F.lit(0)}
    return gone.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in facts.schema])


def fingerprints(facts: DataFrame, module_tiers: DataFrame, now: str) -> DataFrame:
    """The fingerprint of every annotated function, as a baseline holds them."""
    key = ["file_path", "qualname"]
    marks = of_kind(facts, "annotation")
    version = f"{sys.version_info.major}.{sys.version_info.minor}"
    shown = F.array_sort(F.collect_list(F.concat_ws(":", "name", "value")))
    per = marks.groupBy(*key).agg(F.array_sort(F.collect_set("name")).alias("decorators"), F.array_join(shown, ",").alias("attributes"))
    classes = P.artefact_class(marks.withColumn("qualname", F.concat_ws("\0", *key))).withColumns({"file_path": F.substring_index("qualname", "\0", 1), "qualname": F.substring_index("qualname", "\0", -1)})
    files = W.longest_prefix(per.select("file_path").distinct(), "file_path", module_tiers, "path", "default_taint", "ordinal")
    out = per.join(classes, key).join(files, "file_path")
    return out.select(
        F.col("qualname").alias("qualified_name"), W.module_name(F.col("file_path")).alias("module"), "decorators", P.annotation_hash(version, F.col("qualname"), F.col("decorators"), F.col("attributes")).alias("annotation_hash"),
        F.coalesce(lookup(D.TIER, "default_taint"), F.lit(4)).alias("tier_context"), "boundary_transition", F.lit(now).alias("last_changed"), "artefact_class",
    )
