"""Command line: python -m taintloom COMMAND SOURCE ...

scan, lint, explain, facts            what the rules say of a source tree
corpus, publish                       rules against labelled fragments; the conformance status
coherence, regime                     policy against code; governance of the policy
fingerprint update|diff               baselines of annotated functions
exception add|refresh|expire|migrate|preview-drift|review     the register
manifest validate|baseline, resolve   policy files
"""

from __future__ import annotations

import argparse
import datetime
import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintloom import __name__ as package
from taintloom.facts.extract import facts
from taintloom.functions.domains import CATEGORY_FLOORS, COHERENCE_ERRORS, severity_matrix
from taintloom.operators import coherence, corpus, exceptions, findings, fingerprints, regime
from taintloom.plans import scan
from taintloom.sources import config, files

VERSION = "0.2"
KEYS = ["structural", "semantic", "integrity", "institutional"]


class Project:
    """Facts and policy of one run, read when they are asked for."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace) -> None:
        self.spark, self.args = spark, args
        self.manifest = config.manifest(args.manifest) if args.manifest else {}
        if args.resolved:
            self.overlays = config.resolved_overlays(config.resolved(args.resolved, args.manifest, args.allow_stale_resolved))
        else:
            self.overlays = [(data.get("overlay_for", p), data) for p in args.overlay for data in [config.overlay(p)]]
        self.tiers = config.module_tiers(spark, self.manifest)
        self.boundaries = config.boundaries(spark, self.overlays)
        self.fields = config.optional_fields(spark, self.overlays)
        self._facts: DataFrame | None = None
        self._taints: DataFrame | None = None
        self._kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, cached until the command ends: sources may be others by the next one."""
        self._kept.append(df.cache())
        return df

    def close(self) -> None:
        for df in self._kept:
            df.unpersist()

    @property
    def sources(self) -> DataFrame:
        return files.source_tree(self.spark, self.args.source, tuple(self.args.exclude))

    @property
    def facts(self) -> DataFrame:
        if self._facts is None:
            read = self.keep(facts(self.sources, packages=tuple(self.args.package)))
            self._facts = read.unionByName(scan.unreadable(files.source_paths(self.spark, self.args.source, tuple(self.args.exclude)), read))
        return self._facts

    @property
    def taints(self) -> DataFrame:
        if self._taints is None:
            self._taints = self.keep(scan.function_taints(self.facts, self.tiers, self.args.level))
        return self._taints

    @property
    def annotations(self) -> DataFrame:
        return scan.of_kind(self.facts, "annotation").select("file_path", "qualname", "name", "pos", "value")

    @property
    def register(self) -> DataFrame | None:
        return files.exception_register(self.spark, self.args.register, severity_matrix(self.spark)) if self.args.register else None

    def hits(self) -> DataFrame:
        extra = self.spark.createDataFrame([(v,) for v in self.args.validator], "name string")
        return scan.findings(self.facts, self.taints, self.boundaries, self.fields, rounds=self.args.rounds, level=self.args.level, validators=extra, module_tiers=self.tiers)


def _governance(df: DataFrame, rule: str, message, like: DataFrame) -> DataFrame:
    """Rows about governance in the shape of findings."""
    fixed = {"rule_id": F.lit(rule), "message": message}
    usual = {"severity": F.lit("WARNING"), "exceptionability": F.lit("UNCONDITIONAL"), "line": F.lit(1), "col": F.lit(0)}
    value = lambda c: fixed[c] if c in fixed else F.col(c) if c in df.columns else usual.get(c, F.lit(None))
    return df.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in like.schema])


def _excepted(p: Project, hits: DataFrame) -> DataFrame:
    """hits with the register applied: covered findings, and rows for stale, drifted and doubtful exceptions."""
    now_of = p.taints.groupBy("qualname").agg(F.min("body_taint").alias("taint_state"))
    drifted = exceptions.drift(p.register, now_of)
    register = p.register.join(drifted.select("id").distinct().withColumn("drifted", F.lit(True)), "id", "left").withColumn("drifted", F.coalesce("drifted", F.lit(False)))
    prints = p.taints.select("file_path", "qualname", "fingerprint")
    done, stale = exceptions.match(hits.join(prints, ["file_path", "qualname"], "left"), register, p.args.now)
    done = done.drop("fingerprint")
    at = done.select("ordinal", "file_path", "qualname")
    rows = [_governance(stale.drop("rule_id").join(at, "ordinal"), "GOVERNANCE-STALE-EXCEPTION", F.concat(F.lit("fingerprint differs: "), F.col("exception_id")), done).withColumn("exception_id", F.lit(None).cast("string"))]
    place = register.select("id", F.substring_index("location", "::", 1).alias("file_path"), F.element_at(F.split("location", "::", 2), 2).alias("qualname"))
    rows.append(_governance(drifted.select("id", "taint_then", "taint_now").join(place, "id"), "GOVERNANCE-EXCEPTION-TAINT-DRIFT", F.concat(F.col("id"), F.lit(": "), F.col("taint_then"), F.lit(" is now "), F.col("taint_now")), done))
    doubts = exceptions.health(register).unionByName(exceptions.level_stale(register, p.args.level)).join(place, F.col("exception_id") == F.col("id"))
    rows.append(_governance(doubts.drop("exception_id").withColumnRenamed("rule_id", "kind"), "", F.col("id"), done.withColumn("kind", F.lit(""))).drop("rule_id").withColumnRenamed("kind", "rule_id"))
    for more in rows:
        done = done.unionByName(more)
    return done


def run_scan(p: Project) -> int:
    args, spark = p.args, p.spark
    hits = p.hits()
    if args.disable:
        disabled = spark.createDataFrame([(r,) for r in args.disable], "rule_id string")
        off = findings.governance_of_disabled(disabled)
        hits = findings.disable_rules(hits, disabled)
        hits = hits.unionByName(_governance(off, "GOVERNANCE-RULE-DISABLED", F.concat(F.col("disabled_rule"), F.lit(" is switched off")), hits))
    # numbered once and kept: two equal findings of one place are two
    hits = p.keep(hits.withColumns({"exception_id": F.lit(None).cast("string"), "analysis_level": F.lit(args.level)}).withColumn("ordinal", F.monotonically_increasing_id()))
    if args.register:
        hits = p.keep(_excepted(p, hits))
    if args.output:
        law = regime.control_law(hits.filter("rule_id in ('GOVERNANCE-STALE-EXCEPTION', 'GOVERNANCE-RULE-DISABLED')").select(F.col("rule_id").alias("kind")), manifest_available=bool(p.manifest)).first()
        told = {"analysisLevel": args.level, "controlLaw": law.law, "controlLawDegradations": [x for x in law.degradations.split(",") if x] or None, "governanceProfile": p.manifest.get("governance_profile", "lite"), "propertyBagVersion": "0.4", "conformanceGaps": _gaps(p)}
        if not args.verification:
            told["scanTimestamp"] = datetime.datetime.now(datetime.UTC).isoformat()
        files.write_sarif(hits, args.output, VERSION, fingerprints.input_hash(p.sources, "path", "content").first().input_hash, told)
    total = findings.breakdown(hits).first()
    print(" ".join(f"{k}={v}" for k, v in total.asDict().items()))
    return findings.exit_code(False, hits.filter("rule_id = 'TOOL-ERROR'").count(), total.n_blocking)


def _gaps(p: Project) -> list[str]:
    """Gaps that the conformance status names, and what of its inputs has changed since."""
    if not p.args.conformance:
        return []
    if not os.path.exists(p.args.conformance):
        return ["no conformance status"]
    status = config.load(p.args.conformance)
    pairs = lambda d: p.spark.createDataFrame(list(d.items()), "name string, value string")
    now = {"tool_version": VERSION, "manifest_hash": config.manifest_hash(p.args.manifest) if p.args.manifest else None, "input_hash": fingerprints.input_hash(p.sources, "path", "content").first().input_hash}
    stale = sorted(r.input for r in corpus.stale_inputs(pairs(status.get("inputs", {}) or {"": ""}), pairs(now)).collect())
    return ([f"conformance status stale: {', '.join(stale)}"] if stale else []) + list(status.get("gaps", []))


def run_lint(p: Project) -> int:
    rows = p.keep(scan.of_kind(p.facts, "advice").select("file_path", "line", "col", F.col("name").alias("rule")))
    rows.orderBy("file_path", "line", "col", "rule").show(1000, truncate=False)
    return int(not rows.isEmpty())


def run_corpus(p: Project) -> int:
    cells = corpus.cell_verdicts(scan.verify_corpus(files.specimens(p.spark, p.args.source, p.args.level)))
    cells.orderBy("rule_id", "taint_state").show(100, truncate=False)
    return 0


def run_publish(p: Project) -> int:
    """The conformance status of the fragments in --corpus and of the source tree."""
    labelled = p.keep(files.specimens(p.spark, p.args.corpus, p.args.level))
    cells = p.keep(corpus.cell_verdicts(scan.verify_corpus(labelled)))
    hits = p.keep(p.hits().withColumn("exception_id", F.lit(None).cast("string")))
    gaps = sorted(r.gap for r in corpus.conformance_gaps(cells, hits, labelled, CATEGORY_FLOORS).collect())
    total = findings.breakdown(hits).first()
    failing = [r.asDict() for r in cells.filter("verdict = 'FAIL'").orderBy("rule_id", "taint_state").collect()]
    inputs = {"tool_version": VERSION, "manifest_hash": config.manifest_hash(p.args.manifest) if p.args.manifest else None, "input_hash": fingerprints.input_hash(p.sources, "path", "content").first().input_hash, "corpus_hash": fingerprints.input_hash(labelled, "specimen_id", "fragment").first().input_hash}
    files.write_json({"format_version": "1.0", "inputs": inputs, "corpus_verdict": "FAIL" if failing else "PASS", "self_hosting_verdict": "FAIL" if total.n_blocking else "PASS", "gaps": gaps, "corpus_cells_failing": failing, "self_hosting_unexcepted_errors": total.n_blocking, "self_hosting_warning_findings": total.n_warning, "self_hosting_suppressed_cell_findings": total.n_suppress}, p.args.output or "conformance.json")
    print(f"{len(gaps)} gaps")
    return 0


def run_explain(p: Project) -> int:
    none = p.spark.createDataFrame([], "id string, location string")
    regime.explain(p.args.qualname, p.taints, p.annotations, p.hits(), p.register if p.args.register else none).show(200, truncate=False)
    if p.args.level >= 2:
        from taintloom.facts.flow import variable_taints

        declared = config.dependencies(p.spark, p.manifest).select(F.concat_ws(".", "package", "function").alias("name"), "taint")
        variable_taints(p.sources, p.taints, declared).filter(F.col("qualname") == p.args.qualname).orderBy("file_path", "variable").show(200, truncate=False)
    return 0


def run_facts(p: Project) -> int:
    p.facts.write.mode("overwrite").parquet(p.args.output)
    return 0


def _issues(p: Project) -> DataFrame:
    spark = p.spark
    functions = scan.of_kind(p.facts, "function").select("file_path", "qualname")
    tiers = p.tiers.select("path", "tier").filter("tier is not null")
    then = config.module_tiers(spark, config.load(p.args.baseline)).select("path", "tier") if p.args.baseline else tiers.limit(0)
    none = spark.createDataFrame([], "id string, location string, expires string, agent_originated boolean")
    register = p.register if p.args.register else none
    said = lambda k: F.coalesce(F.regexp_extract("value", rf"(?:^|,){k}=([^,]*)", 1), F.lit(""))
    marks = p.annotations.filter("name = 'restoration_boundary'").withColumns({k: ~said(f"{k}_evidence" if k != "institutional" else "institutional_provenance").isin("", "False", "None") for k in KEYS})
    rows = p.boundaries.withColumns({k: F.lit(None).cast("boolean") for k in KEYS})
    evidenced = p.boundaries.filter("transition = 'restoration'").select(F.col("overlay_path").alias("path"))
    return coherence.every_check(p.annotations, rows, tiers, then, evidenced, register, config.bindings(spark, p.overlays), functions, marks, KEYS, p.args.now, p.args.perimeter)


def run_coherence(p: Project) -> int:
    rows = p.keep(_issues(p))
    rows.orderBy("severity", "kind", "function").show(1000, truncate=False)
    gate = p.args.gate or p.manifest.get("governance_profile") == "assurance"
    return int(gate and not rows.filter(F.col("kind").isin(*COHERENCE_ERRORS)).isEmpty())


def _baseline(p: Project) -> DataFrame:
    if p.args.fingerprints:
        return files.fingerprint_baseline(p.spark, p.args.fingerprints)
    return p.spark.createDataFrame([], files.FINGERPRINT + ", python_version string, ordinal int")


def run_regime(p: Project) -> int:
    spark = p.spark
    none = spark.createDataFrame([], "id string, rule_id string, taint_state string, location string, expires string, governance_path string, agent_originated boolean, provenance string, recurrence_count int")
    register = p.register if p.args.register else none
    disabled = spark.createDataFrame([(r,) for r in p.args.disable], "rule_id string")
    if p.args.action == "status":
        exceptions.metrics(register, p.args.now).show(truncate=False)
        regime.fingerprint_metrics(_baseline(p), p.args.now).show(truncate=False)
        regime.rule_metrics(severity_matrix(spark).select("rule_id").distinct(), disabled).show(truncate=False)
        return 0
    checks = p.keep(regime.verify(register, disabled, _issues(p), _baseline(p), config.ratification(spark, p.manifest), p.args.now, assurance=p.manifest.get("governance_profile") == "assurance", manifest_loads=bool(p.manifest)))
    checks.orderBy("check").show(truncate=False)
    return int(not regime.gate(checks, p.args.gate).isEmpty())


def run_fingerprint(p: Project) -> int:
    made = scan.fingerprints(p.facts, p.tiers, p.args.now)
    if p.args.action == "update":
        files.write_fingerprints(made, p.args.output, f"{sys.version_info.major}.{sys.version_info.minor}")
        return 0
    named = lambda df: df.withColumnRenamed("qualified_name", "qualname")
    fingerprints.diff(named(_baseline(p)), named(made).withColumn("ordinal", F.lit(0))).orderBy("qualname").show(1000, truncate=False)
    return 0


def run_exception(p: Project) -> int:
    args, register, matrix = p.args, p.register, severity_matrix(p.spark)
    now_of = p.taints.groupBy("qualname").agg(F.min("body_taint").alias("taint_state"))
    new: DataFrame
    if args.action == "review":
        exceptions.review(register, args.now).show(truncate=False)
        return 0
    if args.action == "preview-drift":
        exceptions.preview_drift(register, now_of, matrix).orderBy("id").show(1000, truncate=False)
        return 0
    if args.action == "add":
        place, _, name = args.location.partition("::")
        prints = p.taints.filter((F.col("file_path") == place) & (F.col("qualname") == name)).select(F.first("fingerprint").alias("ast_fingerprint"))
        fixed = {"id": f"EXC-{uuid.uuid4().hex[:8].upper()}", "rule_id": args.rule, "taint_state": args.taint, "location": args.location, "rationale": args.why, "reviewer": args.by, "expires": args.expires, "governance_path": args.path}
        wanted = prints.select(*[F.lit(v).cast("string").alias(k) for k, v in fixed.items()], F.lit(args.agent).alias("agent_originated"), F.lit(args.level).alias("analysis_level"), "ast_fingerprint")
        rows = p.keep(exceptions.grant(register, wanted, matrix))
        if (refused := rows.first().refused) is not None:
            print(refused, file=sys.stderr)
            return 1
        last = register.agg(F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).first()[0]
        new = register.unionByName(rows.drop("refused").withColumn("ordinal", F.lit(last)), allowMissingColumns=True)
    elif args.action == "refresh":
        new = exceptions.refresh(register, args.id, args.by, args.why, args.now, args.expires)
    elif args.action == "expire":
        new = exceptions.expire(register, args.id, str(datetime.date.fromisoformat(args.now) - datetime.timedelta(days=1)))
    else:
        new = exceptions.migrate(register, exceptions.drift(register, now_of).select("id", "taint_now"), matrix)
    files.write_register(new, args.output)
    return 0


def run_manifest(p: Project) -> int:
    if p.args.action == "baseline":
        files.write_json(config.policy_baseline(p.manifest), p.args.output)
    print("valid")
    return 0


def run_resolve(p: Project) -> int:
    files.write_json(config.resolve(p.args.manifest, p.args.overlay), p.args.output)
    return 0


COMMANDS = {
    "scan": (run_scan, ()), "lint": (run_lint, ()), "corpus": (run_corpus, ()), "publish": (run_publish, ()), "explain": (run_explain, ()), "facts": (run_facts, ()), "coherence": (run_coherence, ()),
    "regime": (run_regime, ("status", "verify")), "fingerprint": (run_fingerprint, ("update", "diff")), "exception": (run_exception, ("add", "refresh", "expire", "migrate", "preview-drift", "review")),
    "manifest": (run_manifest, ("validate", "baseline")), "resolve": (run_resolve, ()),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog=package, description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (f, actions) in COMMANDS.items():
        p = commands.add_parser(name)
        p.set_defaults(run=f)
        if actions:
            p.add_argument("action", choices=actions)
        p.add_argument("source")
        for several in ("--overlay", "--exclude", "--disable", "--validator", "--id"):
            p.add_argument(several, action="append", default=[])
        p.add_argument("--package", action="append", default=None, help="package whose decorators count")
        p.add_argument("--level", type=int, default=1, choices=(1, 2, 3))
        p.add_argument("--rounds", type=int, default=1)
        p.add_argument("--now", default=datetime.date.today().isoformat())
        for flag in ("--gate", "--agent", "--verification", "--allow-stale-resolved"):
            p.add_argument(flag, action="store_true")
        for one in ("--manifest", "--resolved", "--output", "--register", "--conformance", "--corpus", "--baseline", "--perimeter", "--fingerprints", "--qualname", "--rule", "--taint", "--location", "--why", "--by", "--expires"):
            p.add_argument(one)
        p.add_argument("--path", default="standard", choices=("standard", "expedited"))
    args = parser.parse_args(argv)
    args.package = args.package or [package]
    spark = SparkSession.builder.appName(package).getOrCreate()
    project = None
    try:
        project = Project(spark, args)
        return args.run(project)
    except config.PolicyError as e:
        print(e, file=sys.stderr)
        return 2
    finally:
        if project is not None:
            project.close()


if __name__ == "__main__":
    sys.exit(main())
