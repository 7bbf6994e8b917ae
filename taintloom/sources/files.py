"""Source trees, registers and baselines as DataFrames; reports as files."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintloom.functions.domains import SARIF_LEVEL
from taintloom.operators.findings import run_properties
from taintloom.operators.paths import in_scope

REGISTER = (
    "id string, rule string, taint_state string, location string, exceptionability string, severity_at_grant string, rationale string, reviewer string, expires string, "
    "last_refreshed_at string, provenance string, last_refreshed_by string, last_refresh_rationale string, migrated_from string, migrated_by string, agent_originated boolean, "
    "recurrence_count int, governance_path string, ast_fingerprint string, analysis_level int"
)
FINGERPRINT = "qualified_name string, module string, decorators array<string>, annotation_hash string, tier_context int, boundary_transition string, last_changed string, artefact_class string"


def _listed(spark: SparkSession, root: str, exclude: tuple[str, ...], *columns: str) -> DataFrame:
    # what cannot be read gives no row here; scan.unreadable reports it from the list of paths
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root)
    base = root.rstrip("/").removeprefix("file:") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/{1,3}", "/"), "^/+", "/")
    out = read.select(F.replace(path, F.lit(base), F.lit("")).alias("path"), *columns)
    for e in exclude:
        out = out.filter(~in_scope(F.col("path"), F.lit(e)))
    return out


def source_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path relative to root, content) of every Python file below root that can be read, but for excluded directories."""
    return _listed(spark, root, exclude, "content")


def source_paths(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path) of the same files and of those that cannot be read: contents are not."""
    return _listed(spark, root, exclude)


def exception_register(spark: SparkSession, path: str, matrix: DataFrame) -> DataFrame:
    """The register in its order. Rows of an unconditional cell, or without a fingerprint, fail the load."""
    read = spark.read.schema(f"exceptions array<struct<{', '.join(c.replace(' ', ':', 1) for c in REGISTER.split(', '))}>>").json(path, multiLine=True)
    rows = read.select(F.posexplode("exceptions").alias("ordinal", "x")).select(F.col("ordinal").cast("long").alias("ordinal"), "x.*").withColumnRenamed("rule", "rule_id")
    cells = matrix.select("rule_id", "taint_state", F.col("exceptionability").alias("__cell"))
    bad = (F.coalesce(F.col("__cell"), F.lit("")) == "UNCONDITIONAL") | (F.trim(F.coalesce("ast_fingerprint", F.lit(""))) == "")
    checked = rows.join(F.broadcast(cells), ["rule_id", "taint_state"], "left")
    return checked.withColumn("id", F.when(bad, F.raise_error(F.concat(F.lit("exception may not stand: "), "id"))).otherwise(F.col("id"))).drop("__cell")


def write_register(register: DataFrame, path: str) -> None:
    """The whole register as one document, in its order."""
    fields = [c.split()[0] for c in REGISTER.split(", ")]
    rows = register.withColumnRenamed("rule_id", "rule")
    kept = [c for c in fields if c in rows.columns]
    one = rows.agg(F.array_sort(F.collect_list(F.struct("ordinal", *kept))).alias("x")).select(F.transform("x", lambda x: x.dropFields("ordinal")).alias("exceptions"))
    one.coalesce(1).write.mode("overwrite").json(path)


def fingerprint_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints of a baseline, in the present or the earlier layout (key entries), missing fields null."""
    struct = f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in FINGERPRINT.split(', '))}>>"
    read = spark.read.schema(f"python_version string, fingerprints {struct}, entries {struct}").json(path, multiLine=True)
    rows = read.select("python_version", F.posexplode(F.coalesce("fingerprints", "entries")).alias("ordinal", "x"))
    return rows.select("python_version", "ordinal", "x.*").withColumn("artefact_class", F.coalesce("artefact_class", F.lit("enforcement")))


def write_baseline(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


SPECIMEN = (
    "specimen_id string, rule string, fragment string, taint_state string, verdict string, sha256 string, analysis_level_required int, category string, "
    "boundaries array<struct<function:string,transition:string>>, optional_fields array<struct<field:string,approved_default:string>>"
)
SPECIMEN_BYTES = 1 << 20


def _yaml_rows(batches):
    """Specimens of YAML files, one a file; a file that is none gives a row with its name and no fragment."""
    import yaml

    text = lambda v: None if v is None else str(v)
    for batch in batches:
        out = []
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                data = yaml.safe_load(raw.decode("utf-8")) if raw is not None and len(raw) <= SPECIMEN_BYTES else None
            except (yaml.YAMLError, UnicodeDecodeError):
                data = None
            if not isinstance(data, dict):
                data = {"specimen_id": path}
            bounds = [{"function": text(b.get("function")), "transition": text(b.get("transition"))} for b in data.get("boundaries") or []]
            fields = [{"field": text(f.get("field")), "approved_default": repr(f.get("approved_default"))} for f in data.get("optional_fields") or []]
            own = {k: text(data.get(k)) for k in ("specimen_id", "rule", "fragment", "taint_state", "verdict", "sha256", "category")}
            out.append(own | {"analysis_level_required": int(data.get("analysis_level_required") or 1), "boundaries": bounds, "optional_fields": fields})
        kinds = [(k, pa.string()) for k in ("specimen_id", "rule", "fragment", "taint_state", "verdict", "sha256")]
        pair = lambda *names: pa.list_(pa.struct([(n, pa.string()) for n in names]))
        kinds += [("analysis_level_required", pa.int32()), ("category", pa.string()), ("boundaries", pair("function", "transition")), ("optional_fields", pair("field", "approved_default"))]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))


def specimens(spark: SparkSession, path: str, level: int = 3) -> DataFrame:
    """Labelled fragments up to an analysis level, from JSON lines or from all YAML files below a folder; a wrong or
    missing hash of a fragment fails the load, after those of higher levels are left out."""
    if path.endswith((".json", ".jsonl")):
        rows = spark.read.schema(SPECIMEN).json(path)
    else:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.y{a,}ml").load(path)
        rows = raw.select("path", "content").mapInArrow(_yaml_rows, SPECIMEN)
    rows = rows.filter(F.coalesce("analysis_level_required", F.lit(1)) <= level)
    good = F.sha2("fragment", 256) == F.coalesce("sha256", F.lit(""))
    rows = rows.withColumn("fragment", F.when(good, F.col("fragment")).otherwise(F.raise_error(F.concat(F.lit("hash of "), "specimen_id"))))
    pairs = {"boundaries": "function:string,transition:string", "optional_fields": "field:string,approved_default:string"}
    return rows.withColumnRenamed("rule", "rule_id").withColumns({c: F.coalesce(c, F.array().cast(f"array<struct<{t}>>")) for c, t in pairs.items()})


def sarif_results(findings: DataFrame) -> DataFrame:
    """(place, result): each finding as a JSON object, in the report's order."""
    f = findings.withColumn("ordinal", F.xxhash64("rule_id", "file_path", "line", "col", "message"))
    region = F.struct((F.col("end_col") + 1).alias("endColumn"), F.col("end_line").alias("endLine"), (F.col("col") + 1).alias("startColumn"), F.col("line").alias("startLine"))
    location = F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    level = F.coalesce(*[F.when(F.col("severity") == s, F.lit(v)) for s, v in SARIF_LEVEL.items()])
    properties = F.struct("exceptionability", "qualname", "severity", F.coalesce("taint_state", F.lit("UNKNOWN")).alias("taintState"))
    result = F.to_json(F.struct(level.alias("level"), location.alias("locations"), F.struct(F.col("message").alias("text")).alias("message"), properties.alias("properties"), F.col("rule_id").alias("ruleId")))
    return f.orderBy("file_path", "line", "col", "rule_id", "ordinal").select("file_path", "line", "col", "rule_id", result.alias("result"))


def write_sarif(findings: DataFrame, path: str, version: str, input_hash: str, properties: dict | None = None) -> None:
    """One SARIF document on the driver's disk; results stream from the executors in order.

    properties: what the run says of itself besides the counters of its findings and its input's hash; in a
    verification run it holds no time and no commit.
    """
    rules = sorted(r[0] for r in findings.select("rule_id").distinct().collect())
    head = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"}
    driver = {"driver": {"name": "taintloom", "version": version, "rules": [{"id": r} for r in rules]}}
    known = findings if "exception_id" in findings.columns else findings.withColumn("exception_id", F.lit(None).cast("string"))
    counters = run_properties(known).first().asDict()
    counters["implementedRules"] = [r for r in counters["implementedRules"].split(",") if r]
    told = counters | {"inputHash": input_hash} | {k: v for k, v in (properties or {}).items() if v is not None}
    with open(path, "w", encoding="utf-8") as out:
        out.write(json.dumps(head, sort_keys=True)[:-1] + ', "runs": [{"tool": ' + json.dumps(driver, sort_keys=True) + ', "properties": ' + json.dumps(told, sort_keys=True) + ', "results": [\n')
        for k, row in enumerate(sarif_results(findings).toLocalIterator()):
            out.write((",\n" if k else "") + row.result)
        out.write("\n]}]}\n")


def write_json(value: object, path: str) -> None:
    """A small document (a baseline of the policy, a conformance status) on the driver's disk."""
    with open(path, "w", encoding="utf-8") as out:
        out.write(json.dumps(value, indent=2, sort_keys=True) + "\n")


def write_fingerprints(rows: DataFrame, path: str, version: str) -> None:
    """A baseline that fingerprint_baseline reads: one document, made on the executors."""
    one = rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("fingerprints")).withColumn("python_version", F.lit(version))
    one.coalesce(1).write.mode("overwrite").json(path)
