"""Fixed values of the analysis: taints, tiers, severities, decorators and the tables between them.

Results depend on these values being as they are; they are stated here once, as data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# taint, rank (0 most trusted), authority tier (1 most trusted)
TAINTS = (
    ("INTEGRAL", 0, 1),
    ("ASSURED", 1, 2),
    ("GUARDED", 2, 3),
    ("UNKNOWN_ASSURED", 3, 3),
    ("UNKNOWN_GUARDED", 4, 3),
    ("EXTERNAL_RAW", 5, 4),
    ("UNKNOWN_RAW", 6, 4),
    ("MIXED_RAW", 7, 4),
)
RANK = {t: r for t, r, _ in TAINTS}
TIER = {t: n for t, _, n in TAINTS}
SEVERITY_RANK = {"SUPPRESS": 0, "WARNING": 1, "ERROR": 2}

# rule, taint, severity, exceptionability
MATRIX = (
    ("PY-WL-001", "INTEGRAL", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-001", "ASSURED", "ERROR", "STANDARD"),
    ("PY-WL-001", "GUARDED", "WARNING", "RELAXED"),
    ("PY-WL-001", "EXTERNAL_RAW", "SUPPRESS", "TRANSPARENT"),
    ("PY-WL-001", "UNKNOWN_RAW", "SUPPRESS", "TRANSPARENT"),
    ("PY-WL-001", "UNKNOWN_GUARDED", "WARNING", "RELAXED"),
    ("PY-WL-001", "UNKNOWN_ASSURED", "ERROR", "STANDARD"),
    ("PY-WL-001", "MIXED_RAW", "SUPPRESS", "TRANSPARENT"),
    ("PY-WL-002", "INTEGRAL", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-002", "ASSURED", "ERROR", "STANDARD"),
    ("PY-WL-002", "GUARDED", "WARNING", "RELAXED"),
    ("PY-WL-002", "EXTERNAL_RAW", "WARNING", "RELAXED"),
    ("PY-WL-002", "UNKNOWN_RAW", "WARNING", "RELAXED"),
    ("PY-WL-002", "UNKNOWN_GUARDED", "WARNING", "RELAXED"),
    ("PY-WL-002", "UNKNOWN_ASSURED", "ERROR", "STANDARD"),
    ("PY-WL-002", "MIXED_RAW", "WARNING", "STANDARD"),
    ("PY-WL-003", "INTEGRAL", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-003", "ASSURED", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-003", "GUARDED", "ERROR", "STANDARD"),
    ("PY-WL-003", "EXTERNAL_RAW", "SUPPRESS", "TRANSPARENT"),
    ("PY-WL-003", "UNKNOWN_RAW", "SUPPRESS", "TRANSPARENT"),
    ("PY-WL-003", "UNKNOWN_GUARDED", "ERROR", "STANDARD"),
    ("PY-WL-003", "UNKNOWN_ASSURED", "ERROR", "STANDARD"),
    ("PY-WL-003", "MIXED_RAW", "SUPPRESS", "TRANSPARENT"),
    ("PY-WL-004", "INTEGRAL", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-004", "ASSURED", "ERROR", "STANDARD"),
    ("PY-WL-004", "GUARDED", "WARNING", "STANDARD"),
    ("PY-WL-004", "EXTERNAL_RAW", "WARNING", "RELAXED"),
    ("PY-WL-004", "UNKNOWN_RAW", "ERROR", "STANDARD"),
    ("PY-WL-004", "UNKNOWN_GUARDED", "WARNING", "STANDARD"),
    ("PY-WL-004", "UNKNOWN_ASSURED", "WARNING", "STANDARD"),
    ("PY-WL-004", "MIXED_RAW", "ERROR", "STANDARD"),
    ("PY-WL-005", "INTEGRAL", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-005", "ASSURED", "ERROR", "STANDARD"),
    ("PY-WL-005", "GUARDED", "WARNING", "STANDARD"),
    ("PY-WL-005", "EXTERNAL_RAW", "WARNING", "RELAXED"),
    ("PY-WL-005", "UNKNOWN_RAW", "ERROR", "STANDARD"),
    ("PY-WL-005", "UNKNOWN_GUARDED", "WARNING", "STANDARD"),
    ("PY-WL-005", "UNKNOWN_ASSURED", "WARNING", "STANDARD"),
    ("PY-WL-005", "MIXED_RAW", "ERROR", "STANDARD"),
    ("PY-WL-006", "INTEGRAL", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-006", "ASSURED", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-006", "GUARDED", "ERROR", "STANDARD"),
    ("PY-WL-006", "EXTERNAL_RAW", "ERROR", "STANDARD"),
    ("PY-WL-006", "UNKNOWN_RAW", "ERROR", "STANDARD"),
    ("PY-WL-006", "UNKNOWN_GUARDED", "ERROR", "STANDARD"),
    ("PY-WL-006", "UNKNOWN_ASSURED", "ERROR", "STANDARD"),
    ("PY-WL-006", "MIXED_RAW", "ERROR", "STANDARD"),
    ("PY-WL-007", "INTEGRAL", "ERROR", "STANDARD"),
    ("PY-WL-007", "ASSURED", "WARNING", "RELAXED"),
    ("PY-WL-007", "GUARDED", "WARNING", "RELAXED"),
    ("PY-WL-007", "EXTERNAL_RAW", "SUPPRESS", "TRANSPARENT"),
    ("PY-WL-007", "UNKNOWN_RAW", "SUPPRESS", "TRANSPARENT"),
    ("PY-WL-007", "UNKNOWN_GUARDED", "WARNING", "RELAXED"),
    ("PY-WL-007", "UNKNOWN_ASSURED", "WARNING", "RELAXED"),
    ("PY-WL-007", "MIXED_RAW", "WARNING", "STANDARD"),
    ("PY-WL-008", "INTEGRAL", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-008", "ASSURED", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-008", "GUARDED", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-008", "EXTERNAL_RAW", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-008", "UNKNOWN_RAW", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-008", "UNKNOWN_GUARDED", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-008", "UNKNOWN_ASSURED", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-008", "MIXED_RAW", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-009", "INTEGRAL", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-009", "ASSURED", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-009", "GUARDED", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-009", "EXTERNAL_RAW", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-009", "UNKNOWN_RAW", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-009", "UNKNOWN_GUARDED", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-009", "UNKNOWN_ASSURED", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-009", "MIXED_RAW", "ERROR", "UNCONDITIONAL"),
)
RULES = (*dict.fromkeys(rule for rule, _, _, _ in MATRIX), "SCN-021", "SCN-022", "SUP-001")

# decorator names by group
REGISTRY = {
    1: ("external_boundary", "validates_shape", "validates_semantic", "validates_external", "integral_read", "integral_writer", "integral_construction"),
    2: ("integrity_critical",),
    3: ("system_plugin",),
    4: ("int_data",),
    5: ("all_fields_mapped", "output_schema"),
    6: ("trust_boundary", "tier_transition"),
    7: ("parse_at_init",),
    8: ("handles_secrets",),
    9: ("idempotent", "atomic", "compensatable"),
    10: ("fail_closed", "fail_open", "emits_or_explains", "exception_boundary", "must_propagate", "preserve_cause"),
    11: ("handles_pii", "handles_classified", "declassifies"),
    12: ("deterministic", "time_dependent"),
    13: ("thread_safe", "ordered_after", "not_reentrant"),
    14: ("requires_identity", "privileged_operation"),
    15: ("test_only", "deprecated_by", "feature_gated"),
    17: ("restoration_boundary",),
}
GROUP = {name: g for g, names in REGISTRY.items() for name in names}

# decorator: taint of the body, taint of what it returns
DECORATOR_TAINTS = {
    "external_boundary": ("EXTERNAL_RAW", "EXTERNAL_RAW"),
    "validates_shape": ("EXTERNAL_RAW", "GUARDED"),
    "validates_semantic": ("GUARDED", "ASSURED"),
    "validates_external": ("EXTERNAL_RAW", "ASSURED"),
    "integral_read": ("INTEGRAL", "INTEGRAL"),
    "integral_writer": ("INTEGRAL", "INTEGRAL"),
    "integral_construction": ("INTEGRAL", "INTEGRAL"),
}
# decorator: boundary transition that fingerprints record
TRANSITIONS = {
    "validates_shape": "shape_validation",
    "validates_semantic": "semantic_validation",
    "validates_external": "external_validation",
    "integral_construction": "construction",
    "external_boundary": "ingress",
}
# decorators that contradict each other, and what a pair on one function counts as
PAIRS = (
    ("fail_open", "fail_closed", "ERROR"),
    ("fail_open", "integral_read", "ERROR"),
    ("fail_open", "integral_writer", "ERROR"),
    ("fail_open", "integral_construction", "ERROR"),
    ("fail_open", "integrity_critical", "ERROR"),
    ("external_boundary", "int_data", "ERROR"),
    ("external_boundary", "integral_read", "ERROR"),
    ("external_boundary", "integral_construction", "ERROR"),
    ("validates_shape", "validates_semantic", "ERROR"),
    ("validates_shape", "integral_read", "ERROR"),
    ("validates_semantic", "external_boundary", "ERROR"),
    ("exception_boundary", "must_propagate", "ERROR"),
    ("idempotent", "compensatable", "ERROR"),
    ("deterministic", "time_dependent", "ERROR"),
    ("deterministic", "external_boundary", "ERROR"),
    ("integral_read", "restoration_boundary", "ERROR"),
    ("integral_writer", "restoration_boundary", "ERROR"),
    ("external_boundary", "restoration_boundary", "ERROR"),
    ("validates_shape", "restoration_boundary", "ERROR"),
    ("validates_semantic", "restoration_boundary", "ERROR"),
    ("validates_external", "restoration_boundary", "ERROR"),
    ("integral_construction", "restoration_boundary", "ERROR"),
    ("fail_closed", "emits_or_explains", "ERROR"),
    ("validates_external", "validates_shape", "ERROR"),
    ("validates_external", "validates_semantic", "ERROR"),
    ("int_data", "validates_shape", "ERROR"),
    ("preserve_cause", "exception_boundary", "ERROR"),
    ("compensatable", "integral_writer", "ERROR"),
    ("system_plugin", "integral_read", "ERROR"),
    ("fail_open", "deterministic", "WARNING"),
    ("compensatable", "deterministic", "WARNING"),
    ("time_dependent", "idempotent", "WARNING"),
)

BUILTIN_VALIDATORS = (
    "jsonschema.validate", "jsonschema.Draft4Validator.validate", "jsonschema.Draft7Validator.validate", "pydantic.TypeAdapter.validate_python",
    "pydantic.BaseModel.model_validate", "marshmallow.Schema.load", "marshmallow.Schema.loads",
)
COHERENCE_ERRORS = ("tier_topology_inconsistency", "tier_downgrade", "tier_upgrade_without_evidence", "missing_validation_scope", "insufficient_restoration_evidence")
COHERENCE_POLICY = ("tier_topology_inconsistency", "tier_downgrade", "tier_upgrade_without_evidence")
OVERRIDE_RANK = {"OFF": 0, "INFO": 1, "WARNING": 2, "ERROR": 3, "CRITICAL": 4}
CLASSIFICATION_RANK = {"OFFICIAL": 0, "PUBLIC": 0, "INTERNAL": 1, "PROTECTED": 2, "SECRET": 3, "TOP_SECRET": 4}
SARIF_LEVEL = {"ERROR": "error", "WARNING": "warning", "SUPPRESS": "note"}
CATEGORY_FLOORS = {"suppression_interaction": 3, "taint_flow": 8}


def taints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAINTS, "taint string, rank int, tier int")


def severity_matrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MATRIX, "rule_id string, taint_state string, severity string, exceptionability string")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GROUP.items()), "name string, group int")


def pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAIRS, "left string, right string, severity string")
