import hashlib
import json

import pytest

from taintloom.facts.extract import facts, file_facts
from taintloom.functions import domains as D
from taintloom.plans import scan
from taintloom.plans.queries import QUERIES
from taintloom.sources import files


def hits(code, rule):
    return [(r["qualname"], r["line"]) for r in file_facts("m.py", code.encode()) if r["kind"] == "hit" and r["name"] == rule]


@pytest.mark.parametrize("rule,fires,silent", [
    ("PY-WL-001", ["d.get('k', 1)", "d.pop('k', 1)", "d.setdefault('k', 1)", "defaultdict(list)", "collections.defaultdict(int)"], ["d.get('k')", "d.pop('k')", "defaultdict()"]),
    ("PY-WL-002", ["getattr(o, 'a', 1)", "o.a or 1"], ["getattr(o, 'a')", "a or 1", "o.a or b or 1"]),
    ("PY-WL-003", ["'k' in d", "k not in d.keys()", "d.get('k') is None", "None == d.get('k')", "hasattr(o, 'x')", "k in {'a': 1}", "k in d['x']"], ["k in [1]", "k in KNOWN", "k in o.names", "k in func_name", "k in d.values()", "hasattr(n, 'lineno')", "o.c.get('k') is None", "k in set(d)", "k in 'text'"]),
    ("PY-WL-007", ["isinstance(x, int)", "type(x) == int", "type(x) is not int"], ["isinstance(x, ast.Name)", "isinstance(x, (ast.A, ast.B))", "type(x)"]),
])
def test_expressions(rule, fires, silent):
    for e in fires:
        assert hits(f"def f(d, o):\n    y = {e}\n", rule), e
    for e in silent:
        assert not hits(f"def f(d, o):\n    y = {e}\n", rule), e


def handler(head, body):
    return f"def f():\n    for i in x:\n        try:\n            a()\n        except{head}:\n            {body}\n"


def test_handlers():
    assert hits(handler("", "log()"), "PY-WL-004") and hits(handler(" (ValueError, Exception)", "log()"), "PY-WL-004")
    assert not hits(handler(" Exception", "raise"), "PY-WL-004") and not hits(handler(" ValueError", "log()"), "PY-WL-004")
    assert hits("def f():\n    with contextlib.suppress(Exception):\n        a()\n", "PY-WL-004")
    for body in ("pass", "...", "continue", "break"):
        assert hits(handler(" ValueError", body), "PY-WL-005")
    assert not hits(handler(" ValueError", "log()"), "PY-WL-005")
    assert hits(handler(" Exception", "audit(x)"), "PY-WL-006") and not hits(handler(" ValueError", "audit(x)"), "PY-WL-006")


def test_audit_paths():
    assert hits("def f(r):\n    if r:\n        return 1\n    audit(r)\n", "PY-WL-006") == [("f", 3)]
    assert hits("def f(r):\n    if r:\n        audit(r)\n", "PY-WL-006") == [("f", 1)]
    assert not hits("def f(r):\n    if r:\n        raise X\n    log.audit_event(r)\n    return r\n", "PY-WL-006")
    assert not hits("def f(r):\n    try:\n        a()\n    finally:\n        ledger.write(r)\n", "PY-WL-006")


def test_rejections():
    assert not hits("def f(x):\n    raise E\n", "PY-WL-008")
    assert hits("def f(x):\n    if False:\n        raise E\n", "PY-WL-008")
    assert not hits("def f(x):\n    if not x:\n        return None\n", "PY-WL-008")
    assert hits("def f(x):\n    def g():\n        raise E\n    return x\n", "PY-WL-008")


def test_semantic_checks():
    assert hits("def f(d):\n    if d['a'] > 1:\n        pass\n", "PY-WL-009")
    assert not hits("def f(d):\n    validate_schema(d)\n    if d['a'] > 1:\n        pass\n", "PY-WL-009")
    assert not hits("def f(d):\n    ok = isinstance(d, dict)\n    assert d['a']\n", "PY-WL-009")
    assert hits("def f(d):\n    isinstance(d, dict)\n    assert d['a']\n", "PY-WL-009")


def test_sets_in_closures():
    assert not hits("def f():\n    s = set()\n    def g(k):\n        return k in s\n", "PY-WL-003")
    assert hits("def f():\n    s = set()\ndef g(k, s):\n    return k in s\n", "PY-WL-003") == [("g", 4)]


CONTRACTS = """
from pkg import atomic, deterministic, handles_pii, not_reentrant, privileged_operation, ordered_after, feature_gated, test_only
@atomic
def a(db):
    db.save(1)
    db.save(2)
@deterministic
def b():
    return random.random()
@handles_pii(fields=("email",))
def c(email):
    logger.info(email)
@handles_pii(fields=("email",))
def d(email):
    logger.info(hash_value(email))
@privileged_operation
def e(db):
    db.delete(1)
    check_permission()
@ordered_after("first")
def last(): ...
def user():
    last()
    first()
@feature_gated(flag="new-thing")
def g(): ...
"""


def test_contracts(spark):
    rows = list(file_facts("m.py", CONTRACTS.encode()))
    found = {(r["qualname"], r["name"]) for r in rows if r["kind"] == "breach"}
    assert found == {("a", "ERROR"), ("b", "ERROR"), ("c", "ERROR"), ("e", "ERROR"), ("user", "ERROR")}
    assert not [r for r in rows if r["kind"] == "tool_error"]


def test_scan_joins_policy(spark):
    rows = {(r.rule_id, r.qualname): r for r in QUERIES["scan_sample_sources"](spark, "").collect()}
    assert rows["PY-WL-004", "fetch"].taint_state == "EXTERNAL_RAW"
    # handle is ASSURED by its module, and calls an external boundary
    assert rows["PY-WL-002", "handle"].taint_state == "EXTERNAL_RAW" and rows["PY-WL-002", "handle"].severity == "WARNING"
    assert ("PY-WL-008", "check") in rows and ("SCN-021", "confused") in rows
    assert ("GOVERNANCE-FILE-SKIPPED", None) in rows
    assert rows["PY-WL-006", "Store.save"].severity == "ERROR"


def test_delegated_rejection_and_boundaries(spark):
    code = {"p/a.py": "from p.b import must\ndef check(x):\n    must(x)\n    return x\ndef weak(x):\n    return x\n", "p/b.py": "def must(x):\n    raise E\n"}
    sources = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in code.items()], "path string, content binary")
    found = facts(sources).cache()
    none = spark.createDataFrame([], "field string, approved_default string, scope string")
    tiers = spark.createDataFrame([(0, "p", "ASSURED")], "ordinal int, path string, default_taint string")
    b = spark.createDataFrame([("check", "shape_validation", "p"), ("weak", "shape_validation", "p"), ("must", "shape_validation", "elsewhere")], "function string, transition string, overlay_scope string")
    got = scan.findings(found, scan.function_taints(found, tiers), b, none).filter("rule_id = 'PY-WL-008'").collect()
    assert [r.qualname for r in got] == ["weak"]


def test_governed_defaults(spark):
    code = "def f(d):\n    a = schema_default(d.get('x', 1))\n    b = schema_default(d.get('x', 2))\n    c = schema_default(d.get('y', 1))\n"
    found = facts(spark.createDataFrame([("p/a.py", bytearray(code.encode()))], "path string, content binary")).cache()
    tiers = spark.createDataFrame([(0, "p", "ASSURED")], "ordinal int, path string, default_taint string")
    b = spark.createDataFrame([("f", "shape_validation", "p")], "function string, transition string, overlay_scope string")
    fields = spark.createDataFrame([("x", "1", "p")], "field string, approved_default string, scope string")
    got = {r.line: (r.rule_id.rsplit("-", 2)[-2], r.exceptionability) for r in scan.findings(found, scan.function_taints(found, tiers), b, fields).filter("rule_id like 'PY-WL-001-%'").collect()}
    assert got == {2: ("GOVERNED", "TRANSPARENT"), 3: ("UNGOVERNED", "UNCONDITIONAL"), 4: ("UNGOVERNED", "UNCONDITIONAL")}


def test_corpus_and_sources(spark, tmp_path):
    good = "def f(d):\n    return d.get('k', 1)\n"
    lines = [{"specimen_id": f"s{i}", "rule": "PY-WL-001", "fragment": frag, "taint_state": t, "verdict": v, "sha256": hashlib.sha256(frag.encode()).hexdigest()} for i, (frag, t, v) in enumerate([(good, "INTEGRAL", "true_positive"), ("def f(d):\n    return d\n", "INTEGRAL", "true_negative"), (good, "EXTERNAL_RAW", "true_positive")])]
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, lines)))
    got = {r.specimen_id: r.fired for r in scan.verify_corpus(files.specimens(spark, str(tmp_path / "s.json"))).collect()}
    assert got == {"s0": True, "s1": False, "s2": False}
    (tmp_path / "src/skip").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "src/skip/b.py").write_text("x = 1")
    (tmp_path / "src/c.txt").write_text("x")
    assert [r.path for r in files.source_tree(spark, str(tmp_path / "src"), ("skip",)).collect()] == ["a.py"]
    entry = {"id": "E1", "rule": "PY-WL-002", "taint_state": "GUARDED", "location": "a.py::f", "ast_fingerprint": "ab"}
    (tmp_path / "r.json").write_text(json.dumps({"exceptions": [entry]}))
    register = files.exception_register(spark, str(tmp_path / "r.json"), D.severity_matrix(spark))
    assert [(r.id, r.ordinal) for r in register.collect()] == [("E1", 0)]
    (tmp_path / "r.json").write_text(json.dumps({"exceptions": [entry | {"taint_state": "INTEGRAL"}]}))
    with pytest.raises(Exception, match="may not stand"):
        files.exception_register(spark, str(tmp_path / "r.json"), D.severity_matrix(spark)).collect()
    files.write_sarif(QUERIES["scan_sample_sources"](spark, ""), str(tmp_path / "out.json"), "0.1", "sha256:0")
    report = json.loads((tmp_path / "out.json").read_text())
    assert report["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] >= 1


def test_governance_rows(spark):
    code = """
from t import external_boundary, integral_read, restoration_boundary
@external_boundary
@integral_read
def a(x):
    return x
@restoration_boundary(restored_tier=1, structural_evidence=True, semantic_evidence=True, institutional_provenance="board")
def b(x):
    q(x); r(x); s(x)
    return __import__("os")
"""
    many = "".join(f"def f{i}(x):\n    return x\n" for i in range(6))
    found = facts(spark.createDataFrame([("p/a.py", bytearray(code.encode())), ("p/b.py", bytearray(many.encode()))], "path string, content binary")).cache()
    tiers = spark.createDataFrame([(0, "p", "ASSURED")], "ordinal int, path string, default_taint string")
    taints = scan.function_taints(found, tiers)
    assert {r.qualname: r.body_taint for r in taints.filter("file_path = 'p/a.py'").collect()} == {"a": "EXTERNAL_RAW", "b": "ASSURED"}
    none = [spark.createDataFrame([], s) for s in ("function string, transition string, overlay_scope string", "field string, approved_default string, scope string")]
    got = {(r.rule_id, r.file_path) for r in scan.findings(found, taints, *none).filter("rule_id not like 'PY-%'").collect()}
    assert got >= {("GOVERNANCE-TAINT-CONFLICT", "p/a.py"), ("GOVERNANCE-MODULE-TIERS-BLANKET", "p/b.py"), ("GOVERNANCE-MODULE-TIERS-UNDECORATED", "p/b.py"), ("L3-LOW-RESOLUTION", "p/a.py"), ("DYNAMIC-IMPORT", "p/a.py")}
