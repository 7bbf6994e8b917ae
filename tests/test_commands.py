import json

import pytest

from taintloom.__main__ import main
from taintloom.sources import config, files

CODE = """
from taintloom import validates_shape, fail_open
def f(d):
    return d.get('k', 1)
def g(d):
    return d.get('k', 1)
@validates_shape
def check(x):
    return x
"""


@pytest.fixture
def project(tmp_path):
    (tmp_path / "src/p").mkdir(parents=True)
    (tmp_path / "src/p/a.py").write_text(CODE)
    (tmp_path / "m.json").write_text(json.dumps({"tiers": [{"id": "T", "tier": 2}], "module_tiers": [{"path": "p", "default_taint": "ASSURED"}], "metadata": {"ratified_by": "board", "ratification_date": "2026-01-01", "review_interval_days": 90}}))
    overlay = {"overlay_for": "p", "boundaries": [{"function": "check", "transition": "shape_validation", "from_tier": 4, "to_tier": 3}, {"function": "gone", "transition": "semantic_validation"}], "contract_bindings": [{"contract": "c", "functions": ["nowhere"]}]}
    (tmp_path / "o.json").write_text(json.dumps(overlay))
    (tmp_path / "r.json").write_text(json.dumps({"exceptions": []}))
    return tmp_path


def run(project, *args):
    return main([args[0], *([args[1]] if args[1] and not args[1].startswith("-") else []), str(project / "src"), *(a for a in args[1 if args[1].startswith("-") else 2 :])])


def report(project):
    return json.loads((project / "out.json").read_text())["runs"][0]


def test_exceptions_cover_findings(spark, project, capsys):
    m, out = ["--manifest", str(project / "m.json"), "--overlay", str(project / "o.json")], ["--output", str(project / "out.json")]
    assert run(project, "scan", "--level", "3", *m, *out) == 1
    first = report(project)
    assert first["properties"]["gateBlockingCount"] == 3 and first["properties"]["errorFindingCount"] == 3 and first["properties"]["controlLaw"] == "normal"
    assert sorted(r["properties"]["qualname"] for r in first["results"] if r["ruleId"] == "PY-WL-001") == ["f", "g"]
    new = str(project / "new")
    add = ["--register", str(project / "r.json"), "--rule", "PY-WL-001", "--taint", "ASSURED", "--by", "me", "--why", "known", "--output", new, "--now", "2026-02-01"]
    assert run(project, "exception", "add", *m, *add, "--location", "p/a.py::f", "--expires", "soon") == 1
    assert run(project, "exception", "add", *m, *add, "--location", "p/a.py::f", "--expires", "2026-06-01") == 0
    held = ["--register", new]
    assert run(project, "scan", *m, *held, *out, "--now", "2026-02-01") == 1
    assert report(project)["properties"]["gateBlockingCount"] == 2 and report(project)["properties"]["exceptedFindingCount"] == 1
    assert run(project, "scan", *m, *held, *out, "--now", "2026-07-01") == 1
    assert report(project)["properties"]["gateBlockingCount"] == 3  # it has ended
    (project / "m.json").write_text((project / "m.json").read_text().replace("ASSURED", "INTEGRAL"))
    run(project, "scan", *m, *held, *out, "--now", "2026-02-01")
    assert "GOVERNANCE-EXCEPTION-TAINT-DRIFT" in {r["ruleId"] for r in report(project)["results"]}
    capsys.readouterr()
    run(project, "exception", "preview-drift", *m, *held)
    assert "INTEGRAL" in capsys.readouterr().out
    run(project, "exception", "review", *m, *held, "--now", "2026-02-01")
    assert run(project, "exception", "expire", *m, *held, "--id", "none", "--output", str(project / "newer"), "--now", "2026-02-01") == 0


def test_policy_commands(spark, project, capsys):
    m = ["--manifest", str(project / "m.json"), "--overlay", str(project / "o.json"), "--now", "2026-02-01"]
    assert run(project, "manifest", "baseline", *m, "--output", str(project / "b.json")) == 0
    assert json.loads((project / "b.json").read_text())["module_tiers"] == [{"path": "p", "default_taint": "ASSURED"}]
    assert run(project, "coherence", *m, "--baseline", str(project / "b.json")) == 0
    shown = capsys.readouterr().out
    for kind in ("undeclared_boundary", "stale_contract_binding", "unmatched_contract", "missing_validation_scope", "first_scan_perimeter"):
        assert kind in shown
    assert run(project, "coherence", *m, "--gate") == 1
    assert run(project, "regime", "verify", *m) == 1
    shown = capsys.readouterr().out
    assert "manifest_loads" in shown and "ratification_current" in shown
    assert run(project, "regime", "status", *m, "--disable", "PY-WL-008") == 0
    # a resolved document stands for its overlays, while the manifest is the same
    assert run(project, "resolve", *m, "--output", str(project / "res.json")) == 0
    resolved = config.resolved(project / "res.json", project / "m.json")
    assert [b["function"] for b in resolved["boundaries"]] == ["check", "gone"]
    (project / "m.json").write_text((project / "m.json").read_text() + " ")
    with pytest.raises(config.PolicyError, match="changed"):
        config.resolved(project / "res.json", project / "m.json")
    assert main(["manifest", "validate", "x", "--manifest", str(project / "m.json"), "--resolved", str(project / "res.json")]) == 2
    assert main(["manifest", "validate", "x", "--manifest", str(project / "m.json"), "--resolved", str(project / "res.json"), "--allow-stale-resolved"]) == 0
    for bad in ({"tiers": [{"id": "T", "tier": 5}]}, {"tiers": [{"id": 1, "tier": 1}]}, {"module_tiers": [{"path": "p", "default_taint": "X"}]}, {"module_tiers": {}}, {"dependency_taint": [{"package": "a"}]}, {"governance_profile": "none"}):
        (project / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(config.PolicyError):
            config.manifest(project / "bad.json")


def test_fingerprints_and_publish(spark, project, capsys):
    m = ["--manifest", str(project / "m.json"), "--now", "2026-02-01"]
    assert run(project, "fingerprint", "update", *m, "--output", str(project / "fp")) == 0
    assert [(r.qualified_name, r.module, r.tier_context, r.boundary_transition) for r in files.fingerprint_baseline(spark, str(project / "fp")).collect()] == [("check", "p.a", 2, "shape_validation")]
    (project / "src/p/a.py").write_text(CODE.replace("@validates_shape", "@validates_shape\n@fail_open") + "@fail_open\ndef more(): ...\n")
    assert run(project, "fingerprint", "diff", *m, "--fingerprints", str(project / "fp")) == 0
    shown = capsys.readouterr().out
    assert "MODIFIED" in shown and "ADDED" in shown
    from taintloom.functions.domains import MATRIX
    from taintloom.plans.samples import specimens
    import hashlib

    (project / "corpus").mkdir()
    for name, rule, fragment, taint, verdict, bounds in specimens(MATRIX)[:2]:
        body = "".join(f"  {line}\n" for line in fragment.splitlines())
        (project / f"corpus/{name}.yaml").write_text(f"specimen_id: {name}\nrule: {rule}\nfragment: |\n{body}taint_state: {taint}\nverdict: {verdict}\nsha256: {hashlib.sha256(fragment.encode()).hexdigest()}\n")
    out = str(project / "c.json")
    assert run(project, "publish", *m, "--corpus", str(project / "corpus"), "--output", out) == 0
    status = json.loads((project / "c.json").read_text())
    assert status["corpus_verdict"] == "PASS" and status["self_hosting_verdict"] == "FAIL" and "taint_flow: 0/8" in status["gaps"]
    run(project, "scan", *m, "--conformance", out, "--output", str(project / "out.json"))
    assert not [g for g in report(project)["properties"]["conformanceGaps"] if "stale" in g]
    (project / "src/p/b.py").write_text("x = 1\n")
    run(project, "scan", *m, "--conformance", out, "--output", str(project / "out.json"))
    assert "conformance status stale: input_hash" in report(project)["properties"]["conformanceGaps"]
    assert run(project, "lint", "--level", "1") == 1
