import json

import pytest

from taintloom import decorators as D
from taintloom.__main__ import main
from taintloom.facts.flow import variable_taints
from taintloom.functions.domains import GROUP
from taintloom.sources import config

CODE = b"""
import json
import requests
def f(p):
    a = 1
    b = [] if p else [p]
    c = json.loads(p)
    d = helper(a)
    e = a
    if p:
        e = c
    for g in d:
        h = g
    i, j = 1, p
    k = requests.get(p)
    try:
        m = 1
    except E as err:
        m = p
    return f"{a}"
def helper(x):
    return x
"""


def test_variable_taints(spark):
    sources = spark.createDataFrame([("a.py", bytearray(CODE)), ("b.py", bytearray(b"def ("))], "path string, content binary")
    taints = spark.createDataFrame([("a.py", "f", "GUARDED"), ("a.py", "helper", "EXTERNAL_RAW")], "file_path string, qualname string, body_taint string")
    deps = spark.createDataFrame([("requests.post", "ASSURED")], "name string, taint string")
    got = {r.variable: r.taint for r in variable_taints(sources, taints, deps).filter("qualname = 'f'").collect()}
    assert got == {
        "p": "GUARDED", "a": "INTEGRAL", "b": "MIXED_RAW", "c": "UNKNOWN_RAW", "d": "EXTERNAL_RAW", "e": "MIXED_RAW", "g": "EXTERNAL_RAW", "h": "EXTERNAL_RAW",
        "i": "INTEGRAL", "j": "GUARDED", "k": "UNKNOWN_RAW", "m": "MIXED_RAW", "err": "GUARDED",
    }


def test_decorators(spark):
    assert len(GROUP) == 39 and all(callable(getattr(D, n)) for n in GROUP)

    @D.external_boundary
    @D.integral_read
    @D.deprecated_by(date="2030-01-01")
    def f():
        return 1

    assert f() == 1 and D.tier_of(f) == 1 and list(D.marks(f)) == ["deprecated_by", "integral_read", "external_boundary"]
    assert D.require(f, 1) is f
    with pytest.raises(D.TierViolation):
        D.require(object(), 3)
    seen = []
    D.set_violation_handler(seen.append)
    D.require(object(), 3)
    D.set_violation_handler(None)
    assert len(seen) == 1
    good, bad = D.split_by_tier(spark.createDataFrame([(1,), (4,), (None,)], "tier int"), "tier", 2)
    assert good.count() == 1 and bad.count() == 2


def test_policy_files(tmp_path):
    (tmp_path / "policy.yaml").write_text(json.dumps({"tiers": [{"id": "T1", "tier": 1}], "module_tiers": [{"path": "a", "default_taint": "ASSURED"}]}))
    (tmp_path / "x/y").mkdir(parents=True)
    assert config.find_manifest(tmp_path / "x/y") == (tmp_path / "policy.yaml").resolve()
    assert config.manifest(tmp_path / "policy.yaml")["module_tiers"]
    (tmp_path / "bad.json").write_text('{"tiers": [{"id": "T", "tier": 9}]}')
    with pytest.raises(config.PolicyError):
        config.manifest(tmp_path / "bad.json")
    (tmp_path / "x/policy.overlay.yaml").write_text('{"boundaries": [{"function": "f", "transition": "construction", "to_tier": 1, "from_tier": 3}]}')
    with pytest.raises(config.PolicyError):
        config.overlay(tmp_path / "x/policy.overlay.yaml")
    assert len(config.find_overlays(tmp_path, ["x"])) == 1
    with pytest.raises(config.PolicyError):
        config.find_overlays(tmp_path, ["z"])
    (tmp_path / "s.toml").write_text('analysis_level = 3\ntarget_paths = ["src"]\n')
    assert config.settings(tmp_path / "s.toml")["target_paths"] == [str(tmp_path / "src")]
    (tmp_path / "s.toml").write_text("analysis_level = 4\n")
    with pytest.raises(config.PolicyError):
        config.settings(tmp_path / "s.toml")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def f(d):\n    return d.get('k', 1)\n")
    (tmp_path / "m.json").write_text(json.dumps({"module_tiers": [{"path": "a.py", "default_taint": "INTEGRAL"}]}))
    assert main(["scan", str(tmp_path / "src"), "--manifest", str(tmp_path / "m.json"), "--output", str(tmp_path / "o.json"), "--level", "3"]) == 1
    assert "n_blocking=1" in capsys.readouterr().out
    rules = [r["ruleId"] for r in json.loads((tmp_path / "o.json").read_text())["runs"][0]["results"]]
    assert rules == ["GOVERNANCE-MODULE-TIERS-UNDECORATED", "L3-LOW-RESOLUTION", "PY-WL-001"]
    assert main(["scan", str(tmp_path / "src"), "--disable", "PY-WL-001"]) == 0
    assert main(["explain", str(tmp_path / "src"), "--qualname", "f"]) == 0
