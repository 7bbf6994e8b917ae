"""Policy files on the driver: manifests, overlays and scanner settings, small by nature.

JSON is always read; YAML where a YAML library is installed; TOML by the standard library.
"""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from taintloom.functions.domains import OVERRIDE_RANK, TAINTS, TIER

LIMIT = 1 << 20
ALIASES = 1000
SKIPPED = (".git", ".venv", "__pycache__", "node_modules", "tests")
SETTINGS = {"target_paths": list, "exclude_paths": list, "enabled_rules": list, "disabled_rules": list, "default_taint": str, "analysis_level": int, "strict_governance": bool, "max_unknown_raw_percent": (int, float), "known_validators": list, "known_validators_extra": list, "max_expansion_rounds": int}


class PolicyError(ValueError):
    """A policy file that may not be used."""


def load(path: str | Path) -> dict:
    """A mapping from a JSON or YAML file within the limits of size and aliases."""
    raw = Path(path).read_bytes()
    if len(raw) > LIMIT:
        raise PolicyError(f"{path}: larger than {LIMIT} bytes")
    text = raw.decode("utf-8")
    try:
        data = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise PolicyError(f"{path}: is not JSON, and no YAML library is installed") from e
        if sum(line.count("*") for line in text.splitlines() if not line.lstrip().startswith("#")) > ALIASES:
            raise PolicyError(f"{path}: too many aliases") from None
        data = yaml.safe_load(text)
    if not isinstance(data, dict):
        raise PolicyError(f"{path}: is no mapping")
    return data


def manifest(path: str | Path) -> dict:
    """A manifest with its lists checked: tiers 1 to 4, known taints, and one ratification role for each duty."""
    data = load(path)
    unknown = set(data) - {"$id", "governance_profile", "tiers", "module_tiers", "rules", "delegation", "metadata", "dependency_taint", "overlay_paths", "max_exception_duration_days", "scanner"}
    if unknown:
        raise PolicyError(f"{path}: unknown keys {sorted(unknown)}")
    _need(path, "tiers", data.get("tiers", []), {"id": str, "tier": int})
    _need(path, "module_tiers", data.get("module_tiers", []), {"path": str, "default_taint": str})
    _need(path, "dependency_taint", data.get("dependency_taint", []), {"package": str, "function": str, "returns_taint": str})
    ids = {t["id"] for t in data.get("tiers", [])}
    for t in data.get("tiers", []):
        if t["tier"] not in (1, 2, 3, 4):
            raise PolicyError(f"{path}: tier {t}")
    known = {name for name, _, _ in TAINTS}
    for m in data.get("module_tiers", []):
        if m["default_taint"] not in known | ids:
            raise PolicyError(f"{path}: {m['path']} has unknown taint {m['default_taint']}")
    for d in data.get("dependency_taint", []):
        if d["returns_taint"] not in known:
            raise PolicyError(f"{path}: {d['package']}.{d['function']} has unknown taint {d['returns_taint']}")
    if data.get("governance_profile", "lite") not in ("lite", "assurance"):
        raise PolicyError(f"{path}: profile {data['governance_profile']}")
    return data


def _need(path: str | Path, what: str, rows: object, fields: dict[str, type]) -> None:
    """Every row of a list is a mapping with these fields."""
    if not isinstance(rows, list):
        raise PolicyError(f"{path}: {what} is no list")
    for r in rows:
        for name, kind in fields.items():
            if not isinstance(r, dict) or not isinstance(r.get(name), kind):
                raise PolicyError(f"{path}: {what}: {r} lacks {name}")


def manifest_hash(path: str | Path) -> str:
    return "sha256:" + hashlib.sha256(Path(path).read_bytes()).hexdigest()


def policy_baseline(data: dict) -> dict:
    """What a manifest says of tiers, as a baseline to compare later manifests with."""
    return {"tiers": [{"id": t["id"], "tier": t["tier"]} for t in data.get("tiers", [])], "module_tiers": [{"path": m["path"], "default_taint": m["default_taint"]} for m in data.get("module_tiers", [])]}


RESOLVED = "0.2"


def resolve(path: str | Path, overlays: list[str]) -> dict:
    """One document of a manifest and its overlays: boundaries, optional fields, bindings and rule overrides, with the
    hash of the manifest. An overlay may not widen a rule of the manifest, and none may declare a boundary twice."""
    data = manifest(path)
    out = {"format_version": RESOLVED, "manifest_hash": manifest_hash(path), "boundaries": [], "optional_fields": [], "contract_bindings": [], "rule_overrides": list(data.get("rules", {}).get("overrides", [])), "overlays_discovered": []}
    for place in overlays:
        over = overlay(place)
        scope = over.get("overlay_for", str(Path(place).parent))
        out["overlays_discovered"].append(str(place))
        for kind in ("boundaries", "optional_fields"):
            out[kind] += [row | {"overlay_scope": scope, "overlay_path": str(place)} for row in over.get(kind, [])]
        out["contract_bindings"] += over.get("contract_bindings", [])
        for rule in over.get("rule_overrides", []):
            base = next((r for r in out["rule_overrides"] if r.get("id") == rule.get("id")), None)
            if base and OVERRIDE_RANK.get(str(rule.get("severity")), -1) < OVERRIDE_RANK.get(str(base.get("severity")), -1):
                raise PolicyError(f"{place}: widens {rule.get('id')}")
            out["rule_overrides"].append(rule | {"overlay_path": str(place)})
    _check_boundaries(out["boundaries"], path)
    return out


def _check_boundaries(rows: list[dict], path: str | Path) -> None:
    seen = set()
    for b in rows:
        if "function" not in b or "transition" not in b:
            raise PolicyError(f"{path}: boundary without function or transition")
        if b["transition"] != "restoration" and b.get("to_tier") == 1 and b.get("from_tier") != 2:
            raise PolicyError(f"{path}: {b['function']} skips a tier")
        key = (b["function"], b["transition"], b.get("overlay_scope"))
        if key in seen:
            raise PolicyError(f"{path}: declared twice: {key}")
        seen.add(key)


def resolved(path: str | Path, manifest_path: str | Path, allow_stale: bool = False) -> dict:
    """A document made by resolve, checked again; one of another manifest is refused unless stale ones are allowed."""
    data = load(path)
    if data.get("format_version") != RESOLVED:
        raise PolicyError(f"{path}: version {data.get('format_version')}")
    if data.get("manifest_hash") != manifest_hash(manifest_path) and not allow_stale:
        raise PolicyError(f"{path}: the manifest has changed since")
    _check_boundaries(data.get("boundaries", []), path)
    return data


def resolved_overlays(data: dict) -> list[tuple[str, dict]]:
    """The overlays that a resolved document was made of, as boundaries() and optional_fields() take them."""
    places: dict[tuple[str, str], dict] = {}
    for kind in ("boundaries", "optional_fields"):
        for row in data.get(kind, []):
            own = places.setdefault((row.get("overlay_path", ""), row.get("overlay_scope", "")), {"overlay_for": row.get("overlay_scope", "")})
            own.setdefault(kind, []).append(row)
    return [(place, own) for (place, _), own in places.items()]


def dependencies(spark: SparkSession, data: dict) -> DataFrame:
    """(package, function, taint) that a manifest declares of dependencies."""
    rows = [(d["package"], d["function"], d["returns_taint"]) for d in data.get("dependency_taint", [])]
    return spark.createDataFrame(rows, "package string, function string, taint string")


def ratification(spark: SparkSession, data: dict) -> DataFrame:
    """One row: who ratified the policy, when, for how long, and how duties are separated."""
    m = data.get("metadata", {})
    authority = m.get("ratified_by")
    row = (m.get("ratification_date"), json.dumps(authority) if isinstance(authority, dict) else authority, m.get("review_interval_days", 180), json.dumps(m["temporal_separation"]) if m.get("temporal_separation") else None)
    return spark.createDataFrame([tuple(None if v is None else v if isinstance(v, int) else str(v) for v in row)], "last_ratified string, authority string, interval int, separation string")


def bindings(spark: SparkSession, overlays: list[tuple[str, dict]]) -> DataFrame:
    rows = [(b["contract"], list(b.get("functions", []))) for _, data in overlays for b in data.get("contract_bindings", [])]
    return spark.createDataFrame(rows, "contract string, functions array<string>")


def overlay(path: str | Path) -> dict:
    """An overlay; a boundary to tier 1 starts at tier 2 or restores, and a restoration has no to_tier."""
    data = load(path)
    for b in data.get("boundaries", []):
        if b.get("transition") == "restoration":
            b.pop("to_tier", None)
        elif b.get("to_tier") == 1 and b.get("from_tier") != 2:
            raise PolicyError(f"{path}: {b.get('function')} skips a tier")
    return data


def settings(path: str | Path) -> dict:
    """Scanner settings from TOML: unknown keys and values of a wrong kind or range are errors; paths are relative to the file."""
    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    data = data.get("scanner", data)
    for k, v in data.items():
        if k not in SETTINGS or not isinstance(v, SETTINGS[k]):
            raise PolicyError(f"{path}: {k} = {v!r}")
    if not 1 <= data.get("analysis_level", 1) <= 3 or not 0 <= data.get("max_unknown_raw_percent", 0) <= 100 or data.get("max_expansion_rounds", 1) < 1:
        raise PolicyError(f"{path}: value out of range")
    for k in ("target_paths", "exclude_paths"):
        data[k] = [str(Path(path).parent / p) for p in data.get(k, [])]
    return data


def find_manifest(start: str | Path, name: str = "policy.yaml") -> Path | None:
    """The nearest manifest upwards; the search ends at a repository root, the home directory or a cycle."""
    at, seen = Path(start).resolve(), set()
    while True:
        if (at / name).is_file():
            return at / name
        inode = (at.stat().st_dev, at.stat().st_ino)
        if (at / ".git").exists() or at == Path.home() or at.parent == at or inode in seen:
            return None
        seen.add(inode)
        at = at.parent


def find_overlays(root: str | Path, allowed: list[str], name: str = "policy.overlay.yaml") -> list[Path]:
    """All overlays below root; one outside the allowed directories is an error unless "*" is allowed."""
    found = []
    for folder, names, files in os.walk(root, followlinks=False):
        names[:] = sorted(n for n in names if n not in SKIPPED)
        if name in files:
            rel = os.path.relpath(folder, root)
            if "*" not in allowed and not any(rel == a.rstrip("/") or rel.startswith(a.rstrip("/") + "/") for a in allowed):
                raise PolicyError(f"overlay outside the allowed directories: {rel}")
            found.append(Path(folder) / name)
    return found


def module_tiers(spark: SparkSession, data: dict) -> DataFrame:
    """(ordinal, path, default_taint, tier id's number) of a manifest."""
    numbers = {t["id"]: t["tier"] for t in data.get("tiers", [])}
    rows = [(k, m["path"], m["default_taint"], numbers.get(m["default_taint"], TIER.get(m["default_taint"]))) for k, m in enumerate(data.get("module_tiers", []))]
    return spark.createDataFrame(rows, "ordinal int, path string, default_taint string, tier int")


def boundaries(spark: SparkSession, overlays: list[tuple[str, dict]]) -> DataFrame:
    """Boundaries of overlays (directory, overlay); one function and transition declared twice is an error."""
    rows, seen = [], set()
    for place, data in overlays:
        scope = data.get("overlay_for", place)
        for b in data.get("boundaries", []):
            key = (b["function"], b["transition"], scope)
            if key in seen:
                raise PolicyError(f"declared twice: {key}")
            seen.add(key)
            rows.append((b["function"], b["transition"], b.get("from_tier"), b.get("to_tier"), b.get("restored_tier"), json.dumps(b["validation_scope"]) if "validation_scope" in b else None, scope, place))
    return spark.createDataFrame(rows, "function string, transition string, from_tier int, to_tier int, restored_tier int, validation_scope string, overlay_scope string, overlay_path string")


def optional_fields(spark: SparkSession, overlays: list[tuple[str, dict]]) -> DataFrame:
    rows = [(f["field"], repr(f["approved_default"]), data.get("overlay_for", place)) for place, data in overlays for f in data.get("optional_fields", [])]
    return spark.createDataFrame(rows, "field string, approved_default string, scope string")
