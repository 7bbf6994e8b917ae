"""The fact stage: one Arrow-mapped pass that reads, decodes and parses each file once and emits tagged rows."""

from __future__ import annotations

import ast
import hashlib
import io
import sys
import tokenize
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from taintloom.facts.checks import CHECKS, rejects
from taintloom.facts.contracts import advice, breaches, flag_reference
from taintloom.facts.tree import Function, Module, dotted, last_name, of_packages
from taintloom.functions.domains import GROUP

SCHEMA = (
    "kind string, file_path string, qualname string, name string, target string, value string, "
    "line int, col int, end_line int, end_col int, pos int, n int, flag boolean"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def decode(raw: bytes) -> str:
    """Source text by its byte order mark or coding line."""
    encoding, _ = tokenize.detect_encoding(io.BytesIO(raw).readline)
    return io.TextIOWrapper(io.BytesIO(raw), encoding).read()


def module_name(path: str) -> str | None:
    parts = path.removesuffix(".py").split("/")
    if parts[-1] == "__init__":
        parts.pop()
    return ".".join(parts) or None


def _at(node: ast.AST) -> dict:
    return {"line": getattr(node, "lineno", 1), "col": getattr(node, "col_offset", 0), "end_line": getattr(node, "end_lineno", None), "end_col": getattr(node, "end_col_offset", None)}


def _dynamic_import(n: ast.AST, packages: tuple[str, ...] | None) -> str | None:
    """The literal name that a call imports: any, or one of the packages by __import__ or importlib.import_module."""
    if not (isinstance(n, ast.Call) and n.args and isinstance(n.args[0], ast.Constant) and isinstance(name := n.args[0].value, str)):
        return None
    if packages is None:
        return name if last_name(n) in ("__import__", "import_module") else None
    return name if dotted(n.func) in ("__import__", "importlib.import_module") and of_packages(name, packages) else None


def file_facts(path: str, raw: bytes, packages: tuple[str, ...] | None = None) -> Iterator[dict]:
    """Rows of one file. A file that cannot be read or parsed gives one row of kind skipped; a check that
    fails on a function gives one of kind tool_error, and the others go on."""
    try:
        text = decode(raw)
        tree = ast.parse(text, filename=path)
    except (SyntaxError, ValueError, LookupError, RecursionError) as e:
        yield {"kind": "skipped", "name": type(e).__name__, "line": getattr(e, "lineno", None) or 1, "col": getattr(e, "offset", None) or 0}
        return
    module = module_name(path)
    m = Module(tree, path, frozenset(GROUP), packages)
    yield {"kind": "file", "name": module, "value": hashlib.sha256(raw).hexdigest(), "n": len(m.functions)}
    for name, full in m.aliases.items():
        yield {"kind": "import", "name": name, "target": full}
    for n in tree.body:
        if isinstance(n, ast.ImportFrom) and n.module:
            yield from ({"kind": "from_import", "name": a.name, "target": n.module, **_at(n)} for a in n.names if a.name != "*")
    for n in ast.walk(tree):
        if (named := _dynamic_import(n, packages)) is not None:
            yield {"kind": "dynamic_import", "name": named, **_at(n)}
        elif isinstance(n, ast.ClassDef):
            fields = [s.target.id for s in n.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)]
            yield {"kind": "class", "name": n.name, "value": ",".join(fields), **_at(n)}
    literals = Counter(n.value for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str) and n.value)
    yield from ({"kind": "literal", "value": v, "n": c} for v, c in literals.items())
    yield from ({"kind": "advice", "name": rule, **_at(n)} for rule, n in advice(tree))
    top = {f.qualname for f in m.functions if "." not in f.qualname}
    classes = {n.name for n in tree.body if isinstance(n, ast.ClassDef)}
    local = frozenset(f"{module}.{f.qualname}" if module else f.qualname for f in m.functions)
    every = {f.qualname for f in m.functions}
    version = f"{sys.version_info.major}.{sys.version_info.minor}"
    for pos, f in enumerate(m.functions):
        dump = ast.dump(f.node, include_attributes=False, annotate_fields=True)
        source = f"{version}|{path}|{f.qualname}|{dump}"
        yield {"kind": "function", "qualname": f.qualname, "name": f.node.name, "value": hashlib.sha256(source.encode()).hexdigest()[:16], "target": f"{module}.{f.qualname}" if module else f.qualname, "flag": f.plain, "pos": pos, "n": len(f.node.args.args), **_at(f.node)}
        for k, (name, values) in enumerate(f.decorators):
            yield {"kind": "annotation", "qualname": f.qualname, "name": name, "value": ",".join(f"{a}={v}" for a, v in sorted(values.items())), "pos": k, "n": GROUP[name], **_at(f.node)}
            if name == "feature_gated":
                flag = values.get("flag", values.get("0"))
                yield {"kind": "gate", "qualname": f.qualname, "value": flag if isinstance(flag, str) else None, "flag": isinstance(flag, str) and flag_reference(f, flag), **_at(f.node)}
            if name == "all_fields_mapped":
                on = values.get("source", values.get("0"))
                seen = {n.attr for n in f.own if isinstance(n, ast.Attribute)}
                yield {"kind": "mapped", "qualname": f.qualname, "target": on if isinstance(on, str) else None, "value": ",".join(sorted(seen)), **_at(f.node)}
        if f.plain:
            yield {"kind": "rejects", "qualname": f.qualname, "target": f"{module}.{f.qualname}" if module else f.qualname, "flag": rejects(f)}
            try:
                yield from list(_calls(f, top, classes, every))
            except Exception as e:
                yield {"kind": "tool_error", "qualname": f.qualname, "name": "calls", "value": repr(e)[:200], **_at(f.node)}
            reached = {m.full_name(c, local, module or "") for c in f.all(ast.Call) if id(c) not in f.dead}
            yield from ({"kind": "reaches", "qualname": f.qualname, "name": f"{module}.{f.qualname}" if module else f.qualname, "target": t} for t in sorted(x for x in reached if x))
        for rule, check in CHECKS.items():
            try:
                for n, what in check(f):
                    yield {"kind": "hit", "qualname": f.qualname, "name": rule, "value": what, "pos": pos, "flag": f.decorated("validates_shape", "validates_semantic", "validates_external") if rule == "PY-WL-008" else f.decorated("validates_semantic") and not f.decorated("validates_external"), **_at(n)}
            except Exception as e:  # a faulty check must not hide the findings of the others
                yield {"kind": "tool_error", "qualname": f.qualname, "name": rule, "value": repr(e)[:200], **_at(f.node)}
        try:
            for severity, n, what in breaches(f):
                yield {"kind": "breach", "qualname": f.qualname, "name": severity, "value": what, "pos": pos, **_at(n)}
        except Exception as e:
            yield {"kind": "tool_error", "qualname": f.qualname, "name": "SUP-001", "value": repr(e)[:200], **_at(f.node)}


def _calls(f: Function, top: set[str], classes: set[str], every: set[str]) -> Iterator[dict]:
    """Resolved calls to functions of the file, as a set; and the number of call sites with and without a target.
    Calls inside nested functions count for this one too."""
    owner = f.qualname.split(".")[0] if f.qualname.split(".")[0] in classes else None
    found, sites, lost = set(), 0, 0
    for c in ast.walk(f.node):
        if not isinstance(c, ast.Call):
            continue
        name = c.func.id if isinstance(c.func, ast.Name) else None
        to = None
        if name in top:
            to = name
        elif name in classes and f"{name}.__init__" in every:
            to = f"{name}.__init__"
        elif owner and isinstance(c.func, ast.Attribute) and dotted(c.func) == f"self.{c.func.attr}" and f"{owner}.{c.func.attr}" in every:
            to = f"{owner}.{c.func.attr}"
        sites += to is not None
        lost += to is None
        if to:
            found.add(to)
    yield from ({"kind": "edge", "qualname": f.qualname, "target": t} for t in sorted(found))
    yield {"kind": "call_sites", "qualname": f.qualname, "n": sites, "pos": lost}


def facts(sources: DataFrame, path: str = "path", content: str = "content", packages: tuple[str, ...] | None = None) -> DataFrame:
    """All facts of a table of sources (path, content as binary). Cache or write it: many plans read it.

    packages: whose decorators count, by imports of the module itself; without it a decorator counts by its name.
    """

    def run(batches):
        for b in batches:
            paths, contents = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = [dict.fromkeys(COLUMNS) | {"file_path": p} | r for p, raw in zip(paths, contents) for r in file_facts(p, raw or b"", packages)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, KINDS[t]) for c, t in (x.split() for x in SCHEMA.split(", "))]))

    return sources.select(path, content).mapInArrow(run, SCHEMA)
