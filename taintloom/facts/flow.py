"""Taints of local variables: one forward pass over a function's statements.

Branches are joined in the lattice, a loop's body runs once and may be skipped, and a handler starts from the
state before its try. What is not modelled leaves the state as it is.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintloom.facts.extract import decode
from taintloom.facts.tree import Function, Module, dotted
from taintloom.functions.domains import GROUP, RANK

# Calls that serialise, whose results are of unknown origin
SERIALISERS = frozenset({
    "json.dump", "json.dumps", "json.load", "json.loads",
    "pickle.dump", "pickle.dumps", "pickle.load", "pickle.loads",
    "marshal.dump", "marshal.dumps", "marshal.load", "marshal.loads",
    "yaml.dump", "yaml.dump_all", "yaml.load", "yaml.load_all", "yaml.safe_dump", "yaml.safe_load", "yaml.safe_load_all",
    "tomllib.load", "tomllib.loads",
    "tomli_w.dump", "tomli_w.dumps",
})


def join(taints: list[str]) -> str:
    """The lattice join."""
    kinds = set(taints)
    if len(kinds) == 1:
        return taints[0]
    return max(kinds, key=RANK.__getitem__) if all(t.startswith("UNKNOWN_") for t in kinds) else "MIXED_RAW"


def merge(states: list[dict[str, str]]) -> dict[str, str]:
    """Names of all states; where several have one, its taints are joined."""
    return {n: join([s[n] for s in states if n in s]) for n in dict.fromkeys(n for s in states for n in s)}


class Flow:
    def __init__(self, f: Function, own: str, functions: dict[str, str], declared: dict[str, str]) -> None:
        """own: the function's taint; functions: those of the file; declared: taints of dependencies by full name."""
        self.f, self.own, self.functions, self.declared = f, own, functions, declared
        self.packages = {name.split(".")[0] for name in declared}

    def run(self) -> dict[str, str]:
        a = self.f.node.args
        names = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]]
        return self.block(self.f.node.body, dict.fromkeys(names, self.own))

    def call(self, node: ast.Call, state: dict[str, str]) -> str:
        for v in [*node.args, *(k.value for k in node.keywords)]:
            self.value(v, state)
        name = dotted(node.func)
        if name is None:
            return self.own
        head, _, rest = name.partition(".")
        full = self.f.module.aliases.get(head, head) + ("." + rest if rest else "")
        if full in SERIALISERS:
            return "UNKNOWN_RAW"
        if name in self.functions:
            return self.functions[name]
        if full in self.declared:
            return self.declared[full]
        return "UNKNOWN_RAW" if head in self.f.module.aliases and full.split(".")[0] in self.packages else self.own

    def value(self, e: ast.AST, state: dict[str, str]) -> str:
        if isinstance(e, ast.NamedExpr):
            state[e.target.id] = self.value(e.value, state)
            return state[e.target.id]
        if isinstance(e, ast.Constant):
            return "INTEGRAL"
        if isinstance(e, ast.Name):
            return state.get(e.id, self.own)
        if isinstance(e, ast.Call):
            return self.call(e, state)
        if isinstance(e, (ast.List, ast.Tuple, ast.Set)):
            return join([self.value(x, state) for x in e.elts] or ["INTEGRAL"])
        if isinstance(e, ast.Dict):
            return join([self.value(x, state) for x in [*e.keys, *e.values] if x is not None] or ["INTEGRAL"])
        if isinstance(e, ast.BinOp):
            return join([self.value(e.left, state), self.value(e.right, state)])
        if isinstance(e, ast.IfExp):
            self.value(e.test, state)
            return join([self.value(e.body, state), self.value(e.orelse, state)])
        if isinstance(e, (ast.UnaryOp, ast.Await, ast.Starred)):
            return self.value(e.operand if isinstance(e, ast.UnaryOp) else e.value, state)
        for inner in ast.iter_child_nodes(e):
            if isinstance(inner, ast.expr):
                self.value(inner, state)
        return self.own

    def assign(self, target: ast.AST, taint: str, state: dict[str, str], value: ast.AST | None = None) -> None:
        if isinstance(target, ast.Name):
            state[target.id] = taint
        elif isinstance(target, ast.Starred):
            self.assign(target.value, taint, state)
        elif isinstance(target, (ast.Tuple, ast.List)):
            pairs = value.elts if isinstance(value, (ast.Tuple, ast.List)) and len(value.elts) == len(target.elts) else [None] * len(target.elts)
            for t, v in zip(target.elts, pairs):
                self.assign(t, taint if v is None else self.value(v, state), state, v)

    def block(self, stmts: list[ast.stmt], state: dict[str, str]) -> dict[str, str]:
        for s in stmts:
            state = self.step(s, state)
        return state

    def step(self, s: ast.stmt, state: dict[str, str]) -> dict[str, str]:
        if isinstance(s, ast.Assign):
            taint = self.value(s.value, state)
            for t in s.targets:
                self.assign(t, taint, state, s.value)
        elif isinstance(s, ast.AnnAssign) and s.value is not None:
            self.assign(s.target, self.value(s.value, state), state)
        elif isinstance(s, ast.AugAssign):
            self.assign(s.target, join([self.value(s.target, state), self.value(s.value, state)]), state)
        elif isinstance(s, ast.If):
            self.value(s.test, state)
            return merge([self.block(s.body, dict(state)), self.block(s.orelse, dict(state))])
        elif isinstance(s, (ast.For, ast.While)):
            if isinstance(s, ast.For):
                inner = dict(state)
                self.assign(s.target, self.value(s.iter, state), inner)
            else:
                self.value(s.test, state)
                inner = dict(state)
            return self.block(s.orelse, merge([state, self.block(s.body, inner)]))
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for i in s.items:
                taint = self.value(i.context_expr, state)
                if i.optional_vars is not None:
                    self.assign(i.optional_vars, taint, state)
            return self.block(s.body, state)
        elif isinstance(s, ast.Try):
            done = [self.block(s.orelse, self.block(s.body, dict(state)))]
            for h in s.handlers:
                caught = dict(state) | ({h.name: self.own} if h.name else {})
                done.append(self.block(h.body, caught))
            return self.block(s.finalbody, merge(done))
        elif isinstance(s, (ast.Expr, ast.Return)) and s.value is not None:
            self.value(s.value, state)
        return state


def variable_taints(sources: DataFrame, taints: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(file_path, qualname, variable, taint) of all functions that lie outside of other statements.

    sources (path, content); taints (file_path, qualname, body_taint); dependencies (name, taint), a policy list.
    """
    declared = {r[0]: r[1] for r in dependencies.select("name", "taint").collect()}  # as many as the manifest names
    known = taints.groupBy(F.col("file_path").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("qualname", "body_taint"))).alias("known"))

    def run(batches):
        for b in batches:
            rows = []
            for path, raw, pairs in zip(*[c.to_pylist() for c in b.columns]):
                known = dict(pairs or [])
                try:
                    m = Module(ast.parse(decode(raw or b"")), path, frozenset(GROUP))
                except (SyntaxError, ValueError, LookupError):
                    continue
                for f in m.functions:
                    if f.plain:
                        found = Flow(f, known.get(f.qualname, "UNKNOWN_RAW"), known, declared).run()
                        rows += [{"file_path": path, "qualname": f.qualname, "variable": v, "taint": t} for v, t in found.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.string()) for c in ("file_path", "qualname", "variable", "taint")]))

    return sources.select("path", "content").join(known, "path", "left").select("path", "content", "known").mapInArrow(run, "file_path string, qualname string, variable string, taint string")
