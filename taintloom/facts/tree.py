"""What the checks ask of a syntax tree."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def own_nodes(root: ast.AST) -> Iterator[ast.AST]:
    """The root and all below it but the functions defined inside, level by level."""
    level = [root]
    while level:
        yield from level
        level = [c for n in level for c in ast.iter_child_nodes(n) if not isinstance(c, FUNCTION)]


def last_name(node: ast.AST) -> str | None:
    """The rightmost name of `name`, `a.name` and of a call of either."""
    if isinstance(node, ast.Call):
        node = node.func
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def dotted(node: ast.AST) -> str | None:
    """`a.b.c` of names and attributes, else None."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def is_constant_false(test: ast.AST) -> bool:
    return isinstance(test, ast.Constant) and test.value is not Ellipsis and not test.value


@dataclass
class Function:
    """A function, its qualified name, and the functions around it from the outermost on."""

    node: ast.FunctionDef | ast.AsyncFunctionDef
    qualname: str
    around: tuple[Function, ...]
    #: Whether only classes and functions, no if, try or with, lie between it and the module.
    plain: bool
    module: Module

    @cached_property
    def own(self) -> list[ast.AST]:
        return list(own_nodes(self.node))

    def all(self, *kinds: type) -> list:
        return [n for n in self.own if isinstance(n, kinds)]

    @cached_property
    def dead(self) -> set[int]:
        """Nodes under an `if` whose test is constantly false, its else included."""
        return {id(n) for i in self.all(ast.If) if is_constant_false(i.test) for n in own_nodes(i)}

    @cached_property
    def decorators(self) -> list[tuple[str, dict[str, object]]]:
        """Known decorators in order, with literal arguments."""
        return self.module.annotations_of(self.node)

    def decorated(self, *names: str) -> bool:
        return any(last_name(d) in names for d in self.node.decorator_list)


def of_packages(name: str, packages: tuple[str, ...]) -> bool:
    """Whether a module's full name is one of the packages or lies in one."""
    return any(name == p or name.startswith(p + ".") for p in packages)


@dataclass
class Module:
    tree: ast.Module
    path: str
    known: frozenset[str]
    #: Packages whose decorators count, by the module's own imports; None: those of any package, imported or not.
    packages: tuple[str, ...] | None = None
    functions: list[Function] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._collect(self.tree, "", (), True)

    def _collect(self, node: ast.AST, prefix: str, around: tuple[Function, ...], plain: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, FUNCTION):
                f = Function(child, prefix + child.name, around, plain, self)
                self.functions.append(f)
                self._collect(child, f.qualname + ".", (*around, f), plain)
            elif isinstance(child, ast.ClassDef):
                self._collect(child, prefix + child.name + ".", around, plain)
            else:
                self._collect(child, prefix, around, False)

    @cached_property
    def aliases(self) -> dict[str, str]:
        """Local name: full name, from the module's own imports; the last binding counts."""
        out = {}
        for n in self.tree.body:
            if isinstance(n, ast.Import):
                out |= {a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in n.names}
            elif isinstance(n, ast.ImportFrom) and n.module:
                out |= {a.asname or a.name: f"{n.module}.{a.name}" for a in n.names if a.name != "*"}
        return out

    def full_name(self, call: ast.Call, local: frozenset[str], module: str) -> str | None:
        """A call's target: a function of this module, else what an import names, else unknown."""
        f = call.func
        if isinstance(f, ast.Name):
            own = f"{module}.{f.id}" if module else f.id
            return own if own in local else self.aliases.get(f.id)
        if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in self.aliases:
            return f"{self.aliases[f.value.id]}.{f.attr}"
        return None

    def annotations_of(self, node: ast.AST) -> list[tuple[str, dict[str, object]]]:
        out = []
        for d in getattr(node, "decorator_list", []):
            name = dotted(d.func if isinstance(d, ast.Call) else d)
            if name is None:
                continue
            head, _, rest = name.partition(".")
            full = self.aliases.get(head, head) + ("." + rest if rest else "")
            if self.packages is not None and not (head in self.aliases and of_packages(full.rpartition(".")[0], self.packages)):
                continue
            if (last := full.rsplit(".", 1)[-1]) in self.known:
                values = {}
                if isinstance(d, ast.Call):
                    for key, v in [*((str(i), a) for i, a in enumerate(d.args)), *((k.arg, k.value) for k in d.keywords if k.arg)]:
                        try:
                            values[key] = ast.literal_eval(v)
                        except ValueError:
                            values[key] = dotted(v)
                out.append((last, {k: v for k, v in values.items() if v is not None}))
        return out
