"""Sources written for the queries of the parsing stage and the rules, as the driver's tables hold no source code.

A line that a rule must report ends in a comment `#! name`, the qualified name of its function; `#! name x2` where it
must report two places of the line. Everything else must stay silent.
"""

from __future__ import annotations

import re

RULES: dict[str, str] = {}
RULES["PY-WL-001"] = '''
from collections import defaultdict
import collections

def reads(d, key):
    a = d.get("k", 1)  #! reads
    b = d.pop(key, None)  #! reads
    c = d.setdefault("k", [])  #! reads
    e = d.get("k")
    f = d.pop("k")
    g = schema_default(d.get("k", 0))
    return a, b, c, e, f, g

def makes():
    a = defaultdict(list)  #! makes
    b = collections.defaultdict(int)  #! makes
    c = defaultdict()
    def inner(m):
        return m["x"].get("y", "")  #! makes.inner
    return a, b, c, inner

class Store:
    async def load(self, row):
        return row.get("a", 1) + row.get("b", 2)  #! Store.load x2

at_module_level = {}.get("k", 1)
'''
RULES["PY-WL-002"] = '''
def f(o, name):
    a = getattr(o, "a", None)  #! f
    b = getattr(o, name, 1)  #! f
    c = o.title or "untitled"  #! f
    d = o.x.y or ""  #! f
    e = getattr(o, "a")
    g = name or "none"
    h = o.a or o.b or 1
    i = o.a and 1
    return a, b, c, d, e, g, h, i
'''
RULES["PY-WL-003"] = '''
KNOWN = {"a", "b"}

def gates(d, k, o):
    if "key" in d:  #! gates
        pass
    if k not in d.keys():  #! gates
        pass
    if d.get("k") is None:  #! gates
        pass
    if None != d.get("k"):  #! gates
        pass
    if hasattr(o, "x"):  #! gates
        pass
    if k in {"a": 1}:  #! gates
        pass
    if k in d["inner"]:  #! gates
        pass

def silent(d, k, o):
    seen = set()
    seen.add(k)
    func_name = "text"
    return k in [1] or k in KNOWN or k in o.names or k in func_name or k in d.values() or hasattr(o, "lineno") or k in seen or o.cache.get("k") is None or k in set(d)

def shapes(m):
    match m:
        case {"a": a}:  #! shapes
            return a
        case Point(x=0):  #! shapes
            return 0
        case [x]:
            return x
'''
RULES["PY-WL-004"] = '''
import contextlib

def f(x):
    try:
        a()
    except:  #! f
        log(x)
    try:
        a()
    except Exception as e:  #! f
        log(e)
    try:
        a()
    except (ValueError, BaseException):  #! f
        log(x)
    with contextlib.suppress(Exception):  #! f
        a()
    with suppress(ValueError):
        a()

def silent(x):
    try:
        a()
    except Exception:
        raise
    try:
        a()
    except Exception as e:
        raise e
    try:
        a()
    except ValueError:
        log(x)
'''
RULES["PY-WL-005"] = '''
def f(xs):
    for x in xs:
        try:
            a(x)
        except ValueError:  #! f
            pass
        try:
            a(x)
        except KeyError:  #! f
            ...
        try:
            a(x)
        except TypeError:  #! f
            continue
        try:
            a(x)
        except OSError:  #! f
            break
        try:
            a(x)
        except LookupError:
            log(x)
        try:
            a(x)
        except ArithmeticError:
            pass
            log(x)
'''
RULES["PY-WL-006"] = '''
def early(row):
    if row:
        return None  #! early
    audit(row)

def one_way(row):  #! one_way
    if row:
        audit(row)

def masked(row):
    try:
        save(row)
    except Exception:
        audit(row)  #! masked

def refuses(row):
    if row:
        raise ValueError
    log.audit_event(row)
    return row

def at_last(row):
    try:
        save(row)
    finally:
        ledger.write(row)

def returns_it(row):
    return emit(row)

class Store:
    def save(self, row):
        for r in row:
            if r:
                return r  #! Store.save
        self.audit_log.append(row)
        return row
'''
RULES["PY-WL-007"] = '''
import ast

def f(x):
    if isinstance(x, int):  #! f
        pass
    if type(x) == int or type(x) is not str:  #! f x2
        pass
    return isinstance(x, ast.Name) or isinstance(x, (ast.Load, ast.Store)) or type(x)

class Value:
    def __eq__(self, other):
        if not isinstance(other, Value):
            return NotImplemented
        return True

    def __lt__(self, other):
        return isinstance(other, Value)  #! Value.__lt__

    def __post_init__(self):
        object.__setattr__(self, "x", isinstance(self.x, int))
'''
RULES["PY-WL-008"] = '''
def weak(x):  #! weak
    return x

def dead(x):  #! dead
    if False:
        raise ValueError

def hides(x):  #! hides
    def inner(y):
        raise ValueError
    return x

def strong(x):
    raise ValueError

def guards(x):
    if not x:
        return None
    return x

def other_way(x):
    if x:
        x += 1
    else:
        return None
'''
RULES["PY-WL-009"] = '''
def early(d):
    if d["a"] > 1:  #! early
        pass

def unused(d):
    isinstance(d, dict)
    assert d["a"]  #! unused

def checked(d):
    validate_schema(d)
    if d["a"] > 1:
        pass

def tested(d):
    ok = isinstance(d, dict)
    assert d["a"]

def member(d):
    if "a" in d and d["a"]:
        pass
'''

# the advisory lint: its rows are (rule, line)
LINT = '''
def f(d, o, k):
    a = d.get("k", 1)  #! WL001
    b = d.get("k", default=1)  #! WL001
    c = d.setdefault("k", 1)  #! WL001
    e = d.pop("k", 1)
    g = getattr(o, "a", 1)  #! WL002
    h = k in [1, 2]  #! WL003
    i = hasattr(o, "x")  #! WL003
    try:
        a()
    except Exception:  #! WL004
        raise
    try:
        a()
    except ValueError:  #! WL005
        pass
'''

# imports, decorators and calls: which resolve, and to what
NAMES = '''
import importlib
import os.path
import json as j
import trust
import trust.marks as tm
from trust import validates_shape, external_boundary as eb, other
from trust.marks import fail_open
from django.db import transaction
from elsewhere import fail_closed

@eb
def fetch(url):
    return j.loads(os.path.join(url))

@validates_shape
@transaction.atomic
def check(x):
    helper(x)
    return Store(x).load()

@tm.deterministic
@trust.ordered_after("check", strict=True)
def later():
    unknown.call()
    importlib.import_module("json")
    importlib.import_module("trust.plugins")
    __import__("trust")

@fail_closed
@other
def plain():
    def helper():
        return check(1)
    return helper()

def helper(x):
    return fetch(x)

class Store:
    def __init__(self, x):
        self.x = x

    @fail_open(reason="tests")
    def load(self):
        return self.parse(self.x)

    def parse(self, y):
        return y
'''
ANNOTATIONS = [("Store.load", "fail_open", "reason=tests"), ("check", "validates_shape", ""), ("fetch", "external_boundary", ""), ("later", "deterministic", ""), ("later", "ordered_after", "0=check,strict=True")]
DYNAMIC = ["trust", "trust.plugins"]
EDGES = [("Store.load", "Store.parse"), ("check", "Store.__init__"), ("check", "helper"), ("helper", "fetch"), ("plain", "check"), ("plain", "helper"), ("plain.helper", "check")]
CALLS = [
    ("Store.load", "trust.marks.fail_open"), ("check", "sample.m.helper"), ("fetch", "json.loads"), ("helper", "sample.m.fetch"), ("later", "importlib.import_module"),
    ("later", "trust.ordered_after"), ("plain", "sample.m.helper"), ("plain.helper", "sample.m.check"),
]
ALIASES = [("eb", "trust.external_boundary"), ("fail_closed", "elsewhere.fail_closed"), ("fail_open", "trust.marks.fail_open"), ("importlib", "importlib"), ("j", "json"), ("os", "os"), ("other", "trust.other"), ("tm", "trust.marks"), ("transaction", "django.db.transaction"), ("trust", "trust"), ("validates_shape", "trust.validates_shape")]
FUNCTIONS = [("Store.__init__", 41), ("Store.load", 45), ("Store.parse", 48), ("check", 18), ("fetch", 13), ("helper", 37), ("later", 24), ("plain", 32), ("plain.helper", 33)]

# variables: f is GUARDED, raw EXTERNAL_RAW, own lib.safe ASSURED
FLOW = '''
import json
import lib

def raw():
    return 1

def f(a, b):
    c = raw()
    d = a
    e = json.loads(a)
    if b:
        g = raw()
    else:
        g = a
    h = lib.safe(a)
    i = lib.other(a)
    for k in c:
        last = k
    j = "text"
    return d
'''

FLOW_TAINTS = [("raw", "EXTERNAL_RAW"), ("f", "GUARDED")]
VARIABLES = [
    ("a", "GUARDED"), ("b", "GUARDED"), ("c", "EXTERNAL_RAW"), ("d", "GUARDED"), ("e", "UNKNOWN_RAW"), ("g", "MIXED_RAW"), ("h", "ASSURED"), ("i", "UNKNOWN_RAW"), ("k", "EXTERNAL_RAW"),
    ("last", "EXTERNAL_RAW"), ("j", "INTEGRAL"),
]

EXPECTED = re.compile(r"#!\s*(\S+)(?:\s+x(\d+))?\s*$")


def expected(source: str) -> list[tuple[str, int]]:
    """The marked (name, line) of a source, as often as they are marked."""
    found = [(m, k) for k, line in enumerate(source.split("\n"), 1) if (m := EXPECTED.search(line))]
    return [(m[1], k) for m, k in found for _ in range(int(m[2] or 1))]

# a project for the whole scan: paths, tiers of modules, boundaries and optional fields of its policy
PROJECT = {
    "app/core.py": '''
from trust import external_boundary, validates_shape, integral_writer, fail_open, fail_closed

@external_boundary
def fetch(url):
    try:
        return client.get(url, None)
    except Exception:
        pass

@validates_shape
def check(data):
    if "key" in data:
        return data

def handle(url):
    raw = fetch(url)
    name = getattr(raw, "name", "none")
    if isinstance(raw, dict):
        return name
    return raw.title or "untitled"

@fail_open
@fail_closed
def confused(x):
    return x
''',
    "app/broken.py": "def f(:\n",
    "safe/broken.py": "def f(:\n",
    "app/audit.py": '''
class Store:
    def save(self, row):
        if row:
            return None
        self.audit_log(row)
        return row
''',
    "app/fields.py": '''
from trust import all_fields_mapped

def settle(d):
    a = schema_default(d.get("limit", 10))
    b = schema_default(d.get("limit", 11))
    c = schema_default(d.get("other", 1))
    return a, b, c

class Row:
    name: str
    size: int

@all_fields_mapped(source="Row")
def show(row):
    return row.name
''',
    "app/contracts.py": '''
from trust import atomic, deterministic, feature_gated, test_only
from django.db import transaction

@atomic
def twice(db):
    db.save(1)
    db.save(2)

@transaction.atomic
def others(db):
    db.save(1)
    db.save(2)

@deterministic
def draw():
    return random.random()

@feature_gated(flag="new-thing")
def gated():
    return 1

@test_only
def fixture():
    return 1
''',
    "app/user.py": "from app.contracts import fixture\n",
    "app/plugins.py": '''
import importlib
importlib.import_module("json")
importlib.import_module("trust.plugins")
''',
    "app/bound.py": '''
from app.rules import must

def delegates(x):
    must(x)
    return x

def weak(x):
    return x

def meaning(d):
    if d["a"]:
        raise ValueError
''',
    "app/rules.py": '''
def must(x):
    raise ValueError
''',
}
PROJECT_TIERS = [(0, "app", "ASSURED"), (1, "safe", "INTEGRAL")]
PROJECT_BOUNDARIES = [("settle", "shape_validation", "app"), ("delegates", "shape_validation", "app"), ("weak", "shape_validation", "app"), ("meaning", "semantic_validation", "app")]
PROJECT_FIELDS = [("limit", "10", "app")]

# what the scan of the project must report, row by row
PROJECT_COLUMNS = ("rule_id", "file_path", "qualname", "line", "col", "end_line", "end_col", "message", "taint_state", "severity", "exceptionability")
PROJECT_FINDINGS = [
    ("DYNAMIC-IMPORT", "app/plugins.py", None, 4, 0, 4, 40, "trust.plugins", None, "WARNING", "UNCONDITIONAL"),
    ("GOVERNANCE-FILE-SKIPPED", "app/broken.py", None, 1, 7, None, None, "SyntaxError", None, "WARNING", "UNCONDITIONAL"),
    ("GOVERNANCE-FILE-SKIPPED", "safe/broken.py", None, 1, 7, None, None, "SyntaxError", None, "ERROR", "UNCONDITIONAL"),
    ("GOVERNANCE-MODULE-TIERS-BLANKET", "app/contracts.py", None, 1, 0, None, None, "most functions rest on the module's tier", None, "WARNING", "STANDARD"),
    ("GOVERNANCE-MODULE-TIERS-UNDECORATED", "app/audit.py", None, 1, 0, None, None, "trusted module without decorators", None, "WARNING", "STANDARD"),
    ("GOVERNANCE-MODULE-TIERS-UNDECORATED", "app/bound.py", None, 1, 0, None, None, "trusted module without decorators", None, "WARNING", "STANDARD"),
    ("GOVERNANCE-MODULE-TIERS-UNDECORATED", "app/rules.py", None, 1, 0, None, None, "trusted module without decorators", None, "WARNING", "STANDARD"),
    ("L3-LOW-RESOLUTION", "app/audit.py", "Store.save", 3, 4, 7, 18, "1/1", None, "WARNING", "STANDARD"),
    ("L3-LOW-RESOLUTION", "app/bound.py", "delegates", 4, 0, 6, 12, "1/1", None, "WARNING", "STANDARD"),
    ("L3-LOW-RESOLUTION", "app/contracts.py", "draw", 16, 0, 17, 26, "1/1", None, "WARNING", "STANDARD"),
    ("L3-LOW-RESOLUTION", "app/contracts.py", "gated", 20, 0, 21, 12, "1/1", None, "WARNING", "STANDARD"),
    ("L3-LOW-RESOLUTION", "app/contracts.py", "others", 11, 0, 13, 14, "2/2", None, "WARNING", "STANDARD"),
    ("L3-LOW-RESOLUTION", "app/contracts.py", "twice", 6, 0, 8, 14, "2/2", None, "WARNING", "STANDARD"),
    ("L3-LOW-RESOLUTION", "app/core.py", "fetch", 5, 0, 9, 12, "1/1", None, "WARNING", "STANDARD"),
    ("L3-LOW-RESOLUTION", "app/fields.py", "settle", 4, 0, 8, 18, "6/6", None, "WARNING", "STANDARD"),
    ("L3-LOW-RESOLUTION", "app/fields.py", "show", 15, 0, 16, 19, "1/1", None, "WARNING", "STANDARD"),
    ("PY-WL-001", "app/core.py", "fetch", 7, 15, 7, 36, "default value made up by get", "EXTERNAL_RAW", "SUPPRESS", "TRANSPARENT"),
    ("PY-WL-001-GOVERNED-DEFAULT", "app/fields.py", "settle", 5, 8, 5, 42, "'limit'=10", "ASSURED", "SUPPRESS", "TRANSPARENT"),
    ("PY-WL-001-UNGOVERNED-DEFAULT", "app/fields.py", "settle", 6, 8, 6, 42, "'limit'=11", "ASSURED", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-001-UNGOVERNED-DEFAULT", "app/fields.py", "settle", 7, 8, 7, 41, "'other'=1", "ASSURED", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-002", "app/core.py", "handle", 18, 11, 18, 39, "getattr with a default", "EXTERNAL_RAW", "WARNING", "RELAXED"),
    ("PY-WL-002", "app/core.py", "handle", 21, 11, 21, 34, "attribute or a default", "EXTERNAL_RAW", "WARNING", "RELAXED"),
    ("PY-WL-003", "app/core.py", "check", 13, 7, 13, 20, "membership test for a key", "EXTERNAL_RAW", "SUPPRESS", "TRANSPARENT"),
    ("PY-WL-004", "app/core.py", "fetch", 8, 4, 9, 12, "handler for every exception", "EXTERNAL_RAW", "WARNING", "RELAXED"),
    ("PY-WL-005", "app/core.py", "fetch", 8, 4, 9, 12, "handler that does nothing", "EXTERNAL_RAW", "WARNING", "RELAXED"),
    ("PY-WL-006", "app/audit.py", "Store.save", 5, 12, 5, 23, "a way out that bypasses the audit", "ASSURED", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-007", "app/core.py", "handle", 19, 7, 19, 28, "isinstance", "EXTERNAL_RAW", "SUPPRESS", "TRANSPARENT"),
    ("PY-WL-008", "app/bound.py", "weak", 8, 0, 9, 12, "no way to refuse", "ASSURED", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-008", "app/core.py", "check", 12, 0, 14, 19, "no way to refuse", "EXTERNAL_RAW", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-008", "app/fields.py", "settle", 4, 0, 8, 18, "no way to refuse", "ASSURED", "ERROR", "UNCONDITIONAL"),
    ("PY-WL-009", "app/bound.py", "meaning", 12, 4, 13, 24, "semantic test of unchecked data", "ASSURED", "ERROR", "UNCONDITIONAL"),
    ("SCN-021", "app/core.py", "confused", 25, 0, 26, 12, "fail_open+fail_closed", None, "ERROR", "UNCONDITIONAL"),
    ("SCN-022", "app/fields.py", "show", 15, 0, 16, 19, "size", None, "ERROR", "STANDARD"),
    ("SUP-001", "app/contracts.py", "draw", 17, 11, 17, 26, "random.random is not deterministic", None, "ERROR", "STANDARD"),
    ("SUP-001", "app/contracts.py", "gated", 20, 0, 21, 12, "stale feature flag new-thing", None, "WARNING", "STANDARD"),
    ("SUP-001", "app/contracts.py", "twice", 8, 4, 8, 14, "several changes outside a transaction", None, "ERROR", "STANDARD"),
    ("SUP-001", "app/user.py", None, 1, 0, 1, 33, "imports test-only fixture", None, "ERROR", "STANDARD"),
]

# for each rule a fragment that it must report wherever its cell is not silent, and one that it must not
FRAGMENTS = {
    "PY-WL-001": ("def f(d):\n    return d.get('k', 1)\n", "def f(d):\n    return d.get('k')\n"),
    "PY-WL-002": ("def f(o):\n    return o.name or 'none'\n", "def f(o):\n    return o.name\n"),
    "PY-WL-003": ("def f(d):\n    return 'k' in d\n", "def f(d):\n    return d['k']\n"),
    "PY-WL-004": ("def f():\n    try:\n        a()\n    except Exception:\n        log()\n", "def f():\n    try:\n        a()\n    except ValueError:\n        log()\n"),
    "PY-WL-005": ("def f():\n    try:\n        a()\n    except ValueError:\n        pass\n", "def f():\n    try:\n        a()\n    except ValueError:\n        log()\n"),
    "PY-WL-006": ("def f(r):\n    if r:\n        return 1\n    audit(r)\n", "def f(r):\n    audit(r)\n    return 1\n"),
    "PY-WL-007": ("def f(x):\n    return isinstance(x, int)\n", "def f(x):\n    return x.kind\n"),
    "PY-WL-008": ("def f(x):\n    return x\n", "def f(x):\n    raise ValueError\n"),
    "PY-WL-009": ("def f(d):\n    if d['a']:\n        raise ValueError\n", "def f(d):\n    check_schema(d)\n    if d['a']:\n        raise ValueError\n"),
}
DECLARED = {"PY-WL-008": "shape_validation", "PY-WL-009": "semantic_validation"}


def specimens(matrix: tuple[tuple[str, str, str, str], ...]) -> list[tuple]:
    """(specimen_id, rule_id, fragment, taint_state, verdict, boundaries): two for each cell; in a silent cell neither may fire."""
    out = []
    for rule, taint, severity, _ in matrix:
        fires, silent = FRAGMENTS[rule]
        bounds = [("f", DECLARED[rule])] if rule in DECLARED else []
        out.append((f"{rule}-{taint}-1", rule, fires, taint, "true_negative" if severity == "SUPPRESS" else "true_positive", bounds))
        out.append((f"{rule}-{taint}-2", rule, silent, taint, "true_negative", bounds))
    return out
