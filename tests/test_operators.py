import itertools
import random

import duckdb
import pytest

import __spark_entry__ as entry
from taintloom.functions.domains import MATRIX, RANK, TAINTS
from taintloom.functions.lattice import taint_join
from taintloom.operators import exceptions, findings, graph, paths
from taintloom.plans import queries
from taintloom.plans.standins import TABLES, relation
from taintloom.plans.standins import NAMES as NAMES_OF_DECORATORS

D = "/root/testdata/sf0.001"
NAMES = [t for t, _, _ in TAINTS]


@pytest.fixture(scope="module")
def tables():
    for t in TABLES:
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS FROM '{D}/{t}.parquet'")


def rows(columns, values):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for _, v in sorted(zip(columns, r))]) for r in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, D)
    want = duckdb.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())


def test_annotations_come_from_every_line(spark, tables):
    got = {(r.file_path, r.qualname, r.name) for r in relation(spark, D, "annotations").collect()}
    lines = duckdb.sql("SELECT DISTINCT l_suppkey % 50, l_orderkey % 3000, l_partkey % 12 FROM lineitem").fetchall()
    assert got == {(f"src/f{s}.py", f"fn{o}", NAMES_OF_DECORATORS[p]) for s, o, p in lines}


def pairwise(a, b):
    if a == b:
        return a
    if a.startswith("UNKNOWN_") and b.startswith("UNKNOWN_"):
        return max(a, b, key=RANK.get)
    return "MIXED_RAW"


def test_join_is_a_lattice():
    for a, b, c in itertools.product(NAMES, repeat=3):
        assert pairwise(a, b) == pairwise(b, a) and pairwise(pairwise(a, b), c) == pairwise(a, pairwise(b, c))
        assert pairwise(a, "MIXED_RAW") == "MIXED_RAW" and pairwise(a, a) == a


def test_aggregate_equals_the_fold(spark):
    groups = [g for n in (1, 2, 3) for g in itertools.product(NAMES, repeat=n)]
    df = spark.createDataFrame([(i, t) for i, g in enumerate(groups) for t in g], "g int, t string").groupBy("g").agg(taint_join("t").alias("j"))
    for r in df.collect():
        want = groups[r.g][0]
        for t in groups[r.g][1:]:
            want = pairwise(want, t)
        assert r.j == want


def test_matrix_is_complete(spark):
    assert len(MATRIX) == 72 and len({(r, t) for r, t, _, _ in MATRIX}) == 72
    with pytest.raises(Exception, match="no cell"):
        findings.with_severity(spark.createDataFrame([("PY-WL-999", "GUARDED")], "rule_id string, taint_state string")).collect()


@pytest.mark.parametrize("seed", range(4))
def test_rank_fixpoint_on_random_graphs(spark, seed):
    r = random.Random(seed)
    n = r.randint(2, 20)
    nodes = {str(i): (r.randrange(8), r.randrange(8), r.random() < 0.3) for i in range(n)}
    edges = [(str(i), str(j)) for i in range(n) for j in range(n) if r.random() < 0.2]
    state = {k: v[0] for k, v in nodes.items()}
    while True:
        new = {k: v[0] if v[2] else max([state[k], *(nodes[d][1] if nodes[d][2] else state[d] for s, d in edges if s == k)]) for k, v in nodes.items()}
        if new == state:
            break
        state = new
    df = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "name string, rank int, return_rank int, anchored boolean")
    calls = spark.createDataFrame(edges, "src string, dst string")
    got = {x.name: x.refined for x in graph.propagate_ranks(df, calls).collect()}
    assert got == state
    # refining again changes nothing
    again = graph.propagate_ranks(df.drop("rank").join(spark.createDataFrame(list(got.items()), "name string, rank int"), "name"), calls)
    assert {x.name: x.refined for x in again.collect()} == state
    reach = {k: set() for k in nodes}
    for _ in range(n):
        for s, d in edges:
            reach[s] |= {d} | reach[d]
    assert {x.name for x in graph.on_cycle(calls).collect()} == {k for k in nodes if k in reach[k]}


def test_prefixes(spark):
    policy = spark.createDataFrame([(0, "a", "x"), (1, "a/b/", "y"), (2, "a/b", "z"), (3, "", "no")], "ordinal int, path string, v string")
    left = spark.createDataFrame([("a/b/c",), ("a/bc",), ("b",), ("a",)], "file string")
    got = {r.file: r.v for r in paths.longest_prefix(left, "file", policy, "path", "v", "ordinal").collect()}
    # the longer spelling of one directory wins, as length counts characters
    assert got == {"a/b/c": "y", "a/bc": "x", "b": None, "a": "x"}


def test_match_falls_through(spark):
    f = spark.createDataFrame(
        [(1, "R", "GUARDED", "p.py", "f", "aa", 1, "WARNING", "STANDARD", None), (2, "R", "GUARDED", "p.py", "g", "aa", 1, "ERROR", "UNCONDITIONAL", None), (3, "R", "GUARDED", "p.py", None, "aa", 1, "ERROR", "STANDARD", None), (4, "R", "GUARDED", "p.py", "h", "aa", 1, "ERROR", "STANDARD", None)],
        "ordinal int, rule_id string, taint_state string, file_path string, qualname string, fingerprint string, analysis_level int, severity string, exceptionability string, exception_id string",
    )
    entry = lambda k, place, fp="aa", expires=None, level=1, drifted=False: (k, f"E{k}", "R", "GUARDED", f"p.py::{place}", fp, expires, level, drifted)
    register = spark.createDataFrame(
        [entry(0, "f", drifted=True), entry(1, "f", expires="1990-01-01"), entry(2, "f", expires="soon"), entry(3, "f", "bb"), entry(4, "f", "cc"), entry(5, "f", expires="2000-01-01"), entry(6, "f", "dd"), entry(7, "g"), entry(8, "h", "zz"), entry(9, "h", level=0)],
        "ordinal int, id string, rule_id string, taint_state string, location string, ast_fingerprint string, expires string, analysis_level int, drifted boolean",
    )
    done, stale = exceptions.match(f, register, "2000-01-01")
    assert {r.ordinal: (r.exception_id, r.severity) for r in done.collect()} == {1: ("E5", "SUPPRESS"), 2: (None, "ERROR"), 3: (None, "ERROR"), 4: (None, "ERROR")}
    assert {r.ordinal: r.exception_id for r in stale.collect()} == {1: "E3", 4: "E8"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_exit_codes():
    assert [findings.exit_code(True, 1, 1), findings.exit_code(False, 1, 1), findings.exit_code(False, 0, 1), findings.exit_code(False, 0, 0)] == [2, 3, 1, 0]
