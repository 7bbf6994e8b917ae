import random
from collections import defaultdict

import pytest

from taintloom.operators import local_graph as L
from taintloom.operators.local_graph import settle, strong_components


def plain(nodes, calls):
    """The fixpoint and cycles by brute force; and for components the rule itself, step by step."""
    reach = {n: set(calls[n]) for n in nodes}
    for _ in nodes:
        for n in nodes:
            reach[n] |= set().union(*[reach[c] for c in reach[n]])
    part = {n: frozenset([n] + [m for m in nodes if m in reach[n] and n in reach[m]]) for n in nodes}
    now, via, done = {n: nodes[n][0] for n in nodes}, {}, set()
    gives = lambda c: nodes[c][1] if nodes[c][2] else now[c]

    def look(n, callees):
        best = sorted(callees, key=lambda c: (-gives(c), c))[:1]
        if best and gives(best[0]) > now[n]:
            now[n] = gives(best[0])
            via[n] = sorted(callees, key=lambda c: (-gives(c), c))[0]
            return True
        return False

    while len(done) < len(nodes):
        ready = next(part[n] for n in sorted(nodes) if n not in done and all(c in done or c in part[n] for m in part[n] for c in calls[m]))
        for n in sorted(ready):
            if not nodes[n][2]:
                look(n, [c for c in calls[n] if c not in ready])
        todo = {n for n in ready if not nodes[n][2]} if len(ready) > 1 else set()
        while todo:
            n = min(todo)
            todo.discard(n)
            if look(n, calls[n]):
                todo |= {m for m in ready if n in calls[m] and not nodes[m][2]}
        done |= ready
    return now, via, part, reach


def graph(seed):
    r = random.Random(seed)
    n = r.randint(1, 14)
    nodes = {f"n{i}": (r.randrange(8), r.randrange(8), r.random() < 0.25) for i in range(n)}
    calls = {a: [b for b in nodes if r.random() < r.choice((0.05, 0.2, 0.4))] for a in nodes}
    return nodes, calls


@pytest.mark.parametrize("seed", range(60))
def test_against_the_rule(seed):
    nodes, calls = graph(seed)
    now, via, part, reach = plain(nodes, calls)
    got_now, got_via, parts = settle(nodes, calls)
    assert got_now == now and got_via == via
    assert {frozenset(p) for p in parts} == set(part.values())
    seen = set()
    for p in strong_components(calls):
        assert all(c in seen or c in p for n in p for c in calls[n])
        seen.update(p)


def test_many_groups(spark):
    rows, edges, want = [], [], {}
    for seed in range(40):
        nodes, calls = graph(seed)
        now, via, part, reach = plain(nodes, calls)
        rows += [(f"g{seed}", n, *v) for n, v in nodes.items()]
        edges += [(f"g{seed}", a, b) for a, bs in calls.items() for b in bs for _ in range(2)] + [(f"g{seed}", "n0", "elsewhere")]
        want |= {(f"g{seed}", n): (now[n], via.get(n), min(part[n]), n in reach[n]) for n in nodes}
    nodes = spark.createDataFrame([*rows, (None, "x", 1, 1, False), ("g0", None, 1, 1, False)], "group string, name string, rank int, return_rank int, anchored boolean").repartition(5)
    calls = spark.createDataFrame(edges, "group string, src string, dst string").repartition(5)
    got = {(r.group, r.name): (r.refined, r.via, r.component, r.cyclic) for r in L.solve(nodes, calls).collect()}
    assert got == want
    assert L.solve(nodes.limit(0), calls.limit(0)).collect() == []


def test_long_chains_need_no_rounds(spark):
    n = 20_000
    nodes = {f"f{i:05}": (0, 0, False) for i in range(n)}
    nodes[f"f{n - 1:05}"] = (7, 7, True)
    calls = defaultdict(list, {f"f{i:05}": [f"f{i + 1:05}"] for i in range(n - 1)})
    calls = {k: calls[k] for k in nodes}
    now, via, parts = settle(nodes, calls)
    assert set(now.values()) == {7} and len(parts) == n and via["f00000"] == "f00001"
