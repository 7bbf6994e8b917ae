"""Call graphs that lie within files: the rows of a file meet in one task and its graph is solved whole.

One shuffle by file takes the place of rounds of joins, however long the chains of calls are. A file's graph is as
large as its source, so it fits a task; graphs whose calls cross files are for operators/graph.py.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Node = tuple[int, int, bool]  # rank, rank of what it returns, whether its rank is fixed


def strong_components(calls: dict[str, list[str]]) -> list[list[str]]:
    """The strongly connected components, those of callees before those of their callers.

    By the path-based algorithm: `open_` holds nodes whose component is not known, `heads` those that may still be
    the first of theirs.
    """
    number: dict[str, int] = {}
    known: set[str] = set()
    out: list[list[str]] = []
    for root in sorted(calls):
        if root in number:
            continue
        open_, heads, work = [], [], []

        def enter(v: str) -> None:
            number[v] = len(number)
            open_.append(v)
            heads.append(v)
            work.append((v, iter(calls[v])))

        enter(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in number:
                    enter(w)
                    break
                if w not in known:
                    while number[heads[-1]] > number[w]:
                        heads.pop()
            else:
                work.pop()
                if heads[-1] == v:
                    heads.pop()
                    part = [open_.pop()]
                    while part[-1] != v:
                        part.append(open_.pop())
                    out.append(part)
                    known.update(part)
    return out


def settle(nodes: dict[str, Node], calls: dict[str, list[str]]) -> tuple[dict[str, int], dict[str, str], list[list[str]]]:
    """(refined rank of each node, the callee that last raised it, components).

    Components are settled callees first: each floating member takes the highest rank that comes from outside, then
    members pass ranks on among themselves, the alphabetically first waiting one at a time. Of callees with the
    highest rank the alphabetically first is named.
    """
    now = {n: rank for n, (rank, _, _) in nodes.items()}
    via: dict[str, str] = {}
    gives = lambda c: nodes[c][1] if nodes[c][2] else now[c]
    parts = strong_components(calls)

    def raise_(n: str, callees: list[str]) -> bool:
        top = max(map(gives, callees), default=-1)
        if top <= now[n]:
            return False
        now[n] = top
        via[n] = min(c for c in callees if gives(c) == top)
        return True

    for part in parts:
        inside = set(part)
        floating = [n for n in part if not nodes[n][2]]
        for n in floating:
            raise_(n, [c for c in calls[n] if c not in inside])
        if len(part) == 1:
            continue
        callers = defaultdict(list)
        for n in floating:
            for c in calls[n]:
                if c in inside:
                    callers[c].append(n)
        waiting = sorted(floating)
        queued = set(waiting)
        while waiting:
            n = heapq.heappop(waiting)
            queued.discard(n)
            if raise_(n, calls[n]):
                for c in callers[n]:
                    if c not in queued:
                        queued.add(c)
                        heapq.heappush(waiting, c)
    return now, via, parts


def _solved(group, nodes: dict[str, Node], pairs: set[tuple[str, str]]):
    calls: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b in pairs:
        if a in nodes and b in nodes:
            calls[a].append(b)
    now, via, parts = settle(nodes, calls)
    for part in parts:
        least = min(part)
        for n in part:
            yield group, n, now[n], via.get(n), least, len(part) > 1 or n in calls[n]


COLUMNS = {"group": pa.string(), "name": pa.string(), "refined": pa.int32(), "via": pa.string(), "component": pa.string(), "cyclic": pa.bool_()}


def _run(batches):
    group, nodes, pairs, out = None, {}, set(), []

    def flushed(least: int):
        while len(out) >= max(1, least):
            rows = out[:10_000]
            del out[:10_000]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), COLUMNS.values())], list(COLUMNS))

    for batch in batches:
        for g, edge, a, b, rank, back, fixed in zip(*[c.to_pylist() for c in batch.columns]):
            if g != group:
                out.extend(_solved(group, nodes, pairs))
                group, nodes, pairs = g, {}, set()
                yield from flushed(10_000)
            if edge:
                pairs.add((a, b))
            else:
                nodes[a] = (rank, back, fixed)
    out.extend(_solved(group, nodes, pairs))
    yield from flushed(1)


def solve(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (group, name, rank, return_rank, anchored) and edges (group, src, dst) as (group, name, refined, via,
    component, cyclic): for every node its rank after propagation, the callee that raised it, the smallest name of
    its strongly connected component, and whether it reaches itself.

    An anchored node keeps its rank and gives its callers its return rank; every other node takes the highest of its
    own and its callees' ranks. Calls to names that are no nodes of the group count for nothing; repeated calls count
    once; of repeated nodes one counts. Null names and groups are left out.
    """
    none = F.lit(None)
    n = nodes.select("group", F.lit(False).alias("edge"), F.col("name").alias("a"), none.cast("string").alias("b"), F.col("rank").cast("int").alias("rank"), F.col("return_rank").cast("int").alias("back"), F.col("anchored").alias("fixed"))
    e = edges.select("group", F.lit(True).alias("edge"), F.col("src").alias("a"), F.col("dst").alias("b"), none.cast("int").alias("rank"), none.cast("int").alias("back"), none.cast("boolean").alias("fixed"))
    rows = n.unionByName(e).filter("group is not null and a is not null").withColumn("group", F.col("group").cast("string"))
    near = rows.repartition("group").sortWithinPartitions("group", "edge")
    return near.mapInArrow(_run, "group string, name string, refined int, via string, component string, cyclic boolean")


def nodes_of(edges: DataFrame) -> DataFrame:
    """The nodes that edges name, all of one rank."""
    ends = edges.select("group", F.explode(F.array("src", "dst")).alias("name")).distinct()
    return ends.select("group", "name", F.lit(0).alias("rank"), F.lit(0).alias("return_rank"), F.lit(False).alias("anchored"))
