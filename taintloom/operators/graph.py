"""Fixpoints over call graphs whose calls cross files, as loops of joins that stop when nothing changes.

Graphs within files are solved in one pass by operators/local_graph.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a round: checkpointed in the shared folder, for lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir", None) or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def propagate_ranks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (name, rank, return_rank, anchored) with `refined`: the least fixpoint of rank propagation.

    An anchored node keeps its rank and gives its callers its return rank; every other node takes the highest
    of its own and its callees' ranks. Ranks only grow and are few, so only nodes that changed send on.
    """
    nodes = _cut(nodes)
    state = nodes.select("name", "anchored", F.when(F.col("anchored"), F.col("return_rank")).otherwise(F.col("rank")).alias("sends"), F.col("rank").alias("refined"))
    # calls that can change a rank: of a caller that floats
    calls = _cut(edges.select("src", "dst").distinct().join(nodes.filter("not anchored").select(F.col("name").alias("src")), "src", "left_semi"))
    changed = state
    while not changed.isEmpty():
        offers = calls.join(changed.select(F.col("name").alias("dst"), "sends"), "dst").groupBy(F.col("src").alias("name")).agg(F.max("sends").alias("offer"))
        grew = ~F.col("anchored") & (F.col("offer") > F.col("refined"))
        joined = _cut(state.join(offers, "name", "left").withColumn("grew", F.coalesce(grew, F.lit(False))))
        higher = F.when(F.col("grew"), F.col("offer"))
        state = joined.select("name", "anchored", F.coalesce(higher, "sends").alias("sends"), F.coalesce(higher, "refined").alias("refined"))
        changed = joined.filter("grew").select("name", F.col("offer").alias("sends"))
    return nodes.join(state.select("name", "refined"), "name")


def via_callee(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each refined node the alphabetically first of its callees of the highest rank; exact where the
    node is on no cycle. nodes: the result of propagate_ranks."""
    sends = nodes.select(F.col("name").alias("dst"), F.when(F.col("anchored"), F.col("return_rank")).otherwise(F.col("refined")).alias("sends"))
    offers = edges.filter("src != dst").select("src", "dst").distinct().join(sends, "dst")
    best = offers.groupBy("src").agg(F.min_by("dst", F.struct(-F.col("sends"), F.col("dst"))).alias("via"))
    return nodes.join(best.withColumnRenamed("src", "name"), "name", "left").withColumn("via", F.when(~F.col("anchored") & (F.col("refined") > F.col("rank")), F.col("via")))


def low_resolution(counts: DataFrame, limit: float = 0.7) -> DataFrame:
    """Callers of which more than the limit of the call sites are unresolved."""
    total = F.col("resolved") + F.col("unresolved")
    return counts.filter((total > 0) & (F.col("unresolved") / total > limit))


def bounded_expand(seed: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """Names reached from the seed by at most `rounds` steps to callers, with the round that found them.

    A name is found in the first round that reaches it. Rounds are few by their setting; the lineage is cut from the
    third on, before that a plan of joins is cheaper than a table.
    """
    calls = edges.select("src", "dst").distinct()
    found = seed.select("name").distinct().withColumn("round", F.lit(0))
    edge = found
    for k in range(1, rounds + 1):
        if k > 2:
            calls, found, edge = _cut(calls) if k == 3 else calls, _cut(found), _cut(edge)
        callers = calls.join(edge.select(F.col("name").alias("dst")), "dst", "left_semi").select(F.col("src").alias("name")).distinct()
        edge = callers.join(found, "name", "left_anti").withColumn("round", F.lit(k))
        found = found.unionByName(edge)
    return found


def on_cycle(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Names that reach themselves. Names without callees or callers are on no cycle: they are peeled off until
    none is left, and reachability is followed on the rest alone."""
    left = _cut(edges.select("src", "dst").distinct())
    n = left.count()
    while True:
        left = _cut(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        m = left.count()
        if m == n:
            break
        n = m
    reach = left
    step = 0
    while rounds is None or step < rounds:
        step += 1
        more = reach.join(left.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst"))
        new = _cut(more.distinct().join(reach, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            break
        reach = _cut(reach.unionByName(new))
    return reach.filter("src = dst").select(F.col("src").alias("name"))
