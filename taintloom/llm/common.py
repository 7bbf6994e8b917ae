"""What the operators share: session settings, code on executors, tables in the shared folder, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task of a round of components() takes.
ROUND_ROWS = 10_000
#: A node with more edges than this share of all is a hub: there are at most 2 / HUB_SHARE of them.
HUB_SHARE = 1 / 500
HUB_LEAST = 200
#: Nodes that a task's forest holds before it is written out and begun anew.
FOREST = 400_000
#: Bounds of an Arrow batch, by Spark's default; a batch ends with the row that reaches either.
BATCH = {"maxRecordsPerBatch": ("10000", "512"), "maxBytesPerBatch": ("67108864b", "33554432b")}

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, and send this package to executors that lack it.

    Plans read these settings when they run, so they stay set in the session; what the caller has set stays.
    """
    for name, (default, bound) in BATCH.items():
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key) == default:
            spark.conf.set(key, bound)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    target = os.path.join(tempfile.mkdtemp(), "taintloom_llm.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "taintloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


_caches: dict[str, Callable[[], None]] = {}


def take_cache(name: str, drop: Callable[[], None] = lambda: None) -> None:
    """In a worker: from now on only this operator remembers words; what others remembered is dropped."""
    if others := [o for o in _caches if o != name]:
        for other in others:
            _caches.pop(other)()
        release()
    _caches[name] = drop


def release() -> None:
    """Give memory that is free in this process back to the system: workers live on with what they once took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. In local mode (tests) a temporary one is set where none is named."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _drop_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is over: its folder goes with the cluster
            return


atexit.register(_drop_written)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    # the shuffle files behind it go once nothing refers to them: let the driver see that nothing does
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    for f in {os.path.dirname(f) for f in df.inputFiles()}:
        if any(f.endswith(os.path.basename(p)) for _, p in _written):
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def utf8(column: str | Column) -> Column:
    """The text as bytes; null is empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit("")).cast("binary")


def byte_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of a binary Arrow column and its n + 1 offsets, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    joined = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return joined[off[0] : off[-1]], off - off[0]


class Forest:
    """Union-find over the values of one task, the smallest value being the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def link(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forest_rows(forest: Forest) -> pa.RecordBatch:
    nodes = list(forest.up)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], ["a", "b"])


def _spanning(batches):
    """Spanning forests of a task's edges, each node tied to the smallest of its tree."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.link(a, b)
        if len(forest.up) > FOREST:
            yield _forest_rows(forest)
            forest = Forest()
    yield _forest_rows(forest)


def _with_least(rows: DataFrame, least: DataFrame, hubs: DataFrame) -> DataFrame:
    """rows (a, b) with m of their node a. Rows of hubs meet a broadcast table, so that none waits for one task."""
    # at most 2 / HUB_SHARE rows
    few = F.broadcast(hubs.select("a", "m"))
    others = rows.join(few.select("a"), "a", "left_anti").join(least.select("a", "m"), "a")
    return rows.join(few, "a").unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge; edges has longs a and b.

    Each task first reduces its edges to a forest; then large-star and small-star rounds run until
    nothing changes. A node of high degree is a hot key only in its rows, never in a list, and its rows stay
    where they are.
    """
    known = written(edges.select("a", "b").mapInArrow(_spanning, "a long, b long").filter("a != b"))
    n, before = known.count(), None
    while True:
        # a round never has many more edges than the one before: few edges need few tasks and files
        parts = n // ROUND_ROWS + 1
        hub = max(HUB_LEAST, int(n * HUB_SHARE))
        both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, here and below: several plans read it, and each stays small
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        least = written(least.coalesce(parts))
        # large star: larger neighbours move to the least neighbour
        large = _with_least(both.filter("b > a"), least, least.filter(F.col("n") > hub)).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours move to the least of them
        down = written(large.filter("b < a").coalesce(parts))
        small_least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(down, small_least, small_least.filter(F.col("n") > hub))
        nxt = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b")))
        nxt = written(nxt.filter("a != b").distinct().coalesce(parts))
        forget(least)
        forget(down)
        sums = nxt.agg(F.count("*"), F.sum(F.col("a").cast("decimal(20,0)")), F.sum(F.col("b").cast("decimal(20,0)")), F.expr("bit_xor(xxhash64(a, b))")).first()
        forget(known)
        known, n = nxt, sums[0]
        if sums == before:
            break
        before = sums
    return known.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
