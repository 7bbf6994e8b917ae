"""Near-duplicates by SimHash: fingerprints of word shingles, linked within a Hamming distance.

A fingerprint is embedded as the popcounts of its 32 two-bit segments. The Manhattan distance of two
embeddings never exceeds the Hamming distance, so links lie within it. The grid: the segments are dealt to
blocks, radius more than the blocks that a cell fixes; whatever the radius changes, some choice of blocks
keeps all its counts, so the two ends of a link share the cell of that choice. Cells are joined within
themselves, filtered by Manhattan distance and verified by Hamming distance.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from taintloom.llm.common import components, prepare, take_cache, utf8, written

SHINGLE = 4
RADIUS = 4
SEED = 42
SEGMENTS = 32
#: Distinct fingerprints of a cell that one task takes; a larger cell is dealt to pairs of blocks.
CELL = 1 << 16
_ODD = np.uint64(0x5555555555555555)


def fingerprint(text: bytes) -> int:
    """The SimHash of a text's shingles, repeats included: unsigned, 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    names = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist())]
    n, counts = len(names), np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        part = np.array(names[i : i + 4096], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    take_cache("simhash")
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def embed(x: np.ndarray) -> np.ndarray:
    """The popcount of each two-bit segment, in its place."""
    return x - ((x >> np.uint64(1)) & _ODD)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Manhattan distance of embeddings: two counts differ by 2 if their bits differ in the upper place alone."""
    x = a ^ b
    high = (x >> np.uint64(1)) & _ODD
    return np.bitwise_count((x | high) & _ODD) + np.bitwise_count(high & ~x)


def near(one: np.ndarray, one_e: np.ndarray, many: np.ndarray, many_e: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs are links: the lower bound first, then exactly."""
    ok = manhattan(one_e, many_e) <= radius
    if ok.any():
        ok[ok] = np.bitwise_count((one ^ many)[ok] if one.ndim else one ^ many[ok]) <= radius
    return ok


def masks(blocks: int, radius: int) -> list[int]:
    """For each choice of blocks - radius blocks, the bits of their segments."""
    own = [sum(3 << (2 * s) for s in range(b * SEGMENTS // blocks, (b + 1) * SEGMENTS // blocks)) for b in range(blocks)]
    return [sum(c) for c in combinations(own, blocks - radius)]


def best_blocks(n: int, radius: int) -> int:
    """The number of blocks with the least work: rows dealt out, against pairs compared if bits are random."""

    def work(blocks: int) -> float:
        choices = math.comb(blocks, radius)
        return choices * n + choices * n * n / 2 * (3 / 8) ** (SEGMENTS * (blocks - radius) / blocks) / 30

    return min(range(radius + 2, radius + 8), key=work)


def _links(radius: int):
    def run(batches):
        """Links that span each cell's groups, cells being runs of rows with equal cell, mask and part."""
        rest: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            now = tuple(batch.column(i).to_numpy() for i in range(3))
            if rest is not None:
                now = tuple(np.concatenate(x) for x in zip(rest, now))
            change = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
            cut = change[-1] if len(change) else 0
            rest = tuple(x[cut:] for x in now)
            if cut:
                yield from _linked(now[2][:cut].view(np.uint64), np.r_[0, change[change <= cut]], radius)
        if rest is not None and len(rest[0]):
            yield from _linked(rest[2].view(np.uint64), np.array([0, len(rest[0])]), radius)

    return run


def _linked(prints: np.ndarray, bounds: np.ndarray, radius: int):
    embedded = embed(prints)
    sizes = np.diff(bounds)
    left, right = [], []
    # small cells at once: each row with the one k rows on
    place = np.repeat(bounds[1:], sizes)
    small = np.repeat(sizes <= 32, sizes)
    rows = np.arange(len(prints))
    for k in range(1, int(min(32, sizes.max(initial=0)))):
        i = np.flatnonzero(small & (rows + k < place))
        if not len(i):
            break
        i = i[near(prints[i], embedded[i], prints[i + k], embedded[i + k], radius)]
        left.append(prints[i])
        right.append(prints[i + k])
    for c in np.flatnonzero(sizes > 32):
        # a large cell: grow each group from its first row, so that only links that join are made
        todo = np.unique(prints[bounds[c] : bounds[c + 1]])
        todo_e = embed(todo)
        while len(todo):
            queue, todo, todo_e = [todo[0]], todo[1:], todo_e[1:]
            while queue and len(todo):
                x = queue.pop()
                ok = near(x, embed(x), todo, todo_e, radius)
                if ok.any():
                    new = todo[ok]
                    left.append(np.full(len(new), x))
                    right.append(new)
                    queue.extend(new)
                    todo, todo_e = todo[~ok], todo_e[~ok]
    if left and (a := np.concatenate(left)).size:
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(np.concatenate(right).view(np.int64))], ["a", "b"])


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, cell: int = CELL, blocks: int | None = None) -> DataFrame:
    """(node, root) for every fingerprint of the column fp that has a link to another; fp is distinct."""
    n = prints.count()
    chosen = masks(blocks or best_blocks(n, radius), radius)
    odd = F.lit(int(_ODD))
    high, low = F.shiftrightunsigned("fp", 1).bitwiseAND(odd), F.col("fp").bitwiseAND(odd)
    embedded = F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseXOR(low))
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    cells = F.posexplode(F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: F.col("e").bitwiseAND(m))).alias("mask", "cell")
    dealt = prints.select("fp", embedded.alias("e")).select("fp", cells)
    if n > cell:
        # cells of more than `cell` fingerprints, estimated from one fingerprint in 64; either side of a
        # block pair holds about `cell`, and every pair of blocks has a part of its own
        some = dealt.filter(F.pmod(F.xxhash64("fp"), F.lit(64)) == 0).groupBy("mask", "cell").count()
        hot = written(some.filter(F.col("count") * 64 > cell).select("mask", "cell", F.ceil(F.col("count") * 64 / cell).cast("int").alias("parts")))
        dealt = dealt.join(hot, ["mask", "cell"], "left")
        own = F.pmod(F.hash("fp"), F.col("parts"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(own, j) * F.col("parts") + F.greatest(own, j))
        dealt = dealt.select("mask", "cell", "fp", F.explode(F.coalesce(pairs, F.array(F.lit(0)))).alias("part"))
        dealt = dealt.select(F.xxhash64("mask", "part").alias("mask"), "cell", "fp")
    sorted_cells = dealt.select(F.col("mask").cast("long"), "cell", "fp").repartition("mask", "cell").sortWithinPartitions("mask", "cell")
    return components(sorted_cells.mapInArrow(_links(radius), "a long, b long"))


def _least(made: DataFrame, key: Column, radius: int) -> tuple[DataFrame, DataFrame]:
    """Of rows with a fingerprint fp: (fp, root), and the least key of each root; both written."""
    least = made.groupBy("fp").agg(F.min(key).alias("least"))
    roots = link_fingerprints(least.select("fp"), radius)
    known = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written: a join of two plain tables, so that Spark can split a large component
    known = written(known)
    return known, written(known.groupBy("root").agg(F.min("least").alias("least")))


def simhash(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; no link between different texts is lost.

    A null or empty text has fingerprint zero, linked like any other. component_id is the smallest doc_id
    reachable by links; a null doc_id counts for nothing there and gets the component of its fingerprint.
    Repeated rows and ids come out as often as they come in. An empty table gives an empty table. Of docs,
    only the two named columns are read.
    """
    prepare(docs.sparkSession)
    made = written(docs.select(F.col(doc_id).alias("doc_id"), _fingerprints(utf8(text)).alias("fp")))
    known, ids = _least(made, F.col("doc_id"), radius)
    ids = ids.withColumnRenamed("least", "component_id")
    of_print = written(known.join(ids, "root").select("fp", "component_id"))
    return made.join(of_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of docs for each component: the first by doc_id, then by a hash of the text; null ids come last.

    Rows are told apart by id and text: different texts under one id, or without id, each count for themselves.
    """
    prepare(docs.sparkSession)
    own = [F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash")]
    made = written(docs.select(*own, _fingerprints(utf8(text)).alias("fp")))
    _, first = _least(made, F.struct(F.col("id").isNull().alias("none"), "id", "hash"), RADIUS)
    # one key of 128 bits deals rows to the join and to the choice among equal ones: texts are shuffled once
    key = lambda i, h: F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(k), i.isNull(), i, h)) for k in (0, 1)])
    kept = first.select(key(F.col("least.id"), F.col("least.hash")).alias("__k"))
    rows = docs.withColumn("__k", key(F.col(doc_id), F.xxhash64(text))).join(kept, "__k", "left_semi")
    one = F.row_number().over(Window.partitionBy("__k").orderBy(F.xxhash64(*docs.columns)))
    return rows.withColumn("__n", one).filter("__n = 1").select(*docs.columns)
