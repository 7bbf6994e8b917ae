"""Near-duplicates among embeddings by counting collisions of one-dimensional projections.

Unit vectors are projected on random directions and sorted along each. Seen from a vector, another one
collides on a direction if it lies in the window of half width WINDOW around it. Pairs that collide on
enough directions are verified by cosine. The width and the count are set from the exact law of a
projection's difference at the threshold, so that a link at the threshold is missed with the stated chance
at most; links above it are missed less often.

Not all pairs are counted: the first directions, cut at random places into cells, deal vectors to blocks
(GROUPS times GROUP directions), and pairs of one block are counted. A pair is counted in the first block
that it shares. Large blocks are cut into parts, and every pair of parts meets in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintloom.llm.common import Forest, components, prepare, written

COSINE = 0.98
DIRECTIONS = 24
WINDOW = 2.2  # half width, in standard deviations of a projection's difference at the threshold
MISS = 1e-4  # chance that a link at the threshold has too few collisions
GROUPS = 12
GROUP = 6  # directions that one block fixes
CELL = 6.0  # width of a block's cells, in the same deviations
PART = 2048  # vectors of a block that meet in one task
PAIRS = 1 << 15  # colliding pairs verified at once: their vectors are copied


def distance(cosine: float) -> float:
    """Of unit vectors."""
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def needed(directions: int, window: float, miss: float) -> int:
    """The largest count of collisions that a link at the threshold falls short of with chance `miss` at most."""
    p = math.erf(window / math.sqrt(2))
    below, k = 0.0, 0
    while k <= directions:
        below += math.comb(directions, k) * p**k * (1 - p) ** (directions - k)
        if below > miss:
            return k
        k += 1
    return directions


def shared_cell_chance(cell: float, group: int) -> float:
    """The chance that a link at the threshold shares one block: a randomly placed cell holds both ends of a
    normal difference of deviation 1."""
    one = math.erf(cell / math.sqrt(2)) - math.sqrt(2 / math.pi) / cell * (1 - math.exp(-cell * cell / 2))
    return one**group


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _dealt(cosine: float, groups: int, group: int, cell: float):
    """(block, class) rows: block numbers of every class, from its vector."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begin = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = _unit(flat[begin[rows][:, None] + np.arange(dim)])
                width = cell * distance(cosine)
                shift = np.random.default_rng([3, dim]).uniform(0, width, groups * group)
                cells = np.floor((x @ directions(dim, groups * group, 1) + shift) / width).astype(np.int64).reshape(len(rows), groups, group)
                name = np.zeros((len(rows), groups), np.uint64)
                for k in range(group):
                    name = (name ^ cells[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    name ^= name >> np.uint64(29)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[rows], groups)), pa.FixedSizeListArray.from_arrays(pa.array(np.repeat(name.view(np.int64), groups, axis=0).ravel()), groups).cast(pa.list_(pa.int64())), pa.array(np.tile(np.arange(groups, dtype=np.int32), len(rows))), pa.array(name.view(np.int64).ravel())],
                    ["class", "names", "g", "name"],
                )

    return run


def _counted(cosine: float, count: int, window: float, need: int):
    """Links within blocks, blocks being runs of rows with equal key: sums for each class, and joining pairs."""
    half = window * distance(cosine)

    def pairs_of_small(proj: np.ndarray, bounds: np.ndarray, small: int):
        """Colliding pairs of blocks of at most `small` rows: each row with the one k rows on."""
        sizes = np.diff(bounds)
        place = np.repeat(bounds[1:], sizes)
        ok, rows = np.repeat(sizes <= small, sizes), np.arange(len(proj))
        for k in range(1, small):
            i = np.flatnonzero(ok & (rows + k < place))
            if not len(i):
                return
            hits = np.count_nonzero(np.abs(proj[i] - proj[i + k]) <= half, axis=1) >= need
            yield i[hits], i[hits] + k

    def pairs_of_large(proj: np.ndarray, lo: int, hi: int):
        """Colliding pairs of one block: rows in the order of the first direction, each strip of them against
        those that can still be in a window. A pair outside the first window may collide on all others, so
        the strip looks as far as a verified link's difference can reach."""
        order = lo + np.argsort(proj[lo:hi, 0], kind="stable")
        p = proj[order]
        reach = distance(cosine) * np.linalg.norm(directions_first)
        for a in range(0, len(p), 256):
            b = min(len(p), a + 256)
            end = int(np.searchsorted(p[:, 0], p[b - 1, 0] + reach, side="right"))
            for c in range(a, end, 4096):
                d = min(end, c + 4096)
                hits = np.zeros((b - a, d - c), np.int8)
                for k in range(count):
                    hits += np.abs(p[a:b, k, None] - p[None, c:d, k]) <= half
                i, j = np.nonzero(hits >= need)
                ok = i + a < j + c
                yield order[i[ok] + a], order[j[ok] + c]

    directions_first = np.zeros(1)

    def links(rows: pa.Table, bounds: np.ndarray):
        nonlocal directions_first
        column = lambda name: rows.column(name).combine_chunks()
        lists = column("embedding")
        dim = len(lists[0])
        x = _unit(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
        axes = directions(dim, count, 2)
        directions_first = axes[:, 0]
        proj = x @ axes
        names = column("names").flatten().to_numpy().reshape(len(rows), -1)
        cls, many, part, parts, g = (column(c).to_numpy() for c in ("class", "many", "part", "parts", "g"))
        task = column("task").to_numpy()
        sums = np.zeros(len(rows), np.int64)
        different, node = np.unique(cls, return_inverse=True)
        # the tree of each class, as far as known: pairs within one tree join nothing and never reach Python numbers
        forest, tree = Forest(), np.arange(len(different))
        left, right = [], []

        def take(i: np.ndarray, j: np.ndarray) -> None:
            # pairs of one part meet in the task of that part with itself, and in the first block that they share
            alone = task[i] // parts[i] == task[i] % parts[i]
            own = (part[i] != part[j]) | alone
            own &= ~((names[i] == names[j]) & (np.arange(names.shape[1]) < g[i, None])).any(1)
            i, j = i[own], j[own]
            good = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[good], j[good]
            np.add.at(sums, i, many[j])
            np.add.at(sums, j, many[i])
            p, q = node[i], node[j]
            apart = tree[p] != tree[q]
            made = [(a, b) for a, b in zip(p[apart].tolist(), q[apart].tolist()) if forest.link(a, b)]
            if made:
                left.extend(a for a, _ in made)
                right.extend(b for _, b in made)
                moved = list(forest.up)
                tree[moved] = [forest.find(n) for n in moved]

        def take_all(i: np.ndarray, j: np.ndarray) -> None:
            for at in range(0, len(i), PAIRS):
                take(i[at : at + PAIRS], j[at : at + PAIRS])

        for i, j in pairs_of_small(proj, bounds, 48):
            take_all(i, j)
        sizes = np.diff(bounds)
        for c in np.flatnonzero(sizes > 48):
            for i, j in pairs_of_large(proj, bounds[c], bounds[c + 1]):
                take_all(i, j)
        seen = np.flatnonzero(sums)
        a = np.r_[cls[seen], different[np.array(left, np.int64)]]
        b = np.r_[cls[seen], different[np.array(right, np.int64)]]
        n = np.r_[sums[seen], np.zeros(len(left), np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a, b, n)], ["a", "b", "links"])

    def run(batches):
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rest.append(batch)
            keys = batch.column("key").to_numpy()
            if sum(len(x) for x in rest) < 4000 or keys[0] == keys[-1]:
                continue
            rows = pa.Table.from_batches(rest)
            keys = rows.column("key").to_numpy()
            bounds = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
            yield from by_length(rows, bounds)
            rest = rows.slice(int(bounds[-1])).combine_chunks().to_batches()
        if rest:
            rows = pa.Table.from_batches(rest)
            keys = rows.column("key").to_numpy()
            yield from by_length(rows, np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(rows)])

    def by_length(rows: pa.Table, bounds: np.ndarray):
        """All vectors of a block have one length; blocks of each length are handled together."""
        if len(bounds) < 2:
            return
        size = pc.list_value_length(rows.column("embedding")).to_numpy()[bounds[:-1]]
        for dim in np.unique(size):
            own = np.flatnonzero(size == dim)
            if len(own) == len(size):
                yield from links(rows.slice(0, int(bounds[-1])), bounds)
            else:
                at = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in own])
                yield from links(rows.take(pa.array(at)), np.r_[0, np.cumsum(np.diff(bounds)[own])])

    return run


def near_embeddings(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, part: int = PART) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links within one label, cosine >= `cosine`.

    Equal vectors of one label are one class with a count, so copies make no pairs. Vectors that are null, zero
    or hold null or non-finite numbers, and those of a null label, link with nothing. Vectors of different
    lengths never link. Rows that repeat an id are vectors of their own. An empty table gives an empty table.
    """
    prepare(df.sparkSession)
    e, kind = F.col(embedding), df.schema[embedding].dataType.simpleString()
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), (e if kind == "array<float>" else e.cast("array<double>")).alias("e"))
    size = F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    usable = F.col("label").isNotNull() & F.coalesce(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)) & F.coalesce(size > 0, F.lit(False))
    # a class: equal vectors of one label, numbered by its smallest id
    vector = F.when(usable, F.transform("e", lambda x: F.when(x == 0, F.lit(0).cast(kind[6:-1] if kind == "array<float>" else "double")).otherwise(x)))
    rows = rows.select("vec_id", F.when(usable, F.struct("label", vector.alias("embedding"))).alias("what"))
    classes = rows.filter("what is not null").groupBy("what").agg(F.min("vec_id").alias("class"), F.count("*").alias("many"))
    # a repeated or null id may number two classes: the hash tells them apart
    classes = written(classes.select(F.col("what.label").alias("label"), F.col("what.embedding").alias("embedding"), F.col("class").alias("least"), "many").withColumn("class", F.xxhash64("label", "embedding")))
    # blocks are made within a label: its number is part of a block's name
    dealt = classes.select("class", "embedding").mapInArrow(_dealt(cosine, GROUPS, GROUP, CELL), "class long, names array<long>, g int, name long")
    blocks = written(dealt.join(classes.select("class", "label", F.size("embedding").alias("dim")), "class").withColumn("block", F.xxhash64("g", "label", "name", "dim")).select("class", "names", "g", "block"))
    sizes = blocks.groupBy("block").count().filter("count > 1").withColumn("parts", F.ceil(F.col("count") / part).cast("int"))
    blocks = blocks.join(written(sizes.select("block", "parts")), "block")
    own = F.pmod(F.hash("class"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(own, j) * F.col("parts") + F.greatest(own, j))
    blocks = blocks.withColumn("part", own.cast("long")).withColumn("task", F.explode(pairs))
    # two parts meet for the pairs between them, a part with itself for its own
    full = blocks.withColumn("key", F.xxhash64("block", "task")).join(classes.select("class", "embedding", "many"), "class")
    full = full.select("key", "g", "task", "class", "many", F.col("part"), F.col("parts").cast("long").alias("parts"), "names", "embedding")
    need = needed(DIRECTIONS, WINDOW, MISS)
    full = full.repartition("key").sortWithinPartitions("key")
    found = written(full.mapInArrow(_counted(cosine, DIRECTIONS, WINDOW, need), "a long, b long, links long"))
    links = found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    edges = found.filter("links = 0")
    roots = components(edges.select("a", "b")).select(F.col("node").alias("class"), "root")
    known = classes.join(links, "class", "left").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = written(known.join(least, "root").select(F.struct("label", "embedding").alias("what"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id"))
    out = rows.join(known, "what", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
