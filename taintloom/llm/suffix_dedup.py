"""Removal of byte strings that occur elsewhere in the corpus, by prefix-free parsing.

A rolling hash of 16 bytes picks triggers: the trigger of a 200-byte window is the least hash among its
first SPAN positions, leftmost on ties, so it depends on the window's bytes alone and equal windows have
equal triggers at equal places. Triggers cut a text into phrases; the windows that share a trigger form
one phrase region. Two levels of names stand for suffix order:

- parse level: the name of the suffix that follows a trigger, over the bytes every window of it holds;
- dictionary level: the name of a whole phrase region; where regions of one parse name differ, of runs of
  its windows; and where those differ too, of each window.

A suffix array is needed here only for "which suffixes agree on 200 bytes", that is for its equal
classes, so suffixes get names (hashes, as in naming by prefix doubling) and are grouped, not sorted:
grouping combines before a shuffle and splits hot names, a total order does neither. What counts as
equal agrees on two names, of 128 bits together; texts are told apart by two hashes, of as many bits.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintloom.llm.common import byte_slices, forget, prepare, take_cache, utf8, written

WINDOW = 200  # bytes that must agree
GRAM = 16  # bytes a trigger's hash covers
SPAN = 160  # positions of a window among which its trigger lies
TAIL = WINDOW - SPAN + 1  # bytes from a trigger on that all its windows hold
SECOND = 7  # what sets the second hash of a text apart
STEPS = (16, 4, 1)  # windows of a region compared as one: runs of so many, in turn
CHUNK = 1 << 18  # window starts handled at once

_rng = np.random.default_rng(20240607)
_TABLES = [_rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = [int(x) | 1 for x in _rng.integers(1 << 40, 1 << 62, 2)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + (1 << 17))
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = _POWERS[which] = (out[0], out[1])
    return have


class _Hashes:
    """Names of substrings of a buffer."""

    def __init__(self, data: np.ndarray, which: int) -> None:
        power, self.inverse = _powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        h = (self.sums[start + length] - self.sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h

    def grams(self, n: int) -> np.ndarray:
        """The upper 32 bits of the name of each GRAM-byte string, in place as far as possible."""
        h = self.sums[GRAM : GRAM + n] - self.sums[:n]
        h *= self.inverse[:n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h &= np.uint64(0xFFFFFFFF00000000)
        return h


def _least(values: np.ndarray) -> np.ndarray:
    """The least of each SPAN consecutive values."""
    n = len(values) - SPAN + 1
    blocks = -(-len(values) // SPAN)
    padded = np.full(blocks * SPAN, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(values)] = values
    grid = padded.reshape(blocks, SPAN)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[SPAN - 1 : SPAN - 1 + n])


def anchors(joined: np.ndarray, offsets: np.ndarray):
    """For chunks of documents: (document, first start, last start, parse name, region name, trigger).

    Starts are places in joined; a very long document comes in several chunks, which may split a region.
    """
    doc, n_docs = 0, len(offsets) - 1
    at = 0
    while doc < n_docs:
        lo = int(offsets[doc]) + at
        # as many whole documents as fit, or a part of a long one
        last = int(np.searchsorted(offsets, lo + CHUNK, side="right")) - 1
        if last > doc:
            hi, nxt = int(offsets[last]), (last, 0)
        else:
            hi = min(int(offsets[doc + 1]), lo + CHUNK + WINDOW - 1)
            nxt = (doc, at + CHUNK) if lo + CHUNK + WINDOW - 1 < offsets[doc + 1] else (doc + 1, 0)
        ids = (doc, nxt[0] if nxt[1] == 0 else doc + 1)
        data = joined[lo:hi]
        if len(data) >= WINDOW:
            yield from _chunk(data, lo, offsets, ids)
        doc, at = nxt


def _chunk(data: np.ndarray, lo: int, offsets: np.ndarray, ids: tuple[int, int]):
    n = len(data) - WINDOW + 1
    first, second = _Hashes(data, 0), _Hashes(data, 1)
    grams = len(data) - GRAM + 1
    packed = first.grams(grams)
    packed |= np.arange(grams, dtype=np.uint64)
    trigger = (_least(packed)[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    bounds = offsets[ids[0] : ids[1] + 1] - lo
    bounds = np.clip(bounds, 0, len(data))
    good = np.ones(n, bool)
    for end in bounds[1:-1]:
        good[max(0, end - WINDOW + 1) : min(n, end)] = False
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(trigger[1:], trigger[:-1], out=change[1:])
    # a region also starts after a break between documents
    change[1:] |= good[1:] & ~good[:-1]
    starts = np.flatnonzero(change & good)
    if not len(starts):
        return
    edge = np.flatnonzero(change | ~good)
    where = np.searchsorted(edge, starts, side="right")
    ends = np.where(where < len(edge), edge[np.minimum(where, len(edge) - 1)], n) - 1
    document = np.searchsorted(bounds, starts, side="right") - 1 + ids[0]
    parse = second.of(trigger[starts], TAIL)
    region = first.of(starts, ends - starts + WINDOW) ^ (trigger[starts] - starts).astype(np.uint64)
    yield document, starts + lo, ends + lo, parse.view(np.int64), region.view(np.int64), trigger[starts] + lo


def _phrases(batches):
    """The phrases of each text, repeats within a text counted."""
    take_cache("suffix_dedup")
    for batch in batches:
        joined, offsets = byte_slices(batch.column(1))
        texts = batch.column(0).to_numpy(zero_copy_only=False)
        for document, _, _, parse, region, _ in anchors(joined, offsets):
            order = np.lexsort((region, parse, document))
            d, p, r = document[order], parse[order], region[order]
            new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1]) | (r[1:] != r[:-1])])
            count = np.diff(np.r_[new, len(d)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(texts[d[new]]), pa.array(p[new]), pa.array(r[new]), pa.array(count)], ["tid", "parse", "region", "n"])


def _each_region(text: bytes, flags: list[tuple[int, int, int]]):
    """(first start, last start, trigger, kind) of the flagged regions of one text; flags: (parse, region, kind)."""
    kinds = {(p, r): k for p, r, k in flags}
    data = np.frombuffer(text, np.uint8)
    for _, starts, ends, parse, region, trigger in anchors(data, np.array([0, len(data)], np.int64)):
        for i, pair in enumerate(zip(parse.tolist(), region.tolist())):
            if (kind := kinds.get(pair)) is not None:
                yield int(starts[i]), int(ends[i]), int(trigger[i]), kind


def _lists(column: pa.Array, *fields: str):
    """For each row of an array of structs the tuples of those fields; none for null."""
    offsets = column.offsets.to_numpy()
    flat = column.values if isinstance(column, pa.ListArray) else column.flatten()
    columns = [flat.field(f) for f in fields]
    for k in range(len(column)):
        a, b = int(offsets[k]), int(offsets[k + 1])
        yield list(zip(*[c.slice(a, b - a).to_pylist() for c in columns])) if b > a else []


def _contexts(batches):
    """The bytes of each region that stands for a mixed parse name: all its windows."""
    for batch in batches:
        out = []
        for t, u, text, flags in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), _lists(batch.column(3), "parse", "region", "kind")):
            text = text.as_py()
            for lo, hi, trigger, kind in _each_region(text, flags):
                if kind:
                    out.append((t, u, lo, trigger - lo, trigger - hi, kind == 2, text[lo : hi + WINDOW]))
        for k in range(0, len(out), 5000):
            tid, uid, lo, far, near, edge, context = zip(*out[k : k + 5000])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tid, uid, lo, far, near, edge)] + [pa.array(context, pa.binary())], ["tid", "uid", "lo", "far", "near", "edge", "context"])


def _parts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of so many parts: each part's row and its number within the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _runs(step: int):
    """The open windows of each region in runs of at most `step` by distance from the trigger.

    name: what all windows of such a run hold, wherever they occur; hull: all of this run's windows.
    Runs of one window have that window as both, by two independent names.
    """

    def run(batches):
        for batch in batches:
            tid, uid, lo, far, edge = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            joined, offsets = byte_slices(batch.column(5))
            first, second = _Hashes(joined, 0), _Hashes(joined, 1)
            lists = batch.column(6)
            row0 = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            start, end = (lists.flatten().field(k).to_numpy() for k in ("lo", "hi"))
            high, low = lo[row0] + far[row0] - start, lo[row0] + far[row0] - end
            part, k = _parts(high // step - low // step + 1)
            row, bucket = row0[part], low[part] // step + k
            trigger = offsets[row] + far[row]
            core = second.of(trigger - bucket * step, WINDOW - step + 1) + bucket.astype(np.uint64)
            a, b = np.minimum(high[part], bucket * step + step - 1), np.maximum(low[part], bucket * step)
            hull = first.of(trigger - a, a - b + WINDOW) ^ a.astype(np.uint64)
            at = lo[row] + far[row]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tid[row], uid[row], lo[row], at - a, at - b, core.view(np.int64), hull.view(np.int64), edge[row])], ["tid", "uid", "region", "lo", "hi", "name", "hull", "edge"])

    return run


def _cut(text: bytes, flags: list[tuple[int, int, int]], found: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left)."""
    mark = np.zeros(len(text) + 1, np.int32)
    for lo, hi, _, kind in _each_region(text, flags):
        if kind < 2:
            mark[lo] += 1
            mark[hi + WINDOW] -= 1
    for lo, hi in found:
        mark[lo] += 1
        mark[hi + WINDOW] -= 1
    gone = np.cumsum(mark[:-1]) > 0
    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(gone) else 0
    return int(np.count_nonzero(gone)), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def _cutter(with_text: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for t, u, text, flags, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), _lists(batch.column(3), "parse", "region", "kind"), _lists(batch.column(4), "lo", "hi")):
                n, runs, left = _cut(text.as_py(), flags, found)
                rows.append((t, u, n, runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["__tid", "__uid", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def suffix_dedup(docs: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept: the text that stays, without
    the bytes of characters cut in two; null for a null text.

    A byte goes if a WINDOW-byte string over it also starts anywhere else, in the same text or another;
    strings are judged on the input. A null text is empty; a text of under WINDOW bytes stays whole; every
    row of a repeated text of at least WINDOW bytes, repeated ids included, loses all of it. An empty table
    gives an empty table. Columns of docs stay; those named like a result are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    keyed = docs.drop(*made, "__b", "__tid", "__uid", "__size", "__sha").withColumn("__b", utf8(text))
    # texts that share the first hash are taken apart by the second as soon as places in them count
    keyed = keyed.withColumns({"__tid": F.xxhash64("__b"), "__uid": F.xxhash64(F.lit(SECOND), "__b")})
    source = keyed.select("__tid", "__uid", "__b").filter(F.octet_length("__b") >= WINDOW)
    phrases = written(source.select("__tid", "__b").mapInArrow(_phrases, "tid long, parse long, region long, n int"))
    # parse names that occur twice; mixed: before different phrase regions
    names = phrases.groupBy("parse").agg(F.sum("n").alias("n"), F.min("region").alias("r0"), F.max("region").alias("r1"))
    # written, here and below: a join of two plain tables, so that Spark can split a hot name
    names = written(names.filter("n > 1").select("parse", (F.col("r0") != F.col("r1")).alias("mixed")))
    shared = written(phrases.join(names, "parse"))
    forget(phrases)
    regions = written(shared.filter("mixed").groupBy("parse", "region").agg(F.sum("n").alias("all"), F.min("tid").alias("stands")))
    mixed = shared.filter("mixed").join(regions, ["parse", "region"])
    # 0: all of it goes; 1: so too, and its windows are compared; 2: only its windows that are found elsewhere go
    kind = F.when(F.col("all") == 1, 2).when(F.col("tid") == F.col("stands"), 1).otherwise(0)
    flagged = shared.filter("not mixed").select("tid", "parse", "region", F.lit(0).alias("kind"))
    flagged = flagged.unionByName(mixed.select("tid", "parse", "region", kind.alias("kind")))
    flags = flagged.groupBy(F.col("tid").alias("__tid")).agg(F.collect_set(F.struct("parse", "region", "kind")).alias("flags"))
    texts = source.groupBy("__tid", "__uid").agg(F.first("__b").alias("__b"))
    touched = written(texts.join(flags, "__tid").select("__tid", "__uid", "__b", "flags"))
    forget(shared)
    standing = touched.filter(F.exists("flags", lambda f: f["kind"] > 0))
    contexts = written(standing.mapInArrow(_contexts, "tid long, uid long, lo long, far long, near long, edge boolean, context binary"))
    interval = F.struct("lo", "hi")
    whole = F.array(F.struct("lo", (F.col("lo") + F.col("far") - F.col("near")).alias("hi")))
    opened = contexts.withColumn("runs", whole)
    found, made = [], []
    for step in STEPS:
        if step != STEPS[0]:
            still = runs.filter("mixed").groupBy("tid", "uid", F.col("region").alias("lo")).agg(F.collect_list(interval).alias("runs"))
            opened = contexts.join(still, ["tid", "uid", "lo"])
        runs = opened.select("tid", "uid", "lo", "far", "edge", "context", "runs").mapInArrow(_runs(step), "tid long, uid long, region long, lo long, hi long, name long, hull long, edge boolean")
        by = ["name"] if step > 1 else ["name", "hull"]
        names = runs.groupBy(*by).agg(F.count("*").alias("n"), F.min("hull").alias("h0"), F.max("hull").alias("h1"))
        names = written(names.filter("n > 1").select(*by, (F.col("h0") != F.col("h1")).alias("mixed")))
        runs = written(runs.join(names, by).filter("mixed or edge").select("tid", "uid", "region", "lo", "hi", "edge", "mixed"))
        found.append(runs.filter("edge and not mixed").select(F.col("tid").alias("__tid"), F.col("uid").alias("__uid"), "lo", "hi"))
        made.append(runs)
    text_of = ["__tid", "__uid"]
    found = reduce(DataFrame.unionByName, found).groupBy(*text_of).agg(F.collect_list(interval).alias("found"))
    cut = touched.join(found, text_of, "left").select(*text_of, "__b", "flags", "found")
    cut = cut.mapInArrow(_cutter(with_text), "__tid long, __uid long, n_removed long, n_spans long, kept_sha256 string, kept string")
    cut = written(cut.select(*text_of, F.struct("n_removed", "n_spans", "kept_sha256", "kept").alias("__cut")))
    for old in (touched, contexts, *made):
        forget(old)
    # sizes and hashes are taken before the join, so that bytes are not shuffled for them
    sized = keyed.withColumns({"__size": F.octet_length("__b").cast("long"), "__sha": F.sha2("__b", 256)}).drop("__b")
    out = sized.join(cut, text_of, "left")
    none = {"n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept_sha256": F.col("__sha")}
    out = out.withColumns({"n_bytes": F.col("__size")} | {k: F.coalesce(F.col(f"__cut.{k}"), v) for k, v in none.items()} | ({"kept": F.coalesce(F.col("__cut.kept"), F.col(text))} if with_text else {}))
    return out.drop(*text_of, "__cut", "__size", "__sha")
