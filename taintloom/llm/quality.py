"""Quality scores from supervised subword embeddings.

Words and the character n-grams of words have learned vectors at hashed places; a document is their average,
with one feature more for its end and one for each word pair that it repeats, and a softmax layer scores it.
Trained by numpy stochastic gradient descent in one task, on a bounded sample of labelled documents.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from taintloom.llm.common import forget, prepare, release, take_cache, utf8, written

#: Labelled documents, and bytes of them, that training takes at most: those first in the order of a hash of their ids;
#: of these a document that the bytes left cannot hold is passed over.
SAMPLE = 6000
SAMPLE_BYTES = 48 << 20
BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4)
EPOCHS = 8
RATE = 0.4
#: Distinct words that a worker remembers.
REMEMBERED = 200_000
#: Words of more bytes are hashed in numpy, by blocks of so many n-grams, and not remembered.
LONG, BLOCK = 64, 1 << 18
END, AGAIN = b"\0end", b"\0again"
_CRC = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)


def places(word: bytes) -> list[int]:
    """The hashed places of a word and of its character n-grams, bounds included; for words up to LONG bytes."""
    fenced = b"<" + word + b">"
    out = [zlib.crc32(word) % BUCKETS]
    if word.isascii():
        for n in GRAMS:
            out += [zlib.crc32(fenced[i : i + n], n) % BUCKETS for i in range(len(fenced) - n + 1)]
        return out
    starts = [i for i, c in enumerate(fenced) if c & 0xC0 != 0x80] + [len(fenced)]
    for n in GRAMS:
        out += [zlib.crc32(fenced[i:j], n) % BUCKETS for i, j in zip(starts, starts[n:])]
    return out


def long_places(word: bytes) -> Iterator[np.ndarray]:
    """The same for words of any length, in blocks."""
    fenced = np.frombuffer(b"<" + word + b">", np.uint8)
    starts = np.flatnonzero((fenced & 0xC0) != 0x80)
    bounds = np.r_[starts, len(fenced)]
    yield np.array([zlib.crc32(word) % BUCKETS])
    for n in GRAMS:
        grams = len(starts) - n + 1
        for at in range(0, grams, BLOCK):
            begin, end = bounds[at : min(grams, at + BLOCK)], bounds[at + n : min(grams, at + BLOCK) + n]
            size = end - begin
            crc = np.full(len(begin), n ^ 0xFFFFFFFF, np.uint32)
            for k in range(int(size.max())):
                more = k < size
                byte = fenced[np.where(more, begin + k, 0)]
                crc = np.where(more, _CRC[(crc ^ byte) & np.uint32(255)] ^ (crc >> np.uint32(8)), crc)
            yield ((crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)).astype(np.int64)


def repeats(words: list[bytes]) -> int:
    """Word pairs that occurred before in the text."""
    return max(0, len(words) - 1 - len(set(pairwise(words))))


def features(text: bytes, seen: dict[bytes, array]) -> tuple[np.ndarray, np.ndarray]:
    """A document's places and their weights, which sum to 1."""
    words = text.split()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    at: list[int] = [zlib.crc32(END) % BUCKETS, zlib.crc32(AGAIN) % BUCKETS]
    weight: list[float] = [1, repeats(words) * 8]
    more: list[tuple[np.ndarray, np.ndarray]] = []
    for w, n in counts.items():
        if len(w) > LONG:
            for block in long_places(w):
                different, times = np.unique(block, return_counts=True)
                more.append((different, times * n))
            continue
        own = seen.get(w)
        if own is None:
            own = seen[w] = array("i", places(w))
        at += own
        weight += [n] * len(own)
    all_at = np.concatenate([np.array(at, np.int32), *[x[0] for x in more]]) if more else np.array(at, np.int32)
    unique, where = np.unique(all_at, return_inverse=True)
    sums = np.bincount(where, weights=np.concatenate([weight, *[x[1] for x in more]]) if more else weight)
    return unique, (sums / sums.sum()).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """odds: for each place, its vector times the difference of the two softmax rows."""

    odds: np.ndarray

    @property
    def key(self) -> int:
        return zlib.crc32(self.odds.tobytes())


def train(texts: list[bytes], labels: list[int], seed: int = 7) -> Model:
    """The model of these documents; without documents, or with one label alone, every score is 0.5 or leans to it."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out = np.zeros((2, DIM))
    seen: dict[bytes, array] = {}
    docs = []
    for t in texts:
        if len(seen) > REMEMBERED // 2:
            seen.clear()
        docs.append(features(t, seen))
    seen.clear()
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            rate = RATE * (1 - done / steps)
            done += 1
            at, weight = docs[i]
            own = vectors[at]
            hidden = weight @ own
            logits = out @ hidden
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            vectors[at] = own - np.outer(weight, p @ out) * (rate * 8)
            out -= rate * np.outer(p, hidden)
    return Model((vectors @ (out[1] - out[0])).astype(np.float64))


def taken(sizes: list[int], most: int) -> list[int]:
    """Which of the documents of these sizes, in order, fit in `most` bytes together: one that does not fit is passed over."""
    out, left = [], most
    for i, n in enumerate(sizes):
        if n <= left:
            out.append(i)
            left -= n
    return out


def sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str) -> DataFrame:
    """(nth, b, label): whole texts and labels of at most SAMPLE documents and SAMPLE_BYTES bytes, spread by a hash of
    the id. Only their lengths reach the driver. Of the texts of a repeated id one is taken.
    """
    order = [F.xxhash64(F.lit(17), "id"), F.col("id")]
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.filter(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3)) != 1).orderBy(*order).limit(SAMPLE)
    # at most SAMPLE rows of two numbers: small enough to send to every task
    rows = docs.select(F.col(doc_id).alias("id"), utf8(text).alias("b")).join(F.broadcast(chosen), "id")
    rows = written(rows.withColumn("hash", F.xxhash64("b")))
    # at most SAMPLE rows of four numbers
    one = rows.groupBy("id", "label").agg(F.min(F.struct("hash", F.octet_length("b").alias("n"))).alias("x"))
    one = sorted(one.select(order[0].alias("o"), "id", "x.hash", "x.n").collect())
    fits = [one[i] for i in taken([r.n for r in one], SAMPLE_BYTES)]
    schema = f"id {rows.schema['id'].dataType.simpleString()}, hash long, nth int"
    ids = rows.sparkSession.createDataFrame([(r.id, r.hash, i) for i, r in enumerate(fits)], schema)
    return rows.join(F.broadcast(ids), ["id", "hash"]).dropDuplicates(["nth"]).select("nth", "b", "label")


def _trained(batches):
    """The odds of the model of all rows, as bytes: learned where the rows are, in their order."""
    take_cache("quality", _known.clear)
    rows = sorted((n, b, y) for batch in batches for n, b, y in zip(*[c.to_pylist() for c in batch.columns]))
    odds = train([b for _, b, _ in rows], [y for _, _, y in rows]).odds.tobytes()
    del rows
    release()
    yield pa.RecordBatch.from_arrays([pa.array([odds], pa.binary())], ["odds"])


def learn(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str) -> Model:
    """The model of the sample, trained in one task of bounded size; the driver gets BUCKETS numbers."""
    rows = sample(docs, labels, text, doc_id, label)
    got = rows.repartition(1).mapInArrow(_trained, "odds binary").collect()
    forget(rows)
    return Model(np.frombuffer(got[0].odds, np.float64)) if got else train([], [])


_known: dict[bytes, complex] = {}
_known_of: list[int] = []


def score(text: bytes, odds: np.ndarray, known: dict[bytes, complex]) -> float:
    """The chance of label 1. known: for each word the sum over its places (real) and their number (imaginary)."""
    words = text.split()
    long: dict[bytes, complex] = {}
    for w in set(words):
        if len(w) > LONG:
            sums = [(float(odds[block].sum()), len(block)) for block in long_places(w)]
            long[w] = complex(sum(x for x, _ in sums), sum(n for _, n in sums))
        elif w not in known:
            own = places(w)
            known[w] = complex(float(odds[own].sum()), len(own))
    again = repeats(words) * 8
    of_word = (lambda w: long[w] if len(w) > LONG else known[w]) if long else known.__getitem__
    total = sum(map(of_word, words), complex(odds[zlib.crc32(END) % BUCKETS], 1))
    mean = (total.real + again * odds[zlib.crc32(AGAIN) % BUCKETS]) / (total.imag + again)
    return float(1 / (1 + np.exp(-np.clip(mean, -500, 500))))


def scorer(spark, model: Model):
    shared, key = spark.sparkContext.broadcast(model.odds), model.key

    @F.pandas_udf(DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        take_cache("quality", _known.clear)
        if _known_of != [key]:
            _known.clear()
            _known_of[:] = [key]
        odds, out = shared.value, []
        for t in texts:
            if len(_known) > REMEMBERED:
                _known.clear()
            out.append(score(t, odds, _known))
        return pd.Series(out)

    return run


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """docs with held_out, score and predicted; columns of these names are replaced.

    Learns from rows of labels whose crc32 of the id, modulo 3, is not 1, with a label of 0 or 1; an id
    labelled both ways counts as 1. The text alone is scored. A null text is empty and gets the score of an
    end without words; a null id is not held out. Without labels every score is 0.5.
    """
    spark = docs.sparkSession
    prepare(spark)
    model = learn(docs, labels, text, doc_id, label)
    out = docs.withColumn("score", scorer(spark, model)(utf8(text)))
    held = F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))
    return out.withColumns({"held_out": held, "predicted": F.when(F.col("score") >= 0.5, 1).otherwise(0)})
