import zlib

import numpy as np
import pyarrow.parquet as pq

from taintloom.llm import quality
from taintloom.llm.quality import Model, features, long_places, places, score, score_quality, train

D = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    got = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    assert len(got) == 1000
    held = [(x["doc_id"], x["quality"]) for x in pq.read_table(f"{D}/labels.parquet").to_pylist() if zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1]
    right = sum(got[i].predicted == q for i, q in held)
    bad = [i for i, q in held if q == 0]
    assert right / len(held) > 0.9 and sum(got[i].predicted == 0 for i in bad) / len(bad) > 0.7
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    # neither other columns nor other rows' order matter
    changed = docs.selectExpr("doc_id", "text", "'x' as source", "1 as score").repartition(7)
    again = {r.doc_id: r.score for r in score_quality(changed, labels).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_nulls_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "good words"), (2, "bad %%%"), (None, None), (4, ""), (5, "w " * 100000), (1, "good words")], "doc_id long, text string")
    rows = score_quality(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert score_quality(docs.limit(0), labels).collect() == []
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_long_words_count_whole(monkeypatch):
    rng = np.random.default_rng(5)
    good, junk = (bytes(rng.choice(np.frombuffer(letters, np.uint8), 200_000)) for letters in (b"abcdefgh", b"%$#@!^&*"))
    model = train([good[i : i + 300] for i in range(0, 6000, 300)] + [junk[i : i + 300] for i in range(0, 6000, 300)], [1] * 20 + [0] * 20)
    assert isinstance(model, Model)
    known = {}
    assert score(good, model.odds, known) > 0.5 > score(good[:64] + junk, model.odds, known)
    assert not known
    # hashed in blocks as byte by byte, whatever the length
    for block in (quality.BLOCK, 7):
        monkeypatch.setattr(quality, "BLOCK", block)
        for n in (1, 2, 3, 63, 64, 65, 300):
            assert np.concatenate(list(long_places(good[:n]))).tolist() == places(good[:n])
    at, weight = features(b"x " + good[:300] + b" " + good[:300], {})
    want = np.bincount([*places(b"x"), *places(good[:300]) * 2, zlib.crc32(quality.END) % quality.BUCKETS], minlength=quality.BUCKETS).astype(float)
    assert (np.flatnonzero(want) == np.setdiff1d(at, [zlib.crc32(quality.AGAIN) % quality.BUCKETS])).all() and abs(weight.sum() - 1) < 1e-5
    assert np.allclose(weight[weight > 0], want[want > 0] / want.sum())


def test_ngrams_are_of_characters(monkeypatch):
    word = "äö漢字é😀x".encode()
    gram = lambda t, n: zlib.crc32(t.encode(), n) % quality.BUCKETS
    fenced = "<äö漢字é😀x>"
    want = [zlib.crc32(word) % quality.BUCKETS] + [gram(fenced[i : i + n], n) for n in quality.GRAMS for i in range(len(fenced) - n + 1)]
    assert places(word) == want
    for block in (quality.BLOCK, 3):
        monkeypatch.setattr(quality, "BLOCK", block)
        assert np.concatenate(list(long_places(word))).tolist() == want
    assert np.concatenate(list(long_places("字".encode() * 500))).tolist() == places("字".encode() * 500)


def sampled(docs, labels):
    rows = sorted(quality.sample(docs, labels, "text", "doc_id", "quality").collect())
    return [bytes(r.b) for r in rows], [r.label for r in rows]


def test_a_document_too_long_for_the_sample_is_passed_over(spark, monkeypatch):
    assert quality.taken([90, 5, 8, 3, 1], 10) == [1, 3, 4]
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 1000)
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    text = lambda i: f"w{i} " * (5000 if i == ids[0] or i == ids[5] else 8)
    docs = spark.createDataFrame([(i, text(i)) for i in ids for _ in range(2)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    texts, known = sampled(docs, labels)
    assert len(texts) == len(ids) - 2 and sum(map(len, texts)) <= 1000
    assert all(x == text(int(x.split()[0][1:])).encode() and y == int(x.split()[0][1:]) % 2 for x, y in zip(texts, known))


def test_scores_against_plain_features(spark):
    """The registered query against a plain version: the model that the same sample gives, applied word by word."""
    from taintloom.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    texts, known = sampled(docs, labels)
    want_texts = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table(f"{d}/documents.parquet").to_pylist()}
    marks = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{d}/labels.parquet").to_pylist()}
    learn = [i for i in marks if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(zip(texts, known)) == sorted((want_texts[i], marks[i]) for i in learn)
    model = train(texts, known)
    for r in QUERIES["op10_quality"](spark, d).collect():
        at, weight = features(want_texts[r.doc_id], {})
        want = 1 / (1 + np.exp(-float(weight.astype(float) @ model.odds[at])))
        assert abs(r.score - want) < 1e-4 and r.predicted == (r.score >= 0.5)
