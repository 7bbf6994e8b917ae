import hashlib
import random

import pytest
from pyspark.sql import Row

from taintloom.llm.suffix_dedup import CHUNK, WINDOW, suffix_dedup


def brute(texts):
    """Per text (removed, runs, hash of the rest), from every window."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - WINDOW + 1):
            w = t[p : p + WINDOW]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - WINDOW + 1):
            if seen[t[p : p + WINDOW]] > 1:
                gone[p : p + WINDOW] = b"\1" * WINDOW
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def compare(spark, texts):
    rows = [Row(doc_id=i, text=t, n_spans="x", tid=1, parse=2, pos=3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_spans string, tid int, parse int, pos int").repartition(3)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256, r.n_bytes) for r in suffix_dedup(df, with_text=False).collect()}
    as_bytes = [(t or "").encode() for t in texts]
    for i, (t, want) in enumerate(zip(as_bytes, brute(as_bytes))):
        assert got[i] == (*want, len(t)), (i, len(t))
    for r in suffix_dedup(df, with_text=True).collect():
        left, t = r.kept, texts[r.doc_id]
        assert (r.n_removed, r.n_spans, r.kept_sha256, r.n_bytes) == got[r.doc_id]
        if (t or "").isascii():
            assert hashlib.sha256((left or "").encode()).hexdigest() == r.kept_sha256 and (left is None) == (t is None)
        else:
            assert r.n_bytes - r.n_removed - 6 * r.n_spans <= len(left.encode()) <= r.n_bytes - r.n_removed


@pytest.mark.parametrize("seed,alphabet", [(1, "ab"), (2, "abcdefgh é"), (3, "a")])
def test_against_every_window(spark, seed, alphabet):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    passages = [word(n) for n in (150, 199, 200, 201, 260, 700)]
    texts = [None, "", "short", word(WINDOW), word(5000)]
    for _ in range(25):
        parts = [word(r.randint(0, 300)) if r.random() < 0.5 else (p := r.choice(passages))[r.randint(0, 60) :] for _ in range(r.randint(1, 6))]
        texts.append("".join(parts))
    texts += [texts[-1], texts[-1], texts[-2], "xyz " * 400, "q" * 1000, "q" * 199, "q" * 201]
    compare(spark, texts)


def test_long_text_in_chunks(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefghijklmnop") for _ in range(CHUNK + 5000))
    texts = [long, long[CHUNK - 700 : CHUNK + 300], "zz" + long[CHUNK - 100 : CHUNK + 150] + "zz", long[: CHUNK // 2] + "!" + long[CHUNK // 2 :]]
    compare(spark, texts)


def test_texts_that_share_a_hash(spark, monkeypatch):
    """Every text has the same first hash: the second tells them apart."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(5).cast("long") if len(c) == 1 else real(*c))
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    one, two = word(500), word(260)
    texts = [word(300) + one + word(50), one[40:] + word(700), word(900), two, word(10) + two, two[:230] + word(400), "short", None, word(250)]
    compare(spark, texts + texts[:2])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup(df).collect() == []
