import random
import re

import numpy as np
import pytest
import xxhash

from taintloom.llm.simhash import embed, fingerprint, keep_one, link_fingerprints, manhattan, masks, simhash


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(prints, radius=4):
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(prints))]


def test_lower_bound():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 5000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << r.integers(0, 64, 5000).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 5000).astype(np.uint64))
    counts = lambda x: np.array([[int(v >> (2 * s) & 3).bit_count() for s in range(32)] for v in x.tolist()])
    want = np.abs(counts(a) - counts(b)).sum(1)
    assert (manhattan(embed(a), embed(b)) == want).all()
    assert (want <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("blocks,cell", [(6, 1 << 16), (7, 1 << 16), (8, 1 << 16), (6, 40)])
def test_links_against_brute_force(spark, blocks, cell):
    r = random.Random(blocks)
    prints = [r.getrandbits(64) for _ in range(150)]
    for _ in range(250):
        x = r.choice(prints)
        for _ in range(r.randint(1, 6)):
            x ^= 1 << r.randrange(64)
        prints.append(x)
    base = r.getrandbits(64)
    prints += [base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(300)]
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {x.node: x.root for x in link_fingerprints(df, cell=cell, blocks=blocks).collect()}
    want = brute([p & (1 << 64) - 1 for p in prints])
    assert len(masks(blocks, 4)) >= 15
    for i, p in enumerate(prints):
        assert got.get(p, p) == prints[want[i]]


def test_documents(spark):
    r = random.Random(3)
    words = ["Éa", "AB", "c", "dé", "Zz", "ß", "q,", "W"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [None, "", " \t\n", "one", "One", "a b c", *[make(r.randint(0, 9)) for _ in range(60)], *[make(300) for _ in range(20)]]
    texts += [t + " end" for t in texts[-5:]] + ["x " * 30000] + texts[-3:]
    rows = [(i * 3, t, 1, "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[-1:], "doc_id long, text string, component_id int, fp string").repartition(3)
    got = simhash(df).collect()
    assert len(got) == len(rows) + 1
    prints = [plain(t) for t in texts]
    want = brute(prints)
    for g in got:
        i = g.doc_id // 3
        assert (g.fingerprint, g.component_id) == (f"{prints[i]:016x}", want[i] * 3)
    assert fingerprint(b"") == 0


def test_empty_table(spark):
    assert simhash(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_row_of_each_component_stays(spark):
    r = random.Random(9)
    a, b, c, d = ("".join(f"{r.randrange(10**6)} " for _ in range(80)) for _ in range(4))
    # id 1 stands for two texts, one of them a copy of id 0; d has no id; copies without an id of a text with one go
    rows = [(0, a), (1, a), (1, b), (1, b), (2, b), (2, c), (None, d), (None, d), (None, a), (None, None), (None, ""), (7, c)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "n long, text string, source string").repartition(3)
    got = [(x.n, x.text or "", x.source) for x in keep_one(df, doc_id="n").collect()]
    assert sorted(got, key=str) == sorted([(0, a, "s"), (1, b, "s"), (2, c, "s"), (None, d, "s"), (None, "", "s")], key=str)
    assert keep_one(df.limit(0), doc_id="n").collect() == []
