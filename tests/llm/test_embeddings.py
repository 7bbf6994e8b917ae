import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from taintloom.llm import embeddings
from taintloom.llm.embeddings import CELL, GROUP, GROUPS, near_embeddings, needed, shared_cell_chance

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, class int"


def brute(rows, cosine=0.98):
    out, up = {}, {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    good = {}
    for i, v, lab in rows:
        up[i], out[i] = i, 0
        if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[i] = (lab, x / np.linalg.norm(x))
    ids = list(good)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if good[i][0] == good[j][0] and len(good[i][1]) == len(good[j][1]) and good[i][1] @ good[j][1] >= cosine:
                out[i] += 1
                out[j] += 1
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (out[i], find(i)) for i in out}


def data(seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for lab in (0, 1, None):
        for _ in range(40):
            c = r.standard_normal(16)
            c /= np.linalg.norm(c)
            for _ in range(r.integers(1, 8)):
                noise = r.standard_normal(16) * r.uniform(0, 0.06)
                rows.append(((c + noise) * r.uniform(0.5, 2), lab))
    rows += [(rows[3][0], 0)] * 30 + [(rows[3][0] * 2, 0)]
    rows = [(i * 2, [float(x) for x in v], lab) for i, (v, lab) in enumerate(rows)]
    n = 100_000
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] + [1.0] * 15, 0), (n + 4, [None] + [1.0] * 15, 0), (n + 5, [float("inf")] + [1.0] * 15, 0), (n + 6, [1.0] * 8, 0), (n + 7, [1.0] * 8, 0)]
    return rows


@pytest.mark.parametrize("part", [2048, 9])
def test_against_brute_force(spark, part):
    rows = data()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = {r.vec_id: r for r in near_embeddings(df, part=part).collect()}
    want = brute(rows)
    links, found = sum(n for n, _ in want.values()), sum(r.n_links for r in got.values())
    assert found <= links and found / links > 0.99
    for i, (n, c) in want.items():
        assert got[i].n_links <= n and got[i].kept == (got[i].component_id == i)
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) / len(want) > 0.98


def recall(spark, rows):
    """Of the links of every row whose id is divisible by 100 with all rows, those found; by n_links against numpy."""
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, label = np.array([i for i, _, _ in rows]), np.array([lab for _, _, lab in rows])
    asked = np.flatnonzero(ids % 100 == 0)
    near = (x[asked] @ x.T >= 0.98) & (label[asked, None] == label)
    want = dict(zip(ids[asked].tolist(), (near.sum(1) - 1).tolist()))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = {r.vec_id: r.n_links for r in near_embeddings(df).collect() if r.vec_id % 100 == 0}
    assert got.keys() == want.keys() and all(got[i] <= n for i, n in want.items())
    return sum(want.values()), sum(got.values())


def test_recall_on_the_table_with_planted_links(spark):
    """The tables hold no links of their own: rows asked for get neighbours at every cosine from 0.97 to 1."""
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()]
    r = np.random.default_rng(4)
    asked = [row for row in rows if row[0] % 100 == 0]
    assert len(asked) >= 20
    top = max(i for i, _, _ in rows) + 1
    more = []
    for _, v, lab in asked:
        v = np.array(v, float)
        v /= np.linalg.norm(v)
        for cosine in np.linspace(0.97, 0.9999, 60):
            w = r.standard_normal(len(v))
            w -= (w @ v) * v
            w = v * cosine + w / np.linalg.norm(w) * np.sqrt(1 - cosine * cosine)
            more.append((top + len(more), (w * r.uniform(0.2, 5)).tolist(), lab))
    rows = [(i if i < top else i * 100 + 1, [float(c) for c in v], lab) for i, v, lab in rows + more]
    links, found = recall(spark, rows)
    assert links > 30 * len(asked) and found / links >= 0.97


def test_recall_on_the_check_table(spark):
    path = "/root/testdata/check_s/embeddings.parquet"
    if not os.path.isdir(path):
        path = "/root/testdata/sf0.01/embeddings.parquet"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(path).to_pylist()]
    rows = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, found = recall(spark, rows)
    assert found >= 0.97 * links


@pytest.mark.parametrize("pairs", [7, 1 << 15])
def test_a_dense_block_in_pieces(monkeypatch, pairs):
    """Two groups of near copies in one block: all links are counted, and as many pairs made as join."""
    monkeypatch.setattr(embeddings, "PAIRS", pairs)
    r = np.random.default_rng(6)
    centres = np.array([[3.0, 0, 0, 0, 0, 0, 0, 0], [3.0, 1, 0, 0, 0, 0, 0, 0]])
    x = (centres[np.arange(300) % 2] + r.standard_normal((300, 8)) * 0.01).astype(np.float32)
    many = 1 + np.arange(300) % 3
    n, same = len(x), lambda v: np.full(300, v, np.int64)
    columns = [pa.array(v) for v in (same(5), same(0).astype(np.int32), same(0), np.arange(n) * 10, many, same(0), same(1))]
    names = pa.FixedSizeListArray.from_arrays(pa.array(np.zeros(n, np.int64)), 1).cast(pa.list_(pa.int64()))
    lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 8).cast(pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([*columns, names, lists], ["key", "g", "task", "class", "many", "part", "parts", "names", "embedding"])
    out = [row for b in embeddings._counted(0.98, 24, 6.0, 20)([batch]) for row in b.to_pylist()]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & ~np.eye(n, dtype=bool)
    sums = {row["a"] // 10: row["links"] for row in out if row["links"]}
    assert sums == {i: int((near[i] * many).sum()) for i in range(n)}
    made = [(row["a"] // 10, row["b"] // 10) for row in out if not row["links"]]
    assert all(near[p, q] for p, q in made) and len(made) == n - 2
    group = {i: i for i in range(n)}
    for p, q in made:
        old, new = group[p], group[q]
        group = {k: new if v == old else v for k, v in group.items()}
    assert len(set(group.values())) == 2


def test_calibration():
    assert 1 - (1 - shared_cell_chance(CELL, GROUP)) ** GROUPS > 0.99
    assert 10 < needed(24, 2.2, 1e-4) < 24


def test_ids_and_empty_table(spark):
    v = [1.0, 2.0]
    df = spark.createDataFrame([(1, v, 0, "", 0), (1, v, 0, "", 0), (None, v, 0, "", 0), (5, [2.0, -1.0], 0, "", 0)], SCHEMA)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in near_embeddings(df).collect())
    assert got == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (5, 0, 5)]
    assert near_embeddings(df.limit(0)).collect() == []
