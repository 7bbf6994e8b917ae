import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from taintloom.llm import bpe, packing

BYTES = public_tokenizers.path(bpe.TOKENIZER)
WORDS = public_tokenizers.path(packing.TOKENIZER)


def corpus():
    r = random.Random(9)
    bits = ["don't", "I'LL", "'S", "''", "é", "é", "É", "Ωσς", "ΟΔΟΣ", "İI", "ß", "  ", "\n\n", "\t", " ", "\x85", "　", "a", "the", "The", " 123", "4", "½", "œ", "%'s", "don'T", "3've", "×", "À", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "😀", "한국어", "한", "---", "...", "%%%", "_", "x_1", "\x1c", "​", "AAAA", "aaaa", "!!!", "ﬁ", "µ", "'"]
    made = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(800)]
    own = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    return ["", " ", "a" * 5000, "ab" * 3000, "\n" * 3000, *made, *own]


def test_trie_against_the_library():
    own, theirs = bpe.TrieBpe(BYTES), Tokenizer.from_file(BYTES)
    for t in corpus():
        want = theirs.encode(t, add_special_tokens=False).ids
        assert own.ids(t) == want, t[:200]
        assert own.decode(want) == theirs.decode(want, skip_special_tokens=False)
    assert own.decode([223, 50256, 100]) == theirs.decode([223, 50256, 100], skip_special_tokens=False)


def test_words_against_the_library():
    own, theirs = packing.WordIds(WORDS), Tokenizer.from_file(WORDS)
    for t in corpus():
        got = np.frombuffer(own.encode([t])[0], "<u4").tolist()
        assert got == theirs.encode(t, add_special_tokens=False).ids, t[:200]


def test_round_trip_query(spark):
    texts = [None, *corpus()[:60], corpus()[5]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(3)
    theirs = Tokenizer.from_file(BYTES)
    for r in bpe.round_trip(df, BYTES).collect():
        ids = theirs.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False)))
    back = df.select("doc_id", bpe.decode(bpe.encode("text", BYTES), BYTES).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.round_trip(df.limit(0), BYTES).collect() == []


@pytest.mark.parametrize("ranked", [200_000, 7])
def test_packing(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    texts = [None, "", *corpus()[:100], "word " * 300, "word " * 127, "word " * 128, "a b c " * 900]
    rows = [(i, t, 5, 6) for i, t in enumerate(texts)] + [(None, "no id", 5, 6), (3, texts[3], 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, sequence_id int").repartition(3)
    got = packing.pack(df, WORDS, size=128, with_ids=True).collect()
    theirs = Tokenizer.from_file(WORDS)
    used, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
    for spans in used.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 128
    assert sorted(used) == list(range(len(used)))
    for i, t in enumerate(texts):
        if i != 3:
            ids = theirs.encode(t or "", add_special_tokens=False).ids + [2]
            own = sorted(pieces[i])
            assert b"".join(x[1] for x in own) == np.array(ids, "<u4").tobytes()
            assert all(x[2] == len(ids) for x in own)
    assert len(pieces[None]) == 1 and len(pieces[3]) % 2 == 0
    total = sum(r.length for r in got)
    assert total / (len(used) * 128) > 0.9
    assert packing.pack(df.limit(0), WORDS).collect() == []


def test_plan_covers_each_rank_once():
    r = random.Random(2)
    histogram = {n: r.randint(0, 5000) for n in range(1, 513)}
    rows, made = packing.plan(histogram, 512)
    ranks, content = defaultdict(list), np.zeros(made, int)
    for length, rank, count, first, offset in rows.tolist():
        ranks[length].append((rank, count))
        assert (content[first : first + count] == offset).all()
        content[first : first + count] += length
    for n, c in histogram.items():
        at = 0
        for rank, count in sorted(ranks[n]):
            assert rank == at
            at += count
        assert at == c
    assert content.max() <= 512 and content.sum() / (made * 512) > 0.95


def test_other_tokenizers_get_whole_texts(spark):
    texts = corpus()[:120]
    own, theirs = packing.WordIds(BYTES), Tokenizer.from_file(BYTES)
    assert not own.by_words and packing.WordIds(WORDS).by_words
    for t, got in zip(texts, own.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.doc_tokens for r in packing.pack(df, BYTES).collect()}
    assert got == {i: len(theirs.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_packing_of_rows_without_ids(spark):
    """Rows of one or no id are dealt to all groups of ranks, each piece to one place."""
    df = spark.createDataFrame([(None if i % 2 else 7, "a few words") for i in range(3000)], "doc_id long, text string").repartition(5)
    rows = packing.pack(df, WORDS).collect()
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(rows) == len(places) == 3000
    assert sum(r.doc_id is None for r in rows) == 1500
