from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_pii import brute as find_base
from tests.llm.test_simhash import brute as link
from tests.llm.test_simhash import plain
from tests.llm.test_suffix_dedup import brute as cut

D = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    tables = [docs]
    for _, stage in P.STAGES:
        tables.append(P.written(stage(spark, tables[-1], D)))
    rows = [{r.doc_id: r for r in t.collect()} for t in tables[:-1]]
    assert all(t.columns == docs.columns for t in tables[:-1])
    assert all(r.n_chars == len(r.text) for t in rows[1:] for r in t.values())
    # quality: the rest is as it was
    assert 0.6 * len(rows[0]) < len(rows[1]) < len(rows[0])
    assert all(r == rows[0][i] for i, r in rows[1].items())
    # near-duplicates: the first of each group
    ids = sorted(rows[1])
    groups = link([plain(rows[1][i].text) for i in ids])
    assert sorted(rows[2]) == sorted({ids[g] for g in groups})
    # repeated strings
    ids = sorted(rows[2])
    assert sorted(rows[3]) == ids
    for i, (gone, runs, _) in zip(ids, cut([rows[2][i].text.encode() for i in ids])):
        before, after = rows[2][i].text, rows[3][i].text
        assert len(before.encode()) - gone - 6 * runs <= len(after.encode()) <= len(before.encode()) - gone
        assert gone or before == after
    # personal data
    masked = 0
    for i, r in rows[4].items():
        assert not find_base(r.text)
        masked += r.text != rows[3][i].text
        assert find_base(rows[3][i].text) or "[" in r.text or r.text == rows[3][i].text
    assert masked
    # packing
    pieces = defaultdict(list)
    for r in tables[5].collect():
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in rows[4].items():
        n = len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
        assert sum(p[1] for p in pieces[i]) == n and all(p[2] == n for p in pieces[i])
    assert sorted(pieces) == sorted(rows[4])


def test_null_and_empty_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c d e", None, "s", 9)], schema)
    for some in (df, df.limit(0)):
        docs = some
        for _, stage in P.STAGES:
            docs = P.written(stage(spark, docs, D))
        assert some is df or docs.count() == 0
    assert P.near_duplicates(spark, df, D).filter("doc_id = 2").count() <= 1
