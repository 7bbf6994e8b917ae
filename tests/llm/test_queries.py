"""The registered queries of the operators, against plain versions over the small tables."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from taintloom.llm import queries
from tests.llm.test_simhash import brute as link
from tests.llm.test_simhash import plain
from tests.llm.test_suffix_dedup import brute as cut

D = "/root/testdata/sf0.001"
ID = {n: "doc_id" for n in queries.QUERIES} | {"op3_html": "page_id", "op7_chat": "conv_id", "op8_embeddings": "vec_id"}


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{D}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), [x or "" for x in t["text"].to_pylist()]))


def run(spark, name):
    return queries.QUERIES[name](spark, D)


def test_names_and_types(spark):
    want = {
        "op1_suffix_dedup": "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
        "op2_pii": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
        "op3_html": "page_id:bigint url:string text:string n_chars:bigint",
        "op4_simhash": "doc_id:bigint fingerprint:string component_id:bigint",
        "op5_packing": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
        "op6_bpe": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
        "op7_chat": "conv_id:bigint n_turns:bigint turns_sha256:string loss_chars:bigint loss_sha256:string formatted_chars:bigint",
        "op8_embeddings": "vec_id:bigint n_links:bigint component_id:bigint kept:boolean",
        "op9_media": "doc_id:bigint n_bytes:bigint payload_bytes:bigint payload_sha256:string tail_crc32:bigint media_bytes:bigint media_sha256:string feature:string",
        "op10_quality": "doc_id:bigint held_out:boolean score:double predicted:int",
    }
    for name, columns in want.items():
        have = {f"{c}:{t}" for c, t in run(spark, name).dtypes}
        assert set(columns.split()) <= have, (name, have)


def test_op1(spark, texts):
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op1_suffix_dedup").collect()}
    assert got == dict(zip(texts, cut([t.encode() for t in texts.values()])))


def test_op4(spark, texts):
    ids, prints = list(texts), [plain(t) for t in texts.values()]
    order = sorted(range(len(ids)), key=ids.__getitem__)
    groups = link([prints[i] for i in order])
    want = {ids[i]: (f"{prints[i]:016x}", ids[order[g]]) for i, g in zip(order, groups)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op4_simhash").collect()} == want


def test_op5(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, used = defaultdict(dict), defaultdict(list)
    for r in run(spark, "op5_packing").collect():
        pieces[r.doc_id][r.start] = r
        used[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for start, r in sorted(pieces[i].items()):
            assert start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for spans in used.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_op6_and_op9(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in run(spark, "op6_bpe").collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode()))
    for r in run(spark, "op9_media").collect():
        raw = texts[r.doc_id].encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), sha(padded), zlib.crc32(padded[-16:]))
