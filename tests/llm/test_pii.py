import hashlib
import random
import re

from taintloom.llm.pii import KINDS, find_pii, joined, mask_pii, reliabilities
from pyspark.sql import functions as F

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    r = random.Random(11)
    bits = ["a@b.c", "x.y@d-e.com_z@f.org", "@", ".", "..", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.02.3.255", "4425 6797-0686 3800", "4425679706863800", "1", "12", "+1 (509) 555-6973", "+", "+1", "+12 34", "+1()5 ", " ", "é", "\n", "😀", "ab", "-", "(", ")", "token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\"", "555-123-4567", "bob [at] mail [dot] com", "%"]
    made = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(300)]
    return [None, "", "a@b.c@d.e", "a" * 50000, "1." * 20000, "a@" + "b." * 20000 + "c", "+1" + " " * 50000, "7 " * 300, " ".join(["p.q@r.st"] * 700), *made, made[-1]]


def test_base_spans_against_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, start string, kind int").repartition(3)
    got = {r.doc_id: r for r in find_pii(df).select("doc_id", "start", joined("__base").alias("base"), joined("__all").alias("spans")).collect()}
    for i, t in rows:
        want = brute(t or "")
        assert got[i].base == ",".join(want), (i, t[:200])
        assert set(want) <= set(got[i].spans.split(","))
        assert got[i].start == "x"


def test_masking_removes_what_was_found(spark):
    df = spark.createDataFrame([(0, "é write a@b.org or +1 (509) 555-6973 now"), (1, None), (2, ""), (3, "nothing")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in mask_pii(df).collect()}
    assert got == {0: "é write [EMAIL] or [PHONE] now", 1: None, 2: "", 3: "nothing"}


def test_votes_of_reliable_labelers_win():
    p = reliabilities({(4, "111-11"): 80, (4, "1-1-11"): 40, (4, "0--00-"): 60, (4, "0---0-"): 40, (4, "1---0-"): 2})
    assert p[4, "111-11"] > 0.9 > 0.1 > p[4, "0--00-"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert find_pii(df).collect() == []


def test_secret_accepted(spark):
    rows = [(i, f"some words here token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" and more") for i in range(60)]
    rows += [(100 + i, "run-of-the-mill-slug-%d-of-words and 123456789012345678901234" % i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = find_pii(df).select("doc_id", F.size(F.filter("__all", lambda x: x["kind"] == 4)).alias("n")).collect()
    assert all(r.n == 1 for r in got if r.doc_id < 100)
    assert sum(r.n for r in got if r.doc_id >= 100) < 10


def test_query_against_brute_force(spark):
    from taintloom.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = QUERIES["op2_pii"](spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, r.spans.split(",")))
