import hashlib
import re

from factweave.llm import pii


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
}
TEXTS = [
    "é mail a.b@c.de_f@g.hi, x@y no@tld. @a.b c@d.e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.1 999 1.2.3", "4111 1111 1111 1111 and 4111111111111112, 4111-1111-1111-1111-1",
    "+1 (555) 010-2030 +49 30 123 +1", "+" * 50 + "1" * 70, "phone 555-010-2030 call (555) 010 2030", "write to bob at mail dot com", "", None, "𝒳 z@q.io 10.0.0.1", "9" * 5000, "a@" * 400 + "b.cd", "1.1.1.1" + " " * 100 + "+1 23456789012",
    "+1--2--3--4--5--6--7--8--9", "+1((2((3((4((5((6((7((8((9((0", "12 4111 1111 1111 1111 1 2", "4111  1111 1111 1111 4111-1111-1111-1111", "x@y.z" * 3, "10.0.0.1 " * 700 + "+49 301234567 " * 600, "1 " * 9000, "12 ab " * 4000 + "4111111111111111",
]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    found = {r.doc_id: r for r in pii.find(df).selectExpr("doc_id", "base", "spans").collect()}
    for i, t in enumerate(TEXTS):
        want = [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, t or "") if ok(m[0])]
        assert [(x.kind, x.s, x.e) for x in found[i].base] == want
        assert {(x.kind, x.s, x.e) for x in found[i].spans} >= set(want)
    listed = df.join(pii.find(df), "doc_id").select("doc_id", pii.listed(pii.F.col("base")).alias("l")).filter("doc_id = 7").first().l
    assert hashlib.sha256(listed.encode()).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_em_finds_reliable_labelers():
    counts = {(1, 1, 1, 0, 0): 400, (1, 1, 0, 1, 0): 100, (-1, -1, -1, 0, -1): 500, (-1, -1, 1, 0, 0): 60, (1, 1, -1, 0, 0): 30}
    p = pii.em(counts)
    assert p[1, 1, 1, 0, 0] > 0.95 and p[-1, -1, -1, 0, -1] < 0.05 and p[1, 1, -1, 0, 0] > 0.5 > p[-1, -1, 1, 0, 0]


def test_many_matches_take_linear_time(spark):
    import time

    df = spark.createDataFrame([(1, "10.0.0.1 12345 a@b.cd " * 16_000)], "doc_id int, text string")
    began = time.time()
    assert len(pii.find(df).first().base) == 32_000
    assert time.time() - began < 60


def test_odd_rows(odd, empty):
    assert pii.find(odd).count() == 11 and pii.find(empty).count() == 0
