import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from casegrain.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def expected(text):
    spans = [(m.start(), i, m.end(), kind) for i, (kind, p) in enumerate(BASE.items())
             for m in re.finditer(p, text or "") if holds(kind, m[0])]
    spans.sort()
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    counts = [sum(s[3] == k for s in spans) for k in BASE]
    return (*counts, hashlib.sha256(joined.encode()).hexdigest()), [f"{k}:{a}:{b}" for a, _, b, k in spans]


def check(rows, texts):
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts):
        digest, base = expected(text)
        assert tuple(r)[1:6] == digest, text[:200]
        every = [s for s in r["spans"].split(",") if s]
        assert [s for s in every if s.split(":")[0] in BASE and s in base] == base
        for s in every:
            kind, a, b = s.split(":")
            assert 0 <= int(a) < int(b) <= len(text)


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    rows = pii.digest(pii.found_spans(docs)).orderBy("doc_id").collect()
    check(rows, [texts[r["doc_id"]] for r in rows])


TEXTS = [
    "a@b.c_d@e.f x@y..z a.b+c%d@e-f.g.h. @x.y a@b a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.4 1.2.3 1.2.3.4",
    "4041 8949-7460 8795 4041894974608795 0000 0000 0000 00 1 2 3", "+1 (988) 555-2485 ++12 +1 +123456789 +12-3456789012345678",
    "é😀 mail: ü@x.org 😀😀 4041894974608795.", "9" * 5000, "a" * 50_000 + "@", "a." * 9000 + "@b" + ".c" * 9000,
    "1 " * 5000, "+1" + " 2" * 9000, "", None, "no data", "+1 234 567 8901 4111111111111111 1.2.3.4 a@b.cd " * 40,
    "12-34.5.6.7-8@9.10 +1.2.3.4.5.6.7.8.9.0", "1.2.3.4-5.6.7.8 1..2.3.4.5", "x@-.- %@%.% a@b.c-", "007.0.0.1", "+4 4111-1111 1111-1111",
]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, found string")
    rows = pii.digest(pii.found_spans(docs)).orderBy("doc_id").collect()
    check(rows, [t or "" for t in TEXTS])
    assert pii.digest(pii.found_spans(docs.limit(0))).count() == 0
    twice = spark.createDataFrame([(1, "a@b.com"), (1, "a@b.com"), (None, "x")], "doc_id long, text string")
    assert pii.digest(pii.found_spans(twice)).count() == 3


def test_labelers_are_weighed_and_other_spans_added(spark):
    texts = [f"please email user{i}@mail{i % 9}.com or call +1 (988) 555-{1000 + i}" for i in range(60)]
    texts += [f"ssn 219-09-{1000 + i} was given" for i in range(40)]
    texts += [f"order 900-00-{1000 + i} shipped" for i in range(40)]
    texts += [f"key AKIA{'ABCDEFGH'}{10000000 + i} here" for i in range(30)]
    texts += ["or call +1 (988) 555-2485 190.137.223.204 then pay 91 4845168114407329 today"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.found_spans(docs).collect()}
    kinds = [sorted(s["kind"] for s in spans[i]) for i in range(len(texts))]
    assert all(k == ["email", "phone"] for k in kinds[:60])
    assert all(k == ["ssn"] for k in kinds[60:100])
    assert all(k == [] for k in kinds[100:140])
    assert all(k == ["secret"] for k in kinds[140:-1])
    last = {s["kind"]: s["text"] for s in spans[len(texts) - 1]}
    assert last["ip"] == "190.137.223.204" and last["phone_part"] == "+1 (988) 555-2485"
    assert spans[60][0]["text"] == "219-09-1000" and spans[60][0]["probability"] > 0.9


def plain_em(rows):
    """The same rounds over the rows themselves, one by one."""
    share = {k.name: 0.5 for k in pii.KINDS}
    hit, slip = [0.9, 0.8, 0.7], [0.1, 0.3, 0.2]
    for _ in range(pii.ROUNDS):
        posts = []
        for kind, *votes in rows:
            real, unreal = share[kind], 1 - share[kind]
            for vote, h, s in zip(votes, hit, slip):
                if vote is not None:
                    real *= h if vote else 1 - h
                    unreal *= s if vote else 1 - s
            posts.append(real / (real + unreal))
        share = {k: (sum(y for y, r in zip(posts, rows) if r[0] == k) + 1) / (sum(r[0] == k for r in rows) + 2)
                 for k in share}
        rate = lambda i, w, prior: (
            sum(w(y) for y, r in zip(posts, rows) if r[i + 1] == 1) + 10 * prior
        ) / (sum(w(y) for y, r in zip(posts, rows) if r[i + 1] is not None) + 10)
        hit = [rate(i, lambda y: y, 0.8) for i in range(3)]
        slip = [rate(i, lambda y: 1 - y, 0.2) for i in range(3)]
    return share, hit, slip


def test_em_equals_plain_rounds_and_finds_the_reliable_labelers(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(3000):
        kind, real = rng.choice([("ssn", 0.8), ("iban", 0.3)])
        real = rng.random() < real
        says = lambda right: int(real == (rng.random() < right))
        rows.append((kind, says(0.97), says(0.75), says(0.9) if rng.random() < 0.5 else None))
    votes = spark.createDataFrame(rows, "kind string, strict int, gazetteer int, context int")
    r = pii.reliabilities(votes).first()
    share, hit, slip = plain_em(rows)
    assert r["hit"] == pytest.approx(hit) and r["slip"] == pytest.approx(slip)
    assert r["share"] == pytest.approx(share)
    assert r["hit"] == pytest.approx([0.97, 0.75, 0.9], abs=0.06)
    assert r["slip"] == pytest.approx([0.03, 0.25, 0.1], abs=0.06)


def test_no_python_on_the_path(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = pii.digest(pii.found_spans(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert pii.candidates(docs).select(F.size("candidates")).count() == docs.count()


def test_long_values_are_found_whole(spark):
    token, local = "a1b2c3d4" * 80, "long.name" * 9
    docs = spark.createDataFrame(
        [(1, f"set token={token} here"), (2, f"write {local} [at] example [dot] com now")], "doc_id long, text string")
    rows = {r["doc_id"]: r["candidates"] for r in pii.candidates(docs).collect()}
    found = {i: {c["kind"]: c["text"] for c in cs} for i, cs in rows.items()}
    assert found[1]["secret"] == f"token={token}"
    assert found[2]["masked_email"] == f"{local} [at] example [dot] com"
