"""Personal data against plain patterns and checks, hand-made cases, and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from driftline.llm import pii
from tests.compare import assert_same

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TWICE = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def right(kind, found):
    digits = [int(c) for c in found if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(TWICE[d] if k % 2 else d for k, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), k, name, m.end()) for k, (name, p) in enumerate(PLAIN.items()) for m in p.finditer(text) if right(name, m[0])]
    return [(name, start, end) for start, _, name, end in sorted(found)]


def base_of(spans):
    return [(k, s, e) for k, s, e, _, base in spans if base]


def random_text(rng):
    parts = ["a@b.c", "_d@e.f.g", "1.2.3.4", "300.1.1.1", "007.08.09.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (487) 555-7209", "+", "@", ".", " ", "-", "x", "é", "😀", "9", "0", "12", "(", ")", "+49 30 1234567", "\n", "DE89370400440532013000", "tel 487-555-7209", "ssn 123-45-6789"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(7)
    for _ in range(3000):
        text = random_text(rng)
        assert base_of(pii.spans_of(text)) == base_spans(text), text


@pytest.mark.parametrize(("text", "kinds"), [
    ("iban DE89 3704 0044 0532 0130 00 AND GB29NWBK60161331926819.", ["iban", "iban"]),
    ("DE89 3704 0044 0532 0130 01", []),
    ("XDE89370400440532013000", []),
    ("DE893704004405320130001", []),
    ("my ssn is 123-45-6789", ["ssn"]),
    ("part 123-45-6789", []),
    ("ssn 000-45-6789, ssn 123-00-6789", []),
    ("call 487-555-7209", ["local_phone"]),
    ("row 487-555-7209", []),
    ("sample of a phone: 487-555-7209", []),
    ("call +1 (487) 555-7209", ["phone"]),
    ("version 1.2.3.4", ["ip"]),
    ("999.1.1.1 1.2.3", []),
    ("1.2.3." + "0" * 5000 + "4", ["ip"]),
    ("1.2.3." + "9" * 5000, []),
])
def test_kinds(text, kinds):
    assert [k for k, *_ in pii.spans_of(text)] == kinds


def test_scores_follow_checks_and_context():
    score = lambda text: pii.spans_of(text)[0][3]
    assert score("see 1.2.3.4") == 0.5 and score("host 1.2.3.4") == 0.8 and score("version 1.2.3.4") == 0.1
    assert score("4111 1111 1111 1111") == 0.7 and score("card: 4111 1111 1111 1111") == 1.0
    assert score("ghost 1.2.3.4") == 0.5 and score("HOST 1.2.3.4") == 0.8
    assert score("host" + " " * pii.BEFORE + "1.2.3.4") == 0.5


@pytest.mark.parametrize("part", ["a", "1", "+1 ", "1 ", "a@", "1.", "AA11", "DE11 "])
def test_long_texts_take_linear_time(part):
    began = time.perf_counter()
    pii.spans_of(part * (1_000_000 // len(part)) + "@7")
    assert time.perf_counter() - began < 20


ROWS = [(1, None), (2, ""), (3, "mail a@b.c now"), (3, "mail a@b.c now"), (None, "4111 1111 1111 1111"), (4, "é😀 1.2.3.4, 1.2.3.4"), (5, "x " * 200_000 + "+1 (487) 555-7209")]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"spans": F.lit(1), "kind": F.lit("x")}).repartition(3)
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in pii.find_personal_data(docs).collect()), key=repr)
    assert got == sorted(((i, pii.spans_of(t or "")) for i, t in ROWS), key=repr)
    assert pii.find_personal_data(docs.limit(0)).collect() == [] and pii.redact(docs.limit(0)).collect() == []
    clean = {(r.doc_id, r.text[-19:] if r.text else r.text, r.spans, r.kind) for r in pii.redact(docs).collect()}
    assert clean == {(1, None, 1, "x"), (2, "", 1, "x"), (3, "mail [EMAIL] now", 1, "x"), (None, "[CARD]", 1, "x"), (4, "é😀 [IP], [IP]", 1, "x"), (5, " x x x x x x [PHONE]"[-19:], 1, "x")}


def test_redaction_leaves_no_base_span(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert pii.find_personal_data(pii.redact(docs)).where("exists(spans, s -> s.kind <> 'card')").count() == 0


def test_query_against_plain_patterns(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pii.op13_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in base) for x in PLAIN)


def test_sql_on_random_texts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, random_text(rng)) for k in range(400)] + [(1000, None), (1001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "out"))
    folder = tmp_path / "tables"
    folder.mkdir()
    next((tmp_path / "out").glob("part-*")).rename(folder / "documents.parquet")
    assert_same(pii.op13_pii(spark, str(folder)), pii.OP13_SQL, str(folder))
