"""Secret and PII spans against plain regular expressions over small and awkward texts."""

import hashlib
import os
import re
import zlib

import pytest

from askloom.llm import pii, queries, secrets
from askloom.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
LONG = "x" * 60_000
TEXTS = [
    None, "", " ", LONG, "9" * 30_000, "a." * 20_000, "1.2." * 5_000, "a@b.c_d@e.f @ x@y", "mail a@b.co, c+d@e-f.org. 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8.9",
    "é à 4111 1111 1111 1111 é 4111-1111-1111-1112 4111111111111111", "+1 (212) 555-0100 +49 30 123456 +1 2 ++3 4567 8901 23 +" + "1" * 30,
    "日本 a@b.jp \U0001F600 10.0.0.1", "password=abc token: 'longer_value' API_KEY = \"a/b+c=\" secret=token=abcdefg passwd:" + " " * 500 + "hunter22",
    "PassWord='S3cret99' toKen=abcdef tokenn=abcdef apikey=123456 toKen=abcdef", "AKIA" + "A" * 16 + " AKIA12 xAKIA" + "B" * 20,
    "f" * 24 + " " + "a" * 23 + "é" + "0123456789abcdef" * 4 + "G", "call 212-555-0100 or (212) 555-0100", "SSN 123-45-6789 social security",
    "IBAN DE89 3704 0044 0532 0130 00 konto", "DE00370400440532013000", "1.2.3.4@5.6.7.8",
]


def _leftmost(pattern, text, good, flags=re.ASCII):
    return [(m.start(), m.end()) for m in re.finditer(pattern, text, flags) if good(m)]


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def _digits(m):
    return re.sub("[^0-9]", "", m[0])


def pii_spans(t):
    return {
        "email": _leftmost(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t, lambda m: True) if len(t) < 50_000 or "@" in t else [],
        "ip": _leftmost(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t, lambda m: all(int(x) <= 255 for x in m[0].split("."))) if "." in t else [],
        "card": _leftmost(r"[0-9]([\x20-]?[0-9])+", t, lambda m: 16 <= len(_digits(m)) <= 19 and _luhn(_digits(m))),
        "phone": _leftmost(r"\+[0-9][\x20().0-9-]+[0-9]", t, lambda m: 8 <= len(_digits(m)) <= 15),
    }


def secret_spans(t):
    return {
        "assign": _leftmost(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, lambda m: len(m[2]) >= 6,
                            re.ASCII | re.IGNORECASE),
        "access": _leftmost(r"AKIA[A-Z0-9]+", t, lambda m: len(m[0]) >= 20),
        "hex": _leftmost(r"[0-9a-f]+", t, lambda m: len(m[0]) >= 24),
    }


def _sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def _check_pii(row, text):
    want = pii_spans(text or "")
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(len(want[k]) for k in ("email", "ip", "card", "phone")), text[:80]
    assert row.base_sha256 == _sha([(k, a, b) for k in want for a, b in want[k]])


def _check_secrets(row, text):
    want = secret_spans(text or "")
    assert (row.n_assign, row.n_access, row.n_hex) == tuple(len(want[k]) for k in ("assign", "access", "hex")), text[:80]
    order = list(want)
    spans = sorted(((a, order.index(k), b, k) for k in want for a, b in want[k]))
    assert row.base_sha256 == _sha([(k, a, b) for a, _, b, k in spans])


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "x", -1) for i, t in enumerate(TEXTS)] + [(0, None, "x", 1), (3, LONG, "x", 1), (None, "a@b.co", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, kind string, start long").repartition(3)


def test_pii_of_awkward_texts(spark, awkward):
    found = pii.find_pii(awkward)
    rows = queries.span_digest(found, "pii", pii.BASE_KINDS).collect()
    assert len(rows) == len(TEXTS) + 3
    for row in rows:
        if row.doc_id is not None:
            _check_pii(row, TEXTS[row.doc_id])


def test_pii_adds_further_kinds(spark):
    rows = spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00 konto"), (2, "SSN 123-45-6789 social security"), (3, "nothing 12-34")],
                                 "doc_id long, text string")
    assert {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii] for r in pii.find_pii(rows).collect()} == {
        1: [("iban", 5, 32)], 2: [("ssn", 4, 15)], 3: []}


def test_secrets_of_awkward_texts(spark, awkward):
    rows = queries.span_digest(secrets.find_secrets(awkward), "secrets", ("assign", "access", "hex")).collect()
    assert len(rows) == len(TEXTS) + 3
    for row in rows:
        if row.doc_id is not None:
            _check_secrets(row, TEXTS[row.doc_id])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(none).count() == 0 and secrets.find_secrets(none).count() == 0 and pii.redact(none).count() == 0


def test_redacted_texts_hold_no_span(spark, awkward):
    clean = pii.redact(awkward)
    assert clean.columns == awkward.columns and clean.count() == awkward.count()
    assert not any(pii_spans(r.text or "")["email"] for r in clean.collect())


def test_checksummed_tokens(spark):
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[d] + digits
    good = "ghp_" + body + digits.rjust(6, "0")
    rows = spark.createDataFrame([(1, f"x {good} y"), (2, f"x {good[:-1]}! y"), (3, f"ghp_{'A' * 36}")], "doc_id long, text string")
    assert {r.doc_id: [s.kind for s in r.secrets] for r in secrets.find_secrets(rows).collect()} == {1: ["github"], 2: [], 3: []}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not found")
def test_whole_tables(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for row in QUERIES["op7_pii"](spark, SMALL).collect():
        _check_pii(row, texts[row.doc_id])
    for row in QUERIES["op2_secret_scan"](spark, SMALL).collect():
        _check_secrets(row, texts[row.doc_id])
