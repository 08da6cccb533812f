"""Anchor expansion against plain regular expressions, and its own kinds on hand-made cases."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, hit):
    digits = [int(c) for c in hit if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    kinds = list(PATTERNS)
    out = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


TEXTS = {
    1: "mail a.b+c@mail.example.com, or x@y@z.org@q.com.au. and @no.body nobody@ host@single",
    2: "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.04 1.2.3 999999999999.1.1.1 12.34.56.78.",
    3: "4111 1111 1111 1111 and 4111-1111-1111-1112 1234567890123452 0000 0000 0000 x12 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    4: "+1 (509) 555-6973 +44 20 7946 0958. +12 ++3 555 1234 567 8 +1234567890123456789 +49 ()",
    5: "",
    6: None,
    7: "ñé🙂 a@b.co 🙂 +1 768 555 9731",
    8: "a@b.c@d.e 1-2-3 x%40@a-.-b.c..d",
    9: "1.1.1.1@2.2.2.2 +1.1.1.1.1.1.1.1.1",
}


def test_base_spans_equal_regular_expressions(spark, docs_of):
    rows = [*TEXTS.items(), (1, TEXTS[2]), (None, TEXTS[1])]
    got = pii.digest(pii.find(docs_of(rows))).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == sorted(
        (i or 0, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base(t)).encode()).hexdigest(), *[sum(s[0] == k for s in base(t)) for k in PATTERNS])
        for i, t in rows
    )
    assert pii.digest(pii.find(docs_of({}).limit(0))).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0159.@+- ()aZ_%\nñ:/", max_size=60))
def test_any_text_has_the_spans_of_the_patterns(text):
    assert [s for s in pii.spans(text) if s[0] in PATTERNS] == base(text)


@pytest.mark.parametrize("text,kind,value", [
    ("see https://joe:s3cr3t@host.example/x", "login", "joe:s3cr3t"),
    ("IBAN: DE89370400440532013000.", "iban", "DE89370400440532013000"),
    ("iban DE89 3704 0044 0532 0130 00 AND", "iban", "DE89 3704 0044 0532 0130 00"),
    ("SSN 219-09-9999", "ssn", "219-09-9999"),
    ("Account number: 0012345678", "account", "0012345678"),
    ("passport no. C01X00T47", "account", "C01X00T47"),
])
def test_spans_of_the_method(text, kind, value):
    assert [(k, text[a:b]) for k, a, b in pii.spans(text) if k not in PATTERNS] == [(kind, value)]


@pytest.mark.parametrize("text", [
    "IBAN: DE89370400440532013001", "SSN 666-09-9999", "account of 12 days", "on account of ACCOUNT", "myaccount 12345678",
    "http://host:80/path@x", "http://host/joe:pw@x", "passport ABCDEFGH", "iban", "://", "account 123456789012345678901",
])
def test_what_does_not_validate_is_left_alone(text):
    assert not [s for s in pii.spans(text) if s[0] not in PATTERNS]


@pytest.mark.parametrize("unit", ["1", "a", "1.", "a@", "+1 ", "1 ", "://a:", "account ", "9" * 50 + "x", "a@b", "1.1.1", "+" + "5" * 3])
def test_time_grows_with_the_length_alone(unit):
    text = unit * (400_000 // len(unit))
    begun = time.time()
    pii.spans(text)
    assert time.time() - begun < 10


def test_redacted_texts_hold_no_base_spans(spark, docs_of):
    docs = docs_of({i: t for i, t in TEXTS.items()})
    got = pii.redacted(docs)
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[6] is None and texts[5] == "" and texts[7] == "ñé🙂 [EMAIL] 🙂 [PHONE]"
    assert all(not base(t) for t in texts.values())
