"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, plus signs and digits, the ``://`` of a scheme, and words
that announce an identifier. At each anchor a parser of its kind expands to the left and right as far as its characters
go, and validates what it got: domain labels, parts of an address, Luhn's and the IBAN's check digits. Parsers go over
their characters a bounded number of times, so a text of any length costs time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.catalog import query
from strandlake.llm.common import table
from strandlake.session import ship_package

#: Kinds in the order that breaks ties of a start; the first four have patterns fixed by contract, the others are the method's.
KINDS = ("email", "ip", "card", "phone", "login", "iban", "ssn", "account")
BASE = KINDS[:4]
#: Words that announce an identifier, each in lower case, upper case and capitalised.
CUES = {"iban": ("iban",), "ssn": ("ssn",), "account": ("account", "acct", "passport")}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGITS = re.compile(r"[0-9]++")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"([^\x00-\x20/?#@:]+:[^\x00-\x20/?#@]+)@[A-Za-z0-9]")
#: What may stand between a cue and its value.
LINK = r"(?:\x20(?:number|no\.?))?\x20{0,2}[:#=]?\x20{0,2}"
VALUES = {
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[0-9]{1,3})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "account": r"[A-Z0-9]{6,20}",
}
AFTER_CUE = {kind: re.compile(rf"{LINK}({value})(?![A-Za-z0-9_])") for kind, value in VALUES.items()}


def luhn(digits: str) -> bool:
    """Whether the check digit at the end is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def small_parts(address: str) -> bool:
    """Whether all parts of a dotted address are at most 255, leading zeros or not."""
    return all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in address.split(".")))


def card_number(chain: str) -> bool:
    digits = "".join(c for c in chain if c not in " -")
    return 12 <= len(digits) <= 19 and luhn(digits)


def phone_number(number: str) -> bool:
    return 9 <= sum(c in "0123456789" for c in number) <= 15


def iban_number(value: str) -> bool:
    """ISO 7064: the first four characters moved to the end, letters as 10 to 35, leave 1 when divided by 97."""
    compact = value.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def ssn_number(value: str) -> bool:
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def account_number(value: str) -> bool:
    return sum(c in "0123456789" for c in value) >= 5


VALID: dict[str, Callable[[str], bool]] = {
    "email": lambda _: True, "ip": small_parts, "card": card_number, "phone": phone_number,
    "login": lambda _: True, "iban": iban_number, "ssn": ssn_number, "account": account_number,
}


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """The automaton; a hit's value is the anchor's kind and length."""
    automaton = ahocorasick.Automaton()
    automaton.add_word("@", ("email", 1))
    automaton.add_word("+", ("phone", 1))
    automaton.add_word("://", ("login", 3))
    for digit in "0123456789":
        automaton.add_word(digit, ("number", 1))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in (cue, cue.upper(), cue.capitalize()):
                automaton.add_word(form, (kind, len(cue)))
    automaton.make_automaton()
    return automaton


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """``(kind, start, end)`` of every place that a parser expands to, leftmost first and without overlaps in a kind."""
    done = dict.fromkeys(KINDS, 0)
    for last, (anchor, size) in anchors().iter(text):
        first = last + 1 - size
        if anchor == "number":
            if first >= done["card"]:
                if m := CARD.match(text, first):
                    yield "card", first, m.end()
                done["card"] = m.end() if m else first + 1
            if first >= done["ip"]:
                if m := IP.match(text, first):
                    yield "ip", first, m.end()
                else:
                    m = DIGITS.match(text, first)  # what fails at a run's first digit fails at its others
                done["ip"] = m.end()
        elif first < done[anchor]:
            continue
        elif anchor == "email":
            start = first
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < first and (m := DOMAIN.match(text, first + 1)):
                yield "email", start, m.end()
                done["email"] = m.end()
        elif anchor == "phone":
            if m := PHONE.match(text, first):
                yield "phone", first, m.end()
                done["phone"] = m.end()
        elif anchor == "login":
            if first and text[first - 1].isascii() and text[first - 1].isalpha() and (m := LOGIN.match(text, last + 1)):
                yield "login", m.start(1), m.end(1)
                done["login"] = m.end()
        elif (not first or text[first - 1] not in WORD) and (m := AFTER_CUE[anchor].match(text, last + 1)):
            yield anchor, m.start(1), m.end(1)
            done[anchor] = m.end()


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """Valid spans by start, then kind; positions are code points from 0, ends exclusive."""
    text = text or ""
    found = [s for s in candidates(text) if VALID[s[0]](text[s[1] : s[2]])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, spans``, an array of ``kind, start, end``.

    A null or empty text has no spans. Rows that repeat an id are read on their own, a null id stays null, an empty table
    gives no rows. Spans of different kinds may overlap (a card inside a phone number). Columns other than doc_id and text
    are not read.
    """
    ship_package(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches):
        for batch in batches:
            found = ([{"kind": k, "start": a, "end": b} for k, a, b in spans(t.as_py())] for t in batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(found), pa.list_(span))], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind: string, start: long, `end`: long>>")


def redacted(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets; of overlapping spans the first one names them all.

    All columns stay, also those of clashing names; a null text stays null.
    """
    ship_package(docs.sparkSession)
    at = docs.columns.index("text")

    def replace(text: str | None) -> str | None:
        if text is None:
            return None
        parts, done, open_until = [], 0, 0
        for kind, a, b in spans(text):
            if a >= open_until:
                parts += [text[done:a], mark.format(kind.upper())]
            open_until = done = max(open_until, b)
        return "".join([*parts, text[done:]])

    def rewrite(batches):
        for batch in batches:
            texts = pa.array([replace(t.as_py()) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(rewrite, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash and list of the spans that ``find`` gave."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same rows by regular expressions: hits, what stands between them, and a check of each value."""
    forms = lambda kind: "|".join(f for c in CUES[kind] for f in (c, c.upper(), c.capitalize()))
    only = lambda v: f"regexp_replace({v}, '[^0-9]', '', 'g')"
    digit = "CAST(substr({0}, i, 1) AS INTEGER)"
    luhn_sum = f"list_sum([CASE WHEN (length({only('v')}) - i) % 2 = 0 THEN {digit.format(only('v'))} ELSE {digit.format(only('v'))} * 2 - CASE WHEN {digit.format(only('v'))} > 4 THEN 9 ELSE 0 END END FOR i IN range(1, length({only('v')}) + 1)])"
    turned = "(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4))"
    numbers = f"array_to_string([CAST(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({turned}, i, 1)) - 1 AS VARCHAR) FOR i IN range(1, length({turned}) + 1)], '')"
    rest = f"list_reduce([CAST(substr({numbers}, i, 1) AS BIGINT) FOR i IN range(1, length({numbers}) + 1)], lambda x, y: (x * 10 + y) % 97)"
    # (pattern, group of the value, characters of the hit behind the value, condition)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0, 0, "true"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 0, 0, "len([p FOR p IN string_split(v, '.') IF length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS BIGINT), 0) > 255]) = 0"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", 0, 0, f"length({only('v')}) BETWEEN 12 AND 19 AND {luhn_sum} % 10 = 0"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0, 0, f"length({only('v')}) BETWEEN 9 AND 15"),
        "login": (r"[A-Za-z]://([^\x00-\x20/?#@:]+:[^\x00-\x20/?#@]+)@[A-Za-z0-9]", 1, 2, "true"),
        "iban": (rf"\b(?:{forms('iban')}){LINK}({VALUES['iban']})\b", 1, 0, f"length(replace(v, ' ', '')) BETWEEN 15 AND 34 AND {rest} = 1"),
        "ssn": (rf"\b(?:{forms('ssn')}){LINK}({VALUES['ssn']})\b", 1, 0, "v[1:3] NOT IN ('000', '666') AND v[1] <> '9' AND v[5:6] <> '00' AND v[8:11] <> '0000'"),
        "account": (rf"\b(?:{forms('account')}){LINK}({VALUES['account']})\b", 1, 0, f"length({only('v')}) >= 5"),
    }
    hits, lists = [], []
    for rank, (kind, (pattern, group, behind, valid)) in enumerate(rules.items()):
        hits.append(f"regexp_extract_all(body, '{pattern}') AS h_{kind}, regexp_extract_all(body, '{pattern}', {group}) AS v_{kind}, string_split_regex(body, '{pattern}') AS g_{kind}")
        end = f"coalesce(list_sum([length(x) FOR x IN g_{kind}[1:j]]), 0) + list_sum([length(x) FOR x IN h_{kind}[1:j]]) - {behind}"
        lists.append(
            f"[{{'start': CAST({end} - length(v_{kind}[j]) AS BIGINT), 'rank': {rank}, 'kind': '{kind}', 'end': CAST({end} AS BIGINT)}} "
            f"FOR j IN range(1, len(h_{kind}) + 1) IF len([v FOR v IN [v_{kind}[j]] IF {valid}]) = 1]"
        )
    text = lambda s: f"coalesce(array_to_string([x.kind || ':' || x.start || ':' || x.\"end\" FOR x IN {s}], ','), '')"
    base = f"[x FOR x IN spans IF x.rank < {len(BASE)}]"
    counts = ", ".join(f"CAST(len([x FOR x IN spans IF x.kind = '{k}']) AS BIGINT) AS n_{k}" for k in BASE)
    return f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
             hits AS (SELECT doc_id, {', '.join(hits)} FROM docs),
             found AS (SELECT doc_id, list_sort({' || '.join(lists)}) AS spans FROM hits)
        SELECT doc_id, {counts}, sha256({text(base)}) AS base_sha256, {text('spans')} AS spans FROM found
    """


@query("op11_anchor_expansion", _sql())
def run(spark, sf_dir):
    return digest(find(table(spark, sf_dir, "documents")))
