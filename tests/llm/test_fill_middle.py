"""Cuts of the skip list against sums of widths, and whole rows against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest

from strandlake.llm import fill_middle


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 257, 4000])
def test_positions_of_all_ranks(n):
    r = np.random.default_rng(n)
    widths = r.integers(1, 90, n)
    for seed in (0, 1, 2):
        units = fill_middle.SkipList(widths, seed)
        assert [units.position(i) for i in range(n + 1)] == np.concatenate([[0], np.cumsum(widths)]).tolist()
        for lane in units.lanes:
            assert lane[0].sum() == n and lane[1].sum() == widths.sum()
        with pytest.raises(IndexError):
            units.position(n + 1)


def test_lanes_are_few_and_short():
    units = fill_middle.SkipList(np.ones(200_000, dtype=np.int64), 5)
    sizes = [len(lane[0]) for lane in units.lanes]
    assert len(sizes) < 25 and all(b < 0.5 * a for a, b in zip(sizes, sizes[1:]) if a > 1000)


def test_rows_equal_a_plain_version(spark, docs_of):
    r = random.Random(3)
    texts = {i: "".join(r.choice(["ab", "é🙂", "\n", " ", "\r\n", "<P", ">", "<", "<S", "M>"]) for _ in range(r.randrange(40))) for i in range(300)}
    texts |= {400: None, 401: "", 402: "\n", 403: "\n\n\n", 404: "one line", 405: "a<P>b\nc", 406: "x\n" * 60_000, 407: "line\n" * 5 + "last"}
    rows = [*texts.items(), (None, "a\nb\nc\n"), (7, "other\ntext\n"), (7, "other\ntext\n")]
    got = fill_middle.transform(docs_of(rows)).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.output, x.n, x.form, x.prefix_chars or 0, x.middle_chars or 0) for x in got) == sorted(
        (i is None, i or 0, out, n, form, p or 0, m or 0) for i, (n, form, p, m, out) in ((i, plain(i, t)) for i, t in rows)
    )
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert sorted(fill_middle.restored(x.output, x.form) for x in got) == sorted(t or "" for _, t in rows)
    hashed = fill_middle.digest(docs_of(rows)).collect()
    assert sorted(x.restored_sha256 for x in hashed) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert sorted(x.output_sha256 for x in hashed) == sorted(hashlib.sha256(x.output.encode()).hexdigest() for x in got)
    assert fill_middle.transform(docs_of({}).limit(0)).count() == 0


def test_rates(spark, docs_of):
    docs = docs_of({i: f"a{i}\nb\nc\n" for i in range(400)})
    assert {x.form for x in fill_middle.transform(docs, rate=0).collect()} == {"plain"}
    assert {x.form for x in fill_middle.transform(docs, spm=100).collect()} == {"spm"}
    assert 120 < sum(x.form != "plain" for x in fill_middle.transform(docs, rate=50).collect()) < 280
