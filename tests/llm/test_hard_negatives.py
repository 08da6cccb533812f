"""Mined negatives against all scores, and the walk's early end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    good = [
        (u, i, l, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        for u, (i, v, l) in enumerate(rows)
        if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for u, i, label, v in good:
        if i is None or i % 100:
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, t, m) for t, j, m, w in good if t != u and len(w) == len(v)]
        for p, _, pid, _, _ in sorted(x for x in others if x[4] == label)[:5]:
            fits = [x for x in others if x[4] != label and -80 * p <= -100 * x[0] <= -100 * p]
            out += [(i, pid, rank, x[2], -p, -x[0]) for rank, x in enumerate(sorted(fits)[:5], 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(3) for c in ("uid", "size", "ints", "rank", "anchor", "team", "block")})
    ready = hard_negatives.prepared(df)
    got = hard_negatives.mine(ready, ready.where("vec_id % 100 = 0"), **how).collect()
    return sorted((x.anchor_id, x.positive_id or 0, x.rank, x.negative_id or 0, x.positive_score, x.negative_score) for x in got)


def cloud(n, d, seed, spread=1.0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(8, d))
    rows = [(int(i), (base[i % 8] + spread * r.normal(size=d)).astype(np.float32).tolist(), int(r.integers(0, 3))) for i in range(n)]
    return rows


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_equal_to_all_scores(spark, spread):
    rows = cloud(1200, 12, 5, spread)
    odd = [
        (100, rows[100][1], 0), (100, rows[100][1], 1), (None, rows[200][1], 1), (2000, None, 1), (2100, [1.0] * 12, None),
        (2200, [float("nan")] * 12, 1), (2300, [None] + [1.0] * 11, 1), (2400, [0.0] * 12, 1), (2500, [1.0] * 3, 1), (2501, [1.0] * 3, 2),
        (2502, [1.1] * 3, 1), (2600, [], 1), (2601, [], 2), (2602, [], 1),
    ]
    assert mined(spark, rows + odd) == brute(rows + odd)


def test_copies_and_ties(spark):
    r = np.random.default_rng(2)
    hot = r.normal(size=6).astype(np.float32).tolist()
    rows = [(i, hot, i % 2) for i in range(300)] + [(300 + i, r.normal(size=6).astype(np.float32).tolist(), i % 3) for i in range(300)]
    assert mined(spark, rows) == brute(rows)


def test_small_blocks_and_full_clusters(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "GROUP", 8 * 12 * 4)
    monkeypatch.setattr(hard_negatives, "STEP", 8)
    rows = [(10 * i, v, l) for i, v, l in cloud(400, 12, 9)]
    assert mined(spark, rows, block=8 * 12 * 16) == brute(rows)


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)]) == []
    assert mined(spark, [(100, [1.0, 2.0], 1)]) == []


def test_members_leave_the_list_early():
    r = np.random.default_rng(0)
    rows = np.floor(256 * (r.normal(size=(6000, 8)) + 0.0))
    asked = []
    members = np.floor(256 * (np.ones((4, 8)) + 0.01 * r.normal(size=(4, 8))))

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if self.ndim == 2 and isinstance(key, np.ndarray) and key.dtype.kind == "i":
                asked.append(len(key))
            return super().__getitem__(key)

    got = hard_negatives.walk(members, lambda m: np.ones(6000, bool), [[(-np.inf, np.inf)]] * 4, rows.view(Counted), np.arange(6000), 5)
    for m, (places,) in enumerate(got):
        scores = rows @ members[m]
        assert places.tolist() == np.lexsort((np.arange(6000), -scores))[:5].tolist()
    assert sum(asked) < 2000
