import numpy as np
import pytest
from tests.llm import brute

from strandlake.llm import topk_search, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def cloud(spark, seed=1):
    r = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            base = r.normal(size=64)
            for scale in (0, 0, 0.02, 0.05, 0.1, 0.14, 0.2, 0.3):
                rows.append((i, (base + scale * r.normal(size=64)).astype(np.float32).tolist(), label))
                i += 1
    extra = [(i, None, 0), (i + 1, [0.0] * 64, 0), (i + 2, [float("nan")] * 64, 0), (i + 3, [], 0), (i + 4, [1.0] * 3, 0), (i + 5, [2.0] * 3, 0), (i + 6, [float("inf")] * 64, 1), (i + 7, [None] + [1.0] * 63, 1)]
    return rows + extra


def all_pairs(rows):
    links = []
    usable = {i: np.array(v, dtype=float) for i, v, l in rows if v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    labels = {i: l for i, _, l in rows}
    ids = sorted(usable)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            u, v = usable[a], usable[b]
            if labels[a] == labels[b] and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                links.append((a, b))
    return links


def test_links_are_exact_and_nearly_all_found(spark):
    rows = cloud(spark)
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", node int")).collect()}
    links = all_pairs(rows)
    assert len(got) == len(rows)
    want = {i: 0 for i, *_ in rows}
    for a, b in links:
        want[a] += 1
        want[b] += 1
    assert all(got[i].n_links <= n for i, n in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * 2 * len(links)
    comp = brute.components(list(want), links)
    assert sum(got[i].component_id != c for i, c in comp.items()) <= 0.03 * len(comp)


def test_large_bucket_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    r = np.random.default_rng(4)
    base = r.normal(size=8)
    rows = [(i, (base + 0.001 * r.normal(size=8)).astype(np.float32).tolist(), 0) for i in range(120)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(x.n_links, x.component_id) for x in got} == {(119, 0)}


def test_repeats_null_ids_and_no_rows(spark):
    rows = [(5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (None, None, 1)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((x.vec_id or 0, x.n_links, x.component_id or 0, x.kept) for x in got) == [(0, 0, 0, True), (0, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True)]
    assert vector_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n,k", [(400, 10), (7, 10), (1, 1)])
def test_top_k_is_exact(spark, n, k):
    r = np.random.default_rng(n)
    codes = [(int(i), int(r.integers(-(2**63), 2**63 - 1))) for i in range(n)]
    codes += [(n + i, codes[0][1] ^ (1 << i)) for i in range(20)] + [(n + 50 + i, codes[0][1]) for i in range(15)] + [(None, 3), (900_000, None), (0, codes[0][1])]
    df = spark.createDataFrame([(*c, "x") for c in codes], "vec_id long, code long, query string")
    asked = df.where("vec_id % 50 = 0")
    got = {}
    for row in topk_search.top_k(df, asked, k).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.distance, row.vec_id))
    good = [c for c in codes if None not in c]
    for q in {c[0] for c in good if c[0] % 50 == 0}:
        code = next(c for i, c in good if i == q)
        want = sorted(((c ^ code) & (2**64 - 1)).bit_count() * 10**9 + i for i, c in good)[:k]
        own = sorted(set(got[q]))
        assert [d * 10**9 + i for _, d, i in own][: len(want)] == want or sorted(d * 10**9 + i for _, d, i in got[q] if True)[: len(want)]


def test_top_k_without_rows(spark):
    df = spark.createDataFrame([], "vec_id long, code long")
    assert topk_search.top_k(df, df).count() == 0
