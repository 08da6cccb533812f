"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, and distinct codes are posted under each segment's value. A code at distance d from a query
agrees with it in some segment up to ``d // segments`` bits. A round looks up, for every open query, all values at
exactly one more bit from its segments, verifies the Hamming distance of what it finds and keeps the best k. A query is
done when its kth distance is covered: nothing closer can be outside of what has been looked up.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.catalog import query
from strandlake.llm.common import keep, table
from strandlake.llm.vector_dedup import hyperplanes, sign_codes, usable
from strandlake.session import ship_package

BITS = 64
K = 10
#: Postings that one group of segment values is meant to hold.
CELL = 16_384


def sign_code(vectors: DataFrame, bits: int = BITS) -> DataFrame:
    """``vec_id, code``: signs of random hyperplanes as one long; rows whose vector is unusable are left out."""
    ship_package(vectors.sparkSession)

    @F.pandas_udf("long")
    def code(embedding: pd.Series) -> pd.Series:
        out = np.zeros(len(embedding), dtype=np.int64)
        sizes = embedding.map(len).to_numpy()
        for d in np.unique(sizes):
            here = np.flatnonzero(sizes == d)
            rows = np.stack(embedding.iloc[here].to_numpy()).astype(np.float64)
            signs = sign_codes(rows, hyperplanes(int(d), bits, 1, seed=223), bits, 1).astype(np.uint64)
            out[here] = (signs << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
        return pd.Series(out)

    return vectors.where(usable()).select("vec_id", code("embedding").alias("code"))


def segments_for(codes: int, bits: int = BITS) -> int:
    """Segments of about log2(codes) bits, so that a value has about one posting."""
    return max(1, min(bits // 4, round(bits / max(4.0, log2(max(codes, 2))))))


def _segments(code, bits, m):
    """Array of ``(seg, value)``; the first segments have the spare bits."""
    out, at = [], 0
    for s in range(m):
        width = bits // m + (s < bits % m)
        out.append(F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1)).alias("value")))
        at += width
    return F.array(*out)


def _cell(cells):
    return F.pmod(F.xxhash64("seg", "value"), F.lit(cells)).cast("int")


def _key_rows(m: int, bits: int, radius: int, cells: int, parts: dict[int, int]):
    """Looked-up segment values of each open query as rows ``(cell, part, query, code, kth, keys)``, a row per cell and part."""

    def masks(width):
        return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], dtype=np.int64)

    widths = [bits // m + (s < bits % m) for s in range(m)]

    def spread(batches):
        patterns = {w: masks(w) for w in set(widths)}
        for rows in batches:
            out = []
            for q, code, kth, probe in zip(rows["query"], rows["query_code"], rows["kth"], rows["probe"]):
                at = 0
                for s, width in enumerate(widths):
                    value = (int(code) & (2**64 - 1)) >> at & ((1 << width) - 1)
                    at += width
                    if s >= probe:
                        continue
                    keys = patterns[width] ^ value
                    cell = _mixed(s, keys) % np.uint64(cells)
                    order = np.argsort(cell, kind="stable")
                    cuts = np.flatnonzero(np.diff(cell[order], prepend=np.uint64(cells))) if len(keys) else []
                    for own in np.split(order, cuts[1:]):
                        if len(own):
                            c = int(cell[own[0]])
                            out += [(c, p, q, code, kth, s, keys[own]) for p in range(parts.get(c, 1))]
            yield pd.DataFrame(out, columns=["cell", "part", "query", "query_code", "kth", "seg", "keys"])

    return spread


def _mixed(seg: int, values: np.ndarray) -> np.ndarray:
    x = values.astype(np.uint64) + np.uint64((seg + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lookup(k: int):
    """Per cell and part: the best ``k`` postings of each query row's keys, no farther than its kth distance so far."""

    def best(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(keys) and len(index):
            index = index.sort_values(["seg", "value"])
            seg, value = index["seg"].to_numpy(), index["value"].to_numpy()
            code, node = index["code"].to_numpy().view(np.uint64), index["node"].to_numpy()
            ranges = {s: (np.searchsorted(seg, s), np.searchsorted(seg, s, side="right")) for s in np.unique(seg)}
            for q, own, kth, s, wanted in zip(keys["query"], keys["query_code"], keys["kth"], keys["seg"], keys["keys"]):
                a, b = ranges.get(s, (0, 0))
                if a == b:
                    continue
                lo = np.searchsorted(value[a:b], wanted, side="left") + a
                n = np.searchsorted(value[a:b], wanted, side="right") + a - lo
                hit = n > 0
                if not hit.any():
                    continue
                lo, n = lo[hit], n[hit]
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                far = np.bitwise_count(code[at] ^ np.uint64(int(own) & (2**64 - 1))).astype(np.int64)
                near = far <= kth
                at, far = at[near], far[near]
                first = np.lexsort((node[at], far))[:k]
                out.append(pd.DataFrame({"query": q, "node": node[at[first]], "distance": far[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "node": [], "distance": []}, dtype="int64")

    return best


def top_k(codes: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS) -> DataFrame:
    """``query_id, rank, vec_id, distance``: the ``k`` nearest rows of ``codes(vec_id, code)`` to each of ``queries``, by
    distance, then vec_id. Exact; queries that are themselves in ``codes`` find themselves.

    With fewer than ``k`` rows all are returned. Rows with a null id or code are left out on both sides; rows that repeat
    an id are rows of their own, ties between them included; no codes or no queries give no rows.
    """
    ship_package(codes.sparkSession)
    rows = keep(codes.where("vec_id is not null and code is not null").select("vec_id", "code"))
    # Equal codes are one posting. Of its rows the k smallest ids are enough, chosen in two steps so that no code is one task.
    nodes = keep(rows.groupBy("code").agg(F.min("vec_id").alias("node")))
    count = nodes.count()
    asked = keep(
        queries.where("vec_id is not null and code is not null").select(F.col("vec_id").alias("query_id"), F.col("code").alias("query_code"))
    )
    open_ = keep(asked.select("query_code").distinct().withColumn("query", F.monotonically_increasing_id()))
    names = open_
    m = segments_for(count, bits)
    widest = -(-bits // m)
    cells = max(1, count * m // CELL)
    posted = nodes.select("node", "code", F.explode(_segments(F.col("code"), bits, m)).alias("p")).select("node", "code", "p.seg", "p.value")
    posted = keep(posted.withColumn("cell", _numbered(cells)("seg", "value")))
    # Cells whose values are common are cut into parts; there is one count per cell.
    sizes = {r["cell"]: -(-r["n"] // (8 * CELL)) for r in posted.groupBy("cell").agg(F.count("*").alias("n")).where(f"n > {8 * CELL}").collect()}
    share = F.coalesce(*[F.when(F.col("cell") == c, F.lit(n)) for c, n in sizes.items()], F.lit(1))
    posted = keep(posted.withColumn("part", F.pmod(F.xxhash64("node"), share).cast("int")))

    state = open_.select("query", "query_code", F.lit(bits).alias("kth"), F.lit(m).alias("probe"))
    found = None
    for radius in range(widest + 1):
        keys = state.mapInPandas(
            _key_rows(m, bits, radius, cells, sizes), "cell int, part int, query long, query_code long, kth int, seg int, keys array<long>"
        )
        new = keys.groupBy("cell", "part").cogroup(posted.groupBy("cell", "part")).applyInPandas(_lookup(k), "query long, node long, distance long")
        merged = new if found is None else found.union(new)
        order = Window.partitionBy("query").orderBy("distance", "node")
        found = keep(
            merged.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")
        )
        kth = found.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        # All segments up to `radius` bits cover distances up to m * (radius + 1) - 1; each further segment at one bit more adds one.
        covered = m * (radius + 1) - 1
        far = F.when(F.col("n") >= min(k, count), F.col("far")).otherwise(bits)
        state = keep(
            names.join(kth, "query", "left").withColumn("kth", far.cast("int"))
            .where(F.col("kth") > covered)
            .select("query", "query_code", "kth", F.least(F.col("kth") - covered, F.lit(m)).cast("int").alias("probe"))
        )
        if state.isEmpty():
            break
    return _members(rows, nodes, found, names, asked, k)


def _numbered(cells):
    @F.pandas_udf("int")
    def cell(seg: pd.Series, value: pd.Series) -> pd.Series:
        out = np.zeros(len(seg), dtype=np.int32)
        for s in seg.unique():
            here = (seg == s).to_numpy()
            out[here] = (_mixed(int(s), value.to_numpy()[here]) % np.uint64(cells)).astype(np.int32)
        return pd.Series(out)

    return cell


def _members(rows, nodes, found, names, asked, k):
    wanted = found.select("node").distinct().join(nodes, "node").select("node", "code")
    spread = rows.join(wanted, "code").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(256)))
    first = Window.partitionBy("node", "salt").orderBy("vec_id")
    then = Window.partitionBy("node").orderBy("vec_id")
    members = (
        spread.withColumn("i", F.row_number().over(first)).where(F.col("i") <= k)
        .withColumn("j", F.row_number().over(then)).where(F.col("j") <= k).select("node", "vec_id", "j")
    )
    near = Window.partitionBy("query").orderBy("distance", "vec_id", "j")
    best = (
        found.join(members, "node").withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
        .select("query", "rank", "vec_id", "distance")
    )
    return asked.join(names, "query_code").join(best, "query").select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance"))


@query("op1_multi_index_topk")
def run(spark, sf_dir):
    codes = keep(sign_code(table(spark, sf_dir, "embeddings")))
    return top_k(codes, codes.where("vec_id % 100 = 0"))
