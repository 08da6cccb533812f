"""Near-duplicate vectors by random-hyperplane signs in several tables, exact cosine verification and components.

A vector's bucket in a table is the sign pattern of its products with the table's random hyperplanes. Vectors are compared
within buckets only, in matrix blocks of bounded size: a bucket of any size is cut into blocks, and every pair of blocks is
one task's work. A pair is counted in the first table whose bucket it shares, so counts need no list of pairs, and a block
gives at most one edge per vector, whatever the number of its links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.catalog import query
from strandlake.llm.common import components, keep, table
from strandlake.session import ship_package

#: A pair at cosine 0.98 shares one table's 16 signs with probability 0.35, and one of 12 tables with 0.994; closer pairs more often.
TABLES, BITS = 12, 16
#: Vectors of a bucket that meet in one matrix, and rows that one group of buckets is meant to hold.
BLOCK, CELL = 1024, 4096


def hyperplanes(dimension: int, tables: int, bits: int, seed: int = 211) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, tables * bits))


def sign_codes(vectors: np.ndarray, planes: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """``(n, tables)`` integers of ``bits`` signs."""
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def usable(vector="embedding"):
    """True where every component is a finite number and not all are zero; null otherwise false."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _codes(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    """``node, label, codes, embedding`` with a code per table."""

    def code(batches):
        for batch in batches:
            vectors = batch.column("embedding")
            sizes = np.asarray(vectors.value_lengths())
            flat = np.asarray(vectors.flatten(), dtype=np.float64)
            ends = np.cumsum(sizes)
            codes = np.zeros((len(sizes), tables), dtype=np.int64)
            for d in np.unique(sizes):
                here = np.flatnonzero(sizes == d)
                rows = flat[(ends[here] - d)[:, None] + np.arange(d)]
                codes[here] = sign_codes(rows, hyperplanes(int(d), tables, bits), tables, bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("node", "label", "copies", "embedding")] + [pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32()))],
                names=["node", "label", "copies", "embedding", "codes"],
            )

    kind = classes.schema["label"].dataType.simpleString()
    vector = classes.schema["embedding"].dataType.simpleString()
    return classes.select("node", "label", "copies", "embedding").mapInArrow(
        code, f"node long, label {kind}, copies long, embedding {vector}, codes array<int>"
    )


def _links(threshold: float):
    """Function over the rows of some blocks: per vector the copies it is linked with and the root of its part of the block."""

    def one(nodes, copies, unit, codes, side, out):
        first, second = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        i, j = np.nonzero(unit[first] @ unit[second].T >= threshold)
        i, j = first[i], second[j]
        # Within one block each pair is taken once; of two blocks every pair is.
        ahead = nodes[i] < nodes[j] if (side == 2).all() else i != j
        i, j = i[ahead], j[ahead]
        if not len(i):
            return
        # The bucket's table is the first column of codes; earlier tables follow.
        new = ~(codes[i] == codes[j]).any(axis=1) if codes.shape[1] else np.ones(len(i), dtype=bool)
        root = np.arange(len(nodes))
        order = np.argsort(nodes)
        rank = np.empty(len(nodes), dtype=np.int64)
        rank[order] = np.arange(len(nodes))
        low = rank.copy()
        while True:
            before = low.copy()
            np.minimum.at(low, i, before[j])
            np.minimum.at(low, j, before[i])
            if (low == before).all():
                break
        root = order[low]
        links = np.bincount(i[new], weights=copies[j[new]], minlength=len(nodes)) + np.bincount(j[new], weights=copies[i[new]], minlength=len(nodes))
        some = np.flatnonzero((root != np.arange(len(nodes))) | (links > 0))
        out.append((nodes[some], links[some].astype(np.int64), nodes[root[some]]))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        rows = rows.sort_values("block", kind="stable")
        blocks = rows["block"].to_numpy()
        borders = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1, append=blocks[-1] + 1))
        for a, b in zip(borders[:-1], borders[1:]):
            if b - a < 2:
                continue
            own = rows.iloc[a:b]
            vectors = np.stack(own["embedding"].to_numpy()).astype(np.float64)
            # Scaled first, so that neither squares nor sums leave the range of a double.
            vectors /= np.abs(vectors).max(axis=1, keepdims=True)
            vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
            earlier = int(own["at"].iloc[0])
            codes = np.stack(own["codes"].to_numpy())[:, :earlier]
            one(own["node"].to_numpy(), own["copies"].to_numpy().astype(float), vectors, codes, own["side"].to_numpy(), out)
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame({"node": parts[0], "links": parts[1], "root": parts[2]})

    return run


def linked(classes: DataFrame, threshold: float, tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """``node, links, root``: per vector and block, links found there and an edge towards the block's component."""
    ship_package(classes.sparkSession)
    coded = keep(_codes(classes, tables, bits))
    spread = coded.withColumn("dimension", F.size("embedding")).select("*", F.posexplode("codes").alias("at", "code")).withColumn(
        "bucket", F.xxhash64("label", "dimension", "at", "code")
    )
    sizes = spread.select("bucket").groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    sizes = keep(sizes)
    cells = max(1, (sizes.agg(F.sum(F.col("n") * F.col("parts")).alias("n")).first().n or 0) // CELL)
    # A row goes to each pair of parts that holds its own: alone (side 2), as first (0) or as second (1).
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.expr(
        "transform(sequence(0, parts - 1), o -> named_struct('lo', least(part, o), 'hi', greatest(part, o), "
        "'side', if(o = part, 2, if(part < o, 0, 1))))"
    )
    dealt = (
        spread.join(sizes.select("bucket", "parts"), "bucket").withColumn("part", part).withColumn("p", F.explode(pairs))
        .withColumn("block", F.xxhash64("bucket", "p.lo", "p.hi"))
        .select(F.pmod("block", F.lit(cells)).alias("cell"), "block", "node", "copies", "embedding", "codes", "at", F.col("p.side").alias("side"))
    )
    return dealt.groupBy("cell").applyInPandas(_links(threshold), "node long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors are compared if their labels are equal and not null. ``n_links`` counts other vectors linked directly, equal
    ones included; ``component_id`` is the smallest vec_id reachable. A vector that is null, empty, zero or holds a
    null or non-finite component links with nothing, as do vectors of different length. A null vec_id counts as a
    vector but never names a component, unless it is alone (then null). Rows that repeat an id are vectors of their own.
    An empty table gives no rows. Columns other than vec_id, label and embedding are not read.
    """
    rows = keep(
        vectors.select("vec_id", "label", "embedding", (usable() & F.col("label").isNotNull()).alias("good"))
        .withColumn("mark", F.when(F.col("good"), F.xxhash64("label", "embedding"))).withColumn("uid", F.monotonically_increasing_id())
    )
    # Equal vectors are one node. The hash only names the group: the vector itself is part of the key.
    nodes = keep(
        rows.where("good").groupBy("mark", "label", "embedding")
        .agg(F.min("uid").alias("node"), F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    )
    found = keep(linked(nodes, threshold, tables, bits))
    parts = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    facts = (
        named.join(least, "component").join(links, "node", "left")
        .select("mark", "label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    )
    good = rows.where("good").select("vec_id", "mark", "label", "embedding").join(facts, ["mark", "label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op9_hyperplane_links")
def run(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
