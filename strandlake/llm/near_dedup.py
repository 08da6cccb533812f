"""Near-duplicate groups by an inverted join on MinHash signature coordinates.

Every distinct shingle set is posted under each (coordinate, value) of its signature. Pairs that agree in at least
``agree`` of ``coordinates`` values are compared on their full sets. Two sets that agree so often must meet within their
``coordinates - agree + 1`` rarest postings (prefix), and a set with fewer than ``agree`` shared postings can be skipped.

Long postings don't become all pairs. A round takes one hub of each posting and compares the others with it; links found
are contracted, and only postings that still hold several components go on. The sets that are left in those are joined
across components on the rarest of their own shingles, as many as a pair above the threshold can't do without, so no link
that matters to a component is lost, and texts that are alike but not enough meet only if they share what is rare in them.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import shingles
from strandlake.llm.catalog import query
from strandlake.llm.common import components, keep, row_key, table
from strandlake.session import ship_package

WIDTH = 5
COORDINATES = 64
#: A pair at the threshold agrees in fewer coordinates than are asked for with at most this probability.
MISS = 1e-6
#: Rounds against one hub a posting before the rest is joined on its own shingles.
HUB_ROUNDS = 2
#: Members of a hub that are compared in one group.
GROUP = 512


def least_agreeing(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most coordinates that can be asked for so that a pair at ``percent`` is missed with probability ``miss`` at most."""
    p, below, agree = percent / 100, 0.0, 0
    while agree < coordinates:
        below += comb(coordinates, agree) * p**agree * (1 - p) ** (coordinates - agree)
        if below > miss:
            break
        agree += 1
    return max(agree, 1)


def signed(docs: DataFrame, width: int = WIDTH, coordinates: int = COORDINATES) -> DataFrame:
    """``doc_id, text_key, n_shingles, k1, k2, signature``; equal sets share the keys, an empty set has a null signature."""
    ship_package(docs.sparkSession)
    factors, shifts = shingles.maps(coordinates)

    def sign(batches):
        for batch in batches:
            sizes, k1, k2, signatures = [], [], [], []
            for hashes in shingles.shingle_sets(batch.column("text").to_pylist(), width):
                one, two = shingles.set_key(hashes)
                sizes.append(len(hashes))
                k1.append(one)
                k2.append(two)
                signatures.append(shingles.signature(hashes, factors, shifts).view(np.int32) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()),
                 pa.array(k2, pa.int64()), pa.array(signatures, pa.list_(pa.int32()))],
                names=["doc_id", "text_key", "n_shingles", "k1", "k2", "signature"],
            )

    read = docs.select("doc_id", row_key(F.col("text")).alias("text_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(sign, f"doc_id {kind}, text_key long, n_shingles long, k1 long, k2 long, signature array<int>")


def prefix_postings(sets: DataFrame, coordinates: int, agree: int) -> DataFrame:
    """``(posting, node, weight)``: the rarest shared postings of each set that could agree with another one often enough.

    ``weight`` sums how many sets share the set's postings: in a group of near copies it is largest at their original.
    """
    posted = sets.select("node", F.posexplode("signature").alias("i", "v")).select(
        "node", (F.col("i").cast("long") * F.lit(1 << 32) + F.col("v").cast("long") + F.lit(1 << 31)).alias("posting")
    )
    # Counted before the shuffle; postings of one set match nothing and drop out here.
    shared = posted.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1")
    by_set = posted.join(shared, "posting").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "posting"))).alias("p"))
    rare = F.slice("p", F.lit(1), F.size("p") - (agree - 1))
    weight = F.expr("aggregate(p, 0L, (s, x) -> s + x.n)").alias("weight")
    return by_set.where(F.size("p") >= agree).select("node", weight, F.explode(rare).alias("p")).select("p.posting", "node", "weight")


def _agreeing(pairs: DataFrame, sets: DataFrame, agree: int) -> DataFrame:
    """Pairs ``(a, b)`` whose signatures agree in at least ``agree`` places."""
    left = sets.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    same = "size(filter(zip_with(sa, sb, (x, y) -> x = y), z -> z))"
    return pairs.join(left, "a").join(right, "b").where(F.expr(f"{same} >= {agree}")).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose full shingle sets meet in at least ``percent`` per cent of their union.

    The members of a hub ``a`` are dealt to groups of bounded size, to each of which the hub's own text goes.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(counts, "a").select(
        "a", "b", F.pmod(F.hash("b"), F.ceil(F.col("n") / GROUP).cast("int")).alias("g")
    )
    wanted = dealt.union(dealt.select("a", F.col("a").alias("b"), "g").distinct())
    grouped = wanted.join(texts.withColumnRenamed("node", "b"), "b")

    def compare(key, rows: pd.DataFrame) -> pd.DataFrame:
        sets = list(shingles.shingle_sets(rows["text"].tolist(), width))
        nodes = rows["b"].tolist()
        hub = sets[nodes.index(key[0])]
        good = []
        for node, own in zip(nodes, sets):
            if node == key[0]:
                continue
            at = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
            both = int((hub[at] == own).sum())
            if 100 * both >= percent * (len(hub) + len(own) - both):
                good.append(node)
        return pd.DataFrame({"a": [key[0]] * len(good), "b": good}, dtype="int64")

    return grouped.groupBy("a", "g").applyInPandas(compare, "a long, b long")


def _bits_apart(bits: str, other: str) -> str:
    """SQL: in how many places two bitmaps differ."""
    return " + ".join(f"bit_count({bits}[{i}] ^ {other}[{i}])" for i in range(shingles.WORDS))


def _rest_pairs(rest: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of ``rest(node, component)`` from different components that may reach ``percent``: an exact filter.

    Shingles are ordered by how many sets of the rest have them. A set x that shares enough with a set y no larger meets
    it within the first ``|x| - t|x| + 1`` of its own and the first ``|y| - 2t/(1+t)|y| + 1`` of y's shingles, at places
    behind which enough is left of both. Their parity bitmaps differ in no more places than the sets in shingles, which
    tells most sets that are alike but not enough before they become rows.
    """

    def spread(batches):
        for batch in batches:
            sets = list(shingles.shingle_sets(batch.column("text").to_pylist(), width))
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
            bits = [shingles.parity_bits(s).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("component"), pa.array(sizes), pa.ListArray.from_arrays(ends, flat),
                 pa.array(bits, pa.list_(pa.int64()))],
                names=["node", "component", "size", "shingles", "bits"],
            )

    sets = keep(
        texts.join(rest, "node").select("node", "component", "text")
        .mapInArrow(spread, "node long, component long, size long, shingles array<long>, bits array<long>")
    )
    rows = sets.select("node", "component", "size", F.explode("shingles").alias("shingle"))
    shared = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    # Shingles of one set only come first in its order, so only their number matters.
    by_set = (
        rows.join(shared, "shingle").groupBy("node", "component", "size")
        .agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("s"))
        .withColumn("own", F.col("size") - F.size("s"))
        .join(sets.select("node", "bits"), "node")
    )
    probe = F.expr(f"size - cast(ceil({percent} * size / 100) as bigint) + 1 - own")
    index = F.expr(f"size - cast(ceil(2 * {percent} * size / (100 + {percent}) - 1e-9) as bigint) + 1 - own")
    place = by_set.select(
        "node", "component", "size", "bits", "own", index.alias("index"),
        F.posexplode(F.slice("s", F.lit(1), F.greatest(probe, F.lit(0)).cast("int"))).alias("i", "s"),
    )
    x = keep(place.select("node", "component", "size", "bits", "i", (F.col("size") - F.col("own") - F.col("i")).alias("left"), "s.shingle", (F.col("i") < F.col("index")).alias("indexed")))
    y = x.where("indexed").select(*[F.col(c).alias(f"y_{c}") for c in ("node", "component", "size", "bits", "i", "left")], "shingle")
    near = f"""component != y_component and y_size <= size and y_size * 100 >= size * {percent}
               and (least(i, y_i) + least(left, y_left)) * (100 + {percent}) >= {percent} * (size + y_size)
               and (size + y_size - ({_bits_apart("bits", "y_bits")})) * (100 + {percent}) >= 2 * {percent} * (size + y_size)"""
    return x.join(y, "shingle").where(near).select(F.col("node").alias("a"), F.col("y_node").alias("b"))


def _labelled(postings: DataFrame, found: DataFrame) -> DataFrame:
    """Postings with the component of each node so far, those that hold one component only left out."""
    now = postings.join(found, "node", "left").select("posting", "node", "weight", F.coalesce("component", "node").alias("component"))
    open_ = now.groupBy("posting").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("posting")
    return now.join(open_, "posting")


def links(docs: DataFrame, sets: DataFrame, members: DataFrame, width: int, percent: int, coordinates: int, agree: int) -> DataFrame:
    """``(node, component)`` of the sets that are linked with another one.

    ``sets(node, signature)`` holds one row per distinct set, ``members(node, doc_id, text_key)`` one document of each.
    """
    postings = keep(prefix_postings(sets, coordinates, agree))
    able = postings.select("node").distinct()
    marked = keep(sets.join(able, "node", "left_semi"))
    chosen = members.join(able, "node", "left_semi").select("node", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    # Each of the chosen documents is read once; its text stays in the shared folder for all rounds.
    texts = keep(
        docs.select("doc_id", "text").join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (row_key(F.col("text")) == F.col("_key")))
        .groupBy("node").agg(F.first("text").alias("text"))
    )
    edges = None
    tried = None
    found = None
    for number in range(HUB_ROUNDS + 1):
        last = number == HUB_ROUNDS
        rows = postings.withColumn("component", F.col("node")) if found is None else keep(_labelled(postings, found))
        if found is not None and rows.isEmpty():
            break
        if last:
            pairs = _rest_pairs(rows.select("node", "component").distinct(), texts, width, percent)
        else:
            # The hub is the heaviest set; once it has its links, the heaviest of those outside its component.
            heaviest = F.max_by(F.struct("node", "component"), F.struct("weight", (-F.col("node")).alias("m"))).alias("hub")
            for _ in range(number):
                rows = rows.join(rows.groupBy("posting").agg(heaviest), "posting").where("component <> hub.component").drop("hub")
            hubs = rows.groupBy("posting").agg(heaviest)
            pairs = rows.join(hubs, "posting").where("component <> hub.component").select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = keep(pairs)
        tried = pairs if tried is None else tried.union(pairs)
        near = pairs if last else _agreeing(pairs, marked, agree)
        new = keep(_confirmed(near, texts, width, percent))
        edges = new if edges is None else edges.union(new)
        found = components(edges.toDF("src", "dst"))
    return found


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = 85, coordinates: int = COORDINATES, agree: int | None = None
) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_shingles, component_id, kept``.

    ``component_id`` is the smallest doc_id reachable by links, ``kept`` says whether it is the document's own. A null or
    blank text has an empty set and is linked with nothing; a document with a null id takes the smallest id of its
    group, null if there is none, and is not kept unless it stands alone; rows that repeat an id are one document each
    with the same decision; an empty table gives no rows. Columns other than doc_id and text are not read.
    """
    agree = least_agreeing(percent, coordinates) if agree is None else agree
    rows = keep(signed(docs, width, coordinates).withColumn("uid", F.monotonically_increasing_id()))
    # Equal sets are one node: copies are never paired with each other.
    nodes = keep(
        rows.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles")
        .agg(F.min("uid").alias("node"), F.min("doc_id").alias("least_id"), F.min_by(F.struct("doc_id", "text_key", "signature"), "uid").alias("first"))
    )
    found = links(
        docs, nodes.select("node", "first.signature"), nodes.select("node", "first.doc_id", "first.text_key"),
        width, percent, coordinates, agree,
    )
    grouped = nodes.select("k1", "k2", "n_shingles", "node", "least_id").join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    least = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = grouped.join(least, "component").select("k1", "k2", F.col("n_shingles").alias("_n"), "component_id")
    out = rows.where("n_shingles > 0").join(named.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), F.expr("k1 = _k1 and k2 = _k2 and n_shingles = _n"))
    alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "text_key", "n_shingles", "component_id"]
    return out.select(*columns).union(alone.select(*columns)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without those that are near copies of a document with a smaller id."""
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (row_key(docs["text"]) == gone["_key"]), "left_anti")


SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM words),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, hash(g) AS g FROM grams),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
least_ AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, least(coalesce(l.b, w.doc_id), w.doc_id) AS component_id, least(coalesce(l.b, w.doc_id), w.doc_id) = w.doc_id AS kept
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_ l ON l.a = w.doc_id"""


@query("op7_coordinate_join", SQL)
def run(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")
