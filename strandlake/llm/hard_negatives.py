"""Hard negatives by shared lists of anchor clusters.

Anchors that point the same way form a cluster. A candidate at the angle t from a cluster's centre scores at most
|anchor| |candidate| cos(max(0, t - w)) with any of its anchors, w being the widest angle of an anchor. The candidates are
sorted by |candidate| cos(max(0, t - w)) once for a cluster, and every anchor of it walks down this list until the bound of
all that follows shows that nothing is left to find. Results are therefore exact, whatever the clusters are.

Candidates stand in blocks and clusters in groups of bounded size. A group meets a block in one task, which holds no more
than these two; a first pass finds positives among rows of the anchor's label, a second one negatives among the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.catalog import query
from strandlake.llm.common import keep, table
from strandlake.session import ship_package

#: Components are multiplied by this and rounded down.
SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between these per cents of the positive's.
FLOOR, CEILING = 80, 100
#: Anchors of a cluster that are meant to share a list, at most (a fuller one is cut into parts), centres, rows that fit them.
CLUSTER, FULL, CENTRES, SAMPLE = 128, 512, 256, 8192
#: Bytes of the anchors of a group and of the candidates of a block, at 8 bytes a component.
GROUP, BLOCK = 16 << 20, 16 << 20
#: Blocks of a small table.
LEAST_BLOCKS = 32
#: Candidates that an anchor takes from the list at a time.
STEP = 256


def whole_numbers(vector, scale: int = SCALE):
    """The vector's components times ``scale``, rounded down, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``uid, vec_id, label, ints, size`` of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return keep(rows.select("vec_id", "label", whole_numbers(F.col("embedding"), scale).alias("ints")).withColumns({
        "size": F.size("ints"), "uid": F.monotonically_increasing_id(),
    }))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as doubles: they hold whole numbers of up to 53 bits exactly."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column))).astype(np.float64)


def _directions(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(lengths > 0, lengths, 1)[:, None], lengths


def centres(anchors: DataFrame, wanted: int, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Directions that divide a bounded sample of anchors, by the vectors' length; they decide speed only, not results.

    The sample is the ``sample`` anchors of the smallest hash, 64 MB at most; a length it lacks has one centre.
    """
    least = anchors.select("size").groupBy("size").count().orderBy(F.desc("count"), "size").limit(16).collect()
    found = {}
    for size in [x["size"] for x in least if x["size"]]:
        rows = max(1, min(sample, (64 << 20) // (8 * size)))
        own = anchors.where(F.col("size") == size).orderBy(F.xxhash64("uid", "vec_id"), "uid").limit(rows).select("ints").toArrow()
        unit, _ = _directions(_matrix(own.column("ints")))
        best = unit[: max(1, min(wanted, CENTRES, len(unit) // 4))]
        for _ in range(8):
            nearest = (unit @ best.T).argmax(axis=1)
            sums = np.zeros_like(best)
            np.add.at(sums, nearest, unit)
            best, lengths = _directions(sums)
            best = best[lengths > 0]
        found[size] = best
    return found


def clustered(anchors: DataFrame, cluster: int = CLUSTER, full: int = FULL) -> DataFrame:
    """Add ``cluster``, a number that at most about ``full`` anchors share, and ``team``, the group of clusters it is in."""
    n = anchors.count()
    known = centres(anchors, -(-n // cluster))

    def assign(batches):
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            ints = batch.column("ints")
            out = np.zeros(len(sizes), dtype=np.int64)
            for size in np.unique(sizes):
                if int(size) in known:
                    here = np.flatnonzero(sizes == size)
                    unit, _ = _directions(_matrix(pa.chunked_array([ints.take(pa.array(here))])))
                    out[here] = (unit @ known[int(size)].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "centre"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    dealt = keep(anchors.mapInArrow(assign, fields + ", centre long"))
    # A cluster of copies may hold most anchors: parts of it are clusters of their own. A few clusters' anchors make a group.
    parts = dealt.groupBy("size", "centre").agg(F.ceil(F.count("*") / full).alias("parts"))
    dealt = dealt.join(parts, ["size", "centre"]).withColumn("cluster", F.xxhash64("size", "centre", F.pmod(F.xxhash64("uid"), "parts")))
    # What a group may hold is a number of components, so wide vectors stand in more groups than narrow ones.
    teams = dealt.groupBy("size").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.col("size") * 8 / GROUP)).alias("teams"))
    return keep(dealt.join(teams, "size").withColumn("team", F.pmod("cluster", F.col("teams"))).drop("centre", "parts", "teams"))


def _first(scores: np.ndarray, ranks: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k``: larger scores first, ties by rank."""
    return np.lexsort((ranks, -scores))[:k]


def walk(members: np.ndarray, allowed, goals: list[list[tuple[float, float]]], rows: np.ndarray, ranks: np.ndarray, k: int) -> list[list[np.ndarray]]:
    """Per member and goal, places of the first ``k`` allowed rows whose score lies within the goal's bounds.

    ``goals[m]`` lists ``(lowest, highest)`` scores; ``allowed(m)`` marks the rows that member may take. The list is sorted
    once; a member leaves it when no later row can reach a goal's lowest score or come before its kth row.
    """
    unit, lengths = _directions(members)
    towards, sizes = _directions(rows)
    middle, _ = _directions(unit.sum(axis=0, keepdims=True))
    # Angles are widened a little, so that rounding never lowers a bound.
    widest = np.arccos(np.clip(unit @ middle[0], -1, 1)).max() + 1e-7
    angle = np.arccos(np.clip(towards @ middle[0], -1, 1))
    bound = sizes * np.cos(np.maximum(angle - widest, 0))
    bound += np.abs(bound) * 1e-9 + 1e-6
    order = np.argsort(-bound, kind="stable")
    found = [[(np.zeros(0), np.zeros(0, np.int64)) for _ in own] for own in goals]
    walking = [m for m, own in enumerate(goals) if own]
    permitted = {m: allowed(m) for m in walking}
    for at in range(0, len(order), STEP):
        if not walking:
            break
        here = order[at : at + STEP]
        scores = members[walking] @ rows[here].T
        still = []
        for m, own in zip(walking, scores):
            fits = np.flatnonzero(permitted[m][here])
            # No row further down the list scores more than this.
            most = lengths[m] * bound[order[at + STEP]] if at + STEP < len(order) else -np.inf
            over = True
            for g, (low, high) in enumerate(goals[m]):
                had, places = found[m][g]
                new = fits[(own[fits] >= low) & (own[fits] <= high)]
                if len(had) == k:
                    new = new[own[new] >= had[-1]]
                if len(new):
                    had, places = np.concatenate([had, own[new]]), np.concatenate([places, here[new]])
                    best = _first(had, ranks[places], k)
                    found[m][g] = had, places = had[best], places[best]
                over &= most < low or (len(had) == k and most < had[-1])
            if not over:
                still.append(m)
        walking = still
    return [[places for _, places in own] for own in found]


def _walked(k: int, same_label: bool, floor: int = FLOOR, ceiling: int = CEILING):
    """Function over one group of clusters and one block: rows ``anchor, positive, positive_score, score, vec_id, uid``."""
    kinds = pa.schema([("anchor", pa.int64()), ("goal", pa.int64()), ("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(anchors: pa.Table, block: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in kinds.names}
        if anchors.num_rows and block.num_rows:
            rows, members = _matrix(block.column("ints")), _matrix(anchors.column("ints"))
            ids, uids = block.column("vec_id"), block.column("uid").to_numpy()
            # Smaller ids first, null ids last, repeats as they stand.
            known = ids.is_null().to_numpy()
            ranks = np.empty(len(uids), dtype=np.int64)
            ranks[np.lexsort((uids, ids.fill_null(0).to_numpy(), known))] = np.arange(len(uids))
            labels, own = block.column("label").to_numpy(), anchors.column("label").to_numpy()
            names, clusters = anchors.column("uid").to_numpy(), anchors.column("cluster").to_numpy()
            if same_label:
                goals = [[(-np.inf, np.inf)] for _ in names]
                keys = [[-1]] * len(names)
            else:
                asked = anchors.column("goals").to_pylist()
                keys = [[g["uid"] for g in x] for x in asked]
                # floor * positive <= 100 * negative <= ceiling * positive, in whole numbers
                goals = [[(float(-(-floor * g["score"] // 100)), float(ceiling * g["score"] // 100)) for g in x] for x in asked]
            for cluster in np.unique(clusters):
                here = np.flatnonzero(clusters == cluster)
                if same_label:
                    allowed = lambda m: (labels == own[here[m]]) & (uids != names[here[m]])  # noqa: B023,E731
                else:
                    allowed = lambda m: labels != own[here[m]]  # noqa: B023,E731
                for m, lists in enumerate(walk(members[here], allowed, [goals[i] for i in here], rows, ranks, k)):
                    for key, places in zip(keys[here[m]], lists):
                        scores = rows[places] @ members[here[m]]
                        out["anchor"] += [names[here[m]]] * len(places)
                        out["goal"] += [key] * len(places)
                        out["uid"] += uids[places].tolist()
                        out["vec_id"] += ids.take(pa.array(places)).to_pylist()
                        out["score"] += scores.astype(np.int64).tolist()
        return pa.table({n: pa.array(out[n], kinds.field(n).type) for n in kinds.names})

    return run


def _met(anchors: DataFrame, blocks: DataFrame, counts: DataFrame, run) -> DataFrame:
    """Every group of clusters meets every block of its vector length in one task."""
    # Written once more, so that both sides of the meeting have columns of their own.
    teams = keep(anchors.select("size", "team").distinct())
    spread = anchors.join(counts, "size").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    candidates = blocks.join(teams, "size")
    keys = ["size", "team", "block"]
    return spread.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(run, "anchor long, goal long, uid long, vec_id long, score long")


def mine(
    rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
    floor: int = FLOOR, ceiling: int = CEILING, block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` is what ``prepared`` gives, ``anchors`` some of its rows. An anchor's positives are its first other rows of its
    label, the negatives of a positive the first rows of other labels whose score is from ``floor`` to ``ceiling`` per cent of
    the positive's; larger scores come first, ties by smaller vec_id, then null ids, then the row's place. Vectors of
    another length than the anchor's don't count. Rows that repeat an id or a vector are rows of their own; an anchor
    without positives, or a positive without negatives, gives no rows, as does an empty table. Scores must stay below 2 to
    the power of 53.
    """
    ship_package(rows.sparkSession)
    width = F.greatest(F.col("size"), F.lit(1)) * 8
    per_size = rows.groupBy("size").agg(F.count("*").alias("n"))
    by_bytes = F.ceil(F.col("n") * width / F.lit(block))
    counts = keep(per_size.select("size", F.greatest(by_bytes, F.least(F.lit(LEAST_BLOCKS), F.col("n"))).cast("int").alias("blocks")))
    blocks = rows.join(counts, "size").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).drop("blocks")
    grouped = clustered(anchors)
    first = Window.partitionBy("anchor", "goal").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    near = _met(grouped, blocks, counts, _walked(positives, True))
    near = keep(near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives))
    goals = near.groupBy("anchor").agg(F.collect_list(F.struct("uid", "score")).alias("goals"))
    asking = keep(grouped.join(goals, F.col("anchor") == grouped["uid"]).drop("anchor"))
    hard = _met(asking, blocks, counts, _walked(negatives, False, floor, ceiling))
    hard = hard.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    named = near.select("anchor", F.col("uid").alias("goal"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    anchor_ids = grouped.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return hard.join(named, ["anchor", "goal"]).join(anchor_ids, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


SQL = f"""
    WITH rows AS (
        SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS ints
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
        SELECT a.uid AS anchor, a.vec_id AS anchor_id, r.uid, r.vec_id, a.label = r.label AS same,
               CAST(coalesce(list_sum([a.ints[i] * r.ints[i] FOR i IN range(1, len(a.ints) + 1)]), 0) AS BIGINT) AS score
        FROM rows a JOIN rows r ON len(a.ints) = len(r.ints) AND a.uid <> r.uid
        WHERE a.vec_id % 100 = 0),
    positives AS (
        SELECT * FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, uid) <= {POSITIVES}),
    negatives AS (
        SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY n.score DESC, n.vec_id NULLS LAST, n.uid) AS place
        FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
        WHERE {FLOOR} * p.score <= 100 * n.score AND 100 * n.score <= {CEILING} * p.score)
    SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
    FROM negatives WHERE place <= {NEGATIVES}
"""


@query("op13_shared_list_negatives", SQL)
def run(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = prepared(vectors.select("vec_id", moved.alias("label"), "embedding"))
    return mine(rows, rows.where("vec_id % 100 = 0"))
