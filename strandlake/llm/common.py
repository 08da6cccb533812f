"""Small Spark helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ordered slices into which a running total is cut; each is one window group.
SLICES = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; only a local session may go without."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there: the lineage ends and ids stay as they are."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """As ``keep``, but rows of one value of ``column`` stand in one bucket, so that grouping by it moves nothing.

    Every task writes a file for each value it has: meant for rows that are large and whose values don't repeat in tasks.
    """
    spark = df.sparkSession
    name = f"kept_{uuid.uuid4().hex}"
    rows = df.write.option("compression", "uncompressed").option("path", f"{shared_folder(spark)}/{name}").bucketBy(buckets, column)
    rows.format("parquet").saveAsTable(name)
    return spark.table(name)


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text; nulls have a key of their own."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def running_total(df: DataFrame, value: str, group: list[str], slice_: str, order: list, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group before this one, in the order of ``slice_``, then ``order``.

    ``slice_`` must agree with the order. A group of any size is summed in as many tasks as it has slices: each slice has
    its own window, and the totals of the slices before it are one row a slice. Columns of ``group`` must not be null.
    """
    keys = [*group, slice_]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_slice_total"))
    earlier = Window.partitionBy(*group).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_slice_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets, keys)
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_offset")
    )


def global_rank(df: DataFrame, order: list, out: str) -> DataFrame:
    """Add ``out``: the place of a row, from 0, in the order of the whole table; rows should differ in ``order``.

    Range partitions are ranked on their own and moved by the count of the partitions before, so no task sees all rows.
    """
    dealt = keep(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(offsets, "_part").withColumn(out, F.col("_offset") + place - 1).drop("_part", "_offset")


def _two_rows(first: tuple[str, str], second: tuple[str, str], names: tuple[str, str]) -> Column:
    """Array of two structs with fields ``names``, of the columns ``first`` and of the columns ``second``."""
    return F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(row, names)]) for row in (first, second)])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(src, dst)`` of longs: ``(node, component)``, component being the smallest node.

    Alternates two contractions until nothing changes: every node hands its larger neighbours to its smallest one, then
    its smaller ones. A star is done in one round, a path of n nodes in about log n. Minima are taken before the
    shuffle, so a hub costs no more than its edges, and each round is a table in the shared folder.
    """
    pairs = keep(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .distinct()
    )
    before = None
    while True:
        # Two rows of each pair by one array: a union would plan the whole round once for each of its sides.
        both = pairs.select(F.inline(_two_rows(("hi", "lo"), ("lo", "hi"), ("node", "other"))))
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("m", "node").alias("m"))
        large = (
            both.where("other > node").join(least, "node")
            .select(F.col("other").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi")
        pairs = keep(small.select(F.inline(_two_rows(("lo", "m"), ("hi", "m"), ("hi", "lo")))).where("hi <> lo").distinct())
        # Both steps keep the components; a fixed point is a set of stars, told by its size and sums.
        now = pairs.agg(
            F.count("*"), F.sum(F.col("hi").cast("decimal(38,0)")), F.sum(F.col("lo").cast("decimal(38,0)")),
            F.count_if(F.col("hi").isNull()),
        ).first()
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
