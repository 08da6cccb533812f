"""Packing of documents into sequences by cutting stock.

A document is cut into full sequences and a rest. The histogram of rests, in classes of ``grain`` tokens, goes into a
linear program over patterns (what a sequence may hold), whose columns a knapsack prices; rounded patterns give places for
every piece of a class, and pieces take them by rank.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm import cutting
from strandlake.llm.catalog import query
from strandlake.llm.common import keep, row_key, running_total, table
from strandlake.llm.tokens import WordEncoder, default_path
from strandlake.session import ship_package

LENGTH = 2048
#: Tokens per length class: 256 classes at a length of 2,048. A piece is placed as if it had its class's full length.
GRAIN = 8
#: The id that ends each document.
END = 1
#: Slices of a class in which pieces are ranked, so that a length that most documents share is many tasks.
RANK_SLICES = 1024
#: Characters of text that are encoded in one go.
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """``doc_id, text_key, start, length, ids_crc32, doc_tokens`` of each piece, with ``with_ids`` also its ``ids``.

    A document's ids are those of the whole text and ``end_id``; every ``length`` ids make a piece, the rest is the last one.
    """
    ship_package(docs.sparkSession)
    path = tokenizer or default_path()
    last = np.array([end_id], dtype="<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        encoder = _encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and size < CHUNK:
                    size += len(texts[to])
                    to += 1
                rows, source = [], []
                for i, raw in enumerate(encoder.encode_batch(texts[at:to]), at):
                    raw += last
                    n = len(raw) // 4
                    for start in range(0, n, length):
                        own = raw[4 * start : 4 * (start + length)]
                        source.append(i)
                        rows.append((start, len(own) // 4, zlib.crc32(own), n, own))
                take = pa.array(source, pa.int64())
                columns = [pa.array([r[j] for r in rows], pa.int64()) for j in range(4)]
                names = ["doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(r[4], dtype="<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("text_key").take(take), *columns], names=names)
                at = to

    ids = ", ids array<int>" if with_ids else ""
    return docs.select("doc_id", row_key(F.col("text")).alias("text_key"), "text").mapInArrow(
        cut, f"doc_id {kind}, text_key long, start long, length long, ids_crc32 long, doc_tokens long{ids}"
    )


def _places(plan: list[tuple[np.ndarray, int]]) -> dict[int, dict[str, np.ndarray]]:
    """For each class: first rank of each pattern that holds it, items per sequence, first sequence; patterns in order."""
    places: dict[int, list] = {}
    sequence = 0
    for pattern, times in plan:
        for c in np.flatnonzero(pattern):
            own = places.setdefault(int(c) + 1, [])
            first = own[-1][0] + own[-1][3] if own else 0
            own.append((first, int(pattern[c]), sequence, int(pattern[c]) * times))
        sequence += times
    return {c: {k: np.array([r[i] for r in rows]) for i, k in enumerate(("rank", "each", "sequence"))} for c, rows in places.items()}


def place(cut: DataFrame, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """``cut`` (pieces that don't change when read again) with ``sequence_id`` and ``offset``.

    Only the histogram (``length / grain`` rows) comes to the driver. Ranks within a class are running totals over slices.
    """
    classes = -(-length // grain)
    cut = cut.withColumn("class", F.ceil(F.col("length") / grain).cast("int"))
    demand = np.zeros(classes, dtype=np.int64)
    for row in cut.groupBy("class").agg(F.count("*").alias("n")).collect():
        demand[row["class"] - 1] = row["n"]
    places = _places(cutting.rounded(demand, classes))

    ranked = cut.withColumn("mark", F.xxhash64("doc_id", "text_key", "start", "piece_id"))
    ranked = ranked.withColumn("slice", F.pmod("mark", F.lit(RANK_SLICES)).cast("int")).withColumn("one", F.lit(1))
    ranked = running_total(ranked, "one", ["class"], "slice", ["mark", "piece_id"], "rank")

    @F.pandas_udf("struct<sequence_id: long, slot: long>")
    def seat(kind: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
        kinds, ranks = kind.to_numpy(), rank.to_numpy()
        for c in np.unique(kinds):
            here = kinds == c
            p = places[int(c)]
            at = np.searchsorted(p["rank"], ranks[here], side="right") - 1
            inside = ranks[here] - p["rank"][at]
            sequence[here] = p["sequence"][at] + inside // p["each"][at]
            slot[here] = inside % p["each"][at]
        return pd.DataFrame({"sequence_id": sequence, "slot": slot})

    seated = ranked.withColumn("seat", seat("class", "rank")).withColumn("sequence_id", F.col("seat.sequence_id"))
    # A sequence holds at most `length` pieces.
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "seat.slot").rowsBetween(Window.unboundedPreceding, -1)
    return seated.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop(
        "class", "mark", "slice", "one", "rank", "seat"
    )


def pack(docs: DataFrame, length: int = LENGTH, grain: int = GRAIN, tokenizer: str | None = None, end_id: int = END) -> DataFrame:
    """One row per piece: ``doc_id, text_key, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is the end id alone. Rows that repeat an id are documents of their own, told apart by
    ``piece_id``; a null id stays null; an empty table gives no rows. Columns other than doc_id and text are not read.
    """
    cut = keep(pieces(docs, length, tokenizer, end_id).withColumn("piece_id", F.monotonically_increasing_id()))
    return place(cut, length, grain).select(
        "doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def sequences(docs: DataFrame, length: int = LENGTH, grain: int = GRAIN, tokenizer: str | None = None, end_id: int = END, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids`` (padded to ``length`` unless their number is a power of two) and
    ``doc_starts``, the offsets at which pieces begin."""
    cut = keep(pieces(docs, length, tokenizer, end_id, with_ids=True).withColumn("piece_id", F.monotonically_increasing_id()))
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = place(cut, length, grain).groupBy("sequence_id").agg(rows.alias("rows")).select(
        "sequence_id", F.flatten(F.col("rows.ids")).alias("ids"), F.col("rows.offset").alias("doc_starts")
    )
    n = F.size("ids")
    even = F.bit_count(n.cast("long")) == 1
    padding = F.when(even, F.expr("cast(array() as array<int>)")).otherwise(F.array_repeat(F.lit(pad_id), F.lit(length) - n))
    return whole.withColumn("ids", F.concat("ids", padding))


@query("op6_column_generation")
def run(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents")).drop("text_key")
