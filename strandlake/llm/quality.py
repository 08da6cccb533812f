"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's tokens are characters, so that no word is unknown. Counts of all orders are tables; discounts come from their
counts of counts. Every task squeezes its texts into shards, rows of some megabytes that are written once, in buckets, and
never shuffled. A shard sends its distinct n-grams, packed by buckets of n-grams; the distinct n-grams of a bucket are joined
to the counts order by order, and the shard gets back one probability for each, with which it scores its documents. A
document is rejected where its perplexity leaves the quantiles that held-out trusted documents of its language have.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.catalog import query
from strandlake.llm.common import keep, keep_bucketed, row_key, table
from strandlake.session import ship_package

ORDER = 5
#: Bits of a token. Code points below FOLD are tokens themselves, all others share the ids above it by remainder.
TOKEN_BITS, FOLD = 12, 4000
MASK = (1 << TOKEN_BITS) - 1
START, END, OTHER = 2, 3, 0
#: One trusted document in so many is held out to measure quantiles.
HELD_OUT = 5
#: Bytes of text in a shard at most (but for one longer text), characters that are read in one go.
SHARD, CHUNK = 16 << 20, 1 << 20
#: Buckets that n-grams are dealt to: as many as shards within these bounds.
LEAST_BUCKETS, MOST_BUCKETS = 16, 4096
#: Quantiles of held-out documents that a document must lie between.
LOW, HIGH = 0.01, 0.99
#: Fewer held-out documents than this hold no such quantile, only their extremes, which are then moved outwards by so many
#: distances from the median.
RESOLVED, SLACK = 100, 1.5
#: Nats that one token adds to a document's score at most: a key or a formula of symbols that trusted text lacks is one
#: oddity of a page, not as many as it has characters.
CAP = 6.0
#: A short text is drawn towards its language's mean by so many tokens.
PRIOR = 60
#: Held-out documents that a language needs for quantiles of its own.
ENOUGH = 25


def gram_chunks(texts: list[str | None], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(n-grams of all tokens and ends, number of them per text)`` for runs of texts."""
    at = 0
    while at < len(texts):
        own, size = [], 0
        while at < len(texts) and (not own or size < CHUNK):
            own.append(texts[at] or "")
            size += len(own[-1]) + order
            at += 1
        pad = "\x00" * (order - 1)
        raw = np.frombuffer("".join(f"{pad}{t}\x00" for t in own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        ids = np.where(raw < FOLD, raw, FOLD + raw % (MASK + 1 - FOLD))
        ids[(ids == START) | (ids == END)] = OTHER
        lengths = np.array([len(t) for t in own])
        first = np.concatenate([[0], np.cumsum(lengths + order)[:-1]])
        for j in range(order - 1):
            ids[first + j] = START
        ids[first + order - 1 + lengths] = END
        grams = np.zeros(len(ids) - order + 1, dtype=np.int64)
        for j in range(order):
            grams = grams << TOKEN_BITS | ids[j : j + len(grams)]
        # The window that ends on a text's first token starts with its padding.
        scored = np.ones(len(grams), dtype=bool)
        for j in range(order - 1):
            later = first[1:] - order + 1 + j
            scored[later] = False
        yield grams[scored], lengths + 1


def _runs(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """The texts in lists of about a chunk of characters, so that no more of a batch exists as Python strings."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text or "")
        if size >= CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run


def _merged(kinds: np.ndarray, counts: np.ndarray, more: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, back = np.unique(np.concatenate([kinds, more]), return_inverse=True)
    return kinds, np.bincount(back, weights=np.concatenate([counts, numbers]), minlength=len(kinds)).astype(np.int64)


def _counted(batches):
    kinds, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for run in _runs(t.as_py() for t in batch.column("text")):
            for grams, _ in gram_chunks(run):
                kinds, counts = _merged(kinds, counts, *np.unique(grams, return_counts=True))
        if len(kinds) > CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(counts)], names=["gram", "n"])
            kinds, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(kinds):
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(counts)], names=["gram", "n"])


def _level(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(gram, alpha)`` and ``(context, gamma)`` of one order, from its counts; only counts of counts come to the driver."""
    t = counts.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    y = t.n1 / (t.n1 + 2 * t.n2) if t.n1 and t.n2 else 0.5
    d = [i - (i + 1) * y * (getattr(t, f"n{i + 1}") / getattr(t, f"n{i}")) if getattr(t, f"n{i}") else 0.5 * i for i in (1, 2, 3)]
    d = [min(max(x, 0.1), i - 0.05) for i, x in zip((1, 2, 3), d)]
    taken = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    parted = counts.withColumn("context", F.shiftright("gram", TOKEN_BITS)).withColumn("taken", taken)
    contexts = parted.groupBy("context").agg(F.sum("n").alias("total"), F.sum("taken").alias("free"))
    alphas = parted.join(contexts, "context").select("gram", ((F.col("n") - F.col("taken")) / F.col("total")).alias("alpha"))
    return alphas, contexts.select("context", (F.col("free") / F.col("total")).alias("gamma"))


class Model:
    """Tables of a fitted model: per order ``(gram, alpha)`` and ``(context, gamma)``."""

    def __init__(self, trusted: DataFrame, order: int = ORDER):
        self.order = order
        counts = keep(trusted.select("text").mapInArrow(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
        self.levels = {}
        for k in range(order, 0, -1):
            self.levels[k] = tuple(map(keep, _level(counts)))
            if k > 1:  # a lower order counts in how many contexts its grams go on
                short = F.col("gram").bitwiseAND(F.lit((1 << TOKEN_BITS * (k - 1)) - 1))
                counts = keep(counts.groupBy(short.alias("gram")).agg(F.count("*").alias("n")))

    def log_probabilities(self, grams: DataFrame) -> DataFrame:
        """``(gram, logp)`` for distinct n-grams of full order."""
        wanted = {self.order: grams}
        for k in range(self.order - 1, 0, -1):
            short = F.col("gram").bitwiseAND(F.lit((1 << TOKEN_BITS * k) - 1))
            wanted[k] = wanted[k + 1].select(short.alias("gram")).distinct()
        lower = None
        for k in range(1, self.order + 1):
            alphas, gammas = self.levels[k]
            rows = wanted[k].withColumn("context", F.shiftright("gram", TOKEN_BITS))
            rows = rows.join(alphas, "gram", "left").join(gammas, "context", "left")
            if lower is None:
                rows = rows.withColumn("below", F.lit(1.0 / (MASK + 1)))
            else:
                short = F.col("gram").bitwiseAND(F.lit((1 << TOKEN_BITS * (k - 1)) - 1))
                rows = rows.withColumn("short", short).join(lower.select(F.col("gram").alias("short"), F.col("p").alias("below")), "short")
            lower = rows.select("gram", (F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("below")).alias("p"))
        return lower.select("gram", F.log("p").alias("logp"))


def _squeezed(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)


def _blocks(batches):
    """Rows of ``shard, doc_ids, text_keys, sizes, packed``: texts of up to ``SHARD`` bytes squeezed together."""
    held: list[tuple] = []
    size, number = 0, TaskContext.get().partitionId() << 32
    schema = None

    def block():
        ids, keys, texts = zip(*held)
        data = b"".join(texts)
        columns = [[number], [list(ids)], [list(keys)], [[len(t) for t in texts]], [len(data)], [_squeezed(data)]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        schema = schema or pa.schema([
            ("shard", pa.int64()), ("doc_ids", pa.list_(batch.schema.field("doc_id").type)), ("text_keys", pa.list_(pa.int64())),
            ("sizes", pa.list_(pa.int64())), ("bytes", pa.int64()), ("packed", pa.binary()),
        ])
        for doc_id, key, text in zip(*map(batch.column, ("doc_id", "text_key", "text"))):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if held and size + len(data) > SHARD:
                yield block()
                held, size, number = [], 0, number + 1
            held.append((doc_id.as_py(), key.as_py(), data))
            size += len(data)
    if held:
        yield block()


def _texts(rows: pa.Table) -> Iterator[str]:
    for row in range(rows.num_rows):
        data = pa.Codec("zstd").decompress(rows.column("packed")[row].as_py(), rows.column("bytes")[row].as_py(), asbytes=True)
        at = 0
        for size in rows.column("sizes")[row].as_py():
            yield data[at : at + size].decode("utf-8", "surrogatepass")
            at += size


def _by_bucket(kinds: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``(n-grams by bucket, then value; their buckets)`` of distinct ones in order of value."""
    order = np.argsort(kinds % buckets, kind="stable")
    return kinds[order], kinds[order] % buckets


def _pack(grams: np.ndarray) -> bytes:
    return _squeezed(np.diff(grams, prepend=0).tobytes())


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.Codec("zstd").decompress(data, 8 * n, asbytes=True), dtype=np.int64))


def _sender(buckets: int):
    def send(rows: pa.Table) -> pa.Table:
        kinds = np.zeros(0, np.int64)
        for run in _runs(_texts(rows)):
            for grams, _ in gram_chunks(run):
                kinds = np.union1d(kinds, np.unique(grams))
        grams, dealt = _by_bucket(kinds, buckets)
        names, first = np.unique(dealt, return_index=True)
        parts = np.split(grams, first[1:])
        shard = rows.column("shard")[0].as_py()
        return pa.table({
            "shard": pa.array([shard] * len(names), pa.int64()), "bucket": pa.array(names, pa.int64()),
            "n": pa.array([len(p) for p in parts], pa.int64()), "grams": pa.array([_pack(p) for p in parts], pa.binary()),
        })

    return send


def _union(rows: pa.Table) -> pa.Table:
    grams = np.zeros(0, np.int64)
    for data, n in zip(rows.column("grams"), rows.column("n")):
        grams = np.union1d(grams, _unpack(data.as_py(), n.as_py()))
    return pa.table({"gram": pa.array(grams)})


def _answers(rows: pa.Table, known: pa.Table) -> pa.Table:
    keys, values = known.column("gram").to_numpy(), known.column("logp").to_numpy()
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    found = [values[np.searchsorted(keys, _unpack(d.as_py(), n.as_py()))].tobytes() for d, n in zip(rows.column("grams"), rows.column("n"))]
    return pa.table({"shard": rows.column("shard"), "bucket": rows.column("bucket"), "logps": pa.array(found, pa.binary())})


def _scorer(buckets: int):
    def scored(rows: pa.Table, answers: pa.Table) -> pa.Table:
        # A chunk keeps its distinct n-grams and where they stand (four bytes a character) until the shard's are known.
        chunks = []
        kinds = np.zeros(0, np.int64)
        for run in _runs(_texts(rows)):
            for grams, lengths in gram_chunks(run):
                own, places = np.unique(grams, return_inverse=True)
                chunks.append((own, places.astype(np.int32), lengths))
                kinds = np.union1d(kinds, own)
        grams, _ = _by_bucket(kinds, buckets)
        order = np.argsort(answers.column("bucket").to_numpy())
        logps = np.frombuffer(b"".join(answers.column("logps")[int(i)].as_py() for i in order), dtype=np.float64)
        values = logps[np.argsort(grams)]
        tokens, sums, capped = [], [], []
        for own, places, lengths in chunks:
            logp = values[np.searchsorted(kinds, own)][places]
            ends = np.cumsum(lengths)
            tokens.append(lengths)
            for out, each in ((sums, logp), (capped, np.maximum(logp, -CAP))):
                total = np.concatenate([[0.0], np.cumsum(each)])
                out.append(total[ends] - total[ends - lengths])
        flat = lambda name: pa.concat_arrays([x.values for x in rows.column(name)])
        return pa.table({
            "doc_id": flat("doc_ids"), "text_key": flat("text_keys"), "tokens": pa.array(np.concatenate(tokens).astype(np.int64)),
            "logp": pa.array(np.concatenate(sums)), "capped": pa.array(np.concatenate(capped)),
        })

    return scored


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, text_key, tokens, logp, capped`` of each whole text, the end of the text being one token more."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = docs.select("doc_id", row_key(F.col("text")).alias("text_key"), "text").mapInArrow(
        _blocks, f"shard long, doc_ids array<{kind}>, text_keys array<long>, sizes array<long>, bytes long, packed binary"
    )
    shards = -(-size // SHARD)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = keep_bucketed(blocks, "shard", max(tasks, min(2 * shards, 10_000)))
    buckets = min(max(shards, LEAST_BUCKETS), MOST_BUCKETS)
    sent = keep(blocks.groupBy("shard").applyInArrow(_sender(buckets), "shard long, bucket long, n long, grams binary"))
    grams = keep(sent.groupBy("bucket").applyInArrow(_union, "gram long"))
    known = keep(model.log_probabilities(grams).withColumn("bucket", F.pmod("gram", F.lit(buckets))))
    back = sent.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_answers, "shard long, bucket long, logps binary")
    return blocks.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(
        _scorer(buckets), f"doc_id {kind}, text_key long, tokens long, logp double, capped double"
    )


def trusted_roles(labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out)`` of all trusted documents."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    return good.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(HELD_OUT)) == 0).alias("held_out"))


def trusted_texts(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """``text`` of all documents the model is fitted on."""
    return docs.join(roles.where("not held_out").select("doc_id"), "doc_id").select("text")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, text_key, lang, tokens, perplexity, score, low, high, kept``.

    ``score`` is the mean surprise of a token in nats, of which one adds ``CAP`` at most, drawn towards the language's mean in
    short texts; ``perplexity`` is that of all tokens as they are. A document is
    kept if it lies from ``low`` to ``high``, which the language's quantiles give. A language with few held-out documents, a null
    language included, is measured by all of them; without trusted documents nothing is rejected. A null or empty text
    has its end as only token and is judged like any short text. Rows that repeat an id are scored on their own; an
    empty table gives no rows. Columns other than doc_id, text and lang, and doc_id and quality of labels, are not read.
    """
    ship_package(docs.sparkSession)
    read = docs.select("doc_id", "lang", "text")
    roles = keep(trusted_roles(labels))
    model = Model(trusted_texts(read, roles))
    facts = keep(read.select("doc_id", row_key(F.col("text")).alias("text_key"), "lang").dropDuplicates(["doc_id", "text_key", "lang"]))
    scored = keep(score(read, model).withColumn("surprise", -F.col("capped") / F.col("tokens")))
    same = F.expr("doc_id <=> _id and text_key = _key")
    named = scored.join(
        facts.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.coalesce("lang", F.lit("")).alias("_lang"), "lang")
        .groupBy("_id", "_key").agg(F.min("_lang").alias("_lang"), F.min("lang").alias("lang")), same, "left",
    ).drop("_id", "_key")
    held = keep(named.join(roles.where("held_out").select("doc_id"), "doc_id", "left_semi"))
    weigh = lambda mean: (F.col("surprise") * F.col("tokens") + F.lit(float(PRIOR)) * mean) / (F.col("tokens") + PRIOR)
    overall = held.agg(F.avg("surprise").alias("mean")).first().mean
    if overall is None:
        none = F.lit(None).cast("double")
        return named.select("doc_id", "text_key", "lang", "tokens", F.exp(-F.col("logp") / F.col("tokens")).alias("perplexity"), F.col("surprise").alias("score"), none.alias("low"), none.alias("high"), F.lit(True).alias("kept"))
    at = lambda q: F.percentile_approx("score", q, 100_000)
    beyond = F.when(F.count("score") < RESOLVED, SLACK).otherwise(0.0)
    cuts = [(at(q) + beyond * (at(q) - at(0.5))).alias(n) for n, q in (("low", LOW), ("high", HIGH))]
    means = held.groupBy("_lang").agg(F.avg("surprise").alias("mean"), F.count("*").alias("n")).where(F.col("n") >= ENOUGH).select("_lang", "mean")
    shrunk = held.join(means, "_lang", "left").withColumn("score", weigh(F.coalesce("mean", F.lit(overall))))
    by_lang = keep(means.join(shrunk.groupBy("_lang").agg(*cuts), "_lang"))
    everywhere = shrunk.agg(*cuts).first()
    # One row a language.
    judged = named.join(by_lang, "_lang", "left").withColumn("score", weigh(F.coalesce("mean", F.lit(overall))))
    low, high = F.coalesce("low", F.lit(everywhere.low)), F.coalesce("high", F.lit(everywhere.high))
    return judged.select(
        "doc_id", "text_key", "lang", "tokens", F.exp(-F.col("logp") / F.col("tokens")).alias("perplexity"), "score", low.alias("low"), high.alias("high"),
        F.col("score").between(low, high).alias("kept"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    gone = classify(docs, labels).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (row_key(docs["text"]) == gone["_key"]), "left_anti")


@query("op2_kneser_ney_quality")
def run(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")
