"""Secret scan: three fixed patterns, and a battery of randomness tests for every other long token.

A token's encoding is the smallest alphabet that holds it. Against uniform random symbols of that alphabet stand three
tests: chi-squared of the symbols (and of the kinds of symbols), runs above and below the alphabet's middle, and serial
correlation of neighbours. Fisher's method joins them to one p-value: high for keys, low for words. How high it gets for
ordinary text (words, names, slugs, paths, numbers) of an encoding and length is known from a built-in reference, the same
whatever the table. A token is reported where its chance among ordinary text passes Benjamini and Hochberg's rule among
the tokens of its length band.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.catalog import query
from strandlake.llm.common import keep, row_key, table

#: Fixed patterns, their kinds in order, and the fewest characters (of the group given) that count. Runs of hex digits are
#: asked for at their least length at once: a run is one match with or without it, and short ones need not become rows.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = (("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (pattern of the whole token, alphabet) from small to large.
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[a-z]+$", LOWER),
    ("^[A-Z]+$", UPPER),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[A-Za-z]+$", UPPER + LOWER),
    ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Share of false reports among the reported tokens of a length band.
FALSE_SHARE = 0.05
#: p-values are counted on a grid of this many steps of -ln p, each of this width.
STEPS, STEP = 400, 0.125
#: Ordinary text is made of these words and numbers, so many tokens of each style and length; longer tokens than these
#: lengths are held against the longest, as short text looks more random.
WORDS = (
    "the of and to in is that for with on as are this by be from or at an was not have which one all new time page home user name "
    "file data list view order number system report project version update default product image config service "
    "der die und das von mit ist nicht auch werden haben eine durch unter zwischen straße "
    "le la les des une dans pour que est pas sur avec plus jour maison toujours "
    "el los las por con para una del como pero sus entre cuando ciudad trabajo"
).replace("ß", "ss").split()
NUMBERS = ("1", "2", "3", "7", "10", "12", "24", "42", "64", "100", "128", "2024", "2019", "365", "2567")
HEX_WORDS = ("DEAD", "BEEF", "CAFE", "FACE", "0000", "FFFF", "00", "FF", "1234", "2024", "BAD", "FEED", "0001", "A0")
REFERENCE, LENGTHS = 400, (20, 24, 28, 32, 40, 48, 64, 96)
#: The spread of ordinary text is taken so much wider than that of the reference, whose words are few.
WIDER = 1.25


def _tail(z):
    """Upper tail of the normal distribution at ``z >= 0``, good to some per cent far out."""
    return f"(0.5D * exp(-0.717D * ({z}) - 0.416D * ({z}) * ({z})))"


def _surprise(z, sides=2):
    """-ln of the p-value of a normal score, one-sided where only large scores count."""
    if sides == 1:
        return f"if(({z}) > 0, -ln({_tail(z)}), -ln(1D - {_tail(f'-({z})')}))"
    return f"-ln(2D * {_tail(f'abs({z})')})"


def _encoding(values):
    """The value of the smallest alphabet that holds ``token``."""
    return F.coalesce(*[F.when(F.rlike("token", F.lit(p)), F.lit(v)) for (p, _), v in zip(ENCODINGS[:-1], values)], F.lit(values[-1]))


def randomness(tokens: DataFrame) -> DataFrame:
    """Add ``surprise``, -ln of the joint p-value that the symbols of ``token`` are uniform and independent."""
    alphabet = _encoding([a for _, a in ENCODINGS])
    chi = lambda x, df: f"((pow(({x}) / ({df}), 1D / 3) - (1D - 2D / (9D * ({df})))) / sqrt(2D / (9D * ({df}))))"
    kinds = "array(array(digits, length(regexp_replace(alphabet, '[^0-9]', ''))), array(lowers, length(regexp_replace(alphabet, '[^a-z]', ''))), array(uppers, length(regexp_replace(alphabet, '[^A-Z]', ''))))"
    steps = [
        {"alphabet": alphabet},
        {"a": F.length("alphabet").cast("double"), "n": F.length("token").cast("double"),
         "v": F.expr("transform(filter(split(token, ''), c -> c <> ''), c -> instr(alphabet, c) - 1)"),
         "digits": F.regexp_count("token", F.lit("[0-9]")), "lowers": F.regexp_count("token", F.lit("[a-z]")),
         "uppers": F.regexp_count("token", F.lit("[A-Z]"))},
        # sum of (count - n/a)^2 / (n/a) = a/n * sum of count^2 - n
        {"x2": F.expr("a / n * aggregate(transform(filter(split(alphabet, ''), c -> c <> ''), c -> length(token) - length(replace(token, c, ''))), 0D, (s, k) -> s + k * k) - n"),
         "k2": F.expr(f"aggregate(filter({kinds}, k -> k[1] > 0), 0D, (s, k) -> s + pow(k[0] - n * k[1] / a, 2) / (n * k[1] / a))"),
         "kf": F.expr(f"size(filter({kinds}, k -> k[1] > 0)) - if(a > 62, 0, 1)"),
         "pairs": F.expr("zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (x, y) -> named_struct('x', x, 'y', y))")},
        {"runs": F.expr("1D + aggregate(pairs, 0D, (s, p) -> s + if((p.x < a / 2) = (p.y < a / 2), 0, 1))"),
         "serial": F.expr("aggregate(pairs, 0D, (s, p) -> s + (p.x - (a - 1) / 2) * (p.y - (a - 1) / 2)) / ((a * a - 1) / 12)")},
        {"s1": F.expr(f"greatest({_surprise(chi('greatest(x2, 0.01D)', 'a - 1'), 1)}, 0D)"),
         "s2": F.expr(f"if(kf > 0, greatest({_surprise(chi('greatest(k2, 0.01D)', 'greatest(kf, 1)'), 1)}, 0D), 0D)"),
         "s3": F.expr(f"greatest({_surprise('(runs - 1 - (n - 1) / 2) / sqrt((n - 1) / 4)')}, 0D)"),
         "s4": F.expr(f"greatest({_surprise('serial / sqrt(n - 1)')}, 0D)")},
        # The two chi-squared tests share their symbols: the stronger counts once, doubled as two looks were taken.
        {"s": F.expr("greatest(greatest(s1, s2) - ln(2D), 0D) + s3 + s4")},
        {"surprise": F.expr("s - ln(1D + s + s * s / 2)")},
    ]
    out = tokens
    for columns in steps:
        out = out.withColumns(columns)
    return out.select(*tokens.columns, "surprise")


@functools.cache
def ordinary() -> tuple[tuple[int, int, float, float], ...]:
    """``(encoding, length, mean, deviation)`` of the root of the surprise of ordinary text; few rows, the same in any table."""
    spark = SparkSession.active()
    pick = lambda words, salt: F.expr(
        f"transform(sequence(1, 60), i -> element_at(array({', '.join(repr(w) for w in words)}), cast(pmod(xxhash64(id, i, {salt}), {len(words)}) as int) + 1))"
    )
    mixed = "transform(w, (x, i) -> if(pmod(xxhash64(id, i, 3), 4) = 0, element_at(d, i + 1), x))"
    names = "transform({0}, x -> initcap(x))"
    styles = (
        "array_join(h, '')", "array_join(w, '')", "upper(array_join(w, ''))", f"array_join({names.format('w')}, '')",
        f"upper(array_join({mixed}, ''))", f"regexp_replace(upper(array_join({mixed}, '')), '[0189]', '')", f"array_join({mixed}, '')",
        f"array_join({names.format(mixed)}, '')", f"array_join({mixed}, '-')", f"array_join({names.format(mixed)}, '_')",
        f"array_join({mixed}, '/')", f"array_join({names.format(mixed)}, '/')",
    )
    made = (
        spark.range(0, REFERENCE, 1, 2).select("id", pick(WORDS, 0).alias("w"), pick(NUMBERS, 1).alias("d"), pick(HEX_WORDS, 2).alias("h"))
        .select(F.explode(F.array(*[F.expr(x) for x in styles])).alias("long")).select("long", F.explode(F.array(*map(F.lit, LENGTHS))).alias("length"))
        .select("length", F.expr("substring(long, 1, length)").alias("token"))
    )
    found = randomness(made).withColumn("encoding", _encoding(list(range(len(ENCODINGS)))))
    stats = found.groupBy("encoding", "length").agg(F.avg(F.sqrt("surprise")).alias("m"), F.stddev(F.sqrt("surprise")).alias("sd"), F.count("*").alias("n"))
    return tuple((x.encoding, x.length, x.m, x.sd) for x in stats.where("n >= 30").collect())


def strangeness(tokens: DataFrame) -> DataFrame:
    """Add ``rarity``, -ln of the chance that ordinary text of the token's encoding and length looks so random."""
    read = randomness(tokens).withColumn("encoding", _encoding(list(range(len(ENCODINGS)))))
    best = {}
    for encoding, length, m, sd in sorted(ordinary(), key=lambda x: x[1]):
        best.setdefault(encoding, []).append((length, m, sd))
    score = F.lit(0.0)
    for encoding, rows in best.items():
        z = F.lit(0.0)
        for length, m, sd in rows:
            z = F.when(F.length("token") >= length, (F.lit(m) - F.sqrt("surprise")) / (WIDER * sd)).otherwise(z)
        score = F.when(F.col("encoding") == encoding, z).otherwise(score)
    read = read.withColumn("z", F.greatest(score, F.lit(0.0)))
    return read.select(*tokens.columns, F.expr(f"greatest(-ln({_tail('z')}), 0D)").alias("rarity"))


def _hits(pattern):
    """Lengths of the text between the matches, and the matches."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(
        f"if(rlike(body, '{quoted}'), named_struct('gaps', transform(split(body, '{quoted}', -1), x -> length(x)), "
        f"'hits', regexp_extract_all(body, '{quoted}', 0)), null)"
    )


def find_spans(docs: DataFrame, false_share: float = FALSE_SHARE) -> tuple[DataFrame, DataFrame]:
    """``(documents, spans)``: rows of ``uid, doc_id, text_key`` and of ``uid, kind, start, end``.

    Positions are code points from 0, ends exclusive. Tokens that meet a span of a fixed pattern are left to it.
    """
    listed = [*[(k, p) for k, p, _, _ in PATTERNS], ("random", TOKEN)]
    found = keep(
        docs.select("doc_id", row_key(F.col("text")).alias("text_key"), F.coalesce("text", F.lit("")).alias("body"))
        .select("doc_id", "text_key", *[_hits(p).alias(k) for k, p in listed])
        .withColumn("uid", F.monotonically_increasing_id())
    )
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("at")) for k, _ in listed])).alias("k")
    rows = (
        found.select("uid", kinds).where("k.at is not null")
        .select("uid", "k.kind", F.posexplode(F.arrays_zip("k.at.gaps", "k.at.hits")).alias("i", "z"))
        .where("z.hits is not null")
        .select("uid", "kind", "i", F.col("z.gaps").alias("gap"), F.col("z.hits").alias("token"))
    )
    before = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", (F.coalesce(F.sum(F.col("gap") + F.length("token")).over(before), F.lit(0)) + F.col("gap")).cast("long"))
    rows = rows.withColumn("end", F.col("start") + F.length("token"))
    long_enough = F.coalesce(*[
        F.when(F.col("kind") == k, F.length(F.regexp_extract("token", p, g) if g else F.col("token")) >= least)
        for k, p, g, least in PATTERNS
    ])
    base = rows.where("kind <> 'random'").where(long_enough).select("uid", "kind", "start", "end")
    tokens = rows.where("kind = 'random'").select("uid", "kind", "start", "end", "token")
    other = base.select(F.col("uid").alias("_uid"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    # Left out before the tests are counted, else hashes would make room for false reports.
    tokens = strangeness(tokens.join(other, F.expr("uid = _uid and start < _end and _start < end"), "left_anti")).select(
        "uid", "kind", "start", "end",
        F.least(F.floor(F.log2(F.length("token")) * 2), F.lit(40)).cast("int").alias("band"),
        F.least(F.floor(F.col("rarity") / STEP), F.lit(STEPS)).cast("int").alias("step"),
    )
    spans = keep(base.withColumns({c: F.lit(None).cast("int") for c in ("band", "step")}).union(tokens))
    limits = _limits(spans, false_share)
    limit = F.coalesce(*[F.when(F.col("band") == b, F.lit(s)) for b, s in limits.items()], F.lit(STEPS + 1))
    reported = spans.where("kind <> 'random'").union(spans.where("kind = 'random'").where(F.col("step") >= limit))
    return found.select("uid", "doc_id", "text_key"), reported.select("uid", "kind", "start", "end")


def _limits(spans: DataFrame, false_share: float) -> dict[int, int]:
    """For each length band the least step of -ln p that is reported; at most 41 rows come to the driver."""
    counts = spans.where("kind = 'random'").groupBy("band", "step").agg(F.count("*").alias("n"))
    rarer = Window.partitionBy("band").orderBy(F.col("step").desc())
    ruled = (
        counts.withColumn("found", F.sum("n").over(rarer)).withColumn("tests", F.sum("n").over(Window.partitionBy("band")))
        .where(F.exp(F.col("step") * -STEP) * F.col("tests") <= F.lit(false_share) * F.col("found"))
    )
    return {r.band: r.step for r in ruled.groupBy("band").agg(F.min("step").alias("step")).collect()}


def _joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def scan(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """One row per document: ``doc_id, text_key``, counts ``n_assign, n_access, n_hex, n_random`` and ``spans``, an array of
    ``(start, kind_no, end, kind)`` by start, then kind.

    Null and empty texts have no spans; rows that repeat an id are scanned on their own; an empty table gives no rows.
    Columns other than doc_id and text are not read.
    """
    documents, spans = find_spans(docs, false_share)
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    by_doc = spans.groupBy("uid").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        F.sort_array(F.collect_list(F.struct("start", order.alias("kind_no"), "end", "kind"))).alias("spans"),
    )
    empty = F.expr("cast(array() as array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>)")
    return documents.join(by_doc, "uid", "left").select(
        "doc_id", "text_key", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.coalesce("spans", empty).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and ``n_chars`` counted anew; texts without a span stay as they are."""
    spans = scan(docs).where("size(spans) > 0").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.first("spans").alias("_spans"))
    same = docs["doc_id"].eqNullSafe(spans["_id"]) & (row_key(docs["text"]) == spans["_key"])
    # A span starts a cut unless an earlier one reaches over it; a cut lasts as long as spans overlap.
    cuts = F.expr(
        "aggregate(_spans, cast(array() as array<struct<s:bigint,e:bigint>>), (a, x) -> if(size(a) > 0 and x.start < a[size(a) - 1].e, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('s', a[size(a) - 1].s, 'e', greatest(a[size(a) - 1].e, x.end)))), "
        "concat(a, array(named_struct('s', x.start, 'e', x.end)))))"
    )
    clean = F.expr(
        "concat(array_join(transform(_cuts, (c, i) -> concat(substring(text, int(if(i = 0, 0, _cuts[i - 1].e)) + 1, "
        f"int(c.s - if(i = 0, 0, _cuts[i - 1].e))), '{mark}')), ''), substring(text, int(_cuts[size(_cuts) - 1].e) + 1))"
    )
    out = docs.join(spans, same, "left").withColumn("_cuts", F.when(F.col("_spans").isNotNull(), cuts))
    out = out.withColumn("text", F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@query("op3_secret_randomness")
def run(spark, sf_dir):
    out = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"), "n_random",
    )
