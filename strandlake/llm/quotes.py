"""Quotation linking: finds which message a quoted passage comes from and orders conversations by reply, without quotes.

A line that opens with ``>`` marks is quoted, their number being its level. Lines are normalised (marks off, lower case,
white space collapsed) and hashed; a quoted line is joined to the first message that says it itself, in the same
conversation if there is one, else anywhere. The lines of a passage vote for its origin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.catalog import query
from strandlake.llm.common import keep, table

#: Quote marks at the start of a line.
MARKS = r"^[ \t]*(?:>[ \t]?)+"


def message_lines(messages: DataFrame) -> DataFrame:
    """``uid, conv_id, turn, line_no, level, passage, line, mark``: passage numbers runs of lines of one level in a message."""
    lines = messages.select(
        "uid", "conv_id", "turn", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n", -1)).alias("line_no", "line")
    )
    level = F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 0), "[^>]", ""))
    said = F.trim(F.regexp_replace(F.lower(F.regexp_replace("line", MARKS, "")), r"\s+", " "))
    order = Window.partitionBy("uid").orderBy("line_no")
    turned = F.coalesce(F.col("level") != F.lag("level").over(order), F.lit(True)).cast("int")
    return (
        lines.withColumn("level", level).withColumn("said", said).withColumn("turned", turned)
        .withColumn("passage", F.sum("turned").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("mark", F.when(F.col("said") != "", F.xxhash64("said")))
        .drop("said", "turned")
    )


def passage_origins(lines: DataFrame) -> DataFrame:
    """``uid, passage, level, origin_conv, origin_turn, votes``: the message that says most lines of a quoted passage.

    Each line hash has one origin per conversation and one at all, found by a minimum that is taken before the shuffle,
    so a line that everybody says or quotes joins one row, never each with each.
    """
    own = lines.where("level = 0 and mark is not null and turn is not null")
    here = own.groupBy("conv_id", "mark").agg(F.min("turn").alias("here_turn"))
    first = own.where("conv_id is not null").groupBy("mark").agg(F.min(F.struct("turn", "conv_id")).alias("first"))
    quoted = lines.where("level > 0 and mark is not null")
    near = quoted.join(
        here.select(F.col("conv_id").alias("_conv"), F.col("mark").alias("_mark"), "here_turn"),
        F.expr("mark = _mark and conv_id <=> _conv and here_turn < turn"), "left",
    ).drop("_conv", "_mark")
    far = near.join(first, "mark", "left")
    origin = F.when(F.col("here_turn").isNotNull(), F.struct(F.col("conv_id").alias("conv"), F.col("here_turn").alias("turn"))).otherwise(
        F.when(F.col("first").isNotNull() & ~F.col("first.conv_id").eqNullSafe(F.col("conv_id")), F.struct(F.col("first.conv_id").alias("conv"), F.col("first.turn").alias("turn")))
    )
    votes = (
        far.withColumn("origin", origin).where("origin is not null")
        .groupBy("uid", "passage", "level", "origin").agg(F.count("*").alias("votes"))
    )
    best = votes.groupBy("uid", "passage", "level").agg(F.max(F.struct("votes", (-F.col("origin.turn")).alias("early"), "origin")).alias("b"))
    return best.select("uid", "passage", "level", F.col("b.origin.conv").alias("origin_conv"), F.col("b.origin.turn").alias("origin_turn"), "b.votes")


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: ``conv_id, turn, role, text`` without quotes, ``n_quoted`` lines, ``max_level``, the message it
    replies to (``reply_conv, reply_turn``: origin of the first passage of level 1, else null) and ``thread_turn``, the
    turn at which its chain of replies within the conversation began. Ordered by ``conv_id, thread_turn, turn``, every
    reply follows what it answers.

    A null text has no lines and stays null; a null turn can neither quote nor be quoted and threads alone; a null
    conv_id is a conversation of its own; rows that repeat a turn keep one row each. An empty table gives no rows.
    Columns other than the four read are left out.
    """
    rows = keep(messages.select("conv_id", "turn", "role", "text").withColumn("uid", F.monotonically_increasing_id()))
    lines = message_lines(rows)
    origins = passage_origins(lines)
    parents = (
        origins.where("level = 1").groupBy("uid")
        .agg(F.min(F.struct("passage", "origin_conv", "origin_turn")).alias("p"))
        .select("uid", F.col("p.origin_conv").alias("reply_conv"), F.col("p.origin_turn").alias("reply_turn"))
    )
    quoted = lines.where("level > 0").groupBy("uid").agg(F.count("*").alias("n_quoted"), F.max("level").alias("max_level"))
    own = (
        rows.where(F.rlike("text", F.lit("(?m)" + MARKS)))
        .select("uid", F.array_join(F.filter(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1), lambda x: ~F.rlike(x, F.lit(MARKS))), "\n").alias("own"))
        .select("uid", F.trim(F.col("own")).alias("own"))
    )
    linked = keep(
        rows.join(parents, "uid", "left").join(quoted, "uid", "left").join(own, "uid", "left")
        .select(
            "uid", "conv_id", "turn", "role", F.coalesce("own", "text").alias("text"),
            F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("max_level", F.lit(0)).alias("max_level"), "reply_conv", "reply_turn",
        )
    )
    return _threaded(linked)


def _threaded(linked: DataFrame) -> DataFrame:
    """Add ``thread_turn`` by following replies within a conversation, twice as far in each round."""
    replies = F.col("reply_conv").eqNullSafe(F.col("conv_id")) & F.col("reply_turn").isNotNull() & (F.col("reply_turn") < F.col("turn"))
    chains = keep(
        linked.where(replies).groupBy("conv_id", "turn").agg(F.min("reply_turn").alias("root"))
    )
    while True:
        up = chains.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("root").alias("_root"))
        longer = chains.join(up, chains["conv_id"].eqNullSafe(F.col("_conv")) & (chains["root"] == F.col("_turn")), "left")
        moved = keep(longer.select("conv_id", "turn", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        chains = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    tops = chains.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "root")
    out = linked.join(tops, linked["conv_id"].eqNullSafe(F.col("_conv")) & (linked["turn"] == F.col("_turn")), "left")
    return out.select(
        "conv_id", "turn", "role", "text", "n_quoted", "max_level", "reply_conv", "reply_turn", F.coalesce("root", "turn").alias("thread_turn")
    )


SQL = r"""
WITH RECURSIVE rows_ AS (SELECT row_number() OVER () AS uid, conv_id, turn, role, text FROM conversations),
split_ AS (SELECT uid, conv_id, turn, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM rows_),
cut AS (SELECT uid, conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM split_),
told AS (SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]?)+'), '[^>]', '', 'g')) AS level,
                trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*(?:>[ \t]?)+', '')), '\s+', ' ', 'g')) AS said FROM cut),
turned AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY uid ORDER BY line_no) THEN 0 ELSE 1 END AS fresh FROM told),
lines AS (SELECT *, sum(fresh) OVER (PARTITION BY uid ORDER BY line_no) AS passage FROM turned),
own AS (SELECT * FROM lines WHERE level = 0 AND said <> '' AND turn IS NOT NULL),
here AS (SELECT conv_id, said, min(turn) AS here_turn FROM own GROUP BY ALL),
everywhere AS (SELECT said, conv_id AS first_conv, turn AS first_turn FROM own WHERE conv_id IS NOT NULL
               QUALIFY row_number() OVER (PARTITION BY said ORDER BY turn, conv_id) = 1),
origins AS (SELECT q.uid, q.passage, q.level, CASE WHEN here_turn IS NOT NULL THEN q.conv_id ELSE first_conv END AS origin_conv, coalesce(here_turn, first_turn) AS origin_turn
            FROM lines q LEFT JOIN here h ON q.said = h.said AND q.conv_id IS NOT DISTINCT FROM h.conv_id AND h.here_turn < q.turn LEFT JOIN everywhere e ON q.said = e.said
            WHERE q.level = 1 AND q.said <> '' AND (here_turn IS NOT NULL OR (first_turn IS NOT NULL AND first_conv IS DISTINCT FROM q.conv_id))),
votes AS (SELECT uid, passage, origin_conv, origin_turn, count(*) AS n FROM origins GROUP BY ALL),
best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY uid, passage ORDER BY n DESC, origin_turn, origin_conv DESC NULLS LAST) = 1),
parents AS (SELECT uid, origin_conv, origin_turn FROM best QUALIFY row_number() OVER (PARTITION BY uid ORDER BY passage) = 1),
facts AS (SELECT uid, CAST(count(*) FILTER (level > 0) AS BIGINT) AS n_quoted, CAST(max(level) AS INTEGER) AS max_level,
                 trim(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (level = 0), '')) AS kept FROM lines GROUP BY uid),
linked AS (SELECT r.*, n_quoted, max_level, CASE WHEN n_quoted > 0 THEN kept ELSE text END AS shown, origin_conv, origin_turn
           FROM rows_ r JOIN facts USING (uid) LEFT JOIN parents USING (uid)),
steps AS (SELECT conv_id, turn, min(origin_turn) AS up FROM linked WHERE origin_conv IS NOT DISTINCT FROM conv_id AND origin_turn < turn GROUP BY ALL),
walk AS (SELECT conv_id, turn, up AS root FROM steps UNION SELECT w.conv_id, w.turn, s.up FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.turn = w.root),
tops AS (SELECT conv_id, turn, min(root) AS root FROM walk GROUP BY ALL)
SELECT l.conv_id, l.turn, l.role, l.shown AS text, n_quoted, max_level, origin_conv AS reply_conv, origin_turn AS reply_turn, coalesce(t.root, l.turn) AS thread_turn
FROM linked l LEFT JOIN tops t ON l.conv_id IS NOT DISTINCT FROM t.conv_id AND l.turn = t.turn"""


@query("op4_quote_threads", SQL)
def run(spark, sf_dir):
    return conversations(table(spark, sf_dir, "conversations"))
