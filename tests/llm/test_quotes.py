import duckdb
import pandas as pd

from strandlake.llm import quotes

ROWS = [
    (1, 0, "user", "Hello there\nhow are you?"),
    (1, 1, "assistant", "> Hello   THERE\nI am fine"),
    (1, 2, "user", "another topic"),
    (1, 3, "user", ">> hello there\n> I am fine\ngood"),
    (2, 0, "user", "> another topic\nseen elsewhere"),
    (3, 0, "user", "> nobody said this\nown"),
    (3, None, "user", "> own"),
    (None, 0, "user", "no conversation"),
    (4, 0, "user", None),
    (4, 1, "user", ""),
    (5, 0, "a", "same"), (5, 0, "a", "same"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_links_threads_and_own_text(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], SCHEMA + ", uid int")
    out = quotes.conversations(df).collect()
    assert len(out) == len(ROWS)
    got = {(r.conv_id, r.turn): r for r in out}
    assert (got[1, 1].reply_conv, got[1, 1].reply_turn, got[1, 1].thread_turn) == (1, 0, 0)
    assert got[1, 1].text == "I am fine" and got[1, 1].n_quoted == 1
    assert (got[1, 3].reply_turn, got[1, 3].thread_turn, got[1, 3].max_level) == (1, 0, 2)
    assert (got[1, 2].reply_turn, got[1, 2].thread_turn) == (None, 2)
    assert (got[2, 0].reply_conv, got[2, 0].reply_turn) == (1, 2) and got[2, 0].thread_turn == 0
    assert got[3, 0].reply_conv is None and got[3, 0].text == "own"
    assert got[3, None].reply_conv is None
    assert got[4, 0].text is None and got[4, 1].text == ""


def test_a_line_that_everybody_quotes_has_one_origin(spark):
    rows = [(7, t, "u", "common line") for t in range(50)] + [(7, 100 + t, "u", "> common line\nyes") for t in range(50)]
    lines = quotes.message_lines(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", uid long"))
    origins = quotes.passage_origins(lines).collect()
    assert len(origins) == 50 and {(r.origin_conv, r.origin_turn) for r in origins} == {(7, 0)}


def test_long_reply_chain_has_one_root(spark):
    rows = [(1, 0, "u", "line 0")] + [(1, t, "u", f"> line {t - 1}\nline {t}") for t in range(1, 40)]
    out = quotes.conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.thread_turn for r in out} == {0} and all(r.reply_turn == r.turn - 1 for r in out if r.turn)


def test_no_rows(spark):
    assert quotes.conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_gives_the_same_rows(spark):
    long = [(8, 0, "u", "line 0")] + [(8, t, "u", f"> line {t - 1}\n>> line 0\nline {t}") for t in range(1, 20)]
    rows = ROWS + long + [(9, 0, "u", "> line 3\r\n> line 4\rtail"), (9, 1, "u", ">only")]
    con = duckdb.connect()
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", conversations)
    cursor = con.execute(quotes.SQL)
    names = [d[0] for d in cursor.description]
    out = quotes.conversations(spark.createDataFrame(rows, SCHEMA))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(key, cursor.fetchall())) == sorted(key([r[n] for n in names]) for r in out.collect())
