import duckdb
import pandas as pd

from tidewalk.llm.quotes import CHAT_SQL, as_mail, chat

ROWS = [
    (1, 0, "user", "The first question, which is long enough.\n\nAnd a second paragraph to quote.", 9),
    (1, 1, "assistant", "An answer to the first question here.", 9),
    (1, 2, "user", "On Monday, A wrote:\n> The first question, which\n> is long enough.\n\nMy reply to the very first.", 9),
    (1, 3, "assistant", "> > The first question, which is long enough.\n> My reply to the very FIRST!\n\nThird level answer text.", 9),
    (1, 4, "user", ">> unknown words nobody said before\nplain", 9),
    (1, 4, "user", ">> unknown words nobody said before\nplain", 9),
    (2, 0, None, None, 9),
    (2, 1, "user", "", 9),
    (None, 1, "user", "> The first question, which is long enough.", 9),
    (3, None, "user", "no turn\n> An answer to the first question here.", 9),
    (3, 5, "user", "x" * 50_000 + "\n> y", 9),
]
SCHEMA = "conv_id long, turn long, role string, text string, level int"


def test_links_and_order(spark):
    rows = {(r.conv_id, r.turn): r for r in chat(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert rows[1, 2].reply_to == 0 and rows[1, 2].content == "My reply to the very first."
    assert (rows[1, 3].reply_to, rows[1, 3].thread, rows[1, 3].level, rows[1, 3].quote_depth) == (2, 0, 2, 2)
    assert rows[1, 4].reply_to is None and rows[1, 4].thread == 4 and rows[1, 4].content == "plain"
    assert rows[2, 0].content is None and rows[2, 0].rendered == "<|user|>\n"
    assert rows[None, 1].reply_to is None


def test_equals_sql(spark):
    conversations = pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text", "level"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    want = sorted(map(repr, duckdb.sql(CHAT_SQL).fetchall()))
    got = sorted(repr(tuple(r)) for r in chat(spark.createDataFrame(ROWS, SCHEMA)).collect())
    assert got == want


def test_empty(spark):
    assert chat(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_quotations_link_where_no_longer_one_does(spark):
    rows = [(1, 0, "a", "Yes, ok", 9), (1, 1, "b", "Another and much longer text", 9), (1, 2, "a", "> Yes, ok\nfine", 9), (1, 3, "b", "> Yes, ok\n\n> Another and much longer text\nso", 9)]
    out = {r.turn: r.reply_to for r in chat(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {0: None, 1: None, 2: 0, 3: 1}


def test_mail_threads_are_linked_as_they_were_made(spark):
    rows = [(c, t, "user", f"Message {t} of {c} has\ntwo lines.", 9) for c in range(3) for t in range(12)] + [(9, 1, None, None, 9), (None, 1, "x", "y", 9), (9, None, "x", "y", 9)]
    out = chat(as_mail(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.conv_id in (0, 1, 2):
            want = None if r.turn % 4 == 0 else r.turn - (2 if r.turn % 3 == 2 else 1)
            assert r.reply_to == want and r.content == f"Message {r.turn} of {r.conv_id} has\ntwo lines."
    assert max(r.level for r in out) >= 3 and max(r.quote_depth for r in out) == 2
