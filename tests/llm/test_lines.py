import duckdb
import pandas as pd

from tidewalk.llm.line_dup import LINES_SQL, drop_recurring_lines
from tidewalk.llm.queries import op9_line_dedup

SCHEMA = "doc_id long, text string, gone string, n_lines int, whole string"
LINES = ["Posted by user17 on 2024-01-05 at noon", "Read more about the red house here", "Read more about the old house here"]


def made():
    rows = [(i, f"{chr(97 + i)} own opening words stay\n{LINES[0].replace('17', str(i))}\n\nRead more about the {w} house here\nshort one", "x", 7, "y") for i, w in enumerate("red old red big new red red tall".split())]
    rows += [(50, None, "x", 7, "y"), (51, "", "x", 7, "y"), (None, LINES[1], "x", 7, "y"), (3, rows[3][1], "x", 7, "y"), (60, "word " * 20_000, "x", 7, "y"), (61, LINES[1], None, None, None)]
    return rows


def test_recurring_lines_go_but_for_the_first_document(spark):
    out = {r.doc_id: r for r in drop_recurring_lines(spark.createDataFrame(made(), SCHEMA)).collect()}
    assert out[0].n_dropped == 0 and "Posted by" in out[0].text and "Read more" in out[0].text
    assert out[5].text == "f own opening words stay\n" and out[5].n_dropped == 3 and "short one" in out[0].text
    assert out[61].text == "" and out[61].n_dropped == 1
    assert out[50].text is None and out[50].n_lines == 0 and out[51].text == "" and out[None].text == LINES[1]
    assert out[5].gone == "x" and out[5].whole == "y" and out[60].n_dropped == 0


def test_equals_sql(spark):
    frame = spark.createDataFrame([r for r in made() if r[0] is not None and r[0] != 3], SCHEMA)
    from pyspark.sql import functions as F

    got = drop_recurring_lines(frame).select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))
    documents = pd.DataFrame([r[:2] for r in frame.collect()], columns=["doc_id", "text"])  # noqa: F841
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, duckdb.sql(LINES_SQL).fetchall()))


def test_whole_table_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(repr, map(tuple, op9_line_dedup(spark, sf).collect()))) == sorted(map(repr, con.execute(LINES_SQL).fetchall()))


def test_short_lines_recur_as_they_stand(spark):
    rows = [(i, f"Les.\n{i} 2\n  Page   7 \n\n{i} words of its own {chr(97 + i)} x{chr(97 + i)}", "x", 7, "y") for i in range(6)]
    out = {r.doc_id: (r.n_dropped, r.text) for r in drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[0] == (0, rows[0][1]) and out[3][1].split("\n")[:2] == ["3 2", ""]


def test_empty(spark):
    assert drop_recurring_lines(spark.createDataFrame([], SCHEMA)).count() == 0
