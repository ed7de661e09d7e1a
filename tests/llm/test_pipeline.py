"""Each stage on its own input against a brute-force version, and run() against the stages one by one."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewalk.llm.common import table
from tidewalk.llm.line_dup import LINES_SQL
from tidewalk.llm.packing import VOCABULARY

from .common_rows import SCHEMA, documents
from .test_near_dup import brute_force

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = table(stage(spark, docs, SF), name)
        seen[name] = (before, docs.toPandas())
        assert name == "packing" or docs.columns == columns

    before, after = seen["language_id"]
    letters = before.text.fillna("").map(lambda t: any(map(str.isalpha, t)))
    assert set(after.doc_id) <= set(before.doc_id[letters]) and len(after) >= 0.98 * letters.sum()

    before, after = seen["line_dedup"]
    documents = before  # noqa: F841
    want = duckdb.sql(LINES_SQL).df().set_index("doc_id")
    con = duckdb.connect()
    con.register("t", after)
    got = con.execute("SELECT doc_id, md5(text) FROM t").fetchall()
    assert all(want.kept_md5[i] == h for i, h in got)
    gone = set(before.doc_id) - set(after.doc_id)
    assert all(want.n_dropped[i] > 0 for i in gone)

    before, after = seen["near_dedup"]
    groups = brute_force(list(zip(before.doc_id, before.text, strict=True)))
    assert set(after.doc_id) == {i for i, (_, c) in groups.items() if i == c}

    before, after = seen["decontaminate"]
    plain = lambda t: f" {' '.join(''.join(c if c.isalnum() or ord(c) > 127 else ' ' for c in t.lower()).split())} "
    items = [plain(t) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text]
    dirty = {i for i, t in zip(before.doc_id, before.text, strict=True) if any(x in plain(t) for x in items)}
    assert set(before.doc_id) - set(after.doc_id) == dirty

    before, after = seen["packing"]
    tokens = Tokenizer.from_file(VOCABULARY)
    want = {i: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for i, t in zip(before.doc_id, before.text, strict=True)}
    assert after.groupby("doc_id")["length"].sum().to_dict() == want and after.groupby("sequence_id")["length"].sum().max() <= 4096

    again = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "start"]
    pd.testing.assert_frame_equal(again.sort_values(key, ignore_index=True), after.sort_values(key, ignore_index=True))


def test_stages_take_awkward_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(r[0], r[1], r[2], *r[3:]) for r in documents()], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns and 0 < out.count() <= frame.count()
        assert stage(spark, frame.limit(0), SF).count() == 0


def test_stages_judge_rows_with_null_or_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    odd = [(None, None, "en"), (None, "12 34", "en"), (None, item, "en"), (7, "99", "en"), (None, "", None)]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string, lang string")).withColumn("gone", F.lit("x")).withColumn("row", F.lit(1))
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert sorted(str(r.text) for r in kept.where("doc_id IS NULL").collect()) == [item] and kept.columns == docs.columns
    assert {r.text for r in docs.where("doc_id = 7").collect()} - {r.text for r in kept.where("doc_id = 7").collect()} == {"99"}
    assert corpus_pipeline.line_dedup(spark, docs, SF).where("doc_id IS NULL").count() == 4
    assert corpus_pipeline.line_dedup(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.near_dedup(spark, docs, SF).where("doc_id IS NULL").count() == 4
    assert corpus_pipeline.decontaminate(spark, docs, SF).where("doc_id IS NULL").count() == 3
    assert corpus_pipeline.packing(spark, docs, SF).where("doc_id IS NULL").count() == 4
