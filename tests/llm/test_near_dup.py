import itertools
import re

import numpy as np
from pyspark.sql import functions as F

from tidewalk.llm.graph import components
from tidewalk.llm.near_dup import _classes, near_duplicates, registers, similarity, without_near_duplicates

from .common_rows import SCHEMA, documents, twins

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_force(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_equals_brute_force(spark):
    rows = documents()
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute_force([r[:2] for r in rows])
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_random_families_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for family in range(12):
        base = [f"v{x}" for x in rng.integers(0, 500, 90)]
        for _ in range(8):
            copy = [w if rng.random() > 0.03 * (family % 4) else f"v{rng.integers(0, 500)}" for w in base]
            rows.append((len(rows), " ".join(copy)))
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_force(rows)


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]
    got = similarity(registers(a)[None], registers(b)[None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(got - 0.6) < 0.15
    assert (np.maximum(registers(a), registers(b)) == registers(np.union1d(a, b))).all()


def test_components_of_a_long_chain(spark):
    links = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in components(links).collect()} == {0}


def test_filter_keeps_columns_and_empty_table(spark):
    frame = spark.createDataFrame(documents(), SCHEMA)
    assert without_near_duplicates(frame).columns == frame.columns
    assert near_duplicates(frame.limit(0)).count() == 0


def test_regular_words_are_told_apart(spark):
    rows = [(2 * k + i, " ".join(f"{word} {x}" for x in "pqrst")) for k, order in enumerate((3, 10, 12)) for i, word in enumerate(twins(order))]
    assert all(r.component_id == r.doc_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_sets_that_share_a_key_stay_apart(spark):
    rows = [(1, 11, 5, 7, 70, b"a"), (2, 12, 5, 7, 70, b"a"), (3, 13, 6, 7, 71, b"b"), (4, 14, 9, 8, 80, b"c"), (5, 15, 0, None, None, None)]
    rows, classes = _classes(spark.createDataFrame(rows, "doc_id long, t long, n long, key long, check long, regs binary"))
    assert sorted((r.rep.doc_id, r.n) for r in classes.collect()) == [(1, 5), (3, 6), (4, 9)]
    by = {r.doc_id: r.key for r in rows.collect()}
    assert by[1] == by[2] != by[3] and by[5] is None


def test_an_id_with_several_texts_is_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b), (5, None), (10, c), (10, ""), (12, c)]
    out = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(3, 26, 3), (5, 0, 5), (5, 26, 3), (5, 26, 3), (9, 26, 3), (10, 0, 10), (10, 26, 10), (12, 26, 10)]


def test_links_at_the_limit_are_found(spark):
    rng, rows = np.random.default_rng(12), []
    for k in range(300):  # 42 shared of 56 shingles
        base = [f"v{x}" for x in rng.choice(10**6, 53, replace=False)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[7:] + [f"x{k}y{i}" for i in range(7)]))]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_force(rows)
    assert sum(r.component_id != r.doc_id for r in out) == 300
