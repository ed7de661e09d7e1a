import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewalk.llm import forest
from tidewalk.llm.decontaminate import common_in_order, contaminated, without_benchmark
from tidewalk.llm.sharding import shard

from .common_rows import SCHEMA, documents, words

VECTORS = "vec_id long, embedding array<float>, label int, block long, dim int"


def plain_shards(rows, shards):
    """The same rule in one loop: rows in the order of two hashes, cut where the running total passes a target."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    ordered = sorted((md5(t or ""), "" if i is None else md5(str(i)), i or 0, i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    total, at, out, slots = sum(x[4] for x in ordered), 0, [], Counter()
    for _, _, _, i, size, crc in ordered:
        s = at * shards // total
        out.append((i, size, crc, "bytes", s, slots[s], None))
        slots[s] += 1
        at += size
    return out


def test_shards_equal_brute_force(spark):
    rows = documents() + [(10_000 + i, "same text", "en", 1, 2, 3, "g") for i in range(700)] + [(20_000 + i, " ".join(words(i, 30)), "en", 1, 2, 3, "g") for i in range(400)]
    rows += [(30_000 + i, f"text {i % 90}", "en", 1, 2, 3, "g") for i in range(3600)] + [(None, "same text", "en", 1, 2, 3, "g")] * 3 + [(5, "same text", "en", 1, 2, 3, "g")] * 200
    got = [tuple(r) for r in shard(spark.createDataFrame(rows, SCHEMA), 8).collect()]
    assert sorted(got, key=repr) == sorted(plain_shards([r[:2] for r in rows], 8), key=repr)
    per = Counter()
    for r in got:
        per[r[4]] += r[1]
    assert max(per.values()) - sum(per.values()) / 8 <= max(r[1] for r in got) and set(per) == set(range(8))
    by = {}
    for r in got:
        by.setdefault(r[2], set()).add(r[4])
    assert sum(len(s) - 1 for s in by.values()) <= 7  # a group is split by a cut only
    assert shard(spark.createDataFrame([], SCHEMA)).count() == 0


def brute(rows, q, x, k=10):
    found = sorted((float(np.sqrt(((np.array(v, float) - np.array(x, float)) ** 2).sum())), i) for i, v in {(i, tuple(v)) for i, v in rows} if (i, v) != (q, tuple(x)) and len(v) == len(x))
    return found[:k]


def test_exact_search_of_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i * 10, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    good += [(7000 + i, good[0][1]) for i in range(40)] + [(-100, [1.0] * 3), (-200, [2.0] * 3), (100, [0.0, 5.0] * 4), (200, good[7][1])]
    bad = [(300_000, None), (300_100, [0.0] * 8), (300_200, [float("nan")] + [1.0] * 7), (None, [1.0] * 8), (300_300, []), (300_400, [None] + [1.0] * 7)]
    frame = spark.createDataFrame([(i, v, 1, 1, 1) for i, v in [*good, good[3], *bad]], VECTORS)
    got = {}
    for r in forest.nearest(frame, miss=0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], round(r.score, 9), r.vec_id))
    want = {}
    for q, x in good:
        if q % 100 == 0:
            want.setdefault(q, []).extend((n + 1, round(s, 9), i) for n, (s, i) in enumerate(brute(good, q, x)))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items()}
    assert forest.nearest(frame.limit(0)).count() == 0


def isotropic(n, rng):
    x = rng.normal(size=(n, 64))
    return x / np.linalg.norm(x, axis=1)[:, None]


def clustered(n, rng):
    return isotropic(n // 50, rng)[rng.integers(0, n // 50, n)] + 0.05 * rng.normal(size=(n, 64))


@pytest.mark.parametrize(("made", "n", "most"), [(isotropic, 500, 0.9), (isotropic, 4_000, 0.75), (isotropic, 12_000, 0.6), (clustered, 500, 0.2), (clustered, 4_000, 0.2), (clustered, 12_000, 0.2)])
def test_recall_and_share_of_rows_ranked(made, n, most):
    x = made(n, np.random.default_rng(n))
    hits, share = [], []
    for q, (rows, score) in zip(range(0, n, 100), forest.Forest(x).search(x[::100], 10, forest.MISS), strict=True):
        true = np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:11]
        hits.append(len(set(true) & set(rows[np.argsort(score, kind="stable")[:11]].tolist())) - 1)
        share.append(len(rows) / n)
    assert np.mean(hits) >= 9 and np.mean(share) <= most


def test_recall_of_the_whole_search(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = frame.toPandas()
    x, ids = np.stack(table.embedding.to_numpy()).astype(float), table.vec_id.to_numpy()
    out = forest.nearest(frame).toPandas()
    hits = []
    for q, found in out.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits.append(len(set(ids[np.lexsort((ids, d))[:10]]) & set(found.vec_id)) / 10)
    assert np.mean(hits) >= 0.9 and len(hits) == (ids % 100 == 0).sum()


def test_benchmark_passages_are_found(spark):
    items = [(i, " ".join(words(100 + i, 16 + 4 * i)).capitalize() + ". The answer is " + f"w{i}x.") for i in range(8)]
    rows = [(i, " ".join(words(200 + i, 150) + items[i % 8][1].split() + words(300 + i, 90)), "en", 1, 2, 3, "g") for i in range(16)]
    loose = items[5][1].split()
    loose[3::7] = ["other"] * len(loose[3::7])
    rows += [(50, " ".join(words(400, 60) + loose), "en", 1, 2, 3, "g"), (51, " ".join(words(500, 400)), "en", 1, 2, 3, "g"), *documents()]
    bench = [*items, (90, None), (91, ""), (None, "a b c"), (92, " .. ")]
    frame, benchmark = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(frame, benchmark).collect()}
    assert got == {(i, i % 8) for i in range(16)} | {(50, 5)}
    frame = frame.union(spark.createDataFrame([(None, rows[0][1], *rows[0][2:]), (0, "clean text", *rows[0][2:])], SCHEMA))
    kept = without_benchmark(frame, benchmark)  # row by row, whatever the id
    assert kept.columns == frame.columns and kept.count() == len(rows) - 17 + 1
    assert [r.text for r in kept.where("doc_id = 0").collect()] == ["clean text"]
    assert contaminated(frame, benchmark.limit(0)).count() == 0 and contaminated(frame.limit(0), benchmark).count() == 0


def test_common_subsequence():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(0, 6, 12), rng.integers(0, 6, 20)
        assert common_in_order(a, b) == plain(a, b)


def test_an_item_in_a_third_of_short_documents_is_found(spark):
    item = " ".join(words(7, 24)) + ". The answer is w7x."
    rows = [(i, " ".join(words(1000 + i, 30) + (item.split() if i % 3 == 0 else []) + words(2000 + i, 20)), "en", 1, 2, 3, "g") for i in range(90)]
    found = contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in found.collect()} == set(range(0, 90, 3))


def test_paraphrases_are_found_wherever_the_subsequence_rule_holds(spark):
    rng = np.random.default_rng(8)
    texts = [t for t in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").limit(3_000).toPandas().text if t]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").orderBy("item_id").collect()]
    pool, rows, want = " ".join(texts[:500]).split(), list(enumerate(texts)), (set(), set())
    for k, (item, text) in enumerate(items * 2):
        own, last = text.split(), len(re.split(r"[.?!:\n]", text.strip().rstrip(".?!:"))[-1].split())
        keep = {*range(len(own) - last, len(own)), *rng.choice(len(own) - last, max(0, min(len(own) - last, int(np.ceil(0.6 * len(own))) - last + 1)), replace=False).tolist()}
        spread = k >= len(items)  # every second word foreign besides
        loose = [x for i, w in enumerate(own) for x in (w if i in keep else pool[rng.integers(len(pool))], *[pool[rng.integers(len(pool))]] * spread)]
        host = texts[k].split()
        rows.append((100_000 + k, " ".join(host[: len(host) // 2] + loose + host[len(host) // 2 :])))
        want[spread].add((100_000 + k, item))
    found = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert want[0] | want[1] <= {(r.doc_id, r.item_id) for r in found}
    alone = {(r.doc_id, r.item_id) for r in found if r.retrieved}  # by the cosine, without the bound's help
    assert len(want[0] & alone) >= 0.9 * len(want[0]) and len(want[1] & alone) >= 0.8 * len(want[1])


def test_whole_search_equals_brute_force(spark):
    """Every passage of every document against every item, without retrieval or bound; synonyms, dropped words, turned clauses."""
    rng = np.random.default_rng(9)
    items = [(i, " ".join(words(700 + i, 14 + 3 * i, 60 if i % 2 else 4000)) + f". It is {' '.join(words(800 + i, 2 + i % 3, 90))}.") for i in range(8)]
    rows = []
    for d in range(120):
        host, own = words(900 + d, int(rng.integers(0, 120)), 60 if d % 2 else 4000), items[d % 8][1].split()
        if d % 4 == 0:
            own = [w if rng.random() < 0.75 else f"new{rng.integers(99)}" for w in own]
        elif d % 4 == 1:
            own = [w for w in own if rng.random() < 0.7]
        elif d % 4 == 2:
            cut = int(rng.integers(1, len(own)))
            own = own[cut:] + own[:cut]
        rows.append((d, " ".join(host[: len(host) // 2] + own + host[len(host) // 2 :])))
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    number: dict[str, int] = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in split(t)])
    want = set()
    for d, text in rows:
        doc = code(text)
        for i, item in items:
            own, answer = code(item), set(code(item.rstrip(".").split(".")[-1]).tolist())
            for begin in range(0, len(doc), 16):
                region = doc[max(0, begin - len(own)) : begin + 32 + len(own)]
                if common_in_order(own, region) >= 0.6 * len(own) and len(answer & set(region.tolist())) >= 0.5 * len(answer):
                    want.add((d, i))
                    break
    found = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = found.collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and 50 < len(want) < 400
    assert sum(r.retrieved for r in found) >= 0.9 * len(want)
