import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewalk.llm.kernel import U, Words
from tidewalk.llm.packed import unpack
from tidewalk.llm.substring_dup import Tree, _suffixes, byte_runs, distinct, in_order, ranked, used_of, without_repeats

from .common_rows import SCHEMA, documents, twins, words

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute_force(rows):
    first = {}
    for i, t in ((r[0], r[1]) for r in rows if r[0] is not None):
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    want = []
    for i, t in ((r[0], r[1]) for r in rows):
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(want, key=repr)


@pytest.mark.parametrize("most", [600_000, 100])
def test_equals_brute_force(spark, monkeypatch, most):
    rows = documents() + [(77, "a " * 40 + "end", "en", 1, 2, 3, "g"), (78, "a " * 20, "en", 1, 2, 3, "g"), (77, "other " * 20, "en", 1, 2, 3, "g")]
    passage = words(55, 60)
    rows += [(3000 + i, " ".join(words(i, 5) + passage[: 20 + i] + words(i + 1, 5)), "en", 1, 2, 3, "g") for i in range(30)]
    rows += [(4000 + i, " ".join(twins(10)[i % 2] + f" p{j}" for j in range(8)), "en", 1, 2, 3, "g") for i in range(4)]
    # one 4-word beginning in most suffixes, over several buckets
    rows += [(5000 + i, " ".join(f"at the end of x{(i + j) % 9} y{j}" for j in range(25)), "en", 1, 2, 3, "g") for i in range(40)]
    if most == 100:
        monkeypatch.setattr("tidewalk.llm.substring_dup.DOCS", 20)
    out = without_repeats(spark.createDataFrame(rows, SCHEMA), most).collect()
    assert sorted(map(tuple, out), key=repr) == brute_force(rows)


@pytest.mark.parametrize("kept", [64, 2])
def test_repeats_of_a_bucket_whatever_shares_their_fingerprint(monkeypatch, kept):
    """Fingerprints of 4 bits between buckets; those of 2 bits stand for passages that share even a whole one."""
    whole = Words.windows
    monkeypatch.setattr(Words, "windows", lambda *a: (lambda prints, at: ((prints >> U(64 - kept)) << U(64 - kept), at))(*whole(*a)))
    rows = [(i, " ".join(words(i % 40, 20))) for i in range(120)]
    docs = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "row": pa.array(range(120), pa.int64())})
    none = pa.table({"bucket": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
    found = _suffixes(1, 4, np.zeros(0, np.int64))((pa.scalar(0),), docs, none).column("blob").to_pylist()
    got = set()
    for texts, own, at in (unpack(blob, rising=(0,)) for blob in found):
        got |= set(zip(texts[own].tolist(), at.tolist(), strict=True))
    assert got == {(i, k) for i in range(40, 120) for k in range(8)}


def test_nodes_are_the_equal_beginnings():
    rng = np.random.default_rng(6)
    passages = rng.integers(0, 3, (400, 13)).astype(np.int32)
    passages[:, 2:] = passages[rng.integers(0, 4, 400), 2:]
    tree = Tree(passages)
    rows = passages[tree.order].tolist()
    assert rows == sorted(rows)
    for depth in (1, 3, 13):
        want: dict[tuple, int] = {}
        for r in rows:
            want[tuple(r[:depth])] = want.get(tuple(r[:depth]), 0) + 1
        begin, end = tree.nodes(depth)
        assert sorted((tuple(rows[b][:depth]), e - b) for b, e in zip(begin, end, strict=True)) == sorted((k, n) for k, n in want.items() if n > 1)


@pytest.mark.parametrize("most", [2, 60, 70_000, 2**31 - 1])
def test_order_of_passages_by_several_words_at_once(most):
    rng = np.random.default_rng(8)
    passages = rng.integers(0, most, (500, 13)).astype(np.int32)
    passages[100:300, : rng.integers(1, 13)] = passages[0, :1]
    passages[300:, :11] = passages[rng.integers(0, 5, 200), :11]
    assert passages[in_order(passages)].tolist() == sorted(passages.tolist())
    assert len(in_order(passages[:0])) == 0


@pytest.mark.parametrize("n", [0, 1, 700])
def test_numbers_told_apart_by_sorting(n):
    x = np.random.default_rng(9).integers(0, 50, n)
    want, back = np.unique(x, return_inverse=True)
    assert distinct(x).tolist() == want.tolist()
    first, rank = ranked(x)
    assert x[first].tolist() == want.tolist() and rank.tolist() == back.tolist()
    for under in (50, 10_000):  # by a table, and by sorting
        used, rank = used_of(x, under)
        assert used.tolist() == want.tolist() and rank.tolist() == back.tolist()


def test_byte_runs():
    raw = "ä bc  d".encode()
    assert byte_runs(np.frombuffer(raw, np.uint8), np.array([0, 3, 7]), np.array([2, 5, 8])).to_pylist() == [b"\xc3\xa4", b"bc", b"d"]
    assert len(byte_runs(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_empty(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
