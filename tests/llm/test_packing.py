import zlib

import numpy as np
from tokenizers import Tokenizer

from tidewalk.llm.kernel import U
from tidewalk.llm.packing import LENGTH, VOCABULARY, WordTokens, first_fit_decreasing, pack_documents, parts_of

from .common_rows import twins

TEXTS = [
    *(f"{a} and {b}" for a, b in map(twins, (3, 10, 12))), *twins(10), *twins(12),
    "a<|endoftext|>b It's  don't !!! x.y,z 3.14 éÉ Ünï x　y é .́", "<|ENDOFTEXT|> <|endoftext|>", "THE The the.", "", "  ", None,
    "naïve—dash…? '  s", "a'\ts 'LL x'S l'!x", "İstanbul ΣΑΣ ﬁ", "word " * 9000, "w" * 30_000, "same text", "same text", "%%%,x.***",
]


def test_exact_round_trip(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "clash")]
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, grp string"), with_ids=True).toPandas()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = sorted(((i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows), key=repr)
    got = []
    for _, doc in out.sort_values(["start"]).groupby(["doc_id", "doc_tokens"], dropna=False):
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in doc["ids"]])
        got.append((None if doc.doc_id.isna().any() else int(doc.doc_id.iloc[0]), ids.tolist()))
        assert all(zlib.crc32(x) == c for x, c in zip(doc["ids"], doc.ids_crc32, strict=True))
    assert sorted(got, key=repr) == want
    for _, one in out.sort_values("offset").groupby("sequence_id"):
        assert one.offset.tolist() == [0, *np.cumsum(one.length)[:-1]] and one.length.sum() <= LENGTH


def test_tree_equals_plain_first_fit():
    lengths = np.random.default_rng(1).integers(1, 101, 400)
    bins, offsets = first_fit_decreasing(lengths, 100)
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        b = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        room += [100] * (b == len(room))
        assert (bins[i], offsets[i]) == (b, 100 - room[b])
        room[b] -= lengths[i]


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_that_share_a_code_are_told_apart():
    tokens = WordTokens(VOCABULARY)
    for text in ("first second third", "other words, then first second", "second"):
        raw = text.encode()
        words = parts_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        words.code = words.code & U(1)
        ids, ends = tokens.encode(words)
        assert ids.tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids and ends.tolist() == [0, len(ids)]


def test_rows_that_repeat_an_id_are_dealt_to_several_groups(spark):
    out = pack_documents(spark.range(20_000).selectExpr("7L AS doc_id", "'some words' AS text")).toPandas()
    assert len(out) == 20_000 and (out.sequence_id.to_numpy() >> 32).max() >= 3
    assert (out.groupby(out.sequence_id.to_numpy() >> 32).size() < 8_000).all()
