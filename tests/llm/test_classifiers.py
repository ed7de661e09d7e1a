import random
import re
import zlib

import numpy as np
import zstandard

from tidewalk.llm.language import dictionaries, identify, learnable, letters, without_rejected
from tidewalk.llm.kernel import FOLDED, U, Words
from tidewalk.llm.toxicity import _MASKED, _PLAIN, _UNMASK, FEATURES, SECOND_PERSON, STANDS_FOR, _codes, features, isotonic, score_toxicity

from .common_rows import SCHEMA, documents

SF = "/root/testdata/sf0.1"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = identify(docs, learnable(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    held = out[out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)]
    assert (held.lang == held.lang_pred).mean() >= 0.98
    assert out.rejected.mean() < 0.01 and out.score.between(0, 1).all()


def test_language_of_awkward_rows(spark):
    frame = spark.createDataFrame([*documents(), (5, "12 !! 34", "en", 1, 2, 3, "g"), (6, "½ ² Ⅷ ٣ _ 〇", "en", 1, 2, 3, "g")], SCHEMA)
    rows = {r.doc_id: r for r in identify(frame, learnable(frame)).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].rejected and rows[i].score == 0 for i in (96, 95, 94, 5, 6))
    assert rows[100].lang_pred == "en" and identify(frame.limit(0), learnable(frame)).count() == 0
    assert {r.lang_pred for r in identify(frame, learnable(frame).limit(0)).collect()} == {"und"}


def test_letters_are_those_of_unicode():
    for c in map(chr, range(0x3000)):
        assert bool(letters(c)) == any(x.isalpha() for x in c.lower())


def test_every_language_is_learned_from_all_parts_of_its_texts(spark):
    rng = random.Random(1)
    vocabulary = [["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(40)] for _ in range(70)]
    text = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    rows = [(100 * k + i, text(k, 60), f"l{k:02}") for k in range(70) for i in range(3)] + [(9000, "q" * 30_000 + " ending words", "l70"), (9001, "tiny", "l71")]
    content = dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(content) == 72 and b"ending words" in content["l70"] and content["l71"] == b"tiny"
    ask = spark.createDataFrame([(k, text(k, 30)) for k in range(70)], "doc_id long, text string")
    out = identify(ask, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == f"l{r.doc_id:02}" and not r.rejected for r in out)


def plain_language(text, content):
    """Compressed sizes without pieces kept apart by the operator: the same rule, written out for one text."""
    clean = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    if not clean:
        return "und", True
    sizes = {}
    for lang, raw in content.items():
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=9)
        w, raw_text = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False), clean.encode()
        sizes[lang] = sum(len(w.compress(raw_text[i : i + 1024])) for i in range(0, len(raw_text), 1024))
    first, second = sorted(sizes.values())[:2]
    return [lang for lang in sorted(sizes) if sizes[lang] == first], second < first * 1.02


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(300)
    content = dictionaries(learnable(docs))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in identify(docs, learnable(docs)).collect():
        best, narrow = plain_language(texts[r.doc_id], content)
        assert r.lang_pred in best and r.rejected == narrow


def test_rows_are_rejected_one_by_one(spark):
    frame = spark.createDataFrame([*documents(), (None, "12", "en", 1, 2, 3, "g"), (100, "34", "en", 1, 2, 3, "g")], SCHEMA)
    gone = {(r.doc_id, r.text) for r in frame.collect()} - {(r.doc_id, r.text) for r in without_rejected(frame, learnable(frame)).collect()}
    assert gone == {(96, None), (95, ""), (94, " \t\n"), (None, "12"), (100, "34")}


def test_narrow_margins_are_rejected_and_clean_texts_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng, held = random.Random(5), [(r.lang, r.text) for r in docs.orderBy("doc_id").collect() if r.text and len(r.text) >= 400 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    clean = [x for _, t in held for x in (t, t[:150])]
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for n in (120, 300, 600, 1200) for _ in range(50)]
    by = {lang: [t.split() for x, t in held if x == lang] for lang in {x for x, _ in held}}
    mixed = []
    for _ in range(200):
        a, b = rng.sample(sorted(by), 2)
        mixed.append(" ".join(w for z in zip(rng.choice(by[a])[:60], rng.choice(by[b])[:60]) for w in z))  # noqa: B905
    rows = [(i, t) for i, t in enumerate(clean + junk + mixed)]
    out = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string"), learnable(docs)).collect()}
    share = lambda a, b: sum(out[i].rejected for i in range(a, b)) / (b - a)
    n = len(clean)
    assert share(0, n) <= 0.01 and share(n, n + 200) >= 0.7 and share(n + 200, n + 400) >= 0.1
    # with equal dictionaries every text is an exact tie, whatever its length
    twins = spark.createDataFrame([(i, held[0][1], lang) for i in range(3) for lang in "ab"], "doc_id long, text string, lang string")
    tied = identify(spark.createDataFrame(rows[:20], "doc_id long, text string"), twins).collect()
    assert all(r.rejected and r.margin == 0 for r in tied)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = score_toxicity(docs, labels).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3) == 1).all()
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit / held.toxic.sum() >= 0.9 and hit / max(1, held.predicted.sum()) >= 0.95


def test_toxicity_of_awkward_rows(spark):
    frame = spark.createDataFrame(documents(), SCHEMA)
    labels = spark.createDataFrame([(100, 1), (99, 0), (None, 1), (98, None), (5555, 1)], "doc_id long, toxic int")
    out = score_toxicity(frame, labels).collect()
    assert len(out) == len(documents()) and all(0 <= r.score <= 1 for r in out)
    assert score_toxicity(frame, labels.limit(0)).count() == len(documents())
    assert score_toxicity(frame.limit(0), labels).count() == 0


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    knots, values = isotonic(x, (rng.random(300) < 1 / (1 + np.exp(-x))).astype(float))
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all()


def plain_features(text, lexicon):
    """The features of one text, word by word; lexicon: weights of whole words."""
    fold = lambda w: w.translate({c: c + 32 for c in range(65, 91)})
    raw = text.encode()
    split = lambda letters: [w.decode() for w in re.findall(letters, raw)]
    words, masked = split(rb"[A-Za-z\x80-\xff]+"), split(rb"[A-Za-z\x80-\xff013457@$!]+")
    hit = [fold(w) in lexicon for w in words]
    hidden = sum("".join(STANDS_FOR.get(c, c) for c in fold(w)) in lexicon for w in masked)
    you = [fold(w) in SECOND_PERSON for w in words]
    n, size = len(words), max(len(raw), 1)
    near = [h and any(you[max(0, i - 5) : i] + you[i + 1 : i + 6]) for i, h in enumerate(hit)]
    letters = max(sum(len(w.encode()) for w in words), 1)
    at = lambda f: sum(map(f, raw))
    many = max(n, 1)
    return [
        np.log1p(n), np.log1p(sum(hit)), sum(hit) / many, len({fold(w) for w, h in zip(words, hit) if h}), sum(lexicon.get(fold(w), 0) for w in words),  # noqa: B905
        sum(near), sum(you) / many, at(lambda b: 65 <= b <= 90) / letters, sum(len(w) > 2 and w.isascii() and w.isupper() for w in words) / many,
        at(lambda b: b == 33) / size, at(lambda b: 32 < b < 48) / size, at(lambda b: 48 <= b < 58) / size, np.log1p(max(hidden - sum(hit), 0)),
        sum(len(w.encode()) == 1 for w in words) / many, sum(len(w.encode()) for w in words) / many, sum(a == b == c for a, b, c in zip(raw, raw[1:], raw[2:])) / size,  # noqa: B905
    ]


def test_features_equal_brute_force():
    lexicon = {"idiot": 3.0, "stupid": 2.5, "hat": 2.2}
    texts = ["You are an IDIOT, stupid!!!", "", "a hat on your head, st0pid 1d10t $tup1d", "nothing here", "HAT hat HAT tu es Hat", "été 123 ... @@@ x" * 40]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    codes = _codes(list(lexicon))
    weights = np.empty(len(codes))
    for w, value in lexicon.items():
        weights[np.searchsorted(codes, _codes([w])[0])] = value
    got = features(Words(data, at, FOLDED, _PLAIN), Words(data, at, _UNMASK, _MASKED), codes + U(0), weights)
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, plain_features(text, lexicon)), dict(zip(FEATURES, zip(row, plain_features(text, lexicon)), strict=True))  # noqa: B905


def test_an_id_with_many_rows_is_learned_from_once(spark):
    docs = spark.range(3_000).selectExpr("id % 3 AS doc_id", "concat('text ', id) AS text")
    assert score_toxicity(docs, spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, toxic int")).count() == 3_000


def test_few_labels_are_learned_crosswise(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common, bad = [word() for _ in range(300)], ["grumbel", "fnarkel", "zorbel"]
    rows = [(i, " ".join(rng.choices(common, k=40) + (rng.choices(bad, k=4) if i % 4 == 0 else []))) for i in range(600)]
    out = score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")).collect()
    held = [r for r in out if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) >= 0.98
