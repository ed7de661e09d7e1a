"""Language by compression: the per-language zstandard dictionary that makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, remainder

#: Training: documents a language, bytes of its dictionary, and bytes of all dictionaries (with very many languages
#: each gets its share). Texts of LEAST characters are preferred; of a longer one SLICES slices spread over it are taken.
SAMPLE, DICTIONARY, ALL, LEAST, SLICES = 200, 96_000, 24_000_000, 40, 4
#: Bytes compressed at a time, so that a text's own words don't outweigh the dictionary's.
STEP = 1024
LEVEL = 9
#: A language is rejected if its bytes are within this share of the runner-up's. On sf0.1 0.8 % of the held-out documents
#: (most under 60 bytes) and of their beginnings are, of random letters 74 % (120 bytes) to all (1,200), of two languages 20 to 34 %.
MARGIN = 0.02


_OTHER = re.compile(r"[\W\d_]+")
#: Characters under 0x10000 that Python's patterns take as word characters though they are no letters: ½, ², Ⅷ. A set of
#: their own, which is searched by a bitmap; the few texts with characters beyond are taken character by character.
_NUMBERS = re.compile(f"[{''.join(c for c in map(chr, range(128, 0x10000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())}]")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def letters(text: str) -> str:
    """The text in lower case, every run of other characters than letters as one space."""
    text = text.lower()
    if not text.isascii():
        text = _NUMBERS.sub(" ", text)
        if _BEYOND.search(text):
            text = "".join(c if c.isalpha() else " " for c in text)
    return _OTHER.sub(" ", text).strip()


def dictionaries(labelled: DataFrame, sample: int = SAMPLE) -> dict[str, bytes]:
    """Raw dictionary content by language from a bounded sample of labelled documents (doc_id, text, lang).

    Sampled are each language's first `sample` documents in the order of a hash of id and text, longer ones before
    those under LEAST characters. Every language is learned, however rare.
    """
    each = DICTIONARY // (sample * 4 // 5)
    size, one = F.length("text"), each // SLICES
    spread = [F.substr("text", (F.lit(1) + (size - one) * i / (SLICES - 1)).cast("int"), F.lit(one)) for i in range(SLICES)]
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.when(size <= each, F.col("text")).otherwise(F.concat_ws(" ", *spread)).alias("part"), (size < LEAST).alias("short"), F.xxhash64("doc_id", "text").alias("h"))
    known = known.withColumn("salt", F.pmod("h", F.lit(64)))
    for by in (["lang", "salt"], ["lang"]):  # a language with a third of all rows is cut down in 64 parts first
        known = known.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("short", "h"))).where(F.col("k") <= sample)
    texts: dict[str, list[bytes]] = {}
    for row in known.select("lang", "k", "part").orderBy("lang", "k").collect():  # `sample` rows a language
        texts.setdefault(row.lang, []).append(letters(row.part).encode())
    most = min(DICTIONARY, ALL // max(1, len(texts)))
    return {lang: b" ".join(x)[:most] for lang, x in texts.items()}


def _judge(content: dict[str, bytes]) -> Callable[[list], dict[str, list]]:
    """lang_pred, score, margin and rejected of texts."""
    names = sorted(content)
    writers = []
    for name in names:
        d = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        writers.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def one(value: str | None) -> tuple[str, float, float, bool]:
        text = letters(value or "")
        if not names or not text:
            return "und", 0.0, 0.0, True
        raw = text.encode()
        parts = [raw[i : i + STEP] for i in range(0, len(raw), STEP)]
        sizes = np.array([sum(len(w.compress(x)) for x in parts) for w in writers], float)
        margin = float(np.partition(sizes, 1)[1] / sizes.min() - 1) if len(names) > 1 else 1.0
        tied = np.flatnonzero(sizes == sizes.min())
        if len(tied) > 1:  # too short to tell by whole bytes: how often its words stand in the dictionaries
            words = [b" " + w + b" " for w in raw.split()]
            seen = [sum(np.log1p(content[names[i]].count(w)) for w in words) for i in tied]
            sizes[tied[int(np.argmax(seen))]] -= 0.5
        best = int(sizes.argmin())
        over = sizes - sizes[best]
        score = float(1 / np.exp(-np.minimum(over, 60) * min(1.0, 40 / len(parts) ** 0.5 / 8)).sum())
        return names[best], score, margin, margin < MARGIN

    def run(texts: list) -> dict[str, list]:
        found = [one(t) for t in texts]
        return {c: [f[i] for f in found] for i, c in enumerate(("lang_pred", "score", "margin", "rejected"))}

    return run


def _identified(content: dict[str, bytes]) -> Callable:
    kinds = {"lang_pred": pa.string(), "score": pa.float64(), "margin": pa.float64(), "rejected": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(content)
        for batch in batches:
            found = judge(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[c], k) for c, k in kinds.items())], ["doc_id", *kinds])

    return run


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, lang_pred, score, margin, rejected.

    Every text is cut into pieces of 1 KB, each compressed with each language's raw-content dictionary; the language
    of the smallest sum is predicted, ties to the one whose dictionary has the text's words most often (then the first
    by name). `score` falls with the bytes the runners-up are away; `rejected` marks texts without a letter and those
    of any length whose margin, 0 for a tie, is narrow.

    Null, empty or letterless texts are `und`, score 0, rejected. Without labelled documents all are `und`. Null ids
    and repeated rows are predicted row by row; other columns are ignored; an empty table gives no rows.
    """
    return id_and_text(docs).mapInArrow(_identified(dictionaries(labelled)), "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def without_rejected(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of `docs` that `identify` doesn't reject, each judged by its own text, whatever its id; columns as they are."""
    content = dictionaries(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(content)
        for batch in batches:
            texts = batch.column("text").cast(pa.string()).to_pylist()
            yield batch.filter(pa.array([not x for x in judge(texts)["rejected"]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learnable(docs: DataFrame) -> DataFrame:
    """Documents whose lang may be learned: crc32 of the id as text, modulo 4, is not 2."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(remainder("doc_id", 4) != 2)
