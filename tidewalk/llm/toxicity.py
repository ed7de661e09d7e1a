"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, id_and_text, remainder, table
from .kernel import FOLDED, U, Words, pieces

#: Labelled documents that are learned from at most (the first by a hash of the id), entries of the learned lexicon,
#: parts of the sample that are taken crosswise.
SAMPLE, LEXICON, FOLDS = 12_000, 400, 3
#: Bytes of word beginnings that lexicon entries may have; 0 is the whole word.
SIZES = (0, 4, 5, 6, 7, 8)
TREES, DEPTH, RATE, BINS, SMALLEST = 80, 3, 0.15, 32, 12
THRESHOLD = 0.7
#: Words that address the reader, in four languages, and characters that stand for letters.
SECOND_PERSON = "you your yours yourself u du dich dir dein deine sie ihr tu te toi ton ta tes vous votre vos tú ti tus usted vosotros".split()
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = ["words", "hits", "density", "kinds", "weight", "near_you", "you", "capitals", "shouted", "exclaimed", "marks", "digits", "masked", "single", "word_length", "long_runs"]

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_PLAIN = ~_LETTER
_MASKED, _UNMASK = _PLAIN.copy(), FOLDED.copy()
for _from, _to in STANDS_FOR.items():
    _MASKED[ord(_from)] = False
    _UNMASK[ord(_from)] = FOLDED[ord(_to)]


def _codes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    return np.sort(Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), FOLDED, _PLAIN).code)


_YOU = _codes(SECOND_PERSON)


def _place(codes: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Index in the sorted `among`, or -1."""
    if not len(among):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(among, codes), len(among) - 1)
    return np.where(among[at] == codes, at, -1)


def _entries(words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lexicon keys of words: number of bytes, codes, and the words' indexes."""
    for size in SIZES:
        codes, at = words.prefixes(size) if size else (words.code, np.arange(len(words.code)))
        yield size, codes + U(size), at


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each part with and without the label have each lexicon key."""
    for batch in batches:
        labels, parts = batch.column("toxic").to_numpy().astype(int), batch.column("part").to_numpy()
        found = [(np.zeros(0, U), np.zeros(0, int))]
        for rows, data, at in pieces(batch):
            words = Words(data, at, FOLDED, _PLAIN)
            text = np.repeat(np.arange(len(words.count)), words.count)
            for _, codes, index in _entries(words):
                pairs = np.unique(np.stack([codes, text[index].astype(U)]), axis=1) if len(codes) else np.zeros((2, 0), U)
                row = pairs[1].astype(int)
                found.append((pairs[0], parts[rows][row] * 2 + labels[rows][row]))
        codes, kind = (np.concatenate(x) for x in zip(*found, strict=True))
        keys, many = np.unique(np.stack([codes, kind.astype(U)]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(keys[1].astype(np.int64)), pa.array(many.astype(np.int64))], ["code", "kind", "n"])


def features(words: Words, masked: Words, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    n = len(words.count)
    data, at = words.data, words.at
    size = np.maximum(np.diff(at), 1)
    per = lambda flags: np.add.reduceat(np.append(flags, 0), at[:-1])[: len(size)] * (np.diff(at) > 0)
    text = np.repeat(np.arange(n), words.count)
    many = np.maximum(words.count, 1)

    def hits(own: Words) -> tuple[np.ndarray, np.ndarray]:
        best, key = np.zeros(len(own.code)), np.full(len(own.code), -1)
        for _, found, index in _entries(own):
            place = _place(found, codes)
            good = np.flatnonzero(place >= 0)
            better = good[weights[place[good]] > best[index[good]]]
            best[index[better]] = weights[place[better]]
            key[index[better]] = place[better]
        return best, key

    best, key = hits(words)
    hit = best > 0
    you = _place(words.code, _YOU) >= 0
    close = np.zeros(len(hit), bool)
    for step in range(1, 6):
        same = text[step:] == text[:-step]
        close[step:] |= you[:-step] & same
        close[:-step] |= you[step:] & same
    counted = lambda x: np.bincount(text, x, n)
    kinds = np.bincount(np.unique(np.stack([text[hit], key[hit]]), axis=1)[0], minlength=n) if hit.any() else np.zeros(n)
    other = np.repeat(np.arange(n), masked.count)
    masked_hits = np.maximum(np.bincount(other, hits(masked)[0] > 0, n) - counted(hit), 0)
    upper = (data >= 65) & (data <= 90)
    letters = np.maximum(per(_LETTER[data].astype(np.int64)), 1)
    length = words.end - words.start
    rise = np.concatenate([[0], np.cumsum(upper)])
    shouted = (rise[words.end] - rise[words.start] == length) & (length > 2)
    long_runs = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) if len(data) > 2 else np.zeros(0, bool)
    return np.column_stack([
        np.log1p(words.count), np.log1p(counted(hit)), counted(hit) / many, kinds, counted(best), counted(hit & close), counted(you) / many,
        per(upper.astype(np.int64)) / letters, counted(shouted) / many, per((data == 33).astype(np.int64)) / size,
        per(((data > 32) & (data < 48)).astype(np.int64)) / size, per(((data >= 48) & (data < 58)).astype(np.int64)) / size,
        np.log1p(masked_hits), counted(length == 1) / many, counted(length) / many, per(np.concatenate([long_runs, [False] * (len(data) - len(long_runs))]).astype(np.int64)) / size,
    ])


def _featured(lexicon: tuple[np.ndarray, np.ndarray], data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return features(Words(data, at, FOLDED, _PLAIN), Words(data, at, _UNMASK, _MASKED), *lexicon)


def _sampled(lexicons: list[tuple[np.ndarray, np.ndarray]]) -> Callable:
    """Features of sampled documents, each by the lexicon of the other parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, parts = np.zeros((batch.num_rows, len(FEATURES))), batch.column("part").to_numpy()
            for rows, data, at in pieces(batch):
                own = parts[rows]
                for part in np.unique(own):
                    found[rows][own == part] = _featured(lexicons[part], data, at)[own == part]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "part", "toxic")] + [pa.array(list(found), pa.list_(pa.float64()))], ["doc_id", "part", "toxic", "x"])

    return run


class Boosted:
    """Gradient-boosted regression trees of fixed depth on the logistic loss, over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(c[c != 0], np.linspace(0, 1, BINS - 1)) if (c != 0).any() else []) for c in x.T]
        rate = np.clip(y.mean() if len(y) else 0.1, 1e-3, 1 - 1e-3)
        self.base, self.trees = np.log(rate / (1 - rate)), []
        if len(y) < 2 * SMALLEST or y.min() == y.max():
            return
        bins, raw = self._bins(x), np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree, leaf = self._grow(bins, y - p, p * (1 - p))
            self.trees.append(tree)
            raw += tree[2][leaf]

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)]) if len(self.edges) else x.astype(int)

    def _grow(self, bins: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> tuple:
        feature, cut, leaf = np.zeros((1 << DEPTH) - 1, int), np.full((1 << DEPTH) - 1, BINS), np.zeros(len(bins), int)
        for node in range((1 << DEPTH) - 1):
            depth = (node + 1).bit_length() - 1
            rows = np.flatnonzero(leaf == node - (1 << depth) + 1)
            best = 1e-6
            whole = slope[rows].sum() ** 2 / (curve[rows].sum() + 1)
            for f in range(bins.shape[1]):
                own = bins[rows, f]
                g, h, n = (np.cumsum(np.bincount(own, w, BINS + 1)) for w in (slope[rows], curve[rows], None))
                gain = g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - whole
                gain[(n < SMALLEST) | (n[-1] - n < SMALLEST)] = 0
                if gain.max() > best:
                    best, feature[node], cut[node] = gain.max(), f, int(gain.argmax())
            if node == (1 << depth + 1) - 2 or depth == 0:  # the level is complete
                leaf = self._down(bins, feature, cut, depth + 1)
        g, h = np.bincount(leaf, slope, 1 << DEPTH), np.bincount(leaf, curve, 1 << DEPTH)
        return (feature, cut, RATE * g / (h + 1)), leaf

    @staticmethod
    def _down(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
        leaf, rows = np.zeros(len(bins), int), np.arange(len(bins))
        for level in range(depth):
            node = leaf + (1 << level) - 1
            leaf = 2 * leaf + (bins[rows, feature[node]] > cut[node])
        return leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins, out = self._bins(x), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            out += value[self._down(bins, feature, cut, DEPTH)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y (pool adjacent violators), shrunk by one example of each label."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for at, value in zip(x[order], y[order], strict=True):
        blocks.append([at, at, value, 1.0])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            lo, _, s, n = blocks.pop(-2)
            blocks[-1] = [lo, blocks[-1][1], blocks[-1][2] + s, blocks[-1][3] + n]
    knots = [k for b in blocks for k in (b[0], b[1])]
    value = [(b[2] + 0.1) / (b[3] + 0.2) for b in blocks for _ in range(2)]
    return np.array(knots), np.maximum.accumulate(np.array(value))


def _calibrated(raw: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    plain = 1 / (1 + np.exp(-raw))
    # a touch of the raw score keeps the order within a step
    return np.clip(0.995 * (np.interp(raw, knots, values) if len(knots) else plain) + 0.005 * plain, 0, 1)


def _lexicon(terms: DataFrame, yes: str, no: str, all_yes: int, all_no: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes, sorted, and weights of the keys whose odds of the label are high."""
    odds = F.log((F.expr(yes) + 0.5) / (all_yes + 1) / ((F.expr(no) + 0.5) / (all_no + 1)))
    top = terms.select("code", F.expr(yes).alias("yes"), odds.alias("odds")).where("yes >= 3 AND odds > 2")
    top = top.orderBy(F.desc(F.col("odds") * F.sqrt("yes")), "code").limit(LEXICON).collect()
    codes, weights = np.array([r.code for r in top], np.int64).view(U), np.array([r.odds for r in top], float)
    order = np.argsort(codes)
    return codes[order], weights[order]


def train(docs: DataFrame, labels: DataFrame) -> tuple:
    """Lexicon, trees and calibration from at most SAMPLE labelled documents, the first in the order of a hash of the id.

    The sample is taken crosswise in FOLDS parts, whatever its size: a document's features come from a lexicon of the
    other parts, its raw score for the calibration from trees of the other parts.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("long").alias("toxic"))
    chosen = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(SAMPLE)
    one = F.min_by("text", F.xxhash64("text")).alias("text")  # of an id with several texts
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "h", "toxic").agg(one)  # at most SAMPLE ids
    sample = table(sample.select("doc_id", "text", "toxic", F.pmod("h", F.lit(FOLDS)).alias("part")), "sample")
    rows = {(r.part, r.toxic): r.n for r in sample.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
    terms = sample.select("text", "toxic", "part").mapInArrow(_terms, "code long, kind long, n long")
    terms = table(terms.groupBy("code").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(2 * FOLDS))), "terms")
    size = lambda toxic, but: sum(n for (part, label), n in rows.items() if label == toxic and part != but)
    column = lambda toxic, but: " + ".join(f"n{2 * part + toxic}" for part in range(FOLDS) if part != but)
    *others, lexicon = [_lexicon(terms, column(1, but), column(0, but), size(1, but), size(0, but)) for but in [*range(FOLDS), None]]

    found = sample.mapInArrow(_sampled(others), "doc_id long, part long, toxic long, x array<double>")
    found = sorted(found.collect(), key=lambda r: r.doc_id)  # at most SAMPLE rows
    for done in (sample, terms):
        drop_table(done)
    x = np.array([r.x for r in found]).reshape(-1, len(FEATURES))
    y, part = np.array([r.toxic for r in found], float), np.array([r.part for r in found], int)
    raw = np.zeros(len(y))
    for p in range(FOLDS):
        raw[part == p] = Boosted(x[part != p], y[part != p]).raw(x[part == p])
    return lexicon, Boosted(x, y), *isotonic(raw, y)


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted.

    Features are lexicon densities (words and word beginnings whose odds of the label are high), their nearness to
    words that address the reader, capitals, punctuation and hits that only appear when look-alike characters are read
    as letters. Lexicon, trees and calibration are learned crosswise from a bounded sample. Labels are learned only
    from ids whose crc32 as text, modulo 3, is not 1.

    Null or empty texts have all features 0 and get their score too; null ids are scored; labels of unknown ids or
    null labels are ignored, and without any every score is the same. Of an id that repeats one text is learned from; all its
    rows are scored. Other columns are ignored, an empty table gives no rows.
    """
    docs = id_and_text(docs)
    learn = docs if learn_from is None else id_and_text(learn_from)
    lexicon, model, knots, values = train(learn, labels.where(remainder("doc_id", 3) != 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0), *(_calibrated(model.raw(_featured(lexicon, data, at)), knots, values) for _, data, at in pieces(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found))], ["doc_id", "score"])

    out = docs.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
