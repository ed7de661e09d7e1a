"""Benchmark passages in documents: latent retrieval, an exact bound for the rest, then longest common subsequence and answer checks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .kernel import FOLDED, U, Words, binary, pieces

#: Hashed terms, dimensions of the random sketch and of the latent space, words of a block; a passage is two blocks.
TERMS, SKETCH, LATENT, BLOCK = 1 << 15, 72, 64, 16
#: Cosine from which a passage is retrieved for an item.
COSINE = 0.3
#: Least share of an item's words in common order; least share of its answer's words.
SHARED, ANSWER = 0.6, 0.5
#: Words in at most this many items are counted sparsely in the overlap bound, all others densely.
RARE = 12
#: Benchmark items that are searched for in one pass over the documents; more take more passes.
ITEMS = 1_000
#: Rows of the term matrix that are added up together; partial sums that one task adds; passages that give a partial sum.
SLAB, FAN, SHARE = 1024, 64, 200_000

_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False


def words_of(data: np.ndarray, at: np.ndarray) -> Words:
    """Lower-cased runs of letters and digits."""
    return Words(data, at, FOLDED, _BETWEEN)


def _terms(words: Words) -> np.ndarray:
    return (words.code >> U(64 - TERMS.bit_length() + 1)).astype(np.int64)


def _blocks(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks of BLOCK words begin, and each block's text."""
    n = -(-words.count // BLOCK)
    text = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return words.first[:-1][text] + inside * BLOCK, text


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many passages (pairs of blocks that don't overlap) each term stands; the passages as term -1."""
    seen, passages = np.zeros(TERMS, np.int64), 0
    for batch in batches:
        for _, data, at in pieces(batch):
            words = words_of(data, at)
            per = -(-words.count // (2 * BLOCK))
            base = np.cumsum(per) - per
            inside = np.arange(len(words.code)) - np.repeat(words.first[:-1], words.count)
            passage = np.repeat(base, words.count) + inside // (2 * BLOCK)
            pairs = (passage * TERMS + _terms(words)).astype(np.int64 if per.sum() * TERMS >= 1 << 31 else np.int32)
            pairs.sort()
            fresh = np.concatenate([pairs[:1] >= 0, pairs[1:] != pairs[:-1]])
            seen += np.bincount(pairs[fresh] & (TERMS - 1), minlength=TERMS)
            passages += int(per.sum())
    terms = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, -1)), pa.array(np.append(seen[terms], passages))], ["term", "n"])


def _sums(table: np.ndarray, rows: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums of the table's `rows` over runs that begin at `heads`, in steps that stay in the processor's cache."""
    out = np.empty((len(heads), table.shape[1]), table.dtype)
    cuts = np.append(heads, len(rows))
    begin = 0
    while begin < len(heads):
        end = max(begin + 1, int(np.searchsorted(cuts, cuts[begin] + 2048, "right")) - 1)
        out[begin:end] = np.add.reduceat(table[rows[cuts[begin] : cuts[end]]], heads[begin:end] - cuts[begin])
        begin = end
    return out


def _passage_vectors(words: Words, weights: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Block sums of the rows of `basis` (weights included), each block's first word and text, and its squared weight."""
    begin, text = _blocks(words)
    terms = _terms(words)
    weight = weights[terms]
    some = np.flatnonzero(weight)
    cut = np.searchsorted(some, np.append(begin, len(terms)))
    sums = np.zeros((len(begin), basis.shape[1]), np.float32)
    norm = np.zeros(len(begin))
    full = np.flatnonzero(cut[:-1] < cut[1:])
    if len(full):
        sums[full] = _sums(basis, terms[some], cut[:-1][full])
        norm[full] = np.add.reduceat(weight[some].astype(float) ** 2, cut[:-1][full])
    return sums, begin, text, norm


def _range_finder(weights: np.ndarray, test: np.ndarray, fans: int) -> Callable:
    """One task's share of A' A test for the TF-IDF matrix A of its passages, in slabs of terms; tasks are dealt to `fans`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weighted = np.zeros((TERMS, SKETCH), np.float32), test * weights[:, None]
        for batch in batches:
            for _, data, at in pieces(batch):
                words = words_of(data, at)
                sums, begin, _, norm = _passage_vectors(words, weights, weighted)
                sums /= np.maximum(norm, 1e-9)[:, None].astype(np.float32)
                terms = _terms(words)
                some = np.flatnonzero(weights[terms])
                block = np.searchsorted(begin, some, "right") - 1
                by = np.argsort(terms[some].astype(np.uint16), kind="stable")  # TERMS fit; 16 bits are sorted by radix
                own = terms[some][by]
                heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
                if len(heads):
                    total[own[heads]] += _sums(sums, block[by], heads) * weights[own[heads], None]
        if total.any():
            slabs = np.arange(TERMS // SLAB)
            salt = zlib.crc32(total[:SLAB].tobytes()) % fans  # from the data, so a task that runs again sends the same rows
            yield pa.RecordBatch.from_arrays([pa.array(slabs), pa.array(np.full(len(slabs), salt)), binary([total[s * SLAB : (s + 1) * SLAB].tobytes() for s in slabs])], ["slab", "salt", "part"])

    return run


def _added(parts: pa.Table) -> pa.Table:
    total = np.zeros(SLAB * SKETCH)
    for chunk in parts.column("part").chunks:
        for x in chunk:
            total += np.frombuffer(x.as_buffer(), np.float32)
    return pa.table({"slab": parts.column("slab")[:1], "salt": pa.array([0], pa.int64()), "part": binary([total.astype(np.float32).tobytes()])})


@dataclass
class Space:
    """Weights of terms and their latent vectors, weights included."""

    weights: np.ndarray
    basis: np.ndarray


def latent_space(docs: DataFrame) -> Space:
    """Randomised SVD of the TF-IDF matrix of all passages: one pass for frequencies, one for the range.

    The driver gets a term-by-sketch matrix whose size doesn't depend on the corpus. Directions come from the Nystrom
    form of A' A and are scaled down by their singular values, so what all passages share doesn't count as likeness.
    """
    kinds = "slab long, salt long, part binary"
    weights = np.zeros(TERMS, np.float32)
    counted = docs.select("text").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = max(1, next((r.n for r in counted if r.term < 0), 1))
    for r in counted:
        if r.term >= 0:  # the commonest term still weighs log(2), so no item is without weight
            weights[r.term] = np.log(1 + n / r.n)
    test = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (TERMS, SKETCH))
    # a task sends a matrix of one size, however few its rows, so tasks are as many as passages or cores ask for
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-n // SHARE))
    parts = docs.select("text").coalesce(tasks).mapInArrow(_range_finder(weights, test, -(-tasks // FAN)), kinds)
    parts = parts.groupBy("slab", "salt").applyInArrow(_added, kinds).groupBy("slab").applyInArrow(_added, kinds)
    image = np.zeros((TERMS, SKETCH))
    for r in parts.collect():  # TERMS / SLAB rows
        image[r.slab * SLAB : (r.slab + 1) * SLAB] = np.frombuffer(r.part, np.float32).reshape(SLAB, SKETCH)
    q, _ = np.linalg.qr(image)
    core = np.linalg.lstsq((test.T.astype(float) @ q), image.T @ q, rcond=1e-8)[0]
    values, turn = np.linalg.eigh((core + core.T) / 2)
    top = np.argsort(-values)[:LATENT]
    scale = 1 / np.sqrt(np.maximum(values[top], max(1e-9, np.median(np.abs(values)))))
    basis = (q @ turn[:, top]) * scale
    return Space(weights, (basis / max(1e-9, np.abs(basis).max()) * weights[:, None]).astype(np.float32))


@dataclass
class Item:
    """A benchmark item: its words and those of its answer, the last sentence."""

    item_id: int
    codes: np.ndarray
    answer: np.ndarray
    listed: list[int]


def _items(rows: list, space: Space) -> tuple[list[Item], np.ndarray]:
    items, vectors = [], []
    for r in rows:
        raw = np.frombuffer(r.text.encode(), np.uint8)
        words = words_of(raw, np.array([0, len(raw)]))
        if len(words.code):
            stops = [i for i, c in enumerate(r.text.encode()[: int(words.start[-1])]) if c in b".?!:\n"]
            answer = words.code[words.start > stops[-1]] if stops else words.code[-max(1, len(words.code) // 4) :]
            items.append(Item(r.item_id, words.code, np.unique(answer), words.code.tolist()))
            terms = _terms(words)
            v = space.basis[terms].sum(0)
            vectors.append(v / max(1e-12, np.linalg.norm(v)))
    return items, np.array(vectors, np.float32).reshape(len(items), -1)


def common_in_order(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a[np.isin(a, b)]:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return int(row[-1])


class Overlap:
    """An upper bound of how many of an item's words can match around a block, to check only what can be confirmed.

    Items come in the order of their length.
    """

    def __init__(self, items: list[Item]) -> None:
        code, item = (np.concatenate(x) for x in zip(*((np.unique(i.codes), np.full(len(np.unique(i.codes)), k)) for k, i in enumerate(items)), strict=True))
        by = np.argsort(code, kind="stable")
        code, item = code[by], item[by]
        self.codes, first, many = np.unique(code, return_index=True, return_counts=True)
        rare = many <= RARE
        self.lists = np.full((len(self.codes), RARE), -1)
        for k in range(RARE):
            has = rare & (many > k)
            self.lists[has, k] = item[first[has] + k]
        self.often = self.codes[~rare]
        self.repeats = np.array([[(i.codes == c).sum() for i in items] for c in self.often], np.float32).reshape(len(self.often), len(items))
        self.codes, self.lists = self.codes[rare], self.lists[rare]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.codes >> U(48)] = True
        size = np.array([len(i.codes) for i in items])
        self.needed = np.ceil(SHARED * size - 1e-9)
        self.least = np.maximum(self.needed - self.repeats.sum(0), 0).astype(np.uint16)
        self.reach = -(-size // BLOCK)
        self.n = len(items)

    def counts(self, words: Words, begin: np.ndarray) -> np.ndarray:
        """Blocks x items: occurrences of the item's rare words in a passage and the blocks around it that the item can reach."""
        at = np.flatnonzero(self.maybe[words.code >> U(48)])
        found = np.minimum(np.searchsorted(self.codes, words.code[at]), max(0, len(self.codes) - 1))
        good = self.codes[found] == words.code[at] if len(self.codes) else np.zeros(len(at), bool)
        block = np.searchsorted(begin, at[good], "right") - 1
        lists = self.lists[found[good]]
        cells = (block[:, None] * self.n + lists)[lists >= 0]
        upto = np.zeros((len(begin) + 1, self.n), np.uint16)  # differences hold although sums may wrap
        keys, many = np.unique(cells, return_counts=True)
        upto[1:].reshape(-1)[keys] = np.minimum(many, 30_000)
        np.cumsum(upto, axis=0, dtype=np.uint16, out=upto)
        n, most = len(begin), int(self.reach.max())
        padded = np.concatenate([np.repeat(upto[:1], most, 0), upto, np.repeat(upto[-1:], most + 2, 0)])
        out = np.empty((n, self.n), np.uint16)
        for reach in np.unique(self.reach):
            own = slice(*np.searchsorted(self.reach, [reach, reach + 1]))
            out[:, own] = padded[most + 2 + reach : most + 2 + reach + n, own] - padded[most - reach : most - reach + n, own]
        return out

    def possible(self, words: Words, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a block and an item that can be confirmed: rare words as often as they occur, others once for each of the item's own."""
        counts = self.counts(words, begin)
        block, item = np.nonzero(counts >= self.least)
        if not len(self.often) or not len(block):
            return block, item
        found = np.minimum(np.searchsorted(self.often, words.code), len(self.often) - 1)
        at = np.flatnonzero(self.often[found] == words.code)
        here = np.zeros((len(begin), len(self.often)), bool)
        here[np.searchsorted(begin, at, "right") - 1, found[at]] = True
        upto = np.zeros((len(begin) + 1, len(self.often)), np.int32)
        np.cumsum(here, axis=0, out=upto[1:])
        total = counts[block, item].astype(float)
        for reach in np.unique(self.reach[item]):
            own = np.flatnonzero(self.reach[item] == reach)
            rows, row = np.unique(block[own], return_inverse=True)
            columns, column = np.unique(item[own], return_inverse=True)
            around = upto[np.minimum(rows + 2 + reach, len(begin))] > upto[np.maximum(rows - reach, 0)]
            total[own] += (around.astype(np.float32) @ self.repeats[:, columns])[row, column]
        good = total >= self.needed[item]
        return block[good], item[good]


class Search:
    """Finds items in texts."""

    def __init__(self, space: Space, items: list[Item], vectors: np.ndarray) -> None:
        by_length = sorted(range(len(items)), key=lambda i: len(items[i].codes))
        self.space, self.items, self.vectors = space, [items[i] for i in by_length], vectors[by_length]
        self.overlap = Overlap(self.items)

    def _confirmed(self, words: Words, text: int, begin: int, item: Item) -> tuple[float, float] | None:
        """Shares of the item's words in order, and of its answer's, around a passage, if they are enough."""
        n = len(item.codes)
        first = max(int(words.first[text]), begin - n)
        region = words.code[first : min(int(words.first[text + 1]), begin + 2 * BLOCK + n)]
        near = set(region.tolist())
        if sum(c in near for c in item.listed) < SHARED * n:
            return None
        share, answered = common_in_order(item.codes, region) / n, float(np.isin(item.answer, region).mean())
        return (share, answered) if share >= SHARED and answered >= ANSWER else None

    def pairs(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, float, float, float, bool]]:
        """Text, item_id, cosine, the two shares, and whether the passage was retrieved by its cosine."""
        words = words_of(data, at)
        if not len(words.code):
            return
        sums, begin, text, _ = _passage_vectors(words, self.space.weights, self.space.basis)
        passage = sums.copy()
        same = text[1:] == text[:-1]
        passage[:-1][same] += sums[1:][same]
        passage /= np.maximum(np.linalg.norm(passage, axis=1), 1e-12)[:, None]
        near = passage @ self.vectors.T
        # what can't be confirmed is not looked at; of the others the retrieved ones first, by cosine, then the rest
        block, item = self.overlap.possible(words, begin)
        cosine = near[block, item]
        done: set[tuple[int, int]] = set()
        for k in np.argsort(-cosine, kind="stable"):
            b, i = int(block[k]), int(item[k])
            key = (int(text[b]), i)
            if key not in done and (shares := self._confirmed(words, key[0], int(begin[b]), self.items[i])):
                done.add(key)
                yield key[0], self.items[i].item_id, float(cosine[k]), *shares, bool(cosine[k] >= COSINE)


def _searches(docs: DataFrame, benchmark: DataFrame) -> Iterator[Search]:
    """A search for every ITEMS items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    n_blocks = -(-items.count() // ITEMS)
    space = latent_space(docs) if n_blocks else None
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).orderBy("item_id", "text").collect()
        own, vectors = _items(rows, space)
        if own:
            yield Search(space, own, vectors)


_PAIRS = {"item_id": pa.int64(), "cosine": pa.float64(), "lcs_share": pa.float64(), "answer_share": pa.float64(), "retrieved": pa.bool_()}
_KINDS = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, retrieved boolean"


def _found(search: Search) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = [(ids[rows.start + t], *rest) for rows, data, at in pieces(batch) for t, *rest in search.pairs(data, at)]
            columns = zip(*out, strict=True) if out else [[]] * (1 + len(_PAIRS))
            kinds = [pa.int64(), *_PAIRS.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", *_PAIRS])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share, retrieved: the documents that hold a benchmark item, one row a pair.

    Passages are 32 words at every 16th. Those whose latent vector's cosine with an item's is COSINE or more are
    retrieved for it; an exact bound of how many of an item's words can match around a passage leaves out those that
    can't be confirmed, and adds those below the cosine that can, so retrieval loses nothing. A candidate is confirmed
    if 60 % of the item's words stand in the same order around the passage and half of the words of the item's answer
    (its last sentence) do too. Items are searched for in blocks of 1,000, each by a pass over all documents.

    Null, empty or wordless texts and items match nothing, nor do null ids. Repeated rows give one row a pair, with the best
    figures. Other columns are ignored; an empty table on either side gives no rows.
    """
    docs = id_and_text(docs).where("doc_id IS NOT NULL")
    found = docs.sparkSession.createDataFrame([], _KINDS)
    for search in _searches(docs, benchmark):
        found = found.union(docs.mapInArrow(_found(search), _KINDS))
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "lcs_share", "answer_share", "retrieved")))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, each judged by its own text, whatever its id; columns as they are."""

    def clean(search: Search) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                texts = pa.RecordBatch.from_arrays([batch.column("text").cast(pa.string())], ["text"])
                for rows, data, at in pieces(texts):
                    for t, *_ in search.pairs(data, at):
                        keep[rows.start + t] = False
                yield batch.filter(pa.array(keep))

        return run

    kept = docs
    for search in _searches(id_and_text(docs), benchmark):
        kept = kept.mapInArrow(clean(search), docs.schema)
    return kept
