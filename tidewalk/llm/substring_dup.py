"""Repeated passages by suffix trees over groups of suffixes that share a variable-length prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, drop_table, id_and_text, table
from .kernel import EXACT, SPACE, U, Words, binary, mix, pieces
from .packed import pack, unpack

WINDOW = 13
#: Suffixes of a tree, fingerprints that one task compares, bytes and documents of a bucket, buckets of a task.
GROUP, RANGE, BYTES, DOCS, TOGETHER = 600_000, 2_000_000, 4_000_000, 4_000, 4
#: Bits of a word in a prefix, words in the longest one, bits that a prefix is lengthened by.
BITS, LONGEST, MORE = 6, 10, 2


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers in order; numpy's own goes through a hash table, which takes far longer than a sort."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different number stands, in the numbers' order, and the rank of each."""
    by = np.argsort(x)
    head = np.concatenate([[True], x[by[1:]] != x[by[:-1]]])[: len(x)]
    rank = np.empty(len(x), np.int64)
    rank[by] = np.cumsum(head) - 1
    return by[head], rank


def used_of(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers of x, which are under n, and each one's rank."""
    if 4 * x.size < n:
        first, rank = ranked(x.ravel())
        return x.ravel()[first], rank.reshape(x.shape)
    met = np.zeros(n, bool)
    met[x] = True
    return np.flatnonzero(met), (np.cumsum(met) - 1)[x]


def byte_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes from each start to its end."""
    at = np.concatenate([[0], np.cumsum(end - start)])
    own = data[np.arange(at[-1]) + np.repeat(start - at[:-1], end - start)]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(own)])


class Bucket:
    """The texts of a bucket: their words, and each window's fingerprint, text and place."""

    def __init__(self, docs: pa.Table, bits: int) -> None:
        """bits: those of a fingerprint that buckets tell one another; inside a bucket all are compared."""
        self.short = U(64 - bits)
        self.words: list[Words] = []
        ids, numbers, prints, texts, places, runs, n = [], [], [], [], [], [], 0
        for batch in docs.to_batches():
            own = batch.column("doc_id")
            for rows, data, at in pieces(batch):
                words = Words(data, at, EXACT)
                fingerprints, begin = words.windows(WINDOW, 21)
                text = np.searchsorted(words.first, begin, "right") - 1
                known = own.slice(rows.start, rows.stop - rows.start).is_valid().to_numpy(zero_copy_only=False)
                keep = known[text]  # null ids neither cause nor suffer removals
                prints.append(fingerprints[keep])
                texts.append(text[keep] + n)
                places.append((begin - words.first[text])[keep])
                runs.append(np.stack([np.full(keep.sum(), len(self.words)), begin[keep]], 1))
                self.words.append(words)
                n += len(words.count)
            ids.append(own.fill_null(0).to_numpy())
            numbers.append(batch.column("row").to_numpy())
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.ids, self.rows = join(ids, np.int64), join(numbers, np.int64)
        self.prints, self.text, self.place = join(prints, U), join(texts, np.int64), join(places, np.int64)
        self.run = np.concatenate(runs) if runs else np.zeros((0, 2), np.int64)

    def paths(self, at: np.ndarray) -> np.ndarray:
        """The windows' leading words, as `paths` has them."""
        out = np.zeros(len(at), U)
        for k, words in enumerate(self.words):
            own = np.flatnonzero(self.run[at, 0] == k)
            out[own] = paths(words.code[self.run[at[own], 1][:, None] + np.arange(LONGEST)])
        return out

    def passages(self, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """The words of windows, as numbers (windows x WINDOW), and what the numbers mean, in the order of bytes."""
        listed, n = [byte_runs(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        out = np.empty((len(at), WINDOW), np.int32)
        for k, words in enumerate(self.words):
            own = np.flatnonzero(self.run[at, 0] == k)
            if not len(own):
                continue
            begin, met = self.run[at[own], 1], np.zeros(len(words.code), bool)
            for j in range(WINDOW):
                met[begin + j] = True
            used = np.flatnonzero(met)
            code, check = words.code[used], words.checks(used)
            first, back = ranked(code)
            if (check[first][back] != check).any():  # words that share a code: all are taken one by one
                first, back = np.arange(len(used)), np.arange(len(used))
            listed.append(byte_runs(words.data, words.start[used[first]], words.end[used[first]]))
            mine = np.empty(len(words.code), np.int32)
            mine[used] = n + back
            out[own] = mine[begin[:, None] + np.arange(WINDOW)]
            n += len(first)
        found = pa.concat_arrays(listed).dictionary_encode()
        order = pc.sort_indices(found.dictionary)
        rank = np.empty(len(order), np.int32)
        rank[order.to_numpy()] = np.arange(len(order))
        return rank[found.indices.to_numpy()][out], found.dictionary.take(order)


def _leaves(ranges: int, bits: int) -> Callable:
    """A bucket's different fingerprints, for the range that each falls into."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        bucket = Bucket(docs, bits)
        prints = distinct(bucket.prints >> bucket.short)
        cuts = np.searchsorted(prints, (np.arange(1, ranges, dtype=object) * (1 << bits) // ranges).astype(U))
        keys, blobs = [], []
        for i, own in enumerate(np.split(prints, cuts)):
            if len(own):
                keys.append(i)
                blobs.append(pack(own, rising=(0,)))
        return pa.table({"range": pa.array(keys, pa.int64()), "bucket": pa.array([key[0].as_py()] * len(keys), pa.int64()), "blob": binary(blobs)})

    return run


def _shared(group: pa.Table) -> pa.Table:
    """Of a range's fingerprints those of several buckets, for each of these."""
    buckets = group.column("bucket").to_pylist()
    found = [unpack(blob, rising=(0,))[0] for blob in group.column("blob").to_pylist()]
    owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
    prints = np.concatenate(found)
    by = np.argsort(prints, kind="stable")
    prints, owner = prints[by], owner[by]
    same = prints[1:] == prints[:-1]
    several = np.zeros(len(prints), bool)
    several[1:] |= same
    several[:-1] |= same
    prints, owner = prints[several], owner[several]
    by = np.argsort(owner, kind="stable")  # keeps the fingerprints rising
    parts = [(b, x) for b, x in zip(buckets, np.split(prints[by], np.searchsorted(owner[by], np.arange(1, len(buckets)))), strict=True) if len(x)]
    return pa.table({"bucket": pa.array([b for b, _ in parts], pa.int64()), "n": pa.array([len(x) for _, x in parts], pa.int64()), "blob": binary([pack(x, rising=(0,)) for _, x in parts])})


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if not len(x) or x.max() < 65_536 else np.uint32)


def _hits(rows: np.ndarray, at: np.ndarray) -> bytes:
    """Places of texts: the texts' rows, then each place's text and word."""
    texts, own = np.unique(rows, return_inverse=True)
    return pack(texts.view(U), _small(own), _small(at), rising=(0,))


def paths(codes: np.ndarray) -> np.ndarray:
    """The leading LONGEST words of passages (by their words' codes) as one number, BITS a word, so that a prefix is a number's leading bits."""
    out = np.zeros(len(codes), U)
    for k in range(LONGEST):
        out = (out << U(BITS)) | (codes[:, k] >> U(64 - BITS))
    return out


def cells(width: int, path: np.ndarray) -> np.ndarray:
    """The prefixes of `width` bits, each told from shorter and longer ones by a leading 1."""
    return ((path >> U(BITS * LONGEST - width)) | U(1 << width)).astype(np.int64)


def dealt_cells(width: int, path: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Each path's shortest prefix, of `width` bits or MORE and MORE, that isn't heavy (or else its longest)."""
    cell = cells(width, path)
    while len(heavy) and width < BITS * LONGEST:
        width = min(BITS * LONGEST, width + MORE)
        more = np.isin(cell, heavy)
        if not more.any():
            break
        cell[more] = cells(width, path[more])
    return cell


def _blobs(cell: np.ndarray, path: np.ndarray, ids: np.ndarray, rows: np.ndarray, text: np.ndarray, at: np.ndarray, passages: np.ndarray, words: pa.Array) -> Iterator[tuple[int, bytes]]:
    """By cell the suffixes, with the words they are made of."""
    by = np.lexsort((path, cell))  # neighbours begin alike, which packs better
    for own in np.split(by, np.flatnonzero(np.diff(cell[by])) + 1):
        if len(own):
            used, symbol = used_of(passages[own], len(words))
            texts, mine = used_of(text[own], len(rows))
            listed = pa.LargeListArray.from_arrays([0, len(used)], words.take(pa.array(used)))
            raw = np.frombuffer(pc.binary_join(listed, pa.scalar(b" ", pa.large_binary()))[0].as_buffer(), np.uint8)
            symbol = _small(symbol)
            yield int(cell[own[0]]), pack(ids[texts].view(U), rows[texts].view(U), _small(mine), _small(at[own]), raw, *np.ascontiguousarray(symbol.T), rising=(0, 1))


def _opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    ids, rows, mine, at, raw, *symbol = unpack(blob, rising=(0, 1))
    apart = np.flatnonzero(raw == 32)
    words = byte_runs(raw, np.append(0, apart + 1), np.append(apart, len(raw)))
    return ids.view(np.int64), rows.view(np.int64), mine.astype(np.int64), at.astype(np.int64), words, np.stack(symbol, 1).astype(np.int32)


def _abroad(bucket: Bucket, shared: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The order of a bucket's windows by fingerprint, and which of them, in that order, other buckets may have."""
    prints = [unpack(blob, rising=(0,))[0] for blob in shared.column("blob").to_pylist()]
    prints = np.sort(np.concatenate(prints)) if prints else np.zeros(0, U)
    by = np.argsort(bucket.prints)
    own = bucket.prints[by] >> bucket.short
    place = np.minimum(np.searchsorted(prints, own), max(0, len(prints) - 1))
    return by, prints[place] == own if len(prints) else np.zeros(len(own), bool)


def _counted(width: int, bits: int, least: int) -> Callable:
    """How many of a bucket's suffixes that others may have begin with each prefix of `width` bits, and, under prefixes of `least` or more, with longer ones."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        bucket = Bucket(docs, bits)
        by, far = _abroad(bucket, shared)
        at = by[far]
        fresh = np.concatenate([[True], bucket.prints[at[1:]] != bucket.prints[at[:-1]]])[: len(at)]
        path, out, at_width = bucket.paths(at[fresh]), [], width
        while len(path):
            cell, back, many = np.unique(cells(at_width, path), return_inverse=True, return_counts=True)
            out.append((cell, many))
            path = path[many[back] >= least]
            if at_width == BITS * LONGEST:
                break
            at_width = min(BITS * LONGEST, at_width + MORE)
        cell, many = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int))
        return pa.table({"cell": pa.array(cell, pa.int64()), "n": pa.array(many, pa.int64())})

    return run


def _suffixes(width: int, bits: int, heavy: np.ndarray) -> Callable:
    """A bucket's suffixes that other texts may share, by the prefix they begin with, and those that it knows to repeat.

    Of equal passages only those of the bucket's smallest id go to the trees, if other buckets may have them too.
    Known repeats come under a negative cell, the bucket's own.
    """

    def run(key: tuple, docs: pa.Table, shared: pa.Table) -> pa.Table:
        bucket, number = Bucket(docs, bits), key[0].as_py()
        by, far = _abroad(bucket, shared)
        prints = bucket.prints[by]
        maybe, again = far.copy(), prints[1:] == prints[:-1]
        maybe[1:] |= again
        maybe[:-1] |= again
        at, prints, far = by[maybe], prints[maybe], far[maybe]
        out: list[tuple[int, bytes]] = []
        if len(at):
            passages, words = bucket.passages(at)
            # equal fingerprints are only taken as one passage where the words are equal
            fresh, other = prints[1:] != prints[:-1], (passages[1:] != passages[:-1]).any(1)
            if (other & ~fresh).any():  # passages that share a fingerprint may alternate: equal ones are put together
                by = np.lexsort((*passages.T[::-1], prints))
                at, prints, far, passages = at[by], prints[by], far[by], passages[by]
                fresh, other = prints[1:] != prints[:-1], (passages[1:] != passages[:-1]).any(1)
            owner = bucket.ids[bucket.text[at]]
            heads = np.flatnonzero(np.concatenate([[True], fresh | other]))
            least = np.repeat(np.minimum.reduceat(owner, heads), np.diff([*heads, len(at)]))
            known, left = at[owner > least], np.flatnonzero((owner == least) & far)
            if len(known):
                out.append((-1 - number, _hits(bucket.rows[bucket.text[known]], bucket.place[known])))
            path = bucket.paths(at[left])
            out += _blobs(dealt_cells(width, path, heavy), path, bucket.ids, bucket.rows, bucket.text[at[left]], bucket.place[at[left]], passages[left], words)
        return pa.table({"cell": pa.array([x[0] for x in out], pa.int64()), "bucket": pa.array([number] * len(out), pa.int64()), "blob": binary([x[1] for x in out])})

    return run


def in_order(passages: np.ndarray) -> np.ndarray:
    """The lexicographic order: by as many words as 64 bits hold, then, of those alike so far, by as many more."""
    bits = max(1, int(passages.max(initial=0)).bit_length())
    order, head = np.arange(len(passages)), np.arange(len(passages)) == 0
    for k in range(0, WINDOW, 64 // bits):
        alike = ~head
        alike[:-1] |= alike[1:]
        at = np.flatnonzero(alike)
        if not len(at):
            break
        own, key = order[at], np.zeros(len(at), U)
        for column in passages[own, k : k + 64 // bits].T:
            key = (key << U(bits)) | column.astype(U)
        both = (np.cumsum(head)[at].astype(U) << U(32)) | ranked(key)[1].astype(U)
        by = np.argsort(both)
        order[at], both = own[by], both[by]
        head[at[1:]] = both[1:] != both[:-1]
    return order


class Tree:
    """A suffix tree down to depth WINDOW, as suffix array and longest common prefixes of neighbours."""

    def __init__(self, passages: np.ndarray) -> None:
        self.order = in_order(passages)
        passages = passages[self.order]
        differ = passages[1:] != passages[:-1]
        self.common = np.where(differ.any(1), differ.argmax(1), WINDOW)

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The topmost inner nodes of `depth` words or more: where their leaves begin and end in the order."""
        deep = np.concatenate([[False], self.common >= depth, [False]]).astype(np.int8)
        step = np.diff(deep)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1


class _Held:
    """Suffixes under one prefix, from several buckets."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.n = 0

    def add(self, bucket: int, blob: bytes) -> None:
        ids, rows, mine, at, words, passages = _opened(blob)
        self.parts.append((np.full(len(mine), bucket), ids[mine], rows[mine], at, words, passages))
        self.n += len(mine)

    def repeats(self) -> Iterator[tuple[int, bytes]]:
        """By bucket the suffixes under deep inner nodes but for those of the node's smallest id, which stay held."""
        words = pa.concat_arrays([p[4] for p in self.parts]).dictionary_encode()
        number, base, passages = words.indices.to_numpy().astype(np.int32), 0, []
        for p in self.parts:
            passages.append(number[base + p[5]])
            base += len(p[4])
        passages = np.concatenate(passages)
        bucket, ids, rows, at = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        tree = Tree(passages)
        begin, end = tree.nodes(WINDOW)
        leaf = np.repeat(begin - np.cumsum(end - begin) + end - begin, end - begin) + np.arange((end - begin).sum())
        under = tree.order[leaf]
        starts = np.cumsum(end - begin) - (end - begin)
        least = np.repeat(np.minimum.reduceat(ids[under], starts), end - begin) if len(under) else ids[under]
        hit = under[ids[under] > least]
        stay = np.ones(len(ids), bool)
        stay[hit] = False
        self.parts, self.n = [(bucket[stay], ids[stay], rows[stay], at[stay], words.dictionary, passages[stay])], int(stay.sum())
        hit = hit[np.argsort(bucket[hit], kind="stable")]
        for own in np.split(hit, np.flatnonzero(np.diff(bucket[hit])) + 1):
            if len(own):
                yield int(bucket[own[0]]), _hits(rows[own], at[own])


def _trees(most: int) -> Callable:
    """The repeats under one prefix, batch by batch, so that a passage of very many buckets is never held whole; known ones as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, limit = _Held(), most

        def told() -> pa.RecordBatch:
            found = list(held.repeats())
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), binary([x for _, x in found])], ["bucket", "blob"])

        for batch in batches:
            if batch.num_rows and batch.column("cell")[0].as_py() < 0:
                yield batch.select(["bucket", "blob"])
                continue
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                held.add(bucket, blob)
                if held.n > limit:
                    yield told()
                    limit = max(most, 2 * held.n)
        if held.n:
            yield told()

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _rewritten(docs: pa.Table, found: pa.Table) -> pa.Table:
    starts: dict[int, list[np.ndarray]] = {}
    for blob in found.column("blob").to_pylist():
        rows, own, at = unpack(blob, rising=(0,))
        by = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[by], np.arange(len(rows) + 1))
        for i, row in enumerate(rows.tolist()):
            starts.setdefault(row, []).append(at[by[cuts[i] : cuts[i + 1]]].astype(np.int64))
    n_words, n_removed, sha, kept_text = [], [], [], []
    for batch in docs.to_batches():
        numbers = batch.column("row").to_pylist()
        for rows, data, at in pieces(batch):
            words = Words(data, at, EXACT)
            for i, row in enumerate(numbers[rows]):
                lo, n = words.first[i], int(words.count[i])
                cover = np.zeros(n + 1, np.int64)
                for x in starts.get(row, ()):
                    np.add.at(cover, x, 1)
                    np.subtract.at(cover, x + WINDOW, 1)
                gone = np.cumsum(cover)[:n] > 0
                kept = joined(data, words.start[lo : lo + n][~gone], words.end[lo : lo + n][~gone])
                n_words.append(n)
                n_removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode("utf-8", "replace"))
    columns = [docs.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())]
    return pa.Table.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Words joined by one space."""
    if not len(start):
        return b""
    keep = np.zeros(end[-1] - start[0] + 2, np.int8)
    keep[start - start[0]] += 1
    keep[end - start[0]] -= 1
    inside = np.cumsum(keep[:-1]).astype(bool)
    inside[end[:-1] - start[0]] = True  # one separator after each word but the last
    out = data[start[0] : end[-1] + 1][inside[: end[-1] + 1 - start[0]]] if end[-1] < len(data) else np.append(data[start[0] : end[-1]], 32)[inside].astype(np.uint8)
    out = np.where(SPACE[out], np.uint8(32), out)
    return out.tobytes()


def without_repeats(docs: DataFrame, most: int = GROUP) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed, kept_sha256 and kept_text.

    A word goes if some run of 13 words over it also starts in a document of smaller doc_id. Documents are dealt to
    buckets of a few MB. Leaves that no deep inner node can have are left out first: suffixes whose first 13 words'
    fingerprint neither two buckets nor two places of their own bucket share. The others are dealt out, with their
    words, by a prefix whose length in bits follows from their number, and that is lengthened, bits at a time, wherever
    more than `most` suffixes share it. Each group's suffix array and longest common prefixes give its tree; the
    suffixes under an inner node of 13 words, but for those of its smallest document, are repeats, by their words and
    not by fingerprints. Trees end at 13 words: beyond, overlapping runs join to the maximal repeats that are cut out.

    A bucket sends of equal passages only its smallest document's, and a group takes its suffixes in batches of which
    it keeps each passage's smallest document, so a passage that a third of all documents share is never held whole.

    Null or empty texts have no words; texts under 13 words stay whole; null ids neither cause nor suffer removals.
    Rows that repeat an id are cut each by its own text, repeated rows alike. Other columns are ignored, an empty table
    gives no rows.
    """
    docs = id_and_text(docs)
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_buckets = 1 + max(size.bytes // BYTES, size.n // DOCS)
    dealt = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_buckets)))
    # in the order of ids, and numbered as written: a text is known by its row
    dealt = bucketed(dealt, "texts", min(100_000, 1 + n_buckets // TOGETHER), "bucket", "doc_id", "row")

    # so many bits that a window meets another by chance in one of 64 cases at most
    bits = min(64, (size.bytes // 2).bit_length() + 6)
    prints = dealt.groupBy("bucket").applyInArrow(_leaves(1 + size.bytes // 4 // RANGE, bits), "range long, bucket long, blob binary")
    shared = table(prints.groupBy("range").applyInArrow(_shared, "bucket long, n long, blob binary"), "shared")
    n = shared.agg(F.sum("n")).first()[0] or 0
    width = min(BITS * LONGEST, int(n // most).bit_length())
    both = lambda: dealt.groupBy("bucket").cogroup(shared.groupBy("bucket"))
    # where a prefix has over `most` suffixes, buckets with under `least` of them have a quarter of `most` at most
    counts = both().applyInArrow(_counted(width, bits, max(1, most // (4 * n_buckets))), "cell long, n long")
    heavy = counts.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("cell").collect()  # n / most a length
    sent = both().applyInArrow(_suffixes(width, bits, np.array(sorted(r.cell for r in heavy), np.int64)), "cell long, bucket long, blob binary")
    repeats = table(sent.groupBy("cell").applyInArrow(_trees(most), "bucket long, blob binary"), "repeats")
    drop_table(shared)
    return dealt.groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(_rewritten, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


#: The same over `documents` in DuckDB's SQL.
REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D ]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, k, array_to_string(words[k:k + 12], ' ') AS passage FROM (SELECT *, unnest(range(1, len(words) - 11)) AS k FROM d)),
f AS (SELECT passage, min(doc_id) AS first FROM w GROUP BY passage),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS pos FROM w JOIN f USING (passage) WHERE first < doc_id),
p AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word FROM d),
o AS (SELECT p.doc_id, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL) AS kept FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""
