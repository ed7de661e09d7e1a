"""Token sequences filled first-fit decreasing by a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, in_parts
from .kernel import EXACT, FOLDED, SPACE, U, Words, pieces

#: Tokens of a sequence, the id that ends a document, documents packed together, distinct words a worker remembers.
LENGTH, END, GROUP, REMEMBERED = 4096, 2, 4_000, 2_000_000
#: The vocabulary splits ASCII words from these marks and lower-cases, so a word is met once whatever case and mark it has.
_MARKS, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_MARKS[list(b".,;:!?")] = True
_PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = True
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def parts_of(data: np.ndarray, at: np.ndarray) -> Words:
    """Parts of texts that the vocabulary encodes alone. Its special tokens are told by case, so then case counts."""
    special = b"<|" in data.tobytes()
    return Words(data, at, EXACT if special else FOLDED, SPACE, (_MARKS, _PLAIN))


class WordTokens:
    """Token ids of whole texts, each distinct word encoded once.

    The vocabulary's white space is dropped and its words are encoded alone, so a text's ids are those of its
    pieces between ASCII white space, one after another.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self._empty()

    def _empty(self) -> None:
        self.codes, self.checks, self.begin, self.size = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, encoded), np.int32, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(size.sum())), size

    def _learn(self, words: Words, codes: np.ndarray, checks: np.ndarray, at: np.ndarray) -> None:
        if len(self.codes) > REMEMBERED:
            self._empty()
        place = np.searchsorted(self.codes, codes)
        fresh = np.ones(len(codes), bool)
        inside = place < len(self.codes)
        fresh[inside] = self.codes[place[inside]] != codes[inside]
        new, raw = at[fresh], words.data.tobytes()
        if not len(new):
            return
        ids, size = self._encoded([raw[a:b].decode("utf-8", "replace") for a, b in zip(words.start[new].tolist(), words.end[new].tolist(), strict=True)])
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        fields = ((self.codes, codes[fresh]), (self.checks, checks[fresh]), (self.begin, begin), (self.size, size))
        self.codes, self.checks, self.begin, self.size = (np.insert(old, place[fresh], x) for old, x in fields)

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin and end.

        Words are told by 128 bits; texts with words that share the first 64 only are encoded without the memory.
        """
        codes, at, back = np.unique(words.code, return_index=True, return_inverse=True)
        checks = words.checks()
        self._learn(words, codes, checks[at], at)
        row = np.searchsorted(self.codes, codes)[back]
        if (self.checks[row] != checks).any():
            raw = words.data.tobytes()
            ids, size = self._encoded([raw[a:b].decode("utf-8", "replace") for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True)])
            return ids, np.concatenate([[0], np.cumsum(size)])
        begin, size = self.begin[row], self.size[row]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)
        return self.ids[place], np.concatenate([[0], ends])[words.first]


@cache
def word_tokens(vocabulary: str) -> WordTokens:
    """One for all tasks of a worker, so that words met before stay known."""
    return WordTokens(vocabulary)


#: Columns of pieces; `deal` tells the documents apart that are dealt to groups, repeated rows too.
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"


def _cut(vocabulary: str, with_ids: bool) -> Callable:
    """Pieces of at most LENGTH ids."""
    names = [x.split()[0] for x in _PIECES.split(",")] + ["ids"] * with_ids
    kinds = [pa.int64()] * 6 + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(vocabulary)
        met: Counter = Counter()
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            out: list[tuple] = []
            for rows, data, at in pieces(batch):
                ids, ends = tokens.encode(parts_of(data, at))
                for i, doc in enumerate(docs[rows]):
                    own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(END)).astype("<u4")
                    crc = zlib.crc32(own.tobytes())
                    met[doc, crc] += 1  # equal rows can take each other's number, so a task that runs again deals alike
                    deal = zlib.crc32(repr((doc, crc, met[doc, crc])).encode())
                    for start in range(0, len(own), LENGTH):
                        raw = own[start : start + LENGTH].tobytes()
                        out.append((doc, start, len(raw) // 4, zlib.crc32(raw), len(own), deal, *[raw] * with_ids))
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    return run


def first_fit_decreasing(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first into the first bin with room.

    A tournament tree holds at each inner node the most room of the bins below, so the first bin that fits is found
    by one walk from the root.
    """
    width = 1
    while width < max(1, len(lengths)):
        width *= 2
    room = [most] * (2 * width)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        need, node = int(lengths[i]), 1
        while node < width:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - width, most - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
    bins, offsets = first_fit_decreasing(group["length"].to_numpy(), LENGTH)
    group["sequence_id"] = (group.pop("grp").to_numpy() << 32) + bins
    group["offset"] = offsets
    return group.drop(columns="deal")


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with `with_ids` the ids as little-endian 32-bit numbers.

    A document's ids are its text's, then id 2; a longer one is cut every 4096 ids. Documents are dealt to groups of
    about 4,000 by a hash of id, text and, for equal rows, their number, and each group is packed first-fit decreasing
    on its own, so no group grows with the corpus. Null or empty texts are the one id 2; rows that repeat an id are
    packed one by one; null ids are kept. Other columns are ignored; an empty table gives no rows.
    """
    groups = in_parts(docs.count(), GROUP)
    more = ", ids binary" * with_ids
    cut = id_and_text(docs).mapInArrow(_cut(vocabulary, with_ids), _PIECES + more)
    cut = cut.withColumn("grp", F.pmod(F.xxhash64("deal", F.lit(17)), F.lit(groups)))
    return cut.groupBy("grp").applyInPandas(_fill, _PIECES.replace(", deal long", "") + more + ", sequence_id long, offset long")
