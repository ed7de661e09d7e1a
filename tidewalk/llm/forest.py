"""Nearest vectors by a forest of sorted hash strings, descended to prefix matches and ascended for more."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, table

#: Trees, bits of a hash string, rows of a block (one forest each), queries that meet a block in one row.
TREES, BITS, ROWS, QUERIES = 256, 24, 16_384, 4_096
#: Trees ascend until a row as near as the last of the k best would be missed by all of them with odds under this.
MISS = 0.05
#: Rows of a block from which a tree's cuts are fitted; trees and queries worked on at a time.
SAMPLE, SOME, BATCH = 512, 16, 256


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array<double>), dim of the vectors that take part, once each."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & finite & F.exists("x", lambda v: v != 0)).withColumn("dim", F.size("x"))


class Forest:
    """Per tree the rows of a block sorted by hash string; a bit says on which side of a random cut a row lies."""

    def __init__(self, x: np.ndarray, saved: tuple[np.ndarray, ...] | None = None) -> None:
        self.x, self.n = x, len(x)
        if saved:
            self.cuts, self.hashes, self.order = saved
        else:
            rng = np.random.default_rng([20260819, 1, x.shape[1]])
            some = np.sort(rng.permutation(self.n)[:SAMPLE])
            at = (rng.uniform(0.35, 0.65, (TREES, BITS)) * len(some)).astype(int)
            self.cuts = np.empty((TREES, BITS), np.float32)
            for t in range(0, TREES, SOME):
                side = np.sort(self._sides(x[some], t), axis=0)
                self.cuts[t : t + SOME] = np.take_along_axis(side, at[None, t : t + SOME], 0)[0]
            hashes = self.strings(x)
            self.order = np.argsort(hashes, axis=1, kind="stable").astype(np.uint16 if self.n <= 65_536 else np.uint32)
            self.hashes = np.take_along_axis(hashes, self.order.astype(np.int64), 1)

    def _sides(self, x: np.ndarray, tree: int) -> np.ndarray:
        """Rows x SOME trees x BITS: how far rows lie along the cuts' axes."""
        axes = np.random.default_rng([20260819, 2, x.shape[1], tree]).normal(size=(x.shape[1], SOME * BITS)).astype(np.float32)
        return (x.astype(np.float32) @ axes).reshape(len(x), SOME, BITS)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """Hash strings, trees x rows."""
        out = np.zeros((TREES, len(x)), np.uint32)
        for t in range(0, TREES, SOME):
            bits = self._sides(x, t) > self.cuts[t : t + SOME]
            for b in range(BITS):
                out[t : t + SOME] = (out[t : t + SOME] << np.uint32(1)) | bits[:, :, b].T
        return out

    def search(self, queries: np.ndarray, k: int, miss: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows that were met, and their distances.

        All trees descend to the longest prefix match and ascend in step. The share of hash bits in which the k-th
        best row so far agrees with the query tells how likely a tree shows a row as near as that at the present
        depth; when all trees together would miss it with odds under `miss`, the ascent ends. The root is the whole
        block, so `miss` = 0 is an exact search.
        """
        rows_of = np.empty_like(self.hashes)  # hash strings by row, for the agreement
        np.put_along_axis(rows_of, self.order.astype(np.int64), self.hashes, 1)
        for start in range(0, len(queries), BATCH):
            points = queries[start : start + BATCH]
            strings = self.strings(points)
            lo, hi = (np.empty((BITS + 1, TREES, len(points)), np.int32) for _ in "lh")
            for depth in range(BITS + 1):
                prefix = (strings >> np.uint32(BITS - depth)).astype(np.uint64)
                for t in range(TREES):
                    lo[depth, t] = np.searchsorted(self.hashes[t], (prefix[t] << np.uint64(BITS - depth)).astype(np.uint32))
                    hi[depth, t] = np.searchsorted(self.hashes[t], ((prefix[t] + np.uint64(1)) << np.uint64(BITS - depth)).astype(np.uint32))
            many = (hi - lo).sum(1)
            for i, point in enumerate(points):
                seen = np.zeros(self.n, bool)
                rows, score = np.zeros(0, np.int64), np.zeros(0)
                for depth in range(BITS, -1, -1):
                    if many[depth, i] <= k and depth:
                        continue
                    here = np.zeros(self.n, bool)
                    for t in range(TREES):
                        here[self.order[t, lo[depth, t, i] : hi[depth, t, i]]] = True
                    new = np.flatnonzero(here & ~seen)
                    seen |= here
                    rows = np.concatenate([rows, new])
                    score = np.concatenate([score, np.sqrt(((self.x[new] - point) ** 2).sum(1))])
                    if len(rows) <= k:  # the query itself may be among them
                        continue
                    last = rows[np.argpartition(score, k)[k // 2 : k + 1]]
                    same = 1 - np.bitwise_count(rows_of[:, last] ^ strings[:, i, None]).sum() / (TREES * BITS * len(last))
                    if (1 - same**depth) ** TREES <= miss:
                        break
                yield rows, score


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1)


def _plant(block: pa.Table) -> pa.Table:
    ids, x = block.column("vec_id").combine_chunks().to_numpy(), _matrix(block.column("x").combine_chunks(), block.num_rows)
    by = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[by], x[by]
    forest = Forest(x)
    blobs = [ids.astype("<i8"), x.astype("<f8"), forest.cuts.astype("<f4"), forest.hashes.astype("<u4"), forest.order]
    return pa.table({"dim": block.column("dim")[:1], "block": block.column("block")[:1], **{f"b{i}": pa.array([b.tobytes()], pa.binary()) for i, b in enumerate(blobs)}})


def _found(k: int, miss: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for i in range(batch.num_rows):
                raw = [batch.column(f"b{j}")[i].as_buffer() for j in range(5)]
                ids = np.frombuffer(raw[0], "<i8")
                n, dim = len(ids), batch.column("dim")[i].as_py()
                x = np.frombuffer(raw[1], "<f8").reshape(n, dim)
                order = np.frombuffer(raw[4], np.uint16 if n <= 65_536 else np.uint32).reshape(TREES, n)
                forest = Forest(x, (np.frombuffer(raw[2], "<f4").reshape(TREES, BITS), np.frombuffer(raw[3], "<u4").reshape(TREES, n), order))
                own = batch.column("queries")[i].values
                q_ids, q_rows, points = own.field("vec_id").to_numpy(), own.field("q").to_numpy(), _matrix(own.field("x"), len(own))
                for q_id, q_row, point, (rows, score) in zip(q_ids, q_rows, points, forest.search(points, k, miss), strict=True):
                    other = np.ones(len(rows), bool)
                    mine = np.flatnonzero(ids[rows] == q_id)  # its own row, not others that have its id
                    other[mine] = (x[rows[mine]] != point).any(1)
                    best = np.flatnonzero(other)
                    ranked = len(best)
                    if ranked > 4 * k:
                        best = best[score[best] <= np.partition(score[best], 4 * k)[4 * k]]
                    best = best[np.lexsort((ids[rows[best]], score[best]))[:k]]
                    out.append((np.full(len(best), q_row), np.full(len(best), q_id), ids[rows[best]], score[best], np.full(len(best), ranked)))
            kinds = (np.int64, np.int64, np.int64, np.float64, np.int64)
            columns = [np.concatenate(c).astype(kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [np.zeros(0, kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "query_id", "vec_id", "score", "ranked"])

    return run


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, miss: float = MISS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other vectors by Euclidean distance.

    Queries are the rows whose vec_id `every` divides. All rows are dealt to blocks by a hash of the id; a block's
    index is a forest of sorted 24-bit hash strings, kept in a table. Each query descends all trees of a block to
    its longest prefix matches and ascends them in step until a row as near as its k-th best would hardly have been
    missed (`miss`; 0 searches exactly); what was met is ranked by exact distances, and blocks' best are merged.
    `ranked` is how many rows of its block were ranked. How far the ascent goes is up to the data: a few rows of clustered
    vectors, a large share of isotropic ones (see the tests and the README).

    Null, empty, zero or non-finite vectors and null ids take no part. Only vectors of equal length meet. Rows that
    repeat both id and vector count once; rows that repeat an id with another vector are queries and candidates of
    their own. Ties go to the smaller vec_id. Other columns are ignored; an empty table gives no rows.
    """
    rows = table(usable(vectors).dropDuplicates(["vec_id", "x"]), "vectors")
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / ROWS).alias("blocks"))
    dealt = rows.join(F.broadcast(sizes), "dim")  # one row a vector length
    indexed = dealt.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.col("blocks")))
    kinds = "dim int, block long, b0 binary, b1 binary, b2 binary, b3 binary, b4 binary"
    index = table(indexed.select("dim", "block", "vec_id", "x").groupBy("dim", "block").applyInArrow(_plant, kinds), "forest")
    queries = dealt.where(F.col("vec_id") % every == 0).withColumn("q", F.xxhash64("vec_id", "x"))
    groups = queries.groupBy("dim").agg(F.ceil(F.count("*") / QUERIES).alias("groups"))
    queries = queries.join(F.broadcast(groups), "dim").withColumn("grp", F.pmod(F.xxhash64("q"), F.col("groups")))
    packed = queries.groupBy("dim", "grp", "blocks").agg(F.collect_list(F.struct("q", "vec_id", "x")).alias("queries"))
    packed = packed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = packed.select("dim", "block", "queries").join(index, ["dim", "block"])
    found = table(met.mapInArrow(_found(k, miss), "q long, query_id long, vec_id long, score double, ranked long"), "found")
    for done in (rows, index):
        drop_table(done)
    best = Window.partitionBy("query_id", "q").orderBy("score", "vec_id")
    placed = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return placed.select("query_id", "rank", "vec_id", "score", "ranked")
