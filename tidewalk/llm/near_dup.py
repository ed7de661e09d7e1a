"""Near-duplicate documents by SetSketch registers, bands, a joint likelihood, and a check on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, id_and_text, table
from .graph import components
from .kernel import FOLDED, U, Words, binary, mix, pieces, stream

WIDTH = 5
#: A link: 100 * intersection >= 75 * union.
LEAST = 75
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
#: SetSketch parameters: base of the exponential spacing, rate, and the last register value.
BASE, RATE, LAST = 1.001, 20.0, 65_534
#: Pairs that the registers put below this similarity are not checked further: over four standard errors under 0.75.
ESTIMATE = 0.58
#: Documents, and shingles, of a block that meets other blocks in one task (a longer document is a block's own share).
BLOCK, BLOCK_SHINGLES = 64, 400_000
_LOW = (stream(101, REGISTERS) & U(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_HIGH = (stream(102, REGISTERS) & U(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)


def shingle_sets(words: Words) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle codes; a text of fewer words is one shingle."""
    codes, at = words.windows(WIDTH, 7)
    cut = np.searchsorted(at, words.first)
    for i, n in enumerate(words.count):
        if n >= WIDTH:
            yield np.unique(codes[cut[i] : cut[i + 1]])
        elif n:
            own = words.code[words.first[i] : words.first[i + 1]] * stream(8, int(n))
            yield mix(np.array([own.sum(dtype=U) + U(n)], U))
        else:
            yield np.zeros(0, U)


def set_keys(codes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a whole shingle set."""
    both = np.array([mix(codes).sum(dtype=U), mix(codes ^ U(len(codes) + 1)).sum(dtype=U)], U)
    return tuple((mix(both * stream(seed, 2)) * stream(seed + 10, 2)).sum(dtype=U).astype(np.int64).item() for seed in (9, 29))


def registers(codes: np.ndarray) -> np.ndarray:
    """Exponentially spaced, truncated minima: the register of a union is the larger of both registers."""
    low, high = (codes & U(0xFFFFFFFF)).astype(np.uint32), (codes >> U(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(codes), 256):
        at = low[i : i + 256, None] * _LOW
        at += high[i : i + 256, None] * _HIGH
        np.minimum(least, at.min(0), out=least)
    waiting = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(waiting * RATE) / np.log(BASE)) + 20_000, 0, LAST).astype(np.uint16)


def similarity(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs, jointly from greater, equal and smaller registers and both set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (n / (n + m))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 81)[None, :-1] * np.minimum(u / v, v / u)
    p = lambda x: np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)
    up, down = p(np.maximum(u - v * grid, 0)), p(np.maximum(v - u * grid, 0))
    seen = more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(np.clip(1 - up - down, 1e-9, 1))
    return np.take_along_axis(grid, seen.argmax(1)[:, None], 1)[:, 0]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, regs = [], [], []
        for _, data, at in pieces(batch):
            for codes in shingle_sets(Words(data, at, FOLDED)):
                sizes.append(len(codes))
                keys.append(set_keys(codes) if len(codes) else (None, None))
                regs.append(registers(codes).tobytes() if len(codes) else None)
        key, check = (pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(sizes, pa.int64()), key, check, binary(regs)], ["doc_id", "t", "n", "key", "check", "regs"])


def _stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            regs = _stack(batch.column("regs")).reshape(-1, BANDS, ROWS).astype(U)
            bucket = mix((regs * stream(12, ROWS)).sum(2, dtype=U) + stream(13, BANDS))
            key = np.repeat(batch.column("key").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().astype(np.int64)), pa.array(key)], ["bucket", "key"])


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, m = (batch.column(c).to_numpy().astype(float) for c in ("n_u", "n_v"))
        likely = np.zeros(0, bool)
        if batch.num_rows:
            likely = (100 * np.minimum(n, m) >= LEAST * np.maximum(n, m)) & (similarity(_stack(batch.column("regs_u")), _stack(batch.column("regs_v")), n, m) >= ESTIMATE)
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(likely)), batch.column("v").filter(pa.array(likely))], ["u", "v"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a probe block and a target block of one bucket: likely links between different components."""
    for batch in batches:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for probes, targets in zip(batch.column("probes"), batch.column("targets"), strict=True):
            side = []
            for block in (probes.values, targets.values):
                side.append([block.field(c).to_numpy() for c in ("key", "root", "n")] + [_stack(block.field("regs"))])
            (pk, pr, pn, pg), (tk, tr, tn, tg) = side
            i, j = np.nonzero((pr[:, None] != tr[None]) & (100 * np.minimum(pn[:, None], tn[None]) >= LEAST * np.maximum(pn[:, None], tn[None])))
            for k in range(0, len(i), 4096):
                a, b = i[k : k + 4096], j[k : k + 4096]
                near = similarity(pg[a], tg[b], pn[a].astype(float), tn[b].astype(float)) >= ESTIMATE
                us.append(pk[a[near]])
                vs.append(tk[b[near]])
        u, v = np.concatenate(us), np.concatenate(vs)
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])


def _block_sets(block: pa.Array) -> list[np.ndarray]:
    out = []
    for _, data, at in pieces(pa.RecordBatch.from_arrays([block.field("text")], ["text"])):
        out += shingle_sets(Words(data, at, FOLDED))
    return out


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each probe its first target whose full shingle set is similar enough."""
    for batch in batches:
        us, vs = [], []
        for probes, targets in zip(batch.column("probes"), batch.column("targets"), strict=True):
            names, sets = targets.values.field("key").to_numpy(), _block_sets(targets.values)
            sizes = np.array([len(x) for x in sets])
            codes = np.concatenate(sets)
            order = np.argsort(codes, kind="stable")
            codes, owner = codes[order], np.repeat(np.arange(len(sets)), sizes)[order]
            for key, own in zip(probes.values.field("key").to_pylist(), _block_sets(probes.values), strict=True):
                lo, hi = np.searchsorted(codes, own), np.searchsorted(codes, own, "right")
                n = hi - lo
                at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
                both = np.bincount(owner[at], minlength=len(sets))
                good = np.flatnonzero(100 * both >= LEAST * (len(own) + sizes - both))
                if len(good):
                    us.append(key)
                    vs.append(int(names[good[0]]))
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hub, hub_set = None, np.zeros(0, U)
    for batch in batches:
        keys, hubs = batch.column("u").to_numpy(), batch.column("v").to_numpy()
        good = np.zeros(batch.num_rows, bool)
        for rows, data, at in pieces(batch, "text_u"):
            for i, own in zip(range(rows.start, rows.stop), shingle_sets(Words(data, at, FOLDED)), strict=True):
                if hub != hubs[i]:
                    text = batch.column("text_v")[i].as_buffer()
                    raw = np.frombuffer(text, np.uint8) if text is not None and text.size else np.zeros(0, np.uint8)
                    hub, hub_set = hubs[i], next(shingle_sets(Words(raw, np.array([0, len(raw)]), FOLDED)))
                both = len(np.intersect1d(own, hub_set, assume_unique=True))
                good[i] = 100 * both >= LEAST * (len(own) + len(hub_set) - both)
        good = pa.array(good)
        yield pa.RecordBatch.from_arrays([pa.array(keys).filter(good), pa.array(hubs).filter(good)], ["u", "v"])


def _with_registers(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    for side in ("u", "v"):
        pairs = pairs.join(classes.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}"), F.col("regs").alias(f"regs_{side}")), side)
    return pairs


def _texts(keys: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """One text (key, text) of each class; an id alone doesn't tell which, as rows can repeat it."""
    reps = classes.join(keys, "key").select("key", "rep.doc_id", "rep.t")
    return table(docs.join(reps, ["doc_id", "t"]).dropDuplicates(["key"]).select("key", "text"), "texts")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs of class keys (u, v) whose representatives' full shingle sets are similar enough."""
    pairs = table(pairs.distinct(), "pairs")
    texts = _texts(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct(), classes, docs)
    joined = pairs.join(texts.select(F.col("key").alias("u"), F.col("text").alias("text_u")), "u")
    joined = joined.join(texts.select(F.col("key").alias("v"), F.col("text").alias("text_v")), "v")
    found = table(joined.sortWithinPartitions("v").mapInArrow(_verify, "u long, v long").distinct(), "confirmed")
    drop_table(texts)
    drop_table(pairs)
    return found


def _between_others(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """Likely links of bucket members that are outside their bucket's main component, block against block."""
    cells = cells.join(classes.select("key", "n", "regs"), "key")
    cells = cells.withColumn("block", F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / BLOCK)))
    packed = cells.groupBy("bucket", "block").agg(F.collect_list(F.struct("key", "root", "n", "regs")).alias("probes"))
    targets = packed.select("bucket", F.col("block").alias("other"), F.col("probes").alias("targets"))
    return packed.join(targets, "bucket").where("block <= other").select("probes", "targets").mapInArrow(_across, "u long, v long").distinct()


def _with_main(cells: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """For bucket members outside the main component one confirmed link to each block of it, if there is any.

    Full sets are compared inside a task, block against block, so the pairs that fail are never rows.
    """
    blocks = []
    for side, own in (("probes", "root <> main"), ("targets", "root = main")):
        ends = cells.where(own).select("key", "main").distinct().join(classes.select("key", "n"), "key")
        size = ends.groupBy("main").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias(f"n_{side}"))
        blocks.append((table(ends, side), size))
    (probes, _), (targets, n_targets) = blocks
    keys = probes.select("key").union(targets.select("key")).distinct()
    texts = _texts(keys, classes, docs)
    packed = []
    for side, (ends, size) in zip(("probes", "targets"), blocks, strict=True):
        dealt = ends.join(size, "main").withColumn("block", F.pmod(F.xxhash64("key"), F.col(f"n_{side}"))).join(texts, "key")
        packed.append(dealt.groupBy("main", "block").agg(F.collect_list(F.struct("key", "text")).alias(side)))
    left = packed[0].join(n_targets, "main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_targets") - 1)))
    pairs = left.join(packed[1], ["main", "block"]).select("probes", "targets")
    found = table(pairs.mapInArrow(_against, "u long, v long"), "main")
    for done in (texts, probes, targets):
        drop_table(done)
    return found


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketches and one row a class: key, n, regs and rep (its smallest doc_id, and that text's hash).

    A class is a set of shingles, told by 128 bits: sets that share `key` but not `check` get keys of their own.
    """
    while True:
        known = rows.where("key IS NOT NULL AND doc_id IS NOT NULL")
        both = [F.min("check").alias("lo"), F.max("check").alias("hi")]
        classes = table(known.groupBy("key").agg(*both, F.min(F.struct("doc_id", "t")).alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")), "classes")
        clash = classes.where("lo <> hi").select("key", F.lit(True).alias("clash"))
        if clash.isEmpty():
            return rows, classes.drop("lo", "hi")
        rows = rows.join(clash, "key", "left").withColumn("key", F.when(F.col("clash"), F.xxhash64("key", "check")).otherwise(F.col("key"))).drop("clash")
        rows = table(rows, "sketches")


def _by_id(links: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Links between the classes' smallest doc_ids, and between the classes that one doc_id has."""
    ids = classes.select("key", F.col("rep.doc_id").alias("id"))
    own = rows.where("key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "key").distinct()
    several = own.groupBy("doc_id").agg(F.min("key").alias("u"), F.max("key").alias("v")).where("u <> v")
    links = links.union(own.join(several.select("doc_id", "u"), "doc_id").select("u", F.col("key").alias("v")).where("u <> v"))
    for side in ("u", "v"):
        links = links.join(ids.withColumnRenamed("key", side), side).drop(side).withColumnRenamed("id", side)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z; documents with 100 * shared shingles >= 75 * all shingles are linked and
    component_id is the smallest doc_id reachable. Equal shingle sets form one class before anything else, so
    exact copies never make pairs. Classes meet in 32 bands of 4 registers; each bucket's members are tried with its
    most central member (the one whose buckets hold most classes), and what stays outside that member's component is
    tried with all the bucket's other members, block by block. Pairs that the joint likelihood does not exclude are confirmed on
    full sets. A pair at similarity 0.75 misses all bands with odds of 5 in a million, less above.

    Null or wordless texts: 0 shingles, linked with nothing, kept. Null doc_id: returned with null component, kept.
    Rows that repeat an id, with whatever texts, are one document: those with words share a component. Other columns
    are ignored; an empty table gives no rows.
    """
    docs = id_and_text(docs).withColumn("t", F.xxhash64("text"))
    rows = table(docs.mapInArrow(_sketch, "doc_id long, t long, n long, key long, check long, regs binary"), "sketches")
    rows, classes = _classes(rows)
    band = classes.select("key", "regs").mapInArrow(_bands, "bucket long, key long")
    full = band.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = table(band.join(full, "bucket"), "members")
    central = members.groupBy("key").agg(F.sum("size").alias("weight"))
    hubs = table(members.join(central, "key").groupBy("bucket").agg(F.max(F.struct("weight", "key"))["key"].alias("hub")), "hubs")
    stars = members.join(hubs, "bucket").where("key <> hub").select(F.greatest("key", "hub").alias("u"), F.least("key", "hub").alias("v")).distinct()
    stars = table(_with_registers(stars, classes).mapInArrow(_estimate, "u long, v long"), "stars")
    links = _confirmed(stars, classes, docs)
    roots = table(components(links), "roots")

    rooted = members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    main = mixed.join(hubs, "bucket").join(roots.select(F.col("node").alias("hub"), F.col("root").alias("main")), "hub", "left")
    main = main.select("bucket", F.coalesce("main", "hub").alias("main"))
    cells = table(rooted.join(main, "bucket"), "cells")
    more = _between_others(cells.where("root <> main"), classes).join(stars, ["u", "v"], "left_anti")
    more = _confirmed(more, classes, docs).union(_with_main(cells, classes, docs))
    roots = components(_by_id(links.union(more), classes, rows))
    ids = classes.select("key", F.col("rep.doc_id").alias("node")).join(roots, "node", "left")
    component = ids.select("key", F.coalesce("root", "node").alias("component_id"))
    has = rows.where("key IS NOT NULL AND doc_id IS NOT NULL").join(component, "key").select("doc_id", "n", "component_id")
    none = rows.where("key IS NULL OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return has.union(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose document stands for its component; rows that repeat its id all stay, as do null ids."""
    keep = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_kept_id"]), "left_semi")


#: The same over `documents` in DuckDB's SQL.
NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[k:k + 4], ' ') AS shingle FROM (SELECT *, unnest(range(1, greatest(len(words) - 3, 2))) AS k FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 75 * (p.n + q.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(least, d.doc_id), d.doc_id) AS component_id, d.doc_id = coalesce(least(least, d.doc_id), d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""
