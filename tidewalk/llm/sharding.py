"""Contiguous shards of near-equal bytes from global prefix sums, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, id_and_text, table

#: Hexadecimal digits of the text's hash that name a part of the global order; bytes that a row weighs besides its text.
DIGITS, ROW_BYTES = 3, 16
PARTS = 16**DIGITS


def _with_parts(rows: DataFrame) -> DataFrame:
    """Each row's part of the order, named by cell, seg and way, which sort as their rows do.

    A cell is all rows whose text's hash begins alike. A text with more rows than half a mean cell is a segment of its
    own between the cell's other texts, split into ways by the hash of the id, so that no part grows with one text.
    """
    texts = rows.groupBy("h").agg(F.count("*").alias("n"))
    mean = rows.agg(F.greatest(F.ceil(F.count("*") / PARTS), F.lit(64)).alias("mean"))  # one row
    often = texts.join(F.broadcast(mean)).where("2 * n > mean").select("h", F.substring("h", 1, DIGITS).alias("cell"), F.ceil(F.col("n") / F.col("mean")).alias("ways"))
    # fewer than 2 * PARTS texts can have over half a mean's rows
    often = often.groupBy("cell").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("h", "ways")))).alias("often"))
    rows = rows.withColumn("cell", F.substring("h", 1, DIGITS)).join(F.broadcast(often), "cell", "left")
    own = F.map_contains_key("often", F.col("h"))
    before = F.size(F.filter(F.map_keys("often"), lambda x: x < F.col("h")))
    seg = F.when(F.col("often").isNull(), 0).otherwise(2 * before + own.cast("int"))
    share = F.conv(F.substring("g", 1, 8), 16, 10).cast("double") / 2.0**32
    way = F.when(F.col("often").isNull() | ~own | (F.col("g") == ""), 0).otherwise(F.floor(share * F.col("often")[F.col("h")]))
    return rows.select("doc_id", "size", "text_crc32", "h", "g", "cell", seg.alias("seg"), way.cast("int").alias("way"))


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Per row of `docs`: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Rows stand in one global order, by the MD5 of the text, then that of the id, so equal texts are neighbours. The
    order is dealt out in parts that a row's hashes name (a text with very many rows has several parts of its own);
    the parts' totals are summed up, rows are summed within their part, and the running total is cut at equal
    targets. Shards are contiguous and differ by about one row's bytes; a group of equal texts is split only where a
    cut falls into it.

    Null texts weigh only the row's 16 bytes and stand with the empty text; null ids come first among equal texts;
    repeated rows take slots of their own. Other columns are ignored; an empty table gives no rows.
    """
    rows = id_and_text(docs)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    g = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    rows = rows.select("doc_id", (F.octet_length(raw).cast("long") + ROW_BYTES).alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("h"), g.alias("g"))
    sizes = table(rows, "sizes")
    rows = _with_parts(sizes)

    # at most a few times PARTS rows
    part = ["cell", "seg", "way"]
    totals = rows.groupBy(*part).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *part, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("total")
    )
    inside = Window.partitionBy(*part).orderBy("h", "g", "doc_id")
    placed = rows.join(F.broadcast(starts), part).select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("row"),
        (F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("at"),
        "total",
    )
    placed = table(placed.select("doc_id", "size", "text_crc32", "row", F.expr(f"cast((at * {int(shards)}) div total as int)").alias("shard")), "placed")
    drop_table(sizes)
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


#: The same over `documents` in DuckDB's SQL; the checksum is worked out byte by byte.
SHARD_SQL = r"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
b AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
r AS (SELECT doc_id, len(bytes) + 16 AS size, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS text_crc32,
    md5(text) AS h, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS g FROM b, t),
o AS (SELECT doc_id, size, text_crc32, row_number() OVER w AS row, CAST(sum(size) OVER (w ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS ahead, CAST(sum(size) OVER () AS BIGINT) AS total
    FROM r WINDOW w AS (ORDER BY h, g, doc_id)),
s AS (SELECT *, (ahead * 40) // total AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row - min(row) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
