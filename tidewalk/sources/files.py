"""Sinks and sources besides parquet tables: partitioned curves, CSV and JSON reports, HTML tables, contract lists."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.universe import valid_tickers


#: 2100-01-01 in milliseconds.
AFTER_ALL = 4_102_444_800_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares; on a local master that names none, in the temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/tidewalk-{name}-{uuid.uuid4().hex}"


def write_curves(curves: DataFrame, path: str) -> None:
    """Return curves of several runs, one folder for each tag and method, so that a reader prunes the others."""
    curves.write.mode("overwrite").partitionBy("tag", "method").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_log(log: DataFrame, path: str) -> None:
    log.write.mode("overwrite").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def markdown(report: DataFrame, most: int = 200) -> str:
    """A small report as a Markdown table, its first `most` rows."""
    head = report.columns
    rows = [[("" if v is None else str(v)) for v in r] for r in report.limit(most).collect()]
    return "\n".join(["| " + " | ".join(x) + " |" for x in (head, ["---"] * len(head), *rows)])


def contracts(raw: DataFrame, column: str = "json", open_ended: int | None = None) -> DataFrame:
    """Perpetual contracts of a JSON list: symbol, status, onboard, delivery (null where open-ended).

    Open-ended are contracts whose delivery date is `open_ended`, the list's own mark in milliseconds, and no others. Where
    no mark is known, they are those after 2100-01-01.
    """
    kind = "array<struct<symbol:string,contractType:string,quoteAsset:string,status:string,onboardDate:long,deliveryDate:long>>"
    rows = raw.select(F.inline(F.from_json(column, kind)))
    rows = rows.where("contractType = 'PERPETUAL' AND quoteAsset = 'USDT' AND status IN ('TRADING', 'SETTLING')")
    end = F.col("deliveryDate")
    dated = end <= AFTER_ALL if open_ended is None else end != open_ended
    return rows.select("symbol", "status", F.timestamp_millis("onboardDate").cast("timestamp_ntz").alias("onboard"), F.when(dated, F.timestamp_millis(end)).cast("timestamp_ntz").alias("delivery"))


class _Tables(HTMLParser):
    """The cells of all tables of a page, row by row."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[int] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append(len(self.tables))
            self.tables.append([])
        elif self.open and tag == "tr":
            self.tables[self.open[-1]].append([])
        elif self.open and tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th") and self.open and self.cell is not None:
            rows = self.tables[self.open[-1]]
            if not rows:
                rows.append([])
            rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def tables_of(html: str) -> list[list[list[str]]]:
    parser = _Tables()
    parser.feed(html or "")
    return parser.tables


#: Headers that constituent lists have used; the first of them that a table has counts.
ALIASES = {
    "ticker": ("symbol", "ticker symbol", "ticker"),
    "name": ("security", "company", "name"),
    "sector": ("gics sector", "gics  sector", "sector"),
    "sub_industry": ("gics sub-industry", "gics sub industry", "sub-industry"),
}


def constituents(html: str, least: int = 300) -> list[tuple]:
    """(ticker, name, sector, sub_industry) of the first table with ticker and sector columns and over `least` data rows.

    Raises LookupError if there is none; other columns that a table lacks are empty.
    """
    for table in tables_of(html):
        header = [" ".join(c.lower().split()) for c in table[0]] if table else []
        at = {k: next((header.index(a) for a in map(" ".join, map(str.split, names)) if a in header), None) for k, names in ALIASES.items()}
        if len(table) - 1 > least and at["ticker"] is not None and at["sector"] is not None:
            return [tuple(row[i] if i is not None and i < len(row) else "" for i in at.values()) for row in table[1:]]
    raise LookupError("no table of constituents in this page")


def html_constituents(pages: DataFrame, least: int = 300, strict: bool = False) -> DataFrame:
    """page_id, ticker, name, sector, sub_industry of all pages' constituent tables, tickers normalised, of 1 to 6 characters.

    A page without such a table has no rows, or with `strict` fails the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, html in zip(batch.page_id, batch.html, strict=True):
                try:
                    rows += [(i, *r) for r in constituents(html, least)]
                except LookupError:
                    if strict:
                        raise
            yield pd.DataFrame(rows, columns=["page_id", *ALIASES])

    raw = pages.select("page_id", "html").mapInPandas(run, "page_id long, ticker string, name string, sector string, sub_industry string")
    return valid_tickers(raw, "ticker")


def html_cells(pages: DataFrame) -> DataFrame:
    """page_id, table_no, row_no, cells of every table of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, t, r, cells) for i, html in zip(batch.page_id, batch.html, strict=True) for t, table in enumerate(tables_of(html)) for r, cells in enumerate(table)]
            yield pd.DataFrame(rows, columns=["page_id", "table_no", "row_no", "cells"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, table_no int, row_no int, cells array<string>")
