"""Queries of the core library by name, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *sql: str) -> Callable[[Query], Query]:
    """Register a query; `sql` are common table expressions and, last, the statement over them."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = ("WITH RECURSIVE " + ",\n".join(sql[:-1]) + "\n" if len(sql) > 1 else "") + sql[-1]
        return run

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the walk-forward pair book of suppliers, by method and fold."""
    from .operators import pnl
    from .params import MONTHLY
    from .plans import pairs_book
    from .sources import panels

    prices = panels.supplier_panel(spark, sf_dir)
    rows = pairs_book.traded(prices, pairs_book.scan(prices, MONTHLY), MONTHLY, use_regime=False)
    return pnl.metrics(pairs_book.books(rows), ["method", "fold"], turnover="turnover", per_year=MONTHLY.periods_per_year)


from . import queries as _queries  # noqa: E402,F401 - fills the tables above
