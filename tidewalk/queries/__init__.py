"""The operators applied to panels of the test tables, each with its SQL counterpart."""

from . import baskets, books, factors, learned, pairs, panels, universe  # noqa: F401
