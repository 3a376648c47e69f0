"""Whole plans and the query catalogue."""

MODULES = (
    "synchrony",
    "frames",
    "ledgers",
    "signals",
    "texts",
    "releases",
    "comparisons",
    "exchange",
)
