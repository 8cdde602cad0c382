"""Charge, balance and status rules of one passage, and identifier formats.

Columns are given by name, or as any SQL expression over the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gantry.schemas import BLACKLISTED_TAGS

SUCCESS, LOW_BALANCE, FLAGGED = "SUCCESS", "LOW_BALANCE", "FLAGGED"


def blacklist_test(tag: str, blacklist: Sequence[str] = BLACKLISTED_TAGS) -> Column:
    """Membership in a literal list; a null tag is not listed."""
    return F.coalesce(F.array_contains(F.lit(list(blacklist)), F.col(tag)), F.lit(False))


def status_after(tag: str, balance: str, amount: str, blacklist: Sequence[str] = BLACKLISTED_TAGS) -> Column:
    """Blacklist first, then balance, else success."""
    short = F.expr(f"{balance} < {amount}")
    return F.when(blacklist_test(tag, blacklist), FLAGGED).when(short, LOW_BALANCE).otherwise(SUCCESS)


def charge(base_rate: str, trips: str) -> Column:
    return F.expr(f"CAST({base_rate} * {trips} AS DECIMAL(10,2))")


def balance_after(balance: str, amount: str) -> Column:
    """Never below zero, and unknown when the balance before is unknown."""
    return F.expr(f"CAST(CASE WHEN {balance} < {amount} THEN 0 ELSE {balance} - {amount} END AS DECIMAL(10,2))")


def numbered(prefix: str, number: str, width: int) -> str:
    """SQL for a zero-padded identifier; numbers wider than `width` keep all their digits."""
    limit = 10**width
    padded = f"substring(CAST({number} + {limit} AS STRING), 2)"
    return f"'{prefix}' || IF({number} < {limit}, {padded}, CAST({number} AS STRING))"


def tag_number(number: str) -> Column:
    return F.expr(numbered("TAG-", number, 5))


def vehicle_key(tag: Column | str) -> Column:
    """Surrogate key of a tag: stable across runs, and needs no global numbering."""
    return F.xxhash64(tag)
